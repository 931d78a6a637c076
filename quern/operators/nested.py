"""Nested JSON records as linked flat tables: problem 3.

A batch of texts is indexed as one byte array: quotes and escapes give the bitmap of what lies inside
strings, structural characters outside them are the tokens, and prefix sums over brackets give their depth.
Ordered by depth, the tokens of one container lie side by side, so spans, places in lists and parents come
from array operations, and rows are emitted by masks. No text is walked through character by character.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import table

# Sections and lists of a resume, older key names beside those they count under.
SECTIONS = {
    "work_experience": "work_experience", "experience": "work_experience", "education": "education", "projects": "projects",
    "certifications": "certifications", "skills": "skills",
}
LISTS = {"bullets": "bullets", "coursework": "coursework", "technologies": "technologies", "tech": "technologies"}


class Shape(NamedTuple):
    """What of a record becomes rows: members of the root by the section they count under, members of an entry by the kind of items they
    count under (older names beside the newer ones), and sections that may hold lists by category."""

    sections: dict[str, str]
    lists: dict[str, str]
    categories: tuple[str, ...] = ()


RESUME = Shape(SECTIONS, LISTS, ("skills",))

_KINDS = np.zeros(256, np.uint8)
for _i, _c in enumerate(b"{}[]:,", 1):
    _KINDS[_c] = _i
OPEN_O, CLOSE_O, OPEN_A, CLOSE_A, COLON, COMMA = range(1, 7)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0D]] = True
_PLAIN = re.compile(rb"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null")


class Index:
    """The structural index of a batch of JSON texts.

    Tokens are the structural characters outside strings, in order. For token i: at, doc, kind, depth, box (the
    token that opens its container), and, if it opens a slot ('[', ':' or ',' in a list), end: the token that
    closes the slot, lo:hi the bytes of its value without blanks, opens: the token that opens the value's
    container or -1, place: its number in the list. ok: by text, whether it is valid JSON with an object or
    list outside.
    """

    def __init__(self, texts: list[bytes]) -> None:
        n = len(texts)
        self.buf = b = np.frombuffer(b"".join(texts), np.uint8)
        self.starts = s = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.ok = ok = np.ones(n, bool)
        self.kind = self.doc = self.at = np.zeros(0, np.int64)
        if not len(b):
            ok[:] = False
            return
        doc_of = np.repeat(np.arange(n), np.diff(s))
        quote = b == 0x22
        slash = b == 0x5C
        if slash.any():  # a quote after an odd run of backslashes is part of its string
            i = np.arange(len(b))
            run = i - np.maximum.accumulate(np.where(slash, -1, i))  # length of the run that ends here
            odd = np.concatenate([[False], (run % 2 == 1)[:-1]])
            odd[s[:-1][np.diff(s) > 0]] = False
            quote &= ~odd
        total = np.cumsum(quote)
        base = np.concatenate([[0], total])[s[:-1]]
        inside = ((total - base[doc_of]) % 2 == 1) & ~quote  # between a pair of quotes
        self.total = total
        ok &= (np.concatenate([[0], total])[s[1:]] - base) % 2 == 0
        bad = (inside & (b < 0x20)) | ((~inside) & ~quote & slash)
        np.logical_and.at(ok, doc_of[bad], False)
        self.inside, self.quote = inside, quote

        kinds = _KINDS[b]
        kinds[inside] = 0
        self.at = at = np.flatnonzero(kinds)
        self.kind = kind = kinds[at].astype(np.int64)
        self.doc = doc = doc_of[at]
        m = len(at)
        opens = (kind == OPEN_O) | (kind == OPEN_A)
        closes = (kind == CLOSE_O) | (kind == CLOSE_A)
        level = np.cumsum(opens.astype(np.int64) - closes)
        first = np.searchsorted(doc, np.arange(n))
        last = np.searchsorted(doc, np.arange(n), "right") - 1
        has = last >= first
        ok &= has
        before = np.zeros(n, np.int64)
        before[has] = np.concatenate([[0], level])[first[has]]
        level = level - before[doc]
        self.depth = depth = level + closes
        ok[has] &= (level[last[has]] == 0) & opens[first[has]] & (depth[first[has]] == 1)
        np.logical_and.at(ok, doc[(depth < 1) | ((level == 0) & (np.arange(m) != last[doc]))], False)
        self.first = first

        # tokens of one container side by side
        order = np.lexsort((np.arange(m), depth, doc))
        rank = np.empty(m, np.int64)
        rank[order] = np.arange(m)
        o_open = opens[order]
        head = np.maximum.accumulate(np.where(o_open, np.arange(m), -1))
        box = np.empty(m, np.int64)
        box[order] = np.where(head >= 0, order[np.maximum(head, 0)], -1)
        self.box = box
        follower = np.full(m, -1, np.int64)
        follower[order[:-1]] = order[1:]
        follower[closes] = -1
        follower[(follower >= 0) & (box[follower] != box)] = -1
        np.logical_and.at(ok, doc[(box < 0) | (~closes & (follower < 0))], False)
        safe = np.maximum(box, 0)
        in_object = kind[safe] == OPEN_O
        np.logical_and.at(ok, doc[closes & ((kind == CLOSE_O) != in_object)], False)
        np.logical_and.at(ok, doc[(kind == COLON) & ~in_object], False)
        nxt = np.where(follower >= 0, kind[np.maximum(follower, 0)], 0)
        # in an object '{' and ',' lead to ':', ':' to ',' or '}'; only '{' may lead to '}'
        np.logical_and.at(ok, doc[in_object & (kind == COMMA) & (nxt != COLON)], False)
        np.logical_and.at(ok, doc[(kind == OPEN_O) & (nxt != COLON) & (nxt != CLOSE_O)], False)
        np.logical_and.at(ok, doc[(kind == COLON) & (nxt != COMMA) & (nxt != CLOSE_O)], False)

        solid = np.flatnonzero(~_BLANK[b])
        tail = np.append(at[1:], len(b))

        def span(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """lo:hi without blanks at its ends; hi = lo if nothing is left."""
            if not len(solid):
                return lo, lo
            i, j = np.searchsorted(solid, lo), np.searchsorted(solid, hi)
            some = j > i
            a = np.where(some, solid[np.minimum(i, len(solid) - 1)], lo)
            return a, np.where(some, solid[np.maximum(j - 1, 0)] + 1, a)

        # text between a token and the next one
        self.lo, self.hi = span(at + 1, np.minimum(tail, s[doc + 1]))
        empty = self.hi == self.lo
        nk = np.append(kind[1:], 0)
        nk[np.append(doc[1:] != doc[:-1], True)] = 0
        value = (kind == COLON) | ((kind == COMMA) & ~in_object) | ((kind == OPEN_A) & ~((nk == CLOSE_A) & empty))
        key = ((kind == COMMA) & in_object) | ((kind == OPEN_O) & ~((nk == CLOSE_O) & empty))
        leads = value & ((nk == OPEN_O) | (nk == OPEN_A))
        np.logical_and.at(ok, doc[(leads | closes) & ~empty], False)  # nothing before or after a container
        np.logical_and.at(ok, doc[(key & (nk != COLON)) | ((key | value) & ~leads & empty)], False)
        lead_lo, lead_hi = span(s[:-1], np.where(has, at[np.minimum(first, m - 1)] if m else 0, s[1:]))
        ok &= lead_lo == lead_hi
        scalar = (value & ~leads) | key
        q = np.concatenate([[0], total])
        quotes = q[self.hi] - q[self.lo]
        text = (b[np.minimum(self.lo, len(b) - 1)] == 0x22) & (b[np.maximum(self.hi - 1, 0)] == 0x22) & (quotes == 2) & (self.hi - self.lo > 1)
        np.logical_and.at(ok, doc[key & ~text & ~empty], False)
        sl = np.concatenate([[0], np.cumsum(slash)])
        self.escaped = sl[self.hi] > sl[self.lo]
        raw = self.buf.tobytes()
        self.raw = raw
        for i in np.flatnonzero(scalar & text & self.escaped & ok[doc]):
            try:
                json.loads(raw[self.lo[i] : self.hi[i]])
            except ValueError:
                ok[doc[i]] = False
        self.null = np.zeros(m, bool)
        bare = np.flatnonzero(value & ~leads & ~text & ~empty & ok[doc])
        self.null[bare] = self.spelled(b"null", self.lo[bare], self.hi[bare])
        figures = np.concatenate([[0], np.cumsum((b >= 0x30) & (b <= 0x39))])
        long = self.hi[bare] - self.lo[bare]
        whole = (figures[self.hi[bare]] - figures[self.lo[bare]] == long) & ((b[self.lo[bare]] != 0x30) | (long == 1))
        known = self.null[bare] | whole | self.spelled(b"true", self.lo[bare], self.hi[bare]) | self.spelled(b"false", self.lo[bare], self.hi[bare])
        for i in bare[~known]:  # numbers with sign, fraction or exponent, and what is no value
            if not _PLAIN.fullmatch(raw[self.lo[i] : self.hi[i]]):
                ok[doc[i]] = False
        self.is_value, self.is_text = value & ok[doc], text
        self.opens = np.where(leads, np.arange(m) + 1, -1)
        # places: how many slots of the same container come before
        slot = value[order].astype(np.int64)
        upto = np.cumsum(slot) - slot
        place = np.empty(m, np.int64)
        place[order] = upto - np.where(head >= 0, upto[np.maximum(head, 0)], 0)
        self.place = place
        # a member's key lies before its ':'
        prev = np.maximum(np.arange(m) - 1, 0)
        self.key_lo, self.key_hi = self.lo[prev], self.hi[prev]
        self.end = follower
        # a value's bytes, containers included
        close = np.full(m, -1, np.int64)
        close[box[closes & (box >= 0)]] = np.flatnonzero(closes & (box >= 0))
        at_open = np.maximum(self.opens, 0) if m else self.opens
        in_range = (self.opens >= 0) & (at_open < m)
        self.v_lo = np.where(in_range, at[np.minimum(at_open, m - 1)], self.lo) if m else self.lo
        self.v_hi = np.where(in_range, at[close[np.minimum(at_open, m - 1)]] + 1, self.hi) if m else self.hi

    def spelled(self, word: bytes, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Which stretches lo:hi are word."""
        out = hi - lo == len(word)
        same = np.flatnonzero(out)
        out[same] = (self.buf[lo[same][:, None] + np.arange(len(word))] == np.frombuffer(word, np.uint8)).all(axis=1)
        return out

    def key_is(self, name: str) -> np.ndarray:
        """Tokens that are the ':' after the key name, as plain text without escapes or with."""
        keys = np.flatnonzero((self.kind == COLON) & self.is_value)
        out = np.zeros(len(self.kind), bool)
        out[keys] = self.spelled(json.dumps(name).encode(), self.key_lo[keys], self.key_hi[keys])
        for i in keys[self.escaped[np.maximum(keys - 1, 0)]]:
            out[i] |= json.loads(self.raw[self.key_lo[i] : self.key_hi[i]]) == name
        return out

    def blank(self, i: np.ndarray) -> np.ndarray:
        """Whether the value of slot i is null or a string of nothing but blanks."""
        out = self.null[i].copy()
        short = np.flatnonzero(self.is_text[i] & (self.opens[i] < 0))
        for j in short:
            v = self.raw[self.lo[i[j]] + 1 : self.hi[i[j]] - 1]
            if not v or v[:1].isspace() or v[:1] in (b"\\", b"\xc2", b"\xe2", b"\xe3"):
                out[j] = not json.loads(self.raw[self.lo[i[j]] : self.hi[i[j]]]).strip()
        return out


def _last_of_key(slots: np.ndarray, group: np.ndarray, prefer: np.ndarray) -> np.ndarray:
    """One slot a group: the last with the most preferred key."""
    o = np.lexsort((slots, prefer, group))
    keep = np.append(group[o][1:] != group[o][:-1], True) if len(o) else np.zeros(0, bool)
    return slots[o][keep]


def flatten(texts: list[str | None], shape: Shape = RESUME) -> pd.DataFrame:
    """Rows (doc, section, entry_no, item_kind, item_no, value) of texts of a shape; doc counts from 0.

    value is the JSON text of the entry or item. Null, empty and unreadable texts give no rows. JSON text in a
    JSON string is read as the text; of repeated keys the last counts, of an older and a newer name the newer
    unless its value is null.
    """
    raw = []
    for t in texts:
        t = (t or "").strip(" \t\r\n")
        while t[:1] == '"':
            try:
                t = json.loads(t)
            except ValueError:
                t = ""
            t = t.strip(" \t\r\n") if isinstance(t, str) else ""
        raw.append(t.encode("utf-8", "surrogatepass"))
    x = Index(raw)
    parts: list[pd.DataFrame] = []

    def emit(slots: np.ndarray, sections: np.ndarray, entries: np.ndarray, kind: str | np.ndarray, items: np.ndarray | int) -> None:
        if len(slots):
            parts.append(pd.DataFrame({"doc": x.doc[slots], "section": sections, "entry_no": entries, "item_kind": kind, "item_no": items, "value": [x.raw[a:b].decode("utf-8", "replace") for a, b in zip(x.v_lo[slots], x.v_hi[slots])]}))

    def elements(slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the elements in the lists that slots hold, with the position in slots of their list."""
        owner = np.full(len(x.kind), -1, np.int64)
        lists = (x.opens[slots] >= 0) & (x.kind[np.minimum(np.maximum(x.opens[slots], 0), len(x.kind) - 1)] == OPEN_A)
        owner[x.opens[slots[lists]]] = np.flatnonzero(lists)
        inside = np.flatnonzero(x.is_value & (x.box >= 0))
        inside = inside[owner[x.box[inside]] >= 0]
        return inside, owner[x.box[inside]]

    def members(slots: np.ndarray, names: dict[str, str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The slots under names in the objects that slots hold: (slot, position in slots, canonical name)."""
        owner = np.full(len(x.kind), -1, np.int64)
        objects = (x.opens[slots] >= 0) & (x.kind[np.minimum(np.maximum(x.opens[slots], 0), len(x.kind) - 1)] == OPEN_O)
        owner[x.opens[slots[objects]]] = np.flatnonzero(objects)
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        canon = list(dict.fromkeys(names.values()))
        for name, to in names.items():
            i = np.flatnonzero(x.key_is(name))
            i = i[(x.box[i] >= 0) & (owner[x.box[i]] >= 0)]
            got.append((i, owner[x.box[i]], np.full(len(i), canon.index(to)), np.where(x.null[i], 0, 1 + (name == to))))
        i, own, name, prefer = (np.concatenate(a) for a in zip(*got))
        keep = _last_of_key(i, own * len(canon) + name, prefer)
        order = np.argsort(i, kind="stable")
        at = order[np.searchsorted(i[order], keep)]
        return keep, own[at].astype(np.int64), np.array(canon, object)[name[at]]

    empty = pd.DataFrame({"doc": [], "section": [], "entry_no": [], "item_kind": [], "item_no": [], "value": []})
    if not len(x.kind):
        return empty
    # the roots as if they were values: a slot before each root
    good = np.flatnonzero(x.ok & (x.first < len(x.kind)))
    roots = x.first[good]
    roots = roots[x.kind[roots] == OPEN_O]
    x.opens = np.append(x.opens, roots)  # virtual slots behind the tokens
    fake = np.arange(len(roots)) + len(x.kind)
    sec, _, names = members(fake, shape.sections)
    live = ~x.blank(sec) if len(sec) else np.zeros(0, bool)
    sec, names = sec[live], names[live]
    if not len(sec):
        return empty
    holds = np.where(x.opens[sec] >= 0, x.kind[np.maximum(x.opens[sec], 0)], 0)
    # entries of lists
    e, own = elements(sec)
    live = ~x.blank(e)
    e, own = e[live], own[live]
    entry, entry_sec, entry_no = [e], [names[own]], [x.place[e]]
    # a single value for a list, but not lists by category
    by_category = (holds == OPEN_O) & np.isin(names.astype(str), shape.categories)
    one = (holds != OPEN_A) & ~by_category
    entry.append(sec[one]), entry_sec.append(names[one]), entry_no.append(np.zeros(one.sum(), np.int64))
    entries, sections, numbers = np.concatenate(entry), np.concatenate(entry_sec), np.concatenate(entry_no)
    emit(entries, sections, numbers, "", -1)
    # categories
    owner = np.full(len(x.kind), -1, np.int64)
    owner[x.opens[sec[by_category]]] = np.flatnonzero(by_category)
    cat = np.flatnonzero((x.kind == COLON) & x.is_value & (x.box >= 0))
    cat = cat[owner[x.box[cat]] >= 0]
    cat = cat[~x.blank(cat)]
    cat_names = names[owner[x.box[cat]]]
    emit(cat, cat_names, x.place[cat], "", -1)
    # items of entries and of categories
    lists, own, kinds = members(entries, shape.lists)
    lists = np.concatenate([lists, cat]).astype(np.int64)
    l_sec = np.concatenate([sections[own], cat_names])
    l_no = np.concatenate([numbers[own], x.place[cat]])
    l_kind = np.concatenate([kinds, np.full(len(cat), "category_items", object)])
    i, own = elements(lists)
    live = ~x.blank(i)
    i, own = i[live], own[live]
    emit(i, l_sec[own], l_no[own], l_kind[own], x.place[i])
    holds = np.where(x.opens[lists] >= 0, x.kind[np.maximum(x.opens[lists], 0)], 0)
    one = (holds != OPEN_A) & ~x.blank(lists)
    emit(lists[one], l_sec[one], l_no[one], l_kind[one], 0)
    return pd.concat(parts, ignore_index=True) if parts else empty


#: Bytes of text that are indexed at once; a longer text is indexed alone.
BATCH_BYTES = 1 << 20
NAMES = ["record_kind", "record_id", "section", "entry_no", "item_kind", "item_no", "value"]
SCHEMA = "record_kind string, record_id long, section string, entry_no int, item_kind string, item_no int, value string"


def _batches(batches: Iterator[pa.RecordBatch], shape: Shape) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(2).to_pylist()
        start = size = 0
        for i in range(len(texts) + 1):
            if i == len(texts) or (size and size + len(texts[i] or "") > BATCH_BYTES):
                out = flatten(texts[start:i], shape)
                if len(out):
                    at = pa.array(out["doc"].to_numpy().astype(np.int64) + start)
                    ints = [pa.array(out[c].to_numpy().astype(np.int32)) for c in ("entry_no", "item_no")]
                    words = [pa.array(out[c].tolist(), pa.string()) for c in ("section", "item_kind", "value")]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), words[0], ints[0], words[1], ints[1], words[2]], names=NAMES)
                start, size = i, 0
            if i < len(texts):
                size += len(texts[i] or "")


def flatten_records(records: DataFrame, shape: Shape = RESUME) -> DataFrame:
    """records (record_kind, record_id, content) as rows of SCHEMA: item_no -1 is an entry, the parent of the
    items with its record, section and entry_no. Narrow: no shuffle, and long texts are indexed alone.

    Null, empty and unreadable contents give no rows; repeated records give their rows again; columns beyond
    the three are ignored.
    """
    return records.select("record_kind", F.col("record_id").cast("long"), "content").mapInArrow(partial(_batches, shape=shape), SCHEMA)


def resume_records(spark: SparkSession, folder: str) -> DataFrame:
    master = table(spark, folder, "master_resumes").select(F.lit("master").alias("record_kind"), F.col("id").alias("record_id"), "content")
    tailored = table(spark, folder, "tailored_resumes").select(F.lit("tailored").alias("record_kind"), F.col("id").alias("record_id"), F.col("tailored_content").alias("content"))
    return master.unionByName(tailored)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return flatten_records(resume_records(spark, folder)).drop("value")


def p3_entries(spark: SparkSession, folder: str) -> DataFrame:
    """The parents with their JSON text, objects and lists in compact form."""
    compact = F.when(F.substring("value", 1, 1).isin("{", "["), F.get_json_object("value", "$")).otherwise(F.col("value"))
    return flatten_records(resume_records(spark, folder)).where("item_no = -1").select("record_kind", "record_id", "section", "entry_no", compact.alias("entry_json"))


def p3_items(spark: SparkSession, folder: str) -> DataFrame:
    """The children, linked by record, section and entry_no, with their text."""
    text = F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), "value", F.lit("}")), "$.v"), "value")
    return flatten_records(resume_records(spark, folder)).where("item_no >= 0").select("record_kind", "record_id", "section", "entry_no", "item_kind", "item_no", text.alias("item_text"))
