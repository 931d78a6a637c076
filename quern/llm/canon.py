"""Freely typed values as entries of a reference list: problem 1.

The reference forms (canonical, alias and abbreviation paths) make a trie of words. A word of a value is searched
in it with a Levenshtein automaton (adjacent swaps count once) whose states are bit masks, which yields all
reference words within a distance that depends on their length. An entry matches if each word of one of its
forms is found in the value; the fullest form wins. Values without word breaks are searched as a whole.
A value that means several entries alike means none of them; all entries within reach are its candidates.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.chars import one_form
from quern.session import heavy, table

#: A longer reference list isn't broadcast but raises ValueError.
MOST_ENTRIES = 100_000
#: Values and words a worker remembers; beyond that it starts anew, without effect on results.
KEPT_VALUES = 400_000
#: Short forms in use for words of a kind, alias paths beside those of the list's alt_names; a parameter of map_values().
SHORT_FORMS = {"job_title": {
    "sr": "senior", "snr": "senior", "jr": "junior", "jnr": "junior", "prin": "principal", "princ": "principal", "ld": "lead",
    "eng": "engineer", "engr": "engineer", "dev": "developer", "mgr": "manager", "mngr": "manager", "anlst": "analyst",
    "exec": "executive", "rep": "representative", "spec": "specialist", "admin": "administrator", "asst": "assistant",
    "tech": "technical", "supv": "supervisor", "supvr": "supervisor", "arch": "architect", "ops": "operations", "acct": "accountant",
    "dir": "director", "coord": "coordinator",
}}


def most_edits(length: int) -> int:
    """Edits allowed for a reference word of this length."""
    return 0 if length <= 3 else 1 if length <= 5 else 2


def fold(text: str) -> str:
    """The consistent form without accents."""
    t = one_form(text)
    return t if t.isascii() else "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))


_WORDS = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return _WORDS.findall(fold(text))


class Trie:
    """Words with payloads, searched by a Levenshtein automaton."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[dict[str, tuple[int, int]] | None] = [None]

    def add(self, word: str, gives: str, most: int) -> None:
        """word leads to gives if at most most edits away."""
        at = 0
        for c in word:
            to = self.next[at].get(c)
            if to is None:
                to = self.next[at][c] = len(self.next)
                self.next.append({})
                self.ends.append(None)
            at = to
        if self.ends[at] is None:
            self.ends[at] = {}
        self.ends[at][gives] = (most, len(word))

    def search(self, word: str, most: int = 2) -> dict[str, int]:
        """What all words within their distance give, with the least distance."""
        m = len(word)
        most = min(most, most_edits(m + 2))
        mask: dict[str, int] = defaultdict(int)
        for i, c in enumerate(word):
            mask[c] |= 1 << i
        goal, full = 1 << m, (1 << (m + 1)) - 1
        out: dict[str, int] = {}
        # row j: the lengths of word's beginnings that are at most j edits from the path
        start = [((1 << (j + 1)) - 1) & full for j in range(most + 1)]
        todo = [(0, start, None, 0)]
        while todo:
            at, rows, before, last = todo.pop()
            end = self.ends[at]
            if end is not None and rows[-1] & goal:
                d = next(j for j, r in enumerate(rows) if r & goal)
                for g, (allowed, length) in end.items():
                    # two edits on a short word that also take away or add two letters make another word
                    if d <= allowed and d < out.get(g, 99) and (d < 2 or length > 7 or abs(length - m) < 2):
                        out[g] = d
            for c, to in self.next[at].items():
                mc = mask.get(c, 0)
                new = [((rows[0] & mc) << 1) & full]
                for j in range(1, most + 1):
                    r = ((rows[j] & mc) << 1) | rows[j - 1] | (rows[j - 1] << 1) | (new[j - 1] << 1)
                    if before is not None:
                        r |= (before[j - 1] & mc & (last >> 1)) << 2
                    new.append(r & full)
                if new[-1]:
                    todo.append((to, new, rows, mc))
        return out


Key = tuple[int, int, int]
Found = dict[int, tuple[Key, int]]


def _add(found: Found, ids: Iterable[int], key: Key, cost: int) -> None:
    """Keeps the best key and the least cost of each entry."""
    for i in ids:
        k, c = found.get(i, (key, cost))
        found[i] = (min(k, key), min(c, cost))


#: An edit weighs more than any number of words that begin with another letter, which only decides between equals.
EDIT = 16


def _least(options: list[list[tuple[int, int]]], used: tuple[int, ...] = ()) -> int | None:
    """The least sum of costs that gives each word of a form a word of its own; options: (cost, place), the best first."""
    if not options:
        return 0
    best = None
    for d, at in options[0]:
        if at not in used and (best is None or d < best):
            rest = _least(options[1:], (*used, at))
            if rest is not None and (best is None or d + rest < best):
                best = d + rest
    return best


class Reference:
    """The entries of one kind. short: short forms of words, with the word they stand for."""

    def __init__(self, entries: list[tuple[int, str, list[str]]], short: dict[str, str]) -> None:
        self.words, self.wholes = Trie(), Trie()
        forms: dict[tuple[str, ...], set[int]] = defaultdict(set)
        heads: dict[tuple[str, ...], set[int]] = defaultdict(set)
        for i, value, others in entries:
            for f in [value, *others]:
                forms[tuple(words(f))].add(i)
            if "," in value:  # the part before the comma is a form of all entries that begin with it
                heads[tuple(words(value.split(",")[0]))].add(i)
        for f, ids in heads.items():
            forms.setdefault(f, ids)
        forms.pop((), None)
        self.forms = list(forms.items())
        self.most_words = max((len(f) for f in forms), default=0)
        self.longest = max((sum(map(len, f)) for f in forms), default=0)
        self.with_word: dict[str, list[int]] = defaultdict(list)
        self.whole_ids: dict[str, set[int]] = defaultdict(set)
        for k, (f, ids) in enumerate(self.forms):
            whole = "".join(f)
            self.wholes.add(whole, whole, most_edits(len(whole)))
            self.whole_ids[whole] |= ids
            for w in set(f):
                self.with_word[w].append(k)
        for w in self.with_word:
            self.words.add(w, w, most_edits(len(w)))
        for s, w in short.items():
            if w in self.with_word and s not in self.with_word:
                self.words.add(s, w, int(len(s) > 3))
        self.seen: dict[str, dict[str, int]] = {}
        self.sure: dict[str, dict[str, int]] = {}

    def _near(self, w: str) -> dict[str, int]:
        """Words of the list within reach of w."""
        got = self.seen.get(w)
        if got is None:
            if len(self.seen) > KEPT_VALUES:
                self.seen.clear()
            got = self.seen[w] = self.words.search(w)
        return got

    def _meant(self, w: str) -> dict[str, int]:
        """Words that w is or misspells: an exact word is no misspelling of another."""
        got = self.sure.get(w)
        if got is None:
            if len(self.sure) > KEPT_VALUES:
                self.sure.clear()
            near = self._near(w)
            got = self.sure[w] = {g: d for g, d in near.items() if not d} if 0 in near.values() else near
        return got

    def _by_words(self, ws: list[str], search: Callable[[str], dict[str, int]]) -> Found:
        """Entries with a form all of whose words are found by words of their own: the fullest form's key."""
        found: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for at, w in enumerate(ws):
            for g, d in search(w).items():
                found[g].append((EDIT * d + (d > 0 and g[0] != w[0]), at))
        for g in found:  # a form's word needs no more places than the form has words
            found[g] = sorted(found[g])[: self.most_words]
        best: Found = {}
        for k in {k for g in found for k in self.with_word[g]}:
            form, ids = self.forms[k]
            if all(w in found for w in form) and (cost := _least([found[w] for w in form])) is not None:
                _add(best, ids, (-len(form), -sum(map(len, form)) + 2 * (cost // EDIT), cost), cost)
        return best

    def _run_together(self, ws: list[str], every: bool) -> Found:
        """Entries with a form that, without its spaces, the whole value or one of its longer words is near to; unless every, a word
        that may be a misspelt one counts only if it is exactly the form."""
        whole = "".join(ws)
        near = dict(self.wholes.search(whole)) if len(whole) <= self.longest + 2 else {}
        for w in set(ws):
            if 5 < len(w) <= self.longest + 2:
                for g, d in self.wholes.search(w).items():
                    if every or not d or not self._near(w):
                        near[g] = min(d, near.get(g, 99))
        best: Found = {}
        for g, d in near.items():
            _add(best, self.whole_ids[g], (-1, -len(g) + 2 * d, EDIT * d), EDIT * d)
        return best

    def entry(self, value: str) -> int:
        """The entry that the value means: the one whose fullest form it holds; -1 if none or several equally."""
        ws = words(value)
        best = self._by_words(ws, self._meant) or self._run_together(ws, False)
        top = min((k for k, _ in best.values()), default=None)
        ids = [i for i, (k, _) in best.items() if k == top]
        return ids[0] if len(ids) == 1 else -1

    def candidates(self, value: str) -> list[tuple[int, int]]:
        """(canon_id, least edits) of all entries within reach of the value, the fullest forms first, then by id."""
        ws = words(value)
        best = self._run_together(ws, True)
        for i, found in self._by_words(ws, self._near).items():
            _add(best, [i], *found)
        return [(i, c // EDIT) for i, (_, c) in sorted(best.items(), key=lambda x: (x[1], x[0]))]


class Lists:
    """The reference lists of all kinds; answers are remembered by worker process."""

    def __init__(self, rows: list[tuple[int, str, str, list[str] | None]], short: dict[str, dict[str, str]] | None = None) -> None:
        by: dict[str, list] = defaultdict(list)
        for i, kind, value, others in rows:
            if value:
                by[kind].append((i, value, [o for o in others or [] if o]))
        self.by = {k: Reference(v, (SHORT_FORMS if short is None else short).get(k, {})) for k, v in by.items()}
        self.seen: dict[tuple[str, str, str], int | list[tuple[int, int]]] = {}

    def _of(self, what: str, kind: str, value: str, none):  # noqa: ANN001, ANN202
        key = (what, kind, value)
        got = self.seen.get(key)
        if got is None:
            if len(self.seen) > KEPT_VALUES:
                self.seen.clear()
            ref = self.by.get(kind)
            got = self.seen[key] = getattr(ref, what)(value) if ref else none
        return got

    def entry(self, kind: str, value: str) -> int:
        return self._of("entry", kind, value, -1)

    def candidates(self, kind: str, value: str) -> list[tuple[int, int]]:
        return self._of("candidates", kind, value, [])


_lists: dict[str, Lists] = {}


def reference_rows(canon: DataFrame) -> list[tuple]:
    """The reference list on the driver: MOST_ENTRIES rows at most, else ValueError."""
    rows = canon.select("canon_id", "kind", "canon_value", "alt_names").limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"over {MOST_ENTRIES} reference entries")
    return sorted((r.canon_id, r.kind, r.canon_value, list(r.alt_names or [])) for r in rows if r.canon_id is not None and r.kind and r.canon_value)


def typed_values(jobs: DataFrame) -> DataFrame:
    """job_id, field, kind, item_no, value of each non-blank typed value."""
    one = [F.array(F.struct(F.lit(f).alias("field"), F.lit(f).alias("kind"), F.lit(0).alias("item_no"), F.col(f).alias("value"))) for f in ("job_title", "location")]
    many = F.transform(
        F.coalesce("required_skills", F.array().cast("array<string>")),
        lambda v, i: F.struct(F.lit("required_skills").alias("field"), F.lit("skill").alias("kind"), i.alias("item_no"), v.alias("value")),
    )
    return jobs.select(F.col("id").alias("job_id"), F.explode(F.concat(*one, many)).alias("v")).select("job_id", "v.*").where(F.col("value").rlike(r"[^\s\p{Z}]"))


def map_values(values: DataFrame, canon: DataFrame, every: bool = False, short: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """values (kind, value and any others) with canon_id, the entry that the value means; -1 if it means none.

    A value that means several entries alike, as a place's name that belongs to several without what tells them apart, means
    none. With every also matches, an array of (canon_id, edits): all entries within reach, the fullest first,
    empty if none; an exactly typed word keeps its neighbours there. Null and blank values match nothing. short:
    short forms by kind, SHORT_FORMS if absent. Narrow: the list is broadcast after a check of its size, each worker answers a
    value once, and no key is shuffled.
    """
    rows, key = reference_rows(canon), uuid.uuid4().hex
    held = values.sparkSession.sparkContext.broadcast((rows, short))

    def lists() -> Lists:
        if key not in _lists:
            _lists.clear()
            _lists[key] = Lists(*held.value)
        return _lists[key]

    @F.pandas_udf(T.IntegerType())
    def meant(kinds: pd.Series, typed: pd.Series) -> pd.Series:
        of = lists().entry
        return pd.Series([of(k, v) if v else -1 for k, v in zip(kinds, typed)])

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("canon_id", T.IntegerType()), T.StructField("edits", T.IntegerType())])))
    def near(kinds: pd.Series, typed: pd.Series) -> pd.Series:
        of = lists().candidates
        return pd.Series([[{"canon_id": i, "edits": d} for i, d in of(k, v)] if v else [] for k, v in zip(kinds, typed)])

    out = values.withColumn("canon_id", meant("kind", "value"))
    return out.withColumn("matches", near("kind", "value")) if every else out


def _misspelt(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    canon = table(spark, folder, "canon_values")
    jobs = heavy(spark, folder, "jobs", "id", "job_title", "location", "required_skills")
    exact = F.broadcast(canon.select("kind", F.col("canon_value").alias("value")).dropna().distinct())
    return typed_values(jobs).join(exact, ["kind", "value"], "left_anti"), canon


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    values, canon = _misspelt(spark, folder)
    return map_values(values, canon).select("job_id", "field", "item_no", "canon_id")


def p1_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """All entries within reach of each typed value, as often as it occurs."""
    values, canon = _misspelt(spark, folder)
    counted = values.groupBy("kind", "value").agg(F.count("*").alias("n_values"))
    return map_values(counted, canon, every=True).select("kind", "value", "n_values", F.explode("matches").alias("m")).select("kind", "value", "n_values", "m.canon_id", "m.edits")


def p1_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """The report of values that mean no entry, with the number of entries within reach."""
    values, canon = _misspelt(spark, folder)
    counted = values.groupBy("kind", "value").agg(F.count("*").alias("n_values"))
    return map_values(counted, canon, every=True).where("canon_id = -1").select("kind", "value", "n_values", F.size("matches").alias("n_candidates"))
