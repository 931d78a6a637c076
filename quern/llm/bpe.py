"""Encoding of whole texts by a public byte-level BPE vocabulary: problem 7.

A piece is merged through a segment tree over the ranks of its adjacent pairs: the root is the leftmost pair of
the lowest rank, each merge updates two leaves in logarithmic time, until no pair can merge.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from quern.session import heavy

TOKENIZERS = "/opt/tokenizers"
# Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces a worker keeps with their ids; beyond that it starts anew, which costs time and changes no result.
KEPT_PIECES = 300_000
_NONE = 1 << 62


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(t): int(r) for t, r in (x.split() for x in data.splitlines() if x)}


class Merger:
    """Encodes one piece of text by ranks: token bytes to rank, which is the id."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks

    def __call__(self, piece: bytes) -> tuple[int, ...]:
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        n = len(piece)
        if not n:
            return ()
        part = [piece[i : i + 1] for i in range(n)]
        if n == 1:
            return (ranks[part[0]],)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        size = 1 << (n - 2).bit_length() if n > 2 else 1
        # a leaf is rank * n + place, so the least key is the leftmost pair of the lowest rank
        tree = [_NONE] * (2 * size)
        for i in range(n - 1):
            r = ranks.get(part[i] + part[i + 1])
            if r is not None:
                tree[size + i] = r * n + i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b

        def put(i: int, key: int) -> None:
            i += size
            tree[i] = key
            while i > 1:
                i >>= 1
                a, b = tree[2 * i], tree[2 * i + 1]
                least = a if a < b else b
                if tree[i] == least:
                    return
                tree[i] = least

        while (key := tree[1]) != _NONE:
            i = key % n
            j = nxt[i]
            part[i] += part[j]
            k = nxt[i] = nxt[j]
            if j < n - 1:
                put(j, _NONE)
            if k < n:
                prev[k] = i
                r = ranks.get(part[i] + part[k])
                put(i, _NONE if r is None else r * n + i)
            else:
                put(i, _NONE)
            h = prev[i]
            if h >= 0:
                r = ranks.get(part[h] + part[i])
                put(h, _NONE if r is None else r * n + h)
        out, i = [], 0
        while i < n:
            out.append(ranks[part[i]])
            i = nxt[i]
        return tuple(out)


class Encoder:
    """Encodes texts; pieces seen before come from memory."""

    def __init__(self, data: bytes, pattern: str = PATTERN) -> None:
        self.merge = Merger(read_ranks(data))
        self.split = regex.compile(pattern).findall
        self.seen: dict[str, tuple[int, ...]] = {}

    def pieces(self, text: str) -> Iterator[tuple[int, ...]]:
        """The ids of each piece of text, in order."""
        words, seen = self.split(text), self.seen
        new = set(words).difference(seen)
        if new:
            if len(seen) + len(new) > KEPT_PIECES:
                seen.clear()
                new = set(words)
            for w in new:
                seen[w] = self.merge(w.encode("utf-8", "replace"))
        return map(seen.__getitem__, words)

    def extend(self, ids: array, text: str) -> None:
        """Appends the text's ids."""
        for p in self.pieces(text):
            ids.extend(p)

    def count(self, text: str) -> int:
        return sum(map(len, self.pieces(text)))


_encoders: dict[bytes, Encoder] = {}


def encoder(data: bytes) -> Encoder:
    """One encoder a worker process and vocabulary."""
    key = hashlib.sha256(data).digest()
    if key not in _encoders:
        _encoders[key] = Encoder(data)
    return _encoders[key]


def _vocabulary(spark: SparkSession, path: str, name: str):  # noqa: ANN202
    """The vocabulary file as a broadcast: under a megabyte, whatever the data; over 16 MB raises ValueError."""
    with open(f"{path}/{name}.tiktoken", "rb") as f:
        data = f.read((16 << 20) + 1)
    if len(data) > 16 << 20:
        raise ValueError(f"{name} is over 16 MB")
    return spark.sparkContext.broadcast(data)


def encode(documents: DataFrame, path: str = TOKENIZERS, name: str = "byte_bpe_50k", text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and ids, the token ids of text without special tokens; what looks like one is plain text.

    Null and empty texts give an empty array. Narrow: no shuffle of texts, so no skew. Long texts are encoded whole.
    """
    vocabulary = _vocabulary(documents.sparkSession, path, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary.value)
        for b in batches:
            ids, ends = array("i"), array("i", [0])
            for t in b.column(1).to_pylist():
                if t:
                    e.extend(ids, t)
                ends.append(len(ids))
            values = pa.Array.from_buffers(pa.int32(), len(ids), [None, pa.py_buffer(ids)])
            offsets = pa.Array.from_buffers(pa.int32(), len(ends), [None, pa.py_buffer(ends)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, values)], names=[key, "ids"])

    kind = dict(documents.dtypes)[key]
    return documents.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>")


def token_counts(documents: DataFrame, columns: list[str], path: str = TOKENIZERS, name: str = "byte_bpe_50k", text: str = "text") -> DataFrame:
    """columns and n_tokens of text; null and empty texts have none."""
    vocabulary = _vocabulary(documents.sparkSession, path, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary.value)
        for b in batches:
            n = [e.count(t) if t else 0 for t in b.column(len(columns)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*columns, "n_tokens"])

    kinds = dict(documents.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", n_tokens long"
    return documents.select(*columns, text).mapInArrow(run, schema)


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode(heavy(spark, folder, "documents", "doc_id", "text"))
