"""Long exact spans shared between texts: problem 9.

Every window of SPAN characters is a paragraph of its own; its MinHash over GRAM-character shingles, with one
hash and one band, is its anchor. Equal windows have equal anchors, so the banding misses none. Windows with
the same anchor lie side by side and make a run. Runs are joined on their anchor and verified exactly: if all
runs of an anchor are the same text, one comparison settles them; else their windows are compared one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.neardup import components
from quern.session import heavy, kept, table

#: Least length of a shared span, and of the shingles from which anchors are taken, in code points.
SPAN, GRAM = 200, 64
#: Runs of an anchor, and windows in them, that one task compares; anchors with more are settled by aggregation over their windows.
HOT_RUNS, HOT_WINDOWS = 20_000, 4_000_000
#: Code points handled at once; a longer text is handled alone.
CHUNK = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Prefixes:
    """Sums over a sequence of code points from which the hash of any stretch follows."""

    def __init__(self, points: np.ndarray) -> None:
        n = len(points)
        if len(_powers[0]) <= n:
            for k, b in enumerate((_BASE, _INVERSE)):
                a = np.full(max(n + 1, CHUNK), b, np.uint64)
                a[0] = 1
                _powers[k] = np.multiply.accumulate(a)
        v = _mix(points.astype(np.uint64) + np.uint64(0x51ED270B))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(v * _powers[0][:n], out=self.sums[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hashes of the stretches lo:hi; equal texts have equal ones wherever they lie."""
        return _mix((self.sums[hi] - self.sums[lo]) * _powers[1][lo] + (hi - lo).astype(np.uint64))

    def all_of(self, length: int) -> np.ndarray:
        """Hashes of all stretches of one length."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        return _mix((self.sums[length:] - self.sums[:n]) * _powers[1][:n] + np.uint64(length))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each width neighbours: blockwise minima from the left and from the right."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    pad = np.full(-len(x) % width, ~np.uint64(0))
    blocks = np.concatenate([x, pad]).reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def points_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts one after another, and where each begins (one more than texts)."""
    raw = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(raw), np.uint32), np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])]).astype(np.int64)


def runs_of(texts: list[str], span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of the texts: place of the text, first window, number of windows, anchor, hash of the run's text."""
    points, starts = points_of(texts)
    p = Prefixes(points)
    anchors = sliding_min(p.all_of(gram), span - gram + 1)
    n = len(anchors)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    doc = np.repeat(np.arange(len(texts)), np.diff(starts))[:n]
    valid = np.arange(n) + span <= starts[doc + 1]
    new = np.ones(n, bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(valid & new)
    bounds = np.flatnonzero(np.append(new | ~valid, True))
    last = bounds[np.searchsorted(bounds, first, "right")]
    return doc[first], first - starts[doc[first]], last - first, anchors[first], p.of(first, last - 1 + span)


def _chunks(b: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[str]]]:
    texts = b.column(column).to_pylist()
    start = size = 0
    for i in range(len(texts) + 1):
        if i == len(texts) or (size and size + len(texts[i] or "") > CHUNK):
            if i > start:
                yield start, i, [t or "" for t in texts[start:i]]
            start, size = i, 0
        if i < len(texts):
            size += len(texts[i] or "")


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def runs(documents: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """doc_id, first, windows, anchor, same of all runs of documents (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for start, _, texts in _chunks(b, 1):
                doc, first, n, anchor, same = runs_of(texts, span, gram)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[doc + start]), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), _signed(anchor), _signed(same)],
                    names=["doc_id", "first", "windows", "anchor", "same"],
                )

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, first int, windows int, anchor long, same long")


def _stretches(doc: np.ndarray, at: np.ndarray, least: np.ndarray, span: int) -> pa.RecordBatch:
    """Windows as stretches of their text; least: the least document that has the window."""
    o = np.lexsort((at, doc))
    doc, at, least = doc[o], at[o], least[o]
    lo, hi = at, at + span
    if len(doc):
        head = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1) | (least[1:] != least[:-1])))
        tail = np.append(head[1:], len(doc)) - 1
        doc, lo, hi, least = doc[head], at[head], at[tail] + span, least[head]
    columns = [pa.array(x.astype(t)) for x, t in ((doc, np.int64), (lo, np.int32), (hi, np.int32), (least, np.int64))]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "lo", "hi", "least_id"])


_LO_HI = "doc_id long, lo int, hi int, least_id long"


def _windows(texts: list[str], first: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of run texts: place of the run, place in its document, hash."""
    points, starts = points_of(texts)
    h = Prefixes(points).all_of(span)
    run = np.repeat(np.arange(len(texts)), np.diff(starts))[: len(h)]
    at = np.arange(len(h))
    ok = at + span <= starts[run + 1]
    run, at, h = run[ok], at[ok], h[ok]
    return run, at - starts[run] + first[run], h


def _settle(span: int):  # noqa: ANN202
    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (anchor, doc_id, first, body) sorted by anchor to the stretches in another document too."""

        def flush(t: pa.Table) -> pa.RecordBatch:
            anchors, docs, first = (t.column(i).to_numpy() for i in range(3))
            run, at, h = _windows(t.column(3).to_pylist(), first, span)
            doc, group = docs[run], anchors[run]
            o = np.lexsort((doc, h, group))
            g, x, d = group[o], h[o], doc[o]
            head = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (x[1:] != x[:-1]))) if len(o) else np.zeros(0, int)
            tail = np.append(head[1:], len(o)) - 1
            size = np.diff(np.append(head, len(o)))
            shared = np.repeat(d[head] != d[tail], size) if len(o) else np.zeros(0, bool)
            return _stretches(d[shared], at[o][shared], np.repeat(d[head], size)[shared], span)

        rest: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            if rest is not None:
                t = pa.concat_tables([rest, t])
            keys = t.column(0).to_numpy()
            if not len(keys):
                continue
            tail = int(np.flatnonzero(keys == keys[-1])[0])
            if tail and len(keys) > 2000:
                yield flush(t.slice(0, tail))
                rest = t.slice(tail)
            else:
                rest = t
        if rest is not None and rest.num_rows:
            yield flush(rest)

    return settle


def shared_stretches(documents: DataFrame, span: int = SPAN, gram: int = GRAM, hot_runs: int = HOT_RUNS) -> DataFrame:
    """doc_id, lo, hi, least_id: stretches of texts, which may overlap, of which every window lies in another document too;
    least_id is the least document that has these windows."""
    r = kept(runs(documents, span, gram), "runs")  # texts are hashed once
    anchors = (
        r.groupBy("anchor")
        .agg(F.min("doc_id").alias("one"), F.max("doc_id").alias("other"), F.min("same").alias("x"), F.max("same").alias("y"), F.count("*").alias("n_runs"), F.sum("windows").alias("n_windows"))
        .where("one <> other")
        .select("anchor", F.col("one").alias("least_id"), (F.col("x") == F.col("y")).alias("alike"), ((F.col("n_runs") > hot_runs) | (F.col("n_windows") > HOT_WINDOWS)).alias("hot"))
    )
    # few anchors are shared: written, their size is known when the join with all runs is planned
    live = kept(r.join(kept(anchors, "anchors"), "anchor"), "shared-runs")
    alike = live.where("alike").select("doc_id", F.col("first").alias("lo"), (F.col("first") + F.col("windows") - 1 + span).alias("hi"), "least_id")
    # the text of the other runs, from a second reading of their documents
    wanted = live.where("not alike").groupBy("doc_id").agg(F.collect_list(F.struct("first", "windows", "anchor", "hot")).alias("cut"))
    bodies = (
        documents.select("doc_id", "text")
        .join(wanted, "doc_id")
        .select("doc_id", "text", F.explode("cut").alias("c"))
        .select("c.hot", "c.anchor", "doc_id", "c.first", F.substring("text", F.col("c.first") + 1, F.col("c.windows") - 1 + span).alias("body"))
    )
    cold = bodies.where("not hot").select("anchor", "doc_id", "first", "body").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_settle(span), _LO_HI)

    def spell_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            anchors, docs, first = (b.column(i).to_numpy() for i in range(3))
            for start, end, texts in _chunks(b, 3):
                run, at, h = _windows(texts, first[start:end], span)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchors[start:end][run]), pa.array(docs[start:end][run]), pa.array(at.astype(np.int32)), _signed(h)], names=["anchor", "doc_id", "lo", "h"]
                )

    each = bodies.where("hot").select("anchor", "doc_id", "first", "body").mapInArrow(spell_out, "anchor long, doc_id long, lo int, h long")
    twice = each.groupBy("anchor", "h").agg(F.min("doc_id").alias("one"), F.max("doc_id").alias("other")).where("one <> other").select("anchor", "h", F.col("one").alias("least_id"))
    hot = each.join(twice, ["anchor", "h"]).select("doc_id", "lo", (F.col("lo") + span).alias("hi"), "least_id")
    return alike.unionByName(cold).unionByName(hot)


def shared_chars(documents: DataFrame, span: int = SPAN, gram: int = GRAM, hot_runs: int = HOT_RUNS) -> DataFrame:
    """doc_id, shared_chars: characters that lie in a span of at least span characters that is in another document too.

    Characters are code points. Documents without such a span, null, empty and shorter texts give no row;
    repeats inside one document alone don't count, nor do rows that repeat a doc_id. Equal hashes of different
    windows would need the same 64-bit anchor and the same 64-bit hash.
    """
    s = shared_stretches(documents, span, gram, hot_runs)
    order = Window.partitionBy("doc_id").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("hi") - F.greatest("lo", F.coalesce(F.max("hi").over(order), F.lit(0))))
    return s.select("doc_id", fresh.alias("fresh")).groupBy("doc_id").agg(F.sum("fresh").cast("long").alias("shared_chars"))


def clusters(documents: DataFrame, span: int = SPAN, gram: int = GRAM, hot_runs: int = HOT_RUNS) -> DataFrame:
    """doc_id, cluster_id: documents that share spans, directly or through others, with the least document of theirs.

    Each shared stretch links a document with the least one that has it, so a passage in n documents makes n - 1 links.
    """
    links = shared_stretches(documents, span, gram, hot_runs).where("doc_id <> least_id").select(F.col("doc_id").alias("a"), F.col("least_id").alias("b"))
    return components(links.distinct()).select(F.col("node").alias("doc_id"), F.col("group").alias("cluster_id"))


def p9_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Removals by component: every document of a cluster but its least one is marked."""
    found = clusters(heavy(spark, folder, "documents", "doc_id", "text").where(F.length("text") >= SPAN))
    return found.withColumn("remove", F.col("doc_id") != F.col("cluster_id"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return shared_chars(heavy(spark, folder, "documents", "doc_id", "text").where(F.length("text") >= SPAN))


def p9_share(spark: SparkSession, folder: str) -> DataFrame:
    """Each document: how many of its characters, and what part, are shared elsewhere."""
    d = table(spark, folder, "documents")
    found = shared_chars(d.select("doc_id", "text").where(F.length("text") >= SPAN))
    n = F.coalesce(F.length("text"), F.lit(0)).alias("n_text_chars")
    out = d.select("doc_id", n).join(found, "doc_id", "left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0)))
    return out.withColumn("shared_part", F.coalesce(F.col("shared_chars") / F.nullif("n_text_chars", F.lit(0)), F.lit(0.0)))
