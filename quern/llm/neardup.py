"""Near-duplicate records with small edits: problem 2.

A record is its set of words. MinHash bands bring similar records together; inside a band's group 128-bit sketches
(one bit of a MinHash each) are compared bit-sliced: their bit planes lie vertically, 64 records to a machine
word, carry-save adders count the differing bits of all of them at once, and blocks are dropped as soon as all
their records are beyond the radius. What stays is checked exactly on the words.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.chars import one_form
from quern.session import discard, heavy, kept

#: Records whose word sets have at least this Jaccard similarity are the same advert.
SIMILARITY = 0.7
#: BANDS x ROWS MinHash values: a pair of similarity 0.7 meets in a band with probability 0.977, 0.8 with 0.9999.
BANDS, ROWS = 30, 6
BITS = 128
#: Bits in which sketches of a pair at SIMILARITY may differ: the mean 128 x 0.15 and three and a half deviations
#: (one such pair in 2000 differs in more).
RADIUS = 33
#: The groups of bands that a sample (one class in SAMPLED) tells to be larger are cut into blocks of about this size before
#: they are shuffled, and pairs of blocks are compared in tasks of their own. At most MOST_HOT bands, the largest, are looked up.
BLOCK, SAMPLED, MOST_HOT = 32_768, 64, 100_000
#: Copies of one text that are joined in one place; those of more are dealt out.
COPIES = 2000
#: Words of which a worker keeps the hash values (at most 62 MB).
KEPT_WORDS = 50_000
_SEED = 20240229


def far_lanes(planes: list[np.ndarray], radius: int, step: int = 16) -> np.ndarray:
    """Lanes (as bits of machine words) in which more than radius of the planes are set.

    planes: arrays of uint64, one bit a lane. Carry-save adders count down the planes; every step planes, words in
    which all lanes are beyond the radius are dropped from the rest of the count.
    """
    n = len(planes[0]) if planes else 0
    far = np.zeros(n, np.uint64)
    live = np.arange(n)
    levels = len(planes).bit_length()
    count = [np.zeros(n, np.uint64) for _ in range(levels)]
    waiting: list[list[np.ndarray]] = [[] for _ in range(levels + 1)]

    def beyond() -> np.ndarray:
        more, same = np.zeros(len(live), np.uint64), np.full(len(live), ~np.uint64(0))
        for level in reversed(range(levels)):
            c = count[level]
            if radius >> level & 1:
                same &= c
            else:
                more |= same & c
                same &= ~c
        return more

    def add(level: int, plane: np.ndarray) -> None:
        while level < levels:
            waiting[level].append(plane)
            if len(waiting[level]) < 2:
                return
            a, b = waiting[level]
            waiting[level] = []
            u = a ^ b
            plane = (a & b) | (count[level] & u)
            count[level] = count[level] ^ u
            level += 1

    for i, plane in enumerate(planes):
        add(0, plane[live] if len(live) < n else plane)
        if (i + 1) % step == 0 and i + 1 < len(planes):
            more = beyond()
            far[live] = more
            stay = np.flatnonzero(~more)
            if len(stay) < 0.7 * len(live):
                live = live[stay]
                count = [c[stay] for c in count]
                waiting = [[w[stay] for w in ws] for ws in waiting]
                if not len(live):
                    return far
    for level in range(levels):  # planes that still wait
        for plane in waiting[level]:
            at, carry = level, plane
            while at < levels:
                carry, count[at] = count[at] & carry, count[at] ^ carry
                at += 1
    far[live] = beyond()
    return far


def vertical(sketches: np.ndarray) -> list[np.ndarray]:
    """The bit planes of sketches (records x words of uint64), 64 records to a machine word; missing lanes are 0."""
    pad = np.zeros((-len(sketches) % 64, sketches.shape[1]), np.uint64)
    bits = np.unpackbits(np.ascontiguousarray(np.concatenate([sketches, pad])).view(np.uint8), axis=1)
    return list(np.ascontiguousarray(np.packbits(bits.T, axis=1)).view(np.uint64))


def lanes(words: np.ndarray, n: int) -> np.ndarray:
    """The first n lanes as booleans."""
    return np.unpackbits(words.view(np.uint8))[:n].astype(bool)


def near_in_block(sketches: np.ndarray, others: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all sketches within radius: i of sketches, j of others; without others i < j of sketches."""
    against = sketches if others is None else others
    planes = vertical(against)
    left, right = [], []
    ones = ~np.uint64(0)
    for i, s in enumerate(sketches):
        bits = np.unpackbits(np.ascontiguousarray(s).view(np.uint8))
        skip = (i + 1) // 64 if others is None else 0  # words before i hold pairs already seen
        diff = [(p[skip:] ^ ones) if bit else p[skip:] for p, bit in zip(planes, bits)]
        near = np.flatnonzero(~lanes(far_lanes(diff, radius), len(against) - 64 * skip)) + 64 * skip
        if others is None:
            near = near[near > i]
        left.append(np.full(len(near), i)), right.append(near)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int),) * 2


def near_in_groups(keys: np.ndarray, sketches: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i < j, of all sketches within radius of others with the same key; keys are sorted.

    Groups of 64 or more are compared one against all, the pairs of smaller ones become the lanes together.
    """
    same = keys[1:] == keys[:-1]
    at = np.flatnonzero(np.append(same, False) | np.append(False, same))  # most groups are of one
    keys, sketches, n = keys[at], sketches[at], len(at)
    if n < 2:
        return np.zeros(0, int), np.zeros(0, int)
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(heads, n))
    left, right = [], []
    for h, size in zip(heads[sizes >= 64], sizes[sizes >= 64]):
        i, j = near_in_block(sketches[h : h + size], None, radius)
        left.append(i + h), right.append(j + h)
    place = np.arange(n) - np.repeat(heads, sizes)
    size = np.repeat(sizes, sizes)
    for gap in range(1, min(64, int(sizes.max()))):
        i = np.flatnonzero((place + gap < size) & (size < 64))
        if len(i):
            near = ~lanes(far_lanes(vertical(sketches[i] ^ sketches[i + gap]), radius), len(i))
            left.append(i[near]), right.append(i[near] + gap)
    return (at[np.concatenate(left)], at[np.concatenate(right)]) if left else (np.zeros(0, int),) * 2


_WORDS = re.compile(r"[^\W_]+")
_BREAKS = str.maketrans({chr(i): " " for i in range(128) if not chr(i).isalnum()})


def words_in_order(text: str) -> list[str]:
    """Runs of letters and digits of the consistent form."""
    if text.isascii():
        return text.lower().translate(_BREAKS).split()
    return _WORDS.findall(one_form(text))


def words_of(text: str) -> set[str]:
    return set(words_in_order(text))


def word_hash(word: str) -> int:
    """64 bits for a word: sets are compared by all of them, MinHash takes the lower half."""
    return ((xxhash.xxh64_intdigest(word) >> 32 << 32) | (xxhash.xxh32_intdigest(word) ^ 1 << 31)) - (1 << 63)


class Hashes:
    """Hash values of words, remembered by worker process."""

    def __init__(self) -> None:
        n = BANDS * ROWS + BITS
        rng = np.random.default_rng(_SEED)
        self.mul = rng.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)
        self.add = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        self.fold = rng.integers(1, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)
        self.place: dict[int, int] = {}
        self.values = np.zeros((KEPT_WORDS, n), np.uint32)

    def of(self, words: np.ndarray) -> np.ndarray:
        """Hash values of words (int64), one row each."""
        x = words.view(np.uint64)[:, None] & np.uint64(0xFFFFFFFF)
        h = x * self.mul + self.add
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(32)).astype(np.uint32)

    def rows(self, words: np.ndarray) -> np.ndarray:
        place = self.place
        try:
            return self.values[[place[w] for w in words.tolist()]]
        except KeyError:
            pass
        if len(words) > KEPT_WORDS // 4:
            return self.of(words)
        new = np.array([w for w in words.tolist() if w not in place], np.int64)
        if len(place) + len(new) > KEPT_WORDS:
            place.clear()
            new = words
        self.values[len(place) : len(place) + len(new)] = self.of(new)
        place.update(zip(new.tolist(), range(len(place), len(place) + len(new))))
        return self.values[[place[w] for w in words.tolist()]]

    def sketch(self, words: np.ndarray) -> np.ndarray:
        """Least hash values: those of the bands, then those whose last bits are the sketch."""
        return np.minimum.reduce(self.rows(words), axis=0)

    def finish(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Band keys and sketches of records from their least hash values."""
        k = BANDS * ROWS
        keys = (low[:, :k].reshape(-1, BANDS, ROWS) * self.fold).sum(axis=2, dtype=np.uint64)
        keys ^= keys >> np.uint64(31)
        keys = (keys * np.uint64(0xBF58476D1CE4E5B9) & ~np.uint64(63)) | np.arange(BANDS, dtype=np.uint64)
        return keys.view(np.int64), np.packbits((low[:, k:] & 1).astype(np.uint8), axis=1).view(np.int64)


_hashes: list[Hashes] = []


def _shared_hashes() -> Hashes:
    if not _hashes:
        _hashes.append(Hashes())
    return _hashes[0]


def word_sets(records: DataFrame, key: str, fields: list[str], needed: str, features: Callable[[str], set[str]] = words_of) -> DataFrame:
    """key, class and words (sorted 64-bit hashes of the distinct words) of the records whose field needed isn't null.

    Words are the runs of letters and digits of the fields in their consistent form, or what features gives. class is a 64-bit hash of
    words: records with the same set have the same, others differ but for a chance of records squared / 2^65.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for b in batches:
            texts = [c.to_pylist() for c in b.columns[1:]]
            classes, ends, flat = [], [0], []
            for parts in zip(*texts):
                words = features(" ".join(p for p in parts if p))
                if len(seen) > 20 * KEPT_WORDS:
                    seen.clear()
                for w in words.difference(seen):
                    seen[w] = word_hash(w)
                h = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
                h.sort()
                if len(h) > 1 and (h[1:] == h[:-1]).any():  # two words with one hash
                    h = np.unique(h)
                classes.append(xxhash.xxh64_intdigest(h.tobytes()) - (1 << 63))
                flat.append(h)
                ends.append(ends[-1] + len(h))
            values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(classes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=[key, "class", "words"]
            )

    kind = dict(records.dtypes)[key]
    return records.where(F.col(needed).isNotNull()).select(key, *fields).mapInArrow(run, f"{key} {kind}, class long, words array<long>")


def banded(sets: DataFrame, hot: dict[int, int] | None = None) -> DataFrame:
    """band, class, low, high (the sketch's words), block, blocks: one row a band of each class; a task gives each class once,
    so copies don't pile up. Classes without words give none. hot: number of blocks of large bands; others have 0."""
    bands = np.array(sorted(hot or {}), np.int64)
    numbers = np.array([(hot or {})[b] for b in bands.tolist()], np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = _shared_hashes(), set()
        for b in batches:
            words, ends = b.column(1).values.to_numpy(), b.column(1).offsets.to_numpy()
            ids, least = [], []
            for c, lo, hi in zip(b.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                if c in seen or lo == hi:
                    continue
                if len(seen) < 10 * KEPT_WORDS:
                    seen.add(c)
                ids.append(c), least.append(hashes.sketch(words[lo:hi]))
            if ids:
                keys, sketches = hashes.finish(np.stack(least))
                keys, classes = keys.ravel(), np.repeat(ids, BANDS)
                blocks = np.zeros(len(keys), np.int32)
                if len(bands):
                    at = np.minimum(np.searchsorted(bands, keys), len(bands) - 1)
                    blocks[bands[at] == keys] = numbers[at][bands[at] == keys]
                block = np.where(blocks > 0, (classes.view(np.uint64) >> np.uint64(20)) % np.maximum(blocks, 1).astype(np.uint64), 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(classes), *(pa.array(np.repeat(sketches[:, i], BANDS)) for i in (0, 1)), pa.array(block), pa.array(blocks)],
                    names=["band", "class", "low", "high", "block", "blocks"],
                )

    return sets.select("class", "words").mapInArrow(run, "band long, class long, low long, high long, block int, blocks int")


def hot_bands(sets: DataFrame, size_of_block: int = BLOCK, sampled: int = SAMPLED) -> dict[int, int]:
    """Bands whose group is larger than a block, as a sample of the classes tells, with the number of their blocks.

    A band it misses is compared in one task all the same, so the sample has no effect on results.
    """
    some = sets.where(F.pmod("class", F.lit(sampled)) == 0).dropDuplicates(["class"])
    n = banded(some).groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") * sampled > size_of_block)
    return {r.band: -(-r.n * sampled // size_of_block) + 1 for r in n.orderBy(F.desc("n"), "band").limit(MOST_HOT).collect()}


def _found(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    a, b = np.minimum(a, b), np.maximum(a, b)
    if len(a):
        a, b = np.unique(np.stack([a, b]), axis=1)
        a, b = a[a != b], b[a != b]
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 100_000) -> Iterator[list[np.ndarray]]:
    """The columns of the batches as arrays of at least rows values, but for the last."""
    waiting: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        waiting.append(b)
        n += b.num_rows
        if n >= rows:
            yield [np.concatenate([w.column(i).to_numpy() for w in waiting]) for i in range(b.num_columns)]
            waiting, n = [], 0
    if n:
        yield [np.concatenate([w.column(i).to_numpy() for w in waiting]) for i in range(waiting[0].num_columns)]


def _sketches(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.stack([low, high], axis=1).view(np.uint64)


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, task, class, low, high) sorted by the first two to pairs of classes: the whole group of a small band (task 0),
    one block of a large one, or one block (even tasks) against another (the odd task after it)."""

    def near(x: list[np.ndarray]) -> pa.RecordBatch:
        small = x[1] == 0
        i, j = near_in_groups(x[0][small], _sketches(x[3][small], x[4][small]), RADIUS)
        a, b = [x[2][small][i]], [x[2][small][j]]
        x = [y[~small] for y in x]
        heads = _heads(x[0], x[1] >> 1)
        for h, e in zip(heads, np.append(heads[1:], len(x[0]))):
            c, s, second = x[2][h:e], _sketches(x[3][h:e], x[4][h:e]), (x[1][h:e] & 1).astype(bool)
            alone = x[1][h] >> 33 == x[1][h] >> 1 & 0xFFFFFFFF
            cut = int(np.searchsorted(second, True))
            i, j = near_in_block(s, None, RADIUS) if alone else near_in_block(s[:cut], s[cut:], RADIUS)
            a.append(c[i]), b.append(c[j if alone else j + cut])
        return _found(np.concatenate(a), np.concatenate(b))

    rest: list[np.ndarray] | None = None
    for x in _gathered(batches):
        if rest is not None:
            x = [np.concatenate([r, y]) for r, y in zip(rest, x)]
        tail = _heads(x[0], x[1] >> 1)[-1]  # the last group may go on
        if tail:
            yield near([y[:tail] for y in x])
        rest = [y[tail:] for y in x]
    if rest is not None:
        yield near(rest)


def close_sketches(sets: DataFrame, size_of_block: int = BLOCK, sampled: int = SAMPLED) -> DataFrame:
    """a, b (a < b): classes that share a band and whose sketches are within RADIUS."""
    bands = banded(sets, hot_bands(sets, size_of_block, sampled))
    others = F.when(F.col("blocks") == 0, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = bands.select("band", "class", "low", "high", "block", F.explode(others).alias("other"))
    i, j = F.least("block", "other") + 1, F.greatest("block", "other") + 1
    second = (F.col("block") > F.col("other")).cast("long")
    task = F.when(F.col("other") < 0, F.lit(0).cast("long")).otherwise((F.shiftleft(i.cast("long"), 32) + j) * 2 + second)
    rows = rows.select("band", task.alias("task"), "class", "low", "high")
    rows = rows.repartition("band", F.shiftright("task", 1)).sortWithinPartitions("band", "task")
    return rows.mapInArrow(_compare, "a long, b long").distinct()


def _jaccard(x: Column, y: Column) -> Column:
    both = F.size(F.array_intersect(x, y))
    return both / (F.size(x) + F.size(y) - both)


def similar_classes(sets: DataFrame, similarity: float = SIMILARITY, size_of_block: int = BLOCK, sampled: int = SAMPLED) -> DataFrame:
    """a, b (a < b): classes whose words have at least this similarity, checked exactly."""
    pairs = kept(close_sketches(sets, size_of_block, sampled), "sketch-pairs")
    # only words of classes in a pair travel; the pairs are written, so their size is known when this is planned
    met = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    words = sets.select("class", "words").join(met, "class", "left_semi").dropDuplicates(["class"])
    return (
        pairs.join(words.select(F.col("class").alias("a"), F.col("words").alias("x")), "a")
        .join(words.select(F.col("class").alias("b"), F.col("words").alias("y")), "b")
        .where(_jaccard(F.col("x"), F.col("y")) >= similarity)
        .select("a", "b")
    )


FIELDS = ["job_title", "company_name", "job_description"]


def _sets(spark: SparkSession, folder: str) -> DataFrame:
    jobs = heavy(spark, folder, "jobs", "id", *FIELDS)
    return kept(word_sets(jobs, "id", FIELDS, "job_description"), "word-sets")


def similar_pairs(sets: DataFrame, key: str = "id", similarity: float = SIMILARITY, copies: int = COPIES) -> DataFrame:
    """Pairs of records, left < right, of the same class or of similar ones.

    sets is word_sets(). Records without any word are similar to none. Repeated rows give repeated pairs of
    their key with others, none with itself.
    """
    links = similar_classes(sets, similarity)
    members = sets.where(F.size("words") > 0).select("class", key)
    sizes = members.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class", F.ceil(F.col("n") / copies).cast("int").alias("parts"))
    # copies of one text are dealt out over its parts; what meets them comes to each part
    dealt = members.join(sizes, "class", "left").select("class", key, "parts", F.when(F.col("parts") > 1, F.pmod(F.xxhash64(key), "parts")).otherwise(0).alias("part"))
    all_parts = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1)).alias("part")
    many = sizes.where("parts > 1")
    across = links
    for end, name in (("a", "x"), ("b", "y")):
        rest = [c for c in across.columns if c != end]
        across = across.join(many.select(F.col("class").alias(end), "parts"), end, "left").select(end, *rest, all_parts(F.col("parts")))
        across = across.join(dealt.select(F.col("class").alias(end), "part", F.col(key).alias(name)), [end, "part"]).select(*rest, name)
    twins = dealt.where("parts is not null")
    left = twins.select("class", "part", F.col(key).alias("x"))
    right = twins.select("class", F.col(key).alias("y"), all_parts(F.col("parts")))
    same = left.join(right, ["class", "part"]).where("x < y").select("x", "y")
    both = across.select("x", "y").unionByName(same)
    return both.select(F.least("x", "y").alias("left"), F.greatest("x", "y").alias("right"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return similar_pairs(_sets(spark, folder)).select(F.col("left").alias("job_id_a"), F.col("right").alias("job_id_b"))


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, group: the least node that a node is linked to, directly or through others.

    links: a, b. Each round gives every node the least group of its neighbours and of its group's node, so chains
    shrink to half; tables are cut off from their lineage each round. Raises RuntimeError if most_rounds don't do.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = kept(both, "links")
    groups = kept(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("group")), "groups")
    for _ in range(most_rounds):
        near = both.join(groups.select(F.col("node").alias("b"), "group"), "b").select(F.col("a").alias("node"), "group")
        jump = groups.select("node", F.col("group").alias("via")).join(groups.select(F.col("node").alias("via"), "group"), "via").select("node", "group")
        new = kept(near.unionByName(jump).unionByName(groups).groupBy("node").agg(F.min("group").alias("group")), "groups")
        changed = new.join(groups.withColumnRenamed("group", "was"), "node").where("group <> was").limit(1).count()
        discard(groups)
        groups = new
        if not changed:
            discard(both)
            return groups
    raise RuntimeError("the components didn't settle")


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Each advert with a description: its group (least id of the same advert) and its number of similar adverts' texts."""
    sets = _sets(spark, folder)
    links = kept(similar_classes(sets), "class-links")
    groups = components(links)
    degree = links.select("a").unionAll(links.select("b")).groupBy(F.col("a").alias("class")).agg(F.count("*").alias("n_links"))
    least = sets.where(F.size("words") > 0).join(groups.withColumnRenamed("node", "class"), "class", "left").withColumn("group", F.coalesce("group", "class"))
    first = least.groupBy("group").agg(F.min("id").alias("group_id"))
    return least.join(first, "group").join(degree, "class", "left").select(F.col("id").alias("job_id"), "group_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
