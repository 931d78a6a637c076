import random

from pyspark.sql import functions as F

from quern.functions.order import numbered, time_slices


def test_numbers(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]) if i < 120 else "hot", rng.choice([None, *range(40)]), i) for i in range(900)]
    d = spark.createDataFrame(rows, "k string, t long, i int")
    want = {}
    for key in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2])), 1):
            want[r[2]] = n
    for coalesced in ("true", "false"):  # one slice, and several that cut the hot key
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
        got = numbered(d, "k", "t", "i")
        assert got.columns == ["k", "t", "i", "n"]
        assert {r.i: r.n for r in got.collect()} == want
        two = numbered(d.withColumn("m", F.lit(None).cast("int")), ["k", "m"], "t", "i", name="place")
        assert {r.i: r.place for r in two.collect()} == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert numbered(d.limit(0), "k", "t", "i").count() == 0


def test_slices(spark):
    d = spark.createDataFrame([(t,) for t in (0, 89, 90, 99, 100, 250)], "t long")
    got = sorted(tuple(r) for r in time_slices(d, F.col("t"), 10, 100).collect())
    assert got == [(0, 0, True), (89, 0, True), (90, 0, True), (90, 1, False), (99, 0, True), (99, 1, False), (100, 1, True), (250, 2, True)]
