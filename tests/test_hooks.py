from pyspark.sql import functions as F

from quern.operators import hooks


def test_judge(spark):
    d = spark.createDataFrame([(1, "other"), (2, "data"), (3, None)], "i int, domain string")

    def judge(batches):
        for b in batches:
            yield b.assign(domain="seen")

    assert sorted(map(tuple, hooks.judged(d, F.col("domain") == "other", judge).collect()), key=str) == [(1, "seen"), (2, "data"), (3, None)]
    assert hooks.judged(d, F.col("domain") == "other") is d


def test_rewrite(spark):
    d = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "i int, t string")

    def rewrite(batches):
        for b in batches:
            yield b.assign(t=b["t"].map(lambda x: "" if x == "b" else "new", na_action="ignore"))

    assert sorted(map(tuple, hooks.rewritten(d, "t", rewrite).collect())) == [(1, "new"), (2, "b"), (3, None)]
    assert hooks.rewritten(d, "t") is d
    assert hooks.observed(d, "n").count() == 3


def test_retried():
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError("busy")
        return x

    assert hooks.retried(flaky, wait=0)(5) == 5 and calls == [5, 5, 5]
    calls.clear()
    try:
        hooks.retried(flaky, tries=2, wait=0)(1)
    except OSError:
        pass
    assert calls == [1, 1]
