import random

import pytest
from pyspark.sql import functions as F

from quern.llm.mixture import mixture, sainte_lague

TARGETS = "source string, target_share double, max_repeats int, n_tokens int"


def highest_quotients(weights, seats, caps):
    held = {k: 0 for k in weights}
    for _ in range(seats):
        free = [k for k, w in weights.items() if w > 0 and held[k] < caps.get(k, seats)]
        if not free:
            break
        held[min(free, key=lambda k: (-weights[k] / (2 * held[k] + 1), k))] += 1
    return held


def test_apportionment():
    rng = random.Random(3)
    for _ in range(200):
        w = {k: rng.choice([0, rng.random(), rng.random() * 50]) for k in "abcdefg"[: rng.randint(1, 7)]}
        caps = {k: rng.randint(0, 60) for k in w} if rng.random() < 0.5 else {}
        seats = rng.randint(0, 200)
        assert sainte_lague(w, seats, caps) == highest_quotients(w, seats, caps)
    assert sainte_lague({}, 5) == {} and sainte_lague({"a": 0}, 5) == {"a": 0}


def test_shares(spark):
    rng = random.Random(1)
    docs = [(i, s, rng.randint(20, 400)) for i, s in enumerate(["big"] * 3000 + ["mid"] * 600 + ["small"] * 60 + ["none"] * 50)] + [(9001, "big", 0), (9002, None, 50), (9003, "mid", None)]
    sizes = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], "doc_id long, source string, n_tokens long, copies int, cell int, shard int")
    targets = spark.createDataFrame([("big", 0.6, 2, 0), ("mid", 0.3, 1, 0), ("small", 0.05, 4, 0), ("absent", 0.05, 3, 0), (None, 0.1, 1, 0), ("zero", 0.0, 1, 0)], TARGETS)
    mix, report = mixture(sizes, targets, blocks=2000)
    r = {x.source: x for x in report.collect()}
    assert r["absent"].mixed_tokens == 0 and r["zero"].mixed_tokens == 0 and set(r) == {"big", "mid", "small", "absent", "zero"}
    for s, share in (("big", 0.6), ("mid", 0.3), ("small", 0.05)):
        assert r[s].reached_share == pytest.approx(share / 0.95, rel=0.03)
        assert r[s].max_copies <= r[s].max_repeats
    # the largest mixture: some source is used up
    assert max(x.mixed_tokens / (x.available_tokens * x.max_repeats) for x in r.values() if x.available_tokens) > 0.97
    rows = mix.collect()
    assert len({x.doc_id for x in rows}) == len(rows) and all(x.copies >= 1 for x in rows)
    assert sorted(map(tuple, mix.collect())) == sorted(map(tuple, mixture(sizes.repartition(7), targets, blocks=2000)[0].collect()))


def test_edges(spark):
    sizes = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    mix, report = mixture(sizes, targets)
    assert mix.count() == 0 and report.first().reached_share == 0.0
    one = spark.createDataFrame([(1, "a", 10), (2, "a", 10)], "doc_id long, source string, n_tokens long")
    mix, report = mixture(one, targets)
    assert sorted((r.doc_id, r.copies) for r in mix.collect()) == [(1, 2), (2, 2)] and report.first().reached_share == 1.0
    with pytest.raises(ValueError, match="two for one"):
        mixture(one, targets.union(targets))
    mix, report = mixture(one, targets.limit(0))
    assert mix.count() == 0 and report.agg(F.count("*")).first()[0] == 0


def test_shards_of_shards(spark, monkeypatch):
    """A source with most of the tokens has many shards, apportioned by a tree of groups; shares hold all the same."""
    import quern.llm.mixture as m

    monkeypatch.setattr(m, "SHARD_TOKENS", 4000)
    monkeypatch.setattr(m, "GROUP", 5)
    rng = random.Random(2)
    docs = [(i, "big" if i % 3 else "small", rng.randint(20, 100)) for i in range(6000)]
    sizes = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 2)], "source string, target_share double, max_repeats int")
    mix, report = mixture(sizes, targets, blocks=500)
    have = {s: sum(t for _, x, t in docs if x == s) for s in ("big", "small")}
    assert have["big"] > 4000 * 5 * 5  # three levels
    for r in report.collect():
        assert r.reached_share == pytest.approx(0.5, rel=0.02) and r.max_copies <= (1 if r.source == "big" else 2)
    assert sum(r.copies * r.n_tokens for r in mix.collect()) == pytest.approx(2 * min(have["big"], 2 * have["small"]), rel=0.02)
