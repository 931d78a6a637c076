import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm.spans import Prefixes, clusters, points_of, runs_of, shared_chars, sliding_min


def by_force(docs, span):
    seen = {}
    for i, t in docs:
        for k in range(len(t or "") - span + 1):
            seen.setdefault(t[k : k + span], set()).add(i)
    out = {}
    for i, t in docs:
        mark = np.zeros(len(t or ""), bool)
        for k in range(len(t or "") - span + 1):
            if len(seen[t[k : k + span]]) > 1:
                mark[k : k + span] = True
        if mark.any():
            out[i] = int(mark.sum())
    return out


@pytest.mark.parametrize("hot", [20_000, 2])
@pytest.mark.parametrize(("span", "gram"), [(30, 8), (200, 64)])
def test_against_all_windows(spark, span, gram, hot):
    rng = random.Random(span)
    word = lambda: "".join(rng.choice("abcdé日\U0001f600 ") for _ in range(rng.randint(2, 9)))
    pool = ["".join(word() for _ in range(60)) for _ in range(8)]
    docs = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(pool)
            a = rng.randint(0, len(p) // 2)
            parts += [word(), p[a : a + rng.randint(span - 5, 3 * span)]] if rng.random() < 0.7 else ["".join(word() for _ in range(20))]
        docs.append((i, "".join(parts)))
    docs += [(100, docs[3][1]), (101, "x" * 5 * span), (102, "ab" * 3 * span), (103, "x" * span), (104, "y" * 3 * span), (105, None), (106, "")]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, shared_chars int")
    got = {r.doc_id: r.shared_chars for r in shared_chars(d, span, gram, hot).collect()}
    assert got == by_force(docs, span)
    group = {i: i for i, _ in docs}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    seen = {}
    for i, t in docs:
        for k in range(len(t or "") - span + 1):
            a, b = sorted((top(i), top(seen.setdefault(t[k : k + span], i))))
            group[b] = a
    want = {i: top(i) for i in got}
    assert {r.doc_id: r.cluster_id for r in clusters(d, span, gram, hot).collect()} == want


def test_one_run_of_a_whole_text(spark, monkeypatch):
    """A text of one character is a single run, whatever its length: many such windows are settled by aggregation."""
    docs = [(i, "z" * (300 + i)) for i in range(8)] + [(50, "q" * 400)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    want = by_force(docs, 200)
    assert {r.doc_id: r.shared_chars for r in shared_chars(d).collect()} == want
    monkeypatch.setattr("quern.llm.spans.HOT_WINDOWS", 50)
    assert {r.doc_id: r.shared_chars for r in shared_chars(d).collect()} == want


def test_edges(spark):
    d = spark.createDataFrame([(1, "abc " * 200, 0), (2, None, 0), (3, "", 0), (4, "x", 0)], "doc_id long, text string, lo int")
    assert shared_chars(d).count() == 0
    assert shared_chars(d.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "abc " * 200), (1, "abc " * 200)], "doc_id long, text string")
    assert shared_chars(twice).count() == 0
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh ") for _ in range(700_000))
    d = spark.createDataFrame([(1, long), (2, "zz" + long[1000:1300] + "zz"), (3, long[:199])], "doc_id long, text string")
    assert {r.doc_id: r.shared_chars for r in shared_chars(d).collect()} == {1: 300, 2: 300}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=60), st.integers(1, 20))
def test_sliding_min(values, width):
    x = np.array(values, np.uint64)
    assert sliding_min(x, width).tolist() == [min(values[i : i + width]) for i in range(len(values) - width + 1)]


def test_hashes_depend_on_text_alone():
    points, _ = points_of(["hello world hello", "world"])
    p = Prefixes(points)
    h = p.of(np.array([6, 17, 0, 12]), np.array([11, 22, 5, 17]))
    assert h[0] == h[1] and h[2] == h[3] and h[0] != h[2] and p.all_of(5)[6] == h[0]
    assert len(p.all_of(100)) == 0


def test_runs_cover_all_windows():
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab c") for _ in range(rng.randint(0, 400))) for _ in range(20)]
    doc, first, n, _, _ = runs_of(texts, 50, 12)
    for i, t in enumerate(texts):
        covered = sorted(w for a, k in zip(first[doc == i], n[doc == i]) for w in range(a, a + k))
        assert covered == list(range(max(0, len(t) - 49)))
