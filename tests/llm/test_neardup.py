import random

import numpy as np
import pytest

from quern.llm import neardup as n

RNG = np.random.default_rng(0)
X = RNG.integers(0, 1 << 63, (700, 2), dtype=np.uint64)
X[350:] = X[:350] ^ (np.uint64(1) << RNG.integers(0, 63, (350, 2)).astype(np.uint64))


def brute(a, b, r):
    return np.bitwise_count(a[:, None, :] ^ b[None, :, :]).sum(2) <= r


@pytest.mark.parametrize("radius", [0, 2, 3, 35, 55, 64, 127, 128])
def test_bit_slices(radius):
    for m in (1, 63, 64, 65, 700):
        i, j = n.near_in_block(X[:m], None, radius)
        got = np.zeros((m, m), bool)
        got[i, j] = True
        assert (got == np.triu(brute(X[:m], X[:m], radius), 1)).all()
    i, j = n.near_in_block(X[:100], X[100:], radius)
    got = np.zeros((100, 600), bool)
    got[i, j] = True
    assert (got == brute(X[:100], X[100:], radius)).all()
    keys = np.sort(np.where(np.arange(700) < 150, 0, RNG.integers(1, 200, 700)))
    i, j = n.near_in_groups(keys, X, radius)
    got = np.zeros((700, 700), bool)
    got[i, j] = True
    assert (got == np.triu(brute(X, X, radius) & (keys[:, None] == keys[None, :]), 1)).all()
    assert len(n.near_in_groups(keys[:0], X[:0], radius)[0]) == 0


def adverts(seed=1, groups=40):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows, k = [], 0
    for _ in range(groups):
        base = rng.sample(vocabulary, 80)
        for _ in range(rng.randint(1, 5)):
            words = list(base)
            for _ in range(rng.randint(0, 9)):
                words[rng.randrange(80)] = rng.choice(vocabulary)
            rng.shuffle(words)
            k += 1
            rows.append((k, words[0], words[1], " ".join(words[2:])))
    rows += [(k + 1, "Т itle", None, ""), (k + 2, None, None, None), (k + 3, rows[0][1], rows[0][2], rows[0][3].upper()), (k + 4, "", "", " ,"), (k + 5, "", "", "?"), (k + 6, "a", "b", " ".join(vocabulary) * 5)]
    return rows


def pairs_by_force(rows, similarity=0.7):
    sets = [(r[0], n.words_of(" ".join(x or "" for x in r[1:]))) for r in rows if r[3] is not None]
    return sorted((a, b) for i, (a, x) in enumerate(sets) for b, y in sets[i + 1 :] if x and y and len(x & y) >= similarity * len(x | y))


SCHEMA = "id long, job_title string, company_name string, job_description string"


def test_pairs(spark):
    rows = adverts()
    d = spark.createDataFrame([(*r, 5) for r in rows], SCHEMA + ", class int")
    sets = n.word_sets(d, "id", n.FIELDS, "job_description")
    got = sorted((r.left, r.right) for r in n.similar_pairs(sets).collect())
    assert got == pairs_by_force(rows)
    assert n.similar_pairs(sets.limit(0)).count() == 0


def test_hot_group(spark):
    """Groups over a block go through tasks of their own, with the same result."""
    rng = random.Random(2)
    base = [f"x{k}" for k in range(60)]
    rows = [(k, "t", "c", " ".join(rng.sample(base, 57))) for k in range(90)] + [(100 + k, *r[1:]) for k, r in enumerate(adverts(3, 10))]
    sets = n.word_sets(spark.createDataFrame(rows, SCHEMA), "id", n.FIELDS, "job_description")
    pairs = lambda **k: sorted(map(tuple, n.similar_classes(sets, **k).collect()))
    whole = pairs()
    assert len(whole) > 3000
    assert n.hot_bands(sets, 16, 1)
    assert pairs(size_of_block=16, sampled=1) == whole
    near = lambda *a: sorted(map(tuple, n.close_sketches(sets, *a).collect()))
    assert near(1, 1) == near(7, 1) == near(89, 2) == near()


def test_copies_of_one_text(spark):
    """A third of all rows are copies of one text, another third nearly: all pairs, however the copies are dealt out."""
    base = " ".join(f"x{k}" for k in range(60))
    rows = [(k, "t", "c", base) for k in range(40)] + [(50 + k, "t", "c", base + " y") for k in range(40)] + [(100 + k, *r[1:]) for k, r in enumerate(adverts(3, 14))]
    sets = n.word_sets(spark.createDataFrame(rows, SCHEMA), "id", n.FIELDS, "job_description")
    for copies in (7, 2000):
        assert sorted(map(tuple, n.similar_pairs(sets, copies=copies).collect())) == pairs_by_force(rows)


def test_classes_and_groups(spark):
    links = spark.createDataFrame([(5, 9), (9, 7), (1, 2), (20, 21), (21, 22), (22, 23), (23, 24), (24, 25)], "a long, b long")
    got = {r.node: r.group for r in n.components(links).collect()}
    assert got == {5: 5, 7: 5, 9: 5, 1: 1, 2: 1, **{k: 20 for k in range(20, 26)}}
    assert n.components(links.limit(0)).count() == 0


def test_words():
    assert n.words_of("Ab-cd, É_e 1a") == {"ab", "cd", "é", "e", "1a"} and n.words_of("A_b c") == {"a", "b", "c"} and n.words_of("") == set()
