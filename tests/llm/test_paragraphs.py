import random

import pytest

from quern.llm.paragraphs import alike_paragraphs, shingles

SCHEMA = "doc_id long, text string, first_doc long, class long"


def test_shingles():
    assert shingles("One two, three four FIVE six") == {"one two three four five", "two three four five six"}
    assert shingles("a b") == {"a b"} and shingles(" , ") == set() and shingles("") == set()


def by_force(docs, similarity=0.8):
    paras = [((d, k), shingles(p)) for d, t in docs if t for k, p in enumerate(t.split("\n\n")) if shingles(p)]
    group, degree = {k: k for k, _ in paras}, {k: set() for k, _ in paras}
    for i, (a, x) in enumerate(paras):
        for b, y in paras[i + 1 :]:
            if len(x & y) >= similarity * len(x | y):
                old, new = sorted((group[a], group[b]))[::-1]
                group = {k: new if g == old else g for k, g in group.items()}
                if x != y:
                    degree[a].add(frozenset(y)), degree[b].add(frozenset(x))
    many = {g for g in group.values() if sum(v == g for v in group.values()) > 1}
    return sorted((*k, *g, len(degree[k])) for k, g in group.items() if g in many)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(500)]
    pool = [[rng.choice(words) for _ in range(60)] for _ in range(12)]
    docs = []
    for d in range(40):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = list(rng.choice(pool)) if rng.random() < 0.7 else [rng.choice(words) for _ in range(rng.choice([2, 30]))]
            if rng.random() < 0.5:
                p[rng.randrange(len(p))] = "edit"
            parts.append(" ".join(p))
        docs.append((d, "\n\n".join(parts)))
    docs += [(100, None), (101, ""), (102, "\n\n \n\n"), (103, "short one"), (104, "Short ONE!"), (105, " ".join(words) * 20)]
    got = alike_paragraphs(spark.createDataFrame([(*x, 5, 6) for x in docs], SCHEMA))
    assert sorted(map(tuple, got.select("doc_id", "para_no", "first_doc", "first_para", "n_links").collect())) == by_force(docs)


def test_none(spark):
    assert alike_paragraphs(spark.createDataFrame([], SCHEMA)).count() == 0
