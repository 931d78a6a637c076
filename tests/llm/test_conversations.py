import datetime
import random

import pytest

from quern.llm import conversations as module
from quern.llm.conversations import ROLES, conversations


@pytest.fixture(params=["whole", "sliced"])
def cut(request, spark, monkeypatch):
    """Sessions in one slice, and cut into slices and short stretches: both give the same."""
    if request.param == "sliced":
        monkeypatch.setattr(module, "STRETCH", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")

MESSAGES = "id long, session_id string, role string, content string, tool_calls_json string, created_at timestamp, turn int, speaker string"


def at(s):
    return None if s is None else datetime.datetime(2025, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(seconds=s)


def by_force(rows, sessions):
    kept = {}
    for i, s, r, c, t, w in sorted(rows, key=lambda r: r[0]):
        kept.setdefault((s, r, c, w), (i, s, r, c, t, w))
    out = []
    for s in sessions:
        mine = [r for r in kept.values() if r[1] == s]
        who = [ROLES.get((r[2] or "").strip().lower()) for r in mine]
        if any(w is None for w in who) or any(r[5] is None for r in mine):
            continue
        turns = sorted([(r[5], r[0], w, r[3]) for r, w in zip(mine, who) if w in ("user", "assistant") and not (w == "assistant" and r[4])])
        if turns and len(turns) % 2 == 0 and all((t[2] == ("user", "assistant")[k % 2]) and (t[3] or "").strip() for k, t in enumerate(turns)):
            out += [(s, k + 1, t[1], t[2]) for k, t in enumerate(turns)]
    return sorted(out)


def test_random_sessions(spark, cut):
    rng = random.Random(7)
    rows, k = [], 0
    for s in range(120):
        t = rng.randint(0, 5)
        for n in range(rng.randint(0, 8)):
            k += 1
            t += rng.choice([0, 1, 5])
            role = rng.choice(["user", " Human ", "USER"]) if n % 2 == 0 else rng.choice(["assistant", "AI", "bot "])
            role = rng.choice(["tool", "system", "???", None, "user", "assistant"]) if rng.random() < 0.08 else role
            text = rng.choice(["", " ", "\u00a0", None]) if rng.random() < 0.04 else f"m{k}"
            calls = "[]" if rng.random() < 0.05 else None
            rows.append((k, None if rng.random() < 0.02 else f"s{s}", role, text, calls, at(None if rng.random() < 0.02 else t)))
            if rng.random() < 0.15:
                k += 1
                rows.append((k, *rows[-1][1:]))
    rng.shuffle(rows)
    known = [f"s{s}" for s in range(110)]
    d = spark.createDataFrame([(*r, 0, "x") for r in rows], MESSAGES)
    sessions = spark.createDataFrame([(s, 1) for s in [*known, "s0", None, "none"]], "id string, turns int")
    want = by_force(rows, known)
    assert want
    assert sorted(tuple(r) for r in conversations(d, sessions).select("session_id", "turn_no", "message_id", "speaker").collect()) == want


def test_hot_session_with_ties(spark, cut):
    rows = [(k, "h", "user" if k % 2 == 0 else "bot", f"m{k}", None, at(k // 10)) for k in range(400)]
    rows += [(1000 + k, f"s{k // 2}", "user" if k % 2 == 0 else "bot", f"m{k}", None, at(k)) for k in range(800)]  # a third of all rows is one session's
    d = spark.createDataFrame([(*r, 0, "x") for r in rows], MESSAGES)
    known = ["h", *(f"s{k}" for k in range(400))]
    s = spark.createDataFrame([(k,) for k in known], "id string")
    assert sorted(tuple(r) for r in conversations(d, s).collect()) == by_force(rows, known)


def test_broken_across_slices(spark, cut):
    rows = [(k, "h", "user" if k % 2 == 0 else "bot", f"m{k}", None, at(k)) for k in range(400)]
    s = spark.createDataFrame([("h",)], "id string")
    for gone in ((), (200,), (399,), (0,), (200, 201)):
        some = [r for r in rows if r[0] not in gone]
        d = spark.createDataFrame([(*r, 0, "x") for r in some], MESSAGES)
        assert sorted(tuple(r) for r in conversations(d, s).collect()) == by_force(some, ["h"])


def test_empty(spark):
    d = spark.createDataFrame([], MESSAGES)
    assert conversations(d, spark.createDataFrame([("h",)], "id string")).count() == 0
    one = spark.createDataFrame([(1, "h", "user", "x", None, at(0), 0, "x"), (2, "h", "ai", "y" * 200_000, None, at(0), 0, "x")], MESSAGES)
    assert conversations(one, spark.createDataFrame([("h",)], "id string")).count() == 2
    assert conversations(one, spark.createDataFrame([], "id string")).count() == 0
