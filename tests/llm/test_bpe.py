import random

import pytest

from quern.llm.bpe import TOKENIZERS, Encoder, Merger, encode, read_ranks, token_counts

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def public():
    t = tokenizers.Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def texts():
    rng = random.Random(4)
    fixed = ["", " ", "<|endoftext|> x", "a" * 5000, "\U0001f600" * 50 + "  \n\n x", "aab" * 3000, "don't we'll", "ｆｕｌｌ wide\u200b", "\x00\x01", "日本語テキスト", "a\xa0b\u3000c", "1234567890" * 20, "\r\n\t \n"]
    return fixed + ["".join(rng.choice("ab cdé'\n1-\u0301語") for _ in range(rng.randint(0, 200))) for _ in range(200)]


def test_ids(spark, public):
    t = texts()
    d = spark.createDataFrame([(i, x, [1]) for i, x in enumerate(t)] + [(len(t), None, [1]), (0, t[0], [2])], "doc_id long, text string, ids array<int>")
    got = encode(d).collect()
    assert len(got) == len(t) + 2
    for r in got:
        assert r.ids == (public.encode(t[r.doc_id], add_special_tokens=False).ids if r.doc_id < len(t) else []), r.doc_id
    n = {r.doc_id: r.n_tokens for r in token_counts(d, ["doc_id"]).collect()}
    assert all(n[r.doc_id] == len(r.ids) for r in got)
    assert encode(d.limit(0)).count() == 0


def test_merges_by_the_plain_way():
    with open(f"{TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = read_ranks(f.read())
    merge, rng = Merger(ranks), random.Random(1)

    def plain(piece):
        part = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            best = min(((ranks[part[i] + part[i + 1]], i) for i in range(len(part) - 1) if part[i] + part[i + 1] in ranks), default=None)
            if best is None:
                return tuple(ranks[p] for p in part)
            part[best[1] : best[1] + 2] = [part[best[1]] + part[best[1] + 1]]

    for _ in range(400):
        piece = bytes(rng.choice(b"abehilnoprstu\xc3\xa9\xff") for _ in range(rng.randint(0, 40)))
        assert merge(piece) == plain(piece) or piece in ranks


def test_memory_is_bounded(monkeypatch):
    import quern.llm.bpe as b

    monkeypatch.setattr(b, "KEPT_PIECES", 5)
    with open(f"{TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        e = Encoder(f.read())
    assert [e.count(x) for x in ("one two three four", "five six seven eight nine ten", "one two three four")] == [4, 6, 4]
