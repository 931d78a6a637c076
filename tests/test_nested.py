import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.operators.nested import LISTS, SECTIONS, Shape, flatten, flatten_records


def blank(v):
    return v is None or (isinstance(v, str) and not v.strip())


def plain(texts):
    """The rows by walking parsed JSON."""
    out = []
    for i, t in enumerate(texts):
        try:
            v = json.loads(t or "")
            while isinstance(v, str):
                v = json.loads(v)
        except ValueError:
            continue
        if not isinstance(v, dict):
            continue

        def get(d, names, name):
            return next((d[k] for k in sorted((k for k, x in names.items() if x == name), key=lambda k: k != name) if d.get(k) is not None), None)

        for s in dict.fromkeys(SECTIONS.values()):
            val = get(v, SECTIONS, s)
            if blank(val):
                continue
            if isinstance(val, dict) and s == "skills":
                for n, x in enumerate(val.values()):
                    if not blank(x):
                        out.append((i, s, n, "", -1))
                        out += [(i, s, n, "category_items", m) for m, y in enumerate(x if isinstance(x, list) else [x]) if not blank(y)]
                continue
            for n, e in enumerate(val if isinstance(val, list) else [val]):
                if blank(e):
                    continue
                out.append((i, s, n, "", -1))
                for kind in dict.fromkeys(LISTS.values()) if isinstance(e, dict) else ():
                    x = get(e, LISTS, kind)
                    if not blank(x):
                        out += [(i, s, n, kind, m) for m, y in enumerate(x if isinstance(x, list) else [x]) if not blank(y)]
    return sorted(out)


def rows(texts):
    return sorted(map(tuple, flatten(texts)[["doc", "section", "entry_no", "item_kind", "item_no"]].values.tolist()))


CASES = [
    "", "{}", "[]", "null", '{"skills": [1, null, "  ", "a\\n", "\\u0020"], "education":"x"}', '{"skills":["a",]}', '{"a":1,}', '{"skills":["a"]} x', '{"skills":["a"]',
    '{"skills" ["a"]}', '"{\\"skills\\":[\\"q\\"]}"', "nope", '{"projects":[{"tech":"a","bullets":null,"technologies":[]}, {}, "x"]}', '{"skills":{"A":"x","B":[],"C":null}}',
    '{"a":"\\"","skills":["\\\\"]}', '{"skills":["b"}]', '{"skills":[01]}', '{"skills":[1.5e3,true]}', None, '{"sk\\u0069lls":["z"]}', '{"experience":[{"bullets":"one"}],"work_experience":null}',
    '{"skills":["a\tb"]}', '{"skills":[["n"],{"k":1}]}', 'x{"skills":["a"]}', '{"skills":["a" "b"]}', '{"skills":[a]}', '{"skills":["a"]}{"skills":["b"]}', '{"x":{"skills":["no"]},"skills":["yes"]}',
    '{"skills":["' + "\\\\" * 5000 + '"]}', '{"a":' * 500 + "1" + "}" * 500, '{"certifications":{"name":"c"},"work_experience":{"bullets":["b"]}}', '{"skills":["é","日本","\U0001f600"]}', '{"skills":["\\ud83d"]}', "}{", '{"a"}', '{,}', "[,]", '{"skills":[{"bullets":["x"]}]}',
]


def test_cases_together_and_alone():
    assert rows(CASES) == plain(CASES)
    for c in CASES:
        assert rows([c]) == plain([c]), c


leaf = st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=8) | st.sampled_from(["", " ", "\\", '"', "{", "]"])
value = st.recursive(leaf, lambda v: st.lists(v, max_size=4) | st.dictionaries(st.sampled_from([*SECTIONS, *LISTS, "title", "x"]), v, max_size=4), max_leaves=25)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.dictionaries(st.sampled_from([*SECTIONS, "x"]), value, max_size=5), st.integers(0, 40), st.booleans()), max_size=5))
def test_against_a_parser(docs):
    texts = []
    for d, cut, twice in docs:
        t = json.dumps(d, ensure_ascii=twice)
        texts.append(json.dumps(t) if twice and not cut else t[: len(t) - cut] if cut % 3 == 0 else t)
    assert rows(texts) == plain(texts)


def test_records(spark):
    body = json.dumps({"work_experience": [None, {"title": "t", "bullets": ["a", "", "b"]}], "skills": {"S": ["x"]}})
    d = spark.createDataFrame([("master", 1, body, "z"), ("master", 1, body, "z"), ("tailored", 2, None, "z"), ("tailored", None, "[", "z")], "record_kind string, record_id long, content string, section string")
    got = sorted(tuple(r) for r in flatten_records(d).collect())
    one = [("master", 1, "skills", 0, "", -1, '["x"]'), ("master", 1, "skills", 0, "category_items", 0, '"x"'), ("master", 1, "work_experience", 1, "", -1, '{"title": "t", "bullets": ["a", "", "b"]}'),
           ("master", 1, "work_experience", 1, "bullets", 0, '"a"'), ("master", 1, "work_experience", 1, "bullets", 2, '"b"')]
    assert got == sorted(one * 2)
    assert flatten_records(d.limit(0)).count() == 0


def test_long_text():
    big = json.dumps({"skills": ["s" * 50] * 60_000})
    assert len(flatten([big, '{"skills":["a"]}', big[:-1]])) == 60_001


@pytest.mark.parametrize("n", [1, 2, 3])
def test_repeats(n):
    assert len(flatten(['{"skills":["a","b"]}'] * n)) == 2 * n


def test_another_shape():
    shape = Shape({"orders": "orders", "purchases": "orders", "tags": "tags", "prices": "prices"}, {"lines": "lines", "notes": "notes"}, ("prices",))
    t = '{"purchases": [{"lines": ["a", null, 1.5e3], "notes": "n"}, null, true], "prices": {"x": [1, 2], "y": null}, "tags": ["t\\u0041"], "skills": ["not asked for"]}'
    got = [tuple(r) for r in flatten([t, "[1]", "{"], shape)[["section", "entry_no", "item_kind", "item_no", "value"]].itertuples(index=False)]
    assert sorted(got) == sorted([
        ("orders", 0, "", -1, '{"lines": ["a", null, 1.5e3], "notes": "n"}'), ("orders", 2, "", -1, "true"), ("tags", 0, "", -1, '"t\\u0041"'), ("prices", 0, "", -1, "[1, 2]"),
        ("orders", 0, "lines", 0, '"a"'), ("orders", 0, "lines", 2, "1.5e3"), ("orders", 0, "notes", 0, '"n"'), ("prices", 0, "category_items", 0, "1"), ("prices", 0, "category_items", 1, "2"),
    ])
    assert flatten(['{"orders": [01]}', '{"orders": [-1, 0, 12, 1.0, 1.]}'], shape).empty and len(flatten(['{"orders": [-1, 0, 12, 1.5]}'], shape)) == 4
