import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions.chars import one_form, visible
from quern.llm.unify import FIELDS, MAY_CHANGE, changed_fields, consistent, is_case, reference_form

CASES = {
    "Princіpal Engineer": True, "ｃｉｖｉｌ": True, "oﬃce": True, "Café": False, "Cafe\u0301": True, "ju\u200dnior": True, "wh\xadenever": True, "a\xa0b": True, "a\u3000b": True, "enɡine": True,
    "Зимоград Софт": False, "Γνώση της γλώσσας": False, "don’t – “x” • €": False, "tab\there\nline": False, "": False, "plain": False, "Зимоград\u200b": True, "Straße": False, "сост": False, "PYΤHON": True,
}


def test_cases():
    for text, want in CASES.items():
        assert is_case(text) is want, text


def test_prefilter_is_wider():
    pattern = re.compile(MAY_CHANGE)
    for text, want in CASES.items():
        assert bool(pattern.search(text)) or not want, text


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8", max_codepoint=0x2FFF) | st.sampled_from("аеорсіɡａﬁ\u0301\u200b\xa0 ab"), max_size=20))
def test_properties(text):
    if not re.search(MAY_CHANGE, text):
        assert not is_case(text)
    assert one_form(one_form(text)) == one_form(text) or "\u0345" in text or any(ord(c) > 0x24F for c in text)
    assert not is_case(text) or visible(text) != text
    assert one_form(text).replace(" ", "").replace("\n", "") == re.sub(r"[\s\x85]", "", reference_form(text)) or re.search(r"[\x1c-\x1f\u1680\u2028\u2029\t\x0b\x0c\r]", text)


def test_frames(spark):
    rows = [(1, "Princіpal", None, "x\r\ny\tZ", 3), (2, "", " ", "ju\u200dnior", 3), (2, "", " ", "ju\u200dnior", 3), (3, None, None, None, 3), (4, "É" * 100_000 + "\u200b", "a", "b", 3)]
    d = spark.createDataFrame(rows, "id long, job_title string, company_name string, job_description string, value int")
    assert sorted(map(tuple, changed_fields(d).collect())) == [(1, "job_title"), (2, "job_description"), (2, "job_description"), (4, "job_title")]
    got = {r.id: r for r in d.select("id", *[consistent(F.col(f)).alias(f) for f in FIELDS]).collect()}
    assert (got[1].job_title, got[1].job_description, got[1].company_name) == ("principal", "x\ny z", None) and got[2].job_description == "junior" and got[4].job_title == "é" * 100_000
    assert changed_fields(d.limit(0)).count() == 0
