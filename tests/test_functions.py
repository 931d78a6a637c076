import datetime

from pyspark.sql import functions as F

from quern.functions import sets, text
from quern.functions.chars import one_form, visible


def one(spark, expr, **values):
    kind = "string" if "c" in values else "array<string>"
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kind}" for k in values))
    return row.select(expr.alias("r")).first().r


def test_text(spark):
    c = F.col("c")
    cases = [
        (text.normalise_skill(c), "  Node.JS;", "node.js"), (text.normalise_skill(c), None, None), (text.clean_text(c), None, ""), (text.clean_text(c), " a \n b", "a b"),
        (text.truncate_words(c, 7), "abc defgh", "abc…"), (text.truncate_words(c, 7), "abc", "abc"), (text.html_text(c), "<p>a&amp;b</p> c", "a&b c"), (text.html_text(c), None, ""),
        (text.without_query(c), "http://a/b?c", "http://a/b"), (text.posting_url(c, "http://x"), "http://y?z=1&jk=Ab1&q", "http://x/viewjob?jk=Ab1"), (text.url_slug(c), "https://a.b/c", "a.b_c"),
        (text.url_host(c), "https://www.a.b/c", "a.b"), (text.first_sentence_with(c, F.lit("x")), "A. B X y! C", "B X y!"), (text.first_sentence_with(c, F.lit("q")), "A", ""),
        (text.is_noise(c), "5+ years", True), (text.is_noise(c), "Remote", True), (text.is_noise(c), "sql", False), (text.looks_technical(c), "the", False), (text.looks_technical(c), "h2", True),
        (text.clean_skill(c), " Python skills and", "python skills"), (text.clean_skill(c), "Requirements:", ""), (text.clean_skill(c), "SQL experience.", "sql"), (text.printable_cp1252(c), "a→é", "a?é"),
        (text.split_list(c), " , ", None), (text.title_case(c), "o'neil data-eng", "O'Neil Data-Eng"), (text.without_markdown(c), '"**a**"', "a"), (text.voice(c), "I my me", "first_person"),
        (text.voice(c), None, "no_pronouns"), (text.salary_text(c), " N/A ", None), (text.salary_text(c), " 5 ", "5"), (text.json_or_text(c), '"a\\n"', "a\n"), (text.json_or_text(c), "{bad", "{bad"), (text.json_or_text(c), None, None),
    ]
    for i, (e, given, want) in enumerate(cases):
        assert one(spark, e, c=given) == want, (i, given)


def test_negation(spark):
    t = "Needs SQL. No PHP required"
    assert one(spark, text.negated_before(F.col("c"), F.lit(t.index("PHP") + 1)), c=t) is True
    assert one(spark, text.negated_before(F.col("c"), F.lit(t.index("SQL") + 1)), c=t) is False


def test_dates(spark):
    today = datetime.date(2026, 3, 19)
    cases = {"30+ days ago": 30, "2 weeks ago": 14, "recently": None, "Just posted": 0, "5 hours ago": 0, "yesterday": 1, "a month ago": 30, "3 months": 90, "on 2026-03-01T08:00": 18, "": None}
    for raw, days in cases.items():
        got = one(spark, text.posted_date(F.col("c"), F.lit(today)), c=raw)
        assert got == (None if days is None else today - datetime.timedelta(days)), raw
    assert one(spark, text.iso_date(F.col("c")), c="2024-13-01") is None


def test_sets(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, sets.merged(a, b), a=["Python", "AWS"], b=["python", "Docker", "docker"]) == ["Python", "AWS", "Docker"]
    assert one(spark, sets.merged(a, b), a=None, b=["x", "x", ""]) == ["x", "x"]
    assert one(spark, sets.merged(a, b), a=[], b=None) is None
    assert sorted(one(spark, sets.expanded(a), a=["PostgreSQL", "CI/CD", None])) == ["ci/cd", "cicd", "postgres", "postgresql"]
    assert one(spark, sets.first_matching(a, b), a=["x", "Y", "z"], b=["y"]) == ["Y", "x", "z"]
    assert one(spark, sets.in_order(a, b), a=["p", "q", "r"], b=["r", "s"]) == ["r", "p", "q"]
    assert one(spark, sets.share_of(a, b), a=[], b=["x"]) == 0.0


def test_forms():
    assert visible("Princіpal ｃ\u200dﬁ Зима e\u0301") == "Principal cfi Зима é"
    assert one_form("STRAßE\u00a0X\r\nY") == "strasse x\ny"
    assert one_form("") == "" and visible("plain") == "plain"
