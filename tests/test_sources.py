import zipfile
import pytest
import datetime
import json

from pyspark.sql import functions as F

from quern.operators import upsert
from quern.sources import readers, sinks
from quern.streaming import streams


def test_pages(spark):
    ld = {"@type": "JobPosting", "title": "T", "hiringOrganization": "Acme", "description": "<p>D &amp; E</p>", "datePosted": "2024-01-15T00:00:00Z", "baseSalary": {"value": {"minValue": 1234.5}}}
    rows = [
        ("https://a/1?x=2", f'<script type="application/ld+json">[{{"@type":"Other"}}, {json.dumps(ld)}]</script>'), ("https://a/1?x=1", '<script type="application/ld+json">{bad</script><h1>H</h1>'),
        ("https://a/2", '<h1>Ti<b>t</b>le</h1><p class="x c">Co<br>rp</p><div class="d">De<i>sc</i></div>'), ("https://a/3", "<h1>only</h1>"), ("https://a/4", None), ("https://a/5", ""),
    ]
    d = readers.postings_of_pages(spark.createDataFrame(rows[:1] + rows[2:], "url string, html string"), {"title": ("h1",), "company": (".c",), "description": (".d",)})
    got = {r.application_url: r for r in d.collect()}
    assert set(got) == {"https://a/1", "https://a/2"}
    r = got["https://a/1"]
    assert (r.title, r.company, r.location, r.description, str(r.posted), r.salary) == ("T", "Acme", None, "D & E", "2024-01-15", "USD 1,234")
    assert (got["https://a/2"].title, got["https://a/2"].company) == ("Ti t le", "Co rp")
    bad = spark.createDataFrame([rows[1]], "url string, html string").select(readers.json_ld_posting(F.col("html")).alias("p")).first().p
    assert bad is None


def test_files(spark, tmp_path):
    (tmp_path / "d.yaml").write_text("# c\nlangs:\n  - Python\n  - 'Go'\nnested:\n  sub:\n    - SQL # x\n")
    assert sorted(map(tuple, readers.read_dictionary(spark, str(tmp_path / "d.yaml")).collect())) == [("go", "langs"), ("python", "langs"), ("sql", "nested")]
    assert readers.read_dictionary(spark, str(tmp_path / "none.yaml")).count() == 0
    (tmp_path / "s.json").write_text('{"a": {"x": 1}, "new": 2}')
    assert readers.read_settings(str(tmp_path / "s.json"), {"a": {"x": 0, "y": 3}, "b": 4}) == {"a": {"x": 1, "y": 3}, "b": 4, "new": 2}
    assert readers.read_settings(str(tmp_path / "no.json"), {"b": 4}) == {"b": 4}
    assert readers.table_folder({}, {"database": {"path": "p"}}, "d") == "p" and readers.table_folder({"DATABASE_URL": "u"}, {}, "d") == "u"
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "ann.json").write_text('{"skills": []}')
    assert [tuple(r) for r in readers.read_resumes(spark, str(tmp_path / "r")).collect()] == [("ann", '{"skills": []}')]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_bytes("é".encode())
    (tmp_path / "t" / "b.txt").write_bytes("é".encode("latin-1"))
    assert [r.text for r in readers.read_documents(spark, str(tmp_path / "t")).collect()] == ["é", "é"]
    (tmp_path / "u.json").write_text('{"model":"m","date":"d1","calls":2,"tokens_estimated":3}\n{"model":"m","date":"d0","calls":9,"tokens_estimated":9}\n')
    assert [tuple(r) for r in readers.read_usage(spark, str(tmp_path / "u.json"), "d1").collect()] == [("m", "d1", 2, 3)]


def test_docx(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Ann &amp; Bo</w:t><w:tab/><w:t>x</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>é</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "b.docx").write_bytes(b"no zip")
    (tmp_path / "c.txt").write_text("plain")
    got = {r.path.rpartition("/")[2]: r.text for r in readers.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.docx": "Ann & Bo\tx\n\né", "b.docx": None, "c.txt": "plain"}


def test_usage_forms(spark, tmp_path):
    read = lambda text: (tmp_path / "f.json").write_text(text) and sorted(tuple(r) for r in readers.read_usage(spark, str(tmp_path / "f.json"), "d1").collect())
    assert read('{"primary": {"date": "d1", "calls": 4, "tokens_estimated": 5}, "bulk": {"date": "d0", "calls": 1, "tokens_estimated": 1}}') == [("primary", "d1", 4, 5)]
    assert read('{"date": "d1", "calls": 4, "tokens_estimated": 5}') == [("primary", "d1", 4, 5)]
    assert read("not json") == [] and read("{}") == []


def test_uploads(spark):
    m = spark.createDataFrame([(5, "n", "{}", True, False)], "id long, name string, content string, is_active boolean, is_sample boolean")
    new = spark.createDataFrame([("b", '{"skills": [], "personal_info": {}}'), ("a", "no json"), ("c", None)], "name string, content string")
    got = [(r.id, r.name, r.is_active, r.missing) for r in readers.uploaded(m, new, activate=True).orderBy("id").collect()]
    all_ = ["personal_info", "skills", "work_experience"]
    assert got == [(5, "n", False, None), (6, "a", False, all_), (7, "b", False, ["work_experience"]), (8, "c", True, all_)]
    assert [r.is_active for r in readers.uploaded(m, new.limit(0), activate=True).collect()] == [True]


def test_a_page_that_cannot_be_read_costs_only_itself(spark):
    pages = spark.createDataFrame([("https://h/1", "<h1>T</h1><p class='c'>C</p><p class='d'>D</p>"), ("https://h/2", "<![bad[ <h1>"), ("https://h/3", None)], "url string, html string")
    found = lambda **k: [r.application_url for r in readers.postings_of_pages(pages, {"title": ("h1",), "company": (".c",), "description": (".d",)}, **k).collect()]
    assert found() == ["https://h/1"] and found(most=0) == []


def test_tables(spark, tmp_path):
    at = str(tmp_path)
    assert sinks.list_tables(spark, at + "/none") == []
    sinks.create_tables(spark, at, {"b": "x int", "a": "x int"})
    assert sinks.list_tables(spark, at) == ["a", "b"] and sinks.healthy(spark, at, ["a", "b"]) and not sinks.healthy(spark, at, ["a", "c"])
    assert sinks.drop_tables(spark, at, ["a", "c"]) == ["a"] and sinks.list_tables(spark, at) == ["b"]


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    at = str(tmp_path / "t.parquet")
    sinks.write_table(spark.createDataFrame([(1,)], "i int"), at)
    bad = spark.createDataFrame([(2,)], "i int").select(F.raise_error("broken").cast("int").alias("i"))
    with pytest.raises(Exception, match="broken"):
        sinks.write_table(bad, at)
    assert [r.i for r in spark.read.parquet(at).collect()] == [1]
    sinks.write_table(spark.read.parquet(at).selectExpr("i + 1 AS i"), at)  # it may read what it replaces
    assert [r.i for r in spark.read.parquet(at).collect()] == [2] and sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["t.parquet"]


def test_sinks(spark, tmp_path):
    assert sinks.create_tables(spark, str(tmp_path), {"a": "x int"}) == ["a"] and sinks.create_tables(spark, str(tmp_path), {"a": "x int"}) == []
    d = spark.createDataFrame([(1, "é", None)], "i int, s string, n string")
    sinks.export_json(d, str(tmp_path / "j"))
    assert json.loads(spark.read.text(str(tmp_path / "j")).first().value) == {"i": 1, "s": "é", "n": None}
    sinks.write_table(d, str(tmp_path / "w"), ["i"])
    assert spark.read.parquet(str(tmp_path / "w")).count() == 1
    sinks.dump_pages(spark.createDataFrame([("https://h/x", "<p>"), (None, "q")], "url string, html string"), str(tmp_path / "p"))
    assert sorted(r.host for r in spark.read.text(str(tmp_path / "p")).collect()) == ["h", "unknown"]


def test_seed(spark):
    m = spark.createDataFrame([(5, "n", "c", True, True, "x"), (6, "n", "c", True, False, "y")], "id long, name string, content string, is_active boolean, is_sample boolean, domain string")
    s = spark.createDataFrame([("a", "x", "1"), ("b", "y", "2"), ("c", "y", "3"), ("d", "z", "4")], "name string, domain string, content string")
    got = sorted((r.id, r.name, r.domain) for r in readers.seed_samples(m, s).collect())
    assert got == [(5, "n", "x"), (6, "n", "y"), (7, "b", "y"), (8, "d", "z")]


def test_upsert_stream_over_batches(spark, tmp_path):
    schema = "id long, application_url string, job_title string, company_name string, location string, job_description string, required_skills array<string>, preferred_skills array<string>, salary_range string, date_posted date, status string"
    for n, rows in enumerate([[(1, "u", "t", "c", "l", "d", ["A"], [], "5", None, "applied")], [(2, "u", "t2", "c", None, "d", ["B"], [], "", None, "new"), (3, "v", "t", "c", "l", "d", [], [], "", None, "new")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r.application_url: r for r in streams.upsert_stream(stream).select(*upsert.FIELDS).collect()}
    assert set(got) == {"u", "v"} and got["u"].location == "l" and sorted(got["u"].required_skills) == ["A", "B"]


def test_admission_stream(spark, tmp_path):
    at = lambda s: datetime.datetime(2025, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(seconds=s)
    spark.createDataFrame([("k", at(0)), ("k", at(10)), ("k", at(20)), ("j", at(0))], "k string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "c"))
    out = streams.replay(streams.admitted(streams.stream_of(spark, str(tmp_path / "c")), "k", "ts", 2), "admit")
    base = int(at(0).timestamp() * 1e6)
    assert sorted((r.k, r.admitted_at - base) for r in out.collect()) == [("j", 0), ("k", 0), ("k", 10_000_000), ("k", 60_000_001)]


def test_log_and_first_postings(spark, tmp_path):
    (tmp_path / "app.log").write_bytes(b"a ERROR\n\xff b\n")
    assert [r.line[0] for r in readers.read_log(spark, str(tmp_path / "app.log")).collect()] == ["a", "\ufffd"]
    at = lambda s: datetime.datetime(2025, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(seconds=s)
    spark.createDataFrame([("u", at(0)), ("u", at(5)), ("v", at(1))], "application_url string, date_scraped timestamp").coalesce(1).write.parquet(str(tmp_path / "p"))
    got = streams.replay(streams.first_by_url(streams.stream_of(spark, str(tmp_path / "p")), "date_scraped"), "first").collect()
    assert sorted(r.application_url for r in got) == ["u", "v"]
