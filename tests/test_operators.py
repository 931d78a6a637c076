import datetime
import json

import pytest
from pyspark.sql import functions as F

from quern.functions import sets
from quern.operators import classify, extract, quota, resume_text, resumes, skills, upsert


@pytest.fixture(autouse=True, scope="module")
def columns(spark):
    global A, B
    A, B = F.col("a"), F.col("b")


def row(spark, schema, *values):
    return spark.createDataFrame([values], schema)


def test_skill_match(spark):
    d = row(spark, "a array<string>, b array<string>", ["Python", "Django", "PostgreSQL"], ["Python", "Django", "AWS"])
    m = d.select(skills.skill_match(A, B).alias("m")).first().m
    assert (m.score, m.matched, m.additional, m.n_job) == (50.0, ["django", "python"], ["aws"], 4)
    none = d.select(skills.skill_match(F.array().cast("array<string>"), B).alias("m")).first().m
    assert (none.score, none.matched, none.additional, none.n_resume) == (0.0, [], [], 3)
    assert d.select(skills.skill_match(F.lit(None).cast("array<string>"), A).alias("m")).first().m.score == 0.0


def test_match_score(spark):
    d = row(spark, "a array<string>, b array<string>, p array<string>, e array<string>", ["Python", "Django", "PostgreSQL"], ["Python", "Django", "AWS"], ["Redis"], [])
    level = F.lit(None).cast("string")
    assert d.select(skills.match_score(A, F.col("p"), B, F.col("e"), level).alias("s")).first().s.total == 50.5
    s = d.select(skills.match_score(A, F.col("e"), B, F.col("e"), level).alias("s")).first().s
    assert s.total == 65.5 and s.weight_note
    assert d.select(skills.match_score(A, F.col("e"), B, F.array(F.lit(""), F.lit("python"), F.lit("go")), F.lit("master")).alias("s")).first().s.experience == 58.33


def test_education_score(spark):
    d = row(spark, "a array<string>", ["BS", "x"])
    got = d.select(*[skills.education_score(F.lit(x), A).alias(x) for x in ("high_school", "bachelor", "master", "phd")]).first()
    assert list(got) == [100.0, 100.0, 50.0, 0.0]


def test_gap(spark):
    d = row(spark, "a array<string>, b array<string>", ["Python", "Go", "Rust"], ["python", "golang", " R "])
    g = d.select(skills.skill_gap(A, F.array(F.lit("Python"), F.lit("SQL")), B).alias("g")).first().g
    assert g.missing_required == [] and g.match_percentage == 100.0  # 'Rust' holds 'r'
    assert g.missing_preferred == ["SQL"] and g.matched == ["Python", "Go", "Rust"]
    assert d.select(skills.skill_gap(F.array().cast("array<string>"), A, B)["match_percentage"].alias("m")).first().m == 100.0


def test_category_match(spark):
    d = row(spark, "b array<string>", ["python"])
    by = F.create_map(F.lit("x"), F.array(F.lit("python")), F.lit("y"), F.array(F.lit("sql")), F.lit("z"), F.array().cast("array<string>"))
    assert d.select(skills.category_match(by, B).alias("s")).first().s == 50.0
    assert d.select(skills.category_match(by, B, F.create_map(F.lit("x"), F.lit(3.0))).alias("s")).first().s == 75.0


def test_sections(spark):
    t = "About\nRequirements:\n- a\nNice to have\n- b\nmust-have\n- c"
    s = row(spark, "a string", t).select(extract.sections(A).alias("s")).first().s
    assert (s.required, s.preferred) == ("About\n- a\n- c", "- b")
    s = row(spark, "a string", "x\nPreferred:\ny ").select(extract.sections(A).alias("s")).first().s
    assert (s.required, s.preferred) == ("x\nPreferred:\ny", "y")
    assert row(spark, "a string", None).select(extract.sections(A)["required"].alias("s")).first().s is None


def test_experience():
    f = lambda t: [(x["skill"], x["years"], x["is_minimum"]) for x in extract.experience(t)]
    assert f("5+ years of Python and SQL") == [("python", 5, True)]
    assert f("Docker: 3 years") == [("docker", 3, False)]
    assert f("No 5 years of Java") == [] and f("99 years of Java") == [] and f("") == []
    assert f("3-5 years of Go")[0][1] == 5 and f("3 to 5 years of Go")[0][1] == 3


def test_places_of_experience_are_all_matches_of_the_pattern():
    import random

    random.seed(5)
    form = extract._FORMS[2]
    for _ in range(2000):
        t = "".join(random.choice(["ab", "c", " ", "  ", ":", "3", " years", "year", "+", "\n", "x" * 20, "- "]) for _ in range(25))
        assert [m.span() for m in form.places(t)] == [m.span() for m in form.pattern.finditer(t)], t


def test_sections_of_one_text_are_those_of_the_column(spark):
    import random

    random.seed(6)
    lines = ["Requirements:", "nice to have", " Preferred ", "a", "", " b", "plus", "c\td"]
    texts = ["\n".join(random.choices(lines, k=6)) for _ in range(200)] + ["", " ", "\n"]
    got = spark.createDataFrame([(t,) for t in texts], "a string").select("a", extract.sections(A).alias("s")).collect()
    assert all(extract.parts(r.a) == (r.s.required, r.s.preferred) for r in got)


def test_facts(spark):
    find = extract.facts_finder(spark.createDataFrame([("sql", "skill"), ("go", "skill"), ("trust", "soft_skills"), ("texas", "skill")], "phrase string, category string"), lambda t: ["spacy", "go"])
    t = "Requirements:\nSQL, Texas and trust, 3+ years of Go and more\nNice to have:\nSQL, Go. MBA, master"
    rows = spark.createDataFrame([(t,), (None,), (" ",)], "a string").select(find(A).alias("f")).collect()
    f = rows[0].f
    assert (f.required, f.preferred, f.asked, f.level) == (["sql", "go", "spacy"], [], ["go"], "mba")
    assert all(r.f.required == [] and r.f.level is None for r in rows[1:])


def test_education_and_certificates():
    assert [(x["level"], x["is_required"]) for x in extract.education("Bachelor's degree in Physics. PhD preferred")] == [("bachelor", False), ("phd", False)]
    assert extract.education("managed")[0]["level"] == "high_school"
    assert [x["name"] for x in extract.certificates("PMP and pmp or CISSP a plus")] == ["pmp", "cissp"]
    assert extract.education("") == extract.certificates("") == []


def test_phrases(spark):
    p = extract.Phrases([("machine learning", "x"), ("learning", "y"), ("c", "z"), ("c++", "z"), ("sql", "x"), ("sql", "y")])
    hits = lambda t: [(a, c, k) for a, c, k in p.find(t)]
    assert hits("Machine learning, learning") == [("machine learning", "x", 0), ("learning", "y", 18)]
    assert hits("no learning here. learning") == [("learning", "y", 18)]
    assert [h[0] for h in hits("C++ dev")] == ["c"] and hits("mysql sqlx") == []
    assert hits("sql") == [("sql", "x", 0)] and hits("") == []
    find = extract.phrase_finder(spark.createDataFrame([("sql", "k"), (None, "k")], "phrase string, category string"))
    got = spark.createDataFrame([("SQL",), (None,), ("",)], "a string").select(find(A).alias("h")).collect()
    assert [None if r.h is None else len(r.h) for r in got] == [1, None, 0]


def test_phrases_against_one_pattern_each():
    import random
    import re

    random.seed(3)
    words = ["a", "b", "ab", "a b", "b a", "a-b", "b c d", "c", "c d"]
    p = extract.Phrases([(w, "k") for w in words])
    for _ in range(300):
        t = "".join(random.choice(["a", "b", "c", "d", " ", " ", "-", ".", "no "]) for _ in range(30))
        want, spans = [], []
        for w in sorted(words, key=len, reverse=True):
            for m in re.finditer(rf"\b{re.escape(w)}\b", t):
                a, e = m.span()
                if not any(x <= a and e <= y for x, y in spans) and not extract._NEGATION.search(t[max(0, a - 50) : a]):
                    spans.append((a, e))
                    want.append((w, a))
        assert sorted((w, a) for w, _, a in p.find(t)) == sorted(want), t


def test_resume_text(spark):
    t = "Ann\na@b.co\nSkills:\nPython | SQL\n• Go · Rust\nEXPERIENCE\nAcme 2020"
    s = row(spark, "a string", t).select(extract.resume_sections(A).alias("s")).first().s
    assert s == {"head": ["Ann", "a@b.co"], "skills": ["Python | SQL", "• Go · Rust"], "experience": ["Acme 2020"]}
    assert row(spark, "a array<string>", ["Python | SQL", "Go, Go", "-x-", "Java"]).select(extract.listed_skills(A).alias("s")).first().s == ["Python", "SQL", "Go", "Java"]


def test_domain(spark):
    d = row(spark, "a string, b string", "Data Analyst", "sql sql nurse")
    find = classify.domain_finder(classify.keyword_table(spark))
    c = d.select(find(A, B).alias("c")).first().c
    assert (c.domain, c.best, c.total) == ("data", 8, 9) and round(c.confidence, 4) == 0.8889
    assert d.select(find(F.lit(None).cast("string"), F.lit("sql nurse")).alias("c")).first().c.domain == "other"


def test_document_kind(spark):
    d = row(spark, "a string", "experience education skills a@b.co 555-123-4567")
    k = d.select(classify.document_kind(A).alias("k")).first().k
    assert (k.verdict, k.confidence, k.n_resume) == ("resume", 0.7, 3)
    assert d.select(classify.document_kind(F.lit("Invoice, subtotal"))["verdict"].alias("v")).first().v == "not_resume"
    assert d.select(classify.document_kind(F.lit(None).cast("string"))["confidence"].alias("v")).first().v == 0.0
    t = "experience education skills summary projects a@b.co 555-123-4567 receipt"
    assert d.select(classify.document_kind(F.lit(t))["verdict"].alias("v")).first().v == "inconclusive"


def test_parsed_shapes(spark):
    docs = [
        {"skills": ["a", "", None, "b"], "work_experience": {"title": "t", "bullets": "one", "dates": "2020 - 2022"}, "certifications": ["c", {"title": "d"}, {"name": "e"}], "summary": "s"},
        {"skills": {"X": ["a"], "Y": [], "Z": None}, "experience": [None, {"title": None, "duration": "2010-2012"}], "projects": [{"name": "p", "tech": ["q"], "bullets": ["z"]}], "certifications": {"name": "f"}},
        {},
    ]
    texts = [json.dumps(docs[0]), json.dumps(json.dumps(docs[1])), json.dumps(docs[2]), None, "{bad", "[]"]
    p = resumes.parsed(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, content string")).orderBy("id").collect()
    assert p[0].skills == ["a", "b"] and p[0].bullets == ["one"] and p[0].certs == ["c", "d", "e"] and p[0].summary == "s"
    assert p[1].skills == ["a"] and p[1].certs == ["f"] and p[1].projects[0].technologies == ["q"] and p[1].positions[0].dates == "2010-2012" and p[1].bullets == ["z"]
    for r in p[2:]:
        assert (r.skills, r.bullets, r.certs, r.summary, r.positions) == ([], [], [], None, [])


def test_style(spark):
    s = row(spark, "a array<string>", ["• Cut costs 5%.", "• did x.", "plain Text."]).select(resumes.style(A, F.lit("I my me")).alias("s")).first().s
    assert (s.voice, s.sentences, s.bullet_char, s.capitalization, s.trailing_period, s.metric_density, s.n_bullets) == ("first_person", "punchy", "•", "lower", True, "moderate", 3)
    s = row(spark, "a array<string>", []).select(resumes.style(A, F.lit(None).cast("string")).alias("s")).first().s
    assert (s.voice, s.sentences, s.avg_words, s.bullet_char, s.capitalization, s.trailing_period) == ("no_pronouns", "moderate", 0.0, "none", "upper", False)


def test_checks(spark):
    d = row(spark, "a string, b string", "Cut cost by 40% for five teams", "Worked on awesome Kubernetes things")
    c = d.select(resumes.check_bullet(A, B, F.array(F.lit("sql"))).alias("c")).first().c
    assert c.warnings == ["figures removed", "unfit word", "filler phrase", "new skill"] and c.score == 20 and not c.is_valid
    assert d.select(resumes.check_bullet(A, A).alias("c")).first().c.is_valid
    assert d.select(resumes.check_bullet(A, F.lit("")).alias("c")).first().c.warnings == ["figures removed", "too short", "empty"]
    assert d.select(resumes.check_summary(A, F.lit("x " * 120)).alias("c")).first().c.warnings == ["too long"]


def test_tailoring(spark):
    d = row(spark, "a array<string>, b array<string>", ["sql work", "none", "sql and go"], ["SQL", "Go", "sql"])
    got = d.select(
        resumes.best_bullets(A, B, 2).alias("i"), resumes.promoted(F.array(F.lit("Go")), B, F.lit("sql go")).alias("p"), resumes.coverage(F.lit("sql"), B).alias("c"),
        resumes.coverage(F.lit("x"), F.array().cast("array<string>")).alias("z"), sets.first_matching(A, B).alias("f"),
    ).first()
    assert (got.i, got.p, got.c, got.z, got.f) == ([0, 2], ["Go", "SQL"], 66.7, 0.0, ["sql work", "none", "sql and go"])
    pos = F.transform(F.array(F.lit("2020-2024"), F.lit("2018-2020"), F.lit("2022 – Present")), lambda x: F.struct(x.alias("dates")))
    assert d.select(resumes.years_of_experience(pos).alias("y")).first().y == 6


def test_upsert(spark):
    schema = "id long, application_url string, job_title string, company_name string, location string, job_description string, required_skills array<string>, preferred_skills array<string>, salary_range string, date_posted date, status string, extra int"
    day = datetime.date(2025, 1, 1)
    old = spark.createDataFrame([(1, "u", "t", "c", "l", "d", ["A"], None, "5", day, "applied", 0), (2, "v", "t", "c", None, "d", None, None, None, None, "new", 0)], schema)
    new = spark.createDataFrame(
        [(8, "u", "t1", "c1", "", "d1", ["x"], ["p"], None, None, "new", 0), (9, "u", "t2", "c2", None, "d2", ["a", "B"], ["p"], "", None, "new", 0), (10, "w", "n", "c", "l", "d", ["Q"], [], None, None, "archived", 0), (11, None, "n", "c", "l", "d", [], [], None, None, "new", 0)],
        schema,
    )
    got = {r.id: r for r in upsert.upsert_postings(old, new).collect()}
    assert set(got) == {1, 2, 10}
    r = got[1]
    assert (r.job_title, r.location, r.salary_range, r.date_posted, r.required_skills, r.preferred_skills, r.status, r.is_new) == ("t2", "l", "5", day, ["A", "B"], ["p"], "applied", False)
    assert got[10].status == "new" and got[10].is_new and got[2].job_title == "t"
    assert upsert.upsert_postings(old.limit(0), new.limit(0)).count() == 0


def test_ledger(spark):
    usage = spark.createDataFrame([("m", "d", 1, 2)], "model string, day string, n_calls long, n_tokens long")
    calls = spark.createDataFrame([("m", "d", "12345678"), ("n", "d", None)], "model string, day string, text string")
    assert sorted(map(tuple, upsert.ledger(usage, calls).collect())) == [("m", "d", 2, 4), ("n", "d", 1, 0)]


def test_quota(spark):
    at = lambda s: datetime.datetime(2025, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(seconds=s)
    d = spark.createDataFrame([("k", i, at(s)) for i, s in enumerate([0, 10, 60, 61, 86400])] + [("j", 9, at(0))], "k string, i int, ts timestamp")
    assert {r.i: r.n_window for r in quota.offered_load(d, "k", "ts").collect()} == {0: 1, 1: 2, 2: 3, 3: 3, 4: 1, 9: 1}
    got = {r.i: (r.n_today, r.admitted, r.left) for r in quota.daily_quota(d, "k", "ts", "i", 2).collect()}
    assert got[1] == (2, True, 0) and got[2] == (3, False, 0) and got[4] == (1, True, 1)
    base = int(at(0).timestamp() * 1e6)
    adm = {r.i: (r.admitted_at - base) / 1e6 for r in quota.admissions(d, "k", "ts", "i", 1).collect()}
    assert adm[0] == 0 and adm[1] == 60.000001 and adm[2] == 120.000002 and adm[9] == 0 and adm[4] == 86400
    assert quota.admissions(d.limit(0), "k", "ts", "i", 1).count() == 0


def test_resume_text_entries(spark):
    t = """Ann Lee
ann@mail.example | 555-123-4567
Port Calder, SC  github.com/ann
SUMMARY
Builds things.
EXPERIENCE
Acme Corp 2020 - Present
Engineer
• Cut cost
short
Ran the whole platform of the firm
Other Inc Jan 2018 - Mar 2019
Analyst
EDUCATION
BSc, b.s in Maths
Town College
Class of 2017
Certifications:
- PMP
Academic background
none
PROJECTS
Rocket
• flies
• far
Boat
"""
    r = spark.createDataFrame([(t,), (None,), ("",)], "a string").select(resume_text.parsed_text(A).alias("r")).collect()
    x = r[0].r
    assert (x.personal_info.name, x.personal_info.email, x.personal_info.phone, x.personal_info.location, x.personal_info.github) == ("Ann Lee", "ann@mail.example", "555-123-4567", "Port Calder, SC", "github.com/ann")
    assert x.summary == "Builds things."
    assert [(p.title, p.company, p.bullets) for p in x.positions] == [("Engineer", "Acme Corp 2020 - Present", ["Cut cost", "Ran the whole platform of the firm"]), ("Analyst", "Other Inc Jan 2018 - Mar 2019", [])]
    assert [tuple(e) for e in x.education] == [("BSc, b.s in Maths", "Town College", "2017")]
    assert x.certifications == ["PMP"] and [tuple(p) for p in x.projects] == [("Rocket", "flies far"), ("Boat", "")]
    assert r[1].r.positions == [] and r[2].r.personal_info.name == ""


def test_cover():
    import random

    random.seed(9)
    for _ in range(300):
        cover, given = extract.Cover(), []
        for _ in range(30):
            a = random.randint(0, 30)
            b = a + random.randint(1, 12)
            want = not any(x <= a and b <= y for x, y in given)
            assert cover.take(a, b) == want
            if want:
                given.append((a, b))


def test_bullets_that_lose_a_figure_are_rejected(spark):
    kind = "array<struct<title:string,bullets:array<string>>>"
    d = row(spark, f"a {kind}, b {kind}", [("t", ["Cut cost by 20%", "Led a team", "Third"]), ("u", ["x"])], [("t", ["Reduced cost", "Headed a team"])])
    got = d.select(resumes.merged_bullets(A, B).alias("m")).first().m
    assert [(x.bullet, x.rejected) for x in got] == [("Cut cost by 20%", True), ("Headed a team", False), ("Third", False), ("x", False)]


def test_skills_by_category(spark):
    d = row(spark, "a map<string,array<string>>, b array<string>", {"Languages": ["Go", "Java"], "Tools": ["Git"]}, ["java", "Docker", None, "docker"])
    get = lambda groups: d.select(resumes.promoted_groups(groups, B, F.lit("uses DOCKER and Java")).alias("g")).first().g
    assert get(A) == {"Languages": ["Go", "Java"], "Tools": ["Git", "Docker"]}
    assert get(F.map_filter(A, lambda k, v: k != "Tools")) == {"Languages": ["Go", "Java"], "Additional Skills": ["Docker"]}
    groups = F.from_json(F.lit('{"Languages": ["Go", "Java"], "Tools": ["Git"]}'), "map<string,array<string>>")
    assert d.select(resumes.tailored_skills(F.array(F.lit("z")), groups, B, F.lit("")).alias("s")).first().s == ["Java", "Go", "Git"]


def test_upsert_batch(spark):
    kind = "id long, application_url string, job_title string, company_name string, location string, job_description string, required_skills array<string>, preferred_skills array<string>, salary_range string, date_posted date, status string"
    full = lambda i, url, company="c": (i, url, "t", company, None, "d", None, None, None, None, "applied")
    jobs = spark.createDataFrame([full(1, "u")], kind)
    came = spark.createDataFrame([full(2, "u"), full(3, "v"), full(4, "v"), full(5, "w", ""), full(6, "x", None)], kind)
    after, counts = upsert.upsert_batch(jobs, came, F.length("company_name") > 0)
    assert sorted((r.id, r.application_url, r.status) for r in after.collect()) == [(1, "u", "applied"), (4, "v", "new")]
    assert {r.outcome: r.n_postings for r in counts.collect()} == {"failed": 2, "saved": 1, "updated": 2}
    none = upsert.upsert_batch(jobs.limit(0), came.limit(0), F.lit(True))
    assert none[0].count() == 0 and {r.n_postings for r in none[1].collect()} == {0}
