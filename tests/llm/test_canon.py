import itertools
import random

import pytest
from pyspark.sql import functions as F

from quern.llm.canon import SHORT_FORMS, Lists, Trie, fold, map_values, most_edits, typed_values, words

LIST = [
    (1, "job_title", "Data Engineer", []), (2, "job_title", "Senior Data Engineer", []), (3, "job_title", "Recruiter", ["Talent Partner"]), (4, "job_title", "Junior Recruiter", ["Junior Talent Partner"]),
    (5, "location", "Kutor, QH", ["Kutor, Quarrin Hills"]), (6, "location", "Kutor, WR", ["Kutor, West Rhys"]), (7, "location", "São Velmo, LU", ["São Velmo, Lusmere"]), (8, "location", "Remote", ["WFH"]),
    (20, "job_title", "Machine Learning Engineer", ["ML Engineer"]), (9, "skill", "Python", ["py"]), (10, "skill", "Apache Spark", ["PySpark"]), (11, "skill", "Docker", []), (12, "skill", "Lean Manufacturing", []), (13, "skill", "Java", []),
]


def osa(a, b):
    """Edits with adjacent swaps, by the table."""
    d = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_trie_against_all_words():
    rng = random.Random(5)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randint(1, 10))) for _ in range(300)}
    t = Trie()
    for w in words:
        t.add(w, w, most_edits(len(w)))
    for _ in range(300):
        x = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 10)))
        want = {}
        for w in words:
            e = osa(x, w)
            if e <= most_edits(len(w)) and (e < 2 or len(w) > 7 or abs(len(w) - len(x)) < 2):
                want[w] = e
        assert t.search(x) == want, x
    assert t.search("") == {w: 1 for w in ()}


@pytest.mark.parametrize(
    ("kind", "value", "want"),
    [
        ("job_title", "Sr. Data Engr", 2), ("job_title", "ENGINEER (Senior Data)", 2), ("job_title", "We hire: Data Enigneer!", 1), ("job_title", "Jr Talent Partner | 3 openings", 4),
        ("job_title", "Sеniоr Ｄａｔａ Engineer", 2), ("job_title", "Glass Blower", None), ("job_title", "Data Entry Clerk", None), ("job_title", "Junior Zzzz Engineer", None), ("job_title", "MLEngineer wanted", 20), ("location", "Kutor", None), ("location", "WR - Kuttor", 6), ("location", "sao velmo metro", 7),
        ("location", "Home office / remote", 8), ("location", "Kutor West Rhys 12345", 6), ("skill", "exp. with Pyhton", 9), ("skill", "spark plugs", None), ("skill", "LeanManufacturing", 12), ("skill", "dock work", None),
        ("skill", "Javanese", None), ("skill", "Java", 13), ("skill", "• PySpark;", 10), ("skill", "", None), ("skill", "\u200b", None), ("nothing", "Java", None), ("skill", "x" * 100_000, None), ("skill", "java " * 20_000, 13),
    ],
)
def test_matches(kind, value, want):
    assert Lists(LIST).entry(kind, value) == (want or -1)


def test_ties_and_neighbours():
    rows = [*LIST, (30, "location", "Groastad, SC", []), (31, "location", "Groastad, LU", []), (32, "skill", "Jaga", []), (33, "skill", "Mava", []), (34, "job_title", "Junior Cook", []), (35, "job_title", "Senior Cook", [])]
    x = Lists(rows)
    assert x.entry("location", "Groastad") == -1 and x.candidates("location", "Groastad") == [(30, 0), (31, 0)] and x.entry("location", "Groastad LU") == 31
    assert x.entry("skill", "Java") == 13 and [i for i, _ in x.candidates("skill", "Java")] == [13, 32, 33]
    assert x.entry("job_title", "Jenior Cook") == 34 and x.entry("job_title", "Sunior Cook") == 35 and x.entry("job_title", "Xunior Cook") == 34
    assert x.entry("job_title", "one two three four five six Senior Cook") == 35 and x.entry("skill", "l e a n m a n u f a c t u r i n g") == 12
    assert Lists(rows, {"job_title": {"zz": "cook"}}).entry("job_title", "Senior ZZ") == 35 and Lists(rows, {}).entry("job_title", "Sr Data Engineer") == 1


def within(a, b):
    """Whether word a is near the list's word b."""
    d = osa(a, b)
    return d if d <= most_edits(len(b)) and (d < 2 or len(b) > 7 or abs(len(b) - len(a)) < 2) else None


def brute_force(rows, kind, value, short):
    """All entries within reach, by trying every form, every choice of words and every whole."""
    ws, out = words(value), {}
    known = {w for _, k, v, o in rows if k == kind for f in [v, *o] for w in words(f)}
    for i, k, v, others in rows:
        if k != kind:
            continue
        for f in [v, *others, *([v.split(",")[0]] if "," in v else [])]:
            form = words(f)
            near = [[within(a, b) for a in ws] for b in form]
            for row, b in zip(near, form):
                for n, a in enumerate(ws):
                    for s, w in short.items():
                        if w == b and s not in known and (d := osa(a, s)) <= int(len(s) > 3) and (row[n] is None or d < row[n]):
                            row[n] = d
            sums = [sum(r[p] for r, p in zip(near, place)) for place in itertools.permutations(range(len(ws)), len(form)) if all(r[p] is not None for r, p in zip(near, place))]
            whole = "".join(form)
            sums += [d for a in ["".join(ws), *(w for w in ws if len(w) > 5)] if (d := within(a, whole)) is not None]
            if sums:
                out[i] = min(out.get(i, 99), *sums)
    return out


def test_candidates_are_all_entries_within_reach():
    rng = random.Random(11)
    rows = [*LIST, (40, "job_title", "Date Engineer", ["Engineer Date Lead"]), (41, "job_title", "Lead Data Engineer", []), (42, "job_title", "Leader", ["Lead"])]
    x = Lists(rows)
    pool = ["data", "date", "engineer", "enginer", "senior", "junior", "recruiter", "lead", "ml", "talent", "partner", "dataengineer", "sr", "eng", "x", "machine", "learning"]
    for _ in range(400):
        ws = [rng.choice(pool) for _ in range(rng.randint(1, 4))]
        w = list(ws[0])
        if rng.random() < 0.7:
            w[rng.randrange(len(w))] = rng.choice("abe ")
        value = " ".join(["".join(w), *ws[1:]])
        assert dict(x.candidates("job_title", value)) == brute_force(rows, "job_title", value, SHORT_FORMS["job_title"]), value


def test_fold():
    assert fold("São VÉLMO ß") == "sao velmo ss"


def test_frames(spark):
    canon = spark.createDataFrame([(*r, 1.0) for r in [*LIST, (None, "skill", "x", None), (99, None, "y", None), (98, "skill", None, None)]], "canon_id int, kind string, canon_value string, alt_names array<string>, edits double")
    jobs = spark.createDataFrame(
        [(1, "Data Engineer ", None, ["Python", None, " ", "pyton"], "v"), (2, None, " ", None, "v"), (2, None, "wfh", [], "v"), (3, "", "", ["a"] * 3, "v")], "id long, job_title string, location string, required_skills array<string>, value string"
    )
    v = typed_values(jobs)
    got = sorted((r.job_id, r.field, r.item_no, r.canon_id) for r in map_values(v, canon).collect())
    assert got == [(1, "job_title", 0, 1), (1, "required_skills", 0, 9), (1, "required_skills", 3, 9), (2, "location", 0, 8), (3, "required_skills", 0, -1), (3, "required_skills", 1, -1), (3, "required_skills", 2, -1)]
    assert map_values(v, canon.limit(0), every=True).where((F.size("matches") > 0) | (F.col("canon_id") > 0)).count() == 0
    assert map_values(v.limit(0), canon).count() == 0
    with pytest.raises(ValueError, match="over"):
        import quern.llm.canon as c

        old, c.MOST_ENTRIES = c.MOST_ENTRIES, 3
        try:
            map_values(v, canon)
        finally:
            c.MOST_ENTRIES = old
