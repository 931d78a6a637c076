"""Queries of matching, extraction, classification, profiling, checks, tailoring, quotas and upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import sets, text
from quern.operators import classify, extract, hooks, quota, resume_text, resumes, skills, upsert
from quern.plans.relational import TODAY, valid_posting, resume_for_domain
from quern.session import heavy, table

# --- text functions over adverts --------------------------------------------------------------------------------------


def _jobs(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return heavy(spark, d, "jobs", "id", *columns)


def t01_normalised_titles(spark: SparkSession, d: str) -> DataFrame:
    return _jobs(spark, d, "source", "company_name").select("id", text.normalise_skill(F.concat(F.lit(" "), "company_name", F.lit(" ;!"))).alias("name"))


def t02_canonical_skills(spark: SparkSession, d: str) -> DataFrame:
    """Skills by the name they count under, with two more synonyms."""
    s = _jobs(spark, d, "required_skills").select(F.explode("required_skills").alias("s")).where("s is not null")
    name = sets.canonical(text.normalise_skill(F.col("s")), {"apache spark": "spark", "unit testing": "testing"})
    return s.groupBy(name.alias("skill")).agg(F.count("*").alias("n"))


def t03_expanded(spark: SparkSession, d: str) -> DataFrame:
    return _jobs(spark, d, "required_skills").select("id", _list(sets.expanded(F.col("required_skills"))).alias("forms"))


def t04_clean(spark: SparkSession, d: str) -> DataFrame:
    return _jobs(spark, d, "job_description").select("id", text.clean_text(F.col("job_description")).alias("clean"))


def t05_truncated(spark: SparkSession, d: str) -> DataFrame:
    return _jobs(spark, d, "job_description").select("id", text.truncate_words(F.col("job_description"), 100).alias("short"))


def t06_html(spark: SparkSession, d: str) -> DataFrame:
    page = F.concat(F.lit("<p>A &amp; B</p> <b>"), "company_name", F.lit("</b>"))
    return _jobs(spark, d, "company_name").select("id", text.html_text(page).alias("text"))


def t07_urls(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("application_url")
    return _jobs(spark, d, "application_url").select(
        "id", text.without_query(u).alias("bare"), text.posting_url(F.concat(u, F.lit("?a=1&jk=k"), F.col("id").cast("string"), F.lit("&b=2")), "https://board.example").alias("canonical"))


def t08_slug_and_host(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("application_url")
    return _jobs(spark, d, "application_url").select("id", text.url_slug(u).alias("slug"), text.url_host(u).alias("host"))


def t09_sentences(spark: SparkSession, d: str) -> DataFrame:
    return _jobs(spark, d, "job_description").select("id", _list(text.sentences(F.col("job_description"))).alias("sentences"))


def t10_first_sentence(spark: SparkSession, d: str) -> DataFrame:
    return _jobs(spark, d, "job_description").select("id", text.first_sentence_with(F.col("job_description"), F.lit("Travel")).alias("sentence"))


def t11_noise(spark: SparkSession, d: str) -> DataFrame:
    v = _jobs(spark, d, "location").where("location is not null").select(F.lower("location").alias("v"))
    return v.distinct().select("v", text.is_noise(F.col("v")).alias("noise"))


def t12_technical(spark: SparkSession, d: str) -> DataFrame:
    s = _jobs(spark, d, "required_skills").select(F.explode("required_skills").alias("s")).where("s is not null")
    return s.distinct().select("s", text.looks_technical(F.lower("s")).alias("technical"))


def t13_negated(spark: SparkSession, d: str) -> DataFrame:
    """Whether the text negates the advert's last skill where it first names it; false where it doesn't name it."""
    at = F.coalesce(F.instr(F.lower("job_description"), F.lower(F.try_element_at("required_skills", F.lit(-1)))), F.lit(0))
    negated = (at > 0) & text.negated_before(F.col("job_description"), at)
    return _jobs(spark, d, "job_description", "required_skills").select("id", F.coalesce(negated, F.lit(False)).alias("negated"))


def t14_clean_skill(spark: SparkSession, d: str) -> DataFrame:
    s = _jobs(spark, d, "required_skills").select(F.explode("required_skills").alias("s")).where("s is not null")
    return s.distinct().select("s", text.clean_skill(F.col("s")).alias("skill"))


def t15_printable(spark: SparkSession, d: str) -> DataFrame:
    return _jobs(spark, d, "job_title").select("id", text.printable_cp1252(F.col("job_title")).alias("title"))


def t16_split(spark: SparkSession, d: str) -> DataFrame:
    return _jobs(spark, d, "location").select("id", F.array_join(text.split_list(F.col("location")), "|").alias("parts"))


def t17_titles(spark: SparkSession, d: str) -> DataFrame:
    return _jobs(spark, d, "job_title").select("id", text.title_case(F.col("job_title")).alias("title"))


def t18_markdown(spark: SparkSession, d: str) -> DataFrame:
    return _jobs(spark, d, "company_name").select("id", text.without_markdown(F.concat(F.lit('"**'), "company_name", F.lit('**" '))).alias("plain"))


def t19_voice(spark: SparkSession, d: str) -> DataFrame:
    return heavy(spark, d, "documents", "doc_id", "text").select("doc_id", text.voice(F.col("text")).alias("voice"))


def t20_contacts(spark: SparkSession, d: str) -> DataFrame:
    return heavy(spark, d, "documents", "doc_id", "text").select("doc_id", text.contacts(F.col("text")).alias("c")).select("doc_id", "c.email", "c.phone", "c.linkedin", "c.github")


def t23_json_or_text(spark: SparkSession, d: str) -> DataFrame:
    """A JSON string's text, any other text as it is: over breakdowns of scores, and the same as JSON strings."""
    t = table(spark, d, "tailored_resumes").select("id", "score_breakdown", F.to_json(F.struct(F.col("score_breakdown").alias("v"))).alias("j"))
    quoted = F.regexp_extract("j", r"(?s)^\{\"v\":(.*)\}$", 1)
    return t.select("id", text.json_or_text(F.col("score_breakdown")).alias("value"), text.json_or_text(F.when(F.col("score_breakdown").isNotNull(), quoted)).alias("unquoted"))


def r08_posted_dates(spark: SparkSession, d: str) -> DataFrame:
    """The dates of adverts said as days, weeks, months ago or in ISO form, by source; 'recently' without one."""
    n = F.datediff(F.lit(TODAY), "date_posted")
    say = lambda x, unit: F.concat(F.lit("Posted "), F.floor(x).cast("string"), F.lit(f" {unit} ago"))
    raw = (
        F.when(F.col("date_posted").isNull(), "recently").when(F.col("source") == "jobharbor", say(n, "days")).when(F.col("source") == "hirewell", say(n / 7, "weeks"))
        .when(F.col("source") == "tasknest", say(n / 30, "months")).otherwise(F.col("date_posted").cast("string"))
    )
    return _jobs(spark, d, "date_posted", "source").select("id", text.posted_date(raw, F.lit(TODAY)).alias("posted"))


def r09_salaries(spark: SparkSession, d: str) -> DataFrame:
    return _jobs(spark, d, "salary_range").select("id", text.salary_text(F.col("salary_range")).alias("salary"))


# --- matching ---------------------------------------------------------------------------------------------------------------


def _masters(spark: SparkSession, d: str) -> DataFrame:
    """Master resumes as columns, with resume_id."""
    return resumes.parsed(heavy(spark, d, "master_resumes", F.col("id").alias("resume_id"), "content"))


def _resume_skills(spark: SparkSession, d: str) -> DataFrame:
    """resume_id, resume_skills of master resumes."""
    p = _masters(spark, d)
    return p.select("resume_id", resumes.all_skills(p).alias("resume_skills"))


def _resume_sides(spark: SparkSession, d: str) -> DataFrame:
    """resume_id, resume_skills, r: each resume's skills expanded once, before it meets its adverts."""
    return _resume_skills(spark, d).withColumn("r", skills.resume_side(F.col("resume_skills")))


def _tailored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tailored_resumes").select(F.col("id").alias("tailored_id"), "job_id", F.col("master_resume_id").alias("resume_id"))


def _pairs(spark: SparkSession, d: str, *columns: str, sides: bool = True) -> DataFrame:
    """Adverts with the resume tailored for them: the pairs to compare."""
    j = table(spark, d, "jobs").select(F.col("id").alias("job_id"), *columns)
    return _tailored(spark, d).join(j, "job_id").join(_resume_sides(spark, d) if sides else _resume_skills(spark, d), "resume_id")


def _advert_sides(adverts: DataFrame, find: Callable[[Column], Column]) -> DataFrame:
    """adverts (required_skills, preferred_skills, job_description) with a, what C02 needs of them: one reading of each text.

    Skills that an advert lists count; those of its text only where its required ones are null.
    """
    f = adverts.withColumn("f", find(F.col("job_description")))
    listed = F.col("required_skills").isNotNull()
    required = F.coalesce("required_skills", "f.required")
    preferred = F.when(listed, sets.none_as_empty(F.col("preferred_skills"))).otherwise(F.coalesce("preferred_skills", "f.preferred"))
    return f.withColumn("a", skills.advert_side(required, preferred, F.col("f.asked"), F.col("f.level"))).drop("f", "required_skills", "preferred_skills", "job_description")


def _active_resume(spark: SparkSession, d: str) -> DataFrame:
    """The active resume of least id with its skills: one row at most."""
    _, active = resume_for_domain(table(spark, d, "master_resumes").select("id", "domain", "is_sample", "is_active"))
    return _resume_sides(spark, d).join(F.broadcast(active.withColumnRenamed("active_resume", "resume_id")), "resume_id")


def _list(c: Column) -> Column:
    return F.array_join(c, "|")


def p13_resume_parts(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the parts of each resume."""
    p = _masters(spark, d).withColumnRenamed("resume_id", "id")
    return p.select("id", F.size("positions").alias("n_positions"), F.size("skills").alias("n_skills"), F.size("certs").alias("n_certs"), F.size("projects").alias("n_projects"), F.size("bullets").alias("n_bullets"), F.col("summary").isNotNull().alias("has_summary"))


def _match(weights: Column | None = None) -> Column:
    """C01 of a pair's advert with its resume's side."""
    sides = F.struct((F.size(sets.none_as_empty(F.col("required_skills"))) > 0).alias("some"), sets.expanded(F.col("required_skills")).alias("j"))
    return text.bound(sides, lambda x: skills.compared(x["some"], x["j"], F.col("r"), weights))


def n03_json_keys(spark: SparkSession, d: str) -> DataFrame:
    """The sections that a resume's JSON has, in order; null if it is no object."""
    c = text.json_or_text(F.col("content"))
    return table(spark, d, "master_resumes").select("id", F.array_join(F.json_object_keys(c), "|").alias("sections"))


def k07_printable(spark: SparkSession, d: str) -> DataFrame:
    """Whether a resume has what its print needs: a person with name and e-mail address that aren't blank."""
    c = text.json_or_text(F.col("content"))
    some = lambda f: F.coalesce(F.length(text.stripped(F.get_json_object(c, f"$.personal_info.{f}"))) > 0, F.lit(False))
    return table(spark, d, "master_resumes").select("id", (some("name") & some("email")).alias("ok"))


def c01_skill_match(spark: SparkSession, d: str) -> DataFrame:
    m = _pairs(spark, d, "required_skills").select("tailored_id", _match().alias("m"))
    return m.select("tailored_id", F.round("m.score", 6).alias("score"), _list(F.col("m.matched")).alias("matched"), F.size("m.missing").alias("n_missing"), F.size("m.additional").alias("n_additional"), "m.n_job", "m.n_resume")


def a20_weighted_match(spark: SparkSession, d: str) -> DataFrame:
    """The match with double weight on two skills."""
    w = F.create_map(F.lit("python"), F.lit(2.0), F.lit("sql"), F.lit(2.0))
    return _pairs(spark, d, "required_skills").select("tailored_id", F.round(_match(w)["score"], 6).alias("score"))


def a21_category_match(spark: SparkSession, d: str) -> DataFrame:
    by = F.create_map(F.lit("required"), sets.none_as_empty(F.col("required_skills")), F.lit("preferred"), sets.none_as_empty(F.col("preferred_skills")))
    return _pairs(spark, d, "required_skills", "preferred_skills").select("tailored_id", F.round(skills.category_match(by, F.col("resume_skills")), 6).alias("score"))


def c02_match_score(spark: SparkSession, d: str) -> DataFrame:
    """The weighted score of each pair, requirements read from the text, once an advert."""
    t = _tailored(spark, d)
    j = _jobs(spark, d, "required_skills", "preferred_skills", "job_description").join(t.select(F.col("job_id").alias("id")), "id", "left_semi")
    j = _advert_sides(j, extract.facts_finder(dictionary(spark, d))).withColumnRenamed("id", "job_id")
    p = t.join(j, "job_id").join(_resume_sides(spark, d).drop("resume_skills"), "resume_id")
    return p.select("tailored_id", skills.score_of(F.col("a"), F.col("r")).alias("s")).select("tailored_id", "s.total", "s.required", "s.preferred", "s.experience", "s.education", "s.bonus")


def c03_education_rank(spark: SparkSession, d: str) -> DataFrame:
    return _resume_sides(spark, d).select("resume_id", F.col("r.rank").alias("rank"))


def c04_skill_gap(spark: SparkSession, d: str) -> DataFrame:
    """The gap of each pair."""
    g = _pairs(spark, d, "required_skills", "preferred_skills").select("tailored_id", skills.gap_for(F.col("required_skills"), F.col("preferred_skills"), F.col("r")).alias("g"))
    return g.select("tailored_id", _list(F.col("g.missing_required")).alias("missing"), F.size("g.missing_preferred").alias("n_missing_preferred"), "g.match_percentage", _list(F.col("g.priority_gaps")).alias("first_gaps"))


def j06_score_for_active(spark: SparkSession, d: str) -> DataFrame:
    """One resume against all adverts: the single row is broadcast."""
    one = _active_resume(spark, d)
    j = table(spark, d, "jobs").select("id", "required_skills")
    return j.crossJoin(F.broadcast(one)).select("id", F.round(_match()["score"], 6).alias("score"))


def c12_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Analysed adverts without tailored resume, with the resume of their domain or the active one, whose C02 is at least 35."""
    own, active = resume_for_domain(table(spark, d, "master_resumes").select("id", "domain", "is_sample", "is_active"))
    done = table(spark, d, "tailored_resumes").select(F.col("job_id").alias("id"))
    j = _jobs(spark, d, "domain", "status", "required_skills", "preferred_skills", "job_description").where(F.col("status") == "analyzed").join(done, "id", "left_anti")
    j = _advert_sides(j, extract.facts_finder(dictionary(spark, d)))
    j = j.join(own, "domain", "left").crossJoin(F.broadcast(active)).withColumn("resume_id", F.coalesce("domain_resume", "active_resume"))
    scored = j.join(_resume_sides(spark, d).drop("resume_skills"), "resume_id").select("id", "resume_id", skills.score_of(F.col("a"), F.col("r"))["total"].alias("score"))
    return scored.where("score >= 35")


# --- extraction ---------------------------------------------------------------------------------------------------------------


def dictionary(spark: SparkSession, d: str) -> DataFrame:
    """Phrase, category of the reference list of skills, other names included."""
    c = table(spark, d, "canon_values").where("kind = 'skill'")
    names = F.concat(F.array("canon_value"), sets.none_as_empty(F.col("alt_names")))
    return c.select(F.explode(names).alias("p")).select(F.lower("p").alias("phrase"), F.lit("skill").alias("category")).distinct()


#: Soft skills that the test texts name: an example of a further category of a dictionary.
SOFT_SKILLS = ("mentor", "coach", "organise", "negotiate", "trust", "clarity", "strong interest", "willingness")


def keywords(spark: SparkSession, d: str) -> DataFrame:
    """phrase, category: all of the reference list by kind, and soft skills."""
    c = table(spark, d, "canon_values").where("kind is not null")
    names = c.select("kind", F.explode(F.concat(F.array("canon_value"), sets.none_as_empty(F.col("alt_names")))).alias("p"))
    soft = spark.createDataFrame([(w, "soft_skills") for w in SOFT_SKILLS], "phrase string, category string")
    return names.select(F.lower("p").alias("phrase"), F.col("kind").alias("category")).distinct().unionByName(soft)


def r01_sections(spark: SparkSession, d: str) -> DataFrame:
    return heavy(spark, d, "documents", "doc_id", "text").select("doc_id", extract.sections(F.col("text")).alias("s")).select("doc_id", "s.required", "s.preferred")


#: Demands that _demanding() adds to adverts in turn.
DEMANDS = (
    "AWS Certified Developer Associate preferred", "PMP or Certified Scrum Master is a plus", "Six  Sigma Green Belt and CISSP required",
    "CompTIA Security+ desired; ITIL v4", "Bachelor's degree in Physics or an MBA, PhD preferred",
)


def _demanding(spark: SparkSession, d: str) -> DataFrame:
    """id, text: the adverts' whole texts with a closing paragraph of demands, made of their skills, as the texts themselves ask for little."""
    s = lambda n: F.try_element_at("required_skills", F.lit(n))
    n = lambda k: (F.col("id") % k).cast("string")
    more = F.element_at(text.words_array(DEMANDS), (F.col("id") % len(DEMANDS) + 1).cast("int"))
    parts = ("job_description", F.lit(" "), n(30), F.lit("+ years of "), s(1), F.lit(" and more. No 4 years of "), s(2), F.lit(" needed. "), s(3), F.lit(": "), n(9), F.lit(" years. "), more)
    return _jobs(spark, d, "job_description", "required_skills").select("id", F.concat_ws("", *parts).alias("text"))


def r02_experience(spark: SparkSession, d: str) -> DataFrame:
    return _demanding(spark, d).select("id", F.explode(extract.experience_of(F.col("text"))).alias("x")).select("id", "x.skill", "x.years", "x.is_minimum")


def r03_education(spark: SparkSession, d: str) -> DataFrame:
    return heavy(spark, d, "documents", "doc_id", "text").select("doc_id", F.explode(extract.education_of(F.col("text"))).alias("x")).select("doc_id", "x.level", "x.field", "x.is_required")


def r04_certificates(spark: SparkSession, d: str) -> DataFrame:
    return _demanding(spark, d).select("id", F.explode(extract.certificates_of(F.col("text"))).alias("x")).select("id", "x.name", "x.is_required")


def r05_requirements(spark: SparkSession, d: str) -> DataFrame:
    """All requirements of an advert in one row: least and most years (0 for none), the highest level, the first of equals."""
    t = F.col("text")
    r = _demanding(spark, d).select("id", extract.experience_of(t).alias("e"), extract.education_of(t).alias("d"), extract.certificates_of(t).alias("c"))
    rank = lambda x: F.coalesce(*[F.when(x["level"] == k, F.lit(v)) for k, v in extract.LEVEL_RANKS.items()])
    level = F.array_max(F.transform("d", lambda x, i: F.struct(rank(x).alias("r"), (-i).alias("i"), x["level"].alias("level"))))["level"]
    years = F.transform("e", lambda x: x["years"])
    return r.select("id", F.coalesce(F.array_min(years), F.lit(0)).alias("min_years"), F.coalesce(F.array_max(years), F.lit(0)).alias("max_years"), level.alias("level"), F.size("d").alias("n_levels"), F.size("c").alias("n_certificates"))


def r06_phrases(spark: SparkSession, d: str) -> DataFrame:
    find = extract.phrase_finder(dictionary(spark, d))
    return _jobs(spark, d, "job_description").select("id", F.explode(find(F.col("job_description"))).alias("h")).select("id", "h.phrase", "h.place")


def r07_skills(spark: SparkSession, d: str, entities: extract.Entities | None = None) -> DataFrame:
    """Skills of the required and the preferred part, preferred ones without the required, no noise; entities adds what a
    model names."""
    find = extract.facts_finder(dictionary(spark, d), entities)
    f = _jobs(spark, d, "job_description").select("id", find(F.col("job_description")).alias("f"))
    return f.select("id", _list(F.array_sort("f.required")).alias("required"), _list(F.array_sort("f.preferred")).alias("preferred"))


def a29_by_category(spark: SparkSession, d: str) -> DataFrame:
    """An advert's keywords by category, surest first, then by text; the first 15 are shown."""
    find = extract.phrase_finder(keywords(spark, d))
    h = _jobs(spark, d, "job_description").select("id", F.explode(find(F.col("job_description"))).alias("h")).select("id", "h.category", "h.phrase", F.lit(1.0).alias("confidence"))
    g = h.groupBy("id", "category").agg(F.collect_set(F.struct((-F.col("confidence")).alias("c"), F.col("phrase").alias("p"))).alias("k"))
    return g.select("id", "category", F.size("k").alias("n"), F.array_join(F.transform(F.slice(F.array_sort("k"), 1, 15), lambda x: x["p"]), ", ").alias("keywords"))


def r11_resume_text(spark: SparkSession, d: str) -> DataFrame:
    """Sections of resumes as plain text."""
    r = heavy(spark, d, "documents", "doc_id", "text", "doc_type").where("doc_type = 'resume'").select("doc_id", extract.resume_sections(F.col("text")).alias("s"))
    return r.select("doc_id", F.explode("s").alias("section", "lines")).select("doc_id", "section", F.size("lines").alias("n_lines"))


def r11_resume_entries(spark: SparkSession, d: str, judge: hooks.Judge | None = None) -> DataFrame:
    """Details and numbers of entries of resumes as plain text; judge (X05) reads those in which no position is found."""
    r = heavy(spark, d, "documents", "doc_id", "text", "doc_type").where("doc_type = 'resume'").select("doc_id", resume_text.parsed_text(F.col("text")).alias("r"))
    sizes = [F.size(f"r.{c}").alias(f"n_{c}") for c in ("positions", "education", "certifications", "projects")]
    found = r.select("doc_id", "r.personal_info.name", "r.personal_info.email", F.length("r.summary").alias("n_summary"), *sizes)
    return hooks.judged(found, F.col("n_positions") == 0, judge)


def c05_domains(spark: SparkSession, d: str, judge: hooks.Judge | None = None) -> DataFrame:
    """C05; judge (X02) decides on texts that the votes leave open."""
    find = classify.domain_finder(classify.keyword_table(spark))
    c = _jobs(spark, d, "job_title", "job_description").select("id", find(F.col("job_title"), F.col("job_description")).alias("c")).select("id", "c.domain", F.round("c.confidence", 4).alias("confidence"), "c.best", "c.total")
    return hooks.judged(c, (F.col("domain") == "other") | (F.col("confidence") < 0.5), judge)


def c06_resume_domains(spark: SparkSession, d: str) -> DataFrame:
    """Domain of a resume by its titles and its summary, bullets and skills."""
    p = _masters(spark, d).withColumnRenamed("resume_id", "id")
    body = F.concat_ws(" ", "summary", F.array_join("bullets", " "), F.array_join("skills", " "))
    find = classify.domain_finder(classify.keyword_table(spark))
    return p.select("id", find(F.array_join("titles", " "), body)["domain"].alias("domain"))


def c07_document_kinds(spark: SparkSession, d: str, judge: hooks.Judge | None = None) -> DataFrame:
    """C07; judge (X03) decides what the signs leave inconclusive, else it ends as not_resume."""
    k = heavy(spark, d, "documents", "doc_id", "text").select("doc_id", classify.document_kind(F.col("text")).alias("k")).select("doc_id", "k.*")
    k = hooks.judged(k, F.col("verdict") == "inconclusive", judge)
    return k.withColumn("ends_as", F.when(F.col("verdict") == "inconclusive", "not_resume").otherwise(F.col("verdict")))


def c11_analysis(spark: SparkSession, d: str) -> DataFrame:
    """C11: new adverts with a text: skills, domain and score for the active resume; one reading of each text, no shuffle."""
    find, domain = extract.facts_finder(dictionary(spark, d)), classify.domain_finder(classify.keyword_table(spark))
    one = F.broadcast(_active_resume(spark, d).select("r"))
    text_ = F.col("job_description")
    j = heavy(spark, d, "jobs", "id", "job_title", "job_description", "status").where((F.col("status") == "new") & (F.length(F.trim(text_)) > 0))
    s = j.select("id", find(text_).alias("f"), domain(F.col("job_title"), text_)["domain"].alias("domain")).crossJoin(one)
    side = skills.advert_side(F.col("f.required"), F.col("f.preferred"), F.col("f.asked"), F.col("f.level"))
    score = text.bound(side, lambda a: skills.score_of(a, F.col("r"))["total"])
    return s.select("id", F.size("f.required").alias("n_required"), F.size("f.preferred").alias("n_preferred"), "domain", F.round(score, 1).alias("match_score"), F.lit("analyzed").alias("status"))


def c11b_flat_analysis(spark: SparkSession, d: str) -> DataFrame:
    """Keywords of the whole text, without sections: soft skills as preferred, all but them and education words as required."""
    find = extract.phrase_finder(keywords(spark, d))
    h = _jobs(spark, d, "job_description").select("id", find(F.col("job_description")).alias("h"))
    names = lambda test: F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter("h", test), lambda x: x["phrase"]))), "|")
    return h.select("id", names(lambda x: ~x["category"].isin(*extract.NO_SKILLS)).alias("required"), names(lambda x: x["category"] == "soft_skills").alias("preferred"))


# --- profile, checks, tailoring -----------------------------------------------------------------------------------------


def c08_style(spark: SparkSession, d: str) -> DataFrame:
    p = _masters(spark, d).withColumnRenamed("resume_id", "id")
    return p.select("id", resumes.style(F.col("bullets"), F.concat_ws(" ", "summary", F.array_join("bullets", " "))).alias("s")).select("id", "s.*")


def _section_names() -> Column:
    return F.transform(sets.none_as_empty(F.col("section_order")), lambda s: F.replace(F.lower(F.trim(s)), F.lit(" "), F.lit("_")))


def o10_section_order(spark: SparkSession, d: str) -> DataFrame:
    p = _masters(spark, d).withColumnRenamed("resume_id", "id")
    return p.select("id", _list(sets.in_order(text.words_array(resumes.SECTIONS), _section_names())).alias("sections"))


def _both(spark: SparkSession, d: str) -> DataFrame:
    """Tailored resumes (new, new_summary, new_skills) with their masters' columns and the advert's words."""
    t = resumes.parsed(heavy(spark, d, "tailored_resumes", "id", "job_id", F.col("master_resume_id").alias("resume_id"), F.col("tailored_content").alias("content")))
    t = t.select("id", "job_id", "resume_id", F.col("positions").alias("new"), F.col("summary").alias("new_summary"), _n_skills().alias("n_new_skills"))
    j = table(spark, d, "jobs").select(F.col("id").alias("job_id"), F.array_distinct(F.concat(sets.none_as_empty(F.col("required_skills")), sets.none_as_empty(F.col("preferred_skills")))).alias("words"))
    j = j.withColumn("words", F.filter("words", lambda w: w.isNotNull()))
    m = _masters(spark, d)
    m = m.select("resume_id", F.col("positions").alias("old"), "summary", "skills", "skill_groups", "projects", "bullets", "section_order", _n_skills().alias("n_skills"))
    return t.join(j, "job_id", "left").join(m, "resume_id")


def _n_skills() -> Column:
    """Skills of a list, or categories of a map."""
    return F.when(F.col("skill_groups").isNotNull(), F.size("skill_groups")).otherwise(F.size("skills"))


def _changed(both: DataFrame) -> DataFrame:
    """Bullets of master and tailored resumes side by side (J10): position and place as long as both have one."""
    pos = both.select("id", "words", F.posexplode(F.slice(F.arrays_zip("old", "new"), 1, F.least(F.size("old"), F.size("new")))).alias("position", "z"))
    z = F.arrays_zip(F.col("z.old.bullets").alias("original"), F.col("z.new.bullets").alias("modified"))
    return pos.select("id", "words", "position", F.posexplode(F.slice(z, 1, F.least(F.size("z.old.bullets"), F.size("z.new.bullets")))).alias("place", "b")).select("id", "words", "position", "place", "b.*")


def j10_bullet_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _changed(_both(spark, d)).select("id", "position", "place", (F.col("original") == F.col("modified")).alias("same"))


def c09_bullet_checks(spark: SparkSession, d: str) -> DataFrame:
    """Warnings of changed bullets, known skills from the advert."""
    b = _changed(_both(spark, d)).where("original <> modified")
    return b.select("id", "position", "place", resumes.check_bullet(F.col("original"), F.col("modified"), F.col("words")).alias("c")).select("id", "position", "place", _list(F.col("c.warnings")).alias("warnings"), "c.is_valid", "c.score")


def c10_resume_checks(spark: SparkSession, d: str) -> DataFrame:
    """A tailored resume checked: its changed bullets, its summary, and whether it lists fewer skills; valid if all is."""
    x = _both(spark, d)
    b = _changed(x).where("original <> modified").select("id", resumes.check_bullet(F.col("original"), F.col("modified"), F.col("words"))["is_valid"].alias("ok"))
    n = b.groupBy("id").agg(F.count("*").alias("n_checked"), F.count_if("ok").alias("n_valid"))
    some = (F.length("summary") > 0) & (F.length("new_summary") > 0) & (F.col("summary") != F.col("new_summary"))
    rest = x.select("id", F.when(some, resumes.check_summary(F.col("summary"), F.col("new_summary"), F.col("words"))["is_valid"]).alias("summary_valid"), (F.col("n_new_skills") < F.col("n_skills")).alias("fewer_skills"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rest.join(n, "id", "left").select(
        "id", zero("n_checked"), zero("n_valid"), "summary_valid", "fewer_skills",
        (F.coalesce(F.col("n_checked") == F.col("n_valid"), F.lit(True)) & F.coalesce("summary_valid", F.lit(True)) & ~F.col("fewer_skills")).alias("is_valid"))


def c15_tailoring(spark: SparkSession, d: str, rewrite: hooks.Judge | None = None) -> DataFrame:
    """Tailoring around the rewriting of texts, which is a hook.

    The stored tailored texts are the rewritten ones, unless rewrite makes others; one that loses a figure is rejected for the original.
    """
    x = hooks.rewritten(_both(spark, d), "new_summary", rewrite).withColumn("merged", resumes.merged_bullets(F.col("old"), F.col("new")))
    now = F.coalesce(F.nullif("new_summary", F.lit("")), "summary")
    x = x.withColumn("after", F.concat_ws(" ", now, F.array_join(F.transform("merged", lambda b: b["bullet"]), " "))).withColumn("before", F.concat_ws(" ", "summary", F.array_join(F.transform("merged", lambda b: b["original"]), " ")))
    x = x.withColumn("listed", resumes.tailored_skills(F.col("skills"), F.col("skill_groups"), F.col("words"), F.col("after")))
    names = F.map_keys("skill_groups")
    old_names = F.when(F.col("skill_groups").isNotNull(), F.array_join(names, " ")).otherwise(F.array_join("skills", " "))
    new_names = F.when(F.col("skill_groups").isNotNull(), F.array_join(F.map_keys(resumes.promoted_groups(F.col("skill_groups"), F.col("words"), F.col("after"))), " ")).otherwise(F.array_join("listed", " "))
    parts = ("personal_info", "professional_summary", "work_experience", "skills", "education", "certifications", "projects")
    x = x.withColumn("coverage_before", resumes.coverage(F.concat_ws(" ", "before", old_names), F.col("words"))).withColumn("coverage_after", resumes.coverage(F.concat_ws(" ", "after", new_names), F.col("words")))
    return x.select(
        "id", _list(F.slice("listed", 1, 5)).alias("first_skills"), F.size("listed").alias("n_skills"),
        _list(F.transform(resumes.best_projects(F.col("projects"), F.col("words")), lambda p: p["name"])).alias("projects"),
        _list(F.transform(resumes.best_bullets(F.col("bullets"), F.col("words"), 3), lambda i: i.cast("string"))).alias("bullet_places"),
        "coverage_before", "coverage_after", F.round(F.col("coverage_after") - F.col("coverage_before"), 1).alias("improvement"),
        F.size(F.filter("merged", lambda b: b["rejected"])).alias("n_rejected"), resumes.years_of_experience(F.col("old")).alias("years"),
        _list(sets.in_order(text.words_array(parts), _section_names())).alias("sections"),
    )


def o04_skill_order(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d, "required_skills").select("tailored_id", _list(sets.first_matching(F.col("resume_skills"), F.col("required_skills"))).alias("skills"))


def a24_years(spark: SparkSession, d: str) -> DataFrame:
    p = _masters(spark, d).withColumnRenamed("resume_id", "id")
    return p.select("id", resumes.years_of_experience(F.col("positions")).alias("years"))


# --- quotas, logs, scores -----------------------------------------------------------------------------------------------------


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def w03_offered_load(spark: SparkSession, d: str) -> DataFrame:
    return quota.offered_load(_events(spark, d).select("event_id", "event_type", "ts"), "event_type", "ts", 600).select("event_id", "n_window")


def w03_admissions(spark: SparkSession, d: str) -> DataFrame:
    return quota.admissions(_events(spark, d), "event_type", "ts", "event_id", 3, 3600.0)


def w04_daily_quota(spark: SparkSession, d: str) -> DataFrame:
    return quota.daily_quota(_events(spark, d).select("event_id", "event_type", "ts"), "event_type", "ts", "event_id", 5).select("event_id", "n_today", "admitted", "left")


def w05_quota_use(spark: SparkSession, d: str) -> DataFrame:
    """Per cent of a daily quota of 50 used, and whether a tenth or less is left."""
    n = _events(spark, d).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return n.select("event_type", F.col("day").cast("string").alias("day"), F.round(F.col("n") / 50 * 100, 1).alias("used_percentage"), (50 - F.col("n") <= 5).alias("low"))


def a13_capped_sum(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).groupBy("user_id").agg(F.round(F.least(F.sum("value"), F.lit(100.0)), 6).alias("score"))


def a14_score_share(spark: SparkSession, d: str) -> DataFrame:
    """Points of ten for each answer as a share, one decimal, and the advice it gives."""
    points = F.least(F.floor(F.abs("value")), F.lit(10))
    s = _events(spark, d).groupBy("user_id").agg(F.sum(points).alias("points"), F.count("*").alias("n"))
    share = F.round(F.col("points") / (F.col("n") * 10) * 100, 1)
    return s.select("user_id", share.alias("share"), F.when(share >= 85, "strong_yes").when(share >= 70, "yes").when(share >= 50, "maybe").otherwise("no").alias("advice"))


def a25_tokens(spark: SparkSession, d: str) -> DataFrame:
    """A token is four characters."""
    return table(spark, d, "chat_messages").groupBy("role").agg(F.sum(F.floor(F.length(F.coalesce("content", F.lit(""))) / 4)).alias("n_tokens"))


def d04_durations(spark: SparkSession, d: str) -> DataFrame:
    """Seconds from the first to the last message of a session, two decimals."""
    m = table(spark, d, "chat_messages").where("session_id is not null and created_at is not null")
    return m.groupBy("session_id").agg((F.round((F.unix_micros(F.max("created_at")) - F.unix_micros(F.min("created_at"))) / 1e4) / 100).alias("seconds"))


def log_lines(spark: SparkSession, d: str) -> DataFrame:
    """Log lines made of events."""
    kind = {"error": "ERROR 429 quota", "view": "WARNING slow", "purchase": "[scheduler] Job 'scrape_jobs' OK", "click": "[scrape_jobs] Starting"}
    what = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in kind.items()], F.concat((F.col("event_id") % 7).cast("string"), F.lit(" saved, "), (F.col("event_id") % 3).cast("string"), F.lit(" updated,")))
    return table(spark, d, "events").select(F.concat(F.col("event_id").cast("string"), F.lit(" "), what).alias("line"))


def c18_log_summary(spark: SparkSession, d: str) -> DataFrame:
    """What a log says in one pass of aggregates."""
    line = F.col("line")
    number = lambda p, has: F.sum(F.when(line.contains(has), F.coalesce(F.regexp_extract(line, p, 1).try_cast("int"), F.lit(0))).otherwise(0))
    return log_lines(spark, d).agg(
        F.count_if(line.contains("ERROR")).alias("errors"), F.count_if(line.contains("WARNING")).alias("warnings"),
        F.count_if(line.contains("ERROR") & (line.contains("429") | F.lower("line").contains("quota"))).alias("quota_errors"),
        number(r"(\d+) saved,", "saved").alias("saved"), number(r"(\d+) updated,", "updated").alias("updated"),
    )


def a16_task_counts(spark: SparkSession, d: str) -> DataFrame:
    """Starts and ends of tasks by name."""
    name = F.coalesce(F.nullif(F.regexp_extract("line", r"Job '(\w+)' OK", 1), F.lit("")), F.nullif(F.regexp_extract("line", r"\[(\w+)\] (?:Starting|Generating)", 1), F.lit("")))
    x = log_lines(spark, d).select(name.alias("task"), F.col("line").contains("' OK").alias("ok")).where("task is not null")
    return x.groupBy("task").agg(F.count_if(~F.col("ok")).alias("started"), F.count_if("ok").alias("ended"))


# --- upsert ---------------------------------------------------------------------------------------------------------------------


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Adverts scraped before midyear as they are stored (one an address), and postings that arrive: all the others, and those again."""
    j = table(spark, d, "jobs").withColumn("early", F.coalesce(F.col("date_scraped") < F.lit("2025-07-01").cast("timestamp"), F.lit(False)))
    stored = upsert.latest_by_key(j.where("early").select(*upsert.FIELDS), "application_url", "id").select(*upsert.FIELDS)
    again = F.when(F.col("early"), "").otherwise(F.col("salary_range"))
    return stored, j.withColumn("salary_range", again).select(*upsert.FIELDS)


def k01_upsert(spark: SparkSession, d: str) -> DataFrame:
    u = upsert.upsert_postings(*_halves(spark, d))
    return u.select("id", "application_url", "job_title", "salary_range", "status", "is_new")


def _batch(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The arriving postings of K01, every 17th without company."""
    stored, arriving = _halves(spark, d)
    arriving = arriving.withColumn("company_name", F.when(F.col("id") % 17 != 0, F.col("company_name")))
    return upsert.upsert_batch(stored, arriving, valid_posting())


def k02_batch(spark: SparkSession, d: str) -> DataFrame:
    return _batch(spark, d)[0].select("id", "application_url", "job_title", "status", "is_new")


def k02_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return _batch(spark, d)[1]


def u03_merged_skills(spark: SparkSession, d: str) -> DataFrame:
    return _jobs(spark, d, "required_skills", "preferred_skills").select("id", _list(sets.merged(F.col("required_skills"), F.col("preferred_skills"))).alias("skills"))


def k03_tailored(spark: SparkSession, d: str) -> DataFrame:
    """Rows sent twice, the later with another score."""
    t = table(spark, d, "tailored_resumes").select("id", "job_id", "master_resume_id", "match_score", "generated_at")
    again = t.select((F.col("id") + 1_000_000_000).alias("id"), "job_id", "master_resume_id", (F.col("match_score") / 2).alias("match_score"), "generated_at")
    return upsert.upsert_tailored(t.unionByName(again)).select("id", "job_id", "master_resume_id", "match_score")


def c13_archive(spark: SparkSession, d: str) -> DataFrame:
    return upsert.archived(table(spark, d, "jobs").select("id", "status", "date_scraped"), TODAY).select("id", "status")


def k11_ledger(spark: SparkSession, d: str) -> DataFrame:
    """yesterday's counts by role with today's messages added."""
    m = table(spark, d, "chat_messages").where("role is not null and created_at is not null").select(F.col("role").alias("model"), F.date_format("created_at", "yyyy-MM").alias("day"), F.col("content").alias("text"))
    kept = m.groupBy("model", "day").agg(F.lit(1).cast("long").alias("n_calls"), F.lit(10).cast("long").alias("n_tokens"))
    return upsert.ledger(kept, m)


def a27_best_phrase(spark: SparkSession, d: str) -> DataFrame:
    """The first advert with the best score of each title."""
    j = _jobs(spark, d, "job_title", "match_score").where("job_title is not null")
    return upsert.first_by_key(j, ["job_title"], F.desc_nulls_last("match_score"), "id").select("job_title", "id")


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and k[:1] in "acdjknoprtuw" and k[1:3].isdigit()}

from quern.plans.analytics_sql import SQL  # noqa: E402, F401
