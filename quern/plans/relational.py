"""Operational queries: scans, filters, projections, joins, aggregates, orders and set operations."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import order, sets, text
from quern.session import kept, table

#: The day that counts as today; a parameter, so results don't depend on the clock.
TODAY = datetime.date(2026, 1, 19)


def day(d: datetime.date = TODAY) -> Column:
    return F.lit(d)


def start_of(d: datetime.date = TODAY) -> Column:
    """Midnight UTC of the day."""
    return F.lit(d).cast("timestamp")


def micros(c: str) -> Column:
    return F.unix_micros(c)


# --- counts and reports -------------------------------------------------------------------------------------------------


def a01_table_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each table, counted from file metadata."""
    names = ("jobs", "master_resumes", "tailored_resumes", "applications")
    one = [table(spark, d, n).agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n in names]
    out = one[0]
    for x in one[1:]:
        out = out.unionByName(x)
    return out


def a02_dashboard_counts(spark: SparkSession, d: str) -> DataFrame:
    """Conditional counts in one pass."""
    j = table(spark, d, "jobs")
    return j.agg(
        F.count("*").alias("n_jobs"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("new", "analyzed", "applied", "archived")],
        F.count_if(F.col("match_score") >= 70).alias("n_strong"),
        F.count_if(F.col("domain").isNull()).alias("n_no_domain"),
    )


def a03_jobs_by_source(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").groupBy("source").agg(F.count("*").alias("n_jobs"))


def a04_jobs_by_status(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").groupBy("status").agg(F.count("*").alias("n_jobs"))


def a05_average_score(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the scores there are, one decimal, 0 without any."""
    return table(spark, d, "jobs").agg(F.coalesce(F.round(F.avg("match_score"), 1), F.lit(0.0)).alias("avg_score"))


def a06_score_range(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "tailored_resumes")
    return s.agg(F.round(F.avg("match_score"), 6).alias("avg_score"), F.min("match_score").alias("min_score"), F.max("match_score").alias("max_score"))


def a07_tailored_per_master(spark: SparkSession, d: str) -> DataFrame:
    """Children counted before the join, so a master with a third of all children is one row of it."""
    n = table(spark, d, "tailored_resumes").groupBy(F.col("master_resume_id").alias("id")).agg(F.count("*").alias("n"))
    return table(spark, d, "master_resumes").select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n_tailored"))


def a08_daily_report(spark: SparkSession, d: str) -> DataFrame:
    """What today brought."""
    new = table(spark, d, "jobs").agg(F.count_if(F.col("date_scraped") >= start_of()).alias("jobs_today"))
    tailored = table(spark, d, "tailored_resumes").agg(F.count_if(F.col("generated_at") >= start_of()).alias("resumes_today"))
    sent = table(spark, d, "applications").agg(F.count_if(F.col("application_date") >= day()).alias("applications_today"))
    return new.crossJoin(tailored).crossJoin(sent)  # one row each


def a08_newest(spark: SparkSession, d: str) -> DataFrame:
    """The five newest adverts."""
    return table(spark, d, "jobs").select("id", "job_title", "company_name", "date_scraped").orderBy(F.desc_nulls_last("date_scraped"), "id").limit(5).drop("date_scraped")


def a18_upsert_counters(spark: SparkSession, d: str) -> DataFrame:
    """Postings by what their arrival does: failed without a required field, saved if the address is new, else updated."""
    j = table(spark, d, "jobs")
    ok = valid_posting()
    w = Window.partitionBy("application_url").orderBy("id")
    good = j.where(ok).select("application_url", "id").withColumn("n", F.row_number().over(w)).select(F.when(F.col("n") == 1, "saved").otherwise("updated").alias("outcome"))
    bad = j.where(~ok).select(F.lit("failed").alias("outcome"))
    return good.unionByName(bad).groupBy("outcome").agg(F.count("*").alias("n_postings"))


def c16_dashboard(spark: SparkSession, d: str) -> DataFrame:
    """Status and source counts and the mean score from one scan."""
    j = table(spark, d, "jobs")
    return j.groupBy("source").agg(
        F.count("*").alias("n_jobs"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("new", "analyzed", "applied", "archived")],
        F.coalesce(F.round(F.avg("match_score"), 1), F.lit(0.0)).alias("avg_score"),
    )


# --- filters and projections ----------------------------------------------------------------------------------------------


def p01_by_status_and_source(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").where((F.col("status") == "analyzed") & (F.col("source") == F.lower(F.lit("HireWell")))).select("id", "job_title")


def p02_search(spark: SparkSession, d: str) -> DataFrame:
    """% and _ of the search text are wildcards."""
    like = "%data_engineer%"
    return table(spark, d, "jobs").where(F.col("job_title").ilike(like) | F.col("company_name").ilike(like)).select("id", "job_title", "company_name")


def p03_before_cutoff(spark: SparkSession, d: str) -> DataFrame:
    """Scraped over 30 days before today."""
    cutoff = F.date_sub(day(), 30).cast("timestamp")
    return table(spark, d, "jobs").where(F.col("date_scraped") < cutoff).groupBy("status").agg(F.count("*").alias("n_old"))


def p04_not_in(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").where(~F.col("status").isin("applied", "archived")).select("id", "status")


def p05_in_runtime_list(spark: SparkSession, d: str) -> DataFrame:
    """Adverts whose id another table names, as a semi join."""
    ids = table(spark, d, "applications").where(F.col("status") == "interviewing").select(F.col("job_id").alias("id"))
    return table(spark, d, "jobs").join(ids, "id", "left_semi").select("id", "company_name")


def p06_null_and_true(spark: SparkSession, d: str) -> DataFrame:
    active = table(spark, d, "master_resumes").where("is_active").groupBy(F.coalesce("domain", F.lit("(none)")).alias("domain")).agg(F.count("*").alias("n_active"))
    return active


def p08_job_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows as an interface shows them."""
    return table(spark, d, "jobs").select(
        "id", F.coalesce(F.nullif("location", F.lit("")), F.lit("Remote")).alias("location"),
        F.date_format("date_scraped", "MMM dd, yyyy").alias("scraped_on"),
        F.coalesce(F.size("required_skills"), F.lit(0)).alias("n_required"),
        F.coalesce(F.size("preferred_skills"), F.lit(0)).alias("n_preferred"),
    )


def p09_as_records(spark: SparkSession, d: str) -> DataFrame:
    """Rows with times as ISO text."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return table(spark, d, "applications").select("id", "job_id", "status", iso("created_at").alias("created_at"), iso("updated_at").alias("updated_at"), F.col("application_date").cast("string").alias("application_date"))


#: Fields that a posting needs.
NEEDED = ("job_title", "company_name", "job_description", "application_url")


def blank_fields(fields: tuple[str, ...] = NEEDED) -> Column:
    """P10: names of the fields that are null or blank, in order."""
    return F.filter(F.array(*[F.when(F.coalesce(F.length(text.stripped(F.col(f))), F.lit(0)) == 0, F.lit(f)) for f in fields]), lambda x: x.isNotNull())


def valid_posting() -> Column:
    """P10: the fields a posting needs aren't blank."""
    return F.size(blank_fields()) == 0


def p10_required_fields(spark: SparkSession, d: str) -> DataFrame:
    """P10: adverts that aren't complete, place and pay demanded as well, with what they lack."""
    blank = blank_fields((*NEEDED, "location", "salary_range"))
    return table(spark, d, "jobs").select("id", F.array_join(blank, "|").alias("blank")).where("blank <> ''")


def p12_over_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Score at least 60; an absent score counts 0."""
    return table(spark, d, "jobs").where(F.coalesce("match_score", F.lit(0.0)) >= 60).select("id", "match_score")


# --- joins ------------------------------------------------------------------------------------------------------------------


def j01_best_with_job(spark: SparkSession, d: str) -> DataFrame:
    """The five best tailored resumes with their advert; the limit comes before the join."""
    best = table(spark, d, "tailored_resumes").select(F.col("id").alias("tailored_id"), "job_id", "match_score").orderBy(F.desc_nulls_last("match_score"), "tailored_id").limit(5)
    return best.join(table(spark, d, "jobs").select(F.col("id").alias("job_id"), "job_title", "company_name"), "job_id", "left")


def _score_by_job(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tailored_resumes").select("id", "job_id", "match_score")
    return t.groupBy("job_id").agg(F.max_by("match_score", "id").alias("tailored_score"))


def j02_jobs_with_score(spark: SparkSession, d: str) -> DataFrame:
    """One score an advert, of its last tailored resume."""
    s = _score_by_job(spark, d).withColumn("has_resume", F.lit(True))
    j = table(spark, d, "jobs").select(F.col("id").alias("job_id"), "status")
    return j.join(s, "job_id", "left").withColumn("has_resume", F.coalesce("has_resume", F.lit(False)))


def j03_application_titles(spark: SparkSession, d: str) -> DataFrame:
    """Applications with the advert's title, a dash without one."""
    j = table(spark, d, "jobs").select(F.col("id").alias("job_id"), "job_title")
    return table(spark, d, "applications").select("id", "job_id").join(j, "job_id", "left").select("id", F.coalesce("job_title", F.lit("—")).alias("job_title"))


def j04_untailored(spark: SparkSession, d: str) -> DataFrame:
    """Analysed adverts without a tailored resume."""
    t = table(spark, d, "tailored_resumes").select(F.col("job_id").alias("id"))
    return table(spark, d, "jobs").where(F.col("status") == "analyzed").join(t, "id", "left_anti").select("id", "match_score")


def resume_for_domain(masters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The latest own resume of each domain, and the active one of least id; small by construction (one a domain, one)."""
    own = masters.where("not is_sample and domain is not null").groupBy("domain").agg(F.max("id").alias("domain_resume"))
    active = masters.where("is_active").agg(F.min("id").alias("active_resume"))
    return own, active


def j05_resume_for_job(spark: SparkSession, d: str) -> DataFrame:
    """The resume of the advert's domain, else the active one."""
    own, active = resume_for_domain(table(spark, d, "master_resumes").select("id", "domain", "is_sample", "is_active"))
    j = table(spark, d, "jobs").select(F.col("id").alias("job_id"), "domain")
    return j.join(own, "domain", "left").crossJoin(F.broadcast(active)).select("job_id", F.coalesce("domain_resume", "active_resume").alias("resume_id"))


def j07_job_children(spark: SparkSession, d: str) -> DataFrame:
    """Advert, its tailored resumes and their applications, counted on each level before joining."""
    a = table(spark, d, "applications").groupBy(F.col("tailored_resume_id").alias("tailored_id")).agg(F.count("*").alias("n"))
    t = table(spark, d, "tailored_resumes").select(F.col("id").alias("tailored_id"), "job_id").join(a, "tailored_id", "left")
    n = t.groupBy("job_id").agg(F.count("*").alias("n_tailored"), F.sum(F.coalesce("n", F.lit(0))).alias("n_applications"))
    return table(spark, d, "jobs").select(F.col("id").alias("job_id")).join(n, "job_id", "left").select("job_id", F.coalesce("n_tailored", F.lit(0)).alias("n_tailored"), F.coalesce("n_applications", F.lit(0)).alias("n_applications"))


def j08_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose parent is missing."""
    j, m, t = (table(spark, d, n).select("id") for n in ("jobs", "master_resumes", "tailored_resumes"))
    tr, ap, cm = (table(spark, d, n) for n in ("tailored_resumes", "applications", "chat_messages"))
    cs = table(spark, d, "chat_sessions").select("id")

    def missing(child: DataFrame, key: str, parent: DataFrame, name: str) -> DataFrame:
        lost = child.where(F.col(key).isNotNull()).select(F.col(key).alias("id")).join(parent, "id", "left_anti")
        return lost.agg(F.count("*").alias("n_orphans")).select(F.lit(name).alias("link"), "n_orphans")

    parts = [
        missing(tr, "job_id", j, "tailored.job"), missing(tr, "master_resume_id", m, "tailored.master"), missing(ap, "job_id", j, "application.job"),
        missing(ap, "tailored_resume_id", t, "application.tailored"), missing(cm, "session_id", cs, "message.session"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def j09_session_titles(spark: SparkSession, d: str) -> DataFrame:
    """Messages of each session beside its title and its claimed count."""
    n = table(spark, d, "chat_messages").where("session_id is not null").groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("n_messages"))
    s = table(spark, d, "chat_sessions").select("id", F.coalesce("title", F.lit("New chat")).alias("title"), "message_count")
    return s.join(n, "id", "left").withColumn("n_messages", F.coalesce("n_messages", F.lit(0)))


# --- windows and order --------------------------------------------------------------------------------------------------


def w01_best_tailored(spark: SparkSession, d: str) -> DataFrame:
    """The best tailored resume of each advert as a mergeable aggregate, ties by the smaller id."""
    t = table(spark, d, "tailored_resumes").select("id", "job_id", "match_score")
    best = F.max_by("id", F.struct(F.coalesce("match_score", F.lit(-1.0)), -F.col("id")))
    return t.groupBy("job_id").agg(best.alias("tailored_id"))


def w02_latest_resume(spark: SparkSession, d: str) -> DataFrame:
    """The latest own resume by domain."""
    m = table(spark, d, "master_resumes").where("not is_sample")
    return m.groupBy("domain").agg(F.max_by("id", F.struct("created_at", "id")).alias("resume_id"))


def w06_next_message(spark: SparkSession, d: str) -> DataFrame:
    """Each message with the next and the previous one of its session: equi-joins on the number, however long a session is."""
    m = table(spark, d, "chat_messages").where("session_id is not null and created_at is not null").select("id", "session_id", F.unix_micros("created_at").alias("t"))
    n = kept(order.numbered(m, "session_id", "t", "id").select("session_id", "n", "id"), "numbered")
    other = lambda name, step: n.select("session_id", (F.col("n") + step).cast("int").alias("n"), F.col("id").alias(name))
    return n.join(other("next_id", -1), ["session_id", "n"], "left").join(other("previous_id", 1), ["session_id", "n"], "left").select("id", "next_id", "previous_id")


def w07_capped_configs(spark: SparkSession, d: str) -> DataFrame:
    """Sources in order until the running total of new adverts reaches 500; the one that reaches it still runs."""
    n = table(spark, d, "jobs").where(F.col("status") == "new").groupBy("source").agg(F.count("*").alias("n_new"))
    w = Window.partitionBy(F.lit(1)).orderBy("source").rowsBetween(Window.unboundedPreceding, -1)  # one row a source
    return n.withColumn("before", F.coalesce(F.sum("n_new").over(w), F.lit(0))).where("before < 500")


def w08_idle_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Visits of a user end after 30 idle minutes; a user's time is cut into slices that are worked on apart."""
    gap = 1800 * 1_000_000
    e = table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    w = Window.partitionBy("user_id", "_slice").orderBy("t", "event_id")
    last = order.time_slices(e, F.col("t"), gap, 48 * gap).withColumn("last", F.lag("t").over(w)).where("_own")
    return last.groupBy("user_id").agg(F.count_if(F.col("last").isNull() | (F.col("t") - F.col("last") > gap)).alias("n_visits"), F.count("*").alias("n_events"))


def w09_history(spark: SparkSession, d: str) -> DataFrame:
    """User and assistant messages of a session in order."""
    m = table(spark, d, "chat_messages").where("session_id is not null").where(F.col("role").isin("user", "assistant")).select("session_id", "id", "role", F.unix_micros("created_at").alias("t"))
    return order.numbered(m, "session_id", "t", "id", name="place").select("session_id", "id", "place", "role")


def o01_recent(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").select("id", "date_scraped", "source").orderBy(F.desc_nulls_last("date_scraped"), "id").limit(20).select("id", "source")


def o02_page(spark: SparkSession, d: str) -> DataFrame:
    """The third page of 50."""
    return table(spark, d, "jobs").where(F.col("status") == "new").select("id", "date_scraped").orderBy(F.desc_nulls_last("date_scraped"), "id").offset(100).limit(50).select("id")


def o03_by_score(spark: SparkSession, d: str) -> DataFrame:
    """Best scores first, absent ones last."""
    return table(spark, d, "jobs").select("id", "match_score").orderBy(F.desc_nulls_last("match_score"), "id").limit(300)


def o05_trusted_sources(spark: SparkSession, d: str) -> DataFrame:
    """Four adverts a company by the rank of their source, unknown ones last."""
    trusted = F.array(*[F.lit(s) for s in ("jobharbor", "careerloom", "hirewell")])
    place = F.array_position(trusted, F.coalesce("source", F.lit("")))
    w = Window.partitionBy("company_name").orderBy("rank", "id")
    j = table(spark, d, "jobs").where("company_name is not null").select("id", "company_name", F.when(place > 0, place).otherwise(999).cast("int").alias("rank"))
    return j.withColumn("n", F.row_number().over(w)).where("n <= 4").drop("n")


# --- sets ---------------------------------------------------------------------------------------------------------------------


def _low(c: str) -> Column:
    return F.transform(F.filter(sets.none_as_empty(F.col(c)), lambda s: s.isNotNull()), F.lower)


def _text(a: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(a)), "|")


def u01_skill_sets(spark: SparkSession, d: str) -> DataFrame:
    """What both lists of an advert hold, and what only one does."""
    r, p = _low("required_skills"), _low("preferred_skills")
    return table(spark, d, "jobs").select("id", _text(F.array_intersect(r, p)).alias("both_lists"), _text(F.array_except(r, p)).alias("required_only"), _text(F.array_except(p, r)).alias("preferred_only"))


def u02_domain_skills(spark: SparkSession, d: str) -> DataFrame:
    """Number of distinct skills a domain asks for."""
    s = table(spark, d, "jobs").select("domain", F.explode(F.array_union(_low("required_skills"), _low("preferred_skills"))).alias("skill"))
    return s.distinct().groupBy("domain").agg(F.count("*").alias("n_skills"))


def u04_preferred_only(spark: SparkSession, d: str) -> DataFrame:
    """Preferred skills that aren't required, in order."""
    p = F.array_except(sets.none_as_empty(F.col("preferred_skills")), sets.none_as_empty(F.col("required_skills")))
    return table(spark, d, "jobs").select("id", F.array_join(p, "|").alias("preferred_only"))


def u07_searches(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of title and place of all sources of searches, first of each (any case) by priority, then id."""
    j = table(spark, d, "jobs").where("job_title is not null and location is not null").select("id", "job_title", "location", F.when(F.col("status") == "applied", 0).otherwise(1).alias("priority"))
    key = [F.lower("job_title").alias("title_key"), F.lower("location").alias("place_key")]
    return j.groupBy(*key).agg(F.min_by("id", F.struct("priority", "id")).alias("id"))


def a26_distinct_titles(spark: SparkSession, d: str) -> DataFrame:
    """The first advert of each title."""
    return table(spark, d, "jobs").groupBy("job_title").agg(F.min("id").alias("first_id"))


def k04_activation(spark: SparkSession, d: str) -> DataFrame:
    """The latest own resume active, all others not."""
    m = table(spark, d, "master_resumes")
    last = m.where("not is_sample").agg(F.max_by("id", F.struct("created_at", "id")).alias("last"))
    return m.crossJoin(F.broadcast(last)).select("id", (F.col("id") == F.col("last")).alias("is_active"))


def k08_notified(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 adverts, by id, with a score of at least 60."""
    return p12_over_threshold(spark, d).orderBy("id").limit(20)


def c14_tagged(spark: SparkSession, d: str) -> DataFrame:
    """C14: after a search for a domain's adverts, those that it found and that have no domain get it."""
    searched = F.coalesce(*[F.when(F.col("source") == s, F.lit(x)) for s, x in SEARCHED.items()])
    return table(spark, d, "jobs").select("id", F.coalesce("domain", searched).alias("domain"))


#: Domain of the search that a source was searched with.
SEARCHED = {"jobharbor": "tech", "hirewell": "data", "tasknest": "operations"}


def c20_search_configs(spark: SparkSession, d: str) -> DataFrame:
    """Searches for the domains of active resumes: those of the trade at the preferred place (adverts applied for stand for
    them), then one's own (new adverts), the first of each pair of keywords and place in any case."""
    active = table(spark, d, "master_resumes").where("is_active and domain is not null").select("domain").distinct()
    j = table(spark, d, "jobs").where("job_title is not null and status in ('applied', 'new')")
    trade = F.col("status") == "applied"
    c = j.select("id", "domain", F.lower("job_title").alias("keywords"), F.when(trade, F.lit("remote")).otherwise(F.lower(F.coalesce("location", F.lit("")))).alias("place"), F.when(trade, 0).otherwise(1).alias("rank"))
    c = c.join(active, "domain", "left_semi")
    return c.groupBy("keywords", "place").agg(F.min_by(F.struct("id", "domain"), F.struct("rank", "id")).alias("c")).select("keywords", "place", "c.id", "c.domain")


def k10_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Applications after the adverts of one source are deleted: theirs go, others lose a deleted tailored resume."""
    gone = table(spark, d, "jobs").where(F.col("source") == "tasknest").select("id")
    lost = table(spark, d, "tailored_resumes").join(gone.withColumnRenamed("id", "job_id"), "job_id", "left_semi").select(F.col("id").alias("tailored_resume_id"), F.lit(True).alias("lost"))
    a = table(spark, d, "applications").select("id", "job_id", "tailored_resume_id").join(gone.withColumnRenamed("id", "job_id"), "job_id", "left_anti")
    return a.join(lost, "tailored_resume_id", "left").select("id", "job_id", F.when(F.col("lost").isNull(), F.col("tailored_resume_id")).alias("tailored_resume_id"))


QUERIES = {k: v for k, v in list(globals().items()) if k[:1] in "acjkopuw" and k[1:3].isdigit() and callable(v)}

_OK = " AND ".join(f"coalesce(length(regexp_replace({f}, '^\\s+|\\s+$', '', 'g')), 0) > 0" for f in ("job_title", "company_name", "job_description", "application_url"))
_STATUS = ", ".join(f"count(*) FILTER (status = '{s}') AS n_{s}" for s in ("new", "analyzed", "applied", "archived"))
_MIDNIGHT = "TIMESTAMPTZ '2026-01-19 00:00:00+00'"
_LOW = "list_transform(list_filter(coalesce({c}, []::VARCHAR[]), lambda s: s IS NOT NULL), lambda s: lower(s))"
_R, _P = _LOW.format(c="required_skills"), _LOW.format(c="preferred_skills")
_JOIN = "coalesce(array_to_string(list_sort(list_distinct({a})), '|'), '')"

SQL = {
    "a01_table_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in ("jobs", "master_resumes", "tailored_resumes", "applications")),
    "a02_dashboard_counts": f"SELECT count(*) AS n_jobs, {_STATUS}, count(*) FILTER (match_score >= 70) AS n_strong, count(*) FILTER (domain IS NULL) AS n_no_domain FROM jobs",
    "a03_jobs_by_source": "SELECT source, count(*) AS n_jobs FROM jobs GROUP BY source",
    "a04_jobs_by_status": "SELECT status, count(*) AS n_jobs FROM jobs GROUP BY status",
    "a05_average_score": "SELECT coalesce(round(avg(match_score), 1), 0.0) AS avg_score FROM jobs",
    "a06_score_range": "SELECT round(avg(match_score), 6) AS avg_score, min(match_score) AS min_score, max(match_score) AS max_score FROM tailored_resumes",
    "a07_tailored_per_master": "SELECT m.id, count(t.id) AS n_tailored FROM master_resumes m LEFT JOIN tailored_resumes t ON t.master_resume_id = m.id GROUP BY m.id",
    "a08_daily_report": f"""SELECT (SELECT count(*) FROM jobs WHERE date_scraped >= {_MIDNIGHT}) AS jobs_today,
        (SELECT count(*) FROM tailored_resumes WHERE generated_at >= {_MIDNIGHT}) AS resumes_today,
        (SELECT count(*) FROM applications WHERE application_date >= DATE '2026-01-19') AS applications_today""",
    "a08_newest": "SELECT id, job_title, company_name FROM jobs ORDER BY date_scraped DESC NULLS LAST, id LIMIT 5",
    "a18_upsert_counters": f"""WITH j AS (SELECT id, application_url, ({_OK}) AS ok FROM jobs)
        SELECT outcome, count(*) AS n_postings FROM (SELECT CASE WHEN NOT ok THEN 'failed'
          WHEN row_number() OVER (PARTITION BY ok, application_url ORDER BY id) = 1 THEN 'saved' ELSE 'updated' END AS outcome FROM j) GROUP BY outcome""",
    "c16_dashboard": f"SELECT source, count(*) AS n_jobs, {_STATUS}, coalesce(round(avg(match_score), 1), 0.0) AS avg_score FROM jobs GROUP BY source",
    "p01_by_status_and_source": "SELECT id, job_title FROM jobs WHERE status = 'analyzed' AND source = 'hirewell'",
    "p02_search": "SELECT id, job_title, company_name FROM jobs WHERE job_title ILIKE '%data_engineer%' OR company_name ILIKE '%data_engineer%'",
    "p03_before_cutoff": "SELECT status, count(*) AS n_old FROM jobs WHERE date_scraped < TIMESTAMPTZ '2025-12-20 00:00:00+00' GROUP BY status",
    "p04_not_in": "SELECT id, status FROM jobs WHERE status NOT IN ('applied', 'archived')",
    "p05_in_runtime_list": "SELECT id, company_name FROM jobs WHERE id IN (SELECT job_id FROM applications WHERE status = 'interviewing')",
    "p06_null_and_true": "SELECT coalesce(domain, '(none)') AS domain, count(*) AS n_active FROM master_resumes WHERE is_active GROUP BY 1",
    "p08_job_rows": """SELECT id, coalesce(nullif(location, ''), 'Remote') AS location,
        strftime(make_timestamp(epoch_us(date_scraped)), '%b %d, %Y') AS scraped_on,
        coalesce(len(required_skills), 0)::INT AS n_required, coalesce(len(preferred_skills), 0)::INT AS n_preferred FROM jobs""",
    "p09_as_records": """SELECT id, job_id, status, strftime(make_timestamp(epoch_us(created_at)), '%Y-%m-%dT%H:%M:%S.%f') AS created_at,
        strftime(make_timestamp(epoch_us(updated_at)), '%Y-%m-%dT%H:%M:%S.%f') AS updated_at, application_date::VARCHAR AS application_date FROM applications""",
    "p10_required_fields": f"""SELECT * FROM (SELECT id, array_to_string(list_filter([{', '.join(f"CASE WHEN coalesce(length(regexp_replace({f}, '^\\s+|\\s+$', '', 'g')), 0) = 0 THEN '{f}' END" for f in (*NEEDED, 'location', 'salary_range'))}],
        lambda x: x IS NOT NULL), '|') AS blank FROM jobs) WHERE blank <> ''""",
    "p12_over_threshold": "SELECT id, match_score FROM jobs WHERE coalesce(match_score, 0) >= 60",
    "j01_best_with_job": """WITH b AS (SELECT id AS tailored_id, job_id, match_score FROM tailored_resumes ORDER BY match_score DESC NULLS LAST, id LIMIT 5)
        SELECT b.*, j.job_title, j.company_name FROM b LEFT JOIN jobs j ON j.id = b.job_id""",
    "j02_jobs_with_score": """SELECT j.id AS job_id, j.status, t.tailored_score, t.job_id IS NOT NULL AS has_resume FROM jobs j
        LEFT JOIN (SELECT job_id, arg_max_null(match_score, id) AS tailored_score FROM tailored_resumes GROUP BY job_id) t ON t.job_id = j.id""",
    "j03_application_titles": "SELECT a.id, coalesce(j.job_title, '—') AS job_title FROM applications a LEFT JOIN jobs j ON j.id = a.job_id",
    "j04_untailored": "SELECT id, match_score FROM jobs j WHERE status = 'analyzed' AND NOT EXISTS (SELECT 1 FROM tailored_resumes t WHERE t.job_id = j.id)",
    "j05_resume_for_job": """WITH own AS (SELECT domain, max(id) AS r FROM master_resumes WHERE NOT is_sample AND domain IS NOT NULL GROUP BY domain)
        SELECT j.id AS job_id, coalesce(own.r, (SELECT min(id) FROM master_resumes WHERE is_active)) AS resume_id FROM jobs j LEFT JOIN own USING (domain)""",
    "j07_job_children": """SELECT j.id AS job_id, count(DISTINCT t.id) AS n_tailored, count(a.id) AS n_applications FROM jobs j
        LEFT JOIN tailored_resumes t ON t.job_id = j.id LEFT JOIN applications a ON a.tailored_resume_id = t.id GROUP BY j.id""",
    "j08_orphans": " UNION ALL ".join(
        f"SELECT '{n}' AS link, count(*) AS n_orphans FROM {c} x WHERE {k} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} y WHERE y.id = x.{k})"
        for n, c, k, p in (
            ("tailored.job", "tailored_resumes", "job_id", "jobs"), ("tailored.master", "tailored_resumes", "master_resume_id", "master_resumes"),
            ("application.job", "applications", "job_id", "jobs"), ("application.tailored", "applications", "tailored_resume_id", "tailored_resumes"),
            ("message.session", "chat_messages", "session_id", "chat_sessions"),
        )
    ),
    "j09_session_titles": """SELECT s.id, coalesce(s.title, 'New chat') AS title, s.message_count, count(m.id) AS n_messages
        FROM chat_sessions s LEFT JOIN chat_messages m ON m.session_id = s.id GROUP BY ALL""",
    "w01_best_tailored": "SELECT job_id, id AS tailored_id FROM tailored_resumes QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY match_score DESC NULLS LAST, id) = 1",
    "w02_latest_resume": "SELECT domain, id AS resume_id FROM master_resumes WHERE NOT is_sample QUALIFY row_number() OVER (PARTITION BY domain ORDER BY created_at DESC, id DESC) = 1",
    "w06_next_message": """SELECT id, lead(id) OVER w AS next_id, lag(id) OVER w AS previous_id FROM chat_messages
        WHERE session_id IS NOT NULL AND created_at IS NOT NULL WINDOW w AS (PARTITION BY session_id ORDER BY created_at, id)""",
    "w07_capped_configs": """SELECT * FROM (SELECT source, n_new, coalesce(sum(n_new) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
        FROM (SELECT source, count(*) AS n_new FROM jobs WHERE status = 'new' GROUP BY source)) WHERE before < 500""",
    "w08_idle_sessions": """SELECT user_id, sum(new)::BIGINT AS n_visits, count(*) AS n_events FROM (SELECT user_id,
        CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 1800000000 THEN 0 ELSE 1 END AS new FROM events) GROUP BY user_id""",
    "w09_history": """SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY created_at NULLS FIRST, id)::INT AS place, role
        FROM chat_messages WHERE session_id IS NOT NULL AND role IN ('user', 'assistant')""",
    "o01_recent": "SELECT id, source FROM jobs ORDER BY date_scraped DESC NULLS LAST, id LIMIT 20",
    "o02_page": "SELECT id FROM jobs WHERE status = 'new' ORDER BY date_scraped DESC NULLS LAST, id LIMIT 50 OFFSET 100",
    "o03_by_score": "SELECT id, match_score FROM jobs ORDER BY match_score DESC NULLS LAST, id LIMIT 300",
    "o05_trusted_sources": """SELECT id, company_name, rank FROM (SELECT id, company_name,
        CASE source WHEN 'jobharbor' THEN 1 WHEN 'careerloom' THEN 2 WHEN 'hirewell' THEN 3 ELSE 999 END AS rank FROM jobs WHERE company_name IS NOT NULL)
        QUALIFY row_number() OVER (PARTITION BY company_name ORDER BY rank, id) <= 4""",
    "u01_skill_sets": f"""SELECT id, {_JOIN.format(a=f'list_intersect({_R}, {_P})')} AS both_lists,
        {_JOIN.format(a=f'list_filter({_R}, lambda s: NOT list_contains({_P}, s))')} AS required_only,
        {_JOIN.format(a=f'list_filter({_P}, lambda s: NOT list_contains({_R}, s))')} AS preferred_only FROM jobs""",
    "u02_domain_skills": f"SELECT domain, count(DISTINCT skill) AS n_skills FROM (SELECT domain, unnest(list_concat({_R}, {_P})) AS skill FROM jobs) GROUP BY domain",
    "u04_preferred_only": """SELECT id, coalesce(array_to_string(list_filter(p, lambda s, i: NOT list_contains(r, s) AND list_position(p, s) = i), '|'), '') AS preferred_only
        FROM (SELECT id, coalesce(preferred_skills, []::VARCHAR[]) AS p, coalesce(required_skills, []::VARCHAR[]) AS r FROM jobs)""",
    "u07_searches": """SELECT lower(job_title) AS title_key, lower(location) AS place_key, id FROM jobs WHERE job_title IS NOT NULL AND location IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY lower(job_title), lower(location) ORDER BY (status <> 'applied'), id) = 1""",
    "a26_distinct_titles": "SELECT job_title, min(id) AS first_id FROM jobs GROUP BY job_title",
    "k04_activation": "SELECT id, id = (SELECT id FROM master_resumes WHERE NOT is_sample ORDER BY created_at DESC, id DESC LIMIT 1) AS is_active FROM master_resumes",
    "k08_notified": "SELECT id, match_score FROM jobs WHERE coalesce(match_score, 0) >= 60 ORDER BY id LIMIT 20",
    "c14_tagged": "SELECT id, coalesce(domain, CASE source " + " ".join(f"WHEN '{s}' THEN '{x}'" for s, x in SEARCHED.items()) + " END) AS domain FROM jobs",
    "c20_search_configs": """SELECT lower(job_title) AS keywords, CASE WHEN status = 'applied' THEN 'remote' ELSE lower(coalesce(location, '')) END AS place, id, domain FROM jobs
        WHERE job_title IS NOT NULL AND status IN ('applied', 'new') AND domain IN (SELECT domain FROM master_resumes WHERE is_active)
        QUALIFY row_number() OVER (PARTITION BY lower(job_title), CASE WHEN status = 'applied' THEN 'remote' ELSE lower(coalesce(location, '')) END ORDER BY status <> 'applied', id) = 1""",
    "k10_cascade": """WITH gone AS (SELECT id FROM jobs WHERE source = 'tasknest')
        SELECT a.id, a.job_id, t.id AS tailored_resume_id FROM applications a
        LEFT JOIN tailored_resumes t ON t.id = a.tailored_resume_id AND t.job_id NOT IN (SELECT id FROM gone) WHERE a.job_id NOT IN (SELECT id FROM gone)""",
}
