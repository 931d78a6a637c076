"""Queries over sources, sinks and streams: pages made of adverts, exports read back, replays."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import clean_text
from quern.operators import extract
from quern.plans.analytics import dictionary
from quern.plans.extraction_sql import SKILL_NAMES, phrases
from quern.session import shared_folder, table
from quern.sources import readers, sinks
from quern.streaming import streams


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of adverts: every advert of one source as JSON-LD, the others as marked-up text."""
    j = table(spark, d, "jobs").where("job_description is not null").select("id", "job_title", "company_name", "job_description", "date_posted", "source", "location")
    ld = F.to_json(F.struct(
        F.lit("JobPosting").alias("@type"), F.col("job_title").alias("title"), F.struct(F.col("company_name").alias("name")).alias("hiringOrganization"),
        F.col("job_description").alias("description"), F.concat(F.col("date_posted").cast("string"), F.lit("T08:00:00Z")).alias("datePosted"),
        F.struct(F.struct(F.lit("Town").alias("addressLocality"), F.lit("ST").alias("addressRegion")).alias("address")).alias("jobLocation"),
        F.struct(F.lit("EUR").alias("currency"), F.struct((F.col("id") * 10).alias("minValue"), (F.col("id") * 20).alias("maxValue")).alias("value")).alias("baseSalary"),
    ))
    safe = lambda c: F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    script = F.concat(F.lit('<html><script type="application/ld+json">'), F.replace(ld, F.lit("</"), F.lit("<\\/")), F.lit("</script><h1>x</h1></html>"))
    marked = F.concat(F.lit('<html><h1 class="t">'), safe("job_title"), F.lit('</h1><p class="c">'), safe("company_name"), F.lit('</p><div class="d">'), safe("job_description"), F.lit("</div></html>"))
    url = F.concat(F.lit("https://"), "source", F.lit(".example/"), F.col("id").cast("string"), F.lit("?from=list"))
    return j.select("id", url.alias("url"), F.when(F.col("source") == "jobharbor", script).otherwise(marked).alias("html"))


SELECTORS = {"title": (".t", "h1"), "company": (".c",), "description": (".d",)}


def s08_postings_of_pages(spark: SparkSession, d: str) -> DataFrame:
    """S07 to S13, R10."""
    p = readers.postings_of_pages(pages(spark, d), SELECTORS)
    return p.select("application_url", "title", "company", F.md5(clean_text(F.col("description"))).alias("description_md5"), "location", "posted", "salary")


def s04_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """The reference list of skills written as a dictionary file and read back."""
    rows = dictionary(spark, d).limit(extract.MOST_PHRASES).collect()  # the size of any dictionary file
    at = f"{shared_folder(spark)}/dictionary-{uuid.uuid4().hex}"
    lines = "\n".join(["# a dictionary", "skill:", "  more:", *(f"    - {r.phrase}" for r in rows)])
    spark.createDataFrame([(lines,)], "value string").coalesce(1).write.text(at)
    return readers.read_dictionary(spark, at)


def s06_uploads(spark: SparkSession, d: str) -> DataFrame:
    """Resumes uploaded again under new ids, with the sections they lack; the last of them becomes the active one."""
    m = table(spark, d, "master_resumes").select("id", "name", "content", "is_active", "is_sample")
    new = m.where("is_sample").groupBy("content").agg(F.min("name").alias("name")).select(F.concat_ws(" ", "name", F.md5("content")).alias("name"), "content")
    u = readers.uploaded(m, new, activate=True)
    return u.select("id", "is_active", F.array_join("missing", "|").alias("missing"))


def s05_seeded(spark: SparkSession, d: str) -> DataFrame:
    """Samples for domains that have none, made of the domains' latest resumes."""
    m = table(spark, d, "master_resumes")
    own = m.where("not is_sample and domain is not null").select("name", "domain", "content")
    return readers.seed_samples(m, own).where("is_sample").groupBy("domain").agg(F.count("*").alias("n_samples"))


def k05_export(spark: SparkSession, d: str) -> DataFrame:
    """Adverts written as JSON lines and read back."""
    at = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    j = table(spark, d, "jobs").select("id", "job_title", "required_skills", "match_score")
    sinks.export_json(j, at)
    return spark.read.schema(j.schema).json(at).select("id", "job_title", F.array_join("required_skills", "|").alias("skills"), "match_score")


def k06_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores with their breakdowns written as JSON lines and read back."""
    at = f"{shared_folder(spark)}/scores-{uuid.uuid4().hex}"
    t = table(spark, d, "tailored_resumes").select("id", "job_id", "match_score", "score_breakdown")
    sinks.export_json(t, at)
    return spark.read.schema(t.schema).json(at)


BATCHES = 4


def z01_upsert_stream(spark: SparkSession, d: str) -> DataFrame:
    """Adverts that arrive in four files, one a batch, kept as one table by their address."""
    at = f"{shared_folder(spark)}/arrivals-{uuid.uuid4().hex}"
    for k in range(BATCHES):
        table(spark, d, "jobs").where(F.col("id") % BATCHES == k).coalesce(1).write.parquet(f"{at}/{k}")
    stream = spark.readStream.schema(table(spark, d, "jobs").schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/*")
    return streams.upsert_stream(stream).select("id", "application_url", "job_title", "status")


def z02_drain(spark: SparkSession, d: str) -> DataFrame:
    """New adverts get their phrases as they arrive, and become analyzed."""
    find = extract.phrase_finder(dictionary(spark, d))
    work = lambda j: j.select("id", F.coalesce(F.size(find(F.col("job_description"))), F.lit(0)).alias("n_phrases"))
    return streams.drain(streams.stream_of(spark, f"{d}/jobs.parquet"), work)


def _micros(c: str) -> Column:
    return F.unix_micros(c)


def z03_sliding(spark: SparkSession, d: str) -> DataFrame:
    s = streams.replay(streams.sliding_counts(streams.stream_of(spark, f"{d}/events.parquet"), "event_type", "ts", "2 hours", "1 hour"), "sliding", "append")
    last = F.lit(1 << 62)
    return s.select("event_type", _micros("start").alias("start_us"), "n").where(F.col("start_us") < last)


def z04_daily(spark: SparkSession, d: str) -> DataFrame:
    """Days that are over when the stream ends."""
    s = streams.replay(streams.daily_counts(streams.stream_of(spark, f"{d}/events.parquet"), "event_type", "ts"), "daily")
    return s.select("event_type", _micros("day").alias("day_us"), "n")


def z05_visits(spark: SparkSession, d: str) -> DataFrame:
    s = streams.replay(streams.visits(streams.stream_of(spark, f"{d}/events.parquet"), "user_id", "ts"), "visits")
    return s.select("user_id", _micros("start").alias("start_us"), "n")


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and k[:1] in "skz" and k[1:3].isdigit()}

def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^[\\s\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]+|[\\s\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]+$', '', 'g')"


_MARK = "(SELECT max(epoch_us(ts)) - 600000000 FROM events)"
SQL = {
    "s08_postings_of_pages": f"""SELECT 'https://' || source || '.example/' || id AS application_url, CASE WHEN source = 'jobharbor' THEN job_title ELSE {_strip('job_title')} END AS title,
        CASE WHEN source = 'jobharbor' THEN company_name ELSE {_strip('company_name')} END AS company, md5(trim(regexp_replace(CASE WHEN source = 'jobharbor' THEN job_description ELSE {_strip('job_description')} END, '\\s+', ' ', 'g'))) AS description_md5,
        CASE WHEN source = 'jobharbor' THEN 'Town, ST' END AS location,
        CASE WHEN source = 'jobharbor' THEN date_posted END AS posted, CASE WHEN source = 'jobharbor' THEN 'EUR ' || format('{{:,}}', id * 10) || ' – ' || format('{{:,}}', id * 20) END AS salary
        FROM jobs WHERE source IS NOT NULL AND length(trim(job_title)) > 0 AND length(trim(company_name)) > 0 AND length(trim(job_description)) > 0""",
    "s06_uploads": """WITH n AS (SELECT content, concat_ws(' ', min(name), md5(content)) AS name FROM master_resumes WHERE is_sample GROUP BY content),
        t AS (SELECT (SELECT max(id) FROM master_resumes) + row_number() OVER (ORDER BY name) AS id, CASE WHEN json_valid(content) THEN CASE WHEN json_type(content) = 'OBJECT' THEN json_keys(content) END END AS k FROM n)
        SELECT id, (SELECT count(*) FROM n) = 0 AND is_active AS is_active, NULL::VARCHAR AS missing FROM master_resumes
        UNION ALL SELECT id, id = (SELECT max(id) FROM t), array_to_string(list_filter(['personal_info', 'skills', 'work_experience'], lambda s: NOT coalesce(list_contains(k, s), false)), '|') FROM t""",
    "k06_scores": "SELECT id, job_id, match_score, score_breakdown FROM tailored_resumes",
    "z02_drain": f"""WITH {phrases('jobs', 'id', 'job_description', SKILL_NAMES)} SELECT j.id, count(h.id)::INT AS n_phrases, 'analyzed' AS status FROM jobs j LEFT JOIN hit h USING (id) WHERE j.status = 'new' GROUP BY j.id""",
    "s04_dictionary": "SELECT DISTINCT lower(unnest(list_concat([canon_value], coalesce(alt_names, []::VARCHAR[])))) AS phrase, 'skill' AS category FROM canon_values WHERE kind = 'skill'",
    "s05_seeded": """WITH has AS (SELECT domain, count(*) AS n_samples FROM master_resumes WHERE is_sample GROUP BY domain)
        SELECT * FROM has UNION ALL SELECT DISTINCT domain, 1 FROM master_resumes WHERE NOT is_sample AND domain IS NOT NULL AND domain NOT IN (SELECT domain FROM has WHERE domain IS NOT NULL)""",
    "k05_export": "SELECT id, job_title, array_to_string(required_skills, '|') AS skills, match_score FROM jobs",
    "z01_upsert_stream": """WITH b AS (SELECT id % 4 AS batch, max(id) AS id, arg_max_null(job_title, id) AS job_title, application_url FROM jobs WHERE application_url IS NOT NULL GROUP BY 1, 4)
        SELECT arg_min(id, batch) AS id, application_url, arg_max_null(job_title, batch) AS job_title, 'new' AS status FROM b GROUP BY 2""",
    "z03_sliding": f"""SELECT event_type, s AS start_us, count(*) AS n FROM (SELECT event_type, unnest([epoch_us(ts) // 3600000000 * 3600000000, epoch_us(ts) // 3600000000 * 3600000000 - 3600000000]) AS s FROM events)
        WHERE s + 7200000000 <= {_MARK} GROUP BY 1, 2""",
    "z04_daily": f"SELECT event_type, epoch_us(ts) // 86400000000 * 86400000000 AS day_us, count(*) AS n FROM events GROUP BY 1, 2 HAVING day_us + 86400000000 <= {_MARK}",
    "z05_visits": f"""WITH g AS (SELECT user_id, epoch_us(ts) AS t, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS v FROM (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 1800000000 THEN 0 ELSE 1 END AS new FROM events))
        SELECT user_id, min(t) AS start_us, count(*) AS n FROM g GROUP BY user_id, v HAVING max(t) + 1800000000 <= {_MARK}""",
}
