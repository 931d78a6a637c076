"""Keyed tables kept up to date: upsert, merge, archive, activation, cascades and the ledger of usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import sets


def latest_by_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by order, as a mergeable aggregate: no window over a key's rows."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("r")).select(key, "r.*")


def upsert_postings(jobs: DataFrame, postings: DataFrame) -> DataFrame:
    """Jobs after postings arrived, by application_url, with is_new.

    New addresses are inserted with status 'new'. Known ones keep id and status, take title, company and text, take place,
    salary and date unless those are null or empty, and get the union of both lists of skills. Of postings alike in address the
    last id counts; a null address is never known. jobs and postings have the columns of FIELDS; extra ones are dropped.
    """
    p = latest_by_key(postings.where("application_url is not null").select(*FIELDS), "application_url", "id")
    new = {c: F.col(f"p.{c}") for c in FIELDS}
    old = {c: F.col(f"j.{c}") for c in FIELDS}
    known, came = F.col("j.id").isNotNull(), F.col("p.id").isNotNull()
    take = lambda c: F.when(came, new[c]).otherwise(old[c])
    keep = lambda c: F.coalesce(F.nullif(new[c], F.lit("")) if c != "date_posted" else new[c], old[c])
    merged = lambda c: F.when(known & came, sets.merged(old[c], new[c])).when(came, new[c]).otherwise(old[c])
    joined = jobs.select(*FIELDS).alias("j").join(p.alias("p"), F.col("j.application_url") == F.col("p.application_url"), "full")
    return joined.select(
        F.coalesce(old["id"], new["id"]).alias("id"), F.coalesce(old["application_url"], new["application_url"]).alias("application_url"),
        *[take(c).alias(c) for c in ("job_title", "company_name", "job_description")], *[keep(c).alias(c) for c in ("location", "salary_range", "date_posted")],
        *[merged(c).alias(c) for c in ("required_skills", "preferred_skills")], F.when(known, old["status"]).otherwise("new").alias("status"), (~known).alias("is_new"),
    )


def upsert_batch(jobs: DataFrame, postings: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """upsert_postings() of the postings that ok holds for, and (outcome, n_postings) of all: failed, saved, updated.

    A posting that isn't ok, or for which ok is null, costs only itself. Of several with a new address the first is saved, the others update it.
    A null address is saved each time.
    """
    valid = F.coalesce(ok, F.lit(False))
    known = jobs.select("application_url").dropna().distinct().withColumn("known", F.lit(True))
    n = postings.where(valid).groupBy("application_url").agg(F.count("*").alias("n")).join(known, "application_url", "left")
    new = F.when(F.col("application_url").isNull(), F.col("n")).when(F.col("known").isNull(), F.lit(1)).otherwise(F.lit(0))
    counts = n.agg(F.coalesce(F.sum(new), F.lit(0)).alias("saved"), F.coalesce(F.sum(F.col("n") - new), F.lit(0)).alias("updated"))
    both = counts.select(F.explode(F.map_from_arrays(F.array(F.lit("saved"), F.lit("updated")), F.array("saved", "updated"))).alias("outcome", "n_postings"))
    lost = postings.where(~valid).agg(F.count("*").alias("n_postings")).select(F.lit("failed").alias("outcome"), "n_postings")
    return upsert_postings(jobs, postings.where(valid)), both.unionByName(lost)


FIELDS = (
    "id", "application_url", "job_title", "company_name", "location", "job_description", "required_skills", "preferred_skills", "salary_range",
    "date_posted", "status",
)


def upsert_tailored(rows: DataFrame) -> DataFrame:
    """One row for each (job_id, master_resume_id): the last by generated_at, then id."""
    others = [c for c in rows.columns if c not in ("job_id", "master_resume_id")]
    return rows.groupBy("job_id", "master_resume_id").agg(F.max_by(F.struct(*others), F.struct("generated_at", "id")).alias("r")).select("job_id", "master_resume_id", "r.*")


def archived(jobs: DataFrame, today, days: int = 30) -> DataFrame:  # noqa: ANN001
    """Jobs with status archived where they were scraped over days before today and are neither applied for nor archived."""
    old = (F.col("date_scraped") < F.date_sub(F.lit(today), days).cast("timestamp")) & ~F.col("status").isin("applied", "archived")
    return jobs.withColumn("status", F.when(old, "archived").otherwise(F.col("status")))


def ledger(usage: DataFrame, calls: DataFrame) -> DataFrame:
    """Usage (model, day, n_calls, n_tokens) with calls (model, day, text) added; a token is four characters.

    Rows of usage alike in model and day are one.
    """
    more = calls.groupBy("model", "day").agg(F.count("*").alias("n_calls"), F.sum(F.floor(F.length(F.coalesce("text", F.lit(""))) / 4)).alias("n_tokens"))
    return usage.select("model", "day", "n_calls", "n_tokens").unionByName(more).groupBy("model", "day").agg(F.sum("n_calls").alias("n_calls"), F.sum("n_tokens").alias("n_tokens"))


def first_by_key(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each group of keys by order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
