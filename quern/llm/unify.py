"""One consistent form of text that looks the same: problem 5.

Compatibility normalisation in composed form, full case folding, one kind of space, no default-ignorable
characters, look-alike letters inside Latin words as Latin letters. Only texts with a character outside
plain Latin writing go to Python (a test in the scan's own stage), each distinct one of a batch once.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.chars import MAY_CHANGE, one_form, visible
from quern.session import heavy

def is_case(text: str) -> bool:
    """Whether visible() replaces or removes a character. Case, tabs and line ends are no reason."""
    return not text.isascii() and visible(text) != text


@F.pandas_udf(T.BooleanType())
def _is_case(texts: pd.Series) -> pd.Series:
    codes, values = pd.factorize(texts)
    hit = [is_case(v) for v in values] + [False]
    return pd.Series([hit[c] for c in codes], dtype=bool)


@F.pandas_udf(T.StringType())
def _one_form(texts: pd.Series) -> pd.Series:
    codes, values = pd.factorize(texts)
    form = [one_form(v) for v in values] + [None]
    return pd.Series([form[c] for c in codes], dtype=object)


def consistent(text: Column) -> Column:
    """text in its consistent form; null stays null, empty stays empty. Pure ASCII never leaves the JVM."""
    plain = F.lower(F.translate(F.regexp_replace(text, "\r\n?", "\n"), "\t\x0b\x0c", "   "))
    return F.when(not_ascii(text), _one_form(F.when(not_ascii(text), text))).otherwise(plain)


FIELDS = ("job_title", "company_name", "job_description")


def not_ascii(text: Column) -> Column:
    """Whether text has a character beyond ASCII, told by its length in bytes without a pattern."""
    return F.octet_length(text) > F.length(text)


def by_field(jobs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """id, field, value: one row for each non-null field."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]))
    return jobs.select("id", each.alias("e")).select("id", "e.field", "e.value").where(F.col("value").isNotNull())


def changed_fields(jobs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """id, field of the values that hold a character to be replaced or removed. Null and empty values are none;
    repeated rows come out again. Narrow: no shuffle."""
    return by_field(jobs, fields).where(not_ascii(F.col("value")) & F.col("value").rlike(MAY_CHANGE)).where(_is_case("value")).select("id", "field")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return changed_fields(heavy(spark, folder, "jobs", "id", *FIELDS)).withColumnRenamed("id", "job_id")


def p5_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Each advert with its three texts in the consistent form."""
    return heavy(spark, folder, "jobs", "id", *FIELDS).select(F.col("id").alias("job_id"), *[consistent(F.col(f)).alias(f) for f in FIELDS])


def reference_form(text: str) -> str:
    """The form by the plain definition, for tests: character by character."""
    out = unicodedata.normalize("NFKC", visible(text))
    return unicodedata.normalize("NFKC", out.casefold())
