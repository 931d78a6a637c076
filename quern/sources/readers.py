"""Sources: posting pages, JSON-LD, resumes, dictionaries, settings, ledgers, documents and logs."""

from __future__ import annotations

import io
import json
import zipfile
from html.parser import HTMLParser
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import html_text, iso_date, words_array

# --- pages -------------------------------------------------------------------------------------------------------------

_POSTING = (
    "struct<`@type`:string,title:string,description:string,datePosted:string,url:string,hiringOrganization:string,jobLocation:string,baseSalary:string>"
)


def json_ld_blocks(html: Column) -> Column:
    """Texts of a page's JSON-LD blocks in order."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), 1)


def json_ld_posting(html: Column) -> Column:
    """Struct of the page's first JobPosting (title, company, location, description, posted, salary), null without one.

    A block is an object or a list; the first of that type counts, unreadable blocks are passed over. A company is an
    object's name or a text; a place joins its parts that aren't empty; a salary has a currency (USD if absent) and one or both ends.
    """
    block = lambda b: F.when(F.ltrim(b).startswith("["), b).otherwise(F.concat(F.lit("["), b, F.lit("]")))
    found = F.filter(F.flatten(F.transform(json_ld_blocks(html), lambda b: F.coalesce(F.from_json(block(b), f"array<{_POSTING}>"), F.from_json(F.lit("[]"), f"array<{_POSTING}>")))), lambda p: p["@type"] == "JobPosting")
    p = F.try_element_at(found, F.lit(1))
    get = lambda c, path: F.get_json_object(c, path)
    org = F.when(F.ltrim(p["hiringOrganization"]).startswith("{"), F.coalesce(get(p["hiringOrganization"], "$.name"), F.lit(""))).otherwise(F.coalesce(p["hiringOrganization"], F.lit("")))
    place = F.nullif(F.array_join(F.filter(F.array(*[get(p["jobLocation"], f"$.address.address{x}") for x in ("Locality", "Region", "Country")]), lambda x: x.isNotNull() & (x != "")), ", "), F.lit(""))
    low, high = (F.nullif(get(p["baseSalary"], f"$.value.{x}Value").try_cast("double"), F.lit(0.0)) for x in ("min", "max"))
    currency = F.coalesce(get(p["baseSalary"], "$.currency"), F.lit("USD"))
    money = lambda v: F.format_number(F.bround(v, 0), 0)
    salary = F.when(low.isNotNull() & high.isNotNull(), F.concat(currency, F.lit(" "), money(low), F.lit(" – "), money(high))).when(
        F.coalesce(low, high).isNotNull(), F.concat(currency, F.lit(" "), money(F.coalesce(low, high)))
    )
    return F.when(
        p.isNotNull(),
        F.struct(p["title"].alias("title"), org.alias("company"), place.alias("location"), html_text(p["description"]).alias("description"), iso_date(p["datePosted"]).alias("posted"), salary.alias("salary")),
    )


class _Selected(HTMLParser):
    """Text of the first element of each wanted class or tag."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self, wanted: tuple[str, ...]) -> None:
        super().__init__()
        self.wanted, self.found, self.open = wanted, {}, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        for entry in self.open:
            entry[1] += tag not in self.VOID
        classes = {f".{c}" for k, v in attrs if k == "class" for c in (v or "").split()} | {tag}
        for w in self.wanted:
            if w in classes and w not in self.found and tag not in self.VOID:
                self.found[w] = []
                self.open.append([w, 1])

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.VOID:
            for entry in self.open:
                entry[1] -= 1
            self.open = [e for e in self.open if e[1] > 0]

    def handle_data(self, data: str) -> None:
        for w, _ in self.open:
            if data.strip():
                self.found[w].append(data.strip())


def first_text(html: Column, selectors: tuple[str, ...]) -> Column:
    """Text of the first selector ('.class' or a tag) that the page has, null without any."""

    @F.pandas_udf(T.StringType())
    def pick(pages: pd.Series) -> pd.Series:
        def one(page: str) -> str | None:
            p = _Selected(selectors)
            try:
                p.feed(page)
            except (AssertionError, ValueError):  # a page that can't be read costs only itself
                return None
            return next((" ".join(p.found[s]) for s in selectors if s in p.found), None)

        return pages.map(one, na_action="ignore")

    return pick(html)


def postings_of_pages(pages: DataFrame, selectors: dict[str, tuple[str, ...]], most: int | None = None) -> DataFrame:
    """Pages (url, html) as postings: JSON-LD first, else selectors of each field; without title, company and
    text, or if it can't be read, a page is left out; of pages with one address (without query) the one with the least whole
    address counts. most: only so many postings of a run, the first by address (S07's cap), all if absent."""
    one = pages.groupBy(F.substring_index("url", "?", 1).alias("application_url")).agg(F.min_by("html", "url").alias("html"))
    d = one.withColumn("p", json_ld_posting(F.col("html")))
    pick = lambda f: F.coalesce(F.nullif(F.col(f"p.{f}"), F.lit("")), first_text(F.when(F.col("p").isNull(), F.col("html")), selectors.get(f, ())))
    out = d.select("application_url", *[pick(f).alias(f) for f in ("title", "company", "location", "description")], F.col("p.posted").alias("posted"), F.col("p.salary").alias("salary"))
    out = out.where("length(trim(title)) > 0 and length(trim(company)) > 0 and length(trim(description)) > 0")
    return out.orderBy("application_url").limit(most) if most is not None else out


# --- files ---------------------------------------------------------------------------------------------------------------


def read_resumes(spark: SparkSession, path: str) -> DataFrame:
    """JSON files, one resume each, as name (of the file) and content (JSON text)."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("name"), F.col("value").alias("content"))


def seed_samples(masters: DataFrame, samples: DataFrame) -> DataFrame:
    """Masters with the samples (name, domain, content) of domains that have no sample yet."""
    there = masters.where("is_sample").select("domain").distinct()
    top = masters.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    new = samples.groupBy("domain").agg(F.min_by(F.struct("name", "content"), "name").alias("s")).join(there, "domain", "left_anti")
    rows = new.crossJoin(F.broadcast(top)).select(
        (F.col("top") + F.row_number().over(_one_by("domain"))).alias("id"), F.col("s.name").alias("name"), F.col("s.content").alias("content"), F.lit(False).alias("is_active"), F.lit(True).alias("is_sample"), "domain"
    )
    return masters.select("id", "name", "content", "is_active", "is_sample", "domain").unionByName(rows)


# Sections that a resume should have.
NEEDED_SECTIONS = ("personal_info", "work_experience", "skills")


def uploaded(masters: DataFrame, new: DataFrame, activate: bool = False) -> DataFrame:
    """Masters after the resumes new (name, content) were added, with missing, the needed sections that an added one lacks.

    With activate the last of them by name is the only active one. Content that is no JSON object lacks all. Other rows have null.
    """
    top = masters.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    keys = F.coalesce(F.json_object_keys("content"), F.array().cast("array<string>"))
    missing = F.array_sort(F.array_except(words_array(NEEDED_SECTIONS), keys))
    added = new.select("name", "content").crossJoin(F.broadcast(top)).withColumn("n", F.row_number().over(_one_by("name")))  # an upload's files: few
    added = added.select((F.col("top") + F.col("n")).alias("id"), "name", "content", F.lit(False).alias("is_active"), F.lit(False).alias("is_sample"), missing.alias("missing"))
    both = masters.select("id", "name", "content", "is_active", "is_sample", F.lit(None).cast("array<string>").alias("missing")).unionByName(added)
    if not activate:
        return both
    last = added.agg(F.max("id").alias("last"))
    return both.crossJoin(F.broadcast(last)).withColumn("is_active", F.when(F.col("last").isNull(), F.col("is_active")).otherwise(F.col("id") == F.col("last"))).drop("last")


def _one_by(column: str):  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1)).orderBy(column)  # one row a domain


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Phrase, category of a dictionary file: indented lists 'category:' and '- phrase', nested ones flattened.

    Lower case; a missing or unreadable file gives no rows.
    """
    try:
        lines = [x for r in spark.read.text(path, wholetext=True).limit(1).collect() for x in r.value.splitlines()]
    except AnalysisException:
        lines = []
    rows, category = [], None
    for line in lines:
        bare = line.split(" #")[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#"):
            continue
        if bare.lstrip().startswith("- "):
            if category:
                rows.append((bare.lstrip()[2:].strip().strip("\"'").lower(), category))
        elif not bare.startswith((" ", "\t")) and bare.endswith(":"):
            category = bare[:-1].strip()
    return spark.createDataFrame(rows, "phrase string, category string")


def merged_settings(given: dict, defaults: dict) -> dict:
    """Settings with absent ones from defaults, level by level."""
    return {k: merged_settings(given[k], v) if isinstance(v, dict) and isinstance(given.get(k), dict) else given.get(k, v) for k, v in defaults.items()} | {k: v for k, v in given.items() if k not in defaults}


def read_settings(path: str, defaults: dict) -> dict:
    """Settings from a JSON file; defaults if it is missing or unreadable."""
    try:
        given = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        given = {}
    return merged_settings(given if isinstance(given, dict) else {}, defaults)


def table_folder(env: dict[str, str], settings: dict, default: str) -> str:
    """Where tables lie: the address, else the path of the environment, else settings, else default."""
    return env.get("DATABASE_URL") or env.get("DATABASE_PATH") or settings.get("database", {}).get("path") or default


def read_usage(spark: SparkSession, path: str, today: str) -> DataFrame:
    """Model, day, n_calls, n_tokens of today from a ledger in any of its forms: one JSON object of models with their counts, the
    older flat one (date, calls, tokens_estimated) for the model 'primary', or lines of objects with their model."""
    counts = "date string, calls long, tokens_estimated long"
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m")).where("m is not null and m['model'] is null")
    flat = whole.where("m['date'] is not null").select(F.lit("primary").alias("model"), F.from_json(F.to_json("m"), "date string, calls string, tokens_estimated string").alias("c"))
    flat = flat.select("model", F.struct("c.date", F.col("c.calls").try_cast("long").alias("calls"), F.col("c.tokens_estimated").try_cast("long").alias("tokens_estimated")).alias("c"))
    models = whole.where("m['date'] is null").select(F.explode("m").alias("model", "j")).select("model", F.from_json("j", counts).alias("c"))
    each = lines.select(F.get_json_object("line", "$.model").alias("model"), F.from_json("line", counts).alias("c")).where("model is not null")
    found = flat.unionByName(models).unionByName(each)
    return found.where(F.col("c.date") == today).select("model", F.col("c.date").alias("day"), F.col("c.calls").alias("n_calls"), F.col("c.tokens_estimated").alias("n_tokens"))


def text_of_bytes(content: Column) -> Column:
    """Text of bytes: UTF-8, else Latin-1."""
    utf = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
    return F.coalesce(utf, F.decode(content, "ISO-8859-1"))


_WORD_XML = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
MOST_XML = 1 << 28


def docx_text(content: bytes) -> str | None:
    """Text of a DOCX file: its paragraphs, one a line, tabs and breaks kept. None if it is none, or unpacks to over MOST_XML bytes."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            if z.getinfo("word/document.xml").file_size > MOST_XML:
                return None
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, OSError):
        return None
    said = {f"{_WORD_XML}tab": "\t", f"{_WORD_XML}br": "\n", f"{_WORD_XML}cr": "\n"}
    return "\n".join("".join(said.get(n.tag, n.text or "" if n.tag == f"{_WORD_XML}t" else "") for n in p.iter()) for p in root.iter(f"{_WORD_XML}p"))


@F.pandas_udf(T.StringType())
def _docx(contents: pd.Series) -> pd.Series:
    return contents.map(docx_text, na_action="ignore")


def read_documents(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path and text of text files and DOCX files; null for a DOCX that can't be read. PDF needs a library that isn't here."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    docx = F.lower("path").endswith(".docx")
    packed = F.when(docx, _docx(F.when(docx, F.col("content"))))
    return d.where(~F.lower("path").endswith(".pdf")).select("path", F.when(docx, packed).otherwise(text_of_bytes(F.col("content"))).alias("text"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Line of a log file."""
    return spark.read.text(path).select(F.col("value").alias("line"))
