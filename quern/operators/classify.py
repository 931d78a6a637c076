"""Texts by votes of keywords: domains and kinds of documents."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import EMAIL, PHONE, bound, words_array

#: Keywords of the domains of the test tables; domain_finder() takes any table of them.
DOMAIN_KEYWORDS = {
    "tech": ("python", "terraform", "docker", "linux", "git", "golang", "graphql", "kubernetes", "developer", "platform", "incident response", "network"),
    "data": ("sql", "statistics", "data warehousing", "data modelling", "machine learning", "analyst", "data", "datasets", "dashboards"),
    "health": ("patient triage", "wound care", "medication review", "nurse", "pharmacist", "therapist", "patients", "clinics", "wards"),
    "finance": ("financial reporting", "tax preparation", "payroll processing", "budget forecasting", "accountant", "ledgers", "budgets", "invoices"),
    "education": ("lesson planning", "classroom management", "teacher", "lessons", "classrooms"),
    "operations": ("inventory control", "route planning", "lean manufacturing", "warehouse", "warehouses", "shipments", "supply chain", "routes"),
}
TITLE_WEIGHT = 3


MOST_KEYWORDS = 200_000
_VOTES = T.StructType([T.StructField("domain", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("best", T.IntegerType()), T.StructField("total", T.IntegerType())])
_WORDS = re.compile(r"\w+")


def keyword_table(spark: SparkSession, keywords: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """domain, keyword of the test tables' domains, or of keywords."""
    return spark.createDataFrame([(d, k) for d, ks in (keywords or DOMAIN_KEYWORDS).items() for k in ks], "domain string, keyword string")


class Ballot:
    """Counts the keywords of all domains in a text at once, however many there are."""

    def __init__(self, rows: list[tuple[str, str]]) -> None:
        self.domains = list(dict.fromkeys(d for d, _ in rows))
        self.single: dict[str, list[str]] = {}
        self.longer: dict[str, list[tuple[re.Pattern, str]]] = {}
        for d, k in dict.fromkeys((d, k.lower()) for d, k in rows):
            if _WORDS.fullmatch(k):
                self.single.setdefault(k, []).append(d)
            else:  # sought only where its first word stands
                first = _WORDS.search(k)
                self.longer.setdefault(first.group() if first else "", []).append((re.compile(rf"\b{re.escape(k)}\b"), d))

    def count(self, text: str, weight: int, into: Counter) -> None:
        low = text.lower()
        words = Counter(_WORDS.findall(low))
        for k in words.keys() & self.single.keys():
            for d in self.single[k]:
                into[d] += weight * words[k]
        for k in ["", *(words.keys() & self.longer.keys())]:
            for pattern, d in self.longer.get(k, ()):
                into[d] += weight * len(pattern.findall(low))

    def decide(self, title: str | None, body: str | None) -> tuple[str, float, int, int]:
        votes: Counter = Counter()
        self.count(title or "", TITLE_WEIGHT, votes)
        self.count(body or "", 1, votes)
        best, total = max(votes.values(), default=0), sum(votes.values())
        winners = [d for d, n in votes.items() if n == best]
        return (winners[0], best / total, best, total) if best and len(winners) == 1 else ("other", 0.0, best, total)


_ballots: dict[str, Ballot] = {}


def domain_finder(keywords: DataFrame) -> Callable[[Column, Column], Column]:
    """A function of title and text to struct(domain, confidence, best, total): the domain with most hits, three for one in the title.

    keywords: domain, keyword; over MOST_KEYWORDS rows raise ValueError, so sending them to all workers is safe. Hits are whole
    words; each keyword counts for itself, one of two domains for both. No hit, or two domains with most, give 'other' and
    confidence 0, else the confidence is the winner's part of all hits. Null texts are empty.
    """
    rows = keywords.select("domain", "keyword").dropna().limit(MOST_KEYWORDS + 1).collect()
    if len(rows) > MOST_KEYWORDS:
        raise ValueError(f"over {MOST_KEYWORDS} keywords")
    held, key = keywords.sparkSession.sparkContext.broadcast([tuple(r) for r in rows]), uuid.uuid4().hex

    @F.pandas_udf(_VOTES)
    def decide(titles: pd.Series, bodies: pd.Series) -> pd.DataFrame:
        if key not in _ballots:
            _ballots.clear()
            _ballots[key] = Ballot(held.value)
        ballot = _ballots[key]
        return pd.DataFrame([ballot.decide(t, b) for t, b in zip(titles, bodies)], columns=_VOTES.names)

    return decide


# Headings of resumes, and what speaks against one.
RESUME_SIGNS = (
    "experience", "work experience", "employment history", "work history", "professional experience", "career history", "relevant experience",
    "employment", "work background", "education", "academic background", "qualifications", "skills", "technical skills", "core competencies",
    "technical expertise", "programming languages", "tools", "summary", "professional summary", "career summary", "objective", "career objective",
    "profile", "about me", "professional profile", "background", "certifications", "certificates", "achievements", "accomplishments", "projects",
    "publications", "references", "languages", "volunteer", "awards", "honors", "leadership", "professional development", "coursework",
    "activities", "interests", "portfolio",
)
OTHER_SIGNS = (
    "invoice", "bill to", "purchase order", "payment due", "total amount", "tax invoice", "receipt", "quantity", "unit price", "subtotal",
    "abstract", "introduction", "methodology", "conclusion", "bibliography", "doi:", "arxiv", "findings", "results", "discussion", "whereas",
    "hereby", "hereinafter", "agreement", "terms and conditions", "privacy policy", "plaintiff", "defendant", "court", "chapter ",
    "table of contents", "exhibit", "section", "article", "profit", "loss", "balance sheet", "dear ", "sincerely,", "regards,",
    "to whom it may concern",
)


def document_kind(text: Column) -> Column:
    """struct(verdict, confidence, n_resume, n_other) of a text by the signs it contains, as substrings.

    confidence is 0.15 a heading (0.6 at most), 0.15 for an e-mail address, 0.1 for a telephone number, less 0.25 a sign
    against (0.75 at most), in 0 to 1. Two signs against, or 0.3 and less: not_resume; 0.7 and more: resume; between them
    inconclusive, which without a further judge (X03) ends as not_resume. Null counts as ''.
    """
    t = F.coalesce(text, F.lit(""))
    count = lambda low, signs: F.size(F.filter(words_array(signs), lambda s: F.contains(low, s)))
    flag = lambda p, v: F.when(t.rlike(p), v).otherwise(0.0)
    counts = bound(F.lower(t), lambda low: F.struct(count(low, RESUME_SIGNS).alias("yes"), count(low, OTHER_SIGNS).alias("no")))

    def decide(n: Column) -> Column:
        raw = F.least(n["yes"] * F.lit(0.15), F.lit(0.60)) + flag(EMAIL, 0.15) + flag(PHONE, 0.10) - F.least(n["no"] * F.lit(0.25), F.lit(0.75))
        c = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 4)
        judge = lambda c: F.when(n["no"] >= 2, "not_resume").when(c >= 0.70, "resume").when(c <= 0.30, "not_resume").otherwise("inconclusive")
        return bound(c, lambda c: F.struct(judge(c).alias("verdict"), c.alias("confidence"), n["yes"].alias("n_resume"), n["no"].alias("n_other")))

    return bound(counts, decide)
