"""Scalar functions on text, as Column expressions that stay in the JVM."""

from __future__ import annotations

import html
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a posting says instead of a salary, lower case.
NO_SALARY = ("not provided", "n/a", "-", "—", "")
# Words left at the end of a skill by the sentence around it, in the order of their removal.
SKILL_TAILS = (" experience", " skills", " knowledge", " expertise", " required", " preferred", " or", " and", " requirements")
SKILL_LABELS = ("requirements", "qualifications", "responsibilities", "overview")
_END = "[.,;:!?\"']+$"


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def words_array(words: Iterable[str]) -> Column:
    """A constant array of texts, made by one call to the JVM however many they are."""
    return F.expr("array(" + ", ".join(map(_quoted, words)) + ")")


def words_map(pairs: dict[str, str]) -> Column:
    """A constant map of texts, made by one call to the JVM."""
    return F.expr("map(" + ", ".join(f"{_quoted(k)}, {_quoted(v)}" for k, v in pairs.items()) + ")")


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of value, with value worked out once however often f names it."""
    return F.transform(F.array(value), f)[0]


def stripped(c: Column) -> Column:
    """c without white space at its ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalise_skill(c: Column) -> Column:
    """Stripped, lower case, no punctuation at the end, single spaces. Null stays null."""
    return F.regexp_replace(F.regexp_replace(F.lower(stripped(c)), _END, ""), r"\s+", " ")


def clean_text(c: Column) -> Column:
    """Words joined by single spaces; null becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def truncate_words(c: Column, n: int = 5000) -> Column:
    """At most n characters cut at a space, with an ellipsis; shorter texts stay."""
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.regexp_replace(F.substring(c, 1, n), r" [^ ]*\z", ""), F.lit("…")))


@F.pandas_udf(T.StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def html_text(c: Column) -> Column:
    """Text of html: entities, tags, white space. Only texts with '&' leave the JVM. Null becomes ''."""
    plain = F.when(c.contains("&"), _unescaped(F.when(c.contains("&"), c))).otherwise(c)
    return F.coalesce(stripped(F.regexp_replace(F.regexp_replace(plain, "<[^>]+>", " "), r"\s+", " ")), F.lit(""))


def posting_url(c: Column, base: str) -> Column:
    """The address of the posting's key jk, or the address as it is."""
    key = F.regexp_extract(c, "(jk=[a-zA-Z0-9]+)", 1)
    return F.when(key != "", F.concat(F.lit(base + "/viewjob?"), key)).otherwise(c)


def without_query(c: Column) -> Column:
    """The address up to its query."""
    return F.substring_index(c, "?", 1)


def url_slug(c: Column) -> Column:
    """At most 50 characters of the address as a file name."""
    return F.substring(F.replace(F.replace(F.replace(c, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit("")), F.lit("/"), F.lit("_")), 1, 50)


def url_host(c: Column) -> Column:
    """Host of the address; null if there is none."""
    return F.nullif(F.regexp_extract(c, "^[a-z]+://(?:www\\.)?([^/?#]+)", 1), F.lit(""))


def sentences(c: Column) -> Column:
    """Non-blank sentences, split after . ! or ? before white space."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), stripped), lambda s: F.length(s) > 0)


def first_sentence_with(c: Column, word: Column) -> Column:
    """The first sentence that contains word in any case, 200 characters at most; '' if none."""
    hits = F.filter(sentences(c), lambda s: F.contains(F.lower(s), F.lower(word)))
    return F.coalesce(F.substring(F.try_element_at(hits, F.lit(1)), 1, 200), F.lit(""))


# Places that count as noise among skills, and patterns of other noise.
NOISE_PLACES = (
    "san francisco", "new york", "seattle", "austin", "boston", "chicago", "los angeles", "denver", "atlanta", "remote",
    "united states", "usa", "california", "texas", "new york city", "nyc", "sf", "bay area", "silicon valley", "new jersey",
    "virginia", "washington", "oregon", "florida", "georgia", "colorado", "ohio", "united kingdom", "uk", "canada", "india",
    "australia", "europe", "worldwide", "global", "anywhere",
)
NOISE = (
    r"^\d+\+?\s*(years?|yrs?)\b", r"^\d{4}$", r"^\$[\d,]+", r"^(inc|llc|ltd|corp|co\.)$", r"^\d+%$",
    r"^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\b", r"^https?://", r"^www\.",
)


def is_noise(c: Column) -> Column:
    """One character or less, a place, a span of years, money, a company suffix, a share, a month, a link."""
    t = F.lower(stripped(c))
    return (F.length(t) <= 1) | t.isin(*NOISE_PLACES) | t.rlike("|".join(f"(?:{p})" for p in NOISE))


# Common words that are no technology.
PLAIN_WORDS = (
    "the", "and", "for", "with", "your", "our", "their", "have", "has", "been", "will", "from", "this", "that", "these", "those",
    "team", "role", "work", "join", "help", "build", "new", "use", "using", "based", "strong", "good",
)


def looks_technical(c: Column) -> Column:
    """Has a digit, is a short acronym, has . + or -, or is no common word; at least two characters."""
    acronym = (F.upper(c) == c) & c.rlike("[A-Z]") & F.length(c).between(2, 6)
    return (F.length(c) >= 2) & (c.rlike(r"\d") | acronym | c.rlike("[.+-]") | ~c.isin(*PLAIN_WORDS))


# Fixed value: words that negate what follows in the same sentence.
NEGATION = r"\b(no|not|without|don'?t need|doesn'?t require)\b[^.!?\n]{0,40}$"


def negated_before(c: Column, position: Column) -> Column:
    """Whether the 50 characters before position (from 1) negate what stands there."""
    start = F.greatest(F.lit(1), position - 50)
    return F.lower(F.substring(c, start, position - start)).rlike(NEGATION)


def clean_skill(c: Column) -> Column:
    """A captured skill without the sentence's last words; structural labels become ''."""
    cut = lambda out, tail: F.when(F.endswith(out, tail), stripped(F.left(out, F.length(out) - F.length(tail)))).otherwise(out)
    out = F.aggregate(words_array(SKILL_TAILS), F.regexp_replace(F.lower(stripped(c)), _END, ""), cut)
    return bound(F.regexp_replace(out, _END, ""), lambda x: F.when(x.isin(*SKILL_LABELS), F.lit("")).otherwise(x))


def printable_cp1252(c: Column) -> Column:
    """Characters a western console can't show become '?'."""
    extra = "".join(chr(x) for x in range(0xA0, 0x100)) + bytes(b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)).decode("cp1252")
    return F.regexp_replace(c, f"[^\\x00-\\x7F{extra}]", "?")


def split_list(c: Column) -> Column:
    """Parts between commas, stripped and not empty; null if there are none."""
    parts = F.filter(F.transform(F.split(c, ","), stripped), lambda s: F.length(s) > 0)
    return F.when(F.size(parts) > 0, parts)


def title_case(c: Column) -> Column:
    """Each run of letters with a capital first and small ones after it, also behind punctuation."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"([\p{L}]+|[^\p{L}]+)"), 1), F.initcap), "")


def without_markdown(c: Column) -> Column:
    """Text without code fences, emphasis and quotation marks around it."""
    t = F.regexp_replace(F.regexp_replace(c, r"(?m)^```\w*\s*$|```", ""), r"\*\*|__", "")
    return F.regexp_replace(stripped(t), "^[\"'`]+|[\"'`]+$", "")


def voice(c: Column) -> Column:
    """first_person with over two first-person words, else third_person with over two of the third, else no_pronouns."""
    t = F.lower(F.coalesce(c, F.lit("")))
    first = F.regexp_count(t, F.lit(r"\b(i|my|me|i've|i'm|i am|i have)\b"))
    third = F.regexp_count(t, F.lit(r"\b(he|she|they|his|her|their|him|them)\b"))
    return F.when(first > 2, "first_person").when(third > 2, "third_person").otherwise("no_pronouns")


# Patterns of an address, a telephone number and profile links.
EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
PHONE = r"\+?1?\s*[-.]?\s*\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}"
LINKEDIN, GITHUB = r"(?i)linkedin\.com/in/[\w-]+", r"(?i)github\.com/[\w-]+"


def contacts(c: Column) -> Column:
    """Email, phone, linkedin and github in the text; '' where absent."""
    text = F.coalesce(c, F.lit(""))
    found = {"email": EMAIL, "phone": PHONE, "linkedin": LINKEDIN, "github": GITHUB}
    return F.struct(*[stripped(F.regexp_extract(text, p, 0)).alias(k) for k, p in found.items()])


def json_or_text(c: Column) -> Column:
    """A JSON string's text, any other JSON as it is, what is no JSON as it is."""
    quoted = F.ltrim(c).startswith('"')
    return F.coalesce(F.when(quoted, F.get_json_object(F.concat(F.lit('{"v":'), c, F.lit("}")), "$.v")), c)


def salary_text(c: Column) -> Column:
    """The salary, or null for empty ones and placeholders."""
    t = stripped(c)
    return F.when(~F.lower(t).isin(*NO_SALARY), t)


def posted_date(c: Column, today: Column) -> Column:
    """The date that an ISO date or a relative date means; null if it means none.

    The first form that the text holds counts, in this order: ISO date, just posted, today, N hours, N days,
    yesterday, a week ago, N weeks, a month ago, N months. An ISO form that is no date goes on to the rest.
    """
    t = F.lower(c)

    def ago(unit: str, days: int) -> Column:
        n = F.regexp_extract(t, rf"(\d+)\s+{unit}", 1).try_cast("int")
        return F.when(n.isNotNull(), F.date_sub(today, n * days))

    def fixed(pattern: str, days: int) -> Column:
        return F.when(t.rlike(pattern), F.date_sub(today, days))

    return F.coalesce(
        F.regexp_extract(c, r"\d{4}-\d{2}-\d{2}", 0).try_cast("date"), fixed(r"\bjust\s+posted\b", 0), fixed(r"\btoday\b", 0), fixed(r"\d+\s+hour", 0),
        ago("day", 1), fixed(r"\byesterday\b", 1), fixed(r"\ba\s+week\s+ago\b", 7), ago("week", 7), fixed(r"\ba\s+month\s+ago\b", 30), ago("month", 30),
        fixed(r"\b30\+\s+days\b", 30),
    )


def iso_date(c: Column) -> Column:
    """The date before a 'T'; null if it is none."""
    return F.substring_index(c, "T", 1).try_cast("date")
