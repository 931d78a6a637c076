"""Resumes: JSON of changing shape as columns, profiles of style, checks of changed texts, and tailoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import sets
from quern.functions.text import bound, stripped, voice, words_array

_SHAPE = (
    "professional_summary string, summary string, work_experience string, experience string, skills string, education string, "
    "certifications string, projects string, personal_info string, section_order string, font_family string"
)
_POSITIONS = "array<struct<title:string,company:string,location:string,dates:string,duration:string,bullets:string>>"
_PROJECTS = "array<struct<name:string,description:string,technologies:string,tech:string,bullets:string>>"


def _kind(json: Column) -> Column:
    return F.substring(F.ltrim(json), 1, 1)


def _strings(json: Column) -> Column:
    """JSON text as a list of strings: a list's elements, a single text as a list of one, else empty; nulls and blanks left out."""
    got = F.when(_kind(json) == "[", F.from_json(json, "array<string>")).when(F.length(F.trim(json)) > 0, F.array(json))
    return F.filter(sets.none_as_empty(got), lambda s: s.isNotNull() & (F.length(F.trim(s)) > 0))


def _objects(json: Column, shape: str) -> Column:
    """JSON text as a list of objects; one object is a list of one; null elements are left out."""
    listed = F.when(_kind(json) == "[", json).when(_kind(json) == "{", F.concat(F.lit("["), json, F.lit("]")))
    return F.coalesce(F.filter(F.from_json(listed, shape), lambda x: x.isNotNull()), F.from_json(F.lit("[]"), shape))


def parsed(resumes: DataFrame, content: str = "content") -> DataFrame:
    """Resumes with the columns summary, positions, skills, skill_groups, certs, projects, titles, bullets.

    positions: struct(title, company, location, dates, bullets); projects: struct(name, description, technologies,
    bullets); skills of a map are its lists one after another; certs are texts or objects with name or title. Older
    names count under the newer ones. Unreadable or absent content gives empty lists and a null summary. JSON in a JSON text
    counts.
    """
    c = F.col(content)
    c = F.when(_kind(c) == '"', F.get_json_object(F.concat(F.lit('{"v":'), c, F.lit("}")), "$.v")).otherwise(c)
    r = F.col("_r")
    positions = F.transform(
        _objects(F.coalesce(r["work_experience"], r["experience"]), _POSITIONS),
        lambda p: F.struct(p["title"].alias("title"), p["company"].alias("company"), p["location"].alias("location"), F.coalesce(F.nullif(p["dates"], F.lit("")), p["duration"], F.lit("")).alias("dates"), _strings(p["bullets"]).alias("bullets")),
    )
    projects = F.transform(
        _objects(r["projects"], _PROJECTS),
        lambda p: F.struct(F.coalesce(p["name"], F.lit("")).alias("name"), F.coalesce(p["description"], F.lit("")).alias("description"), _strings(F.coalesce(p["technologies"], p["tech"])).alias("technologies"), _strings(p["bullets"]).alias("bullets")),
    )
    groups = F.when(_kind(r["skills"]) == "{", F.from_json(r["skills"], "map<string,array<string>>"))
    skills = F.when(groups.isNotNull(), F.filter(F.flatten(F.transform(F.map_values(groups), sets.none_as_empty)), lambda s: s.isNotNull() & (s != ""))).otherwise(_strings(r["skills"]))
    certs = F.filter(
        F.transform(_strings(F.when(_kind(r["certifications"]) == "{", F.concat(F.lit("["), r["certifications"], F.lit("]"))).otherwise(r["certifications"])),
                    lambda s: F.when(_kind(s) == "{", F.coalesce(F.get_json_object(s, "$.name"), F.get_json_object(s, "$.title"))).otherwise(s)),
        lambda s: s.isNotNull() & (s != ""),
    )
    out = (
        resumes.withColumn("_r", F.from_json(c, _SHAPE))
        .withColumn("summary", F.coalesce(r["professional_summary"], r["summary"]))
        .withColumn("positions", positions)
        .withColumn("projects", projects)
        .withColumn("skills", skills)
        .withColumn("skill_groups", groups)
        .withColumn("certs", certs)
        .withColumn("section_order", F.from_json(F.when(_kind(r["section_order"]) == "[", r["section_order"]), "array<string>"))
        .withColumn("font_family", r["font_family"])
    )
    return out.withColumn("titles", F.filter(F.transform("positions", lambda p: p["title"]), lambda t: t.isNotNull())).withColumn(
        "bullets", F.flatten(F.concat(F.transform("positions", lambda p: p["bullets"]), F.transform("projects", lambda p: p["bullets"])))
    ).drop("_r")


def all_skills(d: DataFrame) -> Column:
    """Skills and certificates of parsed()."""
    return F.concat("skills", "certs")


# --- style ----------------------------------------------------------------------------------------------------------------

# What looks like a figure in a bullet, and the characters that open one.
METRIC = r"\d+[%x]?|\$[\d,]+|\d+\.\d+"
BULLETS = ("•", "●", "-", "*", "—")
SECTIONS = (
    "personal_info", "professional_summary", "work_experience", "education", "certifications", "skills", "projects", "awards",
    "publications", "volunteer", "languages",
)


def _share(items: Column, test) -> Column:  # noqa: ANN001
    """Part of the items that pass; null for none."""
    return F.when(F.size(items) > 0, F.size(F.filter(items, test)) / F.size(items))


def _opens(b: Column, ch: str) -> Column:
    return F.coalesce(F.startswith(stripped(b), F.lit(ch)), F.lit(False))


def _opening(bullets: Column, ch: str) -> Column:
    """Number of bullets that ch opens."""
    return F.size(F.filter(bullets, lambda b: _opens(b, ch)))


def _bare(b: Column) -> Column:
    """The bullet without the character that opens it."""
    out = stripped(b)
    return F.coalesce(*[F.when(_opens(b, ch), stripped(F.substring(out, 2, 1 << 30))) for ch in BULLETS], out)


def style(bullets: Column, text: Column) -> Column:
    """Fingerprint of the style of bullets and of all text.

    Without bullets: moderate, 0 words, light, no bullet character, upper, no trailing period.
    """
    words = F.transform(F.filter(bullets, lambda b: F.length(stripped(b)) > 0), lambda b: F.size(F.split(stripped(b), r"\s+")))
    n = F.size(words)
    mean = F.when(n > 0, F.aggregate(words, F.lit(0), lambda a, x: a + x) / n).otherwise(0.0)
    metric = F.coalesce(_share(bullets, lambda b: b.rlike(METRIC)), F.lit(0.0))
    counts = [_opening(bullets, ch) for ch in BULLETS]
    most = F.greatest(*counts)
    letters = F.filter(F.transform(bullets, lambda b: F.substring(_bare(b), 1, 1)), lambda x: x != "")
    upper = F.coalesce(_share(letters, lambda x: x.rlike(r"\p{Lu}")) > 0.80, F.lit(True))
    return F.struct(
        voice(text).alias("voice"),
        F.when((n == 0) | ((mean > 12) & (mean <= 20)), "moderate").when(mean <= 12, "punchy").otherwise("detailed").alias("sentences"),
        F.round(mean, 1).alias("avg_words"), F.coalesce(F.array_min(words), F.lit(0)).alias("min_words"), F.coalesce(F.array_max(words), F.lit(0)).alias("max_words"),
        F.when(metric > 0.40, "heavy").when(metric >= 0.20, "moderate").otherwise("light").alias("metric_density"), F.round(metric, 4).alias("metric_ratio"),
        F.coalesce(*[F.when((most > 0) & (k == most), F.lit(ch)) for k, ch in zip(counts, BULLETS)], F.lit("none")).alias("bullet_char"),
        F.when(upper, "upper").otherwise("lower").alias("capitalization"),
        F.coalesce(_share(bullets, lambda b: F.regexp_replace(b, r"\s+$", "").endswith(".")) > 0.60, F.lit(False)).alias("trailing_period"),
        F.size(bullets).alias("n_bullets"),
    )


# --- checks of changed texts -------------------------------------------------------------------------------------------

# Words unfit for a resume, empty phrases, limits of length, the pattern of figures that must stay.
UNFIT = (
    "amazing", "awesome", "crushed", "killed", "smashed", "slayed", "rockstar", "ninja", "guru", "wizard", "badass", "epic", "insane",
    "literally", "basically", "totally", "super", "mega",
)
FILLERS = ("responsible for", "duties included", "worked on", "helped with", "assisted in", "participated in")
BULLET_WORDS, SUMMARY_WORDS = (5, 30), (15, 100)
FIGURES = r"(\d+\.?\d*\s*%?)"
TOKENS = r"([A-Za-z][A-Za-z0-9+#./\-]{2,})"
# Words that are no skill.
COMMON_WORDS = (
    "developed", "implemented", "designed", "built", "created", "managed", "led", "architected", "optimised", "optimized", "improved", "delivered",
    "deployed", "maintained", "integrated", "automated", "reduced", "increased", "collaborated", "leveraged", "utilized", "utilised", "contributed",
    "supported", "established", "streamlined", "migrated", "refactored", "ensured", "monitored", "diagnosed", "resolved", "documented", "tested",
    "reviewed", "analysed", "analyzed", "enhanced", "expanded", "launched", "senior", "junior", "lead", "principal", "engineer", "developer",
    "application", "applications", "system", "systems", "service", "services", "solution", "solutions", "platform", "infrastructure", "performance",
    "scalable", "robust", "reliable", "efficient", "modern", "best", "practices", "patterns", "standards", "processes", "workflow", "workflows",
    "the", "and", "for", "with", "using", "via", "across", "within", "including", "through", "resulting", "enabling", "achieving", "rest", "api",
    "apis", "sdk", "sdks", "oop", "tdd", "bdd", "cli", "ide", "saas", "paas", "iaas", "http", "https", "json", "xml", "csv", "sql", "nosql", "orm",
    "mvc", "mvp", "mvvm", "spa", "ssr",
)


def new_skills(original: Column, modified: Column, known: Column) -> Column:
    """Words of modified that look like a skill and are neither in original nor known nor common; five, sorted.

    A word looks like a skill with a digit, or with a capital and over four characters.
    """
    tokens = F.array_distinct(F.regexp_extract_all(modified, F.lit(TOKENS), 1))
    old = F.transform(F.regexp_extract_all(original, F.lit(TOKENS), 1), F.lower)
    known_low = F.transform(F.filter(sets.none_as_empty(known), lambda s: s.isNotNull()), F.lower)
    common = words_array(COMMON_WORDS)
    fresh = F.filter(tokens, lambda t: ~F.array_contains(old, F.lower(t)) & ~F.array_contains(known_low, F.lower(t)) & ~F.array_contains(common, F.lower(t)))
    return F.slice(F.array_sort(F.filter(fresh, lambda t: t.rlike(r"\d") | (t.rlike("^[A-Z]") & (F.length(t) > 4)))), 1, 5)


def figures_lost(original: Column, modified: Column) -> Column:
    """Whether a figure of original isn't in modified."""
    return F.size(F.array_except(F.regexp_extract_all(original, F.lit(FIGURES), 1), F.regexp_extract_all(modified, F.lit(FIGURES), 1))) > 0


def accepted(original: Column, modified: Column) -> Column:
    """The changed text, or the original where nothing came back or a figure was lost."""
    return F.when(F.coalesce(F.length(stripped(modified)), F.lit(0)) == 0, original).when(figures_lost(original, modified), original).otherwise(modified)


def merged_bullets(old: Column, new: Column) -> Column:
    """Bullets of each position of old, changed as new has them where that is accepted; places that new lacks stay.

    Each is a struct(original, bullet, rejected).
    """

    def one(o: Column, m: Column) -> Column:
        rejected = F.coalesce((o != m) & figures_lost(o, m), F.lit(False))
        return F.struct(o.alias("original"), accepted(o, m).alias("bullet"), rejected.alias("rejected"))

    def position(a: Column, b: Column) -> Column:
        there = sets.none_as_empty(b["bullets"])
        return F.slice(F.zip_with(a["bullets"], there, one), 1, F.size(a["bullets"]))

    return F.flatten(F.slice(F.zip_with(old, new, position), 1, F.size(old)))


def _checks(original: Column, modified: Column, known: Column | None, least: int, most: int, bullet: bool) -> Column:
    n = F.when(F.length(stripped(modified)) > 0, F.size(F.split(stripped(modified), r"\s+"))).otherwise(0)
    low = F.lower(modified)
    named = {
        "figures removed": figures_lost(original, modified) if bullet else F.lit(False),
        "too short": n < least, "too long": n > most,
        "unfit word": F.exists(words_array(UNFIT), lambda w: F.contains(low, w)),
        "filler phrase": F.exists(words_array(FILLERS), lambda w: F.contains(low, w)) if bullet else F.lit(False),
        "new skill": F.size(new_skills(original, modified, known)) > 0 if known is not None else F.lit(False),
        "empty": n == 0,
    }
    return F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in named.items()]), lambda w: w.isNotNull())


def check_bullet(original: Column, modified: Column, known: Column | None = None) -> Column:
    """Warnings of a changed bullet, whether it is valid, and its score (20 off for each warning)."""
    w = _checks(original, modified, known, *BULLET_WORDS, bullet=True)
    return F.struct(w.alias("warnings"), (F.size(w) == 0).alias("is_valid"), F.greatest(F.lit(0), 100 - 20 * F.size(w)).alias("score"))


def check_summary(original: Column, modified: Column, known: Column | None = None) -> Column:
    """The same for a summary, without figures and fillers."""
    w = _checks(original, modified, known, *SUMMARY_WORDS, bullet=False)
    return F.struct(w.alias("warnings"), (F.size(w) == 0).alias("is_valid"), F.greatest(F.lit(0), 100 - 20 * F.size(w)).alias("score"))


# --- tailoring --------------------------------------------------------------------------------------------------------------


def keyword_hits(text: Column, words: Column) -> Column:
    """Number of words (distinct, any case) that text contains."""
    low = F.lower(text)
    return F.size(F.filter(F.array_distinct(F.transform(sets.none_as_empty(words), F.lower)), lambda w: F.contains(low, w)))


def best_projects(projects: Column, words: Column, n: int = 3) -> Column:
    """The n projects with most of the words in name, description and technologies; ties stay in order."""
    text = lambda p: F.concat_ws(" ", p["name"], p["description"], F.array_join(p["technologies"], " "))
    ranked = F.array_sort(F.transform(projects, lambda p, i: F.struct((-keyword_hits(text(p), words)).alias("r"), i.alias("i"), p.alias("p"))))
    return F.transform(F.slice(ranked, 1, n), lambda x: x["p"])


def best_bullets(bullets: Column, words: Column, n: int = 10) -> Column:
    """Places (from 0) of the n bullets with most of the words; ties by place; in the bullets' order."""
    ranked = F.array_sort(F.transform(bullets, lambda b, i: F.struct((-keyword_hits(b, words)).alias("r"), i.alias("i"))))
    return F.array_sort(F.transform(F.slice(ranked, 1, n), lambda x: x["i"]))


def _fresh(skills: Column, words: Column, text: Column) -> Column:
    low, have = F.lower(text), sets.lowered(skills)
    wanted = F.filter(sets.none_as_empty(words), lambda w: w.isNotNull())
    return F.filter(wanted, lambda w, i: F.contains(low, F.lower(w)) & ~F.array_contains(have, F.lower(w)) & (F.array_position(sets.lowered(wanted), F.lower(w)) == i + 1))


def promoted(skills: Column, words: Column, text: Column) -> Column:
    """Skills with the words that text contains and skills lack (any case), in the words' order."""
    return F.concat(skills, _fresh(skills, words, text))


# The categories that take new skills, the first that a resume has; else one of this name is added.
CATEGORIES = ("Frameworks and Libraries", "Frameworks", "Tools", "Technologies", "Libraries")
OTHER_CATEGORY = "Additional Skills"


def promoted_groups(groups: Column, words: Column, text: Column) -> Column:
    """N04 for skills by category (map): new words go to the first of CATEGORIES that is there, else to OTHER_CATEGORY."""
    have = F.filter(F.flatten(F.transform(F.map_values(groups), sets.none_as_empty)), lambda s: s.isNotNull())
    names = F.map_keys(groups)
    target = F.coalesce(F.try_element_at(F.filter(words_array(CATEGORIES), lambda c: F.array_contains(names, c)), F.lit(1)), F.lit(OTHER_CATEGORY))

    def grown(x: Column) -> Column:
        there = F.transform_values(groups, lambda k, v: F.when(k == x["target"], F.concat(sets.none_as_empty(v), x["new"])).otherwise(v))
        return F.when(F.size(x["new"]) == 0, groups).when(F.array_contains(names, x["target"]), there).otherwise(F.map_concat(groups, F.create_map(x["target"], x["new"])))

    return bound(F.struct(_fresh(have, words, text).alias("new"), target.alias("target")), grown)


def tailored_skills(skills: Column, groups: Column, words: Column, text: Column) -> Column:
    """Promoted skills with the wanted ones first, within each category for skills by category (groups not null)."""
    by = F.transform_values(promoted_groups(groups, words, text), lambda _, v: sets.first_matching(v, words))
    return F.when(groups.isNotNull(), F.flatten(F.transform(F.map_values(by), sets.none_as_empty))).otherwise(sets.first_matching(promoted(skills, words, text), words))


def coverage(text: Column, words: Column) -> Column:
    """Per cent of the words (any case) that text contains, one decimal; 0 without words."""
    low, w = F.lower(F.coalesce(text, F.lit(""))), sets.none_as_empty(words)
    return bound(low, lambda t: F.when(F.size(w) > 0, F.round(F.size(F.filter(w, lambda x: F.contains(t, F.lower(x)))) / F.size(w) * 100, 1)).otherwise(0.0))


def years_of_experience(positions: Column) -> Column:
    """Sum over positions of last less first four-digit number of their dates; fewer than two count nothing."""
    found = F.transform(positions, lambda p: F.regexp_extract_all(p["dates"], F.lit(r"(\d{4})"), 1))
    span = lambda y: F.when(F.size(y) >= 2, F.abs(F.element_at(y, -1).cast("int") - F.element_at(y, 1).cast("int"))).otherwise(0)
    return F.aggregate(found, F.lit(0), lambda a, y: a + span(y))
