"""Skill lists compared: match, gap, categories and the weighted score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.sets import canonical, expanded, none_as_empty, share_of
from quern.functions.text import bound, normalise_skill, stripped, words_array
from quern.operators.extract import LEVEL_RANKS

# Weights of the score's parts; words that tell a level.
REQUIRED, PREFERRED, EXPERIENCE, EDUCATION, MOST_BONUS, BONUS = 0.40, 0.30, 0.20, 0.10, 5.0, 0.5
LEVEL_WORDS = {
    4: ("phd", "ph.d", "doctorate"), 3: ("master", "masters", "m.s.", "ms", "mba"),
    2: ("bachelor", "bachelors", "b.s.", "bs", "undergraduate"), 1: ("associate",),
}


def resume_side(skills: Column) -> Column:
    """What comparisons need of a resume's skills, worked out once a resume: n (raw), forms (T03), low, names (T02), rank."""
    raw = none_as_empty(skills)
    return F.struct(
        F.size(raw).alias("n"), expanded(raw).alias("forms"), F.transform(raw, lambda s: F.lower(stripped(s))).alias("low"),
        F.transform(raw, lambda s: canonical(normalise_skill(s))).alias("names"), education_rank(raw).alias("rank"),
    )


def advert_side(required: Column, preferred: Column, asked: Column, level: Column) -> Column:
    """What C02 needs of an advert, worked out once an advert. Null lists count as empty, a null level as none asked for."""
    none_asked = lambda s: F.when(s == "", s).otherwise(canonical(normalise_skill(s)))
    rank = F.coalesce(*[F.when(level == k, F.lit(v)) for k, v in LEVEL_RANKS.items()], F.when(level.isNotNull(), F.lit(2)))
    return F.struct(
        (F.size(none_as_empty(required)) > 0).alias("some_required"), expanded(required).alias("required"),
        (F.size(none_as_empty(preferred)) > 0).alias("some_preferred"), expanded(preferred).alias("preferred"),
        F.transform(none_as_empty(asked), none_asked).alias("asked"), rank.alias("rank"),
    )


def compared(some: Column, forms: Column, resume: Column, weights: Column | None = None) -> Column:
    """C01 of an advert's forms and resume_side(); some: whether anything is asked for."""
    none = F.array().cast("array<string>")
    pick = lambda a: F.when(some, F.array_sort(a)).otherwise(none)
    both = F.struct(F.array_intersect(forms, resume["forms"]).alias("in"), forms.alias("j"), resume["forms"].alias("r"), resume["n"].alias("n"), some.alias("some"))
    return bound(
        both,
        lambda x: F.struct(
            F.when(some, share_of(x["j"], x["in"], weights)).otherwise(F.lit(0.0)).alias("score"),
            pick(x["in"]).alias("matched"),
            pick(F.array_except(x["j"], x["in"])).alias("missing"),
            pick(F.array_except(x["r"], x["in"])).alias("additional"),
            F.when(some, F.size(x["j"])).otherwise(0).alias("n_job"),
            F.when(some, F.size(x["r"])).otherwise(x["n"]).alias("n_resume"),
        ),
    )


def skill_match(job: Column, resume: Column, weights: Column | None = None, extra: dict[str, str] | None = None) -> Column:
    """Score, matched, missing, additional (sorted) and sizes of the expanded sets of two skill lists.

    Nothing asked for (null or empty job) gives score 0, empty lists, 0 asked for and the length of the raw resume list.
    """
    side = F.struct(F.size(none_as_empty(resume)).alias("n"), expanded(resume, extra).alias("forms"))
    sides = F.struct((F.size(none_as_empty(job)) > 0).alias("some"), expanded(job, extra).alias("j"), side.alias("r"))
    return bound(sides, lambda x: compared(x["some"], x["j"], x["r"], weights))


def category_match(by_category: Column, resume: Column, weights: Column | None = None) -> Column:
    """Mean of the categories' shares, with weights (map, 1 where absent); categories without skills don't count."""
    w = (lambda e: F.coalesce(F.try_element_at(weights, e["c"]), F.lit(1.0))) if weights is not None else (lambda e: F.lit(1.0))

    def mean(scores: Column) -> Column:
        total = F.aggregate(scores, F.lit(0.0), lambda a, e: a + w(e))
        return F.when(total > 0, F.least(F.aggregate(scores, F.lit(0.0), lambda a, e: a + e["s"] * w(e)) / total, F.lit(100.0))).otherwise(F.lit(0.0))

    forms = F.filter(F.transform(F.map_entries(by_category), lambda e: F.struct(e["key"].alias("c"), expanded(e["value"]).alias("j"))), lambda e: F.size(e["j"]) > 0)
    scored = lambda x: F.transform(x["j"], lambda e: F.struct(e["c"].alias("c"), share_of(e["j"], x["r"]).alias("s")))
    return bound(bound(F.struct(forms.alias("j"), expanded(resume).alias("r")), scored), mean)


def education_rank(skills: Column) -> Column:
    """The highest level that a skill names by exactly one of its words; 0 if none does."""
    low = F.transform(none_as_empty(skills), F.lower)
    out = F.lit(0)
    for rank in sorted(LEVEL_WORDS):
        out = F.when(F.arrays_overlap(low, words_array(LEVEL_WORDS[rank])), rank).otherwise(out)
    return out


def _education_part(asked: Column, have: Column) -> Column:
    return F.when(asked.isNull() | (have >= asked), 100.0).when(have == asked - 1, 50.0).otherwise(0.0)


def _experience_part(asked: Column, names: Column) -> Column:
    each = F.transform(asked, lambda s: F.when(s == "", 75.0).when(F.array_contains(names, s), 100.0).otherwise(0.0))
    return F.when(F.size(each) > 0, F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / F.size(each)).otherwise(100.0)


def _no_advert(asked: Column | None = None, level: Column | None = None) -> Column:
    none = F.lit(None).cast("array<string>")
    return advert_side(none, none, none if asked is None else asked, F.lit(None).cast("string") if level is None else level)


def education_score(level: Column, skills: Column) -> Column:
    """100 without a level asked for or with at least it, 50 one level below, else 0."""
    return _education_part(_no_advert(level=level)["rank"], education_rank(skills))


def experience_score(asked: Column, skills: Column) -> Column:
    """Mean over the skills that years are asked of: 100 if the resume has it, 0 if not, 75 for '' (years in general).

    100 if nothing is asked.
    """
    return _experience_part(_no_advert(asked)["asked"], resume_side(skills)["names"])


def score_of(advert: Column, resume: Column) -> Column:
    """The weighted score of advert_side() for resume_side() with its parts, each rounded to two decimals.

    Without preferred skills their weight goes to the required ones. Each additional skill adds half a point, five at
    most; the total is 100 at most.
    """
    some = advert["some_preferred"]
    parts = F.struct(
        compared(advert["some_required"], advert["required"], resume).alias("req"), compared(some, advert["preferred"], resume).alias("pref"),
        _experience_part(advert["asked"], resume["names"]).alias("exp"), _education_part(advert["rank"], resume["rank"]).alias("edu"),
    )

    def weighed(x: Column) -> Column:
        req, pref, exp, edu = (x[k] for k in ("req", "pref", "exp", "edu"))
        raw = req["score"] * F.when(some, REQUIRED).otherwise(REQUIRED + PREFERRED) + pref["score"] * F.when(some, PREFERRED).otherwise(0.0) + exp * EXPERIENCE + edu * EDUCATION
        bonus = F.least(F.size(req["additional"]) * BONUS, F.lit(MOST_BONUS))
        return F.struct(
            F.round(F.least(raw + bonus, F.lit(100.0)), 2).alias("total"),
            F.round(req["score"], 2).alias("required"), F.round(pref["score"], 2).alias("preferred"),
            F.round(exp, 2).alias("experience"), F.round(edu, 2).alias("education"), F.round(bonus, 2).alias("bonus"),
            F.concat(req["matched"], pref["matched"]).alias("matched"), req["missing"].alias("missing"), req["additional"].alias("additional"),
            F.when(some, "").otherwise("preferred weight redistributed to required").alias("weight_note"),
        )

    return bound(parts, weighed)


def match_score(required: Column, preferred: Column, resume: Column, experience: Column, level: Column) -> Column:
    """score_of() from the lists themselves."""
    sides = F.struct(advert_side(required, preferred, experience, level).alias("a"), resume_side(resume).alias("r"))
    return bound(sides, lambda x: score_of(x["a"], x["r"]))


def has_skill(skill: Column, resume: Column, names: Column) -> Column:
    """Skill is in the resume: the same, the same canonical name, or, from four characters on, one in the other.

    resume: lower-case, stripped skills; names: their canonical names.
    """
    s = F.lower(F.regexp_replace(skill, r"^\s+|\s+$", ""))

    def found(x: Column) -> Column:
        near = F.exists(resume, lambda r: F.contains(r, x["s"]) | F.contains(x["s"], r))
        return F.array_contains(resume, x["s"]) | F.array_contains(resume, x["name"]) | F.array_contains(names, x["name"]) | ((F.length(x["s"]) >= 4) & near)

    return bound(F.struct(s.alias("s"), canonical(normalise_skill(skill)).alias("name")), found)


def skill_gap(required: Column, preferred: Column, resume: Column) -> Column:
    """C04 from the resume's skills themselves; see gap_for()."""
    return bound(resume_side(resume), lambda side: gap_for(required, preferred, side))


def gap_for(required: Column, preferred: Column, side: Column) -> Column:
    """What of an advert's lists a resume (resume_side()) has and lacks. 100 per cent if nothing is required; five gaps first."""
    n = F.size(none_as_empty(required))

    def split(x: Column) -> Column:
        mark = lambda a: F.transform(none_as_empty(a), lambda s: F.struct(s.alias("s"), has_skill(s, x["low"], x["names"]).alias("ok")))
        return F.struct(mark(required).alias("r"), mark(preferred).alias("p"))

    def sorted_out(x: Column) -> Column:
        pick = lambda a, ok: F.transform(F.filter(a, lambda m: m["ok"] == F.lit(ok)), lambda m: m["s"])
        return F.struct(pick(x["r"], True).alias("r"), pick(x["p"], True).alias("p"), pick(x["r"], False).alias("mr"), pick(x["p"], False).alias("mp"))

    def told(x: Column) -> Column:
        return F.struct(
            F.concat(x["r"], F.array_except(x["p"], x["r"])).alias("matched"),
            x["mr"].alias("missing_required"), x["mp"].alias("missing_preferred"),
            F.when(n > 0, F.round(F.size(x["r"]) / n * 100, 1)).otherwise(100.0).alias("match_percentage"),
            F.slice(x["mr"], 1, 5).alias("priority_gaps"),
        )

    return bound(bound(split(side), sorted_out), told)
