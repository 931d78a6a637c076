"""Sets and ordered lists of skills as Column expressions on arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import normalise_skill, words_map

# Other names of a skill with the name it counts under, one step only; three pairs point both ways.
SYNONYMS = {
    "js": "javascript", "ts": "typescript", "py": "python", "rb": "ruby", "golang": "go", "cplusplus": "c++", "csharp": "c#",
    "reactjs": "react", "react.js": "react", "vuejs": "vue", "vue.js": "vue", "angularjs": "angular", "nodejs": "node.js",
    "node js": "node.js", "rubyonrails": "rails", "ruby on rails": "rails", "springboot": "spring boot",
    "amazon web services": "aws", "microsoft azure": "azure", "google cloud platform": "gcp", "google cloud": "gcp",
    "postgresql": "postgres", "microsoft sql server": "sql server", "mssql": "sql server", "mongo": "mongodb", "elastic": "elasticsearch",
    "kubernetes": "k8s", "k8s": "kubernetes", "docker swarm": "docker", "gitlab ci/cd": "gitlab ci", "github action": "github actions",
    "scikit learn": "scikit-learn", "sklearn": "scikit-learn", "tensor flow": "tensorflow", "pytorch": "torch", "torch": "pytorch",
    "natural language processing": "nlp", "machine learning": "ml", "ml": "machine learning", "deep learning": "dl", "ai": "artificial intelligence",
    "ci/cd": "cicd", "ci cd": "cicd", "continuous integration": "cicd", "continuous deployment": "cicd", "agile/scrum": "agile",
    "rest api": "rest", "restful api": "rest", "restful": "rest", "nosql": "no-sql", "no sql": "no-sql",
    "aws sa": "aws solutions architect", "cka": "certified kubernetes administrator", "ckad": "certified kubernetes application developer",
}


def none_as_empty(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def canonical(skill: Column, extra: dict[str, str] | None = None) -> Column:
    """The name a normalised skill counts under, one step; extra synonyms (X08) win. Unknown ones stay."""
    return F.coalesce(F.try_element_at(words_map(SYNONYMS | (extra or {})), skill), skill)


def expanded(skills: Column, extra: dict[str, str] | None = None) -> Column:
    """Each skill's normal form, its canonical name and that without - and /; distinct, in order. Null skills are left out."""

    def forms(s: Column) -> Column:
        n = normalise_skill(s)
        c = canonical(n, extra)
        plain = F.regexp_replace(F.regexp_replace(c, "[-/]", " "), r"^\s+|\s+$", "")
        return F.array(n, c, plain)

    return F.array_distinct(F.flatten(F.transform(F.filter(none_as_empty(skills), lambda s: s.isNotNull()), forms)))


def lowered(skills: Column) -> Column:
    return F.transform(none_as_empty(skills), F.lower)


def merged(existing: Column, incoming: Column) -> Column:
    """Existing skills, then incoming ones not yet there in any case; null if both are empty.

    With no existing skills, incoming ones come as they are; empty and null incoming ones are left out.
    """
    new = F.filter(none_as_empty(incoming), lambda s: s.isNotNull() & (s != ""))
    old = none_as_empty(existing)
    fresh = F.filter(new, lambda s, i: ~F.array_contains(lowered(old), F.lower(s)) & (F.array_position(lowered(new), F.lower(s)) == i + 1))
    return F.when(F.size(new) == 0, F.when(F.size(old) > 0, old)).when(F.size(old) == 0, new).otherwise(F.concat(old, fresh))


def first_matching(items: Column, wanted: Column) -> Column:
    """Items that are wanted first (any case), the rest after them, both in their order."""
    want = lowered(wanted)
    hit = lambda s: F.coalesce(F.array_contains(want, F.lower(s)), F.lit(False))
    return F.concat(F.filter(none_as_empty(items), hit), F.filter(none_as_empty(items), lambda s: ~hit(s)))


def in_order(keys: Column, order: Column) -> Column:
    """Keys that order names come first, as it names them, the rest after them."""
    return F.array_union(F.array_intersect(none_as_empty(order), keys), keys)


def share_of(wanted: Column, have: Column, weights: Column | None = None) -> Column:
    """Per cent of wanted that have holds, by weights (map, 1 where absent); 0 for nothing wanted, 100 at most."""
    if weights is None:
        n = F.size(wanted)
        return F.when(n > 0, F.size(F.array_intersect(wanted, have)) / n * 100.0).otherwise(F.lit(0.0))
    w = lambda s: F.coalesce(F.try_element_at(weights, s), F.lit(1.0))
    total = F.aggregate(wanted, F.lit(0.0), lambda a, s: a + w(s))
    got = F.aggregate(F.array_intersect(wanted, have), F.lit(0.0), lambda a, s: a + w(s))
    return F.when(total != 0, F.least(got / total * 100.0, F.lit(100.0))).otherwise(F.lit(0.0))
