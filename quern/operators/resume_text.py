"""Resumes as plain text: personal details and the entries of their sections."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import EMAIL, GITHUB, LINKEDIN, PHONE
from quern.operators.extract import RESUME_HEADS

# Heads of sections without entries of their own; what marks dates, degrees, years and places.
OTHER_HEADS = "ACADEMIC BACKGROUND"
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
DATES = re.compile(rf"\b(?:{MONTHS}|\d{{4}}).*(?:{MONTHS}|\d{{4}}|Present|Current)\b", re.I)
DEGREE = re.compile(r"\b(bachelor|master|phd|doctorate|associate|b\.s|m\.s|b\.a|m\.a|mba)\b", re.I)
YEAR = re.compile(r"\b(?:19|20)\d{2}\b")
PLACE = re.compile(r"[A-Z][a-zA-Z ]+,\s*[A-Z]{2,}")
BULLETS = "•-*·"
_HEADS = {name: re.compile(rf"(?:{heads})\b", re.I) for name, heads in RESUME_HEADS.items()}
_OTHER = re.compile(rf"(?:{OTHER_HEADS})\b", re.I)
_PERSON = {"email": re.compile(EMAIL), "phone": re.compile(PHONE), "linkedin": re.compile(LINKEDIN), "github": re.compile(GITHUB)}

def _sections(lines: list[str]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    current: list[str] | None = None
    for line in lines:
        name = next((n for n, p in _HEADS.items() if p.match(line)), None)
        if name:
            current = out.setdefault(name, [])
        elif _OTHER.match(line):
            current = None
        elif current is not None:
            current.append(line)
    return out


def _grouped(lines: list[str], opens) -> Iterator[list[str]]:  # noqa: ANN001
    """Runs of lines that begin where opens(line, run so far) says so; lines before the first are left out."""
    run: list[str] = []
    for line in lines:
        if opens(line, run):
            if run:
                yield run
            run = [line]
        elif run:
            run.append(line)
    if run:
        yield run


def _bare(line: str) -> str:
    return line.lstrip(BULLETS + " ")


def _position(run: list[str]) -> dict:
    rest = run[2:]
    return {"title": run[1] if len(run) > 1 else "", "company": run[0], "dates": run[0], "bullets": [_bare(x) for x in rest if x[0] in BULLETS or len(x) > 20]}


def _school(run: list[str]) -> dict:
    years = (YEAR.search(x) for x in run[2:])
    return {"degree": run[0], "institution": run[1] if len(run) > 1 else "", "year": next((m[0] for m in years if m), "")}


def parse(text: str) -> dict:
    """Details and sections of one resume; a line that begins with a head opens its section.

    The name is the first of ten lines without address or number, the place the first of twenty that look like
    'Town, ST'. A position opens with a line of dates, its next line is the title; a school with a degree; a project with a short
    line without bullet. The summary is five lines at most. What is absent is '' or [].
    """
    lines = [x.strip() for x in text.splitlines()]
    top = "\n".join(lines[:30])
    found = {k: (m[0].strip() if (m := p.search(top)) else "") for k, p in _PERSON.items()}
    name = next((x for x in lines[:10] if x and not _PERSON["email"].search(x) and not _PERSON["phone"].search(x)), "")
    place = next((m[0] for x in lines[:20] if (m := PLACE.search(x))), "")
    s = _sections([x for x in lines if x])
    return {
        "personal_info": {"name": name, "location": place, **found},
        "summary": " ".join(s.get("summary", [])[:5]),
        "positions": [_position(r) for r in _grouped(s.get("experience", []), lambda x, _: bool(DATES.search(x)))],
        "education": [_school(r) for r in _grouped(s.get("education", []), lambda x, _: bool(DEGREE.search(x)))],
        "certifications": [b for x in s.get("certifications", []) if (b := _bare(x))],
        "projects": [
            {"name": r[0], "description": " ".join(map(_bare, r[1:]))}
            for r in _grouped(s.get("projects", []), lambda x, run: not run or (x[0] not in BULLETS and len(x) < 60))
        ],
    }


_S = T.StringType()


def _struct(*names: str, **more: T.DataType) -> T.StructType:
    return T.StructType([*(T.StructField(n, _S) for n in names), *(T.StructField(n, t) for n, t in more.items())])


KIND = T.StructType([
    T.StructField("personal_info", _struct("name", "location", "email", "phone", "linkedin", "github")), T.StructField("summary", _S),
    T.StructField("positions", T.ArrayType(_struct("title", "company", "dates", bullets=T.ArrayType(_S)))),
    T.StructField("education", T.ArrayType(_struct("degree", "institution", "year"))),
    T.StructField("certifications", T.ArrayType(_S)), T.StructField("projects", T.ArrayType(_struct("name", "description"))),
])


@F.pandas_udf(KIND)
def _parsed(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(t or "") for t in texts], columns=KIND.names)


def parsed_text(text: Column) -> Column:
    """parse() of a column; null counts as ''."""
    return _parsed(text)
