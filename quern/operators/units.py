"""Quantities in different units, here pay, in one unit: problem 6.

Conversions are edges between units with affine functions y = a x + b. The shortest compositions from every
unit to the canonical one are worked out once, cycles are checked to be the identity, and amounts are
converted by an equi-join on their source unit. Scales (thousand, lakh) are units like others.
"""

from __future__ import annotations

import re
from collections import deque
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.chars import MAY_CHANGE, char_class, visible
from quern.session import heavy, table

MOST_UNITS = 10_000

Edge = tuple[str, str, float, float]


def compose(edges: list[Edge], target: str, tolerance: float = 1e-9) -> list[tuple[str, float, float, int]]:
    """(unit, a, b, steps) for each unit that reaches target: the affine function of its shortest path.

    edges: (source, target, a, b) for target = a * source + b; each also counts backwards. Raises ValueError
    when two ways between the same units differ by more than tolerance (relative), or a is 0 or not finite.
    Units that do not reach target are left out. No edges give the target alone. Repeated edges are one.
    """
    if len(edges) > MOST_UNITS:
        raise ValueError(f"over {MOST_UNITS} conversions")
    near: dict[str, list[tuple[str, float, float]]] = {target: []}
    for src, dst, a, b in edges:
        if not a or a != a or abs(a) == float("inf"):
            raise ValueError(f"{src} to {dst} can't be undone: factor {a}")
        near.setdefault(src, []).append((dst, a, b))
        near.setdefault(dst, []).append((src, 1 / a, -b / a))
    # out[u] takes u to target; breadth first, so each path is a shortest one
    out, queue = {target: (1.0, 0.0, 0)}, deque([target])
    while queue:
        at = queue.popleft()
        a0, b0, n = out[at]
        for to, a, b in near[at]:  # at = (to - b) / a, then a0 * at + b0
            if to not in out:
                out[to] = (a0 / a, b0 - a0 * b / a, n + 1)
                queue.append(to)
    for src, dst, a, b in edges:
        if src in out and dst in out:
            x, y = out[src], out[dst]
            if abs(x[0] - y[0] * a) > tolerance * abs(x[0]) or abs(x[1] - (y[0] * b + y[1])) > tolerance * max(1, abs(x[1])):
                raise ValueError(f"the cycle through {src} and {dst} isn't the identity")
    return [(u, a, b, n) for u, (a, b, n) in sorted(out.items())]


def pay_edges(factors: list[tuple[str, str, float]]) -> list[Edge]:
    """Edges between units of pay 'currency/period' and 'currency/period/scale': scaled amounts to plain ones, an amount a period
    to one a year, a currency to USD."""
    money, spans, scales = ([(c, f) for k, c, f in factors if k == kind] for kind in ("currency", "period", "scale"))
    scaled = [(f"{m}/{p}/{s}", f"{m}/{p}", f, 0.0) for m, _ in money for p, _ in spans for s, f in scales]
    per = [(f"{m}/{p}", f"{m}/year", f, 0.0) for m, _ in money for p, f in spans if p != "year"]
    return scaled + per + [(f"{m}/year", "USD/year", f, 0.0) for m, f in money if m != "USD"]


# The forms in which units are written, by code of unit_factors. A code that isn't here is written as itself.
CURRENCIES = {
    "CAD": ("CAD", "C$", "CA$", "Canadian dollars?"), "AUD": ("AUD", "A$", "AU$", "Australian dollars?"),
    "USD": ("USD", "US$", "$", "(?:US )?dollars?"), "EUR": ("EUR", "€", "euros?"), "GBP": ("GBP", "£", "pounds?(?: sterling)?"),
    "CHF": ("CHF", "(?:Swiss )?francs?", r"SFr\.?", r"Fr\."), "INR": ("INR", "₹", r"Rs\.?", "rupees?"), "SEK": ("SEK", "(?:Swedish )?kron(?:or|a)", "kr"),
}
PERIODS = {
    "hour": r"hourly|hours?|hrs?|p/?h|/h|p\.h\.|stunden?|stündlich|std\.?|heures?|horas?",
    "day": r"daily|days?|p/?d|/d|p\.d\.|per diem|tage?|täglich|jours?|días?",
    "week": r"weekly|weeks?|wks?|p/?w|p\.w\.|wochen?|wöchentlich|semaines?|semanas?",
    "month": r"monthly|months?|mos?|p/?m|p\.m\.|pcm|monate?|monatlich|mois|meses|mes",
    "year": r"yearly|annual(?:ly)?|annum|years?|yrs?|p/?a|p\.a\.|lpa|jahre?|jährlich|(?:par|/) ?ans?|année|años?",
}
SCALES = {"k": "k|thousand|tausend|mille", "m": "m|mn|million", "lakh": "lakhs?|lpa|l"}
SIGNS = "$€£₹"
WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
    "seventeen eighteen nineteen"
).split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()

_LEFT, _RIGHT = r"(?<![^\W\d_])", r"(?![^\W\d_])"
_NUMBER_WORD = re.compile(rf"{_LEFT}(?:(?:{'|'.join(TENS)})(?:[- ](?:{'|'.join(WORDS[1:10])}))?|{'|'.join(WORDS)}){_RIGHT}(?: hundred)?", re.I)
_VALUE = r"\d{1,3}(?:[ ,.'’]\d{2,3})+(?:[.,]\d{1,2})?(?!\d)|\d+(?:[.,]\d+)?"
# what carries figures and is no pay
_ASIDE = re.compile(
    r"\([^)]*\)|\d+(?:[.,]\d+)? ?%(?: bonus)?|\+ ?bonus.*$|\bplus\b.*$|\band \d+ .*$|\+.*$"
    r"|^\s*(?:ref|grade|level|band|job|id|step|tier|class)\b\.?:? ?[\w/.-]*\s*(?:[|·:–—-]\s*|$)", re.I)  # fmt: skip
_DASH = re.compile(f"[{char_class('2010-2015')}]")


def number(text: str, scale: str = "") -> Decimal:
    """A figure with ',', '.', ''' or spaces between thousands and ',' or '.' before decimals.

    The last ',' or '.' with one or two digits after it is the decimal sign, with three digits a thousands sign.
    A leading 0 (0.051), or a scale over a thousand after it (2.146M), makes it a decimal sign too.
    """
    s = re.sub(r"[ '’]", "", text)
    m = re.fullmatch(r"(.*)[.,](\d+)", s)
    if not m:
        return Decimal(s)
    head, tail = m.groups()
    whole = re.sub(r"[.,]", "", head)
    if len(tail) != 3 or whole in ("", "0") or (scale[:1] in ("m", "l") and head.isdigit()):
        return Decimal(f"{whole or 0}.{tail}")
    return Decimal(whole + tail)


def _words_to_figures(text: str) -> str:
    def figure(m: re.Match) -> str:
        n = 0
        for w in re.split(r"[- ]", m.group().lower()):
            n = n * 100 if w == "hundred" else n + (WORDS.index(w) if w in WORDS else 10 * (TENS.index(w) + 2))
        return str(n)

    return _NUMBER_WORD.sub(figure, text)


# Codes of currencies (ISO 4217), but for ALL, TOP and TRY, which are words as well.
ISO_CODES = (
    "AED AFN AMD AOA ARS AUD AWG AZN BAM BBD BDT BGN BHD BIF BMD BND BOB BRL BSD BTN BWP BYN BZD CAD CDF CHF CLP CNY COP CRC CUP CVE CZK DJF DKK "
    "DOP DZD EGP ERN ETB EUR FJD FKP GBP GEL GHS GIP GMD GNF GTQ GYD HKD HNL HTG HUF IDR ILS INR IQD IRR ISK JMD JOD JPY KES KGS KHR KMF KPW KRW "
    "KWD KYD KZT LAK LBP LKR LRD LSL LYD MAD MDL MGA MKD MMK MNT MOP MRU MUR MVR MWK MXN MYR MZN NAD NGN NIO NOK NPR NZD OMR PAB PEN PGK PHP PKR "
    "PLN PYG QAR RON RSD RUB RWF SAR SBD SCR SDG SEK SGD SHP SLE SOS SRD SSP STN SVC SYP SZL THB TJS TMT TND TTD TWD TZS UAH UGX USD UYU UZS VES "
    "VND VUV WST XAF XCD XOF XPF YER ZAR ZMW"
).split()
_ISO = frozenset(ISO_CODES)
_SIGN = re.compile(f"[{char_class('00A2-00A5 058F-058F 060B-060B 09F2-09F3 0E3F-0E3F 17DB-17DB 20A0-20C0')}]")

# a sentence that says how pay is counted: it speaks of pay and holds no figure
_CUE = re.compile(r"\b(?:pay|paid|earn(?:ings)?|salar(?:y|ies)|money|amounts?|rates?|range|figures|wages?|compensation|remuneration)\b", re.I)
_NO_CUE = re.compile(r"\d|bonus|\bsign-on|travel|voucher|turned over|turnover", re.I)

Pay = tuple[str | None, str | None, str | None, str | None, str | None, str | None]
NO_PAY: Pay = (None,) * 6


class Units:
    """Reads amounts and units out of text, those of the forms above and others of factors (kind, code, factor)."""

    def __init__(self, factors: list[tuple[str, str, float]]) -> None:
        codes = {kind: [c for k, c, _ in factors if k == kind] for kind in ("currency", "period", "scale")}
        self.scale = {c: f for k, c, f in factors if k == "scale"}
        forms = {c: (re.escape(c),) for c in codes["currency"] if c not in CURRENCIES} | CURRENCIES
        named = {c: [f for f in fs if f[-1] not in SIGNS] for c, fs in forms.items()}
        periods = {c: rf"{re.escape(c)}(?:s|ly)?" for c in codes["period"] if c not in PERIODS} | PERIODS
        words = {c: re.escape(c) for c in codes["scale"] if c not in SCALES} | SCALES | {"crore": "crores?"}
        self.codes = {"c": list(forms), "p": list(periods), "s": list(words)}
        either = lambda c: "|".join([f"{_LEFT}(?:{'|'.join(named[c])}){_RIGHT}", *(re.escape(f) for f in forms[c] if f[-1] in SIGNS)])
        self.currency = self._pattern([f"(?P<c{i}>{either(c)})" for i, c in enumerate(forms)])
        self.named = re.compile(f"{_LEFT}(?:{'|'.join(f for fs in named.values() for f in fs) or '(?!)'}){_RIGHT}", re.I)
        #: What a description without other letters than these of plain Latin writing must match to be worth reading.
        self.may_say = "(?i)(?<![a-z])(?:" + ("|".join(f for fs in named.values() for f in fs) or "(?!)") + ")(?![a-z])"
        self.period = self._pattern([f"(?P<p{i}>{_LEFT}(?:{p}){_RIGHT})" for i, p in enumerate(periods.values())])
        scales = "|".join(f"(?P<s{i}>{w})" for i, w in enumerate(words.values()))
        self.amount = re.compile(rf"(?<![\w.,])(?P<v>{_VALUE}) ?(?P<s>{scales})?(?![^\W_])", re.I)

    @staticmethod
    def _pattern(forms: list[str]) -> re.Pattern:
        return re.compile("|".join(forms) or "(?!)", re.I)

    def _first(self, pattern: re.Pattern, text: str) -> str | None:
        m = pattern.search(text)
        return self.codes[m.lastgroup[0]][int(m.lastgroup[1:])] if m else None

    def _scale(self, m: re.Match) -> str | None:
        return next((c for i, c in enumerate(self.codes["s"]) if m[f"s{i}"]), None) if m["s"] else None

    def _size(self, value: Decimal, scale: str | None) -> float:
        return float(value) * self.scale.get(scale, 1.0)

    def _foreign(self, text: str) -> str | None:
        """A currency that no form stands for: a sign, or a code of ISO_CODES, beside an amount."""
        for m in self.amount.finditer(text):
            before, after = text[: m.start()].rstrip()[-3:], text[m.end() :].lstrip()[:3]
            sign = _SIGN.match(before[-1:]) or _SIGN.match(after[:1])
            code = next((c for c in (before, after) if c in _ISO), None)
            if sign or code:
                return sign.group() if sign else code
        return None

    def _inherits(self, value: Decimal, after: tuple[Decimal, str | None] | None) -> bool:
        """Whether an amount without scale has that of the next: if that brings the two nearer to each other."""
        if not after or not after[1] or not value or not after[0]:
            return False
        apart = lambda x: max(x, 1 / x)
        ratio = float(value / after[0])
        return apart(ratio) <= apart(ratio / self.scale.get(after[1], 1.0))

    def pay(self, text: str | None) -> Pay | None:
        """(low, low's scale, high, high's scale, currency, period) as written; None without an amount of pay.

        Of more than two amounts the least and the greatest count. An amount without a scale has that of the next one where
        that brings the two nearer to each other. Percentages, bonuses, days of leave, text in brackets and leading grades or references are left
        out. A currency or scale that no code stands for comes out as written. Null, empty and wordless texts give None.
        """
        if not text:
            return None
        s = _words_to_figures(" ".join(_DASH.sub("-", visible(text)).split()))
        while (t := _ASIDE.sub(" ", s).strip()) != s:
            s = t
        bare = self.currency.sub(lambda m: " " * len(m.group()), s)
        found = [(number(m["v"], (m["s"] or "").lower()), self._scale(m), m) for m in self.amount.finditer(bare)]
        if not found:
            return None
        rest = s
        for _, _, m in reversed(found):  # units are looked for outside the figures
            rest = rest[: m.start("v")] + " " + ("a year INR" if (m["s"] or "").lower() == "lpa" else "") + " " + (rest[m.end() :] if m["s"] else rest[m.end("v") :])
        ends, after = [], None
        for value, scale, _ in reversed(found):
            after = (value, after[1] if not scale and self._inherits(value, after) else scale)
            ends.append(after)
        low, high = (f(reversed(ends), key=lambda e: self._size(*e)) for f in (min, max))
        currency, period = self._first(self.currency, rest), self._first(self.period, self.currency.sub(" ", rest))
        if period is None and re.search(r"lakh|lpa", s, re.I):
            period = "year"
        return str(low[0]), low[1], str(high[0]), high[1], currency or self._foreign(bare), period

    def said(self, text: str | None) -> tuple[str | None, str | None]:
        """(currency, period) that a description gives for its pay. Later sentences fill what earlier ones lack."""
        currency = period = None
        for s in re.split(r"(?<=[.!?])\s+|\n", visible(text or "")):
            if _CUE.search(s) and not _NO_CUE.search(s) and (m := self.named.search(s)):
                currency = currency or self._first(self.currency, m.group())
                if period is None:
                    period = self._first(self.period, self.currency.sub(" ", s))
        return currency, period


_PAY = T.StructType([T.StructField(c, T.StringType()) for c in ("low", "low_scale", "high", "high_scale", "currency", "period")])
_SAID = T.StructType([T.StructField(c, T.StringType()) for c in ("currency", "period")])
_units: dict[tuple, Units] = {}


def _reader(factors: list[tuple[str, str, float]]) -> Units:
    key = tuple(factors)
    if key not in _units:
        _units.clear()
        _units[key] = Units(factors)
    return _units[key]


def _each(kind: T.StructType, factors: list[tuple[str, str, float]], what: str, none: tuple):  # noqa: ANN202
    """The method what of Units over a column, each distinct value of a batch read once."""

    def over(texts: pd.Series) -> pd.DataFrame:
        codes, values = pd.factorize(texts)
        read = getattr(_reader(factors), what)
        rows = [read(v) or none for v in values] + [none]
        return pd.DataFrame([rows[c] for c in codes], columns=kind.names)

    over.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(over, kind)


def known_factors(factors: DataFrame) -> list[tuple[str, str, float]]:
    """Rows of unit_factors on the driver, those with a null left out; over MOST_UNITS raise ValueError."""
    rows = factors.select("kind", "code", "factor").dropna().distinct().limit(MOST_UNITS + 1).collect()
    if len(rows) > MOST_UNITS:
        raise ValueError(f"over {MOST_UNITS} units")
    return sorted(tuple(r) for r in rows)


def conversions(factors: DataFrame) -> DataFrame:
    """unit, a, b, steps to USD/year from unit_factors (kind, code, factor).

    Rows with a null are left out. The result has a row for each currency, period and scale, at most MOST_UNITS, else
    ValueError is raised; so broadcasting it is safe.
    """
    return factors.sparkSession.createDataFrame(compose(pay_edges(known_factors(factors)), "USD/year"), "unit string, a double, b double, steps int")


def amounts(jobs: DataFrame, factors: DataFrame) -> DataFrame:
    """id, low, high as written, unit and high_unit, low_usd, high_usd (null for a unit without conversion) of each row of
    jobs whose salary_range holds an amount of pay.

    A unit in salary_range counts first, then one job_description gives for the pay, then USD and year; a currency or scale that
    no code stands for is a unit of its own, without conversion. Rows without an amount, with null or blank salary_range,
    are left out. Ends are rounded half up to whole dollars, the smaller is low; repeated rows come out as often as they
    come in. One narrow pass and broadcast equi-joins on the source units: no shuffle, so no skew.
    """
    known = known_factors(factors)
    pay_of, said_of = _each(_PAY, known, "pay", NO_PAY), _each(_SAID, known, "said", (None, None))
    text = F.col("job_description")
    worth = text.rlike(_reader(known).may_say) | (F.octet_length(text) > F.length(text)) & text.rlike(MAY_CHANGE)
    unit = lambda scale: F.concat_ws("/", F.coalesce("currency", "said.currency", F.lit("USD")), F.coalesce("period", "said.period", F.lit("year")), scale)
    d = (
        jobs.where(F.col("salary_range").isNotNull())
        .select("id", "job_description", pay_of("salary_range").alias("p"))
        .where("p.low is not null")
        .select("id", "p.*", F.when((F.col("p.currency").isNull() | F.col("p.period").isNull()) & worth, text).alias("said"))
        .withColumn("said", said_of("said"))
        .select("id", "low", "high", unit("low_scale").alias("unit"), unit("high_scale").alias("high_unit"))
    )
    to = conversions(factors).drop("steps")
    for x, key in (("x", "unit"), ("y", "high_unit")):
        d = d.join(F.broadcast(to.toDF(key, f"{x}a", f"{x}b")), key, "left")
    x, y = (F.round(F.col(c).cast("double") * F.col(f"{k}a") + F.col(f"{k}b")).cast("long") for c, k in (("low", "x"), ("high", "y")))
    both = F.col("xa").isNotNull() & F.col("ya").isNotNull()
    return d.select("id", "low", "high", "unit", "high_unit", F.when(both, F.least(x, y)).alias("low_usd"), F.when(both, F.greatest(x, y)).alias("high_usd"))


def annual_pay(jobs: DataFrame, factors: DataFrame) -> DataFrame:
    """id, low_usd, high_usd of amounts() with a conversion."""
    return amounts(jobs, factors).where("low_usd is not null").select("id", "low_usd", "high_usd")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    jobs = heavy(spark, folder, "jobs", "id", "salary_range", "job_description")
    return annual_pay(jobs, table(spark, folder, "unit_factors")).withColumnRenamed("id", "job_id")


def p6_unknown(spark: SparkSession, folder: str) -> DataFrame:
    """The report of adverts whose pay is in a unit without conversion: job_id, low, high, unit."""
    jobs = heavy(spark, folder, "jobs", "id", "salary_range", "job_description")
    found = amounts(jobs, table(spark, folder, "unit_factors")).where("low_usd is null")
    return found.select(F.col("id").alias("job_id"), "low", "high", "unit")


def p6_units(spark: SparkSession, folder: str) -> DataFrame:
    """The composed conversions themselves."""
    return conversions(table(spark, folder, "unit_factors"))
