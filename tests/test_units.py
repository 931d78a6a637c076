import pytest

from quern.operators import units

FACTORS = [("currency", "USD", 1.0), ("currency", "EUR", 1.08), ("currency", "INR", 0.012), ("currency", "CHF", 1.12), ("currency", "CAD", 0.74), ("period", "hour", 2080.0),
           ("period", "day", 260.0), ("period", "week", 52.0), ("period", "month", 12.0), ("period", "year", 1.0), ("scale", "k", 1e3), ("scale", "m", 1e6), ("scale", "lakh", 1e5)]


def test_compose_finds_shortest_and_checks_cycles():
    got = {u: (a, b, n) for u, a, b, n in units.compose([("c", "k", 1.0, 273.15), ("f", "c", 5 / 9, -160 / 9)], "k")}
    assert got["k"] == (1.0, 0.0, 0) and got["c"][2] == 1 and got["f"][2] == 2
    assert got["f"][0] * 32 + got["f"][1] == pytest.approx(273.15)
    assert units.compose([("a", "b", 2.0, 0.0), ("a", "b", 2.0, 0.0), ("x", "y", 1.0, 0.0)], "b") == [("a", 2.0, 0.0, 1), ("b", 1.0, 0.0, 0)]
    with pytest.raises(ValueError, match="identity"):
        units.compose([("a", "b", 2.0, 0.0), ("b", "c", 2.0, 0.0), ("a", "c", 5.0, 0.0)], "c")
    with pytest.raises(ValueError, match="undone"):
        units.compose([("a", "b", 0.0, 0.0)], "b")
    assert units.compose([], "z") == [("z", 1.0, 0.0, 0)]


@pytest.mark.parametrize(
    ("text", "low", "high", "currency", "period"),
    [
        ("120 500 à 136 500 EUR", "120500", "136500", "EUR", None),
        ("CHF 6'650 per month", "6650", "6650", "CHF", "month"),
        ("9 650,00 – 12 000,00 € pro Monat", "9650.00", "12000.00", "EUR", "month"),
        ("Grade 3 | 195 à 210 € par jour", "195", "210", "EUR", "day"),
        ("twenty-one to twenty-eight pounds sterling an hour", "21", "28", "GBP", "hour"),
        ("136,000 – 165,000 (401k match 4%)", "136000", "165000", None, None),
        ("95 – 114 thousand euros a year and 25 days leave", "95", "114", "EUR", "year"),
        ("C$82,500.00 annually", "82500.00", "82500.00", "CAD", "year"),
        ("108,000 - 141,000 + 15% bonus", "108000", "141000", None, None),
    ],
)
def test_pay(text, low, high, currency, period):
    p = units.Units(FACTORS).pay(text)
    assert (p[0], p[2], p[4], p[5]) == (low, high, currency, period)


@pytest.mark.parametrize("text", [None, "", "  ", "Band C", "Competitive", "n/a", "—", "+ bonus", "15% bonus"])
def test_no_pay(text):
    assert units.Units(FACTORS).pay(text) is None


def test_units_said():
    assert units.Units(FACTORS).said("Nice. The range shown is what you earn each hour, in euros. Travel costs up to 90 francs per month are covered.") == ("EUR", "hour")
    assert units.Units(FACTORS).said("Last year the firm turned over £3.4M.\nA sign-on payment of $5,000 is possible.") == (None, None)
    assert units.Units(FACTORS).said(None) == (None, None)


def test_annual_pay(spark):
    rows = [
        (1, "€10 an hour", "Money: US dollars, counted by the week."), (2, "100-90", "Money: euros, counted by the day."), (3, "₹24.1-33.3 LPA", None), (4, None, "Money: euros, counted by the day."),
        (5, "50k", None), (5, "50k", None), (6, "2.146M INR", ""), (7, "Negotiable", None), (8, "", None), (9, "90 – 100k USD", None), (10, "x" * 100_000, "y" * 100_000),
    ]
    jobs = spark.createDataFrame([(*r, "kept out") for r in rows], "id long, salary_range string, job_description string, unit string")
    got = sorted(tuple(r) for r in units.annual_pay(jobs, spark.createDataFrame(FACTORS, "kind string, code string, factor double")).collect())
    assert got == [(1, 22464, 22464), (2, 25272, 28080), (3, 28920, 39960), (5, 50000, 50000), (5, 50000, 50000), (6, 25752, 25752), (9, 90000, 100000)]
    assert units.annual_pay(jobs.limit(0), spark.createDataFrame(FACTORS, "kind string, code string, factor double")).count() == 0


def test_more_amounts_and_scales():
    pay = units.Units(FACTORS).pay
    assert pay("40k / 50k / 60k USD")[:5] == ("40", "k", "60", "k", "USD")
    assert pay("60 / 40 / 50k")[:4] == ("40", "k", "60", "k")
    assert pay("33000 to 40k")[:4] == ("33000", None, "40", "k") and pay("1748 – 2079K INR")[:4] == ("1748", "k", "2079", "k")
    assert pay("3 crore INR")[:2] == ("3", "crore")


def test_units_without_conversion_are_reported(spark):
    rows = [(1, "NOK 600,000 per year", None), (2, "JPY 5,000,000", None), (3, "¥ 900", None), (4, "70,000 DOE", None), (5, "12 crore rupees", None), (6, "9 TOK a fortnight", None), (7, "50 kr per hour", None)]
    jobs = spark.createDataFrame(rows, "id long, salary_range string, job_description string")
    factors = spark.createDataFrame([*FACTORS, ("currency", "TOK", 2.0), ("period", "fortnight", 26.0)], "kind string, code string, factor double")
    got = {r.id: (r.unit, r.low_usd) for r in units.amounts(jobs, factors).collect()}
    assert got == {1: ("NOK/year", None), 2: ("JPY/year", None), 3: ("¥/year", None), 4: ("USD/year", 70000), 5: ("INR/year/crore", None), 6: ("TOK/fortnight", 468), 7: ("SEK/hour", None)}
    assert sorted(r.id for r in units.annual_pay(jobs, factors).collect()) == [4, 6]


def test_units_are_looked_for_wherever_they_are_said():
    import re

    u = units.Units(FACTORS)
    for t, want in (("Salaries are in SFr per month.", ("CHF", "month")), ("Pay is in kr by the day.", ("SEK", "day")), ("Pay is in Rs. counted by the month.", ("INR", None))):
        assert u.said(t) == want and re.search(u.may_say, t)
