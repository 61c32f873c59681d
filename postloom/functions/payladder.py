"""The ladder that reads pay from free text by order of decision: range, single amount, unpaid, vague, unknown.

Its results are those of a given set of patterns, quirks included; ``operators/pay.py`` is the parser for pay in any unit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and multipliers of the ladder.
NUMBER = r"[\d,]+(?:\.\d+)?"
SCALES = r"lpa|lakh|lakhs|lac|crore|cr|k"
RANGE = rf"(?i)(?:₹|rs\.?|inr|\$|usd)?\s*({NUMBER})\s*({SCALES})?\s*[-–to]+\s*(?:₹|rs\.?|inr|\$|usd)?\s*({NUMBER})\s*({SCALES})?"
SINGLE = rf"(?i)(₹|rs\.?|inr|\$|usd)?\s*({NUMBER})\s*({SCALES})?\s*(?:/|per\s+)?\s*(hour|hr|month|mo|year|yr|annum|week)?"
VAGUE = r"(?i)competitive (?:stipend|salary|pay|compensation)|\bpaid internship\b|stipend provided"
UNPAID = r"(?i)\bunpaid\b|no stipend|for academic credit only|\bvolunteer\b"
RUPEES = r"₹|\brs\.?\b|\binr\b"
DOLLARS = r"\$|\busd\b"
PERIODS = [("year", r"(?i)\b(year|yr|annum|annual|lpa)\b"), ("hour", r"(?i)\b(hour|hr|hourly)\b"), ("month", r"(?i)\b(week|weekly)\b"), ("month", r"(?i)\b(month|mo|monthly)\b")]
MULTIPLIERS = {"lpa": 100_000, "lakh": 100_000, "lakhs": 100_000, "lac": 100_000, "crore": 10_000_000, "cr": 10_000_000, "k": 1_000}
HOURS_A_MONTH, MONTHS_A_YEAR, MONTHS_OF_A_STIPEND = 160, 12, 3


def scaled_number(digits: Column, scale: Column) -> Column:
    """A number with grouping commas times its multiplier word; NULL if no digits are left or there are more than 300."""
    clean = F.replace(digits, F.lit(","), F.lit(""))
    times = F.lit(1.0)
    for words in ((1e5, ("lpa", "lakh", "lakhs", "lac")), (1e7, ("crore", "cr")), (1e3, ("k",))):
        times = F.when(F.lower(scale).isin(*words[1]), F.lit(words[0])).otherwise(times)
    return F.when(F.length(clean) <= 300, clean.try_cast("double")) * times


def per_month(amount: Column, period: Column) -> Column:
    return F.when(period == "hour", amount * HOURS_A_MONTH).when(period == "year", amount / MONTHS_A_YEAR).when(period == "stipend_total", amount / MONTHS_OF_A_STIPEND).otherwise(amount)


def parse_pay(text: Column, strict: bool = False) -> Column:
    """Struct comp_min, comp_max, currency, period, confidence, inr_month, paid of a text; NULL counts as empty.

    The default takes any two numbers with a dash, ``to`` or ``t`` and ``o`` between them for a range ("2-4 years"), looks at the leftmost match
    alone, and trusts a single amount without period (0.75) more than one without currency (0.60). ``strict`` asks a range for a currency, a multiplier or
    a period, and a number for a leading digit. Amounts of other currencies than the rupee aren't converted.
    """
    own = NUMBER if not strict else r"\d[\d,]*(?:\.\d+)?"
    rng, one = RANGE.replace(NUMBER, own), SINGLE.replace(NUMBER, own)
    none, blank = F.lit(None).cast("double"), F.lit("")

    def read(t: Column) -> Column:
        """Each pattern runs once; the matches are taken apart by themselves."""
        period = blank
        for name, p in reversed(PERIODS):
            period = F.when(t.rlike(p), name).otherwise(period)
        groups = lambda p, n: F.split(F.regexp_replace(F.regexp_extract(t, p, 0), "(?i)^(?:" + p.removeprefix("(?i)") + ")$", "|".join(f"${i}" for i in range(1, n + 1))), r"\|", -1)
        return F.struct(
            groups(rng, 4).alias("r"), groups(one, 4).alias("s"), F.when(t.rlike(RUPEES), "INR").when(t.rlike(DOLLARS), "USD").otherwise("").alias("cur"),
            period.alias("per"), t.rlike(UNPAID).alias("unpaid"), t.rlike(VAGUE).alias("vague"),
        )

    def numbers(x: Column) -> Column:
        r, s = (lambda i: F.get(x["r"], F.lit(i))), (lambda i: F.get(x["s"], F.lit(i)))
        lo, hi = scaled_number(r(0), r(1)), scaled_number(r(2), r(3))
        ranged = lo.isNotNull() & hi.isNotNull()
        if strict:
            ranged = ranged & ((x["cur"] != "") | (x["per"] != "") | (r(1) != "") | (r(3) != ""))
        return F.struct(lo.alias("lo"), hi.alias("hi"), F.coalesce(ranged, F.lit(False)).alias("ranged"), scaled_number(s(1), s(2)).alias("v"), *[x[c].alias(c) for c in ("cur", "per", "unpaid", "vague")])

    def decide(x: Column) -> Column:
        cur, per = x["cur"], x["per"]
        row = lambda a, b, c, p, k, paid: F.struct(
            a.alias("comp_min"), b.alias("comp_max"), c.alias("currency"), p.alias("period"), (k if isinstance(k, Column) else F.lit(k).cast("double")).alias("confidence"),
            F.when(c == "INR", per_month(a, p)).alias("inr_month"), F.lit(paid).alias("paid"),
        )
        single = row(
            x["v"], none, F.when(cur == "", "INR").otherwise(cur), F.when(per == "", "month").otherwise(per),
            F.when(per == "", 0.75).when(cur == "", 0.60).otherwise(0.90), "paid",
        )
        return (
            F.when(x["ranged"], row(x["lo"], x["hi"], cur, per, 0.95, "paid"))
            .when(x["v"].isNotNull(), single)
            .when(x["unpaid"], row(none, none, blank, blank, 0.0, "unpaid"))
            .when(x["vague"], row(none, none, blank, blank, 0.50, "paid"))
            .otherwise(row(none, none, blank, blank, 0.0, "unknown"))
        )

    out = F.array(F.trim(F.coalesce(text, F.lit(""))))
    for step in (read, numbers, decide):  # lambdas over one element: what a step gives is computed once
        out = F.transform(out, step)
    return out[0]
