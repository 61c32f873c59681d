"""Amounts in many currencies, periods and scales to one unit (problem 2).

``parse_amounts`` reads what a text states: amounts, currency, period, the months a lump sum covers. What it doesn't state is predicted by
a calibrated tree ensemble from magnitude, source settings, kind of record and neighbouring fields (``UnitModel``); an
exact check follows: a unit stated in the record's other text, or registered for its source, overrules the prediction,
and a prediction below the confidence needed goes to review. ``masked_evaluation`` measures the ensemble where that check is hidden from it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import Decimal
from functools import reduce

import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.operators.lineage import written

CURRENCY = [  # fixed values: notations of a currency, tried in this order
    ("USD", r"us\$|\busd|\bu\.s\.? dollars?|\bus dollars?"),
    ("CAD", r"c\$|ca\$|\bcad|canadian dollars?"),
    ("AUD", r"a\$|au\$|\baud|australian dollars?"),
    ("SGD", r"s\$|\bsgd|singapore dollars?"),
    ("INR", r"₹|\brs\b\.?|\brs(?=\d)|\binr|rupees?|\bpaisa\b|\bpaise\b"),
    ("EUR", r"€|\beur|\beuros?"),
    ("GBP", r"£|\bgbp|pounds?(?: sterling)?"),
    ("JPY", r"¥|\bjpy|\byen\b"),
    ("USD", r"\$|\bdollars?"),
]
PERIOD = [  # fixed values: notations of a period, tried in this order
    ("fortnight", r"fortnight(?:ly)?|every two weeks|every 2 weeks|bi-?weekly"),
    ("hour", r"/ ?h(?:ou)?r?s?\b|\b(?:per|an?|by the|each) hour|\bp/h\b|\bhourly\b|\bp\.?h\.?(?!\w)|^hours?$|^hrs?$"),
    ("day", r"/ ?day\b|\b(?:per|an?|by the|each) day|\bdaily\b|\bp\.d\.|^days?$"),
    ("week", r"/ ?w(?:ee)?k\b|\b(?:per|an?|by the|each) week|\bweekly\b|\bp\.w\.|\bpw\b|^week$|^wk$"),
    ("month", r"/ ?mo(?:nth)?\b|\b(?:per|an?|by the|each) month|\bmonthly\b|\bp\.m\.?|\bpm\b|\bper mensem|^months?$|^mo$"),
    ("year", r"/ ?y(?:ea)?r\b|\b(?:per|an?|by the|each) (?:year|annum)|\byearly\b|\bannual(?:ly)?\b|\bp\.a\.?|\bpa\b|\blpa\b|^years?$|^yr$"),
]
_CUR = [(c, re.compile(p, re.I)) for c, p in CURRENCY]
_PER = [(c, re.compile(p, re.I)) for c, p in PERIOD]
_NUM = r"(?:\d{1,3}(?:,\d{2,3})+(?:\.\d+)?|\d+(?:\.\d+)?)"
_AMOUNT = re.compile(rf"(?P<n>{_NUM}|\d{{1,3}}(?:\.\d{{3}})+)\s*(?P<m>lpa\b|lakhs?\b|lacs?\b|l\b|crores?\b|cr\b|k\b|thousand\b|mn\b|million\b|'000)?", re.I)
_SCALE = {"lpa": 10**5, "lakh": 10**5, "lac": 10**5, "l": 10**5, "crore": 10**7, "cr": 10**7, "k": 10**3, "thousand": 10**3, "mn": 10**6, "million": 10**6, "'000": 10**3}
_LUMP = re.compile(r"(?:lump sum|one[- ]time|total|covers|covering)[^\d]{0,20}(\d{1,2})[\s-]*months?", re.I)
_NOISE = re.compile(
    r"\d+(?:\.\d+)?\s*%(?:\s*[–—-]\s*\d+(?:\.\d+)?\s*%)?(?:\s*(?:bonus|equity))?|\(?\d+\s*(?:[-–—+]|to)?\s*\d*\+?\s*(?:years?|yrs?|weeks?|months?|days?|hours?)\b(?:\s+of\s+\w+)?\)?|\(\d{4}\)",
    re.I,
)
_UNPAID = re.compile(r"\bunpaid\b|\bvolunteer\b|\bcommission only\b|\bequity only\b", re.I)
#: Amounts above this many units aren't converted: they go to review, for exact products must stay below 2**63.
MOST = 10**12


def currency_of(text: str) -> str | None:
    return next((c for c, p in _CUR if p.search(text)), None)


def period_of(text: str) -> str | None:
    return next((c for c, p in _PER if p.search(text)), None)


def parse_amount(text: str | None) -> tuple[int | None, int | None, str | None, str | None, int, str] | None:
    """(min, max in hundredths, currency, period, months of a lump sum or 0, scale word) that ``text`` states; None if no positive amount.

    Both amounts are None where one is above ``MOST``.
    """
    if text is None:
        return None
    t = " ".join(text.replace(" ", " ").replace(" ", " ").split())
    if not t or t[0] in "-−" or _UNPAID.search(t):
        return None
    lump = _LUMP.search(t)
    months = int(lump.group(1)) if lump else 0
    if lump:
        t = t[: lump.start()] + t[lump.end() :]
    t = _NOISE.sub(" ", t)
    found = []
    for m in _AMOUNT.finditer(t):
        raw, scale = m.group("n"), (m.group("m") or "").lower().rstrip("s")
        if re.fullmatch(r"\d{1,3}(?:\.\d{3})+", raw) and not scale:
            raw = raw.replace(".", "")
        found.append([Decimal(raw.replace(",", "")), _SCALE.get(scale, 1), scale, m.start(), m.end()])
    if not found:
        return None
    a = found[0]
    b = a
    if len(found) > 1 and re.fullmatch(r"[^\d]{0,14}", t[a[4] : found[1][3]]) and re.search(r"[-–—~−]|\bto\b|\bbis\b|\band\b", t[a[4] : found[1][3]], re.I):
        b = found[1]
        if b[1] > 1 and a[1] == 1 and a[0] <= b[0]:
            a[1] = b[1]
    lo, hi = int(a[0] * a[1] * 100), int(b[0] * b[1] * 100)
    if lo > hi:
        lo, hi = hi, lo
    if lo <= 0:
        return None
    if hi > MOST * 100:
        lo = hi = None
    cur, per = currency_of(t), period_of(t)
    return lo, hi, cur, per, months if 0 < months < 100 else 0, b[2] or a[2]


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(t, *p) for t in pdf["text"] if (p := parse_amount(t))]
        yield pd.DataFrame(rows, columns=["text", "lo", "hi", "currency", "period", "months", "scale"]).astype({"lo": "Int64", "hi": "Int64"})


def parse_amounts(texts: DataFrame) -> DataFrame:
    """``text, lo, hi, currency, period, months, scale`` for each distinct ``text`` that states a positive amount of pay.

    ``lo`` and ``hi`` are hundredths of the stated unit, NULL for amounts above ``MOST``; units not stated are NULL. NULL, blank and unpaid texts, percentages and years
    of experience give no row. Distinct texts are parsed once, in Arrow batches.
    """
    d = texts.select("text").where("text IS NOT NULL AND trim(text) <> ''").distinct()
    schema = "text string, lo bigint, hi bigint, currency string, period string, months int, scale string"
    return d.mapInPandas(_parse_batches, schema)


_WORDS = r"indian rupees|us dollars|canadian dollars|australian dollars|singapore dollars|japanese yen|pounds sterling|euros|rupees|yen|inr|usd|cad|aud|sgd|jpy|gbp|eur"
_STATED = rf"(?i)\b({_WORDS})\b,?\s+((?:per|by the|an?|each)\s+(?:hour|day|week|fortnight|month|year|annum)|hourly|daily|weekly|fortnightly|monthly|yearly|annually)\b"


def _code(word: Column, table: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, x: c.when(word.rlike("(?i)" + x[1]), x[0]), table[1:], F.when(word.rlike("(?i)" + table[0][1]), table[0][0]))


def stated_units(text: Column) -> tuple[Column, Column]:
    """Currency and period that a running text states for its figures, NULL where it doesn't."""
    cur, per = F.regexp_extract(text, _STATED, 1), F.regexp_extract(text, _STATED, 2)
    return F.when(cur != "", _code(cur, CURRENCY)), F.when(per != "", _code(per, PERIOD))


def note_units(note: Column) -> tuple[Column, Column, Column]:
    """Currency, period and scale (hundredths per unit: lakh, thousand, paise) of a short note."""
    n = F.trim(F.regexp_replace(F.coalesce(note, F.lit("")), r"(?i)not converted;|,? ?\bnot (?:monthly|yearly|weekly)\b", ""))
    scale = (
        F.when(n.rlike(r"(?i)\bpais[ae]\b"), 1)
        .when(n.rlike(r"(?i)\blakhs?\b|\blacs?\b"), 100 * 10**5)
        .when(n.rlike(r"(?i)\bcrores?\b"), 100 * 10**7)
        .when(n.rlike(r"(?i)\bthousands?\b|'000"), 100 * 10**3)
    )
    return _code(n, CURRENCY), _code(n, PERIOD), scale


class UnitModel:
    """A calibrated random forest for one missing unit (``currency`` or ``period``).

    Fitted on at most ``sample_rows`` labelled rows (those whose field states the unit), chosen by hash; a fifth of them is held out: an
    isotonic regression of "prediction right" on the forest's top probability gives the confidence.
    """

    def __init__(self, labelled: DataFrame, unit: str, sample_rows: int = 20_000, seed: int = 7):
        rows = labelled.where(F.col(unit).isNotNull()).withColumn("_h", F.abs(F.xxhash64("origin", "record_id")) % 1_000_003)
        rows = rows.orderBy("_h", "origin", "record_id").limit(sample_rows).withColumn("label_text", F.col(unit))
        rows = written(rows.select("label_text", "_h", *_FEATURES))
        self.unit = unit
        self.fitted = None
        classes = [r[0] for r in rows.select("label_text").distinct().orderBy("label_text").collect()]
        self.classes = classes
        if len(classes) < 2 or rows.where("_h % 5 = 0").isEmpty() or rows.where("_h % 5 <> 0").isEmpty():
            return  # nothing to learn or nothing to calibrate on: no confidence
        stages = [StringIndexer(inputCols=_NAMES, outputCols=[f"{c}_i" for c in _NAMES], handleInvalid="keep")]
        stages.append(VectorAssembler(inputCols=[*_NUMBERS, *[f"{c}_i" for c in _NAMES]], outputCol="features"))
        label = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label_text")).cast("double") - 1
        train = rows.withColumn("label", label)
        forest = RandomForestClassifier(numTrees=16, maxDepth=7, maxBins=64, seed=seed, cacheNodeIds=False)
        self.fitted = Pipeline(stages=[*stages, forest]).fit(train.where("_h % 5 <> 0"))
        held = self.fitted.transform(train.where("_h % 5 = 0"))
        held = held.select(F.array_max(vector_to_array("probability")).alias("top"), (F.col("prediction") == F.col("label")).cast("double").alias("right"))
        iso = IsotonicRegression(featuresCol="top", labelCol="right").fit(held)
        self.steps = list(zip(iso.boundaries.toArray().tolist(), iso.predictions.toArray().tolist(), strict=True))

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``{unit}_pred`` and the calibrated ``{unit}_conf``."""
        if self.fitted is None:
            only = F.lit(self.classes[0] if self.classes else None).cast("string")
            return rows.withColumn(f"{self.unit}_pred", only).withColumn(f"{self.unit}_conf", F.lit(0.0))
        keep = rows.columns
        x = self.fitted.transform(rows)
        top = F.array_max(vector_to_array("probability"))
        conf = F.lit(self.steps[-1][1])
        for (b0, p0), (b1, p1) in reversed(list(zip(self.steps, self.steps[1:], strict=False))):
            between = p0 + (top - b0) * ((p1 - p0) / (b1 - b0)) if b1 > b0 else F.lit(p1)
            conf = F.when(top <= b1, between).otherwise(conf)
        conf = F.when(top <= self.steps[0][0], self.steps[0][1]).otherwise(conf) if len(self.steps) > 1 else conf
        pred = F.array(*[F.lit(c) for c in self.classes])[F.col("prediction").cast("int")]
        return x.select(*keep, pred.alias(f"{self.unit}_pred"), conf.alias(f"{self.unit}_conf"))


_NUMBERS = ["log_lo", "is_range"]
_NAMES = ["origin", "scale_f", "board_currency_f", "board_period_f", "text_currency_f", "text_period_f"]
_FEATURES = [*_NUMBERS, *_NAMES]


def _with_features(rows: DataFrame, hidden: bool = False) -> DataFrame:
    """The columns that the ensemble reads; ``hidden``: without what boards and other texts state."""
    none = lambda c: F.lit("none") if hidden else F.coalesce(F.col(c), F.lit("none"))
    return rows.withColumns(
        {
            "log_lo": F.log10(F.col("lo").cast("double")),
            "is_range": (F.col("hi") > F.col("lo")).cast("double"),
            "scale_f": F.when(F.coalesce("scale", F.lit("")) == "", "none").otherwise(F.col("scale")),
            "board_currency_f": none("board_currency"),
            "board_period_f": none("board_period"),
            "text_currency_f": none("text_currency"),
            "text_period_f": none("text_period"),
        }
    )


def assign_units(rows: DataFrame, confident: float = 0.9, sample_rows: int = 20_000) -> DataFrame:
    """``rows`` with both units decided.

    ``rows``: ``origin, record_id, lo, hi, currency, period, months, scale`` (parsed), ``text_currency, text_period`` (other text of the record),
    ``board_currency, board_period``. Adds ``currency_pred, currency_conf, period_pred, period_conf`` and ``currency_used, period_used, decided_by``.
    What the field leaves out is predicted; a confident prediction stands unless the check contradicts it: the unit that the other text states, or else
    the board. ``decided_by``, the last rung at which a unit is stated: ``field``, ``text``, ``board``, ``model`` (it alone) or ``review`` (nothing states the unit and
    the model isn't confident, or the amount is NULL, being too large). ``model_says``: ``agrees`` (all confident predictions, one at least, are what is used), ``differs`` or ``unsure``.
    Rows whose field states both units aren't predicted. Empty input gives an empty result.
    """
    x = _with_features(rows.where("lo IS NOT NULL"))
    cur, per = UnitModel(x, "currency", sample_rows), UnitModel(x, "period", sample_rows)
    gaps = F.col("currency").isNull() | (F.col("period").isNull() & (F.col("months") == 0))
    blank = lambda df: df.withColumns({f"{u}_{c}": F.lit(None).cast(t) for u in ("currency", "period") for c, t in (("pred", "string"), ("conf", "double"))})
    x = blank(x.where(~gaps)).unionByName(per.predict(cur.predict(x.where(gaps)))).drop(*[c for c in _FEATURES if c != "origin"])
    x = x.unionByName(blank(rows.where("lo IS NULL")).select(*x.columns))
    sure, wrong = [], []
    for u in ("currency", "period"):
        model = F.when(F.col(f"{u}_conf") >= confident, F.col(f"{u}_pred"))
        x = x.withColumn(f"{u}_used", F.coalesce(u, f"text_{u}", f"board_{u}", model))
        x = x.withColumn(
            f"{u}_by",
            F.when(F.col(u).isNotNull(), 0).when(F.col(f"text_{u}").isNotNull(), 1).when(F.col(f"board_{u}").isNotNull(), 2).when(model.isNotNull(), 3).otherwise(4),
        )
        asked = F.col(u).isNull() & ((F.col("months") == 0) if u == "period" else F.lit(True))
        sure.append(asked & model.isNotNull())
        wrong.append(F.coalesce(asked & (model != F.col(f"{u}_used")), F.lit(False)))
    by = F.greatest("currency_by", F.when(F.col("months") > 0, 0).otherwise(F.col("period_by")))
    by = F.when(F.col("lo").isNull(), 4).otherwise(by)
    x = x.withColumn("decided_by", F.array(*[F.lit(v) for v in ("field", "text", "board", "model", "review")])[by])
    x = x.withColumn("model_says", F.when(by == 0, None).when(wrong[0] | wrong[1], "differs").when(sure[0] | sure[1], "agrees").otherwise("unsure"))
    return x.drop("currency_by", "period_by")


def masked_evaluation(rows: DataFrame, sample_rows: int = 20_000) -> DataFrame:
    """``unit, bin, n, mean_conf, accuracy``: how the ensemble does where it is alone, by tenths of its confidence.

    It is fitted on the rows whose field states the unit, with boards and other texts hidden, and asked about the rows whose field doesn't state it; what their other text
    or board states is the truth. A calibrated model has about the same ``accuracy`` as ``mean_conf`` in every bin. Rows without a truth aren't counted.
    """
    x = _with_features(rows.where("lo IS NOT NULL"), hidden=True)
    out = None
    for u in ("currency", "period"):
        model = UnitModel(x, u, sample_rows)
        asked = x.where(F.col(u).isNull() & ((F.col("months") == 0) if u == "period" else F.lit(True))).withColumn("_truth", F.coalesce(f"text_{u}", f"board_{u}")).where("_truth IS NOT NULL")
        y = model.predict(asked).select(F.col(f"{u}_conf").alias("conf"), F.coalesce(F.col(f"{u}_pred") == F.col("_truth"), F.lit(False)).cast("double").alias("right"))
        y = y.groupBy(F.least(F.floor(F.col("conf") * 10), F.lit(9)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("conf").alias("mean_conf"), F.avg("right").alias("accuracy"))
        y = y.select(F.lit(u).alias("unit"), "bin", "n", "mean_conf", "accuracy")
        out = y if out is None else out.union(y)
    return out


def without_factor(rows: DataFrame, factors: DataFrame) -> DataFrame:
    """``rows`` with ``no_factor``: a unit that is decided but that ``factors`` don't hold."""
    f = factors.select("kind", "unit").distinct()
    cur, per = (f.where(F.col("kind") == k).select(F.col("unit").alias(f"_{k}")) for k in ("currency", "period"))
    x = rows.join(cur, F.col("currency_used") == F.col("_currency"), "left").join(per, F.col("period_used") == F.col("_period"), "left")
    gone = (F.col("currency_used").isNotNull() & F.col("_currency").isNull()) | ((F.col("months") == 0) & F.col("period_used").isNotNull() & F.col("_period").isNull())
    return x.withColumn("no_factor", gone).drop("_currency", "_period")


def to_monthly(rows: DataFrame, factors: DataFrame, target_min: str, target_max: str) -> DataFrame:
    """Whole units of the base currency per month, halves up, in exact integer arithmetic.

    ``factors``: ``kind, unit, num, den``; rows with a unit that has no factor (``without_factor``) and rows for review are left out. A lump sum is divided by
    its months instead of a period's factor. Products stay below 2**63 for amounts up to ``MOST`` hundredths times factors
    of 10**4.
    """
    f = factors.dropDuplicates(["kind", "unit"])
    cur = f.where("kind = 'currency'").select(F.col("unit").alias("_c"), F.col("num").alias("_cn"), F.col("den").alias("_cd"))
    per = f.where("kind = 'period'").select(F.col("unit").alias("_p"), F.col("num").alias("_pn"), F.col("den").alias("_pd"))
    x = rows.join(cur, F.col("currency_used") == F.col("_c")).join(per, F.col("period_used") == F.col("_p"), "left")
    x = x.where("lo IS NOT NULL AND (months > 0 OR _p IS NOT NULL)")
    lump = F.col("months") > 0
    num = F.col("_cn") * F.when(lump, F.lit(1).cast("bigint")).otherwise(F.col("_pn"))
    den = F.col("_cd") * F.when(lump, F.col("months").cast("bigint")).otherwise(F.col("_pd")) * 100
    x = x.withColumn("_n", num).withColumn("_d", den)
    for src, dst in (("lo", target_min), ("hi", target_max)):
        x = x.withColumn(dst, F.expr(f"(2 * {src} * _n + _d) div (2 * _d)"))
    return x.drop("_c", "_cn", "_cd", "_p", "_pn", "_pd", "_n", "_d")
