"""Mixed timestamp texts to one UTC instant (problem 4).

A text is rewritten by one regular expression per family of notations into ``year|month|day|hour|minute|second|fraction|a/p|zone``, and the
instant is integer arithmetic on those parts, independent of the session's time zone. Wall times without a zone take the zone of their
source. That zone is estimated over all rows of the source: of the candidate zones the one whose offset history gives the fewest
violations (``estimate_zones``). The check that follows: a valid registered zone overrules the estimate.
"""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postloom.operators.lineage import written

# Minutes east of UTC meant by an abbreviation.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "BST": 60, "CET": 60, "WEST": 60, "CEST": 120, "EET": 120, "MSK": 180,
    "EEST": 180, "GST": 240, "PKT": 300, "IST": 330, "NPT": 345, "ICT": 420, "SGT": 480, "HKT": 480, "AWST": 480,
    "JST": 540, "KST": 540, "ACST": 570, "AEST": 600, "ACDT": 630, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "NST": -210, "BRT": -180, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
# Abbreviations that name a zone with daylight saving rather than an offset.
ZONE_WORDS = {"ET": "America/New_York", "CT": "America/Chicago", "MT": "America/Denver", "PT": "America/Los_Angeles"}
# The first three letters of the months in English, German and Spanish.
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
    "mär": 3, "mrz": 3, "mai": 5, "okt": 10, "dez": 12, "ene": 1, "abr": 4, "ago": 8, "dic": 12,
}

_ZONE = r"(?:(?:UTC|GMT)? ?[+-]\d{1,2}(?::?\d{2})?(?: ?\[[A-Za-z_]+(?:/[A-Za-z_]+)+\])?|\[?[A-Za-z_]+(?:/[A-Za-z_]+)+\]?|[A-Za-z]{1,4}|[(\[][A-Z]{1,4}[)\]])"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?: ?([AaPp])\.?[Mm]\.?(?![A-Za-z]))?"
_TAIL = rf"(?: ?({_ZONE}))?$"
_DAYNAME = r"(?:[A-Za-z]{3,9}\.?,? )?"
ISO = rf"^(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}})(?:(?:[Tt]|,? ){_CLOCK})?{_TAIL}"
COMPACT = rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:[Tt](\d{{2}}):?(\d{{2}}):?(\d{{2}})?(?:[.,](\d{{1,9}}))?)?{_TAIL}"
NUMERIC = rf"^(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}}|\d{{2}})(?:(?:[Tt]|,? ){_CLOCK})?{_TAIL}"
DAY_MONTH = rf"^{_DAYNAME}(\d{{1,2}})(?:st|nd|rd|th|\.)?[ -]([^\d ]{{3}})[^\d ,.]*\.?,?[ -](\d{{4}})(?:,? (?:at )?{_CLOCK})?{_TAIL}"
MONTH_DAY = rf"^{_DAYNAME}([A-Za-z]{{3}})[A-Za-z]*\.? (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})(?:,? (?:at )?{_CLOCK})?{_TAIL}"
EPOCH = r"^(\d{9,17})(?:\.(\d{1,9}))?$"
JSON_DATE = r"^/?Date\((\d{9,17})(?:[+-]\d{4})?\)/?$"



def instant_parts(text: Column, day_first: Column) -> Column:
    """Array year, month, day, hour, minute, second, fraction, a/p, zone of a calendar notation; one element for others.

    No notation matches what another one is rewritten to, so the rewritings are chained and each expression runs once.
    """
    t = F.regexp_replace(text, ISO, "$1|$3|$4|$5|$6|$7|$8|$9|$10")
    t = F.regexp_replace(t, COMPACT, "$1|$2|$3|$4|$5|$6|$7||$8")
    t = F.regexp_replace(t, NUMERIC, F.when(day_first, "$4|$3|$1|$5|$6|$7|$8|$9|$10").otherwise("$4|$1|$3|$5|$6|$7|$8|$9|$10"))
    t = F.regexp_replace(t, DAY_MONTH, "$3|$2|$1|$4|$5|$6|$7|$8|$9")
    t = F.regexp_replace(t, MONTH_DAY, "$3|$1|$2|$4|$5|$6|$7|$8|$9")
    return F.split(t, r"\|", -1)


def parse_instants(df: DataFrame, text: str, day_first: Column) -> DataFrame:
    """``df`` with ``local_us`` (wall clock), ``offset_min`` (stated), ``local_offset``, ``stated_zone`` (IANA) and ``epoch_us``.

    ``local_offset``: the stated offset tells of the writer's own zone (any but Z, UTC and GMT, which machines write everywhere). Exactly one of ``local_us`` and ``epoch_us`` is set for a text that states a moment, both are NULL for any other
    (NULL, blank, impossible dates, words). ``day_first``: order of all-number dates whose year doesn't come first;
    NULL counts as False, and a date impossible in that order is no moment.
    """
    t = F.regexp_replace(F.col(text), r"\s*(?:年|月)\s*(?=\d)", "-")
    t = F.regexp_replace(t, r"日|\b(?:Uhr|hrs)\s*$|(?<=\s)de(?=\s)", "")
    t = F.trim(F.regexp_replace(t, r"[\s\u00a0\u3000]+", " "))
    first = F.coalesce(day_first, F.lit(False))
    # a lambda over one element: the regular expressions stay outside the generated stage, which they would push beyond the JVM's
    # size limit of a method
    df = df.withColumn("_t", t).withColumn("_p", F.transform(F.array("_t"), lambda x: instant_parts(x, first))[0])
    t = F.col("_t")
    at = lambda i: F.get("_p", F.lit(i))
    months = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    month = F.coalesce(at(1).try_cast("int"), months[F.lower(at(1))])
    year = at(0).try_cast("int")
    year = F.when(year < 100, year + 2000).otherwise(year)
    df = df.withColumn("_y", year).withColumn("_mo", month).withColumn("_d", at(2).try_cast("int"))
    df = df.withColumn("_day", F.expr("unix_date(cast(try_make_timestamp_ntz(_y, _mo, _d, 0, 0, 0) as date))"))
    zero = lambda c: F.coalesce(c.try_cast("int"), F.lit(0))
    half = F.lower(at(7))
    h = zero(at(3))
    hour = F.when(half == "", h).when((h < 1) | (h > 12), None).otherwise(h % 12 + F.when(half == "p", 12).otherwise(0))
    valid = (hour < 24) & (zero(at(4)) < 60) & (zero(at(5)) < 60)
    micro = F.rpad(F.substring(at(6), 1, 6), 6, "0").try_cast("bigint")
    local = (
        F.col("_day").cast("bigint") * 86_400_000_000
        + (hour * 3600 + zero(at(4)) * 60 + zero(at(5))).cast("bigint") * 1_000_000
        + F.coalesce(micro, F.lit(0))
    )
    zone = at(8)
    signed = F.regexp_extract(zone, r"^(?:UTC|GMT)? ?([+-])(\d{1,2}):?(\d{2})?", 1)
    minutes = F.regexp_extract(zone, r"([+-])(\d{1,2}):?(\d{2})?", 2).try_cast("int") * 60 + F.coalesce(
        F.regexp_extract(zone, r"([+-])(\d{1,2}):?(\d{2})?", 3).try_cast("int"), F.lit(0)
    )
    word = F.upper(F.regexp_replace(zone, r"[()\[\]]", ""))
    abbreviations = F.create_map(*[x for k, v in ABBREVIATIONS.items() for x in (F.lit(k), F.lit(v))])
    words = F.create_map(*[x for k, v in ZONE_WORDS.items() for x in (F.lit(k), F.lit(v))])
    offset = F.when(signed != "", F.when(signed == "-", -minutes).otherwise(minutes)).when(zone != "", abbreviations[word])
    df = df.withColumn("_named", F.regexp_replace(zone, r"[\[\]]", "")).withColumn("offset_min", offset)
    df = df.withColumn("local_offset", F.coalesce((signed != "") | ((zone != "") & ~word.isin("Z", "UTC", "GMT") & offset.isNotNull()), F.lit(False)))
    names = zone_names(df.sparkSession).withColumnRenamed("zone", "_iana")
    df = df.join(F.broadcast(names), F.col("_named") == F.col("_iana"), "left")
    df = df.withColumn("stated_zone", F.when(signed == "", F.col("_iana")).when(zone != "", words[word]))
    understood = (zone == "") | F.col("offset_min").isNotNull() | F.col("stated_zone").isNotNull()
    df = df.withColumn("local_us", F.when(valid & understood, local))
    whole = F.coalesce(F.nullif(F.regexp_extract(t, EPOCH, 1), F.lit("")), F.nullif(F.regexp_extract(t, JSON_DATE, 1), F.lit("")))
    n = F.length(whole)
    scale = F.when(n <= 11, 1_000_000).when(n <= 14, 1_000).otherwise(1)
    below = F.regexp_extract(t, EPOCH, 2)
    below = F.when(below != "", F.floor(F.concat(F.lit("0."), below).cast("decimal(10,9)") * scale).cast("bigint")).otherwise(0)
    df = df.withColumn("epoch_us", whole.try_cast("bigint") * scale.cast("bigint") + below)
    return df.drop("_t", "_p", "_y", "_mo", "_d", "_day", "_named", "_iana")


def known_zones() -> list[str]:
    """The names of the public zone database, links such as UTC and GMT included; about 600, whatever the data."""
    return sorted(z for z in zoneinfo.available_timezones() if z not in ("Factory", "ROC", "localtime") and not z.startswith(("posix/", "right/")))


def zone_names(spark: SparkSession) -> DataFrame:
    """``zone``: the known names as a table."""
    return spark.createDataFrame([(z,) for z in known_zones()], "zone string")


def to_utc(local_us: Column, zone: Column) -> Column:
    """Wall clock to UTC by the zone's offset history; of a doubled hour the earlier, a skipped hour moves forward."""
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local_us), zone))


def evidence(parsed: DataFrame, source: str, ingested: str, sequence: str | None = None, span: int = 86_400) -> DataFrame:
    """``source, local_us, offset_us, in_us, low_us, high_us``: what the rows of ``parse_instants`` tell about the zone of their source.

    Rows that state a local offset give it; wall times without a zone give the moment of their ingestion and, with
    ``sequence`` (a column in whose order a source publishes), the last known moment before and the first one after them. Neighbours are
    sought among rows ingested within the same ``span`` seconds, so that no source is sorted as a whole.
    """
    known = F.coalesce(F.col("epoch_us"), F.col("local_us") - F.col("offset_min").cast("bigint") * 60_000_000)
    offset = F.when(F.col("local_offset"), F.col("offset_min").cast("bigint") * 60_000_000)
    wall = F.expr("local_us IS NOT NULL AND offset_min IS NULL AND stated_zone IS NULL")
    low = high = F.lit(None).cast("bigint")
    in_us = F.unix_micros(F.col(ingested).cast("timestamp"))
    if sequence:
        w = Window.partitionBy(source, F.floor(in_us / (span * 1_000_000))).orderBy(sequence)
        low = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        high = F.first(known, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    x = parsed.select(F.col(source).alias("source"), "local_us", offset.alias("offset_us"), in_us.alias("in_us"), low.alias("low_us"), high.alias("high_us"), wall.alias("_wall"))
    return x.where("source IS NOT NULL AND local_us IS NOT NULL AND (_wall OR offset_us IS NOT NULL)").drop("_wall")


def estimate_zones(rows: DataFrame, zones: list[str]) -> DataFrame:
    """``source, zone, n_rows, n_violations``: for each source the zone of ``zones`` that fits its rows of ``evidence`` best.

    A row that states an offset violates a zone whose offset at that moment is another one. A wall time violates a zone that puts it
    after its ingestion, before the known moment that precedes it or after the one that follows. The fewest violations win, then the smallest
    mean lag before ingestion (of two zones without a violation the tighter), then the name. Rows are reduced to one sum per source and zone
    before the shuffle, so a source with a third of all rows costs no more. NULL bounds can't be violated; no rows give no estimate.
    """
    at = to_utc(F.col("local_us"), F.col("zone"))
    x = rows.withColumn("zone", F.explode(F.array(*[F.lit(z) for z in zones]))).withColumn("at", at)
    never = F.lit(False)
    off = F.col("at") != F.col("local_us") - F.col("offset_us")
    wrong = F.coalesce(F.col("at") > F.col("in_us"), never) | F.coalesce(F.col("at") < F.col("low_us"), never) | F.coalesce(F.col("at") > F.col("high_us"), never)
    lag = F.when(F.col("offset_us").isNull(), F.greatest(F.col("in_us") - F.col("at"), F.lit(0)).cast("double"))
    scored = x.groupBy("source", "zone").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.when(F.col("offset_us").isNotNull(), off).otherwise(wrong)).alias("n_violations"),
        F.avg(lag).alias("mean_lag"),
    )
    best = F.min_by(F.struct("zone", "n_rows", "n_violations"), F.struct("n_violations", "mean_lag", "zone")).alias("b")
    return scored.groupBy("source").agg(best).select("source", "b.*")


def normalise_instants(
    df: DataFrame,
    text: str,
    source: str,
    registry: DataFrame,
    ingested: str | None = None,
    zones: list[str] | None = None,
    first_us: int | None = None,
    last_us: int | None = None,
    sequence: str | None = None,
) -> DataFrame:
    """``df`` with ``utc_us``, the UTC instant in microseconds that ``text`` states, or NULL.

    ``registry``: ``source, tz, date_order``; of several rows of a source one counts. A zone in the text wins. Every other wall time gets the
    zone estimated over the rows of its source from ``ingested`` (a timestamp column), the offsets its other rows state, and ``sequence``,
    among ``zones``; a valid registered zone then overrules the estimate. Without ``ingested`` and ``zones`` nothing is estimated. Moments outside
    [first_us, last_us), where given, are no moments (sentinels such as 0000-00-00). A row without text, or with a text that is no moment, keeps
    NULL; a NULL source has no zone; extra columns pass through, rows are never dropped. The parsed rows are written once: select the columns you need first.
    """
    reg = registry.select(F.col("source").alias("_src"), F.col("tz").alias("_rz"), F.col("date_order").alias("_order")).dropDuplicates(["_src"])
    names = zone_names(df.sparkSession).withColumnRenamed("zone", "_tz")
    reg = reg.join(F.broadcast(names), F.col("_rz") == F.col("_tz"), "left").drop("_rz")
    x = df.join(reg, F.col(source) == F.col("_src"), "left")
    x = parse_instants(x, text, F.col("_order") == "dmy")
    zone = F.coalesce("stated_zone", "_tz")
    if ingested and zones:
        x = written(x.drop("_src", "_order"))
        est = estimate_zones(evidence(x, source, ingested, sequence), zones)
        x = x.join(est.select(F.col("source").alias("_es"), F.col("zone").alias("_ez")), F.col(source) == F.col("_es"), "left")
        zone = F.coalesce("stated_zone", "_tz", "_ez")
    at = F.coalesce(
        F.col("epoch_us"),
        F.col("local_us") - F.col("offset_min").cast("bigint") * 60_000_000,
        to_utc(F.col("local_us"), zone),
    )
    inside = F.lit(True)
    if first_us is not None:
        inside = inside & (at >= first_us)
    if last_us is not None:
        inside = inside & (at < last_us)
    x = x.withColumn("utc_us", F.when(inside, at))
    return x.drop("_src", "_tz", "_order", "_es", "_ez", "local_us", "offset_min", "local_offset", "stated_zone", "epoch_us")
