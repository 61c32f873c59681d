"""Queries of the general data-cleaning problems (2, 4 and 5) over the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.operators.boards import board_settings
from postloom.operators.instants import estimate_zones, evidence, normalise_instants, parse_instants
from postloom.operators.lineage import written
from postloom.operators.multivalue import explode_values, learn_and_split
from postloom.operators.pay import assign_units, masked_evaluation, note_units, parse_amounts, stated_units, to_monthly, without_factor
from postloom.sources.tables import table

#: origin -> (table, its field of problem 4)
INSTANT_FIELDS = {
    "greenhouse": ("greenhouse_job", "updated_at"),
    "lever": ("lever_posting", "created_at"),
    "ashby": ("ashby_job", "published_at"),
    "workable": ("workable_job", "published_on"),
}
#: Candidate zones of boards.
ZONES = [
    "America/Los_Angeles", "America/Denver", "America/Chicago", "America/New_York", "Europe/London", "Europe/Berlin",
    "Asia/Kolkata", "Asia/Singapore", "Asia/Tokyo", "Australia/Sydney", "UTC",
]


def _instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(
        DataFrame.unionByName,
        [
            table(spark, sf_dir, t).select(F.lit(o).alias("origin"), F.col("item_id").alias("record_id"), "source_id", "fetched_at", F.col(f).alias("text"))
            for o, (t, f) in INSTANT_FIELDS.items()
        ],
    )


#: All moments of the tables lie in 2024 to 2026.
FIRST_US, LAST_US = 1_704_067_200_000_000, 1_798_761_600_000_000


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One UTC instant for each record whose field holds a valid moment."""
    boards = board_settings(table(spark, sf_dir, "job_source"))
    x = normalise_instants(_instants(spark, sf_dir), "text", "source_id", boards, "fetched_at", ZONES, FIRST_US, LAST_US)
    return x.where("utc_us IS NOT NULL").select("origin", "record_id", "utc_us")


def p4_zone_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zone estimated for each source as if none were registered, beside the registered one."""
    boards = board_settings(table(spark, sf_dir, "job_source")).select("source", "tz", "date_order")
    x = _instants(spark, sf_dir).join(boards, F.col("source_id") == F.col("source"), "left")
    parsed = parse_instants(x, "text", F.col("date_order") == "dmy").drop("source")
    est = estimate_zones(evidence(parsed, "source_id", "fetched_at"), ZONES)
    return est.join(boards.select("source", "tz"), "source", "left").select(
        F.col("source").alias("source_id"), "zone", F.col("tz").alias("registered"), "n_rows", "n_violations"
    )


def _packed_pieces(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    posting = table(spark, sf_dir, "posting").select(F.col("posting_id").alias("record_id"), "location_raw")
    lever = table(spark, sf_dir, "lever_posting").select(F.col("item_id").alias("record_id"), "categories_all_locations")
    texts = posting.select(F.col("location_raw").alias("text")).union(lever.select(F.explode("categories_all_locations").alias("text")))
    return posting, lever, learn_and_split(texts, listed_names(spark, sf_dir))


def listed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``name``: the listed places under all their names."""
    return table(spark, sf_dir, "location_ref").select(F.explode(F.concat(F.array("canonical"), F.coalesce("aliases", F.array()))).alias("name"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each place value of a field that holds several, with its position."""
    posting, lever, pieces = _packed_pieces(spark, sf_dir)
    pieces = written(pieces)
    a = explode_values(posting, ["record_id"], "location_raw", pieces)
    b = explode_values(lever, ["record_id"], "categories_all_locations", pieces, array=True)
    return a.select(F.lit("posting").alias("origin"), "*").union(b.select(F.lit("lever").alias("origin"), "*"))


def _pay_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed pay of every record with the units that its other text and its board state."""
    boards = board_settings(table(spark, sf_dir, "job_source")).select(
        "source", F.col("currency").alias("board_currency"), F.col("period").alias("board_period")
    )
    posting = table(spark, sf_dir, "posting").where("trim(compensation_raw_text) <> ''")
    cur, per = stated_units(F.concat_ws(" . ", "description_text", "requirements_text"))
    a = posting.select(F.lit("posting").alias("origin"), F.col("posting_id").alias("record_id"), "source_id", F.col("compensation_raw_text").alias("text"), cur.alias("text_currency"), per.alias("text_period"))
    cur, per = stated_units(F.col("description_plain"))
    b = table(spark, sf_dir, "ashby_job").where("trim(compensation_tier_summary) <> ''")
    b = b.select(F.lit("ashby").alias("origin"), F.col("item_id").alias("record_id"), "source_id", F.col("compensation_tier_summary").alias("text"), cur.alias("text_currency"), per.alias("text_period"))
    x = a.unionByName(b)
    x = x.join(parse_amounts(x), "text").join(boards, F.col("source_id") == F.col("source"), "left").drop("source", "source_id", "text")
    cur, per, scale = note_units(F.col("comp_note"))
    c = table(spark, sf_dir, "comp_detail").where("trim(normalized_inr_month) <> ''")
    c = c.select(
        F.lit("comp_detail").alias("origin"), F.col("job_id").alias("record_id"), F.col("normalized_inr_month").alias("text"),
        F.coalesce(cur, F.nullif(F.upper(F.trim("currency")), F.lit(""))).alias("text_currency"), per.alias("text_period"), scale.alias("note_scale"),
    )
    c = c.join(parse_amounts(c), "text").drop("text")
    scaled = F.when((F.col("scale") == "") & F.col("note_scale").isNotNull(), F.col("note_scale"))
    for v in ("lo", "hi"):
        c = c.withColumn(v, F.coalesce(F.expr(v) * scaled.cast("bigint") / 100, F.col(v)).cast("bigint"))
    c = c.where("lo > 0 OR lo IS NULL").drop("note_scale").withColumn("board_currency", F.lit("INR")).withColumn("board_period", F.lit("month"))
    return x.unionByName(c)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rupees per month of each record that states a positive amount of pay."""
    x = assign_units(written(_pay_rows(spark, sf_dir)))
    x = to_monthly(x, table(spark, sf_dir, "unit_factor"), "inr_month_min", "inr_month_max")
    return x.select("origin", "record_id", "inr_month_min", "inr_month_max")


def p2_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records for review: no unit could be assigned, none has a factor, the amount is too large, or the confident prediction contradicts the unit stated elsewhere."""
    x = without_factor(assign_units(written(_pay_rows(spark, sf_dir))), table(spark, sf_dir, "unit_factor"))
    against = [F.coalesce((F.col(f"{u}_conf") >= 0.9) & (F.col(f"{u}_pred") != F.col(f"{u}_used")), F.lit(False)) for u in ("currency", "period")]
    return x.where((F.col("decided_by") == "review") | F.col("no_factor") | against[0] | against[1]).select(
        "origin", "record_id", "currency_used", "currency_pred", F.round("currency_conf", 4).alias("currency_conf"),
        "period_used", "period_pred", F.round("period_conf", 4).alias("period_conf"), F.when(F.col("no_factor"), "no_factor").otherwise(F.col("decided_by")).alias("decided_by"),
    )


def p2_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records each rung decides, and what the model says of them."""
    return assign_units(written(_pay_rows(spark, sf_dir))).groupBy("origin", "decided_by", "model_says").agg(F.count(F.lit(1)).alias("n"))


def p2_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of the ensemble by its confidence, with boards and other texts hidden from it."""
    x = masked_evaluation(written(_pay_rows(spark, sf_dir)))
    return x.select("unit", "bin", "n", F.round("mean_conf", 4).alias("mean_conf"), F.round("accuracy", 4).alias("accuracy"))


QUERIES = {
    "p2_found": p2_found,
    "p2_review": p2_review, "p2_decisions": p2_decisions, "p2_calibration": p2_calibration,
    "p4_found": p4_found, "p4_zone_estimates": p4_zone_estimates, "p5_found": p5_found}
