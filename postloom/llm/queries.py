"""Queries of the problems tagged llm, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.canonical_map import map_values
from postloom.llm.leak import leaked_items
from postloom.llm.mixture import mix_sources
from postloom.llm.name_link import link_names, name_pairs
from postloom.llm.near_dup import expand_copies, similar_pairs
from postloom.llm.split_text import split_oversized
from postloom.operators.graph import connected_components
from postloom.operators.lineage import written
from postloom.sources.tables import spread_table, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listed places that each place field names, -1 for a field that names none."""
    fields = [("posting", "posting", "posting_id", "location_raw"), ("greenhouse", "greenhouse_job", "item_id", "location_name"), ("lever", "lever_posting", "item_id", "categories_location")]
    rows = None
    for origin, t, key, field in fields:
        x = table(spark, sf_dir, t).select(F.lit(origin).alias("origin"), F.col(key).alias("record_id"), F.col(field).alias("text"))
        rows = x if rows is None else rows.union(x)
    ref = table(spark, sf_dir, "location_ref").select(
        F.col("location_id").cast("bigint").alias("entry_id"),
        F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>"))).alias("names"),
        "region", "region_code", "country", "country_name",
    )
    found = map_values(rows, ref)
    return rows.join(found, "text").select("origin", "record_id", F.col("entry_id").cast("int").alias("location_id"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different spellings of one employer."""
    return name_pairs(written(link_names(table(spark, sf_dir, "posting").select(F.col("company_name_raw").alias("name")))))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each spelling with the class of its employer and the number of other spellings."""
    x = written(link_names(table(spark, sf_dir, "posting").select(F.col("company_name_raw").alias("name"))))
    sizes = x.groupBy("class").agg(F.min("name").alias("class_id"), (F.count(F.lit(1)) - 1).alias("n_links"))
    return x.join(sizes, "class").select("name", "class_id", "n_links")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of postings whose sets of three consecutive words have at least half of their union in common."""
    p = spread_table(spark, sf_dir, "posting", "posting_id", "title_raw", "description_text").where("trim(description_text) <> ''")
    text = F.concat_ws(" ", F.coalesce("title_raw", F.lit("")), "description_text")
    pairs, members = similar_pairs(p, "posting_id", text, k=3, similarity=(1, 2))
    x = expand_copies(pairs, members)
    return x.select(F.col("a").alias("posting_a"), F.col("b").alias("posting_b"))


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each posting with its class of near-duplicates at five words and 0.8, and the number of its direct links."""
    p = spread_table(spark, sf_dir, "posting", "posting_id", "title_raw", "description_text").where("trim(description_text) <> ''")
    text = F.concat_ws(" ", F.coalesce("title_raw", F.lit("")), "description_text")
    pairs, members = similar_pairs(p, "posting_id", text, k=5, similarity=(4, 5))
    pairs = pairs.select("a", "b")
    pairs = written(pairs)  # read by the components and the counts
    comp = connected_components(pairs)
    sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    ends = pairs.union(pairs.select("b", "a")).toDF("rep", "other")
    links = ends.join(sizes.select(F.col("rep").alias("other"), "copies"), "other").groupBy("rep").agg(F.sum("copies").alias("linked"))
    x = members.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").join(sizes, "rep").join(links, "rep", "left")
    return x.select(F.col("id").alias("posting_id"), F.coalesce("component", "rep").alias("class_id"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least 12 consecutive words of a held-out item, unedited."""
    x = leaked_items(spread_table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", table(spark, sf_dir, "golden_item"), "item_id", "body")
    return x.select("doc_id", F.col("item_id").cast("int").alias("item_id")).distinct()


def p7_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of 24 words of an item with at most three word edits."""
    x = leaked_items(spread_table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", table(spark, sf_dir, "golden_item"), "item_id", "body", width=24, max_edits=3, walks=6, places=5, samples=4)
    return x.select("doc_id", F.col("item_id").cast("int").alias("item_id")).distinct()


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture: each record used, how often, and its tokens."""
    mixture, _ = mix_sources(spread_table(spark, sf_dir, "documents", "doc_id", "source", "text"), "doc_id", "source", F.col("text"), table(spark, sf_dir, "mix_target"))
    return mixture.select(F.col("id").alias("doc_id"), "source", "shard", "n_tokens", "uses")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source with a target."""
    return mix_sources(spread_table(spark, sf_dir, "documents", "doc_id", "source", "text"), "doc_id", "source", F.col("text"), table(spark, sf_dir, "mix_target"))[1]


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of each document longer than its limit, in order."""
    x = split_oversized(spread_table(spark, sf_dir, "documents", "doc_id", "text", "lang"), "doc_id", "text", "lang", table(spark, sf_dir, "split_limit"))
    return x.withColumnRenamed("id", "doc_id")


QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p3_classes": p3_classes, "p6_found": p6_found, "p6_classes": p6_classes, "p7_found": p7_found, "p7_near": p7_near, "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p9_pieces": p9_pieces}
ORACLE_SQL: dict[str, str] = {}
