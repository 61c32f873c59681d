"""Mixing sources to target weights (problem 8).

Sainte-Lague apportionment hands the tokens of the total to the sources, one by one to the highest quotient share / (2 n + 1) in
effect, no source beyond its records times its repeats; within a source each shard of bounded size gets its exact share of the quota in tokens, the tokens that
rounding leaves over going to the largest fractions. Nothing is floored to larger units, so neither a small source nor a small shard loses its part as the total grows,
and only sums per source reach the driver. A shard puts its records in
seeded order and takes them until its tokens are reached; whole passes come first, so repeats differ by at most one within a shard.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm.tokenizer import VOCABULARY, count_tokens
from postloom.operators.lineage import written


def sainte_lague(weights: dict, seats: int, most: dict | None = None) -> dict:
    """Seats by the highest quotients weight / (2 n + 1); no key gets more than ``most[key]``. Ties go to the smaller key.

    The bulk is given at once: floor(share) - 1 seats are certain for a key while no limit binds; the rest go by a heap, O(keys) steps.
    If all limits are reached before the seats are, the remaining seats stay unassigned.
    """
    most = most or {}
    got = {k: 0 for k in weights}
    open_keys = {k for k, w in weights.items() if w > 0 and most.get(k, math.inf) > 0}
    left = seats
    while open_keys and left > 0:
        total = sum(Fraction(weights[k]) for k in open_keys)
        target = {k: Fraction(weights[k]) * (left + sum(got[x] for x in open_keys)) / total for k in open_keys}
        full = {k for k in open_keys if target[k] >= most.get(k, math.inf)}
        if full:  # a limit binds: these keys get all they may, the others share what is left
            for k in sorted(full):
                give = min(most[k] - got[k], left)
                got[k] += give
                left -= give
            open_keys -= full
            continue
        for k in open_keys:
            give = max(0, min(math.floor(target[k]) - 1 - got[k], left))
            got[k] += give
            left -= give
        heap = [(-Fraction(weights[k]) / (2 * got[k] + 1), k) for k in sorted(open_keys)]
        heapq.heapify(heap)
        while left > 0 and heap:
            _, k = heapq.heappop(heap)
            if got[k] >= most.get(k, math.inf):
                continue
            got[k] += 1
            left -= 1
            heapq.heappush(heap, (-Fraction(weights[k]) / (2 * got[k] + 1), k))
        break
    return got


def shard_quotas(shards: DataFrame) -> DataFrame:
    """``source, shard, quota, have`` of ``source, shard, avail, tokens, have``: the tokens of each source over its shards, in proportion to what they have.

    Every shard gets the whole part of tokens * have / avail; the tokens left over, fewer than there are shards, go one each to the largest remainders (ties: the smaller
    shard). The quotas of a source add up to its tokens, and no shard gets more than its part of the source's repeats, rounded up. In exact integer arithmetic.
    """
    exact = F.col("tokens").cast("decimal(19,0)") * F.col("have").cast("decimal(19,0)")
    x = shards.withColumn("_e", exact).withColumn("_base", F.expr("_e div avail")).withColumn("_rest", F.expr("cast(_e - cast(_base as decimal(19,0)) * avail as bigint)"))
    w = Window.partitionBy("source")
    x = x.withColumn("_left", F.col("tokens") - F.sum("_base").over(w)).withColumn("_rank", F.row_number().over(w.orderBy(F.desc("_rest"), "shard")))
    return x.select("source", "shard", (F.col("_base") + (F.col("_rank") <= F.col("_left")).cast("bigint")).alias("quota"), "have")


def mix_sources(
    docs: DataFrame,
    id_col: str,
    source: str,
    text: Column,
    targets: DataFrame,
    total_tokens: int | None = None,
    shard_tokens: int = 2_000_000,
    seed: int = 8,
    vocabulary: str = VOCABULARY,
) -> tuple[DataFrame, DataFrame]:
    """(mixture ``id, source, shard, n_tokens, uses``, shares ``source, target_share, max_repeats, n_docs, available_tokens, quota_tokens, mixed_tokens, actual_share, largest_use``).

    ``targets``: ``source, target_share, max_repeats``, a bounded table. Shares are taken among the sources that have both a target and
    tokens; sources without a target aren't used, targets without records are reported with zero. ``total_tokens`` NULL is
    the largest total at which every source can fill its share within its repeats. With a larger total the sources at their limit leave the
    rest to the others. Records without text have no tokens and aren't used; a NULL source has no target. The driver holds one row per
    target; shards (tokens / ``shard_tokens`` rows) stay in a table. A shard's records (about ``shard_tokens`` tokens) are ordered in one task; a source
    of a third of all rows has a third of all shards.
    """
    t = targets.select(F.col("source").alias("source"), F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).dropDuplicates(["source"])
    wanted = docs.join(t.where("target_share > 0 AND max_repeats > 0").select(F.col("source").alias(source)), source, "left_semi")
    counted = written(count_tokens(wanted, [F.col(id_col).alias("id"), F.col(source).alias("source")], text, vocabulary).where("n_tokens > 0"))
    spark = docs.sparkSession
    sums = counted.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("c")).collect()
    avail, docs_of = {r["source"]: r["n"] for r in sums}, {r["source"]: r["c"] for r in sums}
    goal = {r["source"]: r for r in t.collect()}
    shares = {s: Fraction(goal[s]["target_share"]).limit_denominator(10**9) for s in avail}
    if shares:
        whole = sum(shares.values())
        shares = {s: v / whole for s, v in shares.items()}
        limit = {s: avail[s] * goal[s]["max_repeats"] for s in avail}
        total = total_tokens if total_tokens is not None else int(min(limit[s] / shares[s] for s in avail))
        quota = sainte_lague(shares, total, limit)
    else:
        quota = {}
    # each source has shards by its own size: a shard of a small source is as large as one of a large source
    parts = [(s, max(1, math.ceil(n / shard_tokens)), n, quota[s]) for s, n in avail.items()]
    parts = F.broadcast(spark.createDataFrame(parts, "source string, shards int, avail bigint, tokens bigint"))  # one row per target
    counted = counted.withColumn("h", F.xxhash64(F.lit(seed), F.col("id").cast("string"))).join(parts, "source")
    counted = counted.withColumn("shard", F.pmod("h", F.col("shards")).cast("int"))
    plan = shard_quotas(counted.groupBy("source", "shard", "avail", "tokens").agg(F.sum("n_tokens").alias("have")))
    x = counted.drop("shards", "avail", "tokens").join(plan.where("quota > 0"), ["source", "shard"])
    order = Window.partitionBy("source", "shard").orderBy("h", "id")
    x = x.withColumn("before", F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("passes", F.expr("quota div have")).withColumn("rest", F.expr("quota % have"))
    # a record belongs to the last pass if most of it lies within the tokens left
    last = F.coalesce("before", F.lit(0)) + F.floor(F.col("n_tokens") / 2) < F.col("rest")
    x = x.withColumn("uses", (F.col("passes") + last.cast("int")).cast("int")).join(t.select("source", "max_repeats"), "source")
    x = x.withColumn("uses", F.least("uses", "max_repeats")).where("uses > 0")
    mixture = x.select("id", "source", "shard", "n_tokens", "uses")
    used = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("mixed_tokens"), F.max("uses").alias("largest_use"))
    stated = spark.createDataFrame(
        [(s, goal[s]["target_share"], goal[s]["max_repeats"], docs_of.get(s, 0), avail.get(s, 0), quota.get(s, 0)) for s in goal],
        "source string, target_share double, max_repeats int, n_docs bigint, available_tokens bigint, quota_tokens bigint",
    )
    x = stated.join(used, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
    # over one row per target
    x = x.withColumn("_all", F.sum("mixed_tokens").over(Window.partitionBy(F.lit(0))))
    shares_out = x.select(
        "source", "target_share", "max_repeats", "n_docs", "available_tokens", "quota_tokens", "mixed_tokens",
        F.round(F.coalesce(F.col("mixed_tokens") / F.col("_all"), F.lit(0.0)), 6).alias("actual_share"), F.coalesce("largest_use", F.lit(0)).alias("largest_use"),
    )
    return mixture, shares_out
