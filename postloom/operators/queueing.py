"""Work queues, slots and budgets: what is due, who gets it, what a failure costs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def claim(queue: DataFrame, order: list[Column], due: Column, limit: int) -> DataFrame:
    """The first ``limit`` rows that are due, with their attempt counted up and their state ``running``: a top-k, no global sort."""
    x = queue.where(due).orderBy(*order).limit(limit)
    return x.withColumn("attempt", F.col("attempt") + 1).withColumn("state", F.lit("running"))


def after_failure(attempt: Column, max_attempts: Column, most: int = 300) -> tuple[Column, Column]:
    """(state, seconds to wait) of a failed row: attempt to the fourth power, capped; discarded at the last attempt, without a wait."""
    gone = attempt >= max_attempts
    wait = F.least(F.pow(attempt.cast("double"), 4.0), F.lit(float(most))).cast("bigint")
    return F.when(gone, "discarded").otherwise("retryable"), F.when(~gone, wait)


def slots_in_use(events: DataFrame, key: str, order: list[str], delta: Column) -> DataFrame:
    """``events`` with ``in_use``: slots taken after each event, one more for an acquisition, one fewer for a release, never below zero.

    The floor is the running sum less its lowest value so far, where that is negative: two windows over one sort.
    """
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = events.withColumn("_s", F.sum(delta).over(w))
    return x.withColumn("in_use", F.col("_s") - F.least(F.min("_s").over(w), F.lit(0))).drop("_s")


def within_budgets(events: DataFrame, key: str, ts: str, order: str, kind: str, per_hour: int = 8, per_day: int = 25, per_kind_day: int = 10) -> DataFrame:
    """``events`` with ``sent``: whether each is within the budgets, counting only those sent before it in the last hour and day.

    A decision depends on all decisions of the key before it, but on no more than a day of them. The batches of a key come one by one, sorted by the
    shuffle, and only the moments sent in the last day are kept (at most ``per_day``), so a key may be of any size.
    """
    names = {c: t for c, t in events.select(key, order, kind).dtypes}
    schema = f"{key} {names[key]}, {order} {names[order]}, sent boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sent = object(), []
        for pdf in batches:
            ok = []
            for k, s, what in zip(pdf[key], pdf["_s"], pdf[kind], strict=True):
                if k != now:
                    now, sent = k, []
                sent = [x for x in sent if x[0] > s - 86_400_000_000]
                hour = sum(x[0] > s - 3_600_000_000 for x in sent)
                fits = hour < per_hour and len(sent) < per_day and sum(x[1] == what for x in sent) < per_kind_day
                if fits:
                    sent.append((s, what))
                ok.append(fits)
            yield pd.DataFrame({key: pdf[key], order: pdf[order], "sent": ok})

    x = events.where(F.col(key).isNotNull()).select(key, order, kind, F.unix_micros(F.col(ts).cast("timestamp")).alias("_s"))
    return x.repartition(key).sortWithinPartitions(key, "_s", order).mapInPandas(run, schema)


def histogram_quantile(df: DataFrame, keys: list[str], value: str, bounds: list[float], q: float) -> DataFrame:
    """``keys, n, quantile`` from counts per bucket, linear within the bucket that holds the rank; the last, open bucket gives its lower bound.

    The rows become ``len(bounds) + 1`` counts per key before any shuffle, whatever their number. NULL values aren't counted; no rows give no quantile.
    """
    n_in = [F.count_if(F.col(value) <= b).alias(f"_le{i}") for i, b in enumerate(bounds)]
    x = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *n_in)
    rank = F.col("n") * F.lit(q)
    out = F.lit(float(bounds[-1]))
    for i in reversed(range(len(bounds))):
        below = F.col(f"_le{i - 1}") if i else F.lit(0)
        low = float(bounds[i - 1]) if i else 0.0
        inside = F.col(f"_le{i}") - below
        here = F.lit(low) + (bounds[i] - low) * F.coalesce((rank - below) / F.nullif(inside, F.lit(0)), F.lit(0.0))
        out = F.when(F.col(f"_le{i}") >= rank, here).otherwise(out)
    return x.select(*keys, "n", out.alias("quantile"))


def stale(df: DataFrame, key: str, ts: str, now: Column, most_seconds: int = 420) -> DataFrame:
    """``key, age_s, alive``: seconds since the last row of each key, and whether that is within the limit."""
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.max(F.col(ts)).cast("timestamp"))
    return df.groupBy(key).agg(age.alias("age_s")).withColumn("alive", F.col("age_s") <= most_seconds)
