"""The change feed and per-key state as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files as they arrive; ``files_per_trigger`` bounds a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def new_records(stream: DataFrame, keys: list[str], ts: str, lateness: str = "1 day") -> DataFrame:
    """First sight of each key; its state is dropped once the watermark has passed."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, ts: str, keys: list[str], size: str = "1 hour", lateness: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts per window and keys; late rows up to ``lateness`` are counted."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return stream.withWatermark(ts, lateness).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(stream: DataFrame, ts: str, keys: list[str], gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    return stream.withWatermark(ts, lateness).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def replay(feed: DataFrame, after_id: int, ring: int = 200, key: str = "event_id") -> DataFrame:
    """The last ``ring`` events that come after ``after_id``: what a subscriber that returns still gets."""
    return feed.orderBy(F.desc(key)).limit(ring).where(F.col(key) > after_id)


def circuit_stream(stream: DataFrame, key: str, ts: str, order: str, failed: str, threshold: int = 5, base: int = 60, most: int = 21_600) -> DataFrame:
    """Consecutive failures and seconds of an open circuit of each key, kept from batch to batch.

    Rows of a key are taken in (time, order) within a micro-batch. State is one number per key.
    """
    out = f"{key} bigint, {order} bigint, failures int, open_s bigint"

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        pdf = pd.concat(list(batches)).sort_values([ts, order], kind="stable")
        fails, opens = [], []
        for f in pdf[failed]:
            n = n + 1 if f else 0
            fails.append(n)
            opens.append(min(most, base * 2 ** min(n - threshold, 40)) if n >= threshold else 0)
        state.update((n,))
        yield pd.DataFrame({key: pdf[key], order: pdf[order], "failures": fails, "open_s": opens})

    return stream.groupBy(key).applyInPandasWithState(step, out, "failures int", "append", GroupStateTimeout.NoTimeout)


def token_stream(stream: DataFrame, key: str, ts: str, order: str, rate: float, burst: float) -> DataFrame:
    """Admission by a token bucket per key, kept from batch to batch: the state is the level and the moment of the last event.

    Rows of a key are taken in (time, order) within a micro-batch.
    """
    out = f"{key} bigint, {order} bigint, allowed boolean, tokens double"

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, at = state.get if state.exists else (burst, None)
        pdf = pd.concat(list(batches)).sort_values([ts, order], kind="stable")
        ok, left = [], []
        for us in pdf[ts].astype("datetime64[us]").astype("int64"):
            level = min(burst, level + (0 if at is None else (us - at) / 1e6) * rate)
            at = us
            ok.append(level >= 1)
            level -= 1 if level >= 1 else 0
            left.append(level)
        state.update((float(level), None if at is None else int(at)))
        yield pd.DataFrame({key: pdf[key], order: pdf[order], "allowed": ok, "tokens": left})

    return stream.groupBy(key).applyInPandasWithState(step, out, "level double, at bigint", "append", GroupStateTimeout.NoTimeout)


def budget_stream(stream: DataFrame, key: str, ts: str, order: str, kind: str, per_hour: int = 8, per_day: int = 25, per_kind_day: int = 10) -> DataFrame:
    """Whether each event is within the budgets of its key, counting only those sent before; the state is the moments and kinds sent in the last day, at most ``per_day``."""
    out = f"{key} bigint, {order} bigint, sent boolean"

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sent = list(zip(*state.get, strict=True)) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values([ts, order], kind="stable")
        ok = []
        for us, what in zip(pdf[ts].astype("datetime64[us]").astype("int64"), pdf[kind], strict=True):
            sent = [x for x in sent if x[0] > us - 86_400_000_000]
            fits = sum(x[0] > us - 3_600_000_000 for x in sent) < per_hour and len(sent) < per_day and sum(x[1] == what for x in sent) < per_kind_day
            if fits:
                sent.append((int(us), what))
            ok.append(fits)
        state.update(([x[0] for x in sent], [x[1] for x in sent]))
        yield pd.DataFrame({key: pdf[key], order: pdf[order], "sent": ok})

    return stream.groupBy(key).applyInPandasWithState(step, out, "at array<bigint>, kind array<string>", "append", GroupStateTimeout.NoTimeout)


def heartbeat(spark: SparkSession, seconds: int = 30) -> DataFrame:
    """A row every ``seconds``: what keeps an idle subscription open."""
    return spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("advanceMillisPerBatch", seconds * 1000).option("numPartitions", 1).load()


def run_every(df: DataFrame, write, checkpoint: str, interval: str | None = None, mode: str = "append"):
    """A loop over micro-batches: ``write(batch, id)`` every ``interval``, or once over all there is if that is NULL. Returns the running query."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    return (w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)).start()


def run_to_memory(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Everything that is there now, through a stream, as a table."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def run_to_parquet(df: DataFrame, path: str, checkpoint: str, partition: list[str] | None = None) -> None:
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    (w.partitionBy(*partition) if partition else w).start().awaitTermination()
