"""Loops over micro-batches, and keyed state that outlives a batch."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from postloom.streaming import feeds


def write(spark, path, rows):
    spark.createDataFrame(rows, "user_id bigint, event_id bigint, ts timestamp, kind string").coalesce(1).write.mode("append").parquet(path)


def test_state_goes_on_in_the_next_batch(spark, tmp_path):
    src, at = str(tmp_path / "in"), dt.datetime(2025, 1, 1)
    stream = lambda: feeds.read_stream(spark, src, "user_id bigint, event_id bigint, ts timestamp, kind string", 1)
    write(spark, src, [(1, i, at + dt.timedelta(seconds=i), "a") for i in range(3)])
    got: dict[str, list] = {"tokens": [], "budget": []}

    def run():
        for name, df in (("tokens", feeds.token_stream(stream(), "user_id", "ts", "event_id", rate=0.001, burst=2.0)), ("budget", feeds.budget_stream(stream(), "user_id", "ts", "event_id", "kind", per_hour=4, per_day=5, per_kind_day=9))):
            feeds.run_every(df, lambda b, _, name=name: got[name].extend(tuple(r) for r in b.collect()), str(tmp_path / name)).awaitTermination()

    run()
    write(spark, src, [(1, i, at + dt.timedelta(seconds=i), "a") for i in range(3, 6)])
    run()
    assert [r[2] for r in sorted(got["tokens"])] == [True, True, False, False, False, False]
    assert [r[2] for r in sorted(got["budget"])] == [True] * 4 + [False] * 2


def test_heartbeat(spark, tmp_path):
    seen = []
    q = feeds.run_every(feeds.heartbeat(spark, 30), lambda b, i: seen.extend(r["timestamp"] for r in b.collect()), str(tmp_path / "c"), "100 milliseconds")
    try:
        for _ in range(100):
            if len(seen) >= 3:
                break
            q.awaitTermination(0.3)
    finally:
        q.stop()
    assert len(seen) >= 3 and all((b - a).total_seconds() == 30 for a, b in zip(seen, seen[1:], strict=False))


def test_replay_keeps_the_last_of_the_ring(spark):
    feed = spark.range(500).select(F.col("id").alias("event_id"))
    assert feeds.replay(feed, 450, ring=20).count() == 20 and feeds.replay(feed, 495, ring=20).count() == 4 and feeds.replay(feed.limit(0), 0).count() == 0
