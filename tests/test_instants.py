from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from postloom.operators.instants import estimate_zones, evidence, normalise_instants, parse_instants

CASES = [  # text, zone of the source, order, UTC or None
    ("2025-03-04T05:06:07Z", "Asia/Kolkata", "dmy", "2025-03-04T05:06:07"),
    ("2025-03-04t05:06:07z", "Asia/Kolkata", "dmy", "2025-03-04T05:06:07"),
    ("2025-03-04 05:06:07.123456+05:30", None, None, "2025-03-03T23:36:07.123456"),
    ("2025-03-04T05:06:07,250-0800", None, None, "2025-03-04T13:06:07.250"),
    ("2025-03-04T05:06:07+09", None, None, "2025-03-03T20:06:07"),
    ("2025-03-04 05:06", "America/New_York", "mdy", "2025-03-04T10:06:00"),
    ("2025-07-04 05:06", "America/New_York", "mdy", "2025-07-04T09:06:00"),
    ("2025.07.04 05:06", "Europe/Berlin", "dmy", "2025-07-04T03:06:00"),
    ("2025/07/04", "Europe/Berlin", "mdy", "2025-07-03T22:00:00"),
    (" 2025-07-04 ", "Asia/Tokyo", "mdy", "2025-07-03T15:00:00"),
    ("03/04/2025", "Europe/London", "dmy", "2025-04-02T23:00:00"),
    ("03/04/2025", "America/Chicago", "mdy", "2025-03-04T06:00:00"),
    ("3/4/25 9:05 PM", "America/Chicago", "mdy", "2025-03-05T03:05:00"),
    ("12:30", "Asia/Tokyo", "mdy", None),
    ("Apr 21, 2025 12:31 AM IST", "Asia/Tokyo", "mdy", "2025-04-20T19:01:00"),
    ("22 May 2026 19:33 EDT", "Asia/Tokyo", "mdy", "2026-05-22T23:33:00"),
    ("May 3 2026, 12:42pm PST", "Asia/Tokyo", "mdy", "2026-05-03T20:42:00"),
    ("Fri, 03 Apr 2026 18:09:30 +0530", None, None, "2026-04-03T12:39:30"),
    ("14. August 2025, 22:08 Uhr", "Europe/Berlin", "dmy", "2025-08-14T20:08:00"),
    ("2025-06-13 07:20:22 Asia/Kolkata", "Asia/Tokyo", "dmy", "2025-06-13T01:50:22"),
    ("2024-11-03 00:57:35 America/Los_Angeles", None, None, "2024-11-03T07:57:35"),
    ("2026-07-09T15:45:30[Australia/Sydney]", None, None, "2026-07-09T05:45:30"),
    ("2025-05-08T22:07:37[UTC]", "Asia/Tokyo", None, "2025-05-08T22:07:37"),
    ("2026-07-13 05:49:37 GMT+5:30", None, None, "2026-07-13T00:19:37"),
    ("20250304", "Asia/Tokyo", None, "2025-03-03T15:00:00"),
    ("20250304T050607Z", None, None, "2025-03-04T05:06:07"),
    ("1741064767", None, None, "2025-03-04T05:06:07"),
    ("1741064767.5", None, None, "2025-03-04T05:06:07.5"),
    ("1741064767123", None, None, "2025-03-04T05:06:07.123"),
    ("1741064767123456", None, None, "2025-03-04T05:06:07.123456"),
    ("/Date(1741064767123+0530)/", None, None, "2025-03-04T05:06:07.123"),
    ("2024-11-03 01:30:00", "America/New_York", "mdy", "2024-11-03T05:30:00"),  # doubled hour: the earlier
    ("2025-03-09 02:30:00", "America/New_York", "mdy", "2025-03-09T07:30:00"),  # skipped hour: moves forward
    ("2025-02-30", "Asia/Tokyo", "dmy", None), ("31/31/2025", "Asia/Tokyo", "dmy", None), ("2026-13-45", "Asia/Tokyo", "dmy", None),
    ("0000-00-00T00:00:00Z", "Asia/Tokyo", "dmy", None), ("unknown", "Asia/Tokyo", "dmy", None), ("", "Asia/Tokyo", "dmy", None), (None, "Asia/Tokyo", "dmy", None),
    ("2025-07-04 05:06", "UTC", "mdy", "2025-07-04T05:06:00"), ("2025-07-04 05:06", "Etc/UTC", "mdy", "2025-07-04T05:06:00"), ("2025-07-04 05:06", "GMT", "mdy", "2025-07-04T05:06:00"),
    ("2025-07-04 05:06", "Nowhere/Land", "mdy", None), ("2025-03-04 25:00", "Asia/Tokyo", "dmy", None), ("2025-03-04 05:06 Nowhere/Land", "Asia/Tokyo", "dmy", None), ("x" * 100_000, "Asia/Tokyo", "dmy", None),
]


def test_cases(spark):
    rows = [(i, t, f"s{i}") for i, (t, *_) in enumerate(CASES)]
    reg = spark.createDataFrame([(f"s{i}", z, o) for i, (_, z, o, _) in enumerate(CASES)], "source string, tz string, date_order string")
    df = spark.createDataFrame(rows, "k int, text string, src string").withColumn("tz", F.lit("clash"))
    first, last = 1_704_067_200_000_000, 1_798_761_600_000_000
    got = {r["k"]: r["utc_us"] for r in normalise_instants(df, "text", "src", reg, first_us=first, last_us=last).collect()}
    assert len(got) == len(CASES)
    for i, (t, _, _, want) in enumerate(CASES):
        us = None if want is None else round((dt.datetime.fromisoformat(want) - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))
        assert got[i] == us, (t, got[i], us)


def test_zone_is_estimated_where_none_is_registered(spark):
    zones = ["America/New_York", "Europe/Berlin", "Asia/Tokyo"]
    rows = []
    for s, z in enumerate(zones):
        for h in range(60):
            local = dt.datetime(2025, 1, 1) + dt.timedelta(hours=37 * h)
            off = {"America/New_York": -5, "Europe/Berlin": 1, "Asia/Tokyo": 9}[z]
            if z != "Asia/Tokyo" and dt.datetime(2025, 3, 1) < local:
                continue
            rows.append((s, h, local.isoformat(sep=" "), local - dt.timedelta(hours=off) + dt.timedelta(minutes=5)))
    df = spark.createDataFrame(rows, "src int, h int, text string, seen timestamp").withColumn("source", F.col("src").cast("string"))
    none = spark.createDataFrame([], "source string, tz string, date_order string")
    x = normalise_instants(df, "text", "source", none, "seen", zones)
    assert x.where("utc_us <> unix_micros(seen) - 300000000 OR utc_us IS NULL").count() == 0


def test_empty(spark):
    none = spark.createDataFrame([], "source string, tz string, date_order string")
    df = spark.createDataFrame([], "text string, src string, seen timestamp")
    assert normalise_instants(df, "text", "src", none, "seen", ["Asia/Tokyo"]).count() == 0
    e = spark.createDataFrame([], "source string, local_us bigint, offset_us bigint, in_us bigint, low_us bigint, high_us bigint")
    assert estimate_zones(e, ["Asia/Tokyo"]).count() == 0


ZONES = ["America/New_York", "Europe/Berlin", "Asia/Tokyo", "UTC"]


def test_stated_offsets_of_other_rows_tell_the_zone(spark):
    rows = [
        ("ny", "2025-01-10T08:00:00-05:00"), ("ny", "2025-07-10T08:00:00-0400"), ("ny", "2025-07-10 08:00"), ("ny", "2025-07-10T08:00:00Z"),
        ("be", "2025-01-10T08:00:00+01:00"), ("be", "10 July 2025 08:00 CEST"), ("be", "2025-01-10 08:00"),
        ("ut", "2025-01-10T08:00:00+00:00"), ("ut", "2025-07-10T08:00:00+00:00"), ("ut", "2025-01-10 08:00"),
    ]
    df = spark.createDataFrame(rows, "src string, text string").withColumn("seen", F.lit(dt.datetime(2025, 8, 1)))
    none = spark.createDataFrame([], "source string, tz string, date_order string")
    got = {(r["src"], r["text"]): r["utc_us"] for r in normalise_instants(df, "text", "src", none, "seen", ZONES).collect()}
    us = lambda s: round((dt.datetime.fromisoformat(s) - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))
    assert got[("ny", "2025-07-10 08:00")] == us("2025-07-10T12:00:00")
    assert got[("be", "2025-01-10 08:00")] == us("2025-01-10T07:00:00")
    assert got[("ut", "2025-01-10 08:00")] == us("2025-01-10T08:00:00")


def test_sequence_order_tells_the_zone(spark):
    start = dt.datetime(2025, 3, 1)
    rows = []  # every other row states its moment in UTC; those between are wall times in Tokyo, ingested weeks later
    for i in range(40):
        at = start + dt.timedelta(minutes=20 * i)
        rows.append(("t", i, at.isoformat() + "Z" if i % 2 == 0 else (at + dt.timedelta(hours=9)).isoformat(sep=" ")))
    df = spark.createDataFrame(rows, "src string, n int, text string").withColumn("seen", F.lit(dt.datetime(2025, 5, 1)))
    parsed = parse_instants(df, "text", F.lit(False))
    est = estimate_zones(evidence(parsed, "src", "seen", "n"), ZONES).collect()
    assert [(r["zone"], r["n_violations"]) for r in est] == [("Asia/Tokyo", 0)]


def test_a_registered_zone_overrules_the_estimate(spark):
    rows = [("a", "2025-01-10T08:00:00-05:00"), ("a", "2025-01-10 08:00"), (None, "2025-01-10 08:00"), ("a", None), ("a", "")]
    df = spark.createDataFrame(rows, "src string, text string").withColumn("seen", F.lit(dt.datetime(2025, 8, 1)))
    reg = spark.createDataFrame([("a", "Asia/Tokyo", None)], "source string, tz string, date_order string")
    x = normalise_instants(df, "text", "src", reg, "seen", ZONES).collect()
    assert len(x) == 5
    assert {r["utc_us"] for r in x if r["src"] == "a" and r["text"] == "2025-01-10 08:00"} == {1_736_463_600_000_000}
    assert all(r["utc_us"] is None for r in x if r["src"] is None or not r["text"])


@pytest.mark.parametrize("order", ["dmy", "mdy", None])
def test_repeated_rows_stay(spark, order):
    reg = spark.createDataFrame([("a", "Asia/Tokyo", order), ("a", "Asia/Tokyo", order)], "source string, tz string, date_order string")
    df = spark.createDataFrame([("2025-01-01", "a")] * 3 + [("2025-01-01", None)], "text string, src string")
    x = normalise_instants(df, "text", "src", reg)
    assert x.count() == 4 and x.where("utc_us IS NOT NULL").count() == 3
