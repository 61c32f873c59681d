from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from postloom.sources.alerts import extract, robots_allowed, robots_rules
from postloom.sources.payloads import BOARDS, corrupt_pages, parse_pages, valid_pages
from postloom.streaming import feeds

ITEM = {
    "greenhouse": {"id": 7, "title": "Dev", "absolute_url": "https://a/7", "content": "&lt;p&gt;x", "departments": [{"name": "Eng"}, {"name": "X"}], "location": {"name": "Pune"}},
    "lever": {"id": "7", "text": "Dev", "hostedUrl": "https://a/7", "createdAt": 1741064767123, "workplaceType": "Remote", "categories": {"team": "Eng", "location": "Pune"}},
    "ashby": {"id": "7", "title": "Dev", "jobUrl": "https://a/7", "department": "Eng", "location": "Pune", "compensation": {"scrapeableCompensationSalarySummary": "$1"}},
    "workable": {"shortcode": "7", "title": "Dev", "url": "https://a/7", "department": "Eng", "city": "Pune", "country": "India"},
    "smartrecruiters": {"id": "7", "name": "Dev", "postingUrl": "https://a/7", "department": {"label": "Eng"}, "location": {"city": "Pune"}},
    "recruitee": {"id": 7, "title": "Dev", "status": "published", "careers_url": "https://a/7", "department": "Eng", "city": "Pune"},
    "teamtailor": {"id": "7", "title": "Dev", "url": "https://a/7", "_jobposting": {"jobLocation": [{"address": {"addressLocality": "Pune"}}, {"address": {}}]}},
    "workday": {"title": "Dev", "externalPath": "/job/7", "locationsText": "Pune", "postedOn": "Posted 3+ Days Ago", "bulletFields": ["Full", "R-7"]},
}
WRAP = {"greenhouse": "jobs", "ashby": "jobs", "workable": "jobs", "smartrecruiters": "content", "recruitee": "offers", "teamtailor": "items", "workday": "jobPostings"}


def pages(spark, board, *bodies):
    at = dt.datetime(2025, 5, 10, 12)
    return spark.createDataFrame([(f"p{i}", at, b) for i, b in enumerate(bodies)], "source_id string, fetched_at timestamp, body string")


def body(board, *items):
    return json.dumps({WRAP[board]: list(items)} if board in WRAP else list(items))


@pytest.mark.parametrize("board", sorted(BOARDS))
def test_board(spark, board):
    item = ITEM[board]
    p = pages(spark, board, body(board, item), body(board), body(board, item)[:-8], None, body(board, item, item), body(board, {**item, **{k: "" for k in ("title", "text", "name")}}))
    x = parse_pages(p, board)
    r = x.where("source_id = 'p0'").collect()
    assert len(r) == 1 and r[0]["title_raw"] == "Dev" and r[0]["location_raw"].startswith("Pune") and r[0]["adapter"] == board
    assert r[0]["external_id"] in ("7", "R-7") and r[0]["apply_url"].endswith("/7")
    if board == "lever":
        assert r[0]["remote_hint"] and r[0]["posted_at"] == dt.datetime(2025, 3, 4, 5, 6, 7, 123000)
    if board == "workday":
        assert r[0]["posted_at"] == dt.datetime(2025, 5, 7, 12)
    if board == "greenhouse":
        assert r[0]["description_html"] == "<p>x" and r[0]["department"] == "Eng"
    assert x.where("source_id IN ('p1', 'p2', 'p3')").count() == 0
    assert {r["source_id"] for r in corrupt_pages(p, board).collect()} == {"p2", "p3"}
    assert {r["source_id"] for r in valid_pages(x, ["source_id"]).select("source_id").distinct().collect()} == {"p0"}


def test_alerts():
    mail = "<a href='https://www.linkedin.com/comm/jobs/view/12?x=1&amp;y=2'> <b>Dev</b> &amp; Ops </a><td>Acme</td><p>Pune</p><a href='https://www.linkedin.com/comm/jobs/view/13'></a><a href='https://other/1'>x</a>"
    assert extract("a@linkedin.com", mail) == [("linkedin", "https://www.linkedin.com/comm/jobs/view/12?x=1&y=2", "Dev & Ops", "Acme", "Pune")]
    assert extract("a@else.com", mail) == [] and extract(None, None) == [] and extract("a@linkedin.com", "<a href='x") == []


def test_robots(spark):
    f = spark.createDataFrame([("h", "User-agent: *\nDisallow: /\nUser-agent: loom\nUser-agent: b\nDisallow: /x*\nAllow: /x/ok\nDisallow: /*.pdf$\n# c"), ("e", ""), ("n", None)], "host string, body string")
    rules = robots_rules(f, "host", "body", "loom/1")
    u = spark.createDataFrame([("h", "/x/1"), ("h", "/x/ok/2"), ("h", "/a.pdf"), ("h", "/a.pdf?x"), ("h", "/b"), ("e", "/x"), ("n", "/")], "h string, p string")
    assert {(r["h"], r["p"]): r["allowed"] for r in robots_allowed(u, "h", "p", rules).collect()} == {("h", "/x/1"): False, ("h", "/x/ok/2"): True, ("h", "/a.pdf"): False, ("h", "/a.pdf?x"): True, ("h", "/b"): True, ("e", "/x"): True, ("n", "/"): True}


def test_stream_state_lasts_over_batches(spark, tmp_path):
    src = tmp_path / "in"
    rows = [(i, 1, dt.datetime(2024, 1, 1, 0, i), i != 2) for i in range(6)]
    s = "event_id bigint, user_id bigint, ts timestamp, failed boolean"
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, s).coalesce(1).write.mode("append").parquet(str(src))
        x = feeds.circuit_stream(feeds.read_stream(spark, str(src), s), "user_id", "ts", "event_id", "failed", threshold=2, base=10)
        feeds.run_to_parquet(x, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r["event_id"]: (r["failures"], r["open_s"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: (1, 0), 1: (2, 10), 2: (0, 0), 3: (1, 0), 4: (2, 10), 5: (3, 20)}


def test_replay(spark):
    assert feeds.replay(spark.range(500).withColumnRenamed("id", "event_id"), 450, 20).count() == 20
    assert feeds.replay(spark.range(500).withColumnRenamed("id", "event_id"), 490, 20).agg(F.min("event_id")).first()[0] == 491
