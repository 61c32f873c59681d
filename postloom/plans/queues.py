"""What is due, who may work, what a failure costs, and how rows are found or made: queries over boards and events, each with its SQL."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postloom.functions.similarity import cosine
from postloom.operators import queueing as U
from postloom.operators import relational as R
from postloom.sources.bodies import decode_bodies
from postloom.sources.tables import table

Q: dict = {}
SQL: dict[str, str] = {}
#: The moments that stand for now over events and over boards.
NOW, BOARD_NOW = "2024-01-20 00:00:00", "2026-10-12 00:00:00"


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _at(text: str):
    return F.lit(text).cast("timestamp_ntz")


# --- work queues ---------------------------------------------------------------------------------------------------------------
_QUEUE = "SELECT event_id, event_type AS queue, floor(value)::BIGINT % 4 AS priority, ts AS scheduled_at, (user_id % 6)::INTEGER AS attempt, CASE user_id % 3 WHEN 0 THEN 'available' WHEN 1 THEN 'retryable' ELSE 'completed' END AS state FROM events"


def _queue(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("user_id")
    state = F.when(u % 3 == 0, "available").when(u % 3 == 1, "retryable").otherwise("completed")
    return table(spark, d, "events").select("event_id", F.col("event_type").alias("queue"), (F.floor("value") % 4).alias("priority"), F.col("ts").alias("scheduled_at"), (u % 6).cast("int").alias("attempt"), state.alias("state"))


@query(
    f"WITH q AS ({_QUEUE}) SELECT event_id, queue, priority, scheduled_at, attempt + 1 AS attempt, 'running' AS state FROM q WHERE queue = 'view' AND state IN ('available', 'retryable') AND scheduled_at <= TIMESTAMP '{NOW}' ORDER BY priority, scheduled_at, event_id LIMIT 50"
)
def queue_claim(spark, d):
    """The next fifty rows of a queue, taken."""
    due = (F.col("queue") == "view") & F.col("state").isin("available", "retryable") & (F.col("scheduled_at") <= _at(NOW))
    return U.claim(_queue(spark, d), [F.col("priority"), F.col("scheduled_at"), F.col("event_id")], due, 50)


@query(
    f"WITH q AS ({_QUEUE}) SELECT event_id, CASE WHEN attempt >= 5 THEN 'discarded' ELSE 'retryable' END AS state, CASE WHEN attempt < 5 THEN least(power(attempt, 4), 300)::BIGINT END AS wait_s FROM q WHERE queue = 'error'"
)
def retry_backoff(spark, d):
    """Failed rows: when they are tried again, or that they aren't."""
    state, wait = U.after_failure(F.col("attempt"), F.lit(5))
    return _queue(spark, d).where("queue = 'error'").select("event_id", state.alias("state"), wait.alias("wait_s"))


@query(
    f"SELECT source_id, priority_tier, last_polled_at FROM job_source WHERE status IN ('active', 'pending_review') AND last_polled_at <= TIMESTAMP '{BOARD_NOW}' - INTERVAL 1 HOUR * priority_tier ORDER BY priority_tier, last_polled_at, source_id LIMIT 40"
)
def due_sources(spark, d):
    """Boards whose next poll is due, the most important and longest waiting first."""
    x = table(spark, d, "job_source").where(F.col("status").isin("active", "pending_review"))
    x = x.where(F.col("last_polled_at") <= _at(BOARD_NOW) - F.make_dt_interval(hours=F.col("priority_tier")))
    return x.orderBy("priority_tier", "last_polled_at", "source_id").limit(40).select("source_id", "priority_tier", "last_polled_at")


@query(f"SELECT source_id, url, total_polls, yield_ratio FROM job_source WHERE status = 'pending_review' AND created_at <= TIMESTAMP '{BOARD_NOW}' - INTERVAL 48 HOUR ORDER BY created_at, source_id LIMIT 20")
def trial_sources(spark, d):
    """Boards on trial for 48 hours or more, the oldest first."""
    x = table(spark, d, "job_source").where((F.col("status") == "pending_review") & (F.col("created_at") <= _at(BOARD_NOW) - F.expr("INTERVAL 48 HOURS")))
    return x.orderBy("created_at", "source_id").limit(20).select("source_id", "url", "total_polls", "yield_ratio")


@query("SELECT count(*) FILTER (WHERE status = 'active')::BIGINT AS n_active, count(*)::BIGINT AS n FROM job_source")
def active_sources(spark, d):
    return table(spark, d, "job_source").agg(F.count_if(F.col("status") == "active").alias("n_active"), F.count(F.lit(1)).alias("n"))


@query(
    f"SELECT n.o_orderkey, n.o_custkey, n.o_orderdate FROM orders n LEFT JOIN lineitem l ON l.l_orderkey = n.o_orderkey AND l.l_returnflag = 'N' WHERE l.l_orderkey IS NULL AND n.o_orderdate <= TIMESTAMP '1995-06-17' ORDER BY n.o_orderdate, n.o_orderkey LIMIT 100"
)
def undelivered_due(spark, d):
    """What is due and not delivered yet, the oldest first."""
    done = table(spark, d, "lineitem").where("l_returnflag = 'N'").select("l_orderkey")
    x = table(spark, d, "orders").where(F.col("o_orderdate") <= _at("1995-06-17 00:00:00")).join(done, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")
    return x.orderBy("o_orderdate", "o_orderkey").limit(100).select("o_orderkey", "o_custkey", "o_orderdate")


# --- lookups and projections -----------------------------------------------------------------------------------------------------
@query("SELECT source_id, kind, status, adapter, json_extract_string(adapter_config, '$.token') AS token, yield_ratio FROM job_source WHERE source_id = (SELECT min(source_id) FROM posting)")
def source_by_id(spark, d):
    """One row by its key: the filter reaches the scan."""
    key = table(spark, d, "posting").agg(F.min("source_id")).first()[0]
    return table(spark, d, "job_source").where(F.col("source_id") == F.lit(key)).select("source_id", "kind", "status", "adapter", F.get_json_object("adapter_config", "$.token").alias("token"), "yield_ratio")


@query(
    "SELECT p.posting_id, p.title_raw, p.company_name_raw, p.location_raw, p.employment_type_raw, p.url, p.posted_at, s.kind, s.status, s.priority_tier, length(p.description_text)::BIGINT AS n_chars, p.deadline_at IS NOT NULL AS has_deadline FROM posting p JOIN job_source s USING (source_id)"
)
def posting_detail(spark, d):
    """The wide projection of a posting with its board."""
    s = table(spark, d, "job_source").select("source_id", "kind", "status", "priority_tier")
    return (
        table(spark, d, "posting").join(s, "source_id")
        .select("posting_id", "title_raw", "company_name_raw", "location_raw", "employment_type_raw", "url", "posted_at", "kind", "status", "priority_tier", F.length("description_text").cast("bigint").alias("n_chars"), F.col("deadline_at").isNotNull().alias("has_deadline"))
    )


@query(
    "SELECT o_orderkey, o_orderstatus, l_linenumber FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1 AND l_returnflag = 'R' WHERE o_orderstatus = 'O' OR l_orderkey IS NOT NULL"
)
def visible_rows(spark, d):
    """Open rows, and closed ones that have a mark: the condition spans the outer join."""
    mark = table(spark, d, "lineitem").where("l_linenumber = 1 AND l_returnflag = 'R'").select("l_orderkey", "l_linenumber")
    x = table(spark, d, "orders").select("o_orderkey", "o_orderstatus").join(mark, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return x.where((F.col("o_orderstatus") == "O") | F.col("l_orderkey").isNotNull()).select("o_orderkey", "o_orderstatus", "l_linenumber")


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS distance FROM embeddings a, embeddings b WHERE a.vec_id = 3 AND b.vec_id = 11")
def pair_distance(spark, d):
    """The distance of one stated pair: two point lookups, joined on a constant key."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    a = e.where("vec_id = 3").select(F.col("vec_id").alias("a"), F.col("embedding").alias("ea"), F.lit(1).alias("k"))
    b = e.where("vec_id = 11").select(F.col("vec_id").alias("b"), F.col("embedding").alias("eb"), F.lit(1).alias("k"))
    return a.join(b, "k").select("a", "b", F.round(1 - cosine(F.col("ea"), F.col("eb")), 4).alias("distance"))


@query("SELECT source_id, status FROM job_source WHERE NOT (status = ANY(['paused', 'quarantined']))")
def null_membership(spark, d):
    """Membership of a NULL is unknown, and so is its negation: such rows go."""
    return table(spark, d, "job_source").where(~F.array_contains(F.array(F.lit("paused"), F.lit("quarantined")), F.col("status"))).select("source_id", "status")


@query("SELECT posting_id, posted_at FROM posting WHERE source_id <> '' ORDER BY posted_at ASC NULLS FIRST, posting_id LIMIT 30")
def nulls_first(spark, d):
    return table(spark, d, "posting").orderBy(F.asc_nulls_first("posted_at"), "posting_id").limit(30).select("posting_id", "posted_at")


@query("SELECT doc_id, rank FROM (SELECT doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC NULLS LAST, doc_id)::INTEGER AS rank FROM documents) WHERE rank <= 20 OR n_chars IS NULL")
def nulls_last_rank(spark, d):
    """Ranks within a source, unknown sizes last."""
    w = Window.partitionBy("source").orderBy(F.desc_nulls_last("n_chars"), "doc_id")
    return table(spark, d, "documents").select("doc_id", "n_chars", F.row_number().over(w).alias("rank")).where("rank <= 20 OR n_chars IS NULL").select("doc_id", "rank")


# --- rows that are found or made ----------------------------------------------------------------------------------------------------
@query(
    "SELECT slug, min(id) AS id, bool_and(made) AS made FROM (SELECT slug, coalesce(s.source_id, 'new-' || sha256(slug)[1:12]) AS id, s.source_id IS NULL AS made FROM (SELECT DISTINCT ats_token AS slug FROM posting WHERE ats_token <> '')"
    " LEFT JOIN (SELECT json_extract_string(adapter_config, '$.token') AS token, source_id FROM job_source WHERE adapter = 'lever') s ON token = slug) GROUP BY slug"
)
def find_or_create(spark, d):
    """The id of each key: that of its row where there is one, else one made from the key, the same however often it is asked for."""
    wanted = table(spark, d, "posting").where("ats_token <> ''").select(F.col("ats_token").alias("slug"))
    have = table(spark, d, "job_source").where("adapter = 'lever'").select(F.get_json_object("adapter_config", "$.token").alias("slug"), F.col("source_id").alias("id"))
    return R.find_or_create(wanted, have, "slug", "id")


_SEEDS = [("AFRICA", "south"), ("ASIA", "east"), ("ATLANTIS", "under"), ("EUROPE", "north"), ("MU", "under")]
_SEED_ROWS = ", ".join(f"('{a}', '{b}')" for a, b in _SEEDS)


@query(
    f"SELECT r_name AS name, coalesce(s.side, 'none') AS side, r_regionkey::BIGINT AS id FROM region LEFT JOIN (VALUES {_SEED_ROWS}) AS s(name, side) ON s.name = r_name"
    f" UNION ALL SELECT name, side, NULL FROM (VALUES {_SEED_ROWS}) AS s(name, side) WHERE name NOT IN (SELECT r_name FROM region)"
)
def seed_upsert(spark, d):
    """Rows of a small list put into a table: known names take the new value, others are added."""
    seeds = spark.createDataFrame(_SEEDS, "name string, side string").withColumn("n", F.lit(1))
    now = table(spark, d, "region").select(F.col("r_name").alias("name"), F.lit("none").alias("side"), F.col("r_regionkey").cast("bigint").alias("id"))
    new = seeds.join(now.select("name", "id"), "name", "left").select("name", "side", "id")
    return R.upsert(now, new, ["name"], [F.col("side")])


# --- counters, slots, budgets ------------------------------------------------------------------------------------------------------
@query(
    "WITH e AS (SELECT user_id, event_type, value, ts, event_id, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS after FROM events)"
    " SELECT user_id, count(*)::BIGINT AS total_polls, count(*) FILTER (WHERE event_type <> 'error')::BIGINT AS total_successes, coalesce(sum(floor(value)) FILTER (WHERE event_type = 'view'), 0)::BIGINT AS jobs_found,"
    " count(*) FILTER (WHERE event_type = 'error' AND after = 0)::BIGINT AS failures, max(ts) FILTER (WHERE event_type = 'purchase') AS last_changed, count(*) FILTER (WHERE event_type = 'error' AND after = 0) >= 2 AS retire, 8.0 / power(2, count(*) FILTER (WHERE event_type = 'signup')) AS max_rate FROM e GROUP BY user_id"
)
def poll_counters(spark, d):
    """Counters of each key after its events: totals, failures in a row at the end, the last change, a rate halved at every signal, and whether to retire."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return R.poll_counters(
        e, "user_id", ["ts", "event_id"], failed=F.col("event_type") == "error", found=F.when(F.col("event_type") == "view", F.floor("value")),
        changed=F.col("event_type") == "purchase", slowed=F.col("event_type") == "signup", rate=8.0, retire_after=2,
    )


@query(
    "WITH s AS (SELECT event_id, user_id, ts, sum(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN -1 ELSE 0 END) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))"
    " SELECT event_id, (s - least(min(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0))::BIGINT AS in_use FROM s"
)
def concurrency_slots(spark, d):
    """Slots taken after each event, never below zero."""
    delta = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", -1).otherwise(0)
    return U.slots_in_use(table(spark, d, "events").select("event_id", "user_id", "ts", "event_type"), "user_id", ["ts", "event_id"], delta).select("event_id", "in_use")


TOKEN_SQL = (
    "WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),"
    " b(event_id, user_id, us, rn, allowed, tokens) AS (SELECT event_id, user_id, us, rn, true, 2.0::DOUBLE FROM e WHERE rn = 1 UNION ALL"
    " SELECT event_id, user_id, us, rn, lv >= 1, lv - CASE WHEN lv >= 1 THEN 1 ELSE 0 END FROM (SELECT e.event_id, e.user_id, e.us, e.rn, least(3.0, b.tokens + (e.us - b.us) / 1e6 / 3600.0)::DOUBLE AS lv FROM b JOIN e ON e.user_id = b.user_id AND e.rn = b.rn + 1))"
    " SELECT event_id, user_id, allowed, round(tokens, 4) AS tokens FROM b"
)


@query(TOKEN_SQL)
def token_bucket(spark, d):
    """Sequential admission per user: a rate of one an hour, bursts of three."""
    return R.token_bucket(table(spark, d, "events"), "user_id", "ts", "event_id", rate=1 / 3600, burst=3.0).withColumn("tokens", F.round("tokens", 4))


BUDGET_SQL = (
    "WITH RECURSIVE e AS (SELECT event_id, user_id, event_type AS kind, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),"
    " b(event_id, user_id, rn, sent, log) AS (SELECT event_id, user_id, rn, true, [{'t': us, 'k': kind}] FROM e WHERE rn = 1 UNION ALL"
    " SELECT event_id, user_id, rn, ok, CASE WHEN ok THEN list_append(log, {'t': us, 'k': kind}) ELSE log END FROM (SELECT event_id, user_id, rn, us, kind, log,"
    " len(list_filter(log, lambda x: x.t > us - 3600000000)) < 1 AND len(log) < 3 AND len(list_filter(log, lambda x: x.k = kind)) < 2 AS ok FROM (SELECT e.event_id, e.user_id, e.rn, e.us, e.kind, list_filter(b.log, lambda x: x.t > e.us - 86400000000) AS log FROM b JOIN e ON e.user_id = b.user_id AND e.rn = b.rn + 1)))"
    " SELECT event_id, user_id, sent FROM b"
)


@query(BUDGET_SQL)
def sequential_budgets(spark, d):
    """Which events are sent where each one sent counts against those after it: one an hour, three a day, two of a kind a day."""
    x = U.within_budgets(table(spark, d, "events"), "user_id", "ts", "event_id", "event_type", per_hour=1, per_day=3, per_kind_day=2)
    return x.select("event_id", "user_id", "sent")


@query(f"SELECT user_id, (epoch(TIMESTAMP '{NOW}')::BIGINT - floor(epoch(max(ts)))::BIGINT) AS age_s, (epoch(TIMESTAMP '{NOW}')::BIGINT - floor(epoch(max(ts)))::BIGINT) <= 864000 AS alive FROM events WHERE ts <= TIMESTAMP '{NOW}' GROUP BY user_id")
def liveness(spark, d):
    """Seconds since the last sign of each key, and whether that is recent enough."""
    return U.stale(table(spark, d, "events").where(F.col("ts") <= _at(NOW)), "user_id", "ts", _at(NOW), 864_000)


_BOUNDS = [1.0, 2.5, 5.0, 10.0, 15.0, 20.0, 30.0, 60.0, 120.0]
_LOWS = [0.0, *_BOUNDS[:-1]]


def _histogram_sql(q: float) -> str:
    b = ", ".join(f"({i}, {lo}, {hi})" for i, (lo, hi) in enumerate(zip(_LOWS, _BOUNDS, strict=True)))
    return (
        f"(SELECT event_type, max(n) AS n, coalesce(arg_min(lo + (hi - lo) * coalesce((n * {q} - below) / nullif(le - below, 0), 0), i) FILTER (WHERE le >= n * {q}), {_BOUNDS[-1]}) AS v FROM ("
        f"SELECT event_type, i, lo, hi, le, lag(le, 1, 0) OVER (PARTITION BY event_type ORDER BY i) AS below, n FROM (SELECT event_type, i, lo, hi, count(*) FILTER (WHERE value <= hi) AS le, count(*) AS n FROM events, (VALUES {b}) AS b(i, lo, hi) WHERE value IS NOT NULL GROUP BY ALL)) GROUP BY event_type)"
    )


@query(f"SELECT a.event_type, a.n::BIGINT AS n, round(a.v, 4) AS p50, round(b.v, 4) AS p95 FROM {_histogram_sql(0.5)} a JOIN {_histogram_sql(0.95)} b USING (event_type)")
def histogram_quantiles(spark, d):
    """Quantiles from cumulative buckets, linear within a bucket."""
    e = table(spark, d, "events").select("event_type", "value")
    x, y = (U.histogram_quantile(e, ["event_type"], "value", _BOUNDS, q) for q in (0.5, 0.95))
    x = x.select("event_type", "n", F.round("quantile", 4).alias("p50"))
    return x.join(y.select("event_type", F.round("quantile", 4).alias("p95")), "event_type")


_AFTER = "CASE event_id % 4 WHEN 0 THEN (event_id % 900)::VARCHAR WHEN 1 THEN 'Mon, 08 Jan 2024 10:20:30 GMT' WHEN 2 THEN ' 120 ' ELSE 'soon' END"


@query(
    f"SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch(TIMESTAMP '{NOW}')::BIGINT + event_id % 900 WHEN 1 THEN epoch(TIMESTAMP '2024-01-08 10:20:30')::BIGINT WHEN 2 THEN epoch(TIMESTAMP '{NOW}')::BIGINT + 120 END AS until_s FROM events"
)
def retry_after(spark, d):
    """Moments until which to wait, from whole seconds or an HTTP date; other texts say nothing."""
    i = F.col("event_id") % 4
    text = F.when(i == 0, (F.col("event_id") % 900).cast("string")).when(i == 1, "Mon, 08 Jan 2024 10:20:30 GMT").when(i == 2, " 120 ").otherwise("soon")
    return table(spark, d, "events").select("event_id", F.unix_seconds(R.retry_after(text, F.lit(NOW).cast("timestamp"))).alias("until_s"))


@query("SELECT doc_id, least(octet_length(encode(text)), 2000)::BIGINT AS n_bytes, octet_length(encode(text)) > 2000 AS truncated, CASE WHEN octet_length(encode(text)) <= 2000 THEN sha256(text) END AS text_hash FROM documents")
def capped_bodies(spark, d):
    """Bodies decoded by their encoding and capped at 2,000 bytes (the cap is the operation), with what was cut off flagged."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            body = [None if t is None else gzip.compress(t.encode(), 1) if i % 2 else t.encode() for i, t in zip(ids, b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(body, pa.binary()), pa.array(["gzip" if i % 2 else "identity" for i in ids], pa.string())], ["doc_id", "body", "encoding"])

    x = decode_bodies(table(spark, d, "documents").select("doc_id", "text").mapInArrow(pack, "doc_id bigint, body binary, encoding string"), "body", "encoding", 2000)
    return x.select("doc_id", F.octet_length("body").cast("bigint").alias("n_bytes"), "truncated", F.when(~F.col("truncated"), F.sha2("body", 256)).alias("text_hash"))


@query("SELECT user_id, event_type, count(*)::BIGINT AS observations, max(ts) AS last_seen, min(event_id) AS first_event FROM events GROUP BY user_id, event_type")
def touch(spark, d):
    """Observations of each record counted up and its last sight moved on, as one aggregate."""
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("observations"), F.max("ts").alias("last_seen"), F.min("event_id").alias("first_event"))


@query(
    "WITH n AS (SELECT user_id, count(*) FILTER (WHERE epoch_us(ts) >= epoch_us(TIMESTAMP '2024-01-19')) AS used FROM events WHERE ts <= TIMESTAMP '2024-01-20' GROUP BY user_id) SELECT user_id, used::BIGINT AS used, round(used / 25.0, 4) AS ratio FROM n"
)
def budget_ratio(spark, d):
    """Calls of the last day against the budget of a day."""
    e = table(spark, d, "events").where(F.col("ts") <= _at(NOW))
    return e.groupBy("user_id").agg(F.count_if(F.col("ts") >= _at("2024-01-19 00:00:00")).alias("used")).withColumn("ratio", F.round(F.col("used") / 25.0, 4))


QUERIES, ORACLE_SQL = Q, SQL
