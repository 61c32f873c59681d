"""Feeds, joins, aggregates, folds over event logs: queries over the star schema and the event stream, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postloom.operators import relational as R
from postloom.sources.tables import table

Q: dict = {}
SQL: dict[str, str] = {}
NOW = "1998-08-02"


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- ranked feeds -------------------------------------------------------------------------------------------------------
_FEED_SQL = """
WITH f AS (
  SELECT o_orderkey, c_name, n_name, o_orderpriority,
         round(least(o_totalprice / 5000.0, 100.0) * CASE n_regionkey WHEN 2 THEN 1.2 WHEN 3 THEN 1.05 ELSE 1.0 END, 4) AS priority
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE o_orderstatus = 'O'
)
"""


def feed(spark: SparkSession, d: str) -> DataFrame:
    """Open orders with customer and nation, ranked by a capped price times a region factor."""
    o = table(spark, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = table(spark, d, "nation")
    x = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    factor = F.when(F.col("n_regionkey") == 2, 1.2).when(F.col("n_regionkey") == 3, 1.05).otherwise(1.0)
    return x.select("o_orderkey", "c_name", "n_name", "o_orderpriority", F.round(F.least(F.col("o_totalprice") / 5000.0, F.lit(100.0)) * factor, 4).alias("priority"))


@query(_FEED_SQL + "SELECT * FROM f ORDER BY priority DESC, o_orderkey LIMIT 25")
def feed_topk(spark, d):
    return R.page(feed(spark, d), "priority", "o_orderkey", 25)


@query(_FEED_SQL + ", p AS (SELECT *, row_number() OVER (ORDER BY priority DESC, o_orderkey) AS rn FROM f) SELECT * EXCLUDE (rn) FROM p WHERE rn BETWEEN 26 AND 50")
def feed_page2(spark, d):
    x = feed(spark, d)
    last = R.page(x, "priority", "o_orderkey", 25).collect()[-1]
    after = R.decode_cursor(R.encode_cursor(last["priority"], last["o_orderkey"]))
    return R.page(x, "priority", "o_orderkey", 25, after)


@query(_FEED_SQL + "SELECT * FROM f WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND priority >= 50 ORDER BY priority DESC, o_orderkey LIMIT 100")
def feed_filtered(spark, d):
    return R.page(R.optional_filters(feed(spark, d), {"o_orderpriority": ["1-URGENT", "2-HIGH"], "n_name": None}, {"priority": 50}), "priority", "o_orderkey", 100)


# --- joins ----------------------------------------------------------------------------------------------------------------
@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def undelivered_antijoin(spark, d):
    """Customers without an urgent order."""
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey")
    return table(spark, d, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def delivered_semijoin(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'")
    return table(spark, d, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@query(
    "SELECT c_custkey, coalesce(count(o_orderkey), 0)::BIGINT AS n_urgent, coalesce(round(sum(o_totalprice), 2), 0) AS total FROM customer "
    "LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY c_custkey"
)
def left_join_on_constant(spark, d):
    """The right side is filtered before the outer join, so customers without such an order stay."""
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    x = table(spark, d, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
    return x.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_urgent"), F.coalesce(F.round(F.sum("o_totalprice"), 2), F.lit(0.0)).alias("total"))


@query(
    "SELECT n_name, r_name, count(*)::BIGINT AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem "
    "JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey "
    "JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name"
)
def star_join_revenue(spark, d):
    t = lambda n: table(spark, d, n)
    x = t("lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    x = x.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    x = x.join(t("supplier").select("s_suppkey", "s_nationkey"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("s_nationkey") == F.col("c_nationkey")))
    x = x.join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return x.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT p_partkey, p_brand FROM part WHERE list_contains(['Brand#11', 'Brand#12', 'Brand#13'], p_brand) AND NOT (p_type = ANY(['STANDARD']))")
def array_membership(spark, d):
    return table(spark, d, "part").where(F.array_contains(F.array(F.lit("Brand#11"), F.lit("Brand#12"), F.lit("Brand#13")), F.col("p_brand")) & (F.col("p_type") != "STANDARD")).select("p_partkey", "p_brand")


@query("SELECT doc_id, 1.0 * n_chars / length(text) AS ratio FROM documents WHERE n_chars IS DISTINCT FROM length(text) AND length(text) > 0")
def distinct_from(spark, d):
    x = table(spark, d, "documents").where(~F.col("n_chars").eqNullSafe(F.length("text").cast("bigint")) & (F.length("text") > 0))
    return x.select("doc_id", (F.col("n_chars").cast("double") / F.length("text")).alias("ratio"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%' || 'GE' || '%' ORDER BY p_name, p_partkey LIMIT 50")
def contains_ilike(spark, d):
    return table(spark, d, "part").where(F.col("p_name").ilike("%GE%")).select("p_partkey", "p_name").orderBy("p_name", "p_partkey").limit(50)


# --- aggregates -------------------------------------------------------------------------------------------------------------
@query("SELECT count(*) FILTER (WHERE o_orderstatus = 'O')::BIGINT AS n_open, count(*) FILTER (WHERE o_orderstatus = 'F')::BIGINT AS n_done, count(*) FILTER (WHERE o_orderstatus = 'P')::BIGINT AS n_part FROM orders")
def pipeline_counts(spark, d):
    s = lambda v: F.count_if(F.col("o_orderstatus") == v)
    return table(spark, d, "orders").agg(s("O").alias("n_open"), s("F").alias("n_done"), s("P").alias("n_part"))


@query(
    "SELECT event_type AS queue, count(*) FILTER (WHERE value >= 20)::BIGINT AS waiting, coalesce(max(epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) FILTER (WHERE value >= 20), 0) AS oldest_us FROM events GROUP BY event_type"
)
def queue_depth(spark, d):
    x = table(spark, d, "events")
    age = F.lit(1_706_745_600_000_000).cast("bigint") - F.unix_micros(F.col("ts").cast("timestamp"))
    w = F.col("value") >= 20
    return x.groupBy(F.col("event_type").alias("queue")).agg(F.count_if(w).alias("waiting"), F.coalesce(F.max(F.when(w, age)), F.lit(0)).alias("oldest_us"))


@query("SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS hour, count(*)::BIGINT AS n, round(avg(value), 4) AS mean FROM events GROUP BY ALL")
def metrics_rate(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.date_trunc("HOUR", F.col("ts")).cast("timestamp_ntz").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95 FROM events GROUP BY event_type")
def latency_quantiles(spark, d):
    x = R.exact_quantiles(table(spark, d, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})
    return x.select("event_type", F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"))


@query(
    "SELECT l_orderkey, l_linenumber, n_peers, round(CASE WHEN n_brand >= 20 THEN 100.0 * r_brand / n_brand WHEN n_type >= 20 THEN 100.0 * r_type / n_type END, 4) AS percentile FROM ("
    "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY p_brand, p_type)::BIGINT AS n_peers, count(*) OVER (PARTITION BY p_brand, p_type) AS n_brand, count(*) OVER (PARTITION BY p_type) AS n_type,"
    " count(*) OVER (PARTITION BY p_brand, p_type ORDER BY l_extendedprice RANGE UNBOUNDED PRECEDING) AS r_brand, count(*) OVER (PARTITION BY p_type ORDER BY l_extendedprice RANGE UNBOUNDED PRECEDING) AS r_type"
    " FROM lineitem JOIN part ON l_partkey = p_partkey)"
)
def comp_percentile_ladder(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    x = li.join(table(spark, d, "part").select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    x = x.withColumn("n_peers", F.count(F.lit(1)).over(Window.partitionBy("p_brand", "p_type")))
    x = R.percentile_ladder(x, "l_extendedprice", [["p_brand", "p_type"], ["p_type"]])
    return x.select("l_orderkey", "l_linenumber", "n_peers", F.round(100 * F.col("percentile"), 4).alias("percentile"))


@query(
    "SELECT l_orderkey, l_linenumber, round(((0.5 * l_quantity) + CASE WHEN l_discount > 0 THEN 0.3 * l_discount ELSE 0 END + CASE WHEN l_returnflag = 'N' THEN 0.2 * l_tax ELSE 0 END)"
    " / (0.5 + CASE WHEN l_discount > 0 THEN 0.3 ELSE 0 END + CASE WHEN l_returnflag = 'N' THEN 0.2 ELSE 0 END), 6) AS score FROM lineitem"
)
def weighted_renormalized(spark, d):
    v = {"a": F.col("l_quantity"), "b": F.when(F.col("l_discount") > 0, F.col("l_discount")), "c": F.when(F.col("l_returnflag") == "N", F.col("l_tax"))}
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(R.weighted({"a": 0.5, "b": 0.3, "c": 0.2, "never": 0.4}, v), 6).alias("score"))


@query(f"SELECT o_orderkey, round(0.55 + 0.45 * exp(-greatest(epoch_us(TIMESTAMP '{NOW}') - epoch_us(o_orderdate), 0) / 86400e6 * ln(2.0) / 14.0), 6) AS freshness FROM orders")
def freshness_decay(spark, d):
    age = (F.lit(902_016_000_000_000) - F.unix_micros(F.col("o_orderdate").cast("timestamp"))) / 86400e6
    return table(spark, d, "orders").select("o_orderkey", F.round(R.decay(age), 6).alias("freshness"))


@query(
    f"SELECT o_orderkey, CASE WHEN d < 0 THEN 0 WHEN d < 3 THEN 100 WHEN d < 7 THEN 85 WHEN d < 14 THEN 65 WHEN d < 30 THEN 40 ELSE 20 END AS urgency FROM (SELECT o_orderkey, (epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1998-07-01')) / 86400e6 AS d FROM orders)"
)
def banded_urgency(spark, d):
    from postloom.operators.rules import ladder

    left = (F.unix_micros(F.col("o_orderdate").cast("timestamp")) - F.lit(899_251_200_000_000)) / 86400e6
    return table(spark, d, "orders").select("o_orderkey", ladder([(left < 0, 0), (left < 3, 100), (left < 7, 85), (left < 14, 65), (left < 30, 40)], 20).alias("urgency"))


# --- folds --------------------------------------------------------------------------------------------------------------------
@query(
    "SELECT user_id, n, round(s, 6) AS ema FROM (SELECT user_id, count(*)::BIGINT AS n, sum(0.01 * x * power(0.99, age)) AS s FROM ("
    "SELECT user_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS age FROM events) GROUP BY user_id)"
)
def yield_ema(spark, d):
    return R.ema(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "purchase").withColumn("ema", F.round("ema", 6))


@query(
    "WITH e AS (SELECT *, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS f FROM events), g AS (SELECT *, sum(1 - f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM e),"
    " r AS (SELECT *, sum(f) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS failures FROM g)"
    " SELECT event_id, user_id, failures::BIGINT AS failures, CASE WHEN failures >= 3 THEN least(21600, 60 * power(2, failures - 3))::BIGINT ELSE 0 END AS open_s FROM r"
)
def circuit_state(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return R.circuit_state(e, "user_id", ["ts", "event_id"], F.col("event_type") == "error", threshold=3).select("event_id", "user_id", "failures", "open_s")


@query(
    "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)::BIGINT AS n_day,"
    " count(*) OVER (PARTITION BY user_id, event_type ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)::BIGINT AS n_day_type FROM (SELECT event_id, user_id, event_type, date_trunc('second', ts) AS ts FROM events)"
)
def sliding_budget(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", R.sliding_count(e, ["user_id"], "ts", 86400).alias("n_day"), R.sliding_count(e, ["user_id", "event_type"], "ts", 86400).alias("n_day_type"))


@query(
    "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, arg_max(value, (ts, event_id)) FILTER (WHERE value > 20) AS last_large, arg_min(value, (ts, event_id)) FILTER (WHERE event_type = 'purchase') AS first_bought, bool_or(event_type = 'error') AS ever_failed FROM events GROUP BY user_id"
)
def state_latest_sticky(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("state"), F.when(F.col("value") > 20, F.col("value")).alias("last_large"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("first_bought"), (F.col("event_type") == "error").alias("ever_failed"))
    return R.sticky_state(e, ["user_id"], ["ts", "event_id"], ["state"], ["last_large"], ["first_bought"], ["ever_failed"])


_ALLOWED = [("signup", "view"), ("view", "click"), ("click", "purchase"), ("click", "view"), ("purchase", "view"), ("error", "view")]


@query(
    "SELECT event_id, from_state, event_type FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state FROM events) WHERE from_state IS NOT NULL AND from_state <> event_type"
    " AND (from_state, event_type) NOT IN (" + ", ".join(f"('{a}', '{b}')" for a, b in _ALLOWED) + ")"
)
def fsm_validate(spark, d):
    allowed = spark.createDataFrame(_ALLOWED, "from_state string, to_state string")
    return R.invalid_transitions(table(spark, d, "events").select("event_id", "user_id", "ts", "event_type"), "user_id", ["ts", "event_id"], "event_type", allowed).select("event_id", "from_state", "event_type")


@query("SELECT * FROM (SELECT user_id, event_type, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1) WHERE user_id % 7 <> 0 OR event_type <> 'view'")
def notify_once(spark, d):
    """Insert-if-absent of the first event of each user and type; some keys are there already."""
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "ts")
    there = e.where("user_id % 7 = 0 AND event_type = 'view'")
    return R.insert_if_absent(there, e, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")])


@query(
    "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)"
    " UNION ALL SELECT c_custkey, -1, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"
)
def upsert_latest(spark, d):
    now = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(-1).cast("bigint").alias("o_orderkey"), F.col("c_acctbal").alias("o_totalprice"))
    return R.upsert(now, table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])


@query("SELECT user_id, strftime(ts, '%Y-%m') AS month, event_type, min(event_id) AS event_id, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def month_scoped_dedup(spark, d):
    """One row per key and calendar month, the first, with the number seen."""
    return table(spark, d, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM").alias("month"), "event_type").agg(F.min("event_id").alias("event_id"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, ts + INTERVAL 330 MINUTE AS local_ts, (date_trunc('hour', ts + INTERVAL 330 MINUTE + INTERVAL 59 MINUTE + INTERVAL 59999999 MICROSECOND) - INTERVAL 330 MINUTE)::TIMESTAMP AS next_hour FROM events")
def hour_batch(spark, d):
    """Next full hour of a zone half an hour off UTC; an exact hour stays."""
    return table(spark, d, "events").selectExpr(
        "event_id", "ts + INTERVAL 330 MINUTES AS local_ts", "cast(date_trunc('HOUR', ts + INTERVAL 330 MINUTES + INTERVAL '59:59.999999' MINUTE TO SECOND) AS timestamp_ntz) - INTERVAL 330 MINUTES AS next_hour"
    )


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50")
def json_props_parse(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k")).where("k > 50")


@query("SELECT user_id, date_trunc('hour', ts)::TIMESTAMP AS hour, list(event_type || ':' || event_id ORDER BY value DESC, event_id)[1:10] AS top, count(*)::BIGINT AS n FROM events WHERE event_type <> 'view' GROUP BY ALL")
def batch_collapse(spark, d):
    """What a user waits for in an hour as one message: the ten entries of the highest value in order, and how many there are; a hot hour keeps ten rows a task."""
    x = table(spark, d, "events").where("event_type <> 'view'").select("user_id", F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("hour"), "value", "event_id", "event_type")
    w = Window.partitionBy("user_id", "hour").orderBy(F.desc("value"), "event_id")
    top = x.withColumn("r", F.row_number().over(w)).where("r <= 10").groupBy("user_id", "hour").agg(F.collect_list(F.struct("r", "event_type", "event_id")).alias("e"))
    top = top.select("user_id", "hour", F.transform(F.array_sort("e"), lambda s: F.concat_ws(":", s["event_type"], s["event_id"])).alias("top"))
    return top.join(x.groupBy("user_id", "hour").agg(F.count(F.lit(1)).alias("n")), ["user_id", "hour"])


@query(
    "WITH c AS (SELECT label, CASE WHEN embedding[1] > 0 THEN label ELSE (label + 1) % 10 END AS predicted FROM embeddings), k AS (SELECT DISTINCT label FROM c),"
    " m AS (SELECT k.label, count(*) FILTER (WHERE c.label = k.label AND predicted = k.label) AS tp, count(*) FILTER (WHERE c.label <> k.label AND predicted = k.label) AS fp, count(*) FILTER (WHERE c.label = k.label AND predicted <> k.label) AS fn FROM k CROSS JOIN c GROUP BY k.label)"
    " SELECT label, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM m"
)
def eval_prf1(spark, d):
    """Counts and F1 per class from one pass: each row votes for its own class and for the predicted one."""
    x = table(spark, d, "embeddings").select("label", F.when(F.col("embedding")[0] > 0, F.col("label")).otherwise((F.col("label") + 1) % 10).alias("predicted"))
    ok = F.col("label") == F.col("predicted")
    votes = x.select(F.explode(F.array(F.struct(F.col("label").alias("c"), ok.alias("hit"), (~ok).alias("missed"), F.lit(False).alias("wrong")), F.struct(F.col("predicted").alias("c"), F.lit(False).alias("hit"), F.lit(False).alias("missed"), (~ok).alias("wrong")))).alias("v"))
    m = votes.groupBy(F.col("v.c").alias("label")).agg(F.count_if("v.hit").alias("tp"), F.count_if("v.wrong").alias("fp"), F.count_if("v.missed").alias("fn"))
    m = m.join(x.select("label").distinct(), "label", "left_semi")
    n = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return m.withColumn("f1", F.round(F.when(n > 0, 2.0 * F.col("tp") / n).otherwise(0.0), 6))


@query(
    "WITH r AS (SELECT strftime(ts, '%Y-%m-%d') AS day, round(avg(value), 4) AS score FROM events GROUP BY ALL), p AS (SELECT *, score >= 15 AS passed, last_value(CASE WHEN score >= 15 THEN score END IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_passing FROM r)"
    " SELECT day, score, passed, last_passing, coalesce(last_passing - score > 0.03, false) AS regressed FROM p"
)
def eval_regression(spark, d):
    """Daily scores against the last day that passed the gate."""
    runs = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.round(F.avg("value"), 4).alias("score"))
    return R.against_last_passing(runs.withColumn("suite", F.lit("daily")), "day", "score", 15.0, keys=["suite"]).drop("suite")


@query("SELECT event_id, CASE WHEN event_id % 600 IN (401, 403) THEN 'quarantine' WHEN event_id % 600 = 404 THEN 'not_found' WHEN event_id % 600 = 429 THEN 'rate_limited' ELSE 'normal' END AS action FROM events")
def status_actions(spark, d):
    return table(spark, d, "events").select("event_id", R.status_action(F.col("event_id") % 600).alias("action"))


QUERIES, ORACLE_SQL = Q, SQL
