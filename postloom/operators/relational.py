"""Relational operators shared by the queries: feeds, upserts, folds, budgets, vectors, search."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.functions.similarity import cosine


# --- serving -----------------------------------------------------------------------------------------------------------
def encode_cursor(value: float, key: int | str) -> str:
    return base64.urlsafe_b64encode(json.dumps([value, key]).encode()).decode()


def decode_cursor(cursor: str) -> tuple[float, int | str]:
    v, k = json.loads(base64.urlsafe_b64decode(cursor.encode()))
    return v, k


def page(df: DataFrame, rank: str, key: str, limit: int = 25, after: tuple | None = None, most: int = 100) -> DataFrame:
    """Keyset page by (rank descending, key ascending): TakeOrdered, no offset; every row is on exactly one page."""
    if after is not None:
        df = df.where((F.col(rank) < after[0]) | ((F.col(rank) == after[0]) & (F.col(key) > after[1])))
    return df.orderBy(F.col(rank).desc_nulls_last(), F.col(key)).limit(max(1, min(limit, most)))


def optional_filters(df: DataFrame, one_of: dict[str, Sequence | None], at_least: dict[str, object] | None = None) -> DataFrame:
    """Filters whose parameter is None don't apply; an empty list keeps nothing."""
    for c, values in one_of.items():
        if values is not None:
            df = df.where(F.col(c).isin(*values) if values else F.lit(False))
    for c, v in (at_least or {}).items():
        if v is not None:
            df = df.where(F.col(c) >= v)
    return df


# --- writes as sets ----------------------------------------------------------------------------------------------------
def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def upsert(current: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``current`` with the rows of ``new`` put in the place of those with the same key; of several new rows the first in ``order``."""
    last = latest_per_key(new, keys, order).select(*current.columns)
    return current.join(last.select(*keys), keys, "left_anti").select(*last.columns).unionByName(last)


def insert_if_absent(current: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The rows of ``new`` that an insert ignoring conflicts would add: absent keys, the first row of each."""
    return latest_per_key(new.join(current.select(*keys).distinct(), keys, "left_anti"), keys, order)


def find_or_create(wanted: DataFrame, existing: DataFrame, key: str, id_col: str, prefix: str = "new-") -> DataFrame:
    """``key, id, made``: the smallest existing id of each wanted key, or one made from a hash of the key, the same in every run. NULL keys get none."""
    have = existing.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(id_col).alias("_have"))
    x = wanted.where(F.col(key).isNotNull()).select(key).distinct().join(have, key, "left")
    made = F.concat(F.lit(prefix), F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 12))
    return x.select(key, F.coalesce(F.col("_have").cast("string"), made).alias(id_col), F.col("_have").isNull().alias("made"))


def sticky_state(events: DataFrame, keys: list[str], order: list[str], last: list[str], last_known: list[str], first_known: list[str], ever: list[str]) -> DataFrame:
    """State of each key after its events: last value, last non-NULL, first non-NULL, or whether ever true.

    Reduced by max_by/min_by on the map side: no window, no sort of a key's whole history.
    """
    o = F.struct(*order)
    known = lambda f, c: f(F.when(F.col(c).isNotNull(), F.struct(o.alias("o"), F.col(c).alias("v"))))["v"].alias(c)
    return events.groupBy(*keys).agg(
        *[F.max_by(c, o).alias(c) for c in last],
        *[known(F.max, c) for c in last_known],
        *[known(F.min, c) for c in first_known],
        *[F.bool_or(F.coalesce(c, F.lit(False))).alias(c) for c in ever],
    )


def invalid_transitions(events: DataFrame, key: str, order: list[str], state: str, allowed: DataFrame) -> DataFrame:
    """Events whose state can't follow the one before; staying is allowed, and so is any first state. ``allowed``: ``from_state, to_state``."""
    w = Window.partitionBy(key).orderBy(*order)
    x = events.withColumn("from_state", F.lag(state).over(w)).where((F.col("from_state").isNotNull()) & (F.col("from_state") != F.col(state)))
    return x.join(allowed.withColumnRenamed("to_state", state), ["from_state", state], "left_anti")


# --- folds over event logs -----------------------------------------------------------------------------------------------
def ema(events: DataFrame, key: str, order: list[str], x: Column, alpha: float = 0.01) -> DataFrame:
    """``key, n, ema`` from 0 in closed form: sum of alpha x (1 - alpha)^(n - i)."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    r = events.select(key, x.cast("double").alias("_x"), (F.row_number().over(w) - 1).alias("_age"))
    return r.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.lit(alpha) * F.col("_x") * F.pow(F.lit(1 - alpha), "_age")).alias("ema"))


def poll_counters(events: DataFrame, key: str, order: list[str], failed: Column, found: Column, changed: Column, slowed: Column, rate: float, retire_after: int) -> DataFrame:
    """``key, total_polls, total_successes, jobs_found, failures, last_changed, retire, max_rate`` after the events of each key.

    ``failures`` are those in a row at the end: the failures after the last success, which a maximum finds on the map side, so no history is sorted. ``max_rate``
    is halved by every event that is ``slowed``. NULL conditions count as false.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    o = F.struct(*order)
    x = events.select(key, o.alias("_o"), F.col(order[0]).alias("_ts"), yes(failed).alias("_f"), found.alias("_n"), yes(changed).alias("_c"), yes(slowed).alias("_s"))
    last_ok = x.where("NOT _f").groupBy(key).agg(F.max("_o").alias("_ok"))
    total = x.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_polls"), F.count_if(~F.col("_f")).alias("total_successes"), F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("jobs_found"),
        F.max(F.when(F.col("_c"), F.col("_ts"))).alias("last_changed"), F.count_if("_s").alias("_slow"),
    )
    tail = x.where("_f").join(last_ok, key, "left").where(F.col("_ok").isNull() | (F.col("_o") > F.col("_ok"))).groupBy(key).agg(F.count(F.lit(1)).alias("_fails"))
    y = total.join(tail, key, "left").withColumn("failures", F.coalesce("_fails", F.lit(0)))
    return y.select(key, "total_polls", "total_successes", "jobs_found", "failures", "last_changed", (F.col("failures") >= retire_after).alias("retire"), (F.lit(rate) / F.pow(F.lit(2.0), "_slow")).alias("max_rate"))


def circuit_state(events: DataFrame, key: str, order: list[str], failed: Column, threshold: int = 5, base: int = 60, most: int = 21_600) -> DataFrame:
    """Consecutive failures after each event, and the seconds for which the circuit is open then (doubling, capped)."""
    w = Window.partitionBy(key).orderBy(*order)
    x = events.withColumn("_f", failed.cast("int")).withColumn("_g", F.sum(1 - F.col("_f")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("failures", F.sum("_f").over(Window.partitionBy(key, "_g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    secs = F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), F.col("failures") - threshold)).cast("bigint")
    return x.withColumn("open_s", F.when(F.col("failures") >= threshold, secs).otherwise(F.lit(0).cast("bigint"))).drop("_f", "_g")


def sliding_count(events: DataFrame, keys: list[str], ts: str, seconds: int) -> Column:
    """Events of the same keys in the last ``seconds`` up to and with each event."""
    s = F.unix_seconds(F.col(ts).cast("timestamp"))
    return F.count(F.lit(1)).over(Window.partitionBy(*keys).orderBy(s).rangeBetween(-seconds, 0))


def token_bucket(events: DataFrame, key: str, ts: str, order: str, rate: float, burst: float) -> DataFrame:
    """Events with ``allowed`` and ``tokens`` left: the bucket refills by time, each allowed event takes one.

    A decision depends on all before it, but only through the level and the moment of the last event: the rows of a key come in batches, sorted by
    the shuffle, and two numbers are kept, so a key may be of any size. NULL keys have no bucket and no rows.
    """
    names = dict(events.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, level, at = object(), burst, None
        for pdf in batches:
            ok, left = [], []
            for k, s in zip(pdf[key], pdf["_s"], strict=True):
                if k != now:
                    now, level, at = k, burst, None
                level = min(burst, level + (0 if at is None else s - at) * rate)
                at = s
                ok.append(level >= 1)
                level -= 1 if level >= 1 else 0
                left.append(level)
            yield pd.DataFrame({key: pdf[key], order: pdf[order], "allowed": ok, "tokens": left})

    x = events.where(F.col(key).isNotNull()).select(key, order, (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("_s"))
    return x.repartition(key).sortWithinPartitions(key, "_s", order).mapInPandas(run, f"{key} {names[key]}, {order} {names[order]}, allowed boolean, tokens double")


# --- scores ----------------------------------------------------------------------------------------------------------------
def weighted(weights: dict[str, float], values: dict[str, Column]) -> Column:
    """Weighted mean over the values that are there; 0 if none is."""
    num = sum((F.coalesce(v * weights[k], F.lit(0.0)) for k, v in values.items() if k in weights), F.lit(0.0))
    den = sum((F.when(v.isNotNull(), F.lit(weights[k])).otherwise(0.0) for k, v in values.items() if k in weights), F.lit(0.0))
    return F.when(den > 0, num / den).otherwise(0.0)


def percentile_ladder(df: DataFrame, value: str, ladders: list[list[str]], least: int = 20) -> DataFrame:
    """``df`` with ``percentile`` (inclusive) among the peers of the first key list with at least ``least`` of them, else NULL, and ``level``.

    Rows become one count per keys and value before they are sorted, so a window holds distinct values, not rows; the shares come back by joins on
    keys and value. Rows with a NULL in a key list have no peers there; NULL values have no percentile and are no peers.
    """
    out, pct, lvl = df, None, None
    for i, keys in enumerate(ladders):
        names = [f"_k{j}" for j in range(len(keys))]
        c = df.where(F.col(value).isNotNull()).groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
        w = Window.partitionBy(*names)
        c = c.withColumn(f"_n{i}", F.sum("_c").over(w)).withColumn(f"_p{i}", F.sum("_c").over(w.orderBy("_v")) / F.col(f"_n{i}")).drop("_c")
        on = F.col(value) == F.col("_v")
        for k, n in zip(keys, names, strict=True):
            on = on & (F.col(k) == F.col(n))
        out = out.join(c, on, "left").drop("_v", *names)
        ok = F.col(f"_n{i}") >= least
        pct = F.when(ok, F.col(f"_p{i}")) if pct is None else pct.when(ok, F.col(f"_p{i}"))
        lvl = F.when(ok, i) if lvl is None else lvl.when(ok, i)
    return out.withColumn("percentile", pct).withColumn("level", lvl).drop(*[f"{c}{i}" for c in ("_n", "_p") for i in range(len(ladders))])


def exact_quantiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """``keys`` and one column per entry of ``qs``: quantiles with linear interpolation between neighbouring ranks.

    Rows become one count per keys and value before they are ranked, so a key of a third of all rows is as many rows as it has distinct values. NULLs aren't counted.
    """
    c = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys)
    c = c.withColumn("_cum", F.sum("_c").over(w.orderBy(value))).withColumn("_n", F.sum("_c").over(w))
    out = []
    for name, q in qs.items():
        at = F.lit(q) * (F.col("_n") - 1)
        low = F.min(F.when(F.col("_cum") > F.floor(at), F.col(value)))
        high = F.min(F.when(F.col("_cum") > F.ceil(at), F.col(value)))
        part = F.max(at - F.floor(at))
        out.append((low + (high - low) * part).alias(name))
    return c.groupBy(*keys).agg(*out)


def decay(age_days: Column, half_life: float = 14.0, floor: float = 0.55) -> Column:
    """floor + (1 - floor) e^(-age ln 2 / half life); unknown age counts as one half life, future as 0."""
    a = F.greatest(F.coalesce(age_days, F.lit(half_life)), F.lit(0.0))
    return F.lit(floor) + (1 - floor) * F.exp(-a * F.log(F.lit(2.0)) / half_life)


# --- vectors and text --------------------------------------------------------------------------------------------------------
def nearest_exemplar(vectors: DataFrame, id_col: str, emb: str, exemplars: pd.DataFrame, least: float = 0.72, bound: int = 100_000) -> DataFrame:
    """``id, label, similarity``: the exemplar of the highest cosine, NULL label below ``least``; ties to the first exemplar.

    ``exemplars``: a bounded table (``label, embedding``) that goes to the tasks as one matrix; one product per Arrow batch.
    """
    import numpy as np

    if len(exemplars) > bound:
        raise ValueError("too many exemplars for one matrix")
    m = np.array(exemplars["embedding"].tolist(), dtype="float64")
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    labels = exemplars["label"].tolist()
    dtype = dict(vectors.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.array(pdf["_e"].tolist(), dtype="float64")
            s = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)) @ m.T
            i = s.argmax(axis=1)
            top = s[np.arange(len(i)), i]
            yield pd.DataFrame({"_i": pdf["_i"], "label": [labels[j] if t >= least else None for j, t in zip(i, top, strict=True)], "similarity": top})

    kind = "string" if exemplars["label"].dtype == object else "int"
    x = vectors.where(F.col(emb).isNotNull()).select(F.col(id_col).alias("_i"), F.col(emb).alias("_e"))
    return x.mapInPandas(run, f"_i {dtype}, label {kind}, similarity double").withColumnRenamed("_i", id_col)


def cosine_topk(queries: DataFrame, vectors: DataFrame, id_col: str, emb: str, k: int, block: int = 4096) -> DataFrame:
    """``query_id, id, similarity, rank``: the k nearest other vectors of each query, exactly.

    The stated queries go over all vectors in blocks of ``block`` as one matrix; every task keeps its k best per query, so at most
    k rows per query and task are shuffled.
    """
    import numpy as np

    out = None
    it = queries.select(id_col, emb).where(F.col(emb).isNotNull()).toLocalIterator()
    part: list = []

    def scan(rows: list) -> DataFrame:
        ids = np.array([r[0] for r in rows])
        q = np.array([r[1] for r in rows], dtype="float64")
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best_s, best_i = np.full((len(ids), 0), -2.0), np.full((len(ids), 0), 0)
            for pdf in batches:
                if not len(pdf):
                    continue
                v = np.array(pdf["e"].tolist(), dtype="float64")
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                s = q @ v.T
                own = pdf["i"].to_numpy()
                s[ids[:, None] == own[None, :]] = -2
                best_s = np.concatenate([best_s, s], axis=1)
                best_i = np.concatenate([best_i, np.broadcast_to(own, s.shape)], axis=1)
                order = np.lexsort((best_i, -best_s), axis=1)[:, :k]
                best_s, best_i = np.take_along_axis(best_s, order, 1), np.take_along_axis(best_i, order, 1)
            n = best_s.shape[1]
            r = pd.DataFrame({"query_id": np.repeat(ids, n), "id": best_i.ravel(), "similarity": best_s.ravel()})
            yield r[r["similarity"] > -2]

        x = vectors.select(F.col(id_col).alias("i"), F.col(emb).alias("e")).where("e IS NOT NULL")
        return x.mapInPandas(run, "query_id bigint, id bigint, similarity double")

    for r in it:
        part.append(r)
        if len(part) == block:
            out, part = (scan(part) if out is None else out.union(scan(part))), []
    if part or out is None:
        s = scan(part) if part else queries.sparkSession.createDataFrame([], "query_id bigint, id bigint, similarity double")
        out = s if out is None else out.union(s)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def parse_query(q: str) -> tuple[list[list[str]], list[str]]:
    """Web search syntax: groups of alternatives (``or``) that must all be met, and terms that must not (``-``). Quotes keep phrases."""
    import re

    must: list[list[str]] = []
    never: list[str] = []
    join = False
    for m in re.finditer(r'(-?)"([^"]+)"|(\S+)', q.lower()):
        neg, t = (m.group(1), m.group(2)) if m.group(2) is not None else (("-", m.group(3)[1:]) if m.group(3).startswith("-") and len(m.group(3)) > 1 else ("", m.group(3)))
        t = " ".join(re.findall(r"[a-z0-9]+", t))
        if not t:
            continue
        if t == "or" and not neg and m.group(2) is None:
            join = bool(must)
        elif neg:
            never.append(t)
        elif join:
            must[-1].append(t)
            join = False
        else:
            must.append([t])
    return must, never


def keyword_search(df: DataFrame, q: str, fields: dict[str, float]) -> DataFrame:
    """``df`` rows that match ``q`` in any field, with ``score``: occurrences of the wanted terms, weighted by field.

    Terms match whole words in lower case, without stemming (a stated approximation of full-text ranking).
    """
    must, never = parse_query(q)
    padded = {f: F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(F.col(f), F.lit(""))), r"[^a-z0-9]+", " "), F.lit(" ")) for f in fields}
    has = lambda t: _any_of([p.contains(f" {t} ") for p in padded.values()])
    cond = F.lit(bool(must))
    for alternatives in must:
        cond = cond & _any_of([has(t) for t in alternatives])
    for t in never:
        cond = cond & ~has(t)
    terms = [t for g in must for t in g]
    score = sum((F.regexp_count(padded[f], F.lit(f"(?<= ){t}(?= )")) * w for f, w in fields.items() for t in terms), F.lit(0.0))
    return df.where(cond).withColumn("score", score)


def _any_of(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def reciprocal_rank_fusion(rankings: list[DataFrame], id_col: str, k: int = 60) -> DataFrame:
    """``id, rrf`` from rankings with ``id, rank``: sum of 1 / (k + rank)."""
    x = rankings[0].select(id_col, "rank")
    for r in rankings[1:]:
        x = x.union(r.select(id_col, "rank"))
    return x.groupBy(id_col).agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"))


def semantic_bands(pairs: DataFrame, a: str, b: str, merge: float = 0.94, distinct: float = 0.88) -> DataFrame:
    """``pairs`` with ``similarity`` and ``band``: merge, review or distinct."""
    return bands(pairs.withColumn("similarity", cosine(F.col(a), F.col(b))), merge, distinct)


def bands(x: DataFrame, merge: float = 0.94, distinct: float = 0.88) -> DataFrame:
    """``x`` with the ``band`` of its ``similarity``."""
    return x.withColumn("band", F.when(F.col("similarity") >= merge, "merge").when(F.col("similarity") < distinct, "distinct").otherwise("review"))


def against_last_passing(runs: DataFrame, order: str, score: str, gate: float, fall: float = 0.03, keys: list[str] | None = None, bound: int = 1_000_000) -> DataFrame:
    """``runs`` with ``passed``, the score of the last passing run of the same ``keys`` (a suite) before, and ``regressed``: more than ``fall`` below it.

    Without ``keys`` the runs are one series, which one task sorts: more than ``bound`` of them are refused.
    """
    if not keys and runs.limit(bound + 1).count() > bound:
        raise ValueError(f"more than {bound} runs in one series: give keys")
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    x = runs.withColumn("passed", F.col(score) >= gate)
    x = x.withColumn("last_passing", F.last(F.when(F.col("passed"), F.col(score)), ignorenulls=True).over(w))
    return x.withColumn("regressed", F.coalesce(F.col("last_passing") - F.col(score) > fall, F.lit(False)))


def retry_after(value: Column, now: Column) -> Column:
    """Moment until which to wait: whole seconds from ``now``, or an HTTP date; NULL for other texts."""
    s = F.trim(value)
    secs = F.when(s.rlike(r"^\d{1,9}$"), s.try_cast("int"))
    date = F.try_to_timestamp(F.regexp_extract(s, r"^[A-Z][a-z]{2}, (\d{2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.coalesce(now + F.make_dt_interval(secs=secs.cast("decimal(18,6)")), date)


def status_action(code: Column) -> Column:
    """What an HTTP status asks for."""
    return F.when(code.isin(401, 403), "quarantine").when(code == 404, "not_found").when(code == 429, "rate_limited").otherwise("normal")
