"""Duplicates in stages: exact keys, boilerplate, SimHash and titles, groups and their representative."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.functions.similarity import hamming, jaro_winkler
from postloom.functions.text import squeeze
from postloom.operators.graph import connected_components
from postloom.operators.lineage import release, written

_TOKENS = re.compile(r"[a-z0-9]+")
# Paragraphs of legal text that every employer has.
GLOBAL_BOILERPLATE = [
    r"(?i)equal opportunity employer",
    r"(?i)without regard to race,? color,? religion",
    r"(?i)reasonable accommodation",
    r"(?i)privacy (notice|policy)",
    r"(?i)pay transparency",
    r"(?i)good faith (salary|compensation) range",
    r"(?i)unsolicited resumes? (from|submitted by) (recruiting|staffing)( or (recruiting|staffing))? agenc",
    r"(?i)we do not accept (unsolicited )?agency",
]


def exact_edges(df: DataFrame, id_col: str, keys: list[str]) -> DataFrame:
    """``id, match, stage``: each record with the first record of the first key (in order) that it shares with another.

    Blank and NULL keys match nothing. One pass per key: a minimum per key (reduced before the shuffle), no pairs within a key.
    """
    rows = []
    for stage, k in enumerate(keys, 1):
        x = df.where(F.col(k).isNotNull() & (F.col(k).cast("string") != "")).select(F.col(id_col).alias("id"), F.col(k).alias("k"))
        first = x.groupBy("k").agg(F.min("id").alias("match"))
        rows.append(x.join(first, "k").where("id > match").select("id", "match", F.lit(stage).alias("stage")))
    every = reduce(DataFrame.union, rows)
    return every.groupBy("id").agg(F.min(F.struct("stage", "match")).alias("m")).select("id", "m.match", "m.stage")


def groups_of(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, group``: the components of ``id - match`` edges; lone records are their own group."""
    comp = connected_components(edges, "id", "match")
    return ids.join(comp, ids["id"] == comp["node"], "left").select("id", F.coalesce("component", "id").alias("group"))


def paragraphs(text: Column, least: int = 40) -> Column:
    """Paragraphs of at least ``least`` bytes, trimmed."""
    return F.filter(F.transform(F.split(text, r"\n[ \t\r\f]*\n"), lambda p: F.regexp_replace(p, r"^[ \t\n\r\f]+|[ \t\n\r\f]+$", "")), lambda p: F.octet_length(p) >= least)


def learned_boilerplate(df: DataFrame, owner: str, doc: str, text: str, share: float = 0.6, least_docs: int = 5, recent: int | None = None, order: list[Column] | None = None) -> DataFrame:
    """``owner, h``: hashes of paragraphs in at least ``share`` of an owner's documents; owners of fewer than ``least_docs`` have none.

    ``recent`` with ``order`` takes the last documents of each owner only.
    """
    x = df.where(F.col(owner).isNotNull())
    if recent and order:
        x = x.withColumn("_r", F.row_number().over(Window.partitionBy(owner).orderBy(*order))).where(F.col("_r") <= recent)
    docs = x.groupBy(owner).agg(F.count_distinct(doc).alias("_n")).where(F.col("_n") >= least_docs)
    p = x.select(owner, doc, F.explode(paragraphs(F.col(text))).alias("p")).select(owner, doc, F.sha2(squeeze(F.col("p")), 256).alias("h")).distinct()
    return p.groupBy(owner, "h").agg(F.count(F.lit(1)).alias("_c")).join(docs, owner).where(F.col("_c") >= F.col("_n") * share).select(owner, "h")


def strip_boilerplate(df: DataFrame, owner: str, doc: str, text: str, learned: DataFrame) -> DataFrame:
    """``doc, stripped``: paragraphs that are neither learned nor legal boilerplate; short paragraphs go as well."""
    p = df.select(owner, doc, F.posexplode(paragraphs(F.col(text))).alias("i", "p"))
    p = p.where(~reduce(lambda a, b: a | b, [F.col("p").rlike(x) for x in GLOBAL_BOILERPLATE]))
    p = p.withColumn("h", F.sha2(squeeze(F.col("p")), 256)).join(learned, [owner, "h"], "left_anti")
    kept = p.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "p"))), lambda s: s["p"]), "\n\n").alias("stripped"))
    return df.select(doc).join(kept, doc, "left").select(doc, F.coalesce("stripped", F.lit("")).alias("stripped"))


def simhash_of(text: str | None, k: int = 5) -> int:
    """Signed 64-bit SimHash: shingles of k tokens vote with their frequency, ones win with more than half of the votes."""
    w = _TOKENS.findall((text or "").lower())
    if not w:
        return 0
    sh = Counter(" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))
    h = np.frombuffer(b"".join(hashlib.sha256(s.encode()).digest()[:8] for s in sh), dtype=np.uint8).reshape(-1, 8)
    n = np.fromiter(sh.values(), dtype=np.int64, count=len(sh))
    ones = n @ np.unpackbits(h, axis=1)
    return int(np.packbits(ones * 2 > n.sum()).view(">i8")[0])


def simhash(df: DataFrame, doc: str, text: str, k: int = 5) -> DataFrame:
    """``doc, simhash``: 64-bit SimHash over k-token shingles weighted by frequency; fewer tokens are one shingle, none gives 0.

    One pass in Arrow batches without a shuffle: exploding shingles into 64 conditional sums moves and evaluates far more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([simhash_of(t, k) for t in b.column(1).to_pylist()], pa.int64())], [doc, "simhash"])

    return df.select(doc, text).mapInArrow(run, f"{doc} {dict(df.dtypes)[doc]}, simhash bigint")


def close_simhashes(df: DataFrame, doc: str, most: int = 3) -> DataFrame:
    """``a, b, distance`` with ``a < b``: representatives of distinct SimHashes within ``most`` bits, by pigeonhole blocks.

    The 64 bits are cut in ``most + 1`` blocks, one of which two close patterns share. Zero (no text) is no evidence and joins nothing.
    """
    reps = df.where("simhash <> 0").groupBy("simhash").agg(F.min(doc).alias("id"))
    n = most + 1
    edges = [round(64 * i / n) for i in range(n + 1)]
    block = F.array(*[F.struct(F.lit(i).alias("i"), F.shiftrightunsigned(F.shiftleft(F.col("simhash"), 64 - b), 64 - b + a).alias("v")) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))])
    x = reps.select("id", "simhash", F.explode(block).alias("k"))
    y = x.select(F.col("id").alias("b"), F.col("simhash").alias("sb"), "k")
    d = hamming(F.col("sa"), F.col("sb"))
    pairs = x.select(F.col("id").alias("a"), F.col("simhash").alias("sa"), "k").join(y, "k").where("a < b").withColumn("distance", d).where(F.col("distance") <= most)
    return pairs.select("a", "b", "distance").distinct()


def compatible_places(city_a: Column, tier_a: Column, mode_a: Column, city_b: Column, tier_b: Column, mode_b: Column) -> Column:
    """Same city; both remote; one remote and the same tier; or exactly one without a city."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    far_a, far_b = yes(mode_a == "remote"), yes(mode_b == "remote")
    return yes(city_a == city_b) | (far_a & far_b) | ((far_a | far_b) & yes(tier_a == tier_b)) | (city_a.isNull() != city_b.isNull())


def structural_matches(
    df: DataFrame, key: str, block: list[str], title: str, seen: str, now: Column, days: int = 45, most: int = 200, alike: float = 0.85, merge: int = 3, zero_matches: bool = False
) -> DataFrame:
    """``key, match, distance, action``: the closest earlier candidate of each record by SimHash, to merge with or to escalate.

    ``df`` has also ``city, tier, mode, simhash``. Candidates are the latest ``most`` records of the same ``block`` seen within ``days`` before ``now``; their
    titles are alike (Jaro-Winkler) and their places compatible; the smallest Hamming distance wins, then the smaller key. Up to ``merge`` bits merge, more escalate.
    A record without a moment, or with a NULL in the block, is no candidate. A SimHash of 0 (no text) is no evidence, unless ``zero_matches``.
    Candidates are cut to ``most`` per block while they are read (the limit is part of the operation), so a block of a third of all rows
    meets ``most`` rows, never itself; titles are compared once per pair of titles.
    """
    cols = {c: F.col(c) for c in ("city", "tier", "mode", "simhash")}
    x = df.select(F.col(key).alias("_id"), *[F.col(b).alias(f"_b{i}") for i, b in enumerate(block)], F.col(title).alias("_t"), F.col(seen).alias("_at"), *[c.alias(f"_{n}") for n, c in cols.items()])
    bs = [f"_b{i}" for i in range(len(block))]
    since = now - F.make_dt_interval(days=F.lit(days))
    c = x.where((F.col("_at") > since) & (F.col("_at") <= now))
    for b in bs:
        c = c.where(F.col(b).isNotNull())
    c = c.withColumn("_r", F.row_number().over(Window.partitionBy(*bs).orderBy(F.desc("_at"), "_id"))).where(F.col("_r") <= most).drop("_r")
    other = c.select(*bs, *[F.col(n).alias(f"o{n}") for n in ("_id", "_t", "_at", "_city", "_tier", "_mode", "_simhash")])
    pairs = x.join(other, bs).where("_id <> o_id")
    pairs = pairs.where(compatible_places(*[F.col(n) for n in ("_city", "_tier", "_mode", "o_city", "o_tier", "o_mode")]))
    if not zero_matches:
        pairs = pairs.where("_simhash <> 0 AND o_simhash <> 0")
    titles = pairs.select(F.col("_t").alias("ta"), F.col("o_t").alias("tb")).distinct().where(jaro_winkler("ta", "tb") >= alike)
    pairs = pairs.join(titles, (F.col("_t") == F.col("ta")) & (F.col("o_t") == F.col("tb")), "left_semi")
    best = pairs.groupBy(F.col("_id").alias(key)).agg(F.min(F.struct(hamming(F.col("_simhash"), F.col("o_simhash")).alias("d"), F.col("o_id").alias("o"))).alias("m"))
    return best.select(key, F.col("m.o").alias("match"), F.col("m.d").alias("distance"), F.when(F.col("m.d") <= merge, "merge").otherwise("escalate").alias("action"))


def merge_groups(edges: DataFrame, members: DataFrame, most: int = 25) -> tuple[DataFrame, DataFrame]:
    """(groups ``id, group``, events ``a, b, kept, absorbed, priority``): groups merged edge by edge in the order of ``priority``, none beyond ``most`` members.

    ``edges``: ``a, b, priority``; ``members``: ``id, first_seen``, one row per record, each its own group at first. The group with the earlier first_seen
    is kept, of equal ones the smaller id. The result is that of one pass over the edges in order (priority, a, b), where an edge whose groups are too large together
    is skipped for good. Here every round merges all edges that come first for both of their groups, which no other edge can overtake; rounds go on until no edge
    fits, and each is a few joins whose result is written. A hub merges once a round and at most ``most`` times; in all it takes as many rounds as
    the longest chain of edges that wait for each other, so priorities should not run along chains. Edges with NULLs or unknown ends are ignored.
    """
    seen = members.where("id IS NOT NULL").groupBy("id").agg(F.min("first_seen").alias("first_seen"))
    groups = written(seen.select("id", F.col("id").alias("group"), "first_seen", F.lit(1).cast("bigint").alias("size")))
    live = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b AND priority IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "priority")
    live = live.groupBy("a", "b").agg(F.min("priority").alias("priority"))
    live = written(live.withColumn("ga", F.col("a")).withColumn("gb", F.col("b")))
    events = None
    while True:
        g = groups.select("group", "first_seen", "size").distinct()  # first_seen and size are of the whole group
        e = live.join(g.select(F.col("group").alias("ga"), F.col("first_seen").alias("fa"), F.col("size").alias("na")), "ga")
        e = e.join(g.select(F.col("group").alias("gb"), F.col("first_seen").alias("fb"), F.col("size").alias("nb")), "gb")
        e = written(e.where((F.col("ga") != F.col("gb")) & (F.col("na") + F.col("nb") <= most)))
        if e.isEmpty():
            break
        o = F.struct("priority", "a", "b")
        first = e.select(F.explode(F.array("ga", "gb")).alias("g"), o.alias("o")).groupBy("g").agg(F.min("o").alias("o"))
        both = first.groupBy("o").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("o.*")
        a_first = F.struct("fa", "ga") <= F.struct("fb", "gb")
        pick = lambda x, y: F.when(a_first, F.col(x)).otherwise(F.col(y))
        done = e.join(both, ["priority", "a", "b"], "left_semi").select(
            "a", "b", "priority", pick("ga", "gb").alias("kept"), pick("gb", "ga").alias("absorbed"), pick("fa", "fb").alias("first_seen"), (F.col("na") + F.col("nb")).alias("size")
        )
        done = written(done)
        events = done if events is None else events.union(done)
        moved = done.select(F.explode(F.array("kept", "absorbed")).alias("group"), F.col("kept").alias("_to"), F.col("first_seen").alias("_f"), F.col("size").alias("_s"))
        x = groups.join(moved, "group", "left")
        new = written(x.select("id", F.coalesce("_to", "group").alias("group"), F.coalesce("_f", "first_seen").alias("first_seen"), F.coalesce("_s", "size").alias("size")))
        to = moved.select("group", "_to")
        y = e.select("a", "b", "priority", "ga", "gb").join(to.toDF("ga", "_ta"), "ga", "left").join(to.toDF("gb", "_tb"), "gb", "left")
        left = written(y.select("a", "b", "priority", F.coalesce("_ta", "ga").alias("ga"), F.coalesce("_tb", "gb").alias("gb")).where("ga <> gb"))
        release(groups, live, e)
        groups, live = new, left
    if events is None:
        events = live.select("a", "b", "priority", F.col("ga").alias("kept"), F.col("gb").alias("absorbed")).where("false")
    return groups.select("id", "group"), events.select("a", "b", "kept", "absorbed", "priority")


def representative_score(length: Column, *bonuses: tuple[Column, int], base: int = 40, long_from: int = 1000, long_bonus: int = 25) -> Column:
    """Base, a bonus for long texts, and the bonus of every condition that holds; NULL conditions don't."""
    score = F.lit(base) + F.when(length >= long_from, long_bonus).otherwise(0)
    for cond, bonus in bonuses:
        score = score + F.when(cond, bonus).otherwise(0)
    return score


def recent_representatives(df: DataFrame, group: str, score: Column, id_col: str, seen: str, bonus: int = 5) -> DataFrame:
    """``group, id, score, members``: the record with the highest score, the most recent one (ties: the smaller id) with a bonus; ties to the smaller id.

    The bonus can only lift the most recent record, so the best of the others and the most recent are two aggregates of one pass.
    """
    x = df.select(group, F.col(id_col).alias("_id"), score.alias("_s"), F.col(seen).alias("_at"))
    latest = F.max_by(F.struct("_id", "_s"), F.struct(F.coalesce(F.unix_micros(F.col("_at").cast("timestamp")), F.lit(-(2**62))), -F.col("_id"))).alias("l")
    best = F.max_by(F.struct("_id", "_s"), F.struct("_s", -F.col("_id"))).alias("b")
    y = x.groupBy(group).agg(latest, best, F.count(F.lit(1)).alias("members"))
    lifted = F.col("l._s") + bonus
    win = (lifted > F.col("b._s")) | ((lifted == F.col("b._s")) & (F.col("l._id") <= F.col("b._id"))) | (F.col("l._id") == F.col("b._id"))
    return y.select(group, F.when(win, F.col("l._id")).otherwise(F.col("b._id")).alias(id_col), F.when(win, lifted).otherwise(F.col("b._s")).alias("score"), "members")


def representatives(df: DataFrame, group: str, score: Column, id_col: str) -> DataFrame:
    """The record with the highest score of each group, ties to the smallest id, and the group's size."""
    best = F.max_by(F.struct(F.col(id_col), score.alias("score")), F.struct(score, -F.col(id_col))).alias("m")
    return df.groupBy(group).agg(best, F.count(F.lit(1)).alias("members")).select(group, F.col(f"m.{id_col}").alias(id_col), "m.score", "members")
