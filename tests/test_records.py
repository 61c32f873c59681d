"""Operators of the composed record, of structural matches, scores and queues on small fixtures."""

from __future__ import annotations

import datetime as dt
import gzip
import random

import pytest
from pyspark.sql import functions as F

from postloom.functions.payladder import parse_pay
from postloom.operators import dedup as D
from postloom.operators import queueing as U
from postloom.operators import relational as R
from postloom.operators import scoring as S
from postloom.operators.places import best_places
from postloom.operators.rules import resolve_aliases
from postloom.sources.bodies import decode_bodies, decoded

PAY = [  # text, min, max, currency, period, confidence, month, paid
    ("₹1,00,000/month", 100000, None, "INR", "month", 0.90, 100000, "paid"),
    ("8 LPA", 800000, None, "INR", "year", 0.60, 800000 / 12, "paid"),
    ("₹50K/month", 50000, None, "INR", "month", 0.90, 50000, "paid"),
    ("₹80,000 - ₹1,00,000 per month", 80000, 100000, "INR", "month", 0.95, 80000, "paid"),
    ("2-4 years of experience", 2, 4, "", "", 0.95, None, "paid"),
    ("competitive stipend", None, None, "", "", 0.50, None, "paid"),
    ("an unpaid internship", None, None, "", "", 0.0, None, "unpaid"),
    ("nothing here", None, None, "", "", 0.0, None, "unknown"),
    ("well, it depends: ₹50,000/month", None, None, "", "", 0.0, None, "unknown"),
    ("$20/hour", 20, None, "USD", "hour", 0.90, None, "paid"),
    ("500", 500, None, "INR", "month", 0.75, 500, "paid"),
    ("₹200 an hour", 200, None, "INR", "hour", 0.90, 32000, "paid"),
    ("", None, None, "", "", 0.0, None, "unknown"), (None, None, None, "", "", 0.0, None, "unknown"), ("9" * 400, None, None, "", "", 0.0, None, "unknown"),
]


def test_pay_ladder(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(PAY)], "i int, t string")
    got = df.select("i", parse_pay(F.col("t")).alias("p")).orderBy("i").select("p.*").collect()
    for (t, *want), g in zip(PAY, got, strict=True):
        for w, x in zip(want, g, strict=True):
            assert (x == pytest.approx(w)) if isinstance(w, (int, float)) else x == w, (t, g)


def test_strict_pay_needs_more_than_two_numbers(spark):
    df = spark.createDataFrame([("2-4 years of work",), ("40k - 60k",), ("well, it pays ₹50,000/month",)], "t string")
    got = [r[0] for r in df.select(parse_pay(F.col("t"), strict=True).alias("p")).collect()]
    assert got[0]["comp_max"] is None and got[1]["comp_max"] == 60000 and got[2]["comp_min"] == 50000


def test_aliases_of_any_length(spark):
    g = spark.createDataFrame([("new san dal", 1), ("dal", 2), ("a b c d e f g", 3), ("", 9), ("Dal", 5), (None, 7)], "alias string, entry_id int")
    df = spark.createDataFrame([("x New San Dal, y", 1), ("dal", 2), ("z a b c d e f g h", 3), ("dalx", 4), ("", 5), (None, 6), ("?!", 7)], "t string, alias int")
    got = {r["alias"]: r["entry_id"] for r in resolve_aliases(df, "t", g).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: None, 5: None, 6: None, 7: None}
    assert resolve_aliases(df.limit(0), "t", g).count() == 0 and resolve_aliases(df, "t", g.limit(0)).count() == 7


def test_best_places(spark):
    g = spark.createDataFrame([("Hom", 1), ("Near", 2), ("Far", 3), ("Odd", 4)], "alias string, entry_id int")
    places = spark.createDataFrame([(1, "IN"), (2, "IN"), (3, "US"), (4, None)], "entry_id int, country string")
    rows = [(1, "Far / Near or Hom", False), (2, "Far; Near", False), (3, "Far and Remote", False), (4, "Remote", False), (5, "Nowhere", True), (6, "", None), (7, None, None), (8, "Far, Near", False), (9, "Odd / Far", False), (10, "Odd", False)]
    got = {r["k"]: (r["mode"], r["entry_id"], r["tier"]) for r in best_places(spark.createDataFrame(rows, "k int, raw string, hint boolean"), "k", "raw", "hint", g, places, 1, "IN").collect()}
    assert got == {
        1: ("onsite", 1, 1), 2: ("onsite", 2, 2), 3: ("remote", 3, 3), 4: ("remote", None, 3), 5: ("remote", None, 3), 6: ("unknown", None, 0), 7: ("unknown", None, 0),
        8: ("onsite", 2, 2), 9: ("onsite", 3, 4), 10: ("onsite", 4, 0),
    }


def sequential(edges, members, most):
    group = {i: i for i in members}
    size, seen = {i: 1 for i in members}, dict(members)
    for p, a, b in sorted((p, min(a, b), max(a, b)) for a, b, p in edges):
        x, y = group[a], group[b]
        if x == y or size[x] + size[y] > most:
            continue
        keep, gone = sorted((x, y), key=lambda g: (seen[g], g))
        for i, g in group.items():
            if g == gone:
                group[i] = keep
        size[keep] += size[gone]
        seen[keep] = min(seen[keep], seen[gone])
    return group


@pytest.mark.parametrize("seed,most", [(1, 25), (2, 4), (3, 2)])
def test_capped_merges_equal_one_pass_in_order(spark, seed, most):
    r = random.Random(seed)
    members = {i: r.randrange(20) for i in range(40)}
    edges = [(r.randrange(40), r.randrange(40), r.randrange(1000)) for _ in range(60)] + [(0, i, r.randrange(1000)) for i in range(1, 14)]
    edges = [e for e in edges if e[0] != e[1]]
    best = {}
    for a, b, p in edges:
        k = (min(a, b), max(a, b))
        best[k] = min(best.get(k, 10**9), p)
    want = sequential([(a, b, p) for (a, b), p in best.items()], members, most)
    groups, events = D.merge_groups(spark.createDataFrame(edges, "a int, b int, priority int"), spark.createDataFrame(list(members.items()), "id int, first_seen int"), most)
    assert {x["id"]: x["group"] for x in groups.collect()} == want
    assert events.count() == 40 - len(set(want.values()))


def test_merges_of_nothing(spark):
    m = spark.createDataFrame([(1, 5), (2, 6)], "id int, first_seen int")
    e = spark.createDataFrame([(1, None, 1), (1, 1, 1), (1, 9, 2)], "a int, b int, priority int")
    groups, events = D.merge_groups(e, m)
    assert {(r["id"], r["group"]) for r in groups.collect()} == {(1, 1), (2, 2)} and events.count() == 0


def test_structural_matches(spark):
    now = dt.datetime(2025, 1, 31)
    row = lambda i, title, days, city, tier, mode, h, b="x": (i, b, title, now - dt.timedelta(days=days) if days is not None else None, city, tier, mode, h)
    rows = [
        row(1, "platform engineer", 10, "A", 2, "onsite", 0b1111), row(2, "platform engineer ii", 5, "A", 2, "onsite", 0b1110), row(3, "platform engineer", 60, "A", 2, "onsite", 0b1111),
        row(4, "chef", 1, "A", 2, "onsite", 0b1111), row(5, "platform engineer", 2, "B", 2, "onsite", 0b1111), row(6, "platform engineer", 3, None, 0, "unknown", 0xFF00), row(7, "platform engineer", None, "A", 2, "onsite", 0b1111),
        row(8, "platform engineer", 1, "A", 2, "onsite", 0), row(9, "platform engineer", 1, "A", 2, "onsite", 0b1111, None),
    ]
    df = spark.createDataFrame(rows, "k int, b string, title string, seen timestamp, city string, tier int, mode string, simhash bigint")
    got = {r["k"]: (r["match"], r["distance"], r["action"]) for r in D.structural_matches(df, "k", ["b"], "title", "seen", F.lit(now)).collect()}
    assert got[1] == (2, 1, "merge") and got[2] == (1, 1, "merge") and got[3] == (1, 0, "merge") and got[7] == (1, 0, "merge")
    assert got[5] == (6, 12, "escalate") and got[6] == (2, 11, "escalate")
    assert 4 not in got and 8 not in got and 9 not in got
    both = D.structural_matches(df, "k", ["b"], "title", "seen", F.lit(now), zero_matches=True).where("k = 8").first()
    assert both["distance"] >= 3


def test_recent_representatives(spark):
    df = spark.createDataFrame([("g", 1, 50, 1), ("g", 2, 48, 9), ("h", 3, 50, 1), ("h", 4, 40, 2), ("n", 5, 1, None)], "g string, k int, s int, at int").withColumn("at", F.timestamp_seconds("at"))
    got = {r["g"]: (r["k"], r["score"], r["members"]) for r in D.recent_representatives(df, "g", F.col("s"), "k", "at").collect()}
    assert got == {"g": (2, 53, 2), "h": (3, 50, 2), "n": (5, 6, 1)}


def test_scores(spark):
    df = spark.createDataFrame([(["a", "b", "c"], 60, None), ([], 10, 90), (None, None, None)], "job array<string>, x int, y int")
    levels = F.create_map(F.lit("a"), F.lit(5), F.lit("b"), F.lit(2))
    score, missing = S.coverage_score(F.col("job"), levels)
    got = df.select(score.alias("s"), missing.alias("m"), S.weighted_by(S.parse_weights(F.lit('{"x": 0.5, "y": 0.5, "z": 1}')), {"x": F.col("x"), "y": F.col("y")}).alias("w")).collect()
    assert [(r["s"], r["m"], r["w"]) for r in got] == [(47, ["c"], 60.0), (50, [], 50.0), (50, None, 0.0)]
    one = spark.range(1)
    words = " ".join(f"w{i}" for i in range(46))
    r = one.select(S.first_words(F.lit(words), 45).alias("a"), S.first_words(F.lit("x  y"), 45).alias("b"), *[S.ordinal(F.lit(n)).alias(f"o{n}") for n in (1, 2, 3, 4, 11, 12, 13, 21, 112)]).first()
    assert r["a"].endswith("w44…") and r["b"] == "x  y" and list(r)[2:] == ["1st", "2nd", "3rd", "4th", "11th", "12th", "13th", "21st", "112th"]
    m = one.select(S.merged_levels(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.array(F.lit("b"), F.lit("c"), F.lit("c"))).alias("m")).first()["m"]
    assert m["levels"] == {"b": 2, "c": 3} and m["added"] == ["c"] and m["removed"] == ["a"]
    e = S.hashed_embedding(spark.createDataFrame([(1, "alpha beta gamma"), (2, None), (3, "")], "k int, t string"), "k", "t", 64).orderBy("k").collect()
    assert sum(x * x for x in e[0]["embedding"]) == pytest.approx(1) and sum(map(abs, e[1]["embedding"])) == 0


def test_slots_and_budgets(spark):
    ev = spark.createDataFrame([("k", i, d) for i, d in enumerate([1, -1, -1, 1, 1, -1])], "k string, o int, d int")
    assert [r["in_use"] for r in U.slots_in_use(ev, "k", ["o"], F.col("d")).orderBy("o").collect()] == [1, 0, 0, 1, 2, 1]
    rows = [("k", i, dt.datetime(2025, 1, 1) + dt.timedelta(minutes=m), kind) for i, (m, kind) in enumerate([(0, "a"), (1, "a"), (2, "a"), (61, "a"), (62, "b"), (1441, "a")])] + [(None, 99, dt.datetime(2025, 1, 1), "a")]
    x = U.within_budgets(spark.createDataFrame(rows, "k string, o int, ts timestamp, kind string"), "k", "ts", "o", "kind", per_hour=2, per_day=4, per_kind_day=3)
    assert [r["sent"] for r in x.orderBy("o").collect()] == [True, True, False, True, True, True]


def test_histogram_and_quantiles(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(1, 101)] + [("a", None), ("b", 500.0)], "k string, v double")
    got = {r["k"]: (r["n"], r["quantile"]) for r in U.histogram_quantile(df, ["k"], "v", [10.0, 50.0, 100.0], 0.5).collect()}
    assert got == {"a": (100, 50.0), "b": (1, 100.0)}
    q = {r["k"]: (r["m"], r["t"]) for r in R.exact_quantiles(df, ["k"], "v", {"m": 0.5, "t": 0.95}).collect()}
    assert q["a"] == pytest.approx((50.5, 95.05)) and q["b"] == (500.0, 500.0)


def test_bodies(spark):
    big = b"x" * 1000
    two = gzip.compress(b"ab") + gzip.compress(b"cd")
    assert decoded(gzip.compress(big), "gzip", 10) == (b"x" * 10, True, None) and decoded(gzip.compress(b"x" * 10), "gzip", 10) == (b"x" * 10, False, None)
    assert decoded(two, "gzip", 10)[0] == b"abcd" and decoded(None, "gzip") == (None, False, None) and decoded(b"", None) == (b"", False, None)
    assert decoded(b"nonsense", "gzip")[0] is None and decoded(gzip.compress(big)[:-9], "gzip")[2]
    df = spark.createDataFrame([(1, gzip.compress(big), "gzip"), (2, big, "identity"), (3, None, "gzip"), (4, b"?", "gzip")], "id int, body binary, enc string")
    got = {r["id"]: (r["body"] and len(r["body"]), r["truncated"], r["decode_error"] is None) for r in decode_bodies(df, "body", "enc", 100).collect()}
    assert got == {1: (100, True, True), 2: (100, True, True), 3: (None, False, True), 4: (None, False, False)}


def test_found_or_created(spark):
    want = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "slug string")
    have = spark.createDataFrame([("a", 7), ("a", 3), (None, 1)], "slug string, id int")
    got = {r["slug"]: (r["id"], r["made"]) for r in R.find_or_create(want, have, "slug", "id").collect()}
    assert got["a"] == ("3", False) and got["b"][1] and set(got) == {"a", "b"}
