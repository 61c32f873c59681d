"""Graph, rules, text and relational operators on small cases, nulls, ties and empty tables among them."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from postloom.functions import text as X
from postloom.functions.similarity import cosine, hamming, jaro_winkler_of
from postloom.functions.url import canonical_url
from postloom.operators import dedup as D
from postloom.operators import relational as R
from postloom.operators.graph import connected_components
from postloom.operators.rules import Family, classify, extract_terms, load_families, resolve_aliases, seniority


def one(spark, col, *values, schema="a string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(col).collect()]


def test_components_path_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 5000), (None, 3), (7, None)]
    random.Random(3).shuffle(edges)
    x = connected_components(spark.createDataFrame(edges, "a bigint, b bigint"))
    got = {r["node"]: r["component"] for r in x.collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(50)}, 5000: 5000}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_random_against_union_find(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)]
    parent = list(range(300))

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {v: find(v) for e in edges for v in e}


URLS = {
    "HTTPS://Boards.Example/Acme/Jobs/1": "https://boards.example/Acme/Jobs/1",
    "https://h.example:443/a": "https://h.example/a",
    "http://h.example:80/a": "https://h.example:80/a",
    "https://h.example/a?utm_source=x&b=2&GCLID=9&a=1": "https://h.example/a?a=1&b=2",
    "https://h.example/a?role=&team=eng": "https://h.example/a?team=eng",
    "https://h.example/a?sid=1#apply": "https://h.example/a",
    "https://x.wd5.myworkdayjobs.com/a#/job/7": "https://x.wd5.myworkdayjobs.com/a#/job/7",
    "https://h.example/a/": "https://h.example/a",
    "https://h.example/": "https://h.example/",
    "not a url": "not a url",
}


def test_canonical_url(spark):
    got = one(spark, canonical_url(F.col("a")), *URLS, None)
    assert got == [*URLS.values(), None]
    assert one(spark, canonical_url(canonical_url(F.col("a"))), *URLS) == list(URLS.values())


def test_text(spark):
    assert one(spark, X.strip_html(F.col("a")), "<p>Hi &amp;&nbsp;you</p>\n<b>x</b>", "&lt;h2&gt;A&lt;/h2&gt; &#8377;80,000", None, "") == ["Hi & you x", "A ₹80,000", None, ""]
    t = one(spark, X.normalize_title(F.col("a")), "Software Engineering Intern, Summer 2027 (Bengaluru) - REQ12345", "SRE II")
    assert tuple(t[0]) == ("software engineering intern, (bengaluru) -", "summer", "2027") and t[1]["normalized"] == "site reliability engineer ii"
    assert one(spark, X.scrub(F.col("a")), "mail a.b@c.example or +91 98765 43210, key sk-abcdefghij12345") == ["mail [REDACTED] or [REDACTED], key [REDACTED]"]
    assert len(set(one(spark, X.without_volatile(F.col("a")), "x <!-- 1 --> updated 3 minutes ago", "x  updated 5 hours ago"))) == 1
    assert one(spark, X.slug(F.col("a")), " Acme & Co. ", None) == ["acme-co", None]


def test_rules(spark):
    fs = load_families('{"back": {"strong": ["backend"], "negative": ["designer"]}, "dev": {"strong": ["advocate"], "evidence": true}, "gen": {"weak": ["engineer"]}}')
    assert fs[0] == Family("back", ("backend",), (), ("designer",))
    df = spark.createDataFrame([("backend engineer", ""), ("backend designer engineer", ""), ("advocate engineer", "talk"), ("advocate", "code"), ("cook", ""), (None, "")], "t string, d string")
    got = [tuple(r[0]) for r in df.select(classify(F.col("t"), fs, "other", F.col("d").contains("code"))).collect()]
    assert got == [("back", 0.9), ("gen", 0.6), ("other", 0.0), ("dev", 0.9), ("other", 0.0), ("other", 0.0)]
    s = spark.createDataFrame(
        [("Engineer", "2+ years of experience", ""), ("Engineer", "", "Intern"), ("Senior Associate", "", ""), ("SDE II", "", ""), ("Manager", "", ""), ("Principal Manager", "", ""), ("Dev", "get things done", ""), ("GET", "", "")], "t string, r string, e string"
    )
    assert [r[0] for r in s.select(seniority(F.col("t"), F.col("r"), F.col("e"))).collect()] == ["entry", "internship", "senior", "mid", "senior", "staff", "unknown", "new_grad"]
    assert one(spark, extract_terms(F.col("a"), {"c++": ["c++"], "go": ["go", "golang"]}), "Go and C++.", "gopher", None) == [["c++", "go"], [], []]


def test_aliases(spark):
    g = spark.createDataFrame([("york", 1), ("new york", 2), ("paris", 3), ("paris", 4)], "alias string, entry_id int")
    df = spark.createDataFrame([("New York, US",), ("in York",), ("PARIS",), ("nowhere",), (None,), ("",)], "t string")
    assert {r["t"]: r["entry_id"] for r in resolve_aliases(df, "t", g).collect()} == {"New York, US": 2, "in York": 1, "PARIS": 3, "nowhere": None, None: None, "": None}


@pytest.mark.parametrize(("a", "b", "want"), [("MARTHA", "MARHTA", 0.9611), ("DIXON", "DICKSONX", 0.8133), ("", "", 1.0), ("a", "", 0.0), ("abc", "abc", 1.0)])
def test_jaro_winkler(a, b, want):
    assert jaro_winkler_of(a, b) == pytest.approx(want, abs=1e-4)
    assert jaro_winkler_of(a, b) == pytest.approx(jaro_winkler_of(b, a))


def test_simhash(spark):
    base = " ".join(f"word{i}" for i in range(80))
    df = spark.createDataFrame([(1, base), (2, base.upper()), (3, base + " tail"), (4, "quite another text of a few words " * 3), (5, ""), (6, None), (7, "two words")], "id bigint, t string")
    h = {r["id"]: r["simhash"] for r in D.simhash(df, "id", "t").collect()}
    assert h[1] == h[2] and h[5] == h[6] == 0 and h[7] != 0
    assert bin((h[1] ^ h[3]) & (2**64 - 1)).count("1") < 12 < bin((h[1] ^ h[4]) & (2**64 - 1)).count("1")
    x = spark.createDataFrame([(1, 5), (2, 5), (3, 7), (4, -5), (5, 0), (6, 4611686018427387909)], "id bigint, simhash bigint")
    assert sorted(tuple(r) for r in D.close_simhashes(x, "id").collect()) == [(1, 3, 1), (1, 6, 1), (3, 6, 2)]
    assert one(spark, hamming(F.col("a"), F.lit(0)), 7, -1, schema="a bigint") == [3, 64]


def test_boilerplate(spark):
    about = "About us: we are a company that builds many useful things for many people."
    legal = "We are an Equal Opportunity Employer and more of that kind of sentence here."
    rows = [(i, "a", f"{about}\n\nThis is the specific text number {i} of this very posting.\n \n{legal}\n\nshort") for i in range(5)] + [(9, "b", about), (10, None, about), (11, "a", None)]
    df = spark.createDataFrame(rows, "id int, o string, t string")
    learned = D.learned_boilerplate(df, "o", "id", "t")
    assert learned.count() == 2
    got = {r["id"]: r["stripped"] for r in D.strip_boilerplate(df, "o", "id", "t", learned).collect()}
    assert got[3] == "This is the specific text number 3 of this very posting." and got[9] == about and got[11] == ""


def test_exact_edges_and_groups(spark):
    df = spark.createDataFrame([(1, "u", None), (2, "u", "x"), (3, "", "x"), (4, "", None), (5, None, "")], "id int, k1 string, k2 string")
    e = D.exact_edges(df, "id", ["k1", "k2"])
    assert sorted(tuple(r) for r in e.collect()) == [(2, 1, 1), (3, 2, 2)]
    assert {r["id"]: r["group"] for r in D.groups_of(e, df.select("id")).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_pages_cover_all_once(spark):
    r = random.Random(2)
    df = spark.createDataFrame([(i, float(r.randrange(5))) for i in range(57)] + [(100, None)], "k int, p double").where("p IS NOT NULL")
    seen, after = [], None
    while rows := R.page(df, "p", "k", 10, after).collect():
        seen += [x["k"] for x in rows]
        after = R.decode_cursor(R.encode_cursor(rows[-1]["p"], rows[-1]["k"]))
    assert len(seen) == len(set(seen)) == 57
    assert "TakeOrderedAndProject" in R.page(df, "p", "k")._jdf.queryExecution().toString()


def test_writes(spark):
    cur = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, t int")
    assert sorted(tuple(r) for r in R.upsert(cur, new, ["k"], [F.desc("t")]).collect()) == [(1, "a"), (2, "d"), (3, "e")]
    assert [tuple(r) for r in R.insert_if_absent(cur, new, ["k"], [F.col("t")]).collect()] == [(3, "e", 1)]
    none = spark.createDataFrame([], cur.schema)
    assert R.upsert(none, new, ["k"], [F.desc("t")]).count() == 2
    ev = spark.createDataFrame([(1, 1, "a", None, False), (1, 2, "b", "n", True), (1, 3, "c", None, None)], "k int, t int, s string, n string, f boolean")
    r = R.sticky_state(ev.select("*", F.col("n").alias("m")), ["k"], ["t"], ["s"], ["n"], ["m"], ["f"]).first()
    assert (r["s"], r["n"], r["m"], r["f"]) == ("c", "n", "n", True)


def test_folds(spark):
    ev = spark.createDataFrame([(1, i, f) for i, f in enumerate([1, 1, 1, 0, 1, 1])], "k int, t int, f int")
    x = R.circuit_state(ev, "k", ["t"], F.col("f") == 1, threshold=2, base=10, most=15).orderBy("t").collect()
    assert [(r["failures"], r["open_s"]) for r in x] == [(1, 0), (2, 10), (3, 15), (0, 0), (1, 0), (2, 10)]
    y = 0.0
    for f in [1, 1, 1, 0, 1, 1]:
        y = 0.99 * y + 0.01 * f
    assert R.ema(ev, "k", ["t"], F.col("f")).first()["ema"] == pytest.approx(y)
    base = dt.datetime(2024, 1, 1)
    tb = spark.createDataFrame([(1, i, base + dt.timedelta(seconds=s)) for i, s in enumerate([0, 0, 0, 10, 10])], "k bigint, o bigint, ts timestamp")
    assert [r["allowed"] for r in R.token_bucket(tb, "k", "ts", "o", rate=0.1, burst=2.0).orderBy("o").collect()] == [True, True, False, True, False]


def test_scores(spark):
    df = spark.createDataFrame([(4.0, None), (None, None)], "a double, b double")
    assert [r[0] for r in df.select(R.weighted({"a": 1.0, "b": 3.0}, {"a": F.col("a"), "b": F.col("b"), "c": F.col("a")})).collect()] == [4.0, 0.0]
    for age, want in {0.0: 1.0, 7.0: 0.87, 14.0: 0.78, 30.0: 0.65, 60.0: 0.57}.items():
        assert spark.range(1).select(R.decay(F.lit(age))).first()[0] == pytest.approx(want, abs=0.01)
    p = spark.createDataFrame([("x", "a", float(i)) for i in range(4)] + [("x", "b", 9.0), ("x", None, 1.0), ("x", "a", None)], "g string, h string, v double")
    got = {(r["h"], r["v"]): r["percentile"] for r in R.percentile_ladder(p, "v", [["g", "h"], ["g"]], 4).collect()}
    assert got["a", 1.0] == 0.5 and got["b", 9.0] == 1.0 and got["a", None] is None


def test_vectors(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0])], "id bigint, e array<double>")
    got = [(r["query_id"], r["id"], r["rank"]) for r in R.cosine_topk(e.where("id = 1"), e, "id", "e", 2).orderBy("rank").collect()]
    assert got == [(1, 2, 1), (1, 3, 2)]
    assert R.cosine_topk(e.where("id > 9"), e, "id", "e", 2).count() == 0
    assert one(spark, cosine(F.col("a"), F.array(F.lit(1.0), F.lit(0.0))), [1.0, 0.0], [0.0, 0.0], None, schema="a array<double>") == [1.0, None, None]
    ex = e.where("id IN (1, 3)").selectExpr("cast(id as int) label", "e embedding").toPandas()
    near = {r["id"]: r["label"] for r in R.nearest_exemplar(e, "id", "e", ex, 0.72).collect()}
    assert near == {1: 1, 2: 1, 3: 3, 5: None}


def test_search(spark):
    assert R.parse_query('go "big data" or spark -java') == ([["go"], ["big data", "spark"]], ["java"])
    df = spark.createDataFrame([(1, "Go big data"), (2, "go spark java"), (3, "golang spark"), (4, None), (5, "spark, go! go")], "id int, t string")
    got = {r["id"]: r["score"] for r in R.keyword_search(df, 'go "big data" or spark -java', {"t": 1.0}).collect()}
    assert got == {1: 2.0, 5: 3.0}
    assert R.keyword_search(df, "", {"t": 1.0}).count() == 0


def test_optional_filters(spark):
    df = spark.range(5)
    assert R.optional_filters(df, {"id": None}, {"id": None}).count() == 5
    assert R.optional_filters(df, {"id": []}).count() == 0
    assert R.optional_filters(df, {"id": [1, 2]}, {"id": 2}).count() == 1


def test_domains_signals_and_waits(spark):
    from postloom.functions.url import registered_domain
    from postloom.operators.rules import tri_state

    assert one(spark, registered_domain(F.col("a")), "https://a.b.example/x", "http://x.co.uk", "https://shop.x.co.uk:8080/", "http://10.0.0.1/a", "https://localhost/", None) == ["b.example", "x.co.uk", "x.co.uk", "10.0.0.1", "localhost", None]
    assert one(spark, tri_state(F.col("a"), "yes", "no"), "yes", "no", "yes no", "", None) == [True, False, None, None, None]
    now = dt.datetime(2025, 1, 1)
    df = spark.createDataFrame([("120", now), ("Wed, 01 Jan 2025 01:00:00 GMT", now), ("soon", now), (None, now)], "v string, n timestamp")
    assert [r[0] for r in df.select(R.retry_after(F.col("v"), F.col("n"))).collect()] == [now + dt.timedelta(seconds=120), dt.datetime(2025, 1, 1, 1), None, None]
    runs = spark.createDataFrame([(1, 0.9), (2, 0.5), (3, 0.88), (4, 0.95)], "i int, s double")
    assert [(r["last_passing"], r["regressed"]) for r in R.against_last_passing(runs, "i", "s", 0.8).orderBy("i").collect()] == [(None, False), (0.9, True), (0.9, False), (0.88, False)]
