from __future__ import annotations

import random

from pyspark.sql import functions as F

from postloom.operators.multivalue import atoms, explode_values, learn_and_split

CITIES = ["Lesolundra", "Burwadi", "Nedunburg", "Old Silwadi", "Kelagmouth", "Zavvale", "Drelumton", "Garombury"]
REGIONS = {c: r for c, r in zip(CITIES, ["Sodimo", "Stomoma Desh", "Ruravan", "Milinan", "Krabeno", "Perino", "Ruravan", "Monimoshire"], strict=True)}


def column() -> list[str]:
    r = random.Random(5)
    out = []
    for c in CITIES:
        out += [c, c.lower(), f"{c}, {REGIONS[c]}", f"{c},{REGIONS[c]}", f"{c}, {REGIONS[c]}, IN", f"{c}, IN", f"{c} - Hybrid", f"{c}, 560{r.randint(100, 999)}"]
    for i in range(60):
        a, b, c = r.sample(CITIES, 3)
        out += [f"{a}, {b}, {c}", f"{a} and {b}", f"{a},{REGIONS[a]}; {b}", f"{a} / {c}, {REGIONS[c]}", f"{i % 9 + 1}) {a} 2) {b}, {REGIONS[b]}"]
    return out + ["Remote", "Hybrid", "Stunthorpe and Farancombe", "Stunthorpe and Farancombe, Monimoshire"] * 2


def split(spark, *texts: str, names=("Stunthorpe and Farancombe",)) -> list[list[str]]:
    df = spark.createDataFrame([(t,) for t in [*column(), *texts]], "text string")
    listed = spark.createDataFrame([(n,) for n in [*names, None, "", "A and", "Zavvale"]], "name string")
    got = {r["text"]: r["pieces"] for r in learn_and_split(df, listed).collect()}
    return [got[t] for t in texts]


def test_values(spark):
    cases = {
        "Lesolundra, Sodimo": ["Lesolundra, Sodimo"],
        "Lesolundra,Burwadi,Zavvale": ["Lesolundra", "Burwadi", "Zavvale"],
        "Garombury, 560034": ["Garombury, 560034"],
        "Lesolundra, Burwadi, and Zavvale": ["Lesolundra", "Burwadi", "Zavvale"],
        "Lesolundra or Burwadi": ["Lesolundra", "Burwadi"],
        '"Zavvale, Perino", Remote': ["Zavvale, Perino", "Remote"],
        '["Zavvale", "Burwadi, Stomoma Desh"]': ["Zavvale", "Burwadi, Stomoma Desh"],
        "{Zavvale,\"Burwadi, IN\"}": ["Zavvale", "Burwadi, IN"],
        "1) Zavvale, Perino 2) Burwadi 3) Hybrid": ["Zavvale, Perino", "Burwadi", "Hybrid"],
        "Zavvale<br>Burwadi\r\nNedunburg": ["Zavvale", "Burwadi", "Nedunburg"],
        "Zavvale; ;  Burwadi": ["Zavvale", "Burwadi"],
        "Stunthorpe and Farancombe": ["Stunthorpe and Farancombe"],
        "Stunthorpe and Farancomb (HQ)\nZavvale": ["Stunthorpe and Farancomb (HQ)", "Zavvale"],
        "Burwadi // Zavvale - Hybrid": ["Burwadi", "Zavvale - Hybrid"],
        "Burwadi, IN / Zavvale / Burwadi, Stomoma Desh": ["Burwadi, IN", "Zavvale", "Burwadi, Stomoma Desh"],
        "Burwadii,Nedunburgg": ["Burwadii", "Nedunburgg"],
        "N/A": ["N/A"],
        ";;": [],
    }
    assert dict(zip(cases, split(spark, *cases), strict=True)) == cases


def test_positions_and_blanks(spark):
    df = spark.createDataFrame([(t,) for t in column()], "text string")
    rows = spark.createDataFrame([(1, ["Burwadi", " ", None, "Zavvale / Nedunburg"]), (2, ["Burwadi"]), (3, []), (4, None), (5, ["Burwadi", "Burwadi"])], "k int, a array<string>").withColumn("pieces", F.lit("clash"))
    pieces = learn_and_split(df.union(rows.select(F.explode("a"))))
    got = sorted(tuple(r) for r in explode_values(rows, ["k"], "a", pieces, array=True).collect())
    assert got == [(1, 0, "Burwadi"), (1, 1, "Zavvale"), (1, 2, "Nedunburg"), (5, 0, "Burwadi"), (5, 1, "Burwadi")]
    flat = spark.createDataFrame([(1, "Burwadi; Zavvale"), (2, ""), (3, None), (4, "Burwadi")], "k int, t string")
    pieces = learn_and_split(df.union(flat.select("t")))
    assert sorted(tuple(r) for r in explode_values(flat, ["k"], "t", pieces).collect()) == [(1, 0, "Burwadi"), (1, 1, "Zavvale")]


def test_empty_and_long(spark):
    e = spark.createDataFrame([], "text string")
    assert learn_and_split(e).count() == 0
    long = "; ".join(["Burwadi"] * 5000)
    assert len(split(spark, long)[0]) == 5000
    assert atoms("\"unclosed, quote") == [[("", '"unclosed', 0, 9), (",", "quote", 11, 16)]]


def test_values_of_many_parts_and_names(spark):
    """More parts than any bound, and more names than would fit a list to look through."""
    parts = "Unit Seven, Old Silwadi, Milinan, 560034, IN"
    texts = [parts.replace("Seven", w) for w in ("One", "Two", "Three", "Four", "Five", "Six", "Seven")]
    many = [f"Nam{i:04d}ton and Far{i:04d}combe" for i in range(3000)] + ["Stunthorpe and Farancombe"]
    got = split(spark, *texts, "Nam0077ton & Far0077comb / Zavvale", "Nam1111ton and Far2222combe", names=many)
    assert got[-2] == ["Nam0077ton & Far0077comb", "Zavvale"] and got[-1] == ["Nam1111ton", "Far2222combe"]
    for t, g in zip(texts, got[:7], strict=True):
        assert ", ".join(g) == t and len(g) <= 2 and g[-1].startswith(("Old Silwadi", "Unit")), g
