from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from postloom.llm.canonical_map import map_values, osa, repair_tokens
from postloom.llm.name_link import link_names, name_pairs, segments, short_form, similar_keys, split_former, words_of

REF = [
    (1, ["Lesolundra", "Korbool"], "Sodimo", "SID", "AU", "Australia"),
    (2, ["Shulodwick"], "Glolagia", "GGO", "AU", "Australia"),
    (3, ["Shulodwick", "SUK"], "Solimanshire", "SI", "GB", "United Kingdom"),
    (4, ["Stunthorpe and Farancombe"], "Monimoshire", "MI", "GB", "United Kingdom"),
    (5, ["Borosbury-on-Prore", "BRE"], "Solimanshire", "SI", "GB", "United Kingdom"),
    (6, ["Old Silwadi"], "Milinan Pradesh", "MI", "IN", "India"),
    (7, ["Nâlidmont"], "Krabeno", "KB", "CA", "Canada"),
    (8, ["Denabad"], "Jeresan Pradesh", "JE", "IN", "India"),
    (9, ["Old Kraninpur"], "Stomoma Desh", "SM", "IN", "India"),
]
CASES = {
    "Lesolundra": {1}, "LESOLUNDRA, Sodimo": {1}, "Lesoulndra (Remote)": {1}, "Lesolu. office": {1}, "korbool": {1}, "AU-Lesolundr": {1},
    "Shulodwick, GGO, AU": {2}, "Shulodwick, Solimanshire, United Kingdom": {3}, "Shulodwick, UK; Shulodwick, Australia": {2, 3}, "SUK": {3},
    "Stunthorpe and Farancombe, GB": {4}, "Stunthorpe and Farancomb / Lesolundra": {1, 4}, "near borosbury on prore": {5}, "GB-BRE": {5}, "old silwadi, 412050": {6}, "Old Silwdai": {6},
    "Nalidmont, KB": {7}, "Remote": {-1}, "Old Denabad, India": {-1}, "Hagalstadt": {-1}, "N/A": {-1}, "Remote - Denabad\nNâlidmont": {7, 8}, "x" * 50_000: {-1}, "Old Kranpur": {9},
}


def entries(spark, rows=REF):
    return spark.createDataFrame(rows, "entry_id bigint, names array<string>, region string, region_code string, country string, country_name string")


def test_values(spark):
    df = spark.createDataFrame([(t,) for t in [*CASES, *CASES, "", "  ", None]], "text string").withColumn("entry_id", F.lit("clash"))
    got: dict = {}
    for r in map_values(df, entries(spark)).collect():
        got.setdefault(r["text"], set()).add(r["entry_id"])
    assert got == CASES


def test_no_entries_and_no_values(spark):
    df = spark.createDataFrame([("Pune",)], "text string")
    assert [tuple(r) for r in map_values(df, entries(spark, [])).collect()] == [("Pune", -1)]
    assert map_values(df.where("false"), entries(spark)).count() == 0


def test_token_repair_against_brute_force(spark):
    r = random.Random(7)
    words = ["".join(r.choice("abcd") for _ in range(r.randint(3, 10))) for _ in range(60)]
    typed = [w if r.random() < 0.2 else "".join(c for c in w if r.random() > 0.12) + r.choice(["", "a"]) for w in words] + ["abc", ""]
    a = spark.createDataFrame([(t, False) for t in set(typed) if t], "token string, dot boolean")
    b = spark.createDataFrame([(w, False) for w in words], "word string, longer boolean")
    got = {(x["token"], x["word"]) for x in repair_tokens(a, b).collect()}
    most = lambda n: 0 if n < 5 else 1 if n < 8 else 2
    assert got == {(t, w) for t in set(typed) if t for w in set(words) if osa(t, w, most(len(w))) <= most(len(w))}


def test_long_tokens_and_shared_words(spark):
    """Words beyond the length whose deletions are emitted are repaired as well; a word of all names brings up none by itself."""
    r = random.Random(3)
    long = "".join(r.choice("abcdefgh") for _ in range(60))
    edited = [long, long[:10] + "x" + long[10:], long[:20] + long[21:], long[:11] + long[12] + long[11] + long[13:40] + long[41:], "y" + long[1:]]
    rows = [(1, [long], "R", "RR", "IN", "India"), *[(i, [f"Comn Wod{i:02d}elkar"], "R", "RR", "IN", "India") for i in range(2, 60)]]
    df = spark.createDataFrame([(t,) for t in [*edited, long[::-1], "Comn", "Comn Wod07elkar", "Comn Wod08elkr"]], "text string")
    got = {r["text"]: r["entry_id"] for r in map_values(df, entries(spark, rows)).collect()}
    assert [got[t] for t in edited] == [1] * 5
    assert (got[long[::-1]], got["Comn"], got["Comn Wod07elkar"], got["Comn Wod08elkr"]) == (-1, -1, 7, 8)
    r = random.Random(8)
    words = ["".join(r.choice("abcd") for _ in range(r.randint(36, 48))) for _ in range(25)]
    typed = {w[:i] + r.choice(["", "a", w[i : i + 2][::-1] + "b"]) + w[i + r.choice([0, 1, 2]) :] for w in words for i in (3, 17, 33)}
    a = spark.createDataFrame([(t, False) for t in typed], "token string, dot boolean")
    b = spark.createDataFrame([(w, False) for w in words], "word string, longer boolean")
    pairs = {(x["token"], x["word"]) for x in repair_tokens(a, b).collect()}
    assert pairs == {(t, w) for t in typed for w in words if osa(t, w, 2) <= 2} and len(pairs) > 40


@pytest.mark.parametrize(("a", "b", "d"), [("abcd", "abcd", 0), ("abcd", "abdc", 1), ("abcd", "abc", 1), ("abcd", "xbcdy", 2), ("abcd", "dcba", 3)])
def test_osa(a, b, d):
    assert osa(a, b, 2) == min(d, 3)


NAMES = {
    "A": ["Sezfek Mivleb Materials", "SEZFEK MIVLEB MATERIALS LTD", "Sezfek-Mivleb Materials", "sezfekmivlebmaterials", "Sezfekmivleb Materials", "Materials of Sezfek Mivleb", "Materials, Sezfek Mivleb",
          "Sezfek Mivleb Materials (SMM)", "SMM (Sezfek Mivleb Materials)", "Sezfek Mivl Materials", "Sézfek Mivleb Matls", "S3zfek M1vleb Materials", '"Sezfek Mivleb Materials"', " Sezfek Mivleb Materials.", "Team Sezfek Mivleb Materials",
          "The Sezfek Mivleb Materials Company", "Sezfek Mivleb Materials - Talent Team", "Mivleb Sezfek Materials", "Sezfke Mivleb Materials, L.L.C."],
    "B": ["Sezfek Mivleb Technologies", "Sezfek Mivleb Tech", "Sezfek Mivleb Technologies (P) Ltd"],
    "C": ["Banrum Visyit Software f/k/a Zopdid Hatyod Software", "Banrum Visyit Software", "Zopdid Hatyod S/W", "Zopdid Hatyod Software (formerly Old Hatyod Software)", "Old Hatyod Software"],
    "D": ["Tokyod Vavduv", "Tokyod Vavduv Networks", "Tokyod Vavduv L.L.C.", "Tokyod Vavduv Netwks"],
}
NONE = ["", "  ", None, "Confidential", "N/A", "Company name withheld", "Undisclosed", "Stealth Startup", "Hiring Company", "Confidential Client"]


def fillers():
    kinds = ["Materials", "Technologies", "Software", "Networks"]
    r = random.Random(2)
    syl = ["".join(x) for x in itertools.product("bdfgk", "aeiou", "lmnrt")]
    return [f"{''.join(r.sample(syl, 2)).title()} {''.join(r.sample(syl, 2)).title()} {k}" for k in kinds for _ in range(25)]


def test_names(spark):
    rows = [(n,) for v in NAMES.values() for n in v] * 2 + [(n,) for n in [*NONE, *fillers()]]
    x = link_names(spark.createDataFrame(rows, "name string"))
    got = {r["name"]: r["class"] for r in x.collect()}
    assert not set(NONE) & set(got)
    classes = {k: {got[n] for n in v} for k, v in NAMES.items()}
    assert all(len(v) == 1 for v in classes.values()), classes
    assert len({next(iter(v)) for v in classes.values()}) == 4
    pairs = {tuple(r) for r in name_pairs(x).collect()}
    assert all(a < b for a, b in pairs)
    assert len([p for p in pairs if p[0] in NAMES["B"] or p[1] in NAMES["B"]]) == 3


def test_moved_letters_tie_well_attested_keys(spark):
    """Three decorated spellings of a typo don't part it from its name."""
    rows = [(f"{n}{d}",) for n in ("Brandexolm", "Bradnexolm") for d in ("", " Ltd", " Inc")]
    x = link_names(spark.createDataFrame(rows, "name string")).collect()
    assert len(x) == 6 and len({r["class"] for r in x}) == 1


@pytest.mark.parametrize("times", [1, 12])
def test_typos_at_two_sizes(spark, times):
    """A typo is tied to its name, and two well attested names stay apart, however many spellings there are of each."""
    dress = ["", " Ltd", " Inc", " LLC", " GmbH", " Group", " Careers", " Hiring", " Team", " plc"]
    spelt = lambda key, n: [f"{key[: 3 + i // len(dress)]}{'.' * (i >= len(dress))}{key[3 + i // len(dress) :]}{dress[i % len(dress)]}" if i < len(dress) else f'"{key}"' + " " * (i - len(dress)) + dress[i % len(dress)] for i in range(n)]
    rows = [*spelt("Brandexolm", 10 * times), *spelt("Brandexxolm", times), *spelt("Kolvanther", 9 * times), *spelt("Kolvanthor", 8 * times)]
    x = {r["name"]: r["class"] for r in link_names(spark.createDataFrame([(n,) for n in rows], "name string")).collect()}
    assert len(x) == len(set(rows))
    assert len({x[n] for n in rows if "olm" in n}) == 1
    assert x["Kolvanther"] != x["Kolvanthor"]


def test_words_in_any_order(spark):
    rows = [(n,) for n in ("Abrel Tovin Mesk", "Mesk Abrel Tovin", "Tovin Mesk Abrel", "Abrel Tovin", "Mesk")]
    x = {r["name"]: r["class"] for r in link_names(spark.createDataFrame(rows, "name string")).collect()}
    assert len({x[n] for n, in rows[:3]}) == 1 and len(set(x.values())) == 3


def test_segment_join_against_brute_force(spark):
    r = random.Random(9)
    keys = list({"".join(r.choice("abc") for _ in range(r.randint(1, 9))) for _ in range(150)})

    def lev(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            c = [i]
            for j, y in enumerate(b, 1):
                c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
            p = c
        return p[-1]

    df = spark.createDataFrame([("g", k) for k in keys], "kind string, key string")
    got = {(x["a"], x["b"]): x["d"] for x in similar_keys(df, 2).collect()}
    want = {}
    for a, b in itertools.permutations(keys, 2):
        if min(len(a), len(b)) > 2 and (len(b), b) < (len(a), a) and (d := lev(a, b)) <= 2:
            want[a, b] = d
    assert got == want
    assert [sum(n for _, n in segments(m, 2)) for m in range(3, 20)] == list(range(3, 20))


def test_parts():
    assert split_former("X Y (formerly Z W)") == ["X Y", "Z W"] and split_former("X, previously Z") == ["X", "Z"] and split_former("Express Ltd") == ["Express Ltd"]
    assert words_of("Logistics, Abc Def") == ["abc", "def", "logistics"] and words_of("Abc Def, GmbH") == ["abc", "def"]
    kinds = ["software", "services", "systems", "materials", "media"]
    assert [short_form(a, kinds) for a in ("svcs", "sys", "matls", "media", "s", "softwrae", "medi")] == ["services", "systems", "materials", "media", None, "software", "media"]


def test_empty(spark):
    assert link_names(spark.createDataFrame([(None,), ("",)], "name string")).count() == 0
