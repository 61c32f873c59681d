from __future__ import annotations

import html
import itertools
import os
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import functions as F

from postloom.llm.leak import ItemIndex, edits_within, leaked_items, prefix_within
from postloom.llm.mixture import mix_sources, sainte_lague, shard_quotas
from postloom.llm.near_dup import _compare, candidate_pairs, expand_copies, similar_pairs
from postloom.llm.split_text import boundaries, cores, pieces, split_oversized
from postloom.llm.tokenizer import VOCABULARY, load
from postloom.llm.wordhash import shingle_sets, word_hashes

class ListParam(AccumulatorParam):
    def zero(self, value):
        return []

    def addInPlace(self, a, b):
        return a + b


needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")
W = lambda s: re.findall("[a-z0-9]+", (s or "").lower())


def test_word_hashes():
    texts = ["Hello, wörld 42", "", None, "hello", "Kelvin K and İ", "a" * 3_000_000, "x y " * 300_000]
    h, off = word_hashes(texts)
    assert np.diff(off).tolist() == [len(W(t)) for t in texts[:5]] + [off[6] - off[5], 600_000]
    assert h[0] == h[off[3]] and len(set(h[:4].tolist())) == 4
    x, at = shingle_sets(*word_hashes(["a b c d", "b c d", "a b"]), 3)
    assert np.diff(at).tolist() == [2, 1, 0] and x[at[1]] in x[: at[1]]


def adverts(seed=3, n=150):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        base = [r.choice(vocab) for _ in range(r.randint(4, 120))]
        out.append(" ".join(base))
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            copy = list(base)
            for _ in range(r.choice([0, 1, 3, 8])):
                copy[r.randrange(len(copy))] = r.choice(vocab)
            out.append(" ".join(copy) + ("." if r.random() < 0.3 else ""))
    return out


def jaccard(texts, k):
    s = [frozenset(zip(*[W(t)[i:] for i in range(k)])) for t in texts]
    return {(i, j): len(s[i] & s[j]) / len(s[i] | s[j]) for i, j in itertools.combinations(range(len(s)), 2) if s[i] and s[j]}


@pytest.mark.parametrize(("k", "num", "den"), [(3, 1, 2), (5, 4, 5)])
def test_pairs_against_brute_force(spark, k, num, den):
    texts = adverts()
    df = spark.createDataFrame(list(enumerate([*texts, None, "", "one"])), "n bigint, t string").withColumn("id", F.lit("clash"))
    pairs, members = similar_pairs(df, "n", F.col("t"), k=k, similarity=(num, den))
    got = {tuple(r) for r in expand_copies(pairs, members).collect()}
    want = {p for p, s in jaccard(texts, k).items() if s * den >= num}
    assert got <= want and len(got) >= 0.95 * len(want)


def test_a_third_of_all_rows_alike(spark):
    """One large group, partly exact copies and partly edited, splits into blocks and loses nothing."""
    r = random.Random(5)
    base = [f"z{i}" for i in range(200)]
    hot = []
    for i in range(120):
        c = list(base)
        c[i % 200] = f"edit{i}"
        hot.append(" ".join(c))
    texts = hot + hot[:30] + adverts(8, 80)
    r.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "n bigint, t string")
    pairs, members = similar_pairs(df, "n", F.col("t"), k=3, similarity=(1, 2), leaf=16)
    got = {tuple(x) for x in expand_copies(pairs, members).collect()}
    want = {p for p, s in jaccard(texts, 3).items() if s >= 0.5}
    assert got <= want and len(got) >= 0.97 * len(want)


def test_no_task_gets_a_hot_node(spark, monkeypatch):
    """A third of all rows share a boilerplate: no run of equal keys that is compared is longer than a small node or two blocks."""
    from postloom.llm import near_dup as N

    r = random.Random(6)
    vocab = [f"w{i}" for i in range(3000)]
    boiler = [f"b{i}" for i in range(60)]
    texts = [" ".join(boiler + [r.choice(vocab) for _ in range(50)]) for _ in range(400)] + [" ".join(r.choice(vocab) for _ in range(110)) for _ in range(800)]
    texts += [t + " again" for t in texts[:40]]
    df = spark.createDataFrame(list(enumerate(texts)), "n bigint, t string")
    seen = spark.sparkContext.accumulator([], ListParam())
    plain = N._compare

    def watched(least, sided=False):
        run = plain(least, sided)

        def counted(batches):
            held = list(batches)
            ks = np.concatenate([b.column(0).to_numpy() for b in held]) if held else np.zeros(0)
            seen.add([(sided, int(np.unique(ks, return_counts=True)[1].max()))] if len(ks) else [])
            yield from run(iter(held))

        return counted

    monkeypatch.setattr(N, "_compare", watched)
    sigs = df.select(F.col("n").alias("id"), F.col("t").alias("text")).mapInArrow(N._features(3, False), "id bigint, f1 bigint, f2 bigint, sig binary").select("id", "sig")
    pairs = {tuple(x) for x in N.candidate_pairs(sigs, leaf=32, block=64, least=44).collect()}
    assert {(i, 1200 + i) for i in range(40)} <= pairs
    runs = seen.value
    assert max(n for sided, n in runs if not sided) <= 32
    assert all(n <= 3 * 64 for sided, n in runs if sided)


@pytest.mark.parametrize("leaf", [256, 1])
def test_recall_at_the_threshold(spark, leaf):
    """Pairs of exactly 0.5 are found wherever their nodes end: at the first depth, or at the last as in a much larger table."""
    texts = []
    for i in range(600):
        head = [f"h{i}x{j}" for j in range(42)]
        texts += [" ".join(head + [f"{side}{i}x{j}" for j in range(20)]) for side in "ab"]
    df = spark.createDataFrame(list(enumerate(texts)), "n bigint, t string")
    got = {tuple(x) for x in similar_pairs(df, "n", F.col("t"), k=3, similarity=(1, 2), leaf=leaf)[0].collect()}
    assert got <= {(2 * i, 2 * i + 1) for i in range(600)} and len(got) >= 0.965 * 600


def test_no_texts(spark):
    df = spark.createDataFrame([(1, None), (2, "a b")], "n bigint, t string")
    pairs, members = similar_pairs(df, "n", F.col("t"), k=3)
    assert pairs.count() == 0 and members.count() == 0
    assert expand_copies(pairs, members).count() == 0


def passages():
    r = random.Random(11)
    vocab = [f"v{i}" for i in range(300)]
    words = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [words(r.randint(10, 80)) for _ in range(25)]
    docs = []
    for i in range(120):
        w = words(r.randint(0, 150))
        if i % 3 == 0:
            it = r.randrange(len(items))
            n = r.choice([8, 11, 12, 15, 40])
            a = r.randrange(max(1, len(items[it]) - n))
            at = r.randrange(len(w) + 1)
            w[at:at] = items[it][a : a + n]
        t = " ".join(w)
        docs.append(t if i % 4 else "<p class='x'>" + t.replace(" ", "&nbsp;", 3).replace(" ", "</b> ", 1).upper() + "</p>")
    return items, docs


def test_leaks_against_brute_force(spark):
    items, docs = passages()
    d = spark.createDataFrame([*enumerate(docs), (900, None), (901, "")], "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    i = spark.createDataFrame([*[(k, " ".join(w)) for k, w in enumerate(items)], (500, None), (501, "short")], "item_id int, body string")
    want = set()
    for a, t in enumerate(docs):
        w = " " + " ".join(W(html.unescape(re.sub(r"<[^>]*>", " ", t)))) + " "
        want |= {(a, b) for b, it in enumerate(items) for s in range(len(it) - 11) if f" {' '.join(it[s : s + 12])} " in w}
    for block in (20_000, 7):
        got = {tuple(r) for r in leaked_items(d, "doc_id", "text", i, "item_id", "body", block=block).distinct().collect()}
        assert got == want
    assert leaked_items(d, "doc_id", "text", i.where("false"), "item_id", "body").count() == 0


def test_edited_passages_reach_recall(spark):
    r = random.Random(13)
    vocab = [f"v{i}" for i in range(500)]
    items = [[r.choice(vocab) for _ in range(60)] for _ in range(30)]
    docs, want = [], set()
    for n in range(150):
        it = r.randrange(30)
        p = items[it][10:40]
        for _ in range(2):
            p[r.randrange(3, 27)] = "typo"
        docs.append(" ".join([r.choice(vocab) for _ in range(30)] + p + [r.choice(vocab) for _ in range(30)]))
        want.add((n, it))
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    i = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id int, body string")
    got = {tuple(x) for x in leaked_items(d, "doc_id", "text", i, "item_id", "body", width=24, max_edits=3, walks=3, places=5).distinct().collect()}
    assert len(got & want) >= 0.9 * len(want) and got <= want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_recall_of_three_mixed_edits_in_documents(spark):
    """Passages of 24 words with three insertions, deletions or substitutions, put into documents: nine of ten are found with the parameters of p7_near."""
    r = random.Random(5)
    items = [(x["item_id"], W(x["body"])) for x in spark.read.parquet("/root/testdata/sf0.001/golden_item.parquet").collect()]
    items = [(i, w) for i, w in items if len(w) >= 24]
    docs = [W(x["text"]) for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang = 'en'").collect()]
    vocab = [w for d in docs for w in d]
    rows, want = [], set()
    for k in range(300):
        i, w = r.choice(items)
        s = r.randrange(len(w) - 23)
        p = list(w[s : s + 24])
        for _ in range(3):
            at, kind = r.randrange(len(p)), r.randrange(3)
            p[at : at + (kind != 1)] = [] if kind == 2 else [r.choice(vocab)]
        d = r.choice(docs)
        at = r.randrange(len(d) + 1)
        rows.append((k, " ".join(d[:at] + p + d[at:])))
        want.add((k, i))
    x = leaked_items(spark.createDataFrame(rows, "d bigint, t string"), "d", "t", spark.createDataFrame([(i, " ".join(w)) for i, w in items], "i bigint, b string"), "i", "b", width=24, max_edits=3, walks=6, places=5, samples=4)
    got = {tuple(y) for y in x.distinct().collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_prefixes_within_edits():
    r = random.Random(4)
    for _ in range(3000):
        y, t = [r.choice("ab") for _ in range(r.randint(0, 6))], [r.choice("ab") for _ in range(r.randint(0, 9))]
        most = r.randint(0, 3)
        assert prefix_within(t, y, most) == any(edits_within(t[:n], y, most) for n in range(len(t) + 1)), (t, y, most)


def test_edits():
    assert edits_within(list("abcd"), list("abxd"), 1) and not edits_within(list("abcd"), list("axxd"), 1) and edits_within([], [], 0)
    assert ItemIndex([], 12, 1, 8).hits(*word_hashes(["a b c " * 9])).shape == (0, 2)


def test_sainte_lague_against_the_definition():
    r = random.Random(1)
    for _ in range(60):
        w = {k: r.randint(1, 50) for k in "abcdef"[: r.randint(1, 6)]}
        most = {k: r.randint(0, 40) for k in w} if r.random() < 0.5 else {}
        seats = r.randint(0, 60)
        want = {k: 0 for k in w}
        for _ in range(seats):
            free = [k for k in w if want[k] < most.get(k, 10**9)]
            if not free:
                break
            k = max(sorted(free), key=lambda k: Fraction(w[k], 2 * want[k] + 1))
            want[k] += 1
        got = sainte_lague(w, seats, most)
        assert sum(got.values()) == sum(want.values())
        assert got == want, (w, seats, most)
        assert all(got[k] <= most.get(k, 10**9) for k in w)


def test_shard_quotas_add_up_and_follow_the_shards(spark):
    r = random.Random(12)
    rows, want = [], {}
    for s, n in (("a", 400), ("b", 3), ("c", 1), ("d", 50)):
        have = [r.randint(1, 10**12 if s == "a" else 40) for _ in range(n)]
        tokens = r.randint(1, 3 * sum(have))
        want[s] = (tokens, sum(have))
        rows += [(s, i, sum(have), tokens, h) for i, h in enumerate(have)]
    got = shard_quotas(spark.createDataFrame(rows, "source string, shard int, avail bigint, tokens bigint, have bigint")).collect()
    assert len(got) == len(rows)
    for s, (tokens, avail) in want.items():
        own = [g for g in got if g["source"] == s]
        assert sum(g["quota"] for g in own) == tokens
        assert all(abs(g["quota"] * avail - tokens * g["have"]) < avail for g in own)
    assert shard_quotas(spark.createDataFrame([], "source string, shard int, avail bigint, tokens bigint, have bigint")).count() == 0


@needs_vocabulary
def test_mixture(spark):
    rows = [(i, s, f"word number {i} " * (1 + i % 7)) for s, n in (("a", 300), ("b", 60), ("c", 20), ("no_target", 50)) for i in range(1000 * ord(s[0]), 1000 * ord(s[0]) + n)]
    docs = spark.createDataFrame([*rows, (1, None, "x"), (2, "a", None), (3, "a", "")], "id bigint, source string, text string").withColumn("uses", F.lit("clash"))
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 4), ("missing", 0.1, 2)], "source string, target_share double, max_repeats int")
    for total, shard in ((None, 2_000_000), (None, 500), (4000, 700)):
        mix, shares = mix_sources(docs, "id", "source", F.col("text"), t, total_tokens=total, shard_tokens=shard)
        s = {r["source"]: r for r in shares.collect()}
        m = mix.collect()
        assert {r["source"] for r in m} <= {"a", "b", "c"} and all(1 <= r["uses"] <= {"a": 1, "b": 3, "c": 4}[r["source"]] for r in m)
        assert len({(r["id"]) for r in m}) == len(m)
        assert s["missing"]["mixed_tokens"] == 0 and "no_target" not in s
        for k, want in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
            assert s[k]["actual_share"] == pytest.approx(want, abs=0.03), (total, shard, s)
            assert s[k]["mixed_tokens"] == sum(r["n_tokens"] * r["uses"] for r in m if r["source"] == k)
        assert sum(s[k]["actual_share"] for k in s) == pytest.approx(1, abs=1e-4)
    mix, shares = mix_sources(docs.where("false"), "id", "source", F.col("text"), t)
    assert mix.count() == 0 and shares.agg(F.sum("mixed_tokens")).first()[0] == 0


@needs_vocabulary
def test_mixture_keeps_small_sources_of_a_large_total(spark):
    """A ten-thousandth of the total is more than a small source has in a shard, or in all."""
    rows = [(i, "large", f"word number {i} " * 50) for i in range(3000)] + [(10_000 + i, "small", f"word number {i} " * 4) for i in range(100)] + [(20_000, "tiny", "one word")]
    docs = spark.createDataFrame(rows, "id bigint, source string, text string")
    t = spark.createDataFrame([("large", 0.9969, 1), ("small", 0.003, 3), ("tiny", 0.0001, 40)], "source string, target_share double, max_repeats int")
    for total, shard in ((None, 2000), (None, 2_000_000), (400_000, 2000), (10_000_000, 2000)):
        s = {r["source"]: r for r in mix_sources(docs, "id", "source", F.col("text"), t, total_tokens=total, shard_tokens=shard)[1].collect()}
        for k in s:
            assert s[k]["mixed_tokens"] == pytest.approx(s[k]["quota_tokens"], rel=0.05) and s[k]["mixed_tokens"] > 0, (total, shard, s[k])
            limit = s[k]["available_tokens"] * s[k]["max_repeats"]
            assert s[k]["quota_tokens"] == (limit if total == 10_000_000 else pytest.approx(s[k]["target_share"] * sum(r["quota_tokens"] for r in s.values()), abs=1))


def test_cores_merge_weakest_first():
    assert cores([3, 3, 3, 3], [1, 9, 1], 6) == [(0, 2), (2, 4)]
    assert cores([3, 3, 3, 3], [9, 1, 9], 6) == [(0, 1), (1, 3), (3, 4)]
    assert cores([10, 1], [1], 6) == [(0, 1), (1, 2)] and cores([5], [], 6) == [(0, 1)]
    assert boundaries("A b. C\n\nD")[8] == 6 and boundaries("") == {}


TEXTS = [
    "One sentence here. " * 40 + "\n\n" + "Another, with a clause; and more. " * 50,
    "入社後は先輩と一緒に検索機能の改善に取り組みます。勤務時間は柔軟です。" * 30,
    "x" * 5000,
    "🙂🙃é" * 700,
    "line\r\nline two\r\n\r\n" * 120,
    " " * 3000,
    "tiny",
]


@needs_vocabulary
@pytest.mark.parametrize(("most", "overlap"), [(64, 8), (50, 0), (7, 5), (3, 9)])
def test_pieces_cover_and_fit(most, overlap):
    enc, size = load()
    for t in TEXTS:
        ps = pieces(t, most, overlap, enc, size)
        n = len(enc.encode_ordinary(t))
        assert bool(ps) == (n > most)
        if not ps:
            continue
        assert ps[0][0] == 0 and ps[-1][2] == len(t)
        assert all(a[2] == b[1] for a, b in zip(ps, ps[1:], strict=False))
        wide = max(len(enc.encode_ordinary(c)) for c in set(t))
        for i, (s, c, e, k) in enumerate(ps):
            assert s <= c < e and (k <= most or wide + min(overlap, most - 1) > most)
            if wide == 1:
                assert len(enc.encode_ordinary(t[s:e])) <= most
                if i and ps[i - 1][2] - s < ps[i - 1][2]:
                    assert 0 <= len(enc.encode_ordinary(t[s:c])) <= min(overlap, most - 1)


@needs_vocabulary
def test_split(spark):
    rows = [(i, t, l) for i, t in enumerate(TEXTS) for l in ("en",)] + [(90, TEXTS[0], None), (91, TEXTS[0], "xx"), (92, None, "en"), (93, "", "en")]
    docs = spark.createDataFrame(rows, "doc bigint, body string, lang string").withColumn("piece", F.lit("clash"))
    lim = spark.createDataFrame([("en", 64, 8), ("und", 100, 10)], "lang string, max_tokens int, overlap_tokens int")
    out = split_oversized(docs, "doc", "body", "lang", lim).collect()
    by: dict = {}
    for r in out:
        by.setdefault(r["id"], []).append(r)
    assert set(by) == {0, 1, 2, 3, 4, 90, 91} | ({5} if 5 in by else set())
    assert max(r["n_tokens"] for r in by[90]) > 64 and len(by[90]) == len(by[91])
    for k, ps in by.items():
        text = next(t for i, t, _ in rows if i == k)
        ps.sort(key=lambda r: r["piece_no"])
        assert "".join(p["piece"][p["core_start"] - p["start_char"] :] for p in ps) == text
    natural = [p["piece"].rstrip()[-1] in ".;," for p in by[0]]
    assert sum(natural) >= 0.9 * len(natural)
    assert split_oversized(docs.where("false"), "doc", "body", "lang", lim).count() == 0


def test_compare_holds_runs_over_batches():
    import pyarrow as pa

    k = np.repeat(np.arange(40, dtype=np.int64), 5)
    b = pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.arange(200, dtype=np.int64)), pa.array(k), pa.array(k)], ["node", "id", "s1", "s2"])
    whole = {tuple(x.values()) for r in _compare(64)(iter([b])) for x in r.to_pylist()}
    cut = {tuple(x.values()) for r in _compare(64)(iter([b.slice(0, 7), b.slice(7, 6), b.slice(13)])) for x in r.to_pylist()}
    assert whole == cut and len(whole) == 40 * 10


def test_candidates_need_no_texts(spark):
    assert candidate_pairs(spark.createDataFrame([], "id bigint, sig binary")).count() == 0
