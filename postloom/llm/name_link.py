"""Variant spellings of one name linked (problem 3).

A name is reduced to its distinctive words and its kind: decorations (quotes, legal forms, "Team", "careers", initials in brackets) go, and the
words that many names end in are learned from the column as kinds ("Logistics", "Lgstcs." and "Logistic" are one). The distinctive words, written together, are
the key. Keys of one kind are joined by the pigeonhole principle: of k + 1 segments of one key at least one stands unedited
in the other, shifted by at most k places; segments are looked up in an inverted index and hits are verified by banded
edit distance. Two close keys are one employer unless both are spelt so often that a typing error doesn't explain the rarer one. The same
words in another order and former names tie keys as well; components of all ties are the employers.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.operators.graph import connected_components
from postloom.operators.lineage import written

# Words of legal forms.
LEGAL = frozenset(
    "ltd limited llc llp lp inc incorporated corp corporation gmbh ag kg ug se sa sas sarl srl spa bv nv ab oy as plc pvt private pte pty co kk mbh".split()
)
# Words around a name that aren't part of it.
ASIDE = frozenset("team group careers career hiring jobs recruiting recruitment talent referral via the company holdings".split())
# Phrases that hide the employer.
HIDDEN = re.compile(
    r"^(?:|n/?a|none|null|nil|unknown|not (?:disclosed|specified|available|stated|provided)|undisclosed|anonymous|tbd|tba|various|multiple|self|"
    r"(?:strictly |highly )?confidential(?: (?:client|company|employer|firm|search))?|(?:a |an |our |the |leading |reputed |well[- ]known |top |global |large |major |fast[- ]growing )*"
    r"(?:client|company|employer|start-?up|hiring (?:company|manager|firm|team)|firm|mnc|organi[sz]ation|private (?:company|employer|advertiser))(?: (?:name )?(?:withheld|hidden|confidential|undisclosed|not disclosed))?|"
    r"(?:company |employer )?name (?:withheld|hidden|confidential|undisclosed)|stealth(?:[- ]mode)?(?: (?:startup|start-up|company|mode))?)$",
    re.I,
)
_FORMER = re.compile(r"\s*(?:\(\s*(?:formerly|previously|fka|f/k/a|ex|née|now|earlier)\s+(?:known as\s+)?(.+?)\)|[,;–—-]*\s+(?:formerly|previously|f/?k/?a|ex|earlier)[\s-]+(?:known as\s+)?(.+))\s*$", re.I)
_LEET = str.maketrans("0134578", "oieastb")


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower().replace("ß", "ss")


def split_former(name: str) -> list[str]:
    """A name and the former name it states."""
    m = _FORMER.search(name)
    return [name[: m.start()], m.group(1) or m.group(2)] if m and name[: m.start()].strip() else [name]


def words_of(name: str) -> list[str]:
    """Words of a name without decorations; empty for blanks and phrases that hide the employer."""
    t = fold(" ".join(name.split())).strip(" .\"'“”„`*")
    if HIDDEN.match(t) or not any(c.isalnum() for c in t):
        return []
    m = re.match(r"^([a-z0-9.&]{2,6})\s*\((.{5,})\)$", t)  # "ABC (Able Baker Company)"
    if m:
        t = m.group(2)
    t = re.sub(r"\((?:p|pvt)\)", " ", t)
    t = re.sub(r"\([^)]*\)", " ", t)
    t = re.sub(r"\bs/w\b", "software", t)
    t = re.sub(r"\b(?:[a-z]\.){2,}", lambda x: x.group().replace(".", ""), t)
    t = re.sub(r"\s-\s.*\bteam$", " ", t)
    ofs = re.match(r"^(\w+) of (.+)$", t)
    if ofs:
        t = f"{ofs.group(2)} {ofs.group(1)}"
    elif (c := re.match(r"^([^,]+),\s*(.+)$", t)) and not all(w in LEGAL for w in re.findall(r"[a-z0-9]+", c.group(2))):
        t = f"{c.group(2)} {c.group(1)}"
    ws = [w.translate(_LEET) if any(x.isalpha() for x in w) and any(x.isdigit() for x in w) else w for w in re.findall(r"[a-z0-9]+", t)]
    while len(ws) > 1 and (ws[-1] in LEGAL or ws[-1] in ASIDE):
        ws.pop()
    while len(ws) > 1 and ws[0] in ASIDE:
        ws.pop(0)
    return ws


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for n in pdf["name"]:
            for part, x in enumerate(split_former(n)):
                if ws := words_of(x):
                    out.append((n, part, ws))
        yield pd.DataFrame(out, columns=["name", "part", "words"]).astype({"part": "int32"})


def short_form(a: str, kinds: list[str]) -> str | None:
    """The kind that a word abbreviates or misspells: same first letter, letters in order, the only one."""
    if a in kinds:
        return a
    starts = [k for k in kinds if len(a) >= 2 and k.startswith(a)]
    if len(starts) == 1:
        return starts[0]
    near = [k for k in kinds if len(a) >= 4 and abs(len(a) - len(k)) <= 1 and _one_edit(a, k)]
    if len(near) == 1:
        return near[0]
    inside = [k for k in kinds if len(a) >= 3 and k[0] == a[0] and k[-1] == a[-1] and _in_order(a, k)]
    return inside[0] if len(inside) == 1 else None


def _in_order(a: str, b: str) -> bool:
    it = iter(b)
    return all(c in it for c in a)


def _one_edit(a: str, b: str) -> bool:
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def _keyed(kinds: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for n, part, ws in zip(pdf["name"], pdf["part"], pdf["words"], strict=True):
                ws = list(ws)
                kind = ""
                if len(ws) > 1 and (k := short_form(ws[-1], kinds)):
                    kind, ws = k, ws[:-1]
                elif len(ws) == 1:  # all written together
                    for k in sorted(kinds, key=len, reverse=True):
                        if ws[0].endswith(k) and len(ws[0]) - len(k) >= 5:
                            kind, ws = k, [ws[0][: -len(k)]]
                            break
                out.append((n, part, "".join(ws), kind, " ".join(sorted(ws)) if len(ws) > 1 else ""))
            yield pd.DataFrame(out, columns=["name", "part", "key", "kind", "bag"]).astype({"part": "int32"})

    return run


def segments(n: int, k: int) -> list[tuple[int, int]]:
    """Even partition of a key of length ``n`` into k + 1 segments: (start, length)."""
    base, extra = divmod(n, k + 1)
    out, at = [], 0
    for i in range(k + 1):
        size = base + (i >= k + 1 - extra)
        out.append((at, size))
        at += size
    return out


def _indexed(k: int):
    """Segments of a key, under its kind, length and segment number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(g, key, f"{g}\t{len(key)}\t{i}\t{key[a : a + n]}") for g, key in zip(pdf["kind"], pdf["key"], strict=True) if len(key) > k for i, (a, n) in enumerate(segments(len(key), k))]
            yield pd.DataFrame(out, columns=["kind", "key", "probe"])

    return run


def _probes(k: int):
    """Substrings of a key that could be a segment of a key up to k shorter or as long, at shifted places."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for g, key in zip(pdf["kind"], pdf["key"], strict=True):
                own = set()
                for m in range(max(k + 1, len(key) - k), len(key) + 1):
                    for i, (a, n) in enumerate(segments(m, k)):
                        for at in range(max(0, a - k), min(len(key) - n, a + k) + 1):
                            own.add(f"{g}\t{m}\t{i}\t{key[at : at + n]}")
                out += [(g, key, p) for p in own]
            yield pd.DataFrame(out, columns=["kind", "key", "probe"])

    return run


def similar_keys(keys: DataFrame, k: int = 2) -> DataFrame:
    """``kind, a, b, d``: distinct keys of one kind within edit distance ``k``, each pair once (the longer, or later, is ``a``).

    ``keys``: ``kind, key`` distinct. Keys of at most ``k`` letters join nothing. Exact: the pigeonhole principle loses no pair.
    """
    idx = keys.mapInPandas(_indexed(k), "kind string, key string, probe string").select("probe", F.col("key").alias("b"), F.col("kind").alias("kb"))
    prb = keys.mapInPandas(_probes(k), "kind string, key string, probe string").select("probe", "kind", F.col("key").alias("a"))
    x = prb.join(idx, "probe").where((F.length("b") < F.length("a")) | ((F.length("b") == F.length("a")) & (F.col("b") < F.col("a"))))
    x = x.select("kind", "a", "b").distinct()
    return x.withColumn("d", F.levenshtein("a", "b", k)).where(F.col("d").between(1, k))


def learn_kinds(parts: DataFrame, share: float = 0.005) -> list[str]:
    """Words that end at least ``share`` of the names with two words before them: at most 1 / share of them."""
    last = parts.where("size(words) >= 3").select(F.element_at("words", -1).alias("w"))
    n = last.count()
    rows = last.groupBy("w").count().where((F.col("count") >= max(3.0, share * n)) & (F.length("w") >= 3)).orderBy("w").collect()
    return [r["w"] for r in rows]


def is_typo(small: Column, large: Column, rate: float = 0.1, prior: float = 20.0) -> Column:
    """Whether ``small`` spellings of one key beside ``large`` of a close one are better explained by typing errors than by an employer of its own.

    The odds are ``prior`` times the likelihood of so few under a binomial of ``rate``, over that under any share alike (1 / (n + 1)). What counts is the share, with
    the strength that its numbers give it: beside 10 spellings up to 5 are typos, beside 40 up to 13, beside 400 up to 71, and ever closer to ``rate`` of both as they grow.
    """
    n = small + large
    # log of n! / (k! (n - k)!) by Stirling's series with its first correction
    fact = lambda k: (k + 0.5) * F.log(k + 1.0) - (k + 1.0) + 0.5 * F.log(F.lit(6.283185307179586)) + 1.0 / (12.0 * (k + 1.0))
    gain = fact(n) - fact(small) - fact(large) + small * F.log(F.lit(rate)) + large * F.log(F.lit(1 - rate)) + F.log(n + 1.0)
    return gain + F.log(F.lit(prior)) > 0


def link_names(names: DataFrame, k: int = 2) -> DataFrame:
    """``name, class`` for every distinct name of ``names`` that means an employer.

    NULL, blank and hiding names are left out. A typo ties a key to a neighbour unless both are too well attested for that (``is_typo``, over the distinct
    names that spell each key); a neighbour's key cut short or with two letters changed places is tied in any case. Two letters more count only beside a key
    that three names spell. The same words in another order are one key. A key without a kind joins the one kind that its key has, none if it has several.
    """
    parts = written(names.select("name").where("name IS NOT NULL").distinct().mapInPandas(_rows, "name string, part int, words array<string>"))
    keyed = written(parts.mapInPandas(_keyed(learn_kinds(parts)), "name string, part int, key string, kind string, bag string"))
    node = F.concat_ws("\t", "kind", "key")
    support = written(keyed.groupBy("kind", "key").agg(F.count_distinct("name").alias("support")))
    # ties of keys within a kind
    close = similar_keys(support.select("kind", "key"), k)
    sup = support.select("kind", "key", "support")
    close = close.join(sup.select("kind", F.col("key").alias("a"), F.col("support").alias("na")), ["kind", "a"]).join(
        sup.select("kind", F.col("key").alias("b"), F.col("support").alias("nb")), ["kind", "b"]
    )
    small, large = F.least("na", "nb"), F.greatest("na", "nb")
    moved = (F.length("a") == F.length("b")) & (F.array_sort(F.split("a", "")) == F.array_sort(F.split("b", "")))
    cut = (F.length("a") == F.length("b") + 2) & F.col("a").startswith(F.col("b"))
    inner = (F.length("a") == F.length("b") + 2) & ~cut
    close = close.where(((F.col("d") == 1) | moved | cut | (inner & (large >= 3))) & (moved | cut | is_typo(small, large)))
    ties = close.select(F.concat_ws("\t", "kind", "a").alias("a"), F.concat_ws("\t", "kind", "b").alias("b"))
    # reordered words: each key with the first one of its words
    bags = keyed.where("bag <> ''").groupBy("kind", "bag", "key").count()
    low = bags.groupBy("kind", "bag").agg(F.min("key").alias("low"))
    ties = ties.union(bags.join(low, ["kind", "bag"]).where("key <> low").select(node.alias("a"), F.concat_ws("\t", "kind", "low").alias("b")))
    # former names
    one = keyed.where("part = 0").select("name", node.alias("a"))
    ties = ties.union(one.join(keyed.where("part = 1").select("name", node.alias("b")), "name").select("a", "b"))
    # names without a kind
    only = sup.where("kind <> ''").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("kind").alias("k1")).where("n = 1")
    bare = sup.where("kind = ''").select("key").join(only, "key").select(F.concat_ws("\t", F.lit(""), "key").alias("a"), F.concat_ws("\t", "k1", "key").alias("b"))
    ties = ties.union(bare).union(support.select(node.alias("a"), node.alias("b")))
    comp = connected_components(ties)
    return one.join(comp, F.col("a") == F.col("node")).select("name", F.col("component").alias("class"))


def name_pairs(classes: DataFrame) -> DataFrame:
    """``name_a < name_b`` (byte order): all pairs of names of one class; AQE splits large classes in the join."""
    x = classes.select("class", F.col("name").alias("name_a")).join(classes.select("class", F.col("name").alias("name_b")), "class")
    return x.where("name_a < name_b").select("name_a", "name_b")
