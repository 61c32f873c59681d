"""Free-typed values to the entries of a reference list (problem 1).

Token-level repair: each distinct token of the values is joined to the vocabulary of the reference names within a small edit distance (both sides
emit their deletions, equal deletions meet, the distance is verified). The repaired tokens vote for the names that hold them, at the place where
they stand; a name's score is its soft TF-IDF: the weights of its tokens times their similarity, over all its weight. Only names of which a text holds one
of the rare words without which the score can't be reached are looked at, so a word that many names share ("new", "san") brings up none by itself. The
best non-overlapping names of a value are its entries; of names that several entries share, the words around decide.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postloom.operators.lineage import written

_TOKEN = re.compile(r"[^\W_]+")
#: Marks after which the words around belong to another value.
_HARD = re.compile(r"[;|/•·\n\r\t+&\"“”\[\]{}]|<br|\bor\b|\band\b|\d[.)]\s", re.I)
# Other notations of the country codes in common use.
COUNTRY_WORDS = {
    "US": ["usa", "us", "u s", "u s a", "united states of america", "america"], "GB": ["uk", "gbr", "u k", "great britain", "england"], "IN": ["ind", "bharat"],
    "AU": ["aus"], "CA": ["can"], "DE": ["deu", "ger", "deutschland"], "JP": ["jpn", "nippon", "japan"], "SG": ["sgp"],
    "FR": ["fra"], "ES": ["esp", "espana"], "IT": ["ita", "italia"], "NL": ["nld", "holland"], "IE": ["irl"], "NZ": ["nzl"], "BR": ["bra", "brasil"],
}
# Short forms of the first words of place names.
SHORT = {"n": "north", "s": "south", "e": "east", "w": "west", "ft": "fort", "mt": "mount", "st": "saint", "gt": "great", "pt": "port"}
#: Words around a name that say nothing about where it is.
_ASIDE = frozenset("remote hybrid onsite office hq area metro metropolitan city wfo wfh near greater downtown region based in the district".split())
#: Longest token whose deletions are emitted; longer ones meet by the segments that edits leave whole.
LONGEST = 40
_EDITS = 2


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower().replace("ß", "ss")


def tokens(text: str) -> list[tuple[str, bool, bool]]:
    """(token, whether a dot follows, whether a hard mark or the start stands before it)."""
    t = fold(text)
    out, end = [], 0
    for m in _TOKEN.finditer(t):
        dot = m.end() < len(t) and t[m.end()] == "." and (m.end() + 1 == len(t) or not t[m.end() + 1].isalnum())
        out.append((m.group(), dot, not out or bool(_HARD.search(t, end, m.start()))))
        end = m.end()
    for i, (w, dot, hard) in enumerate(out[:-1]):
        if w in SHORT and not out[i + 1][2] and len(out[i + 1][0]) >= 4 and not (i and len(out[i - 1][0]) == 1):
            out[i] = (SHORT[w], False, hard)
    return out


def most_edits(n: int, longer: bool = False) -> int:
    """Edits allowed in a token of the vocabulary by its length; ``longer``: it is part of a name of several tokens, which the others confirm."""
    if longer:
        return 0 if n < 4 else 1 if n < 6 else 2
    return 0 if n < 5 else 1 if n < 8 else 2


def deletions(token: str, k: int) -> set[str]:
    return {"".join(c for i, c in enumerate(token) if i not in cut) for n in range(k + 1) for cut in combinations(range(len(token)), n)}


def _segments(n: int) -> list[tuple[int, int]]:
    """Even parts (start, length) of a word of ``n`` letters, one of which ``_EDITS`` edits leave whole: a transposition may touch two."""
    parts = 2 * _EDITS + 1
    cut = [n * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:], strict=False)]


def segment_keys(word: str) -> set[str]:
    """Keys of a long word of the vocabulary."""
    return {f"{len(word)}|{i}|{word[a : a + n]}" for i, (a, n) in enumerate(_segments(len(word)))}


def segment_probes(token: str) -> set[str]:
    """Keys of all words within ``_EDITS`` of a long token."""
    out = set()
    for m in range(len(token) - _EDITS, len(token) + _EDITS + 1):
        for i, (a, n) in enumerate(_segments(m)):
            out |= {f"{m}|{i}|{token[at : at + n]}" for at in range(max(0, a - _EDITS), min(len(token) - n, a + _EDITS) + 1)}
    return out


def osa(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions, or most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            d = min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            cur.append(d)
        if min(cur) > most:
            return most + 1
        before, prev = prev, cur
    return prev[-1]


def _token_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for t in pdf["text"]:
            before = ""
            for i, (w, d, hard) in enumerate(tokens(t)):
                rows.append((t, i, w, d, "" if hard else before))
                before = w
        yield pd.DataFrame(rows, columns=["text", "pos", "token", "dot", "prev"]).astype({"pos": "int32", "dot": "bool"})


def _name_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for i, n in zip(pdf["entry_id"], pdf["name"], strict=True):
            ws = [w for w, _, _ in tokens(n)]
            rows += [(i, " ".join(ws), len(ws), j, w) for j, w in enumerate(ws)]
            if len(ws) > 1 and len(ws[0]) >= 6:  # "A" or "Abc." for "A on B"
                rows.append((i, f"{ws[0]} ~", 1, 0, ws[0]))
        yield pd.DataFrame(rows, columns=["entry_id", "name", "n", "idx", "word"]).astype({"entry_id": "int64", "n": "int32", "idx": "int32"})


def _typed_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for t, dot in zip(pdf["token"], pdf["dot"], strict=True):
            rows += [(t, dot, k) for k in (deletions(t, most_edits(len(t) + 1, True)) if len(t) <= LONGEST else segment_probes(t))]
            if dot and len(t) >= 4:
                rows.append((t, dot, f"{t}."))
        yield pd.DataFrame(rows, columns=["token", "dot", "key"]).astype({"dot": "bool"})


def _vocabulary_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for w, longer in zip(pdf["word"], pdf["longer"], strict=True):
            if len(w) <= LONGEST + _EDITS:
                rows += [(w, longer, k) for k in deletions(w, most_edits(len(w), longer))]
            if len(w) >= LONGEST - _EDITS:
                rows += [(w, longer, k) for k in segment_keys(w)]
            rows += [(w, longer, f"{w[:n]}.") for n in range(4, len(w))]
        yield pd.DataFrame(rows, columns=["word", "longer", "key"]).astype({"longer": "bool"})


def _similarity(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        sims, edits = [], []
        for t, w, dot, longer in zip(pdf["token"], pdf["word"], pdf["dot"], pdf["longer"], strict=True):
            k = most_edits(len(w), longer)
            d = 0 if t == w else osa(t, w, k)
            s = 1 - d / len(w) if d <= k else 0.0
            short = dot and len(t) >= 4 and w.startswith(t) and t != w
            sims.append(max(s, 0.9) if short else s)
            edits.append(0 if short else d)
        out = pd.DataFrame({"token": pdf["token"], "dot": pdf["dot"], "word": pdf["word"], "sim": sims, "edits": edits}).query("sim > 0")
        yield out.astype({"edits": "int32"})


def repair_tokens(typed: DataFrame, words: DataFrame) -> DataFrame:
    """``token, dot, word, sim, edits``: each distinct typed token with every word of the vocabulary within its edit distance.

    ``typed``: ``token, dot`` (a dot follows: the token may be the start of a word); ``words``: ``word, longer``. An equi-join on deletions, of tokens beyond ``LONGEST`` letters on segments; short words must be equal.
    """
    a = typed.distinct().mapInPandas(_typed_keys, "token string, dot boolean, key string")
    b = words.groupBy("word").agg(F.bool_or("longer").alias("longer")).mapInPandas(_vocabulary_keys, "word string, longer boolean, key string")
    pairs = a.join(b, "key").select("token", "dot", "word", "longer").distinct()
    return pairs.mapInPandas(_similarity, "token string, dot boolean, word string, sim double, edits int")


def _resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts, ids = [], []
        for text, found in zip(pdf["text"], pdf["found"], strict=True):
            for i in choose(text, list(found)):
                texts.append(text)
                ids.append(i)
        yield pd.DataFrame({"text": texts, "entry_id": pd.Series(ids, dtype="int64")})


def choose(text: str, found: list[dict]) -> list[int]:
    """Entries of one value: best names first, no two on the same tokens; entries of equal names by the words around."""
    ts = tokens(text)
    spans: dict[tuple[int, int], list[dict]] = {}
    for f in found:
        a, b = f["start"], f["start"] + f["n"]
        if a < 0 or b > len(ts):
            continue
        if any(ts[i][2] and ts[i][0] not in ("and", "&") and ts[i - 1][0] != "and" for i in range(a + 1, b)):
            continue  # a name doesn't run across values
        spans.setdefault((a, b), []).append(f)
    order = sorted(spans, key=lambda s: (-max(f["score"] * f["weight"] for f in spans[s]), s))
    taken: list[tuple[int, int]] = []
    for s in order:
        if all(s[1] <= t[0] or s[0] >= t[1] for t in taken):
            taken.append(s)
    out = []
    for a, b in sorted(taken):
        after = min([t[0] for t in taken if t[0] >= b], default=len(ts))
        stop = next((i for i in range(b, after) if ts[i][2]), after)
        before = [ts[a - 1][0]] if a > 0 and not ts[a][2] and not any(t[1] == a for t in taken) else []
        around = " " + " ".join([*before, *(t[0] for t in ts[b:stop])]) + " "
        beside = [w for w in around.split() if w not in _ASIDE and not w.isdigit()]
        best = max(f["score"] for f in spans[a, b])
        if best < 0.84 and beside and not any(_context(f, around) for f in spans[a, b]):
            continue  # spelt too differently for a place that the words around put elsewhere
        near = [f for f in spans[a, b] if f["score"] >= best - 0.15]
        # a lone code that tells the region or country of the place before it names no place of its own
        if b - a == 1 and len(ts[a][0]) <= 3 and a > 0 and not ts[a][2] and any(t[1] <= a for t in taken):
            prev = max(t for t in taken if t[1] <= a)
            if prev[1] == a and any(ts[a][0] in (fold(f["region_code"] or ""), *COUNTRY_WORDS.get(f["country"] or "", ())) for f in spans[prev]):
                continue
        out.append(max(near, key=lambda f: (_context(f, around), f["score"], -f["entry_id"]))["entry_id"])
    return list(dict.fromkeys(out))


def _context(f: dict, around: str) -> float:
    says = lambda w: bool(w) and f" {' '.join(t for t, _, _ in tokens(w))} " in around
    score = 3.0 * says(f["region"]) + 2.0 * says(f["country_name"]) + 1.5 * says(f["region_code"])
    return score + 1.0 * (says(f["country"]) or any(says(w) for w in COUNTRY_WORDS.get(f["country"] or "", ())))


def map_values(values: DataFrame, entries: DataFrame, least: float = 0.62) -> DataFrame:
    """``text, entry_id`` for every distinct non-blank ``text``: the entries that it names, or -1 in one row if it names none.

    ``entries``: ``entry_id bigint, names array<string>, region, region_code, country, country_name``. ``least``: soft TF-IDF that a name needs.
    NULL and blank texts give no rows; with no entries every text gives -1; ties go to the entry with the most context, then the smallest id.
    """
    texts = written(values.select("text").where("text IS NOT NULL AND trim(text) <> ''").distinct())
    ref = entries.dropDuplicates(["entry_id"])
    names = ref.select("entry_id", F.explode(F.array_distinct("names")).alias("name")).where("name IS NOT NULL")
    names = written(names.mapInPandas(_name_rows, "entry_id bigint, name string, n int, idx int, word string"))
    n_names = names.select("name").distinct().count()
    df = names.select("name", "word").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    idf = df.select("word", F.log(1 + F.lit(float(n_names)) / F.col("df")).alias("idf"))
    names = names.join(idf, "word")
    # rarest words first: those up to which the rest of the name weighs too little for ``least`` anchor it
    by_rarity = Window.partitionBy("entry_id", "name").orderBy(F.desc("idf"), "idx")
    names = names.withColumn("weight", F.sum("idf").over(Window.partitionBy("entry_id", "name"))).withColumn("_w", F.sum("idf").over(by_rarity.rowsBetween(Window.unboundedPreceding, 0)))
    names = written(names.withColumn("anchor", F.col("_w") - F.col("idf") <= F.col("weight") * (1 - least) + 1e-9).drop("_w"))
    toks = texts.mapInPandas(_token_rows, "text string, pos int, token string, dot boolean, prev string")
    # a name of one word after the first word of several longer names, such as New or Old, is another place
    first = names.where("idx = 0 AND n > 1").select("name", "word").distinct().groupBy("word").count().where("count > 1").select(F.col("word").alias("prev"), F.lit(True).alias("qualified"))
    fixed = repair_tokens(toks.select("token", "dot"), names.select("word", (F.col("n") > 1).alias("longer")))
    read = written(toks.join(first, "prev", "left").join(fixed, ["token", "dot"]).select("text", "pos", "word", "sim", "edits", F.coalesce("qualified", F.lit(False)).alias("qualified")))
    size = F.length("word")
    own = (F.col("n") > 1) | (~F.col("qualified") & (F.col("edits") <= F.when(size < 5, 0).when(size < 8, 1).otherwise(2)))
    cand = read.join(names.where("anchor").select("entry_id", "name", "n", "idx", "word"), "word").where(own)
    cand = cand.select("text", "entry_id", "name", (F.col("pos") - F.col("idx")).alias("start")).distinct()
    wanted = cand.join(names.select("entry_id", "name", "n", "idx", "word", "idf", "weight"), ["entry_id", "name"]).withColumn("pos", F.col("start") + F.col("idx"))
    votes = wanted.join(read, ["text", "pos", "word"])
    votes = votes.groupBy("text", "entry_id", "name", "n", "start", "weight").agg(F.sum(F.col("idf") * F.col("sim")).alias("s"), F.sum("edits").alias("edits"))
    votes = votes.where("edits <= 2").withColumn("score", F.col("s") / F.col("weight")).where(F.col("score") >= least)
    votes = votes.join(ref.drop("names"), "entry_id")
    found = F.collect_list(F.struct("entry_id", "start", "n", "score", "weight", "region", "region_code", "country", "country_name"))
    chosen = written(votes.groupBy("text").agg(found.alias("found")).mapInPandas(_resolve, "text string, entry_id bigint"))
    none = texts.join(chosen.select("text").distinct(), "text", "left_anti")
    return chosen.union(none.select("text", F.lit(-1).cast("bigint")))
