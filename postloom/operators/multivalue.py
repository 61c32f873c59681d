"""Several values packed in one field: one row per value with its position (problem 5).

A text is cut at marks that always separate (line breaks, semicolons, bars, slashes, bullets, list numbers, "or").
Commas and "and" may separate values or belong to one ("City, Region"; "A and B" as a name): there, every way to
group the atoms is a path of a lattice, in which an atom starts a value, follows as a part of one, or is the second half of a name with "and".
Expectation-maximisation learns over the distinct texts of the whole column how often an atom starts a value and how often it follows; the
Viterbi path of each lattice gives the values, of any number of parts, in time linear in the atoms. Quoted spans are single atoms whatever they hold.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.operators.lineage import written

_QUOTES = {'"': '"', "“": "”", "'": "'", "‘": "’", "«": "»", "「": "」"}
_STRONG = re.compile(
    r"\s*(?:\r\n|[\n\t;|•·‣▪、；]|<br\s*/?>|//|(?<=\S\S)/(?=\s*\S\S)|(?<=\s)/(?=\s)|(?<=\s)\+(?=\s)|(?:^|(?<=\s))\d{1,2}[.)](?=\s)"
    r"|,\s*(?:and|or|&)\b(?=\s)|(?<=\s)(?:or|oder|OR)(?=\s))\s*",
    re.I,
)
_WEAK = re.compile(r"\s*,\s*|\s+(?:and|und|&|y)\s+", re.I)
_SKIP = re.compile(r"^\W*$")
_CLOSE = re.compile(r"\s*(?:$|[\n\t;|•·,/\]}]|<br|\+|&|(?:and|or)\s)", re.I)


def _spans(text: str) -> list[tuple[int, int, bool]]:
    """Quoted spans and the stretches between them: start, end, quoted."""
    out, i, start = [], 0, 0
    fresh = True
    n = len(text)
    while i < n:
        c = text[i]
        if fresh and c in _QUOTES:
            j = text.find(_QUOTES[c], i + 1)
            while j > 0 and not _CLOSE.match(text, j + 1):
                j = text.find(_QUOTES[c], j + 1)
            if j > 0:
                if i > start:
                    out.append((start, i, False))
                out.append((i + 1, j, True))
                i = start = j + 1
                fresh = False
                continue
        if not c.isspace():
            fresh = c in ",;|/•·\n\t[{>&+)"
        i += 1
    if start < n:
        out.append((start, n, False))
    return out


Atom = tuple[str, str, int, int]


def _bare(text: str) -> str:
    """The text without white space and the brackets of a list around it."""
    s = text.strip()
    while len(s) > 1 and (s[0], s[-1]) in {("[", "]"), ("{", "}")}:
        s = s[1:-1].strip()
    return s


def atoms(text: str) -> list[list[Atom]]:
    """Groups of atoms: the weak mark before it (``','``, ``'&'`` or ``''`` for the first), the atom, and its place in ``_bare(text)``."""
    s = _bare(text)
    groups: list[list[Atom]] = [[]]
    for a, b, quoted in _spans(s):
        if quoted:
            groups += [[("", s[a:b].strip(), a, b)], []]
            continue
        at = a
        cuts = [(m.start(), m.end()) for m in _STRONG.finditer(s, a, b) if m.end() > m.start()] + [(b, b)]
        for i, (x, y) in enumerate(cuts):
            if i:
                groups.append([])
            piece_at, mark = at, ""
            for m in [*_WEAK.finditer(s, at, x), None]:
                e = m.start() if m else x
                value = s[piece_at:e].strip()
                if value and not _SKIP.match(value):
                    groups[-1].append((mark if groups[-1] else "", value, piece_at, e))
                if m:
                    piece_at, mark = m.end(), "," if "," in m.group() else "&"
            at = y
    return [g for g in groups if g]


def key(atom: str) -> str:
    """Lower case, single spaces, no full stop at the end; numbers (postal codes) are all alike."""
    k = " ".join(atom.lower().split()).rstrip(" .")
    return k if any(c.isalpha() for c in k) else re.sub(r"\d", "0", k)


def shape(k: str) -> str:
    """Class of an unseen atom."""
    return "n" if any(c.isdigit() for c in k) else "c" if len(k.replace(".", "")) <= 3 else "w"


def _near(a: str, b: str) -> bool:
    """At most one insertion, deletion, substitution or transposition."""
    if a == b:
        return True
    la, lb = len(a), len(b)
    if abs(la - lb) > 1:
        return False
    i = 0
    while i < min(la, lb) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


class Model:
    """Scores of atoms as the start (head) or a later part (tail) of a value, from counts over the whole column."""

    def __init__(self, totals: dict[str, float]):
        self.t = totals
        h, t = max(totals.get("h", 1.0), 1e-9), max(totals.get("t", 1.0), 1e-9)
        self.go = math.log(t / (h + t))
        self.stop = math.log(h / (h + t))
        self.more = math.log(max(1e-3, 1 - totals.get("groups", 1.0) / h))

    def head(self, k: str, counts: dict[str, tuple[float, float]]) -> float:
        s = shape(k)
        c = max(0.0, counts.get(k, (0.0, 0.0))[0] - 1) + (self.t.get("h1" + s, 0.0) + 0.5) / (self.t.get("v1" + s, 0.0) + 1)
        return math.log(c / (self.t.get("h", 1.0) + 1))

    def tail(self, k: str, counts: dict[str, tuple[float, float]]) -> float:
        s = shape(k)
        c = max(0.0, counts.get(k, (0.0, 0.0))[1] - 1) + (self.t.get("t1" + s, 0.0) + 0.5) / (self.t.get("v1" + s, 0.0) + 1)
        return math.log(c / (self.t.get("t", 1.0) + 1))

    def joined(self, k: str, counts: dict[str, tuple[float, float]], whole: frozenset[str]) -> float | None:
        """Score of "a & b" as one head: only where it holds a known name or is seen in at least two texts."""
        if k in whole:
            return 0.0
        c = counts.get(k, (0.0, 0.0))[0] - 1
        return math.log(c / (self.t.get("h", 1.0) + 1)) if c > 0 else None

    def arcs(self, group: list[Atom], counts: dict[str, tuple[float, float]], whole: frozenset[str]) -> list[list[tuple[int, float, str, int]]]:
        """For each place after an atom, the arcs that end there: (place before, log score, key, role); role 0 starts a value, 1 goes on with one."""
        ks = [key(a[1]) for a in group]
        new = self.stop + self.more
        out: list[list[tuple[int, float, str, int]]] = [[] for _ in range(len(ks) + 1)]
        for i, k in enumerate(ks):
            out[i + 1].append((i, self.head(k, counts) + new, k, 0))
            if i and group[i][0] == ",":
                out[i + 1].append((i, self.go + self.tail(k, counts), k, 1))
            if i and group[i][0] == "&" and (j := self.joined(both := f"{ks[i - 1]} & {k}", counts, whole)) is not None:
                out[i + 1].append((i - 1, j + new, both, 0))
        return out

    def best(self, group: list[Atom], counts: dict[str, tuple[float, float]], whole: frozenset[str] = frozenset()) -> list[tuple[int, int]]:
        """Viterbi path: the values as ranges of atoms. Of equal paths the one that starts a value wins."""
        n = len(group)
        score, back = [0.0] + [-math.inf] * n, [(0, 0)] * (n + 1)
        for e, arcs in enumerate(self.arcs(group, counts, whole)):
            for i, s, _, role in arcs:
                if score[i] + s > score[e]:
                    score[e], back[e] = score[i] + s, (i, role)
        out, e, end = [], n, n
        while e:
            i, role = back[e]
            if role == 0:
                out.append((i, end))
                end = i
            e = i
        return out[::-1]

    def expected(self, group: list[Atom], counts: dict[str, tuple[float, float]], whole: frozenset[str], add: dict[tuple[str, int], float]) -> None:
        """Forward-backward: adds the posterior count of every key and role."""
        n = len(group)
        ends = self.arcs(group, counts, whole)
        fw, bw = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
        for e, arcs in enumerate(ends):
            for i, s, _, _ in arcs:
                fw[e] = _logadd(fw[e], fw[i] + s)
        for e in range(n, 0, -1):
            for i, s, _, _ in ends[e]:
                bw[i] = _logadd(bw[i], bw[e] + s)
        for e, arcs in enumerate(ends):
            for i, s, k, role in arcs:
                add[k, role] += math.exp(fw[i] + s + bw[e] - fw[n])


def _logadd(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def _first_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts before the first round: lone atoms start a value, others are either with equal weight."""
    for pdf in batches:
        h: dict[str, float] = defaultdict(float)
        t: dict[str, float] = defaultdict(float)
        for text in pdf["text"]:
            for g in atoms(text):
                for i, (mark, a, _, _) in enumerate(g):
                    k = key(a)
                    if i == 0:
                        h[k] += 1.0
                    else:
                        h[k] += 0.5
                        t[k] += 0.5 if mark == "," else 0.0
                        if mark == "&":
                            h[f"{key(g[i - 1][1])} & {k}"] += 0.5
        ks = [*h, *(k for k in t if k not in h)]
        yield pd.DataFrame({"key": ks, "h": [h.get(k, 0.0) for k in ks], "t": [t.get(k, 0.0) for k in ks]})


def _keys_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts, ks = [], []
        for text in pdf["text"]:
            own: set[str] = set()
            for g in atoms(text):
                if len(g) > 1:
                    own.update(key(a[1]) for a in g)
                    own.update(f"{key(g[i - 1][1])} & {key(a[1])}" for i, a in enumerate(g) if a[0] == "&")
            texts += [text] * len(own)
            ks += sorted(own)
        yield pd.DataFrame({"text": texts, "key": ks})


def _counts_of(row) -> dict[str, tuple[float, float]]:
    return {} if row is None else {x["key"]: (x["h"], x["t"]) for x in row}


def _totals(counts: DataFrame, groups: float) -> dict[str, float]:
    """A few sums over the counts (nine rows at most reach the driver)."""
    s = F.when(F.col("key").rlike(r"\d"), "n").when(F.length(F.regexp_replace("key", r"\.", "")) <= 3, "c").otherwise("w")
    rare = (F.col("h") + F.col("t")) <= 1.5
    rows = (
        counts.groupBy(s.alias("s"))
        .agg(
            F.sum("h").alias("h"),
            F.sum("t").alias("t"),
            F.sum(F.when(rare, F.col("h"))).alias("h1"),
            F.sum(F.when(rare, F.col("t"))).alias("t1"),
            F.sum(F.when(rare, 1.0)).alias("v1"),
        )
        .collect()
    )
    out = {"groups": groups, "h": sum(r["h"] for r in rows), "t": sum(r["t"] for r in rows)}
    for r in rows:
        out |= {k + r["s"]: r[k] or 0.0 for k in ("h1", "t1", "v1")}
    return out


def _shorter(text: str) -> set[str]:
    """The text and what is left of it without any one character: two texts one edit or transposition apart share one of these."""
    return {text, *(text[:i] + text[i + 1 :] for i in range(len(text)))}


def _name_probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for n in pdf["name"]:
            halves = re.split(r"\s+(?:and|&)\s+", n, maxsplit=1, flags=re.I)
            if len(halves) == 2 and all(h.strip() for h in halves):
                x, y = (key(h) for h in halves)
                rows += [(x, y, p) for p in _shorter(x)]
        yield pd.DataFrame(rows, columns=["x", "y", "probe"])


def _left(k: str) -> list[str]:
    return re.split(r"[\s:-]+", k.split(" & ", 1)[0])


def _pair_probes(lengths: list[int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, p) for k in pdf["key"] for n in lengths if n <= len(_left(k)) for p in _shorter(" ".join(_left(k)[-n:]))]
            yield pd.DataFrame(rows, columns=["key", "probe"])

    return run


def _is_whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ok = []
        for k, x, y in zip(pdf["key"], pdf["x"], pdf["y"], strict=True):
            right = k.split(" & ", 1)[1].split()
            ok.append(_near(" ".join(_left(k)[-len(x.split()) :]), x) and _near(" ".join(right[: len(y.split())]), y))
        yield pdf.loc[ok, ["key"]]


def whole_names(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """``key`` of the pairs "a & b" (``key``) that hold a known name with "and" or "&", also with a typing error in each half.

    An equi-join on the first halves and what is left of them without a character, verified on both halves: the names may be any number.
    """
    idx = written(names.select("name").where("name IS NOT NULL").distinct().mapInPandas(_name_probes, "x string, y string, probe string"))
    lengths = [r["n"] for r in idx.select(F.size(F.split("x", " ")).alias("n")).distinct().collect()]  # as many rows as there are lengths
    hits = pairs.mapInPandas(_pair_probes(sorted(lengths)), "key string, probe string").join(idx, "probe").select("key", "x", "y").distinct()
    return hits.mapInPandas(_is_whole, "key string").distinct()


def learn_and_split(texts: DataFrame, names: DataFrame | None = None, rounds: int = 3) -> DataFrame:
    """``text, pieces`` for every distinct non-blank ``text`` of ``texts``: its values as written, in order.

    ``names``: a table with a column ``name``; names that hold "and" or "&" stay whole, also with a typing error (without them
    such names are kept only if the column itself shows them often enough). Each distinct text counts once, so repeated
    rows don't shift the frequencies. Texts of marks only have an empty array; of equally likely values the shorter first one wins.
    """
    texts = written(texts.select("text").where("text IS NOT NULL AND trim(text) <> ''").distinct())
    keys = texts.mapInPandas(_keys_of, "text string, key string")
    counts = written(texts.mapInPandas(_first_counts, "key string, h double, t double").groupBy("key").agg(F.sum("h").alias("h"), F.sum("t").alias("t")))
    groups = float(texts.count())
    if names is not None:
        pairs = keys.where(F.col("key").contains(" & "))
        whole = whole_names(pairs.select("key").distinct(), names)
        whole = pairs.join(whole, "key").groupBy("text").agg(F.collect_list("key").alias("whole"))
        texts = written(texts.join(whole, "text", "left"))
    else:
        texts = texts.withColumn("whole", F.lit(None).cast("array<string>"))
    joined = lambda c: (
        texts.join(
            keys.join(c, "key").groupBy("text").agg(F.collect_list(F.struct("key", "h", "t")).alias("counts")), "text", "left"
        )
    )
    for _ in range(rounds):
        model = Model(_totals(counts, groups))

        def step(batches: Iterator[pd.DataFrame], model: Model = model) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                add: dict[tuple[str, int], float] = defaultdict(float)
                for text, row, whole in zip(pdf["text"], pdf["counts"], pdf["whole"], strict=True):
                    c, w = _counts_of(row), frozenset(() if whole is None else whole)
                    for g in atoms(text):
                        if len(g) == 1:
                            add[key(g[0][1]), 0] += 1.0
                        else:
                            model.expected(g, c, w, add)
                ks = list(dict.fromkeys(k for k, _ in add))
                yield pd.DataFrame({"key": ks, "h": [add.get((k, 0), 0.0) for k in ks], "t": [add.get((k, 1), 0.0) for k in ks]})

        counts = written(joined(counts).mapInPandas(step, "key string, h double, t double").groupBy("key").agg(F.sum("h").alias("h"), F.sum("t").alias("t")))
    model = Model(_totals(counts, groups))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = zip(pdf["text"], pdf["counts"], pdf["whole"], strict=True)
            yield pd.DataFrame({"text": pdf["text"], "pieces": [split_text(t, model, _counts_of(r), frozenset(() if w is None else w)) for t, r, w in rows]})

    return joined(counts).mapInPandas(decode, "text string, pieces array<string>")


def split_text(text: str, model: Model, counts: dict[str, tuple[float, float]], whole: frozenset[str] = frozenset()) -> list[str]:
    """Values of one text, as written."""
    s = _bare(text)
    out = []
    for g in atoms(text):
        for a, b in model.best(g, counts, whole) if len(g) > 1 else [(0, 1)]:
            out.append(s[g[a][2] : g[b - 1][3]].strip())
    return out


def explode_values(df: DataFrame, id_cols: list[str], field: str, pieces: DataFrame, array: bool = False, least: int = 2) -> DataFrame:
    """``id_cols, pos, piece``: a row for each value of ``field``, with positions from 0, for fields of ``least`` values or more.

    ``field`` is a string or, with ``array``, an array of strings whose elements may hold several values each; positions run over the
    whole array. NULL and blank fields and elements give no rows. Rows with the same ids are one field each only if
    the ids are unique; repeated rows give repeated results.
    """
    x = df.select(*id_cols, F.posexplode(field).alias("_e", "text")) if array else df.select(*id_cols, F.lit(0).alias("_e"), F.col(field).alias("text"))
    x = x.where("text IS NOT NULL AND trim(text) <> ''").join(pieces, "text")
    if not array:
        return x.where(F.size("pieces") >= least).select(*id_cols, F.posexplode("pieces").alias("pos", "piece"))
    # elements of one record meet in one small group, in the order of the array
    x = x.groupBy(*id_cols).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_e", "pieces"))), lambda s: s["pieces"])).alias("pieces"))
    return x.where(F.size("pieces") >= least).select(*id_cols, F.posexplode("pieces").alias("pos", "piece"))
