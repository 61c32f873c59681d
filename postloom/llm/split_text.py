"""Splitting oversized items at natural boundaries (problem 9).

A text is its tokens. Atomic segments lie between natural boundaries (paragraphs, lines, sentences, clauses, words); adjacent segments wait in a heap and
the weakest boundary is merged first, as long as the merged size plus the overlap fits. What is left are the cores of the pieces; each
piece but the first starts ``overlap`` tokens before its core. A run of tokens without a boundary is cut between characters.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.tokenizer import VOCABULARY, load

#: Boundaries by strength: the cut is at the end of the match.
_BOUNDARIES = [
    (6, regex.compile(r"\n[ \t\r]*\n\s*")),
    (5, regex.compile(r"\n+")),
    (4, regex.compile(r"[.!?…][\"'”’)\]]*(?=\s)|[。！？][」』）]*")),
    (3, regex.compile(r"[,;:–—](?=\s)|[、，；：]")),
    (2, regex.compile(r"(?<=\S)(?=[^\S\n])")),
]
HARD = 0


def boundaries(text: str) -> dict[int, int]:
    """Character offset of each natural boundary with its strength."""
    out: dict[int, int] = {}
    for strength, p in reversed(_BOUNDARIES):
        for m in p.finditer(text):
            if 0 < m.end() < len(text):
                out[m.end()] = strength
    return out


def cores(sizes: list[int], strengths: list[int], most: int) -> list[tuple[int, int]]:
    """Agglomerative merging of segments of ``sizes``; ``strengths[i]`` is the boundary before segment i + 1. Ranges of segments."""
    n = len(sizes)
    size, right, left, alive = list(sizes), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    end = list(range(1, n + 1))
    heap = [(strengths[i], sizes[i] + sizes[i + 1], i, i + 1) for i in range(n - 1) if sizes[i] + sizes[i + 1] <= most]
    heapq.heapify(heap)
    while heap:
        s, total, i, j = heapq.heappop(heap)
        if not alive[i] or j >= n or not alive[j] or right[i] != j or size[i] + size[j] != total:
            continue
        size[i], alive[j], end[i], right[i] = total, False, end[j], right[j]
        if right[i] < n:
            left[right[i]] = i
            if total + size[right[i]] <= most:
                heapq.heappush(heap, (strengths[right[i] - 1], total + size[right[i]], i, right[i]))
        if left[i] >= 0 and size[left[i]] + total <= most:
            heapq.heappush(heap, (strengths[i - 1], size[left[i]] + total, left[i], i))
    return [(i, end[i]) for i in range(n) if alive[i]]


def pieces(text: str, most: int, overlap: int, enc, token_bytes: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(start, core start, end, tokens) in characters for a text of more than ``most`` tokens; [] for a shorter one."""
    if most < 1 or len(text) <= most and len(text.encode("utf-8", "replace")) <= most:
        return []
    ids = enc.encode_ordinary(text)
    n = len(ids)
    if n <= most:
        return []
    overlap = max(0, min(overlap, most - 1))
    byte_end = np.concatenate([[0], np.cumsum(token_bytes[np.asarray(ids)])])  # byte offset of each token boundary
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    lead = (raw & 0xC0) != 0x80
    chars_before = np.concatenate([[0], np.cumsum(lead)])
    start_ok = np.append(lead, True)[byte_end]  # token boundaries that are character boundaries
    at_char = chars_before[byte_end]
    room = most - overlap
    # natural boundaries at token boundaries
    tokens_at = np.flatnonzero(start_ok)
    chars_at = at_char[tokens_at]
    found = boundaries(text)
    strength = np.array([found.get(int(c), -1) for c in chars_at]) if len(found) < 64 else _lookup(chars_at, found)
    inner = (tokens_at > 0) & (tokens_at < n)
    marks = [0]
    strengths: list[int] = []
    keep = inner & (strength >= 4)

    def add(to: int, s: int) -> None:
        """A segment up to token ``to``; one that doesn't fit is cut at weaker boundaries, then between characters."""
        frm = marks[-1]
        if to - frm <= room:
            marks.append(to)
            strengths.append(s)
            return
        lo, hi = np.searchsorted(tokens_at, frm, "right"), np.searchsorted(tokens_at, to)
        weak = [(int(tokens_at[i]), int(strength[i])) for i in range(lo, hi) if strength[i] in (2, 3)]
        for t, w in [*weak, (to, s)]:
            while t - marks[-1] > room:
                a, b = np.searchsorted(tokens_at, marks[-1], "right"), np.searchsorted(tokens_at, marks[-1] + room, "right")
                cut = int(tokens_at[b - 1]) if b > a else int(tokens_at[min(a, len(tokens_at) - 1)])
                if cut >= t:
                    break
                marks.append(cut)
                strengths.append(HARD)
            marks.append(t)
            strengths.append(w)

    for t, s in zip(tokens_at[keep].tolist(), strength[keep].tolist(), strict=True):
        add(t, s)
    add(n, 9)
    sizes = np.diff(marks).tolist()
    out = []
    for a, b in cores(sizes, strengths[:-1], room):
        c, e = marks[a], marks[b]
        s = max(0, c - overlap) if c else 0
        while s < c and not start_ok[s]:
            s += 1
        out.append((int(at_char[s]), int(at_char[c]), int(at_char[e]), e - s))
    return out


def _lookup(chars: np.ndarray, found: dict[int, int]) -> np.ndarray:
    keys = np.fromiter(found, dtype=np.int64, count=len(found))
    vals = np.fromiter(found.values(), dtype=np.int64, count=len(found))
    order = np.argsort(keys)
    keys, vals = keys[order], vals[order]
    i = np.minimum(np.searchsorted(keys, chars), len(keys) - 1)
    return np.where(keys[i] == chars, vals[i], -1)


def _splitter(path: str, with_text: bool):
    names = ["id", "piece_no", "start_char", "core_start", "end_char", "n_tokens", "piece"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, size = load(path)
        for b in batches:
            ids, texts, most, over = (b.column(i).to_pylist() for i in range(4))
            rows: list[tuple] = []
            chars = 0

            def batch(rows: list[tuple]) -> pa.RecordBatch:
                cols = list(zip(*rows, strict=True)) if rows else [()] * 7
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

            for i, t, m, o in zip(ids, texts, most, over, strict=True):
                for no, (s, c, e, k) in enumerate(pieces(t, m, o, enc, size) if t else []):
                    rows.append((i, no, s, c, e, k, t[s:e] if with_text else None))
                    chars += e - s
                if chars > 1 << 22:
                    yield batch(rows)
                    rows, chars = [], 0
            yield batch(rows)

    return run


def split_oversized(docs: DataFrame, id_col: str, text: str, lang: str, limits: DataFrame, vocabulary: str = VOCABULARY, fallback: str = "und") -> DataFrame:
    """``id, piece_no, start_char, core_start, end_char, n_tokens, piece`` for every text longer than the limit of its language.

    ``limits``: ``lang, max_tokens, overlap_tokens``; NULL and unlisted languages count as ``fallback``. Pieces are in order and cover the text; a piece is
    text[start_char:end_char] and repeats text[start_char:core_start] of the one before: ``overlap_tokens`` tokens, a few less where
    that would cut a character. ``n_tokens`` never exceeds ``max_tokens`` (a single character of more tokens is the exception). Texts within
    the limit, NULL and empty ones have no rows. Each text is one row of one task: no shuffle but the join with the limits.
    """
    lim = limits.select(F.col("lang").alias("_l"), F.col("max_tokens").cast("int").alias("_m"), F.col("overlap_tokens").cast("int").alias("_o")).dropDuplicates(["_l"])
    x = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text"), F.coalesce(lang, F.lit(fallback)).alias("_lang"))
    x = x.join(lim, F.col("_lang") == F.col("_l"), "left")
    rest = lim.where(F.col("_l") == fallback).first()
    most, over = (F.lit(rest[c] if rest else None).cast("int") for c in ("_m", "_o"))
    x = x.select("id", "text", F.coalesce("_m", most).alias("m"), F.coalesce("_o", over, F.lit(0)).alias("o")).where("text <> '' AND m IS NOT NULL AND octet_length(text) > m")
    schema = "id bigint, piece_no int, start_char bigint, core_start bigint, end_char bigint, n_tokens int, piece string"
    return x.mapInArrow(_splitter(vocabulary, True), schema)
