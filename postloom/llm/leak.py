"""Evaluation texts leaking into a corpus (problem 7).

Windows of the items and of the documents are sequences of words. The CGK random walk reads a window and writes each word once or several
times, the choice drawn from a hash of the step and the word: windows a few edits apart agree in most places of the
written sequence, equal windows in all. A key of a few sampled places is looked up among the keys of the items'
windows; independent repetitions (other walks, other places) reach the recall wanted. A hit is verified exactly, by edit distance on
words or, for unedited passages, by comparing the words themselves.

The items are the stated query set: their index is built in blocks of bounded size and goes to the tasks with the function; the corpus is
read once per block and nothing of it is shuffled.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.wordhash import mix, text_chunks, word_hashes

_TAG = re.compile(r"<[A-Za-z/!?][^>]*>")
_WORD = re.compile(r"[a-z0-9]+")
_PAD = np.uint64(0x7F4A7C159E3779B9)


def plain(text: str | None) -> str:
    """Tags replaced by spaces, then entities decoded."""
    t = text or ""
    if "<" in t:
        t = _TAG.sub(" ", t)
    return html.unescape(t) if "&" in t else t


class Walk:
    """One random walk over windows of ``width`` words, and ``samples`` sets of places of what it writes."""

    def __init__(self, seed: int, width: int, places: int, samples: int = 1):
        rng = np.random.default_rng(seed)
        self.seed, self.width = np.uint64(rng.integers(1, 1 << 63)), width
        self.steps = [set(rng.choice(2 * width, size=min(places, 2 * width), replace=False).tolist()) for _ in range(samples)]

    def keys(self, h: np.ndarray, last: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """For each sample the key of the window that starts at each place of ``at``; ``last`` is the end of its window or of its text."""
        bits = mix(h ^ self.seed)  # bit j of a word: whether the walk moves on from it at step j
        i = at.copy()
        keys = [np.full(len(at), self.seed + np.uint64(n), dtype=np.uint64) for n in range(len(self.steps))]
        top = len(h) - 1
        for j in range(max(map(max, self.steps)) + 1):
            c = np.minimum(i, top)
            using = [n for n, s in enumerate(self.steps) if j in s]
            if using:
                word = np.where(i < last, h[c], _PAD)
                for n in using:
                    keys[n] = (keys[n] ^ word) * np.uint64(0x9FB21C651E98DF25)
            i += ((bits[c] >> np.uint64(j % 64)) & np.uint64(1)).view(np.int64)
        return [mix(k) for k in keys]


class ItemIndex:
    """Keys of all windows of a block of items, per sample of each walk, sorted, with a bitmap in front."""

    def __init__(self, items: list[tuple[int, str]], width: int, walks: int, places: int, samples: int = 1):
        self.width = width
        self.walks = [Walk(101 + r, width, places, samples) for r in range(walks)]
        self.ids = [i for i, _ in items]
        self.words = [_WORD.findall(t.lower()) for _, t in items]
        h, off = word_hashes([" ".join(w) for w in self.words])
        at = np.concatenate([np.arange(a, max(a + 1, b - width + 1)) for a, b in zip(off, off[1:], strict=False) if b > a] or [np.zeros(0, np.int64)])
        self.hash, self.offsets = h, off
        self.index = []
        for w in self.walks:
            ends = np.minimum(at + width, off[np.searchsorted(off, at, "right")]) if len(at) else at
            for key in w.keys(h, ends, at) if len(at) else [np.zeros(0, np.uint64)] * samples:
                order = np.argsort(key, kind="stable")
                bitmap = np.zeros(1 << 22, dtype=bool)
                bitmap[key >> np.uint64(42)] = True
                self.index.append((key[order], at[order], bitmap))

    def hits(self, h: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Distinct (start in the documents, start in the items) whose windows share a key in some walk."""
        lens = np.diff(off)
        at = np.flatnonzero(np.repeat(off[1:], lens) - np.arange(len(h)) >= self.width) if len(h) else np.zeros(0, np.int64)
        out = []
        if not len(self.hash) or not len(at):
            return np.zeros((0, 2), np.int64)
        computed = (k for w in self.walks for k in w.keys(h, at + self.width, at))
        for k, (keys, starts, bitmap) in zip(computed, self.index, strict=True):
            some = np.flatnonzero(bitmap[k >> np.uint64(42)])
            lo, hi = np.searchsorted(keys, k[some], "left"), np.searchsorted(keys, k[some], "right")
            n = hi - lo
            src = np.repeat(np.arange(len(some)), n)
            pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            out.append(at[some][src] * len(self.hash) + starts[pos])
        x = np.sort(np.concatenate(out))
        x = x[np.append(True, x[1:] != x[:-1])] if len(x) else x
        return np.stack(np.divmod(x, max(len(self.hash), 1)), axis=1)


def edits_within(a: list, b: list, most: int) -> bool:
    """Whether the edit distance of two word sequences is at most ``most`` (banded)."""
    if abs(len(a) - len(b)) > most:
        return False
    prev = {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        cur = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            best = i if j == 0 else prev.get(j - 1, most + 1) + (x != b[j - 1])
            cur[j] = min(best, prev.get(j, most + 1) + 1, cur.get(j - 1, most + 1) + 1)
        if min(cur.values()) > most:
            return False
        prev = cur
    return prev.get(len(b), most + 1) <= most


def prefix_within(text: list, y: list, most: int) -> bool:
    """Whether some prefix of ``text`` is within edit distance ``most`` of ``y`` (one banded table for all prefixes)."""
    far = most + 1
    row = [abs(d - most) if d >= most else far for d in range(2 * most + 1)]  # row[d]: distance of y[:i] and text[: i + d - most]
    for i, c in enumerate(y, 1):
        new = [far] * (2 * most + 1)
        for d in range(2 * most + 1):
            j = i + d - most
            if j < 0 or j > len(text):
                continue
            best = row[d + 1] + 1 if d < 2 * most else far
            if j:
                best = min(best, row[d] + (text[j - 1] != c))
                if d:
                    best = min(best, new[d - 1] + 1)
            new[d] = best
        if min(new) > most:
            return False
        row = new
    return min(row) <= most


def _scan(index: ItemIndex, max_edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = index.width
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            docs, items = [], []
            for a, b in text_chunks([len(t or "") for t in texts]):
                plains = [plain(t) for t in texts[a:b]]
                h, off = word_hashes(plains)
                hits = index.hits(h, off)
                words: dict[int, list[str]] = {}
                seen: set[tuple[int, int]] = set()
                for at, start in hits.tolist():
                    d, it = int(np.searchsorted(off, at, "right")) - 1, int(np.searchsorted(index.offsets, start, "right")) - 1
                    if (d, it) in seen:
                        continue
                    if d not in words:
                        words[d] = _WORD.findall(plains[d].lower())
                    x = words[d][at - off[d] : at - off[d] + width]
                    s = start - index.offsets[it]
                    y = index.words[it][s : s + width]
                    if x == y and len(y) == width or max_edits and prefix_within(words[d][at - off[d] : at - off[d] + width + max_edits], y, max_edits):
                        seen.add((d, it))
                        docs.append(ids[a + d])
                        items.append(index.ids[it])
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(items, pa.int64())], ["doc_id", "item_id"])

    return run


def leaked_items(
    docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, body: str, width: int = 12, max_edits: int = 0, walks: int = 1, places: int = 8, samples: int = 1, block: int = 20_000
) -> DataFrame:
    """``doc_id, item_id`` (bigint): the document holds ``width`` consecutive words of the item with at most ``max_edits`` word edits.

    Unedited passages have equal walks, so one repetition finds them all. For ``max_edits > 0`` the recall grows with ``walks``: of passages of 24 words
    with three mixed edits, 3 walks with one sample of 5 places find 0.56, 16 find 0.98; 6 walks with 4 samples each find 0.97 at a third of the work.
    Items with fewer than ``width`` words can't leak; NULL texts and bodies have no words; rows with the same id count as one document in the distinct result
    of each batch only if they are the same row. Items are handled in blocks of ``block``: each adds a pass over the corpus.
    """
    rows = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(body).alias("b")).where("i IS NOT NULL AND b IS NOT NULL").orderBy("i")
    src = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("text IS NOT NULL AND doc_id IS NOT NULL")
    out = None
    batch: list[tuple[int, str]] = []

    def add(out: DataFrame | None, batch: list[tuple[int, str]]) -> DataFrame:
        found = src.mapInArrow(_scan(ItemIndex(batch, width, walks, places, samples), max_edits), "doc_id bigint, item_id bigint")
        return found if out is None else out.union(found)

    for r in rows.toLocalIterator():
        batch.append((r["i"], r["b"]))
        if len(batch) == block:
            out, batch = add(out, batch), []
    if batch or out is None:
        out = add(out, batch)
    return out
