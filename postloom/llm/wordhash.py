"""Words of texts as 64-bit hashes, by vector arithmetic over the bytes of many texts at once.

A word is a run of a-z and 0-9 after lower-casing. Its hash is a polynomial over its bytes modulo 2**64, read off prefix sums and mixed; no
Python object is made per word.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_SLICE = 1 << 20
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None:
        p = np.full(_SLICE + 1, _BASE, dtype=np.uint64)
        q = np.full(_SLICE + 1, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        p[0] = q[0] = 1
        _powers = np.cumprod(p), np.cumprod(q)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _slice_words(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and hashes of the words of one slice of at most _SLICE bytes."""
    p, q = _power_tables()
    is_word = np.empty(len(b) + 2, dtype=bool)
    is_word[0] = is_word[-1] = False
    is_word[1:-1] = _ALNUM[b]
    turn = np.flatnonzero(is_word[1:] != is_word[:-1])
    start, end = turn[0::2], turn[1::2]
    h = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * p[: len(b)], out=h[1:])
    return start, mix((h[end] - h[start]) * q[start] + (end - start).astype(np.uint64))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, offsets): text i has the words offsets[i]:offsets[i + 1]. NULL counts as empty."""
    parts = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    ends = np.cumsum([len(x) + 1 for x in parts], dtype=np.int64) if parts else np.zeros(0, dtype=np.int64)
    b = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
    starts, hashes = [], []
    at = 0
    while at < len(b):
        to = min(len(b), at + _SLICE)
        if to < len(b):  # end a slice between words; a run of a whole slice is cut, alike wherever it occurs in a text of its own
            gap = np.flatnonzero(~_ALNUM[b[max(at, to - 4096) : to]])
            if len(gap):
                to = max(at, to - 4096) + int(gap[-1]) + 1
        s, h = _slice_words(b[at:to])
        starts.append(s + at)
        hashes.append(h)
        at = to
    start, h = (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    return h, np.concatenate([[0], np.searchsorted(start, ends)]).astype(np.int64)


def text_chunks(sizes: list[int], most: int = 1 << 21) -> list[tuple[int, int]]:
    """Ranges of rows with about ``most`` characters each, to bound the memory of the vectors."""
    out, a, n = [], 0, 0
    for i, s in enumerate(sizes):
        if n and n + s > most:
            out.append((a, i))
            a, n = i, 0
        n += s
    if a < len(sizes):
        out.append((a, len(sizes)))
    return out


def shingle_sets(h: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct 32-bit hashes of k consecutive words of each text, offsets)."""
    n, docs = len(h), len(offsets) - 1
    if n < k:
        return np.zeros(0, np.uint32), np.zeros(docs + 1, np.int64)
    s = np.zeros(n - k + 1, dtype=np.uint64)
    for i in range(k):
        s = s * np.uint64(0xD6E8FEB86659FD93) + h[i : n - k + 1 + i]
    s = mix(s) >> np.uint64(32)
    doc = np.repeat(np.arange(docs, dtype=np.uint64), np.diff(offsets))
    inside = doc[: n - k + 1] == doc[k - 1 :]
    x = np.sort((doc[: n - k + 1][inside] << np.uint64(32)) | s[inside])
    x = x[np.append(True, x[1:] != x[:-1])] if len(x) else x  # a sort of machine words is many times faster than np.unique
    owner = (x >> np.uint64(32)).astype(np.int64)
    return (x & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.searchsorted(owner, np.arange(docs + 1))
