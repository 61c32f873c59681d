"""Token counts by a public tokenizer; its vocabulary file is a parameter and stays outside the library."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranks of a byte-level BPE in tiktoken's format.
VOCABULARY = os.environ.get("POSTLOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# The pattern that cuts a text into words before byte pairs are merged, as published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_loaded: dict[str, tuple] = {}


def load(path: str = VOCABULARY):
    """(encoder, byte length of each token); one per process."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
        size = np.zeros(max(ranks.values()) + 1, dtype=np.int32)
        for k, v in ranks.items():
            size[v] = len(k)
        _loaded[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), size
    return _loaded[path]


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, _ = load(path)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], [*b.schema.names[:-1], "n_tokens"])

    return run


def count_tokens(df: DataFrame, keep: list[str], text: Column, path: str = VOCABULARY) -> DataFrame:
    """``keep`` columns and ``n_tokens`` of the whole ``text``; NULL and empty texts have 0."""
    x = df.select(*keep, text.alias("_text"))
    schema = ", ".join(f"`{n}` {t}" for n, t in x.dtypes[:-1])
    return x.mapInArrow(_counter(path), f"{schema}, n_tokens bigint")
