"""Bodies of responses: decoded by their encoding, capped, with what was cut off flagged."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

LIMIT = 10 * 1024 * 1024  # fixed value: bytes of a decoded body that are kept


def decoded(body: bytes | None, encoding: str | None, limit: int = LIMIT) -> tuple[bytes | None, bool, str | None]:
    """(at most ``limit`` bytes, whether more followed, error). gzip and br (where the library is installed) are decoded, other encodings passed on as they are.

    No more than ``limit + 1`` bytes of a gzip body are ever decompressed. A broken body gives NULL and the error.
    """
    if body is None:
        return None, False, None
    try:
        if (encoding or "").lower() == "gzip":
            d, data, rest = zlib.decompressobj(31), b"", body
            while len(data) <= limit and rest:
                data += d.decompress(rest, limit + 1 - len(data))
                if d.eof and d.unused_data:  # a further member
                    rest, d = d.unused_data, zlib.decompressobj(31)
                elif d.eof:
                    break
                else:
                    rest = d.unconsumed_tail
            if not d.eof and len(data) <= limit:
                return None, False, "gzip: unexpected end"
        elif (encoding or "").lower() == "br":
            import brotli

            data = brotli.decompress(body)
        else:
            data = body
    except ImportError:
        return None, False, "br: no decoder installed"
    except Exception as e:
        return None, False, f"{encoding}: {e}"
    return data[:limit], len(data) > limit, None


def decode_bodies(df: DataFrame, body: str, encoding: str, limit: int = LIMIT) -> DataFrame:
    """``df`` with ``body`` decoded and capped, and the columns ``truncated`` and ``decode_error``; one pass in Arrow batches, other columns pass through."""
    names = df.columns
    at, enc = names.index(body), names.index(encoding)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [decoded(x.as_py(), e.as_py(), limit) for x, e in zip(b.column(at), b.column(enc), strict=True)]
            cols = [pa.array([g[0] for g in got], pa.binary()) if i == at else b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([g[1] for g in got], pa.bool_()), pa.array([g[2] for g in got], pa.string())], [*names, "truncated", "decode_error"])

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInArrow(run, f"{schema}, truncated boolean, decode_error string")
