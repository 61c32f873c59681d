"""Composite scores from weights that are data, with what went into them, and short explanations."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEUTRAL = 50  # fixed value: the score of what nothing is known about


def parse_weights(text: Column) -> Column:
    """Weights as a map from their JSON text; malformed text is NULL."""
    return F.from_json(text, "map<string,double>")


def weighted_by(weights: Column, values: dict[str, Column]) -> Column:
    """Weighted mean over the values that are there and have a weight; 0 if none is. ``weights``: a map."""
    w = {k: F.when(v.isNotNull(), F.coalesce(weights[k], F.lit(0.0))).otherwise(0.0) for k, v in values.items()}
    num = sum((w[k] * F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in values.items()), F.lit(0.0))
    den = sum(w.values(), F.lit(0.0))
    return F.when(den > 0, num / den).otherwise(0.0)


def coverage_score(wanted: Column, levels: Column, top: int = 5) -> tuple[Column, Column]:
    """(score, missing): 100 times the mean level of the wanted terms over ``top``, rounded; ``NEUTRAL`` if none is wanted. ``levels``: a map; an absent term has level 0."""
    level = lambda s: F.coalesce(F.try_element_at(levels, s), F.lit(0))
    total = F.aggregate(wanted, F.lit(0).cast("bigint"), lambda a, s: a + level(s).cast("bigint"))
    n = F.coalesce(F.size(wanted), F.lit(0))
    return F.when(n > 0, F.round(100 * total / (top * n)).cast("int")).otherwise(NEUTRAL), F.filter(wanted, lambda s: level(s) == 0)


def fused_match(cosine: Column, keyword: Column) -> Column:
    """Keyword share alone where there is no cosine, else a blend of the cosine above 0.55, the keyword share and a constant; 0 to 100."""
    near = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cosine - 0.55) / 0.40))
    return F.round(100 * F.when(cosine.isNull(), keyword).otherwise(0.55 * near + 0.35 * keyword + 0.10)).cast("int")


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def top_factors(weights: Column, values: dict[str, Column], n: int = 4) -> Column:
    """``name=value`` of the ``n`` largest products of weight and value; ties keep the order of ``values``; absent ones are skipped."""
    each = [F.when(v.isNotNull() & weights[k].isNotNull(), F.struct((-F.round(weights[k] * v, 6)).alias("c"), F.lit(i).alias("i"), F.concat(F.lit(f"{k}="), v.cast("string")).alias("t"))) for i, (k, v) in enumerate(values.items())]
    return F.transform(F.slice(F.array_sort(F.array_compact(F.array(*each))), 1, n), lambda s: s["t"])


def first_words(text: Column, most: int = 45) -> Column:
    """The text if it has at most ``most`` words, else so many of them and an ellipsis."""
    w = F.split(F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " ")), " ")
    return F.when(F.size(w) <= most, text).otherwise(F.concat(F.array_join(F.slice(w, 1, most), " "), F.lit("…")))


def ordinal(n: Column) -> Column:
    tail = n % 10
    end = F.when((n % 100).between(11, 13), "th").when(tail == 1, "st").when(tail == 2, "nd").when(tail == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def explanation(wanted: Column, missing: Column, city: Column, tier: Column, remote: Column, per_month: Column, percentile: Column, shown: int = 5) -> Column:
    """Sentences on terms, place and pay, those without data left out; one fixed sentence if none is left."""
    had = F.array_except(wanted, missing)
    n, m = F.size(wanted), F.size(had)
    listed = F.concat(F.array_join(F.slice(had, 1, shown), ", "), F.when(m > shown, ", …).").otherwise(")."))
    skills = F.when(n > 0, F.when(m == 0, F.concat(F.lit("Matches 0 of "), n.cast("string"), F.lit(" required skills."))).otherwise(
        F.concat(F.lit("Matches "), m.cast("string"), F.lit(" of "), n.cast("string"), F.lit(" required skills ("), listed)
    ))
    blank = F.coalesce(city, F.lit("")) == ""
    place = F.when(blank & remote, "Remote.").when(blank, None).when(tier.between(1, 4), F.concat(F.lit("Tier "), tier.cast("string"), F.lit(" location: "), city, F.lit("."))).otherwise(F.concat(city, F.lit(".")))
    amount = F.concat(F.lit("₹"), F.format_number(F.round(per_month).cast("decimal(20,0)"), 0), F.lit("/month"))
    rank = F.when(percentile.isNull(), ".").otherwise(F.concat(F.lit(", "), ordinal(F.round(100 * percentile).cast("int")), F.lit(" percentile among comparable roles.")))
    text = F.concat_ws(" ", skills, place, F.concat(amount, rank))
    return F.when(text == "", "Not enough data yet for a specific explanation — check back after this posting is re-processed.").otherwise(text)


def embedding_text(title: Column, stripped: Column, plain: Column) -> Column:
    """Title, a line break, and the stripped text or else the plain one."""
    blank = lambda c: F.nullif(c, F.lit(""))
    return F.regexp_replace(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(blank(stripped), blank(plain), F.lit(""))), r"^[ \t\n\r\f]+|[ \t\n\r\f]+$", "")


def hashed_embedding(df: DataFrame, id_col: str, text: str, size: int = 64) -> DataFrame:
    """``id, embedding``: signed counts of hashed words, of unit length: the stand-in for a model, which is injected where there is one. NULL counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[int, int]] = {}
        for b in batches:
            out = np.zeros((b.num_rows, size), dtype=np.float32)
            for i, t in enumerate(b.column(1).to_pylist()):
                for w in (t or "").lower().split():
                    if w not in seen:
                        h = int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "big")
                        seen[w] = (h % size, 1 if h >> 63 else -1)
                    out[i, seen[w][0]] += seen[w][1]
                if len(seen) > 100_000:
                    seen.clear()
            out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
            at = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * size)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(at, pa.array(out.reshape(-1)))], [id_col, "embedding"])

    return df.select(id_col, text).mapInArrow(run, f"{id_col} {dict(df.dtypes)[id_col]}, embedding array<float>")


def accept(first: Column, first_conf: Column, second: Column, second_conf: Column, classes: list[str], below: float, least: float) -> tuple[Column, Column]:
    """(class, confidence): the second opinion where the first is below ``below`` and the second names a known class at ``least`` or more; else the first."""
    ok = F.coalesce((first_conf < below) & second.isin(*classes) & (second_conf >= least), F.lit(False))
    return F.when(ok, second).otherwise(first), F.when(ok, second_conf).otherwise(first_conf)


def merged_levels(current: Column, found: Column, default: int = 3) -> Column:
    """Struct levels, added, removed: the found terms with their old level or ``default``; what came and what went."""
    cur = F.coalesce(current, F.create_map().cast("map<string,int>"))
    terms = F.array_distinct(F.coalesce(found, F.array().cast("array<string>")))
    levels = F.map_from_arrays(terms, F.transform(terms, lambda s: F.coalesce(F.try_element_at(cur, s), F.lit(default))))
    old = F.map_keys(cur)
    return F.struct(levels.alias("levels"), F.array_sort(F.array_except(terms, old)).alias("added"), F.array_sort(F.array_except(old, terms)).alias("removed"))
