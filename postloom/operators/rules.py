"""Ordered rules compiled to one CASE chain, and vocabularies matched as words."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Family:
    """A class with patterns that decide (strong), that hint (weak), and that veto it (negative). Patterns are substrings of regular expressions."""

    name: str
    strong: tuple[str, ...] = ()
    weak: tuple[str, ...] = ()
    negative: tuple[str, ...] = ()
    evidence: bool = False


def load_families(text: str) -> list[Family]:
    """Families from JSON, in the order of the file, which is their priority."""
    return [Family(k, *(tuple(v.get(x, ())) for x in ("strong", "weak", "negative")), bool(v.get("evidence"))) for k, v in json.loads(text).items()]


def _any(c: Column, patterns: Sequence[str]) -> Column:
    return c.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def classify(title: Column, families: Sequence[Family], other: str, evidence: Column | None = None) -> Column:
    """Struct family, confidence: all strong rules in order at 0.9, then all weak ones at 0.6, else ``other`` at 0.

    A negative pattern vetoes its family and the search goes on. A family that needs evidence takes the hit only where ``evidence`` holds;
    without it the result is ``other`` at once. NULL titles are ``other``.
    """
    result = lambda n, c: F.struct(F.lit(n).alias("family"), F.lit(c).cast("double").alias("confidence"))
    chain: list[tuple[Column, Column]] = []
    for kind, conf in (("strong", 0.9), ("weak", 0.6)):
        for f in families:
            if patterns := getattr(f, kind):
                hit = _any(title, patterns) & ~_any(title, f.negative)
                if f.evidence and evidence is not None:
                    chain.append((hit & ~evidence, result(other, 0.0)))
                chain.append((hit, result(f.name, conf)))
    if not chain:
        return result(other, 0.0)
    first, *rest = chain
    return reduce(lambda c, x: c.when(*x), rest, F.when(*first)).otherwise(result(other, 0.0))


def ladder(rules: Iterable[tuple[Column, object]], other: object) -> Column:
    """First rule that holds wins."""
    out = None
    for cond, value in rules:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return F.lit(other) if out is None else out.otherwise(other)


# Patterns of the seniority ladder, in its order of decision.
YEARS = r"(?i)(\d+)\+?\s*years?(?:\s+of)?(?:\s+[a-z]+){0,3}?\s+experience"
SENIORITY = {
    "graduation": r"(?i)\bgraduat(?:ing|e)\s+(?:in\s+)?20\d\d\b|\bclass of 20\d\d\b|\bbatch of 20\d\d\b",
    "trainee": r"(?i)graduate engineer trainee|management trainee\s*\(technology\)",
    "trainee_acronym": r"\bGET\b",
    "intern": r"(?i)\bintern(?:ship)?\b|\bco-?op\b|\btrainee\b|summer analyst|industrial trainee|\bapprentice\b",
    "new_grad": r"(?i)new grad(?:uate)?|university grad|campus hire|graduate engineer|entry level",
    "level_4": r"(?i)\b(?:software development engineer|sde)[\s-]*(?:4|iv|5|v|6|vi)\b",
    "level_3": r"(?i)\b(?:software development engineer|sde)[\s-]*(?:3|iii)\b",
    "level_2": r"(?i)\b(?:software development engineer|sde)[\s-]*(?:2|ii)\b",
    "senior": r"(?i)\bsenior\b|\bsr\.?\b|\bstaff\b|\bprincipal\b|\bmid[\s-]level\b",
    "manager": r"(?i)\bmanager\b",
    "staff_word": r"(?i)\bstaff\b|\bprincipal\b",
    "senior_word": r"(?i)\bsenior\b|\bsr\.?\b",
    "entry": r"(?i)\bjunior\b|\bassociate\b|sde[\s-]?1\b|\bl3\b",
}


def seniority(title: Column, requirements: Column, employment_type: Column) -> Column:
    """Years of experience, then the stated kind of employment, then words of title and requirements."""
    s = SENIORITY
    both = F.concat(title, F.lit(" "), requirements)
    years = F.regexp_extract(requirements, YEARS, 1).try_cast("int")
    return ladder(
        [
            (years <= 1, "new_grad"),
            (years < 3, "entry"),
            (years < 5, "mid"),
            (years < 8, "senior"),
            (years >= 8, "staff"),
            (employment_type.rlike(r"(?i)\bintern(?:ship)?\b"), "internship"),
            (both.rlike(s["graduation"]) | both.rlike(s["trainee"]) | both.rlike(s["trainee_acronym"]), "new_grad"),
            (both.rlike(s["intern"]), "internship"),
            (both.rlike(s["new_grad"]), "new_grad"),
            (title.rlike(s["level_4"]), "staff"),
            (title.rlike(s["level_3"]), "senior"),
            (title.rlike(s["level_2"]), "mid"),
            (both.rlike(s["staff_word"]), "staff"),
            (both.rlike(s["senior_word"]), "senior"),
            (both.rlike(s["senior"]), "mid"),
            (title.rlike(s["manager"]), "senior"),
            (both.rlike(s["entry"]), "entry"),
        ],
        "unknown",
    )


def extract_terms(text: Column, vocabulary: dict[str, Sequence[str]]) -> Column:
    """Array of the ids, in the order of the vocabulary, one of whose aliases stands in ``text`` between non-word characters."""
    low = F.lower(text)
    # the plain search spares most texts the regular expression
    hit = lambda a: low.contains(a.lower()) & text.rlike(rf"(?i)(?:^|\W){re.escape(a)}(?:$|\W)")
    some = lambda aliases: reduce(lambda x, y: x | y, [hit(a) for a in aliases])
    return F.array_compact(F.array(*[F.when(some(a), F.lit(i)) for i, a in vocabulary.items()]))


def as_words(c: Column) -> Column:
    """Lower-case words with one space between; letters, digits, full stops, hyphens and apostrophes belong to words."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}.'-]+", " "))


def resolve_aliases(df: DataFrame, text: str, gazetteer: DataFrame) -> DataFrame:
    """``df`` with ``entry_id``: the entry with the longest alias that stands in ``text`` as words; the whole text is the longest of all.

    ``gazetteer``: ``alias``, ``entry_id``. The runs of words of each text, as long as the aliases are, meet the aliases in an equi-join, so a
    growing gazetteer costs a shuffle, not a nested loop. Ties of length go to the smallest id; aliases and texts without words match nothing.
    """
    names = gazetteer.select(as_words(F.col("alias")).alias("alias"), "entry_id").where("alias <> ''")
    names = names.groupBy("alias").agg(F.min("entry_id").alias("entry_id"))
    lengths = [r["n"] for r in names.select(F.size(F.split("alias", " ")).alias("n")).distinct().collect()]  # as many rows as there are lengths
    d = df.select(F.col(text).alias("_t")).where("_t IS NOT NULL").distinct()
    w = F.split(as_words(F.col("_t")), " ")
    grams = d.select("_t", F.posexplode(w).alias("i", "_"), w.alias("w"))
    each = F.filter(F.array(*[F.lit(n) for n in sorted(lengths)]).cast("array<int>"), lambda n: F.col("i") + n <= F.size("w"))
    grams = grams.select("_t", F.explode(F.transform(each, lambda n: F.array_join(F.slice("w", F.col("i") + 1, n), " "))).alias("alias"))
    hits = grams.distinct().join(names, "alias")
    best = hits.groupBy("_t").agg(F.min_by("entry_id", F.struct(-F.length("alias"), F.col("entry_id"))).alias("entry_id"))
    return df.join(best, F.col(text) == F.col("_t"), "left").drop("_t")


def tri_state(text: Column, positive: str, negative: str) -> Column:
    """True, False, or NULL where neither or both patterns stand in the text."""
    p, n = text.rlike(positive), text.rlike(negative)
    return F.when(p & ~n, True).when(n & ~p, False)
