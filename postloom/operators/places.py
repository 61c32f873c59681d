"""Places of a posting by tiers: the best of the places that a field names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions.text import work_mode
from postloom.operators.rules import resolve_aliases

# What separates places in a field; a comma doesn't.
DELIMITERS = r"(?i)\s*(?:/|;|\||\bor\b|\band\b)\s*"


def tier_for(entry: Column, country: Column, remote: Column, home: Column, home_country: Column) -> Column:
    """1 for the home place, 3 for remote work elsewhere, 2 in the home country, 4 abroad, 0 where the country isn't known."""
    return (
        F.when(entry.eqNullSafe(home), 1).when(remote, 3).when(country.eqNullSafe(home_country), 2).when(F.coalesce(country, F.lit("")) != "", 4).otherwise(0)
    )


def best_places(df: DataFrame, key: str, raw: str, remote_hint: str, gazetteer: DataFrame, places: DataFrame, home: int, home_country: str) -> DataFrame:
    """``key, mode, entry_id, tier``: of the places that ``raw`` names, apart at delimiters, the one of the lowest tier, the first of several.

    ``gazetteer``: ``alias, entry_id``; ``places``: ``entry_id, country``. A field that names no known place has NULL and tier 0, or 3 where the work is remote.
    Each distinct field is resolved once, for remote work and for other work; blank fields and NULLs name nothing.
    """
    d = df.select(F.col(raw).alias("_raw")).where("trim(_raw) <> ''").distinct()
    parts = d.select("_raw", F.posexplode(F.split("_raw", DELIMITERS)).alias("_pos", "_part")).withColumn("_part", F.trim("_part")).where("_part <> ''")
    named = resolve_aliases(parts, "_part", gazetteer).where("entry_id IS NOT NULL").join(places.select("entry_id", "country"), "entry_id")
    pick = lambda remote: _pick(tier_for(F.col("entry_id"), F.col("country"), F.lit(remote), F.lit(home), F.lit(home_country)))
    best = named.groupBy("_raw").agg(pick(True).alias("_far"), pick(False).alias("_near"))
    x = df.select(key, F.col(raw).alias("_r"), work_mode(F.col(raw), F.col(remote_hint)).alias("mode")).join(best, F.col("_r") == F.col("_raw"), "left")
    b = F.when(F.col("mode") == "remote", F.col("_far")).otherwise(F.col("_near"))
    tier = F.coalesce(b["tier"], F.lit(0))
    return x.select(key, "mode", b["entry_id"].alias("entry_id"), F.when((tier == 0) & (F.col("mode") == "remote"), 3).otherwise(tier).alias("tier"))


def _pick(tier: Column) -> Column:
    # an unknown tier gives way to every later place
    order = F.struct(F.when(tier > 0, tier).otherwise(99), F.when(tier > 0, F.col("_pos")).otherwise(-F.col("_pos")))
    return F.min_by(F.struct("entry_id", tier.alias("tier")), order)
