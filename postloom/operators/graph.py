"""Connected components over an edge list, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.operators.lineage import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 30) -> DataFrame:
    """``node, component`` for every node of ``edges``; the component is its smallest node.

    Alternating large-star and small-star steps: each round every node hooks its neighbours to its smallest
    neighbour, which converges in O(log n) rounds on paths as well as on stars. A round writes its edges to the
    shared folder. Hubs are pre-aggregated by ``min`` before any shuffle; no neighbourhood is collected.
    NULL ends and self-loops: an edge with a NULL end is ignored, a self-loop yields its node alone.
    Empty edges give an empty result.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    loops = e.where("u = v").select(F.col("u").alias("node"))
    e = written(e.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    nodes = e.select(F.explode(F.array("u", "v")).alias("node")).union(loops).distinct()
    for _ in range(max_rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: larger neighbours of u go to the smallest of u and its neighbours
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (
            large.join(low, "v")
            .select(F.explode(F.array(F.struct(F.col("m").alias("u"), "v"), F.struct(F.col("m").alias("u"), F.col("u").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        new = written(small)
        changed = new.join(e, ["u", "v"], "left_anti").union(e.join(new, ["u", "v"], "left_anti")).limit(1).count()
        e = new
        if not changed:
            break
    else:
        raise RuntimeError("components did not converge")
    return nodes.join(e.select(F.col("v").alias("node"), F.col("u").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
