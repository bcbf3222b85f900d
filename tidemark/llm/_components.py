"""Connected components of an edge table, by alternating large and small stars.

Every step is a grouped minimum and a join; edges are written to the shared
scratch folder after each round, so lineage stays short and nothing is gathered
anywhere.  A star of any size takes one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._io import materialize


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Connect each node's larger neighbours (or itself and its smaller ones) to the smallest node around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
    if larger:
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        out = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = both.where("v < u")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node reaches; nodes without edges are left out."""
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = mark(now)
    for _ in range(most):
        now = materialize(_star(_star(now, True), False).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        if (here := mark(now)) == seen:
            break
        seen = here
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v"))).distinct()
