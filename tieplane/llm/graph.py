"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Returns (node, root): the smallest node that each node with an edge reaches.

    Each round links all larger neighbours of a node to the smallest one, then all smaller ones; minima are
    pre-aggregated, so a hub's edges never meet in one task but for the join, whose skew AQE splits. The
    edge table is written each round, which cuts lineage.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    now = scratch.keep(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges0")
    before = state(now)
    for k in range(1, rounds + 1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            now.join(least, "u").select("u", F.col("m").alias("v"))  # a node keeps its own link to the smallest
        ).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        now = scratch.keep(small, f"edges{k}")
        scratch.drop(f"edges{k - 1}")
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
