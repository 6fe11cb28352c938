"""Differences of two runs' tables by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sides(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Every key with the side that has it: only_a, only_b or common."""
    x, y = a.select(*keys, F.lit(True).alias("_a")), b.select(*keys, F.lit(True).alias("_b"))
    side = F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").otherwise("common")
    return x.join(y, keys, "full_outer").select(*keys, side.alias("side"))


def keyed_diff(a: DataFrame, b: DataFrame, keys: list[str], decimals: int = 6, tolerance: float = 1e-6) -> DataFrame:
    """Each key with the first of these that holds: only_a, only_b, status (matched in one only), image, target
    (rounded), score (by more than the tolerance), same. Tables have img_id, mrow, mcol, score."""
    names = ["img_id", "mrow", "mcol", "score"]
    side = lambda d, p: d.select(*keys, F.lit(True).alias(f"{p}_in"), *(F.col(c).alias(f"{p}_{c}") for c in names))
    j = side(a, "a").join(side(b, "b"), keys, "full_outer")
    c = F.col
    moved = lambda n: F.round(f"a_{n}", decimals) != F.round(f"b_{n}", decimals)
    change = (
        F.when(c("b_in").isNull(), "only_a").when(c("a_in").isNull(), "only_b").when(c("a_img_id").isNull() != c("b_img_id").isNull(), "status")
        .when(c("a_img_id").isNull(), "same").when(c("a_img_id") != c("b_img_id"), "image").when(moved("mrow") | moved("mcol"), "target")
        .when(F.abs(c("a_score") - c("b_score")) > tolerance, "score").otherwise("same")
    )
    return j.withColumn("change", change)
