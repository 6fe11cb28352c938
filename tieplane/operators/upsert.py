"""Score upserts: which of several rows of a key stays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_k = 1").drop("_k")


def best_cell(df: DataFrame, keys: list[str], score: str, ordinal: str) -> DataFrame:
    """Highest score; of equal scores the last input row, as where >= replaces."""
    return first_by(df, keys, [F.desc(score), F.desc(ordinal)])


def upsert_by_score(points: DataFrame, hits: DataFrame, keys: list[str], payload: list[str], score: str, tile: str) -> DataFrame:
    """All points; a hit replaces what a point has only if its score is higher, so of equal scores what is
    there stays, and among hits the lower tile. Points without either keep nulls."""
    old = points.select(*keys, *payload, F.lit(0).alias("_new"))
    new = hits.select(*keys, *payload, F.lit(1).alias("_new"))
    both = old.filter(F.col(score).isNotNull()).unionByName(new.filter(F.col(score).isNotNull()))
    best = first_by(both, keys, [F.desc(score), "_new", tile]).drop("_new")
    others = [c for c in points.columns if c not in payload]
    return points.select(*others).join(best, keys, "left").select(*points.columns)


def first_line(df: DataFrame, keys: list[str], line: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key comes first, and those that repeat one."""
    ranked = df.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(line)))
    return ranked.filter("_k = 1").drop("_k"), ranked.filter("_k > 1").drop("_k")
