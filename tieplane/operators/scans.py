"""Ordered scans over groups of any size: running sums, totals and the row before, carried from range to range."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import held


def scan_by_ranges(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str] = {}, totals: dict[str, str] = {}, before: dict[str, str] = {}) -> DataFrame:  # noqa: B006
    """Adds per group of ``keys`` and in ``order`` (columns, a total order): running sums, the own row included (``sums``: column to
    new name), sums of the whole group (``totals``), and values of the row before (``before``; null for the first).

    Rows are sorted in ranges that split even one group, each range is summed by itself, and what ranges hand on is one row a
    range and group. So no task holds a group, and nothing but those rows meets by group. Null keys are one group.
    """
    dealt = held(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")  # so that a range keeps its number
    added = sorted({*sums, *totals})
    last = F.max_by(F.struct(*(F.col(c) for c in before)), F.struct(*order)) if before else F.lit(None)
    ends = dealt.groupBy(*keys, "_part").agg(*(F.sum(c).alias(f"_s_{c}") for c in added), last.alias("_last"))
    group = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    past = group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    handed = ends.select(
        *(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_part").alias("_p"), F.lag("_last").over(group.orderBy("_part")).alias("_last"),
        *(F.coalesce(F.sum(f"_s_{c}").over(past), F.lit(0)).alias(f"_b_{c}") for c in sums), *(F.sum(f"_s_{c}").over(group).alias(f"_t_{c}") for c in totals),
    )
    own = W.partitionBy(*keys, "_part").orderBy(*order)
    inner = dealt.withColumns({f"_r_{c}": F.sum(c).over(own.rowsBetween(W.unboundedPreceding, W.currentRow)) for c in sums} | {"_place": F.row_number().over(own)} | {f"_l_{c}": F.lag(c).over(own) for c in before})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.col("_part") == F.col("_p"))
    full = inner.join(handed, same)
    out = {o: F.col(f"_r_{c}") + F.col(f"_b_{c}") for c, o in sums.items()} | {o: F.col(f"_t_{c}") for c, o in totals.items()}
    out |= {o: F.when(F.col("_place") == 1, F.col(f"_last.{c}")).otherwise(F.col(f"_l_{c}")) for c, o in before.items()}
    return full.select(*df.columns, *(x.alias(o) for o, x in out.items()))
