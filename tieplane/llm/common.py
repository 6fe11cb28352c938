"""Helpers that the corpus operators share: scratch tables, skew-safe lookups, text normalisation."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: A group with more than total/HEAVY rows is heavy, so there are fewer than HEAVY heavy groups.
HEAVY = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all run on this
    machine (tests). On a cluster without a shared folder it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not where:
        where = tempfile.mkdtemp(prefix="tieplane-")
        spark.sparkContext.setCheckpointDir(where)
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive the loss of executors.

    ``drop`` deletes a table that no later step reads; the rest go when the driver's JVM ends, as a
    returned DataFrame may still read them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._fs(self.base)[0].deleteOnExit(self._fs(self.base)[1])

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            fs, p = self._fs(self.path(name))
            fs.delete(p, True)

    def release(self) -> None:
        """Lets Spark delete the shuffle files of finished steps now, not at some later collection."""
        gc.collect()
        self.spark._jvm.System.gc()


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. ``lower`` does just that where each character is one byte."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to clash with no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def lookup(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Left-joins ``groups`` (one row per key, row count in ``size``) to ``rows`` without skew.

    Fewer than HEAVY groups have more than total/HEAVY rows; only those are broadcast, which bounds the
    broadcast whatever the input. Rows of all other groups meet theirs in a shuffled join whose keys are
    all light. Keys must not be null.
    """
    cut = max(1, total // HEAVY)
    heavy, light = groups.filter(F.col(size) > cut), groups.filter(F.col(size) <= cut)
    first = rows.join(F.broadcast(heavy), keys, "left")
    columns = first.columns
    hit, miss = first.filter(F.col(size).isNotNull()), first.filter(F.col(size).isNull()).select(*rows.columns)
    return hit.unionByName(miss.join(light, keys, "left").select(*columns))


def ranked(rows: DataFrame, groups: list[str], block: str, order: list, rank: str) -> DataFrame:
    """Adds the 0-based rank of each row within ``groups``, ordered by (block, *order), in two levels.

    Rows are ranked inside (groups, block); the counts of the blocks, few per group, give each block its
    base. So no task holds a whole group. ``block`` must be an int column dealt evenly.
    """
    from pyspark.sql import Window as W

    counts = rows.groupBy(*groups, block).agg(F.count(F.lit(1)).alias("_n"))
    over = (W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select(*groups, block, F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_base"))
    inner = rows.withColumn("_r", F.row_number().over(W.partitionBy(*groups, block).orderBy(*order)))
    return inner.join(bases, [*groups, block]).withColumn(rank, (F.col("_base") + F.col("_r") - 1).cast("long")).drop("_r", "_base")
