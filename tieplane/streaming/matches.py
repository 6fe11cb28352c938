"""Match files that arrive over time: each micro-batch is upserted by score into a versioned table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.upsert import first_by
from ..sources.sinks import LostRace, committed, latest, snapshot

#: Times that a merge is made again because another writer was first.
RETRIES = 20
SCHEMA = "pid long, ccd int, row double, col double, img_id int, mrow double, mcol double, score double"


def merge(current: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Of all rows of a point the best score stays, what was there before on a tie, then the lower tile."""
    new = batch.withColumn("_new", F.lit(1))
    both = new if current is None else current.withColumn("_new", F.lit(0)).unionByName(new)
    return first_by(both, ["pid"], [F.col("score").desc_nulls_last(), "_new", F.col("img_id").asc_nulls_last(), "mrow", "mcol"]).drop("_new")


def _tiles(spark: SparkSession, target: str) -> list[str]:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(hadoop)) if fs.exists(hadoop) else []


def current(spark: SparkSession, target: str) -> DataFrame:
    """The upserted table: the latest version of each tile."""
    out = spark.createDataFrame([], SCHEMA)
    for name in _tiles(spark, target):
        if committed(spark, f"{target}/{name}")[0]:
            out = out.unionByName(latest(spark, f"{target}/{name}"))
    return out


def upsert_batch(spark: SparkSession, batch: DataFrame, target: str) -> None:
    """Merges a batch into the tiles that it has rows of, a sensor's few; other tiles are not touched."""
    for r in batch.select("ccd").distinct().orderBy("ccd").collect():
        where, own = f"{target}/ccd={r.ccd}", batch.filter(F.col("ccd").eqNullSafe(F.lit(r.ccd)))
        for last in range(RETRIES, -1, -1):
            version, folder = committed(spark, where)
            old = spark.read.parquet(folder) if version else None
            try:
                snapshot(merge(old, own), where, after=version)
                break
            except LostRace:  # another writer was first: merge with what it has left
                if not last:
                    raise


def upsert_stream(spark: SparkSession, source: str, target: str, checkpoint: str):
    """Starts the query. A batch that is replayed changes nothing, as merging it again keeps what is there."""
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    return stream.writeStream.foreachBatch(lambda batch, _: upsert_batch(spark, batch, target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str = "ts", late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Matches per tile and window of event time, for batch or stream."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size), "ccd").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("score"))
