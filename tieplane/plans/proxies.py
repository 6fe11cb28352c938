"""Correspondence tables made of the driver's general tables, and the SQL that makes the same ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.observations import settled

#: Tiles of the proxy sensor: count, row and column offsets per tile, extent.
TILES, ROW_STEP, COL_STEP, ROWS, COLS = 10, 3, 15, 44000, 15


def r6(x: Column, digits: int = 6) -> Column:
    """Rounded for comparison; the sum turns -0.0 into 0.0."""
    return F.round(x.cast("double"), digits) + F.lit(0.0)


def minutes(ts: str) -> Column:
    """Minutes since 2024-01-01 of a timestamp without zone, whatever the session's zone."""
    day = F.datediff(F.col(ts), F.lit("2024-01-01").cast("date")).cast("long") * 86_400_000_000
    micros = (F.expr(f"extract(SECOND FROM {ts})") * 1_000_000).cast("long")
    return (day + F.hour(ts).cast("long") * 3_600_000_000 + F.minute(ts).cast("long") * 60_000_000 + micros) / 60000000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pt(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("pid"), minutes("ts").alias("row"), F.col("user_id").cast("double").alias("col"), (F.col("user_id") % 10).cast("int").alias("ccd"), F.col("value").alias("score"))


def match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched and unmatched points; what is unmatched has null img_id, mrow, mcol and score."""
    e = settled(table(spark, sf_dir, "events"), {"_row": minutes("ts"), "_k": F.regexp_extract("props", "([0-9]+)", 1).cast("int")})
    k, hit = F.col("_k"), F.col("event_type") != "error"
    row, col = F.col("_row"), F.col("user_id").cast("double")
    return e.select(
        F.col("event_id").alias("pid"), (F.col("user_id") % 10).cast("int").alias("ccd"), row.alias("row"), col.alias("col"), k.alias("k"),
        F.when(hit, k % 10).alias("img_id"), F.when(hit, row + k - 50).alias("mrow"), F.when(hit, col + F.col("value") / 10).alias("mcol"), F.when(hit, F.col("value")).alias("score"),
    )


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match(spark, sf_dir).filter("img_id IS NOT NULL")


def mosaic(spark: SparkSession) -> DataFrame:
    i = F.col("id").cast("int")
    return spark.range(TILES).select(i.alias("ccd"), (i * ROW_STEP).alias("r0"), (i * ROW_STEP + ROWS).alias("r1"), (i * COL_STEP).alias("c0"), (i * COL_STEP + COLS).alias("c1"))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extent of each tile as its points show it."""
    whole = lambda c: c.cast("int")
    return pt(spark, sf_dir).groupBy("ccd").agg(whole(F.floor(F.min("row"))).alias("r0"), whole(F.ceil(F.max("row"))).alias("r1"), whole(F.floor(F.min("col"))).alias("c0"), whole(F.ceil(F.max("col"))).alias("c1"))


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_quantity") * 10).alias("x"), (F.col("l_discount") * 1000).alias("y"), (F.col("l_extendedprice") / 1000).alias("z"), F.col("l_returnflag").alias("strip"))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pid"), F.col("label").alias("ccd"), F.col("embedding").alias("patch"))


def ephem(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("oid"), (F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")) * 1.0).alias("t"), F.col("o_totalprice").alias("y"))


_HIT = "event_type <> 'error'"
_ROW = "(epoch_us(ts) - 1704067200000000) / 60000000.0"
_K = "regexp_extract(props, '([0-9]+)', 1)::INT"
SQL = f"""
pt AS (SELECT event_id AS pid, {_ROW} AS row, user_id::DOUBLE AS col, (user_id % 10)::INT AS ccd, value AS score FROM events),
match AS (SELECT event_id AS pid, (user_id % 10)::INT AS ccd, {_ROW} AS row, user_id::DOUBLE AS col, {_K} AS k,
  CASE WHEN {_HIT} THEN {_K} % 10 END AS img_id, CASE WHEN {_HIT} THEN {_ROW} + {_K} - 50 END AS mrow,
  CASE WHEN {_HIT} THEN user_id::DOUBLE + value / 10 END AS mcol, CASE WHEN {_HIT} THEN value END AS score FROM events),
matched AS (SELECT * FROM match WHERE img_id IS NOT NULL),
mosaic AS (SELECT i::INT AS ccd, (i * {ROW_STEP})::INT AS r0, (i * {ROW_STEP} + {ROWS})::INT AS r1, (i * {COL_STEP})::INT AS c0, (i * {COL_STEP} + {COLS})::INT AS c1 FROM range({TILES}) t(i)),
tiles AS (SELECT ccd, floor(min(row))::INT AS r0, ceil(max(row))::INT AS r1, floor(min(col))::INT AS c0, ceil(max(col))::INT AS c1 FROM pt GROUP BY ccd),
cloud AS (SELECT l_quantity * 10 AS x, l_discount * 1000 AS y, l_extendedprice / 1000 AS z, l_returnflag AS strip FROM lineitem),
patches AS (SELECT vec_id AS pid, label AS ccd, embedding AS patch FROM embeddings),
ephem AS (SELECT o_orderkey AS oid, datediff('day', DATE '1992-01-01', o_orderdate::DATE) * 1.0::DOUBLE AS t, o_totalprice AS y FROM orders)
"""
