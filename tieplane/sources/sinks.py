"""Writers: snapshots, fixed text formats, point files, metrics."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class LostRace(RuntimeError):
    """Another writer has committed the version that this one was to become."""


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def committed(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """The last committed version of a table and the folder that holds it; (0, None) without one. A version is committed by
    its manifest, which gets its name last, in one step, and only if no other has it; folders that no manifest names, of
    writers that died or lost, are no versions."""
    fs, hadoop = _files(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(hadoop)] if fs.exists(hadoop) else []
    last = max((int(n[1:].removesuffix(".manifest")) for n in names if n.startswith("v") and n.endswith(".manifest")), default=0)
    if not last:
        return 0, None
    folder = spark.read.text(f"{path}/v{last}.manifest").first()[0]
    return last, f"{path}/{folder}"


def _commit(spark: SparkSession, path: str, version: int, folder: str) -> bool:
    """Whether the manifest of a version could be named: not if it is there already."""
    jvm = spark._jvm
    fs, draft = _files(spark, f"{path}/{folder}.draft")
    out = fs.create(draft, True)
    out.write(bytearray(folder.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    how = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(draft, _files(spark, f"{path}/v{version}.manifest")[1], how)
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in e.java_exception.getClass().getName():
            raise
        fs.delete(draft, False)
        return False
    return True


def snapshot(df: DataFrame, path: str, after: int | None = None) -> DataFrame:
    """Writes a new version and reads it back; a table is never overwritten while it is read.

    ``after`` is the version that ``df`` was made from (0: none). If another writer has committed a later one meanwhile,
    LostRace is raised and nothing is changed. Without ``after`` the version is added to whatever there is.
    """
    spark, folder = df.sparkSession, f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    while True:
        last = committed(spark, path)[0] if after is None else after
        if _commit(spark, path, last + 1, folder):
            return spark.read.schema(df.schema).parquet(f"{path}/{folder}")
        if after is not None:
            fs, lost = _files(spark, f"{path}/{folder}")
            fs.delete(lost, True)
            raise LostRace(f"{path} has a version {last + 1} already")


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The last committed version."""
    version, folder = committed(spark, path)
    if not version:
        raise FileNotFoundError(f"{path} has no committed version")
    return spark.read.parquet(folder)


def append_hits(seeds: DataFrame, hits: DataFrame) -> DataFrame:
    return seeds.unionByName(hits, allowMissingColumns=True)


def match_line() -> Column:
    """A record as text: seven fields for a match, three without."""
    full = F.format_string("1 %f %f %d %f %f %f", "row", "col", "img_id", "mrow", "mcol", "score")
    return F.when(F.col("img_id").isNull(), F.format_string("0 %f %f", "row", "col")).otherwise(full)


def write_matches(df: DataFrame, path: str, by: str = "ccd", order: str = "line") -> None:
    """A folder of text per tile, rows in their order."""
    df.repartition(by).sortWithinPartitions(by, order).select(by, match_line().alias("value")).write.partitionBy(by).text(path)


def write_points(df: DataFrame, path: str, columns: list[str], order: list, count: bool = True) -> None:
    """An export file: the count, then a line per point. One task writes it, in order, as the format asks."""
    body = df.select(F.lit(1).alias("_o"), F.struct(*order).alias("_k"), F.concat_ws(" ", *(F.format_string("%.6f", F.col(c).cast("double")) for c in columns)).alias("value"))
    if count:
        head = df.agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit(0).alias("_o"), F.lit(None).cast(body.schema["_k"].dataType).alias("_k"), "value")
        body = body.unionByName(head)
    body.orderBy("_o", "_k").select("value").coalesce(1).write.text(path)


def metrics_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.option("header", True).csv(path)


def stats_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


def mosaic_points(df: DataFrame, path: str) -> None:
    """R1 C1 dx dy score left_ccd right_ccd with a header line."""
    df.select("R1", "C1", "dx", "dy", "score", "left_ccd", "right_ccd").coalesce(1).write.option("header", True).option("sep", " ").csv(path)


def ascii_ply(df: DataFrame, path: str, order: tuple[str, ...] = ("x", "y", "z")) -> None:
    """Vertices x, y, z as an ASCII PLY export, in the order of ``order``; one task writes it, as the format asks."""
    n = df.count()
    head = ["ply", "format ascii 1.0", f"element vertex {n}", "property double x", "property double y", "property double z", "end_header"]
    body = df.select(F.lit(len(head)).alias("o"), F.struct(*order).alias("k"), F.format_string("%.6f %.6f %.6f", "x", "y", "z").alias("value"))
    top = df.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, head))).alias("o", "value")).select("o", F.lit(None).cast(body.schema["k"].dataType).alias("k"), "value")
    top.unionByName(body).orderBy("o", "k").select("value").coalesce(1).write.text(path)


def products(files: DataFrame, drop: tuple[str, ...] = (".tif", ".tiff", ".img", ".png", ".jpg"), file: str = "file") -> DataFrame:
    """Files to collect: all but images."""
    out = files
    for s in drop:
        out = out.filter(~F.lower(file).endswith(s))
    return out
