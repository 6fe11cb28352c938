"""Readers of space-separated records; each record keeps its file and its line number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.scans import scan_by_ranges

MATCH = ["row", "col", "img_id", "mrow", "mcol", "score"]


def lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """file, line (from 1), value of all lines but blank ones. Files are read in splits, as any text: a line's number is its
    place in its split, by the order of reading, after the lines of the file's splits before, which are counted."""
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    text = reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"), F.regexp_replace("value", "\r$", "").alias("value"))
    counts = text.groupBy("file", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("file").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inner = text.withColumn("_r", F.row_number().over(W.partitionBy("file", "_b").orderBy("_i")))
    numbered = inner.join(counts.withColumn("_s", before).select("file", "_b", "_s"), ["file", "_b"])
    return numbered.select("file", (F.col("_s") + F.col("_r")).cast("int").alias("line"), "value").filter(F.trim("value") != "")


def numbered(values: DataFrame, file: Column, order: list, value: str = "value") -> DataFrame:
    """file, line, value from any table of lines with an order of their own; no task holds a file."""
    places = [f"_o{i}" for i in range(len(order))]
    d = values.select(file.alias("file"), F.col(value).alias("value"), F.lit(1).alias("_one"), *((F.col(o) if isinstance(o, str) else o).alias(n) for o, n in zip(order, places, strict=True)))
    return scan_by_ranges(d, ["file"], places, {"_one": "line"}).select("file", F.col("line").cast("int").alias("line"), "value")


def fields(df: DataFrame) -> DataFrame:
    """Adds the fields f. Generated, not projected: so the split is not repeated for each field that is read."""
    return df.withColumn("f", F.explode(F.array(F.split(F.trim(F.regexp_replace("value", r"[\t ]+", " ")), " "))))


def dot_of_fields(pairs: list[tuple[int, float]]) -> Column:
    """The sum of fields of a split line times factors, (field from 0, factor); null where a field is missing or no number."""
    return sum((_num(i) * float(w) for i, w in pairs[1:]), _num(pairs[0][0]) * float(pairs[0][1]))


def _num(i: int, kind: str = "double") -> Column:
    return F.expr(f"try_cast(get(f, {i}) AS {kind})")


def _with_least(d: DataFrame, line: Column, out: str) -> DataFrame:
    """Adds the least of ``line`` in each file, from one row a file: no file's lines meet in a task."""
    return d.join(d.groupBy("file").agg(F.min(line).alias(out)), "file", "left")


def match_records(rows: DataFrame, strict: bool = True) -> DataFrame:
    """Tagged records: a first field of 1 has seven fields and a match, any other three. Columns file, line,
    flag and the match columns, unmatched ones null.

    Strict reading ends a file before its first malformed line, as a stream of numbers does; otherwise
    malformed lines are left out (``malformed`` has them).
    """
    d = fields(rows).withColumn("flag", _num(0, "int"))
    whole = F.when(F.col("flag") == 1, F.size("f") >= 7).otherwise(F.size("f") >= 3)
    parts = [_num(1), _num(2), *(F.when(F.col("flag") == 1, _num(i, "int" if i == 3 else "double")) for i in (3, 4, 5, 6))]
    d = d.select("file", "line", "flag", whole.alias("_ok"), *(p.alias(n) for p, n in zip(parts, MATCH, strict=True)))
    ok = F.col("_ok") & F.col("flag").isNotNull() & F.col("row").isNotNull() & F.col("col").isNotNull()
    ok = ok & ((F.col("flag") != 1) | (F.col("img_id").isNotNull() & F.col("mrow").isNotNull() & F.col("mcol").isNotNull() & F.col("score").isNotNull()))
    d = d.withColumn("_bad", F.when(F.coalesce(ok, F.lit(False)), None).otherwise(F.col("line")))
    if strict:
        d = _with_least(d, F.col("_bad"), "_end").filter(F.col("_end").isNull() | (F.col("line") < F.col("_end")))
    else:
        d = d.filter(F.col("_bad").isNull())
    return d.select("file", "line", "flag", *MATCH)


def classified(rows: DataFrame, decimals: int = 6) -> DataFrame:
    """Each line with its kind: record, malformed (neither three nor seven fields, or no numbers), duplicate
    (a source point that came before)."""
    d = fields(rows).withColumn("n", F.size("f"))
    d = d.select("file", "line", "n", _num(0, "int").alias("flag"), *(_num(i, "int" if i == 3 else "double").alias(c) for i, c in enumerate(MATCH, 1)))
    good = F.col("n").isin(3, 7) & F.col("flag").isNotNull() & F.col("row").isNotNull() & F.col("col").isNotNull()
    d = d.withColumn("_g", F.coalesce(good, F.lit(False)))
    w = W.partitionBy("file", "_g", F.round("row", decimals), F.round("col", decimals)).orderBy("line")
    kind = F.when(~F.col("_g"), "malformed").when(F.row_number().over(w) > 1, "duplicate").otherwise("record")
    return d.withColumn("kind", kind).drop("_g")


def matched_only(rows: DataFrame) -> DataFrame:
    return match_records(rows, strict=False).filter("flag = 1")


def unmatched_only(rows: DataFrame) -> DataFrame:
    return match_records(rows, strict=False).filter("flag <> 1 OR img_id IS NULL")


def link_records(rows: DataFrame) -> DataFrame:
    """Links within a strip: the first field is the left tile, whatever its value; lines of seven numbers only."""
    d = fields(rows).filter(F.size("f") == 7)
    names = ["ccd_l", "row", "col", "ccd_r", "mrow", "mcol", "score"]
    d = d.select("file", "line", *(_num(i, "int" if i in (0, 3) else "double").alias(n) for i, n in enumerate(names)))
    return d.dropna(subset=names)


def mosaic_offsets(rows: DataFrame, first: int, count: int) -> DataFrame:
    """Offsets of tiles first..first+count-1; missing ones are zero and marked."""
    d = fields(rows).select(*(_num(i, "int").alias(n) for i, n in enumerate(["ccd", "r0", "r1", "c0", "c1"]))).dropna()
    want = rows.sparkSession.range(first, first + count).select(F.col("id").cast("int").alias("ccd"))
    return want.join(d, "ccd", "left").select("ccd", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("r0", "r1", "c0", "c1")), F.col("r0").isNull().alias("missing"))


IO = ["x0", "x_s", "x_l", "y0", "y_s", "y_l", "k0", "k1", "k2", "f"]


def interior_orientation(rows: DataFrame) -> DataFrame:
    return fields(rows).select(_num(0, "int").alias("ccd"), *(_num(i).alias(n) for i, n in enumerate(IO, 1))).dropna()


def trajectory(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(header: file, begin, line_rate), (samples: file, line, et, Xs, Ys, Zs, phi, omega, kappa)."""
    d = _with_least(fields(rows), F.col("line"), "_first")
    header = d.filter("line = _first").select("file", _num(0).alias("begin"), _num(1).alias("line_rate"))
    samples = d.filter("line > _first").select("file", "line", *(_num(i).alias(n) for i, n in enumerate(["et", "Xs", "Ys", "Zs", "phi", "omega", "kappa"]))).dropna()
    return header, samples


def polynomials(rows: DataFrame) -> DataFrame:
    """file, param (0 on), t0, coefs; of any number of coefficients."""
    d = fields(rows).withColumn("param", F.row_number().over(W.partitionBy("file").orderBy("line")) - 1)
    return d.select("file", "param", _num(0).alias("t0"), F.transform(F.expr("slice(f, 2, size(f))"), lambda x: x.try_cast("double")).alias("coefs"))


def valid_trajectories(samples: DataFrame, polys: DataFrame, least: int = 10) -> DataFrame:
    """Files of enough samples, and whether their polynomials (six rows) can be used again."""
    n = samples.groupBy("file").agg(F.count(F.lit(1)).alias("samples")).filter(F.col("samples") >= least)
    return n.join(polys.groupBy("file").agg(F.count(F.lit(1)).alias("rows")), "file", "left").select("file", "samples", (F.coalesce("rows", F.lit(0)) >= 6).alias("reuse"))


def xyz_points(rows: DataFrame) -> DataFrame:
    """Points of at least three numbers; a first line of one number is a count. Commas and D exponents are
    read; points with a missing or infinite coordinate are dropped. Columns file, line, x, y, z, rest."""
    clean = rows.withColumn("value", F.regexp_replace(F.translate("value", ",", " "), r"(?<=[0-9.])[dD](?=[+-]?[0-9])", "e")).filter(~F.ltrim("value").startswith("#"))
    d = _with_least(fields(clean), F.col("line"), "_first").filter(~((F.col("line") == F.col("_first")) & (F.size("f") == 1)))
    d = d.select("file", "line", _num(0).alias("x"), _num(1).alias("y"), _num(2).alias("z"), F.transform(F.expr("slice(f, 4, greatest(size(f), 4))"), lambda x: x.try_cast("double")).alias("rest"))
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return d.filter(fine("x") & fine("y") & fine("z"))


def label_values(labels: DataFrame, keys: list[str]) -> DataFrame:
    """KEY = value pairs of image labels, quotes and units off; a column per key, null where it is missing.
    ``labels`` has file and value, the label's text."""
    pick = lambda k: F.regexp_extract("value", rf'(?m)^\s*{k}\s*=\s*"?([^"<\r\n]*?)"?\s*(?:<[^>]*>)?\s*$', 1)
    return labels.select("file", *(F.when(pick(k) != "", pick(k)).alias(k) for k in keys))


def name_pattern(pattern: str) -> str:
    """A pattern with REDi_i+1 for any two tile numbers, or one with * and ?, as a regular expression."""
    import re

    parts = [r"RED\d+_\d+" if p == "REDi_i+1" else re.escape(p).replace(r"\*", ".*").replace(r"\?", ".") for p in re.split(r"(REDi_i\+1)", pattern)]
    return "^" + "".join(parts) + "$"


def path_parts(df: DataFrame, file: str = "file") -> DataFrame:
    """Adds seq, level, ccd and suffix of {root}/{seq}/downsample/{level}/{seq}_RED{ccd}{suffix}."""
    pat = r"([^/]+)/downsample/(\d+)/[^/]*_RED(\d+)([^/]*)$"
    g = lambda i: F.regexp_extract(file, pat, i)
    return df.withColumns({"seq": g(1), "level": F.expr(f"try_cast(regexp_extract({file}, '([^/]+)/downsample/([0-9]+)/', 2) AS int)"), "ccd": g(3).try_cast("int"), "suffix": g(4)})
