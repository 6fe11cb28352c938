"""Queries that read and write text records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import sinks, text
from . import proxies as P
from .proxies import r6
from .registry import query

C = F.col


def _lines(spark, sf_dir):
    """The match proxy as tagged text, a file per tile, with odd lines among them."""
    m = P.match(spark, sf_dir)
    late = (C("ccd") % 2 == 0) | (C("pid") % 9409 == 0)  # in odd tiles bad lines come late, if at all
    odd = F.when(late & (C("pid") % 97 == 0), F.lit("1 2")).when(late & (C("pid") % 89 == 0), F.lit("x y z")).otherwise(sinks.match_line())
    return text.numbered(m.withColumn("value", odd), C("ccd").cast("string"), ["pid"])


_KIND = """WITH l AS (SELECT ccd::VARCHAR AS file, pid, row_number() OVER (PARTITION BY ccd ORDER BY pid)::INT AS line, (ccd % 2 = 0 OR pid % 9409 = 0) AND (pid % 97 = 0 OR pid % 89 = 0) AS bad, m.* EXCLUDE (pid, ccd) FROM match m)"""


@query("sc1_strict_records", _KIND + ", e AS (SELECT *, min(line) FILTER (WHERE bad) OVER (PARTITION BY file) AS stop FROM l) SELECT file, line, (img_id IS NOT NULL)::INT AS flag, img_id, round(round(row, 6), 3) + 0.0 AS r, round(round(mcol, 6), 3) + 0.0 AS c FROM e WHERE stop IS NULL OR line < stop")
def sc1(spark, sf_dir):
    return text.match_records(_lines(spark, sf_dir)).select("file", "line", "flag", "img_id", r6(C("row"), 3).alias("r"), r6(C("mcol"), 3).alias("c"))


@query("sc2_classified_lines", _KIND + ", p AS (SELECT file, line, bad, round(l.row, 6) AS r, round(l.col, 6) AS c FROM l), t AS (SELECT *, row_number() OVER (PARTITION BY file, bad, r, c ORDER BY line) AS k FROM p) SELECT file, line, CASE WHEN bad THEN 'malformed' WHEN k > 1 THEN 'duplicate' ELSE 'record' END AS kind FROM t")
def sc2(spark, sf_dir):
    return text.classified(_lines(spark, sf_dir)).select("file", "line", "kind")


@query("sc3_matched_only", _KIND + "SELECT file, line, img_id, round(round(mrow, 6), 3) + 0.0 AS mrow, round(round(score, 6), 3) + 0.0 AS score FROM l WHERE NOT bad AND img_id IS NOT NULL")
def sc3(spark, sf_dir):
    return text.matched_only(_lines(spark, sf_dir)).select("file", "line", "img_id", r6(C("mrow"), 3).alias("mrow"), r6(C("score"), 3).alias("score"))


@query("sc5_unmatched_only", _KIND + "SELECT file, line, round(round(row, 6), 3) + 0.0 AS r, col AS c FROM l WHERE NOT bad AND img_id IS NULL")
def sc5(spark, sf_dir):
    return text.unmatched_only(_lines(spark, sf_dir)).select("file", "line", r6(C("row"), 3).alias("r"), C("col").alias("c"))


@query("sc4_link_records", "SELECT ccd AS ccd_l, img_id AS ccd_r, count(*) AS n, round(avg(mrow - row), 3) + 0.0 AS dr FROM matched GROUP BY ALL")
def sc4(spark, sf_dir):
    m = P.match(spark, sf_dir)
    line = F.when(C("img_id").isNull(), F.lit("0 1 2")).otherwise(F.format_string("%d %.9f %.9f %d %.9f %.9f %f", "ccd", "row", "col", "img_id", "mrow", "mcol", "score"))
    rows = text.numbered(m.withColumn("value", line), C("ccd").cast("string"), ["pid"])
    return text.link_records(rows).groupBy("ccd_l", "ccd_r").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(C("mrow") - C("row")), 3).alias("dr"))


@query("sc6_mosaic_offsets", "SELECT i::INT AS ccd, coalesce(m.r1, 0) AS r1, coalesce(m.c1, 0) AS c1, m.ccd IS NULL AS missing FROM range(12) t(i) LEFT JOIN tiles m ON m.ccd = i AND m.ccd <> 4")
def sc6(spark, sf_dir):
    m = P.tiles(spark, sf_dir).filter("ccd <> 4").withColumn("value", F.format_string("%d %d %d %d %d", "ccd", "r0", "r1", "c0", "c1"))
    return text.mosaic_offsets(text.numbered(m, F.lit("m"), ["ccd"]), 0, 12).select("ccd", "r1", "c1", "missing")


@query("sc10_xyz_points", "SELECT strip, count(*) AS n, round(avg(z), 4) + 0.0 AS z FROM cloud GROUP BY strip")
def sc10(spark, sf_dir):
    c = P.cloud(spark, sf_dir).withColumn("value", F.concat(F.format_string("%.4f, %.4f ", "x", "y"), F.regexp_replace(F.format_string("%.9e", "z"), "e", "D")))
    rows = text.numbered(c, C("strip"), ["x", "y", "z"])
    return text.xyz_points(rows).groupBy(C("file").alias("strip")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("z"), 4).alias("z"))


@query("sc14_name_pattern", "SELECT pid FROM pt WHERE regexp_full_match('A_RED' || ccd || '_' || (ccd + 1) || '.txt', 'A_RED[0-9]+_[0-9]+\\.txt') AND ccd < 5")
def sc14(spark, sf_dir):
    name = F.when(C("ccd") < 5, F.concat(F.lit("A_RED"), C("ccd"), F.lit("_"), C("ccd") + 1, F.lit(".txt"))).otherwise(F.concat(F.lit("B_RED"), C("ccd"), F.lit(".txt")))
    return P.pt(spark, sf_dir).withColumn("name", name).filter(C("name").rlike(text.name_pattern("A_REDi_i+1.txt"))).select("pid")


@query("sk3_match_lines", "SELECT pid, CASE WHEN img_id IS NULL THEN printf('0 %.6f %.6f', round(row, 3), col) ELSE printf('1 %.6f %.6f %d %.6f %.6f %.6f', round(row, 3), col, img_id, round(mrow, 3), mcol, score) END AS value FROM match")
def sk3(spark, sf_dir):
    thousandths = lambda c: F.round(C(c) * 1000) / 1000  # noqa: E731  as the SQL rounds: ties are those of the product, not of the decimal text
    m = P.match(spark, sf_dir).withColumns({c: thousandths(c) for c in ("row", "mrow")})
    return m.select("pid", sinks.match_line().alias("value"))


@query("pr25_split_and_multiply", "SELECT pid, len(string_split(printf('%d %d %d', pid, ccd, 3), ' ')) AS n, 2 * ccd + 3 * pid AS dot FROM pt")
def pr25(spark, sf_dir):
    d = text.fields(P.pt(spark, sf_dir).select("pid", F.format_string("%d %d %d", "pid", "ccd", F.lit(3)).alias("value")))
    return d.select("pid", F.size("f").cast("long").alias("n"), text.dot_of_fields([(1, 2), (0, 3)]).cast("long").alias("dot"))
