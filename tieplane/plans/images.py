"""Queries on rasters: lines of tiles written to files and read back, and their grey values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import detect
from ..operators.joins import ranked_by_ranges
from ..sources import raster
from ..sources.shared import fresh_path
from . import proxies as P
from .registry import query

C = F.col


def tile_lines(spark, sf_dir) -> DataFrame:
    """A tile per label, a line per vector in order of its id, samples stretched over the tile's range: tile, row, v."""
    samples = P.patches(spark, sf_dir)
    span = raster.byte_range(samples.select("ccd", F.explode("patch").alias("x")), "x", ["ccd"])
    named = ranked_by_ranges(samples, ["ccd"], ["pid"], "row").join(span, "ccd")
    low, high = C("low").cast("double"), C("high").cast("double")
    return named.select(C("ccd").alias("tile"), "row", F.transform("patch", lambda x: raster.to_byte(x.cast("double"), low, high)).alias("v"))


LINES = """WITH sp AS (SELECT ccd, min(x)::DOUBLE AS lo, max(x)::DOUBLE AS hi FROM (SELECT ccd, unnest(patch) AS x FROM patches) WHERE abs(x) < 10000 GROUP BY ccd),
ln AS (SELECT ccd AS tile, row_number() OVER (PARTITION BY ccd ORDER BY pid) - 1 AS row, list_transform(patch, lambda x: floor(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (x::DOUBLE - lo) / (hi - lo))) * 255.0::DOUBLE)::INT) AS v FROM patches JOIN sp USING (ccd))"""


def written(spark, sf_dir) -> DataFrame:
    raster.register(spark)
    path = fresh_path(spark, "raster")
    lines = tile_lines(spark, sf_dir)
    raster.write_lines(lines.select("tile", "row", raster.pixels_of(C("v")).alias("pixels")), path, strip=16)
    return spark.read.format("raster").load(path)


@query("sc15_raster_strips", LINES + " SELECT tile, row, array_to_string(v, ',') AS samples FROM ln WHERE tile IN (1, 4, 7) AND row >= 5 AND row < 40")
def sc15(spark, sf_dir):
    some = written(spark, sf_dir).filter(C("tile").isin(1, 4, 7) & (C("row") >= 5) & (C("row") < 40))
    return some.select("tile", "row", F.array_join(raster.values_of(C("pixels")).cast("array<string>"), ",").alias("samples"))


@query("sk8_raster_round_trip", LINES + " SELECT tile, row, len(v) AS n, list_sum(v)::BIGINT AS total, list_sum(list_transform(range(len(v)), lambda i: (i + 1) * v[i + 1]))::BIGINT AS placed FROM ln")
def sk8(spark, sf_dir):
    v = raster.values_of(C("pixels"))
    back = written(spark, sf_dir).select("tile", "row", v.alias("v"))
    total = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x)
    placed = F.aggregate(F.transform("v", lambda x, i: (i + 1) * x), F.lit(0).cast("long"), lambda s, x: s + x)
    return back.select("tile", "row", F.size("v").cast("long").alias("n"), total.alias("total"), placed.alias("placed"))


@query("pr27_stripe_repair", LINES + """, px AS (SELECT tile, row, i AS col, (CASE WHEN i % 16 = 7 THEN 255 - v[i + 1] ELSE (v[i + 1] + i) // 2 END)::DOUBLE AS v FROM ln, range(64) t(i)),
sp2 AS (SELECT tile, min(v) AS lo, max(v) AS hi FROM px WHERE col BETWEEN 1 AND 62 GROUP BY tile),
st AS (SELECT a.tile, a.col, avg(abs(a.v - l.v)) AS sl, avg(abs(a.v - r.v)) AS sr FROM px a JOIN px l ON (l.tile, l.row, l.col) = (a.tile, a.row, a.col - 1) JOIN px r ON (r.tile, r.row, r.col) = (a.tile, a.row, a.col + 1) GROUP BY ALL),
bad AS (SELECT tile, col FROM st JOIN sp2 USING (tile) WHERE least(sl, sr) >= (hi - lo) / 50),
me AS (SELECT b.tile, d.row, b.col, floor(sum(d.v * w) / sum(w)) AS m FROM bad b, (VALUES (-2, 1), (-1, 2), (1, 2), (2, 1)) o(d, w), px d WHERE d.tile = b.tile AND d.col = b.col + o.d GROUP BY ALL),
fx AS (SELECT px.tile, px.row, px.col, coalesce(m, v) AS v, lo, hi FROM px JOIN sp2 USING (tile) LEFT JOIN me USING (tile, row, col))
SELECT tile, row, col, floor(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (v - lo) / (hi - lo))) * 255.0::DOUBLE)::INT AS v FROM fx""")
def pr27_stripes(spark, sf_dir):
    px = tile_lines(spark, sf_dir).select("tile", "row", F.posexplode("v").alias("col", "v"))
    px = px.withColumn("v", F.when(C("col") % 16 == 7, 255 - C("v")).otherwise(F.floor((C("v") + C("col")) / 2)))
    return raster.repair_stripes(px).select("tile", "row", C("col").cast("long").alias("col"), "v")


#: Deviations and radii of the scales that small tiles leave room for.
_FIRST, _LEVELS = 0.5, 2
_BLURS = [(k, 0.5 * 2.0 ** (k / 3), detect.scale_radius(k, 0.5)) for k in range(_LEVELS + 3)]


def small_tiles(spark, sf_dir):
    """Each vector as the lines of an image of eight by eight samples."""
    d = P.patches(spark, sf_dir).select(C("pid").alias("image"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice("patch", r * 8 + 1, 8))).alias("row", "samples"))
    return d.select("image", C("row").cast("long").alias("row"), C("samples").cast("array<double>").alias("samples"))


_PX = "px AS (SELECT pid AS image, i // 8 AS row, i % 8 AS col, patch[i + 1]::DOUBLE AS v FROM patches, range(64) t(i))"


@query("z11_scale_extrema", f"""WITH {_PX}, sc(k, s, rad) AS (VALUES {", ".join(f"({k}, {s!r}::DOUBLE, {r})" for k, s, r in _BLURS)}),
bl AS (SELECT a.image, a.row, a.col, k, sum(exp(-0.5 * (power((b.row - a.row) / s, 2) + power((b.col - a.col) / s, 2))) * b.v) / sum(exp(-0.5 * (power((b.row - a.row) / s, 2) + power((b.col - a.col) / s, 2)))) AS v FROM px a JOIN px b USING (image), sc WHERE abs(b.row - a.row) <= rad AND abs(b.col - a.col) <= rad GROUP BY ALL),
df AS (SELECT x.image, x.row, x.col, x.k, y.v - x.v AS v FROM bl x JOIN bl y ON (y.image, y.row, y.col, y.k) = (x.image, x.row, x.col, x.k + 1)),
ne AS (SELECT a.image, a.row, a.col, a.k, a.v, count(*) AS n, max(b.v) AS hi, min(b.v) AS lo FROM df a JOIN df b ON a.image = b.image AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND abs(a.k - b.k) <= 1 AND (a.row, a.col, a.k) <> (b.row, b.col, b.k) WHERE a.k BETWEEN 1 AND {_LEVELS} GROUP BY ALL)
SELECT image, row::BIGINT AS row, col::BIGINT AS col, k::INT AS level, round(v, 6) + 0.0 AS value FROM ne WHERE n = 26 AND abs(v) >= 0.01 AND (v > hi OR v < lo)""")
def z11(spark, sf_dir):
    found = detect.scale_extrema(small_tiles(spark, sf_dir), least=0.01, first=_FIRST, levels=_LEVELS, size=8)
    return found.select("image", "row", "col", "level", F.round("value", 6).alias("value"))


@query("z11b_interest_points", f"""WITH {_PX}, g AS (SELECT a.image, a.row, a.col, d.v - a.v AS u, r.v - b.v AS w FROM px a JOIN px d ON (d.image, d.row, d.col) = (a.image, a.row + 1, a.col + 1) JOIN px r ON (r.image, r.row, r.col) = (a.image, a.row, a.col + 1) JOIN px b ON (b.image, b.row, b.col) = (a.image, a.row + 1, a.col)),
s AS (SELECT a.image, a.row, a.col, count(*) AS n, sum(b.u * b.u) AS uu, sum(b.u * b.w) AS uw, sum(b.w * b.w) AS ww FROM g a JOIN g b ON a.image = b.image AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY ALL),
q AS (SELECT image, row, col, CASE WHEN uu + ww > 0 THEN (uu * ww - uw * uw) / (uu + ww) ELSE 0 END AS w, CASE WHEN uu + ww > 0 THEN 4 * (uu * ww - uw * uw) / power(uu + ww, 2) ELSE 0 END AS q FROM s WHERE n = 9), m AS (SELECT image, avg(w) AS mean FROM q GROUP BY image),
p AS (SELECT a.image, a.row, a.col, a.w, a.q, coalesce(bool_and(CASE WHEN (b.row, b.col) < (a.row, a.col) THEN a.w > b.w ELSE a.w >= b.w END), true) AS top FROM q a LEFT JOIN q b ON a.image = b.image AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND (a.row, a.col) <> (b.row, b.col) GROUP BY ALL)
SELECT p.image, row::BIGINT AS row, col::BIGINT AS col, round(w, 6) + 0.0 AS weight FROM p JOIN m USING (image) WHERE top AND q >= 0.75 AND w >= mean""")
def z11b(spark, sf_dir):
    return detect.interest_points(small_tiles(spark, sf_dir), half=1, size=8).select("image", "row", "col", F.round("weight", 6).alias("weight"))


_PLACE = {"row": "(pid % 97) * 10.0", "col": "floor(pid / 97) * 10.0"}


@query("m1_pyramid_match", "SELECT ccd, pid, pid AS rid, (pid % 97) * 10.0::DOUBLE + 5 AS mrow, floor(pid / 97) * 10.0::DOUBLE - 3 AS mcol, 1.0::DOUBLE AS score FROM patches")
def m1(spark, sf_dir):
    """Vectors as patches, moved by a known shift: two levels, each found again where it went."""
    from ..operators import matching
    from ..sources.shared import held

    p = P.patches(spark, sf_dir).select("ccd", "pid", F.expr(_PLACE["row"]).cast("double").alias("row"), F.expr(_PLACE["col"]).cast("double").alias("col"), C("patch").cast("array<double>").alias("patch"))
    four = lambda i: (2 * F.floor(i / 4) * 8 + 2 * (i % 4) + 1).cast("int")
    at = lambda i, k: F.get("patch", four(i) - 1 + k)
    coarse = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (at(i, 0) + at(i, 1) + at(i, 8) + at(i, 9)) / 4.0)
    levels = {}
    for level, patch in ((0, C("patch")), (1, coarse)):
        left = p.select("ccd", "pid", (C("row") / 2.0**level).alias("row"), (C("col") / 2.0**level).alias("col"), patch.alias("lpatch"))
        right = p.select("ccd", C("pid").alias("rid"), ((C("row") + 5) / 2.0**level).alias("rrow"), ((C("col") - 3) / 2.0**level).alias("rcol"), patch.alias("rpatch"))
        levels[level] = (left, right)
    found, _ = matching.pyramid_match(levels, ["ccd"], held, reach=8.0)
    return found.select("ccd", "pid", "rid", P.r6(C("mrow")).alias("mrow"), P.r6(C("mcol")).alias("mcol"), P.r6(C("score")).alias("score"))


@query("m2_refine_iteratively")
def m2(spark, sf_dir):
    """Matches that two rounds of affine gate and neighbourhood filter leave."""
    from ..operators import matching
    from ..sources.shared import held

    kept = matching.refine_iteratively(P.matched(spark, sf_dir).select("ccd", "pid", "row", "col", "mrow", "mcol"), ["ccd"], 2, held)
    return kept.select("ccd", "pid", P.r6(C("mrow")).alias("mrow"), P.r6(C("mcol")).alias("mcol"))


_NEAREST = """WITH d AS (SELECT q.vec_id AS id, r.vec_id AS rid, round(list_sum(list_transform(range(64), lambda i: power(q.embedding[i + 1]::DOUBLE - r.embedding[i + 1]::DOUBLE, 2))), 6) AS d2 FROM embeddings q, embeddings r WHERE q.vec_id % 50 = 0 AND r.vec_id <> q.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, rid) AS rank FROM d)"""


@query("h6_nearest_descriptors", _NEAREST + " SELECT id, rid, rank::INT AS rank, d2 + 0.0 AS d2 FROM k WHERE rank <= 2")
def h6(spark, sf_dir):
    """The stated queries, ids divisible by 50, against all rows."""
    from ..operators import descriptors

    rows = P.table(spark, sf_dir, "embeddings").select(C("vec_id").alias("id"), C("embedding").alias("v"))
    return descriptors.nearest_descriptors(rows.filter("id % 50 = 0"), rows)


@query("m9_ratio_matches", _NEAREST + " SELECT a.id, a.rid, a.d2 + 0.0 AS d2 FROM k a JOIN k b ON a.id = b.id AND a.rank = 1 AND b.rank = 2 AND a.d2 < 0.9::DOUBLE * 0.9 * b.d2")
def m9(spark, sf_dir):
    from ..operators import descriptors

    rows = P.table(spark, sf_dir, "embeddings").select(C("vec_id").alias("id"), C("embedding").alias("v"))
    return descriptors.distinct_matches(descriptors.nearest_descriptors(rows.filter("id % 50 = 0"), rows), 0.9)
