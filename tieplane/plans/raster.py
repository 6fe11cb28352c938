"""Queries on grids with a row per cell."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid, robust
from . import proxies as P
from .points import ON_MOSAIC, on_mosaic
from .proxies import r6
from .registry import query

C = F.col
CELL = 480.0


def cells_of(spark, sf_dir):
    """Best-scored disparity per cell; both axes of a cell are shrunk to the proxy's extents."""
    m = on_mosaic(spark, sf_dir).select("pid", "score", C("R1"), (C("C1") * 30).alias("C1"), (C("C2") - C("C1")).alias("dx"), (C("R2") - C("R1")).alias("dy"))
    return grid.rasterise(m, "R1", "C1", CELL, "score", "pid").select("ir", "ic", "dx", "dy", "score", "pid")


CELLS = ON_MOSAIC + """, cl AS (SELECT round_even(R1 / 480.0, 0)::BIGINT AS ir, round_even(C1 * 30 / 480.0, 0)::BIGINT AS ic, C2 - C1 AS dx, R2 - R1 AS dy, score, pid FROM om
  QUALIFY row_number() OVER (PARTITION BY round_even(R1 / 480.0, 0), round_even(C1 * 30 / 480.0, 0) ORDER BY score DESC, pid DESC) = 1)"""
_OFF = "(SELECT unnest([-1, 0, 1]) AS i)"
INC = CELLS + f""", sp AS (SELECT ir + a.i AS ir, ic + b.i AS ic, dx, dy FROM cl, {_OFF} a, {_OFF} b), nb AS (SELECT ir, ic, count(*) AS n, median(dx) AS mx, median(dy) AS my FROM sp GROUP BY ALL),
inc AS (SELECT cl.*, n, sqrt((dx - mx)*(dx - mx) + (dy - my)*(dy - my)) AS e FROM cl JOIN nb USING (ir, ic))"""


@query("g1_regular_grid", "SELECT ccd, (i * 2100)::INT AS row, (j * 2100)::INT AS col, i * 2100 + 1050.0::DOUBLE AS centre_row, j * 2100 + 1050.0::DOUBLE AS centre_col FROM tiles, range(30) a(i), range(3000) b(j) WHERE i < (r1 - r0) // 2100 AND j < (c1 - c0) * 525 // 2100")
def g1(spark, sf_dir):
    m = P.tiles(spark, sf_dir).select("ccd", (C("r1") - C("r0")).alias("h"), ((C("c1") - C("c0")) * 525).alias("w"))
    return grid.regular_grid(m, "h", "w", 2100).select("ccd", "row", "col", "centre_row", "centre_col")


@query("g2_rasterise_best_score", CELLS + "SELECT ir, ic, pid, round(dx, 6) + 0.0 AS dx, score FROM cl WHERE ir >= 0 AND ic >= 0")
def g2(spark, sf_dir):
    return cells_of(spark, sf_dir).select("ir", "ic", "pid", r6(C("dx")).alias("dx"), "score")


@query("g3_local_inconsistency", INC + "SELECT ir, ic, n, round(e, 5) + 0.0 AS e FROM inc")
def g3(spark, sf_dir):
    return grid.inconsistency(cells_of(spark, sf_dir), "dx", "dy").select("ir", "ic", C("n_window").alias("n"), r6(C("inconsistency"), 5).alias("e"))


_KEPT = INC + """, md AS (SELECT median(e) AS med, count(*) AS cnt FROM inc), ma AS (SELECT median(abs(e - med)) AS mad FROM inc, md),
kept AS (SELECT inc.* FROM inc, md, ma WHERE NOT (cnt >= 8 AND e > CASE WHEN 1.4826 * mad > 1e-12 THEN med + 2.0 * (1.4826 * mad) ELSE med END AND n - 1 >= 3))"""


@query("g4_despike", _KEPT + "SELECT ir, ic, pid FROM kept")
def g4(spark, sf_dir):
    return grid.despike(cells_of(spark, sf_dir), "dx", "dy", k=2.0).select("ir", "ic", "pid")


@query("g4b_points_of_kept_cells", _KEPT + "SELECT pid FROM om WHERE (round_even(R1 / 480.0, 0)::BIGINT, round_even(C1 * 30 / 480.0, 0)::BIGINT) NOT IN (SELECT (ir, ic) FROM cl WHERE (ir, ic) NOT IN (SELECT (ir, ic) FROM kept))")
def g4b(spark, sf_dir):
    cells = cells_of(spark, sf_dir)
    points = on_mosaic(spark, sf_dir).withColumn("C30", C("C1") * 30)
    return grid.points_in_cells(points, grid.despike(cells, "dx", "dy", k=2.0), cells, "R1", "C30", CELL).select("pid")


@query("g5_block_mean", "SELECT floor(ir / 4)::BIGINT AS r, floor(ic / 4)::BIGINT AS c, floor(avg(score))::BIGINT AS score FROM cl GROUP BY ALL".join([CELLS, ""]))
def g5(spark, sf_dir):
    return grid.block_mean(cells_of(spark, sf_dir).select(C("ir").alias("r"), C("ic").alias("c"), "score"), 4, "score")


@query("g6_seam_blend", "SELECT pid, floor((CASE pid % 4 WHEN 0 THEN 0.75 WHEN 1 THEN 0.5 ELSE 0.25 END)::DOUBLE * score + (1.0 - CASE pid % 4 WHEN 0 THEN 0.75 WHEN 1 THEN 0.5 ELSE 0.25 END)::DOUBLE * col)::BIGINT AS blend FROM pt")
def g6(spark, sf_dir):
    return grid.seam_blend(P.pt(spark, sf_dir), C("score"), C("col"), C("pid") % 4).select("pid", "blend")


@query("g8_composite", "WITH px AS (SELECT floor(row / 300)::BIGINT AS r, floor(col / 10)::BIGINT AS c, ccd, max(score) AS v FROM pt GROUP BY ALL) SELECT * FROM px QUALIFY row_number() OVER (PARTITION BY r, c ORDER BY ccd DESC) = 1")
def g8(spark, sf_dir):
    px = P.pt(spark, sf_dir).groupBy(F.floor(C("row") / 300).alias("r"), F.floor(C("col") / 10).alias("c"), "ccd").agg(F.max("score").alias("v"))
    return grid.composite(px, "ccd")


@query("g9_upsample", CELLS + "SELECT ir * 2 + a AS ir, ic * 2 + b AS ic, score FROM cl, range(2) x(a), range(2) y(b)")
def g9(spark, sf_dir):
    return grid.upsample(cells_of(spark, sf_dir).select("ir", "ic", "score"), 2)


_DISK2 = "(SELECT a.i AS i, b.i AS j, a.i * a.i + b.i * b.i AS d2 FROM (SELECT unnest([-2,-1,0,1,2]) AS i) a, (SELECT unnest([-2,-1,0,1,2]) AS i) b WHERE a.i * a.i + b.i * b.i <= 4)"


@query("g9b_dilate", CELLS + f"SELECT ir + i AS ir, ic + j AS ic, d2, score FROM cl, {_DISK2} QUALIFY row_number() OVER (PARTITION BY cl.ir + i, cl.ic + j ORDER BY d2, cl.ir, cl.ic) = 1")
def g9b(spark, sf_dir):
    return grid.dilate(cells_of(spark, sf_dir), 2, ["score"])


@query("g11_closing", CELLS + f", di AS (SELECT DISTINCT ir + i AS ir, ic + j AS ic FROM cl, {_DISK2}) SELECT ir + i AS ir, ic + j AS ic FROM di, {_DISK2} GROUP BY ALL HAVING count(*) = 13")
def g11(spark, sf_dir):
    return grid.close(cells_of(spark, sf_dir).select("ir", "ic"), 2)


@query("g11b_proximity_holes", CELLS + f"SELECT DISTINCT ir + i AS ir, ic + j AS ic FROM cl, {_DISK2} WHERE (ir + i, ic + j) NOT IN (SELECT (ir, ic) FROM cl)")
def g11b(spark, sf_dir):
    return grid.holes_near(cells_of(spark, sf_dir), 2)


@query("g10_inland_holes", "RECURSIVE" + CELLS + """, bx AS (SELECT min(ir) AS r0, max(ir) AS r1, min(ic) AS c0, max(ic) AS c1 FROM cl), ho AS (SELECT i AS ir, j AS ic FROM bx, range(-200, 400) a(i), range(-200, 1200) b(j) WHERE i BETWEEN r0 AND r1 AND j BETWEEN c0 AND c1 AND (i, j) NOT IN (SELECT (ir, ic) FROM cl)),
op AS (SELECT ir, ic FROM ho, bx WHERE ir IN (r0, r1) OR ic IN (c0, c1) UNION SELECT ho.ir, ho.ic FROM op JOIN ho ON (ho.ir = op.ir AND abs(ho.ic - op.ic) = 1) OR (ho.ic = op.ic AND abs(ho.ir - op.ir) = 1))
SELECT ir, ic FROM ho WHERE (ir, ic) NOT IN (SELECT (ir, ic) FROM op)""")
def g10(spark, sf_dir):
    return grid.inland_holes(cells_of(spark, sf_dir))


_DISK4 = "(SELECT a.i AS i, b.i AS j, a.i * a.i + b.i * b.i AS d2 FROM (SELECT unnest(range(-4, 5)) AS i) a, (SELECT unnest(range(-4, 5)) AS i) b WHERE a.i * a.i + b.i * b.i <= 16)"


@query("g12_plane_fill", CELLS + f""", ho AS (SELECT DISTINCT ir + i AS ir, ic + j AS ic FROM cl, {_DISK2} WHERE (ir + i, ic + j) NOT IN (SELECT (ir, ic) FROM cl)),
ne AS (SELECT ir + i AS ir, ic + j AS ic, -i AS r, -j AS c, dx AS z, exp(-d2 / 2.0::DOUBLE) AS w FROM cl, {_DISK4}), s AS (SELECT ir, ic, sum(w) AS w, sum(w*r) AS r, sum(w*c) AS c, sum(w*r*r) AS rr, sum(w*r*c) AS rc, sum(w*c*c) AS cc, sum(w*z) AS z, sum(w*r*z) AS rz, sum(w*c*z) AS cz FROM ne JOIN ho USING (ir, ic) GROUP BY ALL),
d AS (SELECT *, w*(rr*cc - rc*rc) + r*(c*rc - r*cc) + c*(r*rc - c*rr) AS det FROM s WHERE w > 1e-6), p AS (SELECT *, CASE WHEN abs(det) > 1e-12 * power(abs(w)+abs(rr)+abs(cc)+abs(r)+abs(c)+abs(rc)+1e-30, 3) THEN ((rr*cc - rc*rc)*z + (c*rc - r*cc)*rz + (r*rc - c*rr)*cz) / det END AS plane FROM d)
SELECT ir, ic, round(CASE WHEN plane IS NOT NULL AND abs(plane - z / w) <= 10 * (abs(z / w) + 1) THEN plane ELSE z / w END, 3) + 0.0 AS dx FROM p""")
def g12(spark, sf_dir):
    cells = cells_of(spark, sf_dir)
    return grid.plane_fill(cells, grid.holes_near(cells, 2), "dx", 1.0, 4).select("ir", "ic", r6(C("dx"), 3).alias("dx"))


def _filled(v: str) -> str:
    """SQL of the holes filled with the planes of a value, as tables named after it."""
    return f""", ne_{v} AS (SELECT ir + i AS ir, ic + j AS ic, -i AS r, -j AS c, {v} AS z, exp(-d2 / 2.0::DOUBLE) AS w FROM cl, {_DISK4}), s_{v} AS (SELECT ir, ic, sum(w) AS w, sum(w*r) AS r, sum(w*c) AS c, sum(w*r*r) AS rr, sum(w*r*c) AS rc, sum(w*c*c) AS cc, sum(w*z) AS z, sum(w*r*z) AS rz, sum(w*c*z) AS cz FROM ne_{v} JOIN hs USING (ir, ic) GROUP BY ALL),
d_{v} AS (SELECT *, w*(rr*cc - rc*rc) + r*(c*rc - r*cc) + c*(r*rc - c*rr) AS det FROM s_{v} WHERE w > 1e-6), p_{v} AS (SELECT *, CASE WHEN abs(det) > 1e-12 * power(abs(w)+abs(rr)+abs(cc)+abs(r)+abs(c)+abs(rc)+1e-30, 3) THEN ((rr*cc - rc*rc)*z + (c*rc - r*cc)*rz + (r*rc - c*rr)*cz) / det END AS plane FROM d_{v}),
f_{v} AS (SELECT ir, ic, CASE WHEN plane IS NOT NULL AND abs(plane - z / w) <= 10 * (abs(z / w) + 1) THEN plane ELSE z / w END AS {v} FROM p_{v})"""


@query("g13_gap_fill", "RECURSIVE" + CELLS + f""", bx AS (SELECT min(ir) AS r0, max(ir) AS r1, min(ic) AS c0, max(ic) AS c1 FROM cl), ho AS (SELECT i AS ir, j AS ic FROM bx, range(-200, 400) a(i), range(-200, 1200) b(j) WHERE i BETWEEN r0 AND r1 AND j BETWEEN c0 AND c1 AND (i, j) NOT IN (SELECT (ir, ic) FROM cl)),
op AS (SELECT ir, ic FROM ho, bx WHERE ir IN (r0, r1) OR ic IN (c0, c1) UNION SELECT ho.ir, ho.ic FROM op JOIN ho ON (ho.ir = op.ir AND abs(ho.ic - op.ic) = 1) OR (ho.ic = op.ic AND abs(ho.ir - op.ir) = 1)),
di AS (SELECT DISTINCT ir + i AS ir, ic + j AS ic FROM cl, {_DISK2}), co AS (SELECT ir + i AS ir, ic + j AS ic FROM di, {_DISK2} GROUP BY ALL HAVING count(*) = 13),
hs AS (SELECT ir, ic FROM (SELECT ir, ic FROM ho WHERE (ir, ic) NOT IN (SELECT (ir, ic) FROM op) UNION SELECT * FROM di UNION SELECT * FROM co) WHERE (ir, ic) NOT IN (SELECT (ir, ic) FROM cl)){_filled("dx")}{_filled("dy")}
SELECT ir, ic, round(dx, 3) + 0.0 AS dx, round(dy, 3) + 0.0 AS dy, false AS filled FROM cl UNION ALL SELECT ir, ic, round(dx, 3) + 0.0, round(dy, 3) + 0.0, true FROM f_dx JOIN f_dy USING (ir, ic)""")
def g13(spark, sf_dir):
    return grid.gap_fill(cells_of(spark, sf_dir), ["dx", "dy"], 1.0, 2, sparse=True).select("ir", "ic", r6(C("dx"), 3).alias("dx"), r6(C("dy"), 3).alias("dy"), "filled")


@query("g14_dem_resample", """WITH q AS (SELECT pid, row / 600 AS r, col * 0.5 AS c FROM pt), dem AS (SELECT i AS r, j AS c, (i * 31 + j * 17) % 101 * 1.0::DOUBLE AS h FROM range(73) a(i), range(75) b(j)),
o AS (SELECT pid, r, c, round_even(r, 0) + a.i AS rr, round_even(c, 0) + b.i AS cc FROM q, (SELECT unnest([-1,0,1]) AS i) a, (SELECT unnest([-1,0,1]) AS i) b),
w AS (SELECT pid, exp(-((rr - r)*(rr - r) + (cc - c)*(cc - c))) AS w, greatest(0, least(72, rr))::BIGINT AS dr, ((cc::BIGINT % 75) + 75) % 75 AS dc FROM o)
SELECT pid, round(sum(w * h) / sum(w), 6) + 0.0 AS h FROM w JOIN dem ON dr = dem.r AND dc = dem.c GROUP BY pid""")
def g14(spark, sf_dir):
    q = P.pt(spark, sf_dir).select("pid", (C("row") / 600).alias("row"), (C("col") * 0.5).alias("col"))
    dem = spark.range(73).select(C("id").alias("r")).crossJoin(spark.range(75).select(C("id").alias("c"))).withColumn("h", (C("r") * 31 + C("c") * 17) % 101 * 1.0)
    return grid.dem_sample(q, dem, 75, 73, "row", "col", "h").select("pid", r6(C("h")).alias("h"))


@query("g15_cell_buckets", """WITH b AS (SELECT floor((x - min(x) OVER ()) / 25)::BIGINT AS ci, floor((y - min(y) OVER ()) / 10)::BIGINT AS cj, z FROM (SELECT x, y * 0.4 AS y_, y, z FROM cloud)),
g AS (SELECT ci, cj, count(*) AS n, sum(z) AS s FROM b GROUP BY ALL) SELECT ci + i AS hi, cj + j AS hj, sum(n)::BIGINT AS n, round(sum(s) / sum(n), 4) + 0.0 AS z FROM g, (SELECT unnest([-1,0,1]) AS i), (SELECT unnest([-1,0,1]) AS j) GROUP BY ALL""")
def g15(spark, sf_dir):
    cloud = P.cloud(spark, sf_dir).select("x", (C("y") * 2.5).alias("y"), "z")
    counts = grid.buckets(cloud, "x", "y", 25.0).groupBy("ci", "cj").agg(F.count(F.lit(1)).alias("n"), F.sum("z").alias("s"))  # before the halo, so cells move and not points
    return grid.halo(counts, 1).groupBy("hi", "hj").agg(F.sum("n").alias("n"), r6(F.sum("s") / F.sum("n"), 4).alias("z"))


@query("w3_focal_median", CELLS + f", sp AS (SELECT ir + a.i AS ir, ic + b.i AS ic, dx FROM cl, {_OFF} a, {_OFF} b) SELECT ir, ic, count(*) AS n, round(median(dx), 6) + 0.0 AS med FROM sp WHERE (ir, ic) IN (SELECT (ir, ic) FROM cl) GROUP BY ALL")
def w3(spark, sf_dir):
    return grid.focal_median(cells_of(spark, sf_dir), ["dx"]).select("ir", "ic", C("n_window").alias("n"), r6(C("dx_median")).alias("med"))


@query("ag5b_grid_metrics", INC + """, k AS (SELECT median(e) AS med FROM inc), a AS (SELECT median(abs(e - med)) AS mad FROM inc, k)
SELECT count(*) AS n_cells, round(count(*) * 100.0 / ((max(ir) + 1) * (max(ic) + 1)), 6) + 0.0::DOUBLE AS coverage, round(median(e), 5) + 0.0 AS inc_median, round(quantile_cont(e, 0.95), 5) + 0.0 AS inc_p95, round(avg(CASE WHEN abs(e - med) > 3 * (1.4826 * mad) THEN 1.0 ELSE 0.0 END) * 100, 6) + 0.0 AS inc_outlier_pct FROM inc, k, a""")
def ag5b(spark, sf_dir):
    inc = grid.inconsistency(cells_of(spark, sf_dir), "dx", "dy").withColumnRenamed("inconsistency", "e")
    s = robust.mad_stats(inc, [], "e").select("outlier_pct")
    cover = F.count(F.lit(1)) * 100.0 / ((F.max("ir") + 1) * (F.max("ic") + 1))
    m = inc.agg(F.count(F.lit(1)).alias("n_cells"), r6(cover).alias("coverage"))
    q = robust.quantile_row(inc, {"inc_median": ("e", 0.5), "inc_p95": ("e", 0.95)}).select(r6(C("inc_median"), 5).alias("inc_median"), r6(C("inc_p95"), 5).alias("inc_p95"))
    return m.join(F.broadcast(s)).join(F.broadcast(q)).select("n_cells", "coverage", "inc_median", "inc_p95", r6(C("outlier_pct")).alias("inc_outlier_pct"))
