"""Queries that join points by place, rank, key or time, upserts, and neighbourhood filters."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import geometry as geo
from ..operators import diff, fit, joins, matching, neighbours, robust, upsert
from ..operators.observations import settled
from . import proxies as P
from .points import _AC, _AR, AFFINE
from .proxies import r6
from .registry import query

C = F.col


def _right(spark, sf_dir):
    return P.matched(spark, sf_dir).select("ccd", C("pid").alias("rid"), C("mrow").alias("rrow"), C("mcol").alias("rcol"), C("score").alias("rscore"))


@query("j3_band_argmax", f"""WITH p AS (SELECT l.pid, r.pid AS rid, r.score FROM matched l JOIN matched r ON l.ccd = r.ccd AND abs({_AR.replace('row', 'l.row').replace('col', 'l.col')} - r.mrow) < 60 AND abs({_AC.replace('row', 'l.row').replace('col', 'l.col')} - r.mcol) < 30)
SELECT pid, rid, score FROM p WHERE score >= 5 QUALIFY row_number() OVER (PARTITION BY pid ORDER BY score DESC, rid) = 1""")
def j3(spark, sf_dir):
    pr, pc = geo.affine(AFFINE, C("row"), C("col"))
    left = P.matched(spark, sf_dir).select("ccd", "pid", pr.alias("pr"), pc.alias("pc"))
    pairs = joins.band_join(left, _right(spark, sf_dir), ("pr", "pc"), ("rrow", "rcol"), 60.0, 30.0, ["ccd"])
    return joins.argmax_pairs(pairs, ["pid"], "rscore", 5.0, ["rid"]).select("pid", "rid", C("rscore").alias("score"))


def _seeds(spark, sf_dir):
    return P.matched(spark, sf_dir).select("ccd", C("pid").alias("sid"), C("row").alias("srow"), C("col").alias("scol"), (C("mrow") - C("row")).alias("dr"), (C("mcol") - C("col")).alias("dc"))


_D2 = "(l.row - s.row) * (l.row - s.row) + (l.col - s.col) * (l.col - s.col)"


_FIELD = """fc AS (SELECT floor(row / 250)::BIGINT AS tr, floor(col / 50)::BIGINT AS tc, avg(row) AS cr, avg(col) AS cc, avg(mrow) AS mr, avg(mcol) AS mc FROM matched GROUP BY ALL),
fd AS (SELECT fc.*, row - cr AS x, col - cc AS y, mrow - mr AS u, mcol - mc AS v FROM matched JOIN fc ON floor(row / 250)::BIGINT = tr AND floor(col / 50)::BIGINT = tc),
fs AS (SELECT tr, tc, cr, cc, mr, mc, count(*) AS n, sum(x*x) AS xx, sum(x*y) AS xy, sum(y*y) AS yy, sum(x*u) AS xu, sum(y*u) AS yu, sum(x*v) AS xv, sum(y*v) AS yv FROM fd GROUP BY ALL),
ff AS (SELECT *, CASE WHEN xx*yy - xy*xy > 1e-9 * xx * yy THEN xx*yy - xy*xy END AS det FROM fs WHERE n >= 12),
fa AS (SELECT tr, tc, (xu*yy - yu*xy) / det AS f0, (yu*xx - xu*xy) / det AS f1, mr - (xu*yy - yu*xy) / det * cr - (yu*xx - xu*xy) / det * cc AS f2, (xv*yy - yv*xy) / det AS f3, (yv*xx - xv*xy) / det AS f4, mc - (xv*yy - yv*xy) / det * cr - (yv*xx - xv*xy) / det * cc AS f5 FROM ff WHERE det IS NOT NULL),
fp0 AS (SELECT m.ccd, pid, """ + f"{_AR} AS gr, {_AC} AS gc" + """, f0*row + f1*col + f2 AS lr, f3*row + f4*col + f5 AS lc FROM matched m LEFT JOIN fa ON floor(row / 250)::BIGINT = tr AND floor(col / 50)::BIGINT = tc),
fp1 AS (SELECT ccd, pid, coalesce(abs(lr - gr) <= 32 AND abs(lc - gc) <= 32, false) AS local, gr, gc, lr, lc FROM fp0), fq AS (SELECT ccd, pid, local, CASE WHEN local THEN lr ELSE gr END AS pr, CASE WHEN local THEN lc ELSE gc END AS pc FROM fp1)"""


@query("j4_field_guided_match", "WITH " + _FIELD + """, c AS (SELECT fq.*, r.pid AS rid, r.score FROM fq JOIN matched r ON fq.ccd = r.ccd AND abs(pr - r.mrow) < 16 AND abs(pc - r.mcol) < 8 WHERE r.score >= 5)
SELECT pid, local, rid, score FROM c QUALIFY row_number() OVER (PARTITION BY pid ORDER BY score DESC, rid) = 1""")
def j4(spark, sf_dir):
    m = P.matched(spark, sf_dir)
    tiled = m.withColumns({"tile_r": F.floor(C("row") / 250), "tile_c": F.floor(C("col") / 50)})
    field = robust.solve_affine(tiled, ["tile_r", "tile_c"], "row", "col", "mrow", "mcol").filter("n >= 12 AND f0 IS NOT NULL")
    out = matching.match_by_field(m.select("ccd", "pid", "row", "col"), _right(spark, sf_dir), ["ccd"], field, list(AFFINE), 250.0, 50.0, 8.0, 5.0, score="rscore")
    return out.select("pid", "local", "rid", "score")


@query("j5_rematch_features", f"""WITH un AS (SELECT pid, ccd, row, col FROM match WHERE img_id IS NULL), a0 AS (SELECT u.pid, (u.row - s.row)*(u.row - s.row) + (u.col - s.col)*(u.col - s.col) AS d2, s.mrow - s.row AS dr, s.mcol - s.col AS dc FROM un u JOIN matched s ON u.ccd = s.ccd WHERE (u.row - s.row)*(u.row - s.row) + (u.col - s.col)*(u.col - s.col) < 10000),
g AS (SELECT pid, count(*) AS n, sum(1.0 / (d2 + 1.0) * dr) / sum(1.0 / (d2 + 1.0)) AS dr, sum(1.0 / (d2 + 1.0) * dc) / sum(1.0 / (d2 + 1.0)) AS dc FROM a0 GROUP BY pid),
p AS (SELECT un.pid, ccd, coalesce(n >= 3, false) AS local, CASE WHEN coalesce(n >= 3, false) THEN row + dr ELSE {_AR} END AS pr, CASE WHEN coalesce(n >= 3, false) THEN col + dc ELSE {_AC} END AS pc FROM un LEFT JOIN g ON un.pid = g.pid)
SELECT p.pid, r.pid AS rid, r.score FROM p JOIN matched r ON p.ccd = r.ccd AND abs(pr - r.mrow) < CASE WHEN local THEN 32 ELSE 64 END AND abs(pc - r.mcol) < CASE WHEN local THEN 16 ELSE 32 END WHERE r.score >= 5 QUALIFY row_number() OVER (PARTITION BY p.pid ORDER BY r.score DESC, r.pid) = 1""")
def j5(spark, sf_dir):
    m = P.match(spark, sf_dir)
    affines = P.mosaic(spark).select("ccd", *(F.lit(float(x)).alias(f) for f, x in zip(fit.AFFINE, AFFINE, strict=True)))
    un = m.filter("img_id IS NULL").select("ccd", "pid", "row", "col")
    out = matching.rematch_features(un, P.matched(spark, sf_dir), _right(spark, sf_dir), affines, ["ccd"], 100.0, 16.0, 32.0, 3, 5.0, score="rscore")
    return out.select("pid", "rid", "score")


@query("u2_cross_strip_upsert", """WITH h AS (SELECT pid, (img_id + 1) % 10 AS img_id, mrow * 1.01 + 3 AS mrow, CASE k % 3 WHEN 0 THEN score WHEN 1 THEN score + 1 ELSE score - 1 END AS score FROM matched UNION ALL SELECT pid, 4, row, 0.5 FROM match WHERE img_id IS NULL AND k % 2 = 0)
SELECT m.pid, CASE WHEN h.pid IS NULL OR m.score >= h.score THEN m.img_id ELSE h.img_id END AS img_id, round(CASE WHEN h.pid IS NULL OR m.score >= h.score THEN m.mrow ELSE h.mrow END, 3) + 0.0 AS mrow, round(CASE WHEN h.pid IS NULL OR m.score >= h.score THEN m.score ELSE h.score END, 6) + 0.0 AS score FROM match m LEFT JOIN h ON m.pid = h.pid""")
def u2(spark, sf_dir):
    """What is there stays when its score is as high."""
    m = P.match(spark, sf_dir)
    step = F.when(C("k") % 3 == 0, 0.0).when(C("k") % 3 == 1, 1.0).otherwise(-1.0)
    hits = m.filter("img_id IS NOT NULL").select("pid", ((C("img_id") + 1) % 10).cast("int").alias("img_id"), (C("mrow") * 1.01 + 3).alias("mrow"), (C("score") + step).alias("score"))
    hits = hits.unionByName(m.filter("img_id IS NULL AND k % 2 = 0").select("pid", F.lit(4).alias("img_id"), C("row").alias("mrow"), F.lit(0.5).alias("score")))
    out = upsert.upsert_by_score(m.select("pid", "img_id", "mrow", "score"), hits, ["pid"], ["img_id", "mrow", "score"], "score", "img_id")
    return out.select("pid", "img_id", r6(C("mrow"), 3).alias("mrow"), r6(C("score")).alias("score"))


_PHASES = f"""dp AS (SELECT l.pid, s.pid AS sid, (l.row - s.row)*(l.row - s.row) + (l.col - s.col)*(l.col - s.col) AS d2, s.mrow - s.row AS vr, s.mcol - s.col AS vc FROM src l, ctl s),
dr AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY d2, vr, vc, sid) AS rk FROM dp), dw AS (SELECT *, greatest(exp(-d2 / 1800.0), 1e-6) AS w FROM dr WHERE rk <= 24 AND (d2 <= 3600 OR rk <= 5)),
dm AS (SELECT pid, sum(w * vr) / sum(w) AS mr, sum(w * vc) / sum(w) AS mc, sum(w) AS sw FROM dw GROUP BY pid HAVING count(*) >= 3),
ds AS (SELECT pid, any_value(mr) AS mr, any_value(mc) AS mc, greatest(sqrt(greatest(sum(w * (vr - mr) * (vr - mr)) / any_value(sw), 1.0)), 8.0) AS sr, greatest(sqrt(greatest(sum(w * (vc - mc) * (vc - mc)) / any_value(sw), 1.0)), 8.0) AS sc FROM dw JOIN dm USING (pid) GROUP BY pid),
pl AS (SELECT src.pid, {_AR} AS ar, {_AC} AS ac, CASE WHEN mr IS NOT NULL THEN row + mr ELSE {_AR} END AS pr, CASE WHEN mr IS NOT NULL THEN col + mc ELSE {_AC} END AS pc,
  CASE WHEN mr IS NOT NULL THEN greatest(4, least(30, floor(3.0 * sr + 0.5))) ELSE 96 END AS rr, CASE WHEN mr IS NOT NULL THEN greatest(4, least(30, floor(3.0 * sc + 0.5))) ELSE 96 END AS rc FROM src LEFT JOIN ds USING (pid)),
tb AS (SELECT pl.*, m.ccd, pr >= r0 AND pr <= r1 AND pc >= c0 AND pc <= c1 AS t1, pr + rr >= r0 AND pr - rr <= r1 AND pc + rc >= c0 AND pc - rc <= c1 AS t2, power(greatest(r0 - pr, pr - r1, 0), 2) + power(greatest(c0 - pc, pc - c1, 0), 2) AS far FROM pl, mosaic m),
tk AS (SELECT *, CASE WHEN t1 THEN 1 WHEN t2 THEN 2 ELSE 3 END AS tier, row_number() OVER (PARTITION BY pid ORDER BY far, ccd) AS rk FROM tb), tz AS (SELECT *, min(tier) OVER (PARTITION BY pid) AS best FROM tk), ca1 AS (SELECT * FROM tz WHERE tier = best AND (tier < 3 OR rk = 1)),
h1 AS (SELECT ca1.pid, ca1.ccd AS tile, r.pid AS rid, r.score FROM ca1 JOIN dst r ON r.tile = ca1.ccd AND abs(r.row - pr) <= rr AND abs(r.col - pc) <= rc), b1 AS (SELECT * FROM (SELECT pid, tile, max(score) AS score FROM h1 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY pid ORDER BY score DESC, tile) = 1),
h2 AS (SELECT pl.pid, r.tile, max(r.score) AS score FROM pl JOIN dst r ON abs(r.row - ar) <= greatest(rr, 100) AND abs(r.col - ac) <= greatest(rc, 100) WHERE pl.pid NOT IN (SELECT pid FROM b1 WHERE score >= 58) GROUP BY ALL),
b2 AS (SELECT * FROM (SELECT * FROM h2 UNION ALL SELECT pid, tile, score FROM b1 WHERE score < 58) WHERE score >= 58 QUALIFY row_number() OVER (PARTITION BY pid ORDER BY score DESC, tile) = 1)"""


@query("j12_two_phase_match", "WITH src AS (SELECT pid, row, col FROM pt WHERE ccd < 4), ctl AS (SELECT pid, row, col, mrow, mcol FROM matched WHERE k > 90), dst AS (SELECT pid, img_id AS tile, mrow AS row, mcol AS col, score FROM matched), " + _PHASES + """
SELECT pid, tile, score, false AS retried FROM b1 WHERE score >= 58 UNION ALL SELECT pid, tile, score, true FROM b2""")
def j12(spark, sf_dir):
    """On points: what a search in a tile would score is the best score of the tile's points within reach."""
    m = P.matched(spark, sf_dir)
    src = P.pt(spark, sf_dir).filter("ccd < 4").select("pid", "row", "col")
    dst = m.select(C("img_id").alias("tile"), C("mrow").alias("rrow"), C("mcol").alias("rcol"), "score")
    places = matching.cross_strip_places(src, m.filter("k > 90").select("row", "col", "mrow", "mcol"), list(AFFINE), 4, 60.0)

    def find(d):
        near = joins.band_join(d.select("pid", "tile", "pr", "pc", "reach_r", "reach_c"), dst, ("pr", "pc"), ("rrow", "rcol"), 101.0, 101.0, ["tile"])
        hit = near.filter((F.abs(C("rrow") - C("pr")) <= C("reach_r")) & (F.abs(C("rcol") - C("pc")) <= C("reach_c")))
        return hit.groupBy("pid", "tile").agg(F.max("score").alias("score"))

    return matching.in_two_phases(places, P.mosaic(spark), find, 58.0, wide=100).select("pid", "tile", "score", "retried")


@query("j6_knn_prediction", f"""WITH p AS (SELECT l.pid, {_D2} AS d2, s.mrow - s.row AS dr, s.mcol - s.col AS dc, row_number() OVER (PARTITION BY l.pid ORDER BY {_D2}, s.pid) AS rk FROM pt l JOIN matched s ON l.ccd = s.ccd)
SELECT pid, count(*) AS k, round(sum(1.0 / (d2 + 1.0) * dr) / sum(1.0 / (d2 + 1.0)), 6) + 0.0 AS dr, round(sum(1.0 / (d2 + 1.0) * dc) / sum(1.0 / (d2 + 1.0)), 6) + 0.0 AS dc FROM p WHERE rk <= 5 GROUP BY pid""")
def j6(spark, sf_dir):
    near = joins.knn_join(P.pt(spark, sf_dir), _seeds(spark, sf_dir), ("row", "col"), ("srow", "scol"), 5, ["pid"], ["d2", "sid"], ["ccd"])
    w = geo.inverse_square(C("d2"))
    return near.groupBy("pid").agg(F.count(F.lit(1)).alias("k"), r6(robust.weighted_mean(C("dr"), w)).alias("dr"), r6(robust.weighted_mean(C("dc"), w)).alias("dc"))


def _moments(spark, sf_dir, radius, values=("dr", "dc"), weigh=None):
    """Matched points, and the sums over their neighbours in the tile."""
    l, seeds, at = P.matched(spark, sf_dir), _seeds(spark, sf_dir), (("row", "col"), ("srow", "scol"), radius, ("pid", "sid"), list(values))
    return l, neighbours.radius_weighted(l, seeds, *at, weigh, ["ccd"]) if weigh else neighbours.radius_moments(l, seeds, *at, ["ccd"])


def _near(spark, sf_dir, radius, closed=False):
    l = P.matched(spark, sf_dir)
    pairs = joins.radius_join(l.select("ccd", "pid", "row", "col"), _seeds(spark, sf_dir), ("row", "col"), ("srow", "scol"), radius, ["ccd"], closed)
    return l, pairs.filter("pid <> sid")


_NEAR = "JOIN matched s ON l.ccd = s.ccd AND l.pid <> s.pid AND " + _D2


@query("j7_radius_neighbours", f"SELECT l.pid, count(*) AS n, round(avg(s.mrow - s.row) + 1e-9, 6) + 0.0 AS dr FROM matched l {_NEAR} < 10000 GROUP BY l.pid")
def j7(spark, sf_dir):
    return _moments(spark, sf_dir, 100.0, ["dr"])[1].select("pid", "n", r6(C("m_dr") + 1e-9).alias("dr"))


@query("j9_adaptive_neighbours", f"""WITH p AS (SELECT l.pid, {_D2} AS d2, s.mrow - s.row AS dr, row_number() OVER (PARTITION BY l.pid ORDER BY {_D2}, s.pid) AS rk FROM matched l JOIN matched s ON l.ccd = s.ccd AND l.pid <> s.pid),
w AS (SELECT *, greatest(exp(-d2 / 20000.0), 1e-6) AS w FROM p WHERE rk <= 24 AND (d2 <= 40000 OR rk <= 5)), m AS (SELECT pid, sum(w * dr) / sum(w) AS mean, count(*) AS n, sum(w) AS sw FROM w GROUP BY pid HAVING count(*) >= 3)
SELECT pid, any_value(n) AS n, round(any_value(mean), 6) + 0.0 AS mean, round(greatest(sqrt(greatest(sum(w * (dr - mean) * (dr - mean)) / any_value(sw), 1.0)), 8.0), 6) + 0.0 AS sigma FROM w JOIN m USING (pid) GROUP BY pid""")
def j9(spark, sf_dir):
    seeds = _seeds(spark, sf_dir)
    l = P.matched(spark, sf_dir).select("ccd", "pid", "row", "col")
    nearest = joins.knn_join(l, seeds, ("row", "col"), ("srow", "scol"), 25, ["pid"], ["d2", "sid"], ["ccd"]).drop("rk").filter("pid <> sid")  # a point is its own nearest
    near = joins.adaptive_neighbours(nearest, ["pid"], 200.0, 5, 24, ["d2", "sid"]).withColumn("w", F.greatest(F.exp(-C("d2") / 20000.0), F.lit(1e-6)))
    mean = near.groupBy("pid").agg(F.count(F.lit(1)).alias("n"), robust.weighted_mean(C("dr"), C("w")).alias("mean"), F.sum("w").alias("sw")).filter("n >= 3")
    d = near.join(mean, "pid")
    var = F.sum(C("w") * (C("dr") - C("mean")) * (C("dr") - C("mean"))) / F.max("sw")
    return d.groupBy("pid").agg(F.max("n").alias("n"), r6(F.max("mean")).alias("mean"), r6(F.greatest(F.sqrt(F.greatest(var, F.lit(1.0))), F.lit(8.0))).alias("sigma"))


@query("j10_nearest_64_in_radius", f"""WITH p AS (SELECT l.pid, {_D2} AS d2, s.mrow - s.row AS dr, row_number() OVER (PARTITION BY l.pid ORDER BY {_D2}, s.pid) AS rk FROM pt l JOIN matched s ON l.ccd = s.ccd WHERE {_D2} <= 2250000)
SELECT pid, count(*) AS n, round(sum(exp(-sqrt(d2) / 400.0) * dr) / sum(exp(-sqrt(d2) / 400.0)), 6) + 0.0 AS dr FROM p WHERE rk <= 64 GROUP BY pid HAVING count(*) >= 3""")
def j10(spark, sf_dir):
    near = joins.knn_join(P.pt(spark, sf_dir), _seeds(spark, sf_dir), ("row", "col"), ("srow", "scol"), 64, ["pid"], ["d2", "sid"], ["ccd"]).filter(C("d2") <= 1500.0 * 1500.0)
    return near.groupBy("pid").agg(F.count(F.lit(1)).alias("n"), r6(robust.weighted_mean(C("dr"), geo.decay(F.sqrt("d2")))).alias("dr")).filter("n >= 3")


@query("j11_candidate_tiles", """WITH q AS (SELECT pid, row * 1.1 - 1000 AS r, col * 1.5 - 20 AS c FROM pt), b AS (SELECT q.*, m.*, r >= r0 AND r <= r1 AND c >= c0 AND c <= c1 AS t1, r + 50 >= r0 AND r - 50 <= r1 AND c + 5 >= c0 AND c - 5 <= c1 AS t2,
  power(greatest(r0 - r, r - r1, 0), 2) + power(greatest(c0 - c, c - c1, 0), 2) AS d2 FROM q, mosaic m),
k AS (SELECT *, CASE WHEN t1 THEN 1 WHEN t2 THEN 2 ELSE 3 END AS tier, row_number() OVER (PARTITION BY pid ORDER BY d2, ccd) AS rk FROM b), z AS (SELECT *, min(tier) OVER (PARTITION BY pid) AS best FROM k)
SELECT pid, tier, ccd AS tile FROM z WHERE tier = best AND (tier < 3 OR rk = 1)""")
def j11(spark, sf_dir):
    q = P.pt(spark, sf_dir).select("pid", (C("row") * 1.1 - 1000).alias("r"), (C("col") * 1.5 - 20).alias("c"))
    return joins.candidate_tiles(q, P.mosaic(spark), "r", "c", 50.0, 5.0).select("pid", "tier", "tile")


@query("j13_first_tier_controls", """WITH o AS (SELECT ccd, 1 AS tier, pid FROM matched WHERE k > 95 UNION ALL SELECT img_id, 2, pid FROM matched WHERE k < 5), z AS (SELECT *, min(tier) OVER (PARTITION BY ccd) AS t FROM o)
SELECT ccd, tier, count(*) AS n, min(pid) AS first FROM z WHERE tier = t GROUP BY ALL""")
def j13(spark, sf_dir):
    m = P.matched(spark, sf_dir)
    o = m.filter("k > 95").select("ccd", F.lit(1).alias("tier"), "pid").unionByName(m.filter("k < 5").select(C("img_id").alias("ccd"), F.lit(2).alias("tier"), "pid"))
    return joins.first_tier(o, ["ccd"], "tier").groupBy("ccd", "tier").agg(F.count(F.lit(1)).alias("n"), F.min("pid").alias("first"))


@query("j14_pooled_tiles", "SELECT t.ccd AS tile, count(*) AS n, round(avg(mrow - row), 6) + 0.0 AS dr FROM mosaic t JOIN matched m ON m.ccd BETWEEN t.ccd - 1 AND t.ccd + 1 GROUP BY t.ccd")
def j14(spark, sf_dir):
    around = F.sequence(F.greatest(F.lit(0), C("ccd") - 1), F.least(F.lit(P.TILES - 1), C("ccd") + 1))
    m = P.matched(spark, sf_dir).withColumn("tile", F.explode(around))
    return m.groupBy("tile").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(C("mrow") - C("row"))).alias("dr"))


@query("j15_zip_join", """WITH a AS (SELECT ccd, row_number() OVER (PARTITION BY ccd ORDER BY pid) AS i, pid FROM matched), b AS (SELECT ccd, row_number() OVER (PARTITION BY ccd ORDER BY mcol, pid) AS i, pid AS other FROM matched)
SELECT a.ccd, a.i, pid, other FROM a JOIN b ON a.ccd = b.ccd AND a.i = b.i""")
def j15(spark, sf_dir):
    m = P.matched(spark, sf_dir)
    a = joins.ranked_by_ranges(m.select("ccd", "pid"), ["ccd"], ["pid"], "i")
    b = joins.ranked_by_ranges(m.select("ccd", "mcol", C("pid").alias("other")), ["ccd"], ["mcol", "other"], "i")
    n = max(1, -(-a.count() // joins.RANGE))  # so that a task's share does not grow
    return a.repartition(n, "ccd", "i").join(b.repartition(n, "ccd", "i"), ["ccd", "i"]).select("ccd", (C("i") + 1).alias("i"), "pid", "other")


def _runs(spark, sf_dir):
    m = P.match(spark, sf_dir).select("pid", "img_id", "mrow", "mcol", "score")
    s = C("pid") % 7
    gone = F.lit(None)
    b = m.filter(s != 0).select(
        F.when(s == 1, C("pid") + 10_000_000).otherwise(C("pid")).alias("pid"), F.when(s == 2, gone).when(s == 3, (C("img_id") + 1) % 10).otherwise(C("img_id")).cast("int").alias("img_id"),
        F.when(s == 2, gone).when(s == 4, C("mrow") + 1).otherwise(C("mrow")).alias("mrow"), F.when(s == 2, gone).otherwise(C("mcol")).alias("mcol"), F.when(s == 2, gone).when(s == 5, C("score") + 0.5).otherwise(C("score")).alias("score"))
    return m, b


_RUNS = """WITH a AS (SELECT pid, img_id, mrow, mcol, score FROM match), b AS (SELECT CASE WHEN pid % 7 = 1 THEN pid + 10000000 ELSE pid END AS pid, CASE pid % 7 WHEN 2 THEN NULL WHEN 3 THEN (img_id + 1) % 10 ELSE img_id END AS img_id,
  CASE pid % 7 WHEN 2 THEN NULL WHEN 4 THEN mrow + 1 ELSE mrow END AS mrow, CASE WHEN pid % 7 <> 2 THEN mcol END AS mcol, CASE pid % 7 WHEN 2 THEN NULL WHEN 5 THEN score + 0.5 ELSE score END AS score FROM match WHERE pid % 7 <> 0)"""
_CHANGE = """SELECT coalesce(a.pid, b.pid) AS pid, CASE WHEN b.pid IS NULL THEN 'only_a' WHEN a.pid IS NULL THEN 'only_b' WHEN (a.img_id IS NULL) <> (b.img_id IS NULL) THEN 'status' WHEN a.img_id IS NULL THEN 'same'
  WHEN a.img_id <> b.img_id THEN 'image' WHEN round(a.mrow, 6) <> round(b.mrow, 6) OR round(a.mcol, 6) <> round(b.mcol, 6) THEN 'target' WHEN abs(a.score - b.score) > 1e-6 THEN 'score' ELSE 'same' END AS change FROM a FULL JOIN b ON a.pid = b.pid"""


@query("j16_keyed_diff", _RUNS + _CHANGE)
def j16(spark, sf_dir):
    return diff.keyed_diff(*_runs(spark, sf_dir), ["pid"]).select("pid", "change")


@query("j17_wrong_points_anti_join", "SELECT pid FROM matched WHERE (ccd, round_even(row * 10, 0), round_even(col * 10, 0)) NOT IN (SELECT (ccd, round_even(row * 10, 0), round_even(col * 10, 0)) FROM match WHERE img_id IS NULL OR k > 60)")
def j17(spark, sf_dir):
    key = lambda d: d.select("*", F.rint(C("row") * 10).alias("_r"), F.rint(C("col") * 10).alias("_c"))
    wrong = key(P.match(spark, sf_dir).filter("img_id IS NULL OR k > 60")).select("ccd", "_r", "_c")
    return key(P.matched(spark, sf_dir)).join(wrong, ["ccd", "_r", "_c"], "left_anti").select("pid")


@query("j18_file_level_diff", """WITH a AS (SELECT DISTINCT ccd * 10 + img_id AS f FROM matched WHERE k < 90), b AS (SELECT DISTINCT ccd * 10 + img_id + 5 AS f FROM matched WHERE k > 10)
SELECT coalesce(a.f, b.f) AS f, CASE WHEN b.f IS NULL THEN 'only_a' WHEN a.f IS NULL THEN 'only_b' ELSE 'common' END AS side FROM a FULL JOIN b ON a.f = b.f""")
def j18(spark, sf_dir):
    m = P.matched(spark, sf_dir)
    a, b = m.filter("k < 90").select((C("ccd") * 10 + C("img_id")).alias("f")).distinct(), m.filter("k > 10").select((C("ccd") * 10 + C("img_id") + 5).alias("f")).distinct()
    return diff.sides(a, b, ["f"])


@query("j19_covering_interval", """WITH c AS (SELECT n_nationkey AS kernel, n_nationkey * 100.0::DOUBLE AS a, n_nationkey * 100.0::DOUBLE + 130 AS b, n_nationkey % 3 AS rank FROM nation),
h AS (SELECT oid, t, c.* FROM ephem JOIN c ON a <= t AND t <= b QUALIFY row_number() OVER (PARTITION BY oid ORDER BY rank, kernel) = 1),
n AS (SELECT oid, t, c.* FROM ephem, c WHERE oid NOT IN (SELECT oid FROM h) QUALIFY row_number() OVER (PARTITION BY oid ORDER BY abs(a - t), a, kernel) = 1)
SELECT oid, kernel, true AS covered FROM h UNION ALL SELECT oid, kernel, false FROM n""")
def j19(spark, sf_dir):
    n = P.table(spark, sf_dir, "nation").select(C("n_nationkey").alias("kernel"), (C("n_nationkey") * 100.0).alias("a"), (C("n_nationkey") * 100.0 + 130).alias("b"), (C("n_nationkey") % 3).alias("rank"))
    return joins.covering_interval(P.ephem(spark, sf_dir), n, "t", "a", "b", "rank", "kernel").select("oid", "kernel", "covered")


@query("j20_pad_tiles", """WITH t AS (SELECT ccd, count(*) AS n FROM pt WHERE ccd IN (2, 3, 4, 7, 8) GROUP BY ccd), w AS (SELECT i::INT AS ccd FROM range(10) r(i)),
d AS (SELECT w.ccd, coalesce(t.ccd, (SELECT min(x.ccd) FROM t x WHERE x.ccd % 2 = w.ccd % 2), (SELECT max(ccd) FROM t)) AS donor FROM w LEFT JOIN t ON w.ccd = t.ccd)
SELECT d.ccd, donor, n FROM d JOIN t ON donor = t.ccd""")
def j20(spark, sf_dir):
    t = P.pt(spark, sf_dir).filter(C("ccd").isin(2, 3, 4, 7, 8)).groupBy("ccd").agg(F.count(F.lit(1)).alias("n"))
    return joins.pad_tiles(t, 10, ["n"])


_TILES = "WITH t AS (SELECT floor(row / 2000)::INT AS tr, floor(col / 15)::INT AS tc, max(score) > 49 AS ok FROM pt GROUP BY ALL)"


@query("j21_ring_donor", _TILES + """, p AS (SELECT a.tr, a.tc, b.tr AS donor_row, b.tc AS donor_col, row_number() OVER (PARTITION BY a.tr, a.tc ORDER BY greatest(abs(a.tr - b.tr), abs(a.tc - b.tc)), b.tr, b.tc) AS rk FROM t a JOIN t b ON b.ok AND greatest(abs(a.tr - b.tr), abs(a.tc - b.tc)) <= 3)
SELECT t.tr, t.tc, donor_row, donor_col FROM t LEFT JOIN p ON t.tr = p.tr AND t.tc = p.tc AND rk = 1""")
def j21(spark, sf_dir):
    t = P.pt(spark, sf_dir).groupBy(F.floor(C("row") / 2000).cast("int").alias("tr"), F.floor(C("col") / 15).cast("int").alias("tc")).agg((F.max("score") > 49).alias("ok"))
    return joins.ring_donor(t, "ok", "tr", "tc", 3).select("tr", "tc", "donor_row", "donor_col")


@query("j22_median_nearest_gap", f"""WITH p AS (SELECT l.ccd, l.pid, min({_D2}) AS d2 FROM matched l JOIN matched s ON l.ccd = s.ccd AND l.pid <> s.pid GROUP BY ALL)
SELECT ccd, round(median(sqrt(d2)), 6) + 0.0 AS gap FROM p GROUP BY ccd""")
def j22(spark, sf_dir):
    l = P.matched(spark, sf_dir).select("ccd", "pid", "row", "col")
    near = joins.knn_join(l, _seeds(spark, sf_dir), ("row", "col"), ("srow", "scol"), 2, ["pid"], ["d2", "sid"], ["ccd"])
    gaps = near.filter("pid <> sid").groupBy("ccd", "pid").agg(F.sqrt(F.min("d2")).alias("d"))
    return robust.exact_quantiles(gaps, ["ccd"], "d", [0.5], "q").select("ccd", r6(F.get("q", F.lit(0))).alias("gap"))


@query("u1_score_upsert", """WITH h AS (SELECT pid, (img_id + 3) % 10 AS img_id, mcol + 1 AS mcol, (value_ + 7) % 60 AS score FROM (SELECT *, round(coalesce(score, 10) + k) AS value_ FROM match) WHERE img_id IS NOT NULL AND k > 30),
z AS (SELECT pid, img_id, mcol, score, 0 AS new FROM matched UNION ALL SELECT *, 1 FROM h), b AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY pid ORDER BY score DESC, new, img_id) = 1)
SELECT m.pid, b.img_id, round(b.mcol, 6) + 0.0 AS mcol, b.score FROM match m LEFT JOIN b ON m.pid = b.pid""")
def u1(spark, sf_dir):
    m = P.match(spark, sf_dir)
    hits = m.filter("img_id IS NOT NULL AND k > 30").select("pid", ((C("img_id") + 3) % 10).alias("img_id"), (C("mcol") + 1).alias("mcol"), ((F.round(F.coalesce("score", F.lit(10.0)) + C("k")) + 7) % 60).alias("score"))
    out = upsert.upsert_by_score(m.select("pid", "img_id", "mcol", "score"), hits, ["pid"], ["img_id", "mcol", "score"], "score", "img_id")
    return out.withColumn("mcol", r6(C("mcol")))


@query("u3_best_cell", "SELECT ccd, floor(row / 480)::BIGINT AS i, floor(col / 16)::BIGINT AS j, pid, score FROM pt QUALIFY row_number() OVER (PARTITION BY ccd, floor(row / 480), floor(col / 16) ORDER BY score DESC, pid DESC) = 1")
def u3(spark, sf_dir):
    cells = P.pt(spark, sf_dir).select("ccd", F.floor(C("row") / 480).alias("i"), F.floor(C("col") / 16).alias("j"), "pid", "score")
    return upsert.best_cell(cells, ["ccd", "i", "j"], "score", "pid")


@query("u4_first_line", "SELECT col, min(pid) AS pid, count(*) - 1 AS repeats FROM pt GROUP BY col")
def u4(spark, sf_dir):
    first, again = upsert.first_line(P.pt(spark, sf_dir).select("col", "pid"), ["col"], "pid")
    return first.join(again.groupBy("col").agg(F.count(F.lit(1)).alias("n")), "col", "left").select("col", "pid", F.coalesce("n", F.lit(0)).cast("long").alias("repeats"))


@query("ag8_neighbour_sigma", f"""WITH n AS (SELECT l.pid, avg(s.mrow - s.row) AS mr, stddev_pop(s.mrow - s.row) AS sr, avg(s.mcol - s.col) AS mc, stddev_pop(s.mcol - s.col) AS sc FROM matched l {_NEAR} < 90000 GROUP BY l.pid)
SELECT pid, round(mr + 1e-9, 6) + 0.0 AS mr, round(sr + 1e-9, 5) + 0.0 AS sr, round(mc + 1e-9, 6) + 0.0 AS mc, round(sc + 1e-9, 5) + 0.0 AS sc FROM n""")
def ag8(spark, sf_dir):
    n = _moments(spark, sf_dir, 300.0)[1]
    near = lambda x: x + 1e-9  # noqa: E731  means of decimals lie on ties of the sixth digit; a step off them, sums in another order round alike
    return n.select("pid", r6(near(C("m_dr"))).alias("mr"), r6(near(F.sqrt("v_dr")), 5).alias("sr"), r6(near(C("m_dc"))).alias("mc"), r6(near(F.sqrt("v_dc")), 5).alias("sc"))


_O = f"WITH n AS (SELECT l.pid, count(*) AS n, avg(s.mrow - s.row) AS mr, sqrt(var_pop(s.mrow - s.row)) AS sr, avg(s.mcol - s.col) AS mc, sqrt(var_pop(s.mcol - s.col)) AS sc FROM matched l {_NEAR} < {{d2}} GROUP BY l.pid)"
_FINE = "abs(mrow - row - mr) < {k} * sr AND abs(mcol - col - mc) < {k} * sc"


def _filtered(spark, sf_dir, radius, k, isolated, weigh=None):
    l, n = _moments(spark, sf_dir, radius, weigh=weigh)
    points = l.withColumns({"own_r": C("mrow") - C("row"), "own_c": C("mcol") - C("col")})
    return robust.moments_filter(points, n, "pid", [("own_r", "dr"), ("own_c", "dc")], k, isolated, weigh is not None).select("pid")



@query("o1_neighbour_outliers", _O.format(d2=10000) + "SELECT m.pid FROM matched m JOIN n USING (pid) WHERE " + _FINE.format(k=2.0))
def o1(spark, sf_dir):
    return _filtered(spark, sf_dir, 100.0, 2.0, isolated=False)


@query("o2_weighted_outliers", f"""WITH n AS (SELECT l.pid, sum(w * dr) / sum(w) AS mr, avg(dr) AS ar, var_pop(dr) AS vr, sum(w * dc) / sum(w) AS mc, avg(dc) AS ac, var_pop(dc) AS vc FROM (SELECT l.pid, exp(-({_D2}) / 45000.0) AS w, s.mrow - s.row AS dr, s.mcol - s.col AS dc FROM matched l {_NEAR} < 90000) l GROUP BY l.pid)
SELECT m.pid FROM matched m JOIN n USING (pid) WHERE abs(mrow - row - mr) < 2 * sqrt(vr + (ar - mr) * (ar - mr)) AND abs(mcol - col - mc) < 2 * sqrt(vc + (ac - mc) * (ac - mc))""")
def o2(spark, sf_dir):
    return _filtered(spark, sf_dir, 300.0, 2.0, isolated=False, weigh=neighbours.gaussian(45000.0))


@query("o3_keep_isolated", _O.format(d2=10000) + "SELECT m.pid FROM match m LEFT JOIN n USING (pid) WHERE m.img_id IS NULL OR n IS NULL OR (" + _FINE.format(k=2.0) + ")")
def o3(spark, sf_dir):
    kept = _filtered(spark, sf_dir, 100.0, 2.0, isolated=True)
    return kept.unionByName(P.match(spark, sf_dir).filter("img_id IS NULL").select("pid"))


@query("o4_global_controls", f"""WITH v AS (SELECT * FROM matched WHERE sqrt((mrow - {_AR})*(mrow - {_AR}) + (mcol - {_AC})*(mcol - {_AC})) < 45 AND abs(mrow - {_AR}) < 40 AND abs(mcol - {_AC}) < 20),
n AS (SELECT l.pid, count(*) AS n, avg(s.mrow - s.row) AS mr, avg(s.mcol - s.col) AS mc, var_pop(s.mrow - s.row) AS vr, var_pop(s.mcol - s.col) AS vc, covar_pop(s.mrow - s.row, s.mcol - s.col) AS cov FROM v l JOIN matched s ON l.ccd = s.ccd AND {_D2} < 90000 GROUP BY l.pid HAVING count(*) >= 5),
t AS (SELECT v.pid, mrow - row - mr AS x, mcol - col - mc AS y, greatest(vr, 1) AS a, greatest(vc, 1) AS b, cov FROM v JOIN n USING (pid))
SELECT pid FROM t WHERE CASE WHEN a * b - cov * cov < 1e-6 THEN abs(x) / sqrt(a) <= 1 AND abs(y) / sqrt(b) <= 1 ELSE (b*x*x - 2*cov*x*y + a*y*y) / (a*b - cov*cov) <= 1 END""")
def o4(spark, sf_dir):
    vx, vy = robust.affine_residual(C("row"), C("col"), C("mrow"), C("mcol"), AFFINE)
    v = P.matched(spark, sf_dir).filter(robust.affine_gate(vx, vy, 45.0, 40.0, 20.0))
    n = neighbours.radius_moments(v, _seeds(spark, sf_dir), ("row", "col"), ("srow", "scol"), 300.0, ("pid", "sid"), ["dr", "dc"], ["ccd"], apart=False)
    fine = robust.mahalanobis_ok(C("n"), C("m_dr"), C("m_dc"), C("v_dr"), C("v_dc"), C("cov"), C("mrow") - C("row"), C("mcol") - C("col"))
    return v.join(n, "pid").filter(fine).select("pid")


@query("o5_match_get", f"""WITH v AS (SELECT pid, ccd, trunc(row) AS row, trunc(col) AS col, trunc(mrow) AS mrow, trunc(mcol) AS mcol FROM matched), g AS (SELECT * FROM v WHERE sqrt((mrow - {_AR})*(mrow - {_AR}) + (mcol - {_AC})*(mcol - {_AC})) < 2500 AND abs(mrow - {_AR}) < 1000 AND abs(mcol - {_AC}) < 550),
n AS (SELECT l.pid, avg(s.mrow - s.row) AS mr, sqrt(var_pop(s.mrow - s.row)) AS sr, avg(s.mcol - s.col) AS mc, sqrt(var_pop(s.mcol - s.col)) AS sc FROM g l JOIN g s ON l.ccd = s.ccd AND l.pid <> s.pid AND {_D2} < 250000 GROUP BY l.pid)
SELECT g.pid FROM g JOIN n USING (pid) WHERE abs(mrow - row - mr) < 3 * sr AND abs(mcol - col - mc) < 3 * sc""")
def o5(spark, sf_dir):
    places = {f"_{c}": geo.trunc(C(c)) for c in ("row", "col", "mrow", "mcol")}
    v = settled(P.matched(spark, sf_dir).select("pid", "ccd", "row", "col", "mrow", "mcol"), places).select("pid", "ccd", *(C(c).alias(c[1:]) for c in places))
    vx, vy = robust.affine_residual(C("row"), C("col"), C("mrow"), C("mcol"), AFFINE)
    g = v.filter(robust.affine_gate(vx, vy, 2500.0, 1000.0, 550.0)).withColumns({"own_r": C("mrow") - C("row"), "own_c": C("mcol") - C("col")})
    s = g.select("ccd", C("pid").alias("sid"), C("row").alias("srow"), C("col").alias("scol"), C("own_r").alias("dr"), C("own_c").alias("dc"))
    n = neighbours.radius_moments(g, s, ("row", "col"), ("srow", "scol"), 500.0, ("pid", "sid"), ["dr", "dc"], ["ccd"])
    return robust.moments_filter(g, n, "pid", [("own_r", "dr"), ("own_c", "dc")], 3.0, isolated=False).select("pid")


@query("m3a_reliable_prediction", f"""WITH s AS (SELECT l.pid, {_D2} AS d2, s.mrow - s.row AS v, s.pid AS sid FROM matched l {_NEAR} < 90000), w AS (SELECT *, 1.0 / (d2 + 1.0) AS w FROM s),
a AS (SELECT *, sum(w) OVER (PARTITION BY pid ORDER BY v, sid ROWS UNBOUNDED PRECEDING) AS acc, sum(w) OVER (PARTITION BY pid) AS tot FROM w), m AS (SELECT pid, min(v) FILTER (WHERE acc >= 0.5 * tot) AS med, sum(w * v) / sum(w) AS mean FROM a GROUP BY pid)
SELECT pid, trunc(row) + trunc(CASE WHEN abs(mean - 5) > 40 AND abs(med - 5) < abs(mean - 5) * 0.75 THEN med ELSE mean END + 0.5) + 0.0 AS pr, abs(mean - 5) > 40 AND abs(med - 5) < abs(mean - 5) * 0.75 AS rejected FROM matched JOIN m USING (pid)""")
def m3a(spark, sf_dir):
    l, pairs = _near(spark, sf_dir, 300.0)
    return matching.reliable_prediction(l, pairs, 5.0)


@query("m5a_best_two", "SELECT pid, rk, rid, score FROM (SELECT l.pid, r.pid AS rid, r.score, row_number() OVER (PARTITION BY l.pid ORDER BY r.score DESC, r.pid) AS rk FROM matched l JOIN matched r ON l.ccd = r.ccd AND abs(l.row - r.mrow) < 40 AND abs(l.col - r.mcol) < 40) WHERE rk <= 2")
def m5a(spark, sf_dir):
    left = P.matched(spark, sf_dir).select("ccd", "pid", "row", "col")
    pairs = joins.band_join(left, _right(spark, sf_dir), ("row", "col"), ("rrow", "rcol"), 40.0, 40.0, ["ccd"])
    return joins.nearest_k(pairs, ["pid"], 2, [F.desc("rscore"), "rid"]).select("pid", C("rk").cast("long").alias("rk"), "rid", C("rscore").alias("score"))


@query("se2_key_sets", _RUNS + "SELECT count(*) FILTER (WHERE b.pid IS NULL) AS only_a, count(*) FILTER (WHERE a.pid IS NULL) AS only_b, count(*) FILTER (WHERE a.pid = b.pid) AS common FROM a FULL JOIN b ON a.pid = b.pid")
def se2(spark, sf_dir):
    a, b = _runs(spark, sf_dir)
    s = diff.sides(a.select("pid"), b.select("pid"), ["pid"])
    n = lambda k: F.count(F.when(C("side") == k, 1))
    return s.agg(n("only_a").alias("only_a"), n("only_b").alias("only_b"), n("common").alias("common"))


@query("se4_change_counts", _RUNS + ", c AS (" + _CHANGE + ") SELECT change, count(*) AS n FROM c GROUP BY change")
def se4(spark, sf_dir):
    return diff.keyed_diff(*_runs(spark, sf_dir), ["pid"]).groupBy("change").agg(F.count(F.lit(1)).alias("n"))
