"""Queries that look for windows in images: tiles of 8 by 8 samples, each against the next."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import patch as Z
from ..operators import matching
from . import proxies as P
from .proxies import r6
from .registry import query
from .sqltext import correlation, places, window

C = F.col
SIDE, HALF = 8, 1
#: Places on an image that windows of 3 by 3 are looked for.
AT = ((3, 3), (4, 4))
#: An affine's offset from the place itself, for the gate.
OFF = (0.6, -0.4)


def _tiles(spark, sf_dir):
    p = P.patches(spark, sf_dir)
    return p.select(C("pid").cast("int").alias("ccd"), F.lit(SIDE).alias("rows"), F.lit(SIDE).alias("cols"), C("patch").alias("samples"))


def _points(spark, sf_dir):
    """AT on each tile that has a next one, predicted at the same place there."""
    t = _tiles(spark, sf_dir).select("ccd")
    both = t.join(t.select((C("ccd") - 1).alias("ccd")), "ccd")
    at = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(r).alias("row"), F.lit(c).alias("col")) for k, (r, c) in enumerate(AT))))
    p = both.select(C("ccd").alias("lccd"), (C("ccd") + 1).alias("rccd"), at.alias("x")).select("lccd", "rccd", (C("lccd").cast("long") * 2 + C("x.k")).alias("pid"), "x.row", "x.col")
    return p.withColumns({"pr": C("row") * 1.0, "pc": C("col") * 1.0, "ar": C("row") + OFF[0], "ac": C("col") + OFF[1]})


_PTS = "tl AS (SELECT pid::INT AS ccd, patch::DOUBLE[] AS a FROM patches), po AS (SELECT l.ccd::BIGINT * 2 + k AS pid, r, c, r AS pr, c AS pc, l.a, n.a AS b FROM tl l JOIN tl n ON n.ccd = l.ccd + 1, (VALUES " + ", ".join(f"({k}, {r}, {c})" for k, (r, c) in enumerate(AT)) + ") x(k, r, c))"
_CLIP = "greatest(0.0, least(1.0, (s + 1.0) / 2.0))"


def _searched(spark, sf_dir, how: Z.Search, least: float):
    t = _tiles(spark, sf_dir)
    return matching.search_in_tiles(_points(spark, sf_dir), t, t, how, least)


@query("z8_coarse_to_fine", f"""WITH {_PTS}, {places('po', 2, 2)}, co AS (SELECT pid, r, c, rr AS pr, cc AS pc, a, b, s FROM ca QUALIFY row_number() OVER (PARTITION BY pid ORDER BY round(1.0 - s, 9), i, j) = 1),
{places('(SELECT pid, r, c, pr, pc, a, b FROM co)', 2).replace('cw AS', 'fw AS').replace('ca AS', 'fa AS').replace('FROM cw', 'FROM fw').replace('(SELECT pid, r, c, pr, pc, a, b FROM co).*', 'co.*').replace('FROM (SELECT pid, r, c, pr, pc, a, b FROM co)', 'FROM (SELECT pid, r, c, pr, pc, a, b FROM co) co')}
SELECT pid, rr * 1.0::DOUBLE AS mrow, cc * 1.0::DOUBLE AS mcol, round(s, 6) + 0.0 AS score FROM fa QUALIFY row_number() OVER (PARTITION BY pid ORDER BY round(1.0 - s, 9), i, j) = 1""")
def z8(spark, sf_dir):
    return _searched(spark, sf_dir, Z.Search(2, HALF, 2, refine=2), -2.0).select("pid", "mrow", "mcol", r6(C("score")).alias("score"))


@query("z9_subpixel", f"""WITH {_PTS}, {places('po', 2)}, be AS (SELECT pid, r, c, rr AS pr, cc AS pc, a, b, s AS top FROM ca QUALIFY row_number() OVER (PARTITION BY pid ORDER BY round(1.0 - s, 9), i, j) = 1),
{places('be', 1).replace('cw AS', 'fw AS').replace('ca AS', 'fa AS').replace('FROM cw', 'FROM fw')}, w AS (SELECT pid, rr, cc, s, top, exp(-30.0 * (1.0 - {_CLIP})) AS w FROM fa)
SELECT pid, round(sum(w * rr) / sum(w), 6) + 0.0 AS mrow, round(sum(w * cc) / sum(w), 6) + 0.0 AS mcol, round(greatest(max(s), any_value(top)), 6) + 0.0 AS score FROM w GROUP BY pid""")
def z9(spark, sf_dir):
    return _searched(spark, sf_dir, Z.Search(2, HALF, 1, sharpness=30.0), -2.0).select("pid", r6(C("mrow")).alias("mrow"), r6(C("mcol")).alias("mcol"), r6(C("score")).alias("score"))


@query("m3_energy_and_gate", f"""WITH {_PTS}, {places('po', 2)}, e AS (SELECT *, round(1.0 - s + 0.1 * sqrt(i * i + j * j) / 2.0, 9) AS energy FROM ca WHERE abs(r + {OFF[0]} - rr) < 2 AND abs(c + {OFF[1]} - cc) < 2)
, h AS (SELECT pid, rr, cc, s FROM e QUALIFY row_number() OVER (PARTITION BY pid ORDER BY energy, i, j) = 1)
SELECT po.pid, CASE WHEN s >= 0.2 THEN rr * 1.0::DOUBLE END AS mrow, CASE WHEN s >= 0.2 THEN cc * 1.0::DOUBLE END AS mcol, CASE WHEN s >= 0.2 THEN round(s, 6) + 0.0 END AS score FROM po LEFT JOIN h ON po.pid = h.pid""")
def m3(spark, sf_dir):
    t = _tiles(spark, sf_dir)
    out = matching.semi_dense(_points(spark, sf_dir), t, t, ["lccd"], Z.Search(2, HALF, 1, smooth=0.1, gate=2.0), 0.2)
    return out.select("pid", "mrow", "mcol", r6(C("score")).alias("score"))


@query("m4_global_refine", f"""WITH {_PTS}, {places('po', 2)}, w AS (SELECT pid, rr, cc, s, exp(-3.0 * (1.0 - s + 0.05 * sqrt(i * i + j * j))) AS w FROM ca)
SELECT pid, round(sum(w * rr) / sum(w), 6) + 0.0 AS mrow, round(sum(w * cc) / sum(w), 6) + 0.0 AS mcol, round(max(s), 6) + 0.0 AS score FROM w GROUP BY pid""")
def m4(spark, sf_dir):
    t = _tiles(spark, sf_dir)
    matches = _points(spark, sf_dir).select("pid", "lccd", "rccd", "row", "col", C("pr").alias("mrow"), C("pc").alias("mcol"), F.lit(0.0).alias("score"))
    out = matching.refine_globally(matches, t, t, reach=2, half=HALF, smooth=0.05)
    return out.select("pid", r6(C("mrow")).alias("mrow"), r6(C("mcol")).alias("mcol"), r6(C("score")).alias("score"))


@query("m6_within_strip", f"""WITH tl AS (SELECT pid::INT AS ccd, patch::DOUBLE[] AS a FROM patches), po AS (SELECT l.ccd * 64 + r * 8 + c AS pid, l.ccd, r, c, r AS pr, c - 4 AS pc, l.a, n.a AS b FROM tl l JOIN tl n ON n.ccd = l.ccd + 1, (VALUES (1, 5), (3, 5), (5, 5), (7, 5), (1, 7), (3, 7), (5, 7), (7, 7)) x(r, c)),
{places('po', 2)}, be AS (SELECT pid, ccd, r, c, rr AS pr, cc AS pc, a, b, s AS top FROM ca QUALIFY row_number() OVER (PARTITION BY pid ORDER BY round(1.0 - s, 9), i, j) = 1),
{places('be', 1).replace('cw AS', 'fw AS').replace('ca AS', 'fa AS').replace('FROM cw', 'FROM fw')}, w AS (SELECT pid, ccd, r, c, rr, cc, s, top, exp(-30.0 * (1.0 - {_CLIP})) AS w FROM fa),
o AS (SELECT pid, ccd, r, c, sum(w * rr) / sum(w) AS mr, sum(w * cc) / sum(w) AS mc, greatest(max(s), any_value(top)) AS sc FROM w GROUP BY ALL)
SELECT ccd AS ccd_l, r AS row, c AS col, ccd + 1 AS ccd_r, round(mr, 6) + 0.0 AS mrow, round(mc, 6) + 0.0 AS mcol, round(sc, 6) + 0.0 AS score FROM o WHERE sc >= 0.6""")
def m6(spark, sf_dir):
    links = matching.within_strip(_tiles(spark, sf_dir), Z.Search(2, HALF, 1, sharpness=30.0), 0.6, overlap=4, step=(2, 2))
    return links.select("ccd_l", "row", "col", "ccd_r", r6(C("mrow")).alias("mrow"), r6(C("mcol")).alias("mcol"), r6(C("score")).alias("score"))


def _shifts() -> str:
    """The mean correlation of each shift of G7 on tiles of 8 by 8 with an overlap of four columns."""
    parts = []
    for i in (-1, 0, 1):
        for j in (0, 1):
            cells = [correlation(window("a", str(max(0, i) + u + 1), str(4 + j + v + 1)), window("b", str(max(0, -i) + u + 1), str(v + 1)), 9) for u in range(6 - abs(i)) for v in range(2 - j)]
            parts.append(f"SELECT ccd, {i} AS dr, {j} AS dc, round(({' + '.join(cells)}) / {len(cells)}, 9) AS m FROM pr")
    return " UNION ALL ".join(parts)


@query("g7_overlap_registration", f"""WITH tl AS (SELECT pid::INT AS ccd, patch::DOUBLE[] AS a FROM patches), pr AS (SELECT l.ccd, l.a, n.a AS b FROM tl l JOIN tl n ON n.ccd = l.ccd + 1), sh AS ({_shifts()})
SELECT ccd, dr, dc, round(m, 6) + 0.0 AS score FROM sh QUALIFY row_number() OVER (PARTITION BY ccd ORDER BY m DESC, dr, dc) = 1""")
def g7(spark, sf_dir):
    return matching.register_overlaps(_tiles(spark, sf_dir), 4, 1, 2, HALF, 1).select("ccd", "dr", "dc", r6(C("score")).alias("score"))


#: A linear map about the middle of a tile under which a window is resampled.
LINEAR = ((1.02, 0.3), (-0.2, 0.98))


def _bilinear(image: str, r: float, c: float) -> str:
    i, j = int(np.floor(r)), int(np.floor(c))
    fr, fc = r - i, c - j
    at = lambda a, b: f"{image}[{a * SIDE + b + 1}]"
    return f"({at(i, j)} * {(1 - fr) * (1 - fc)!r}::DOUBLE + {at(i, j + 1)} * {(1 - fr) * fc!r}::DOUBLE + {at(i + 1, j)} * {fr * (1 - fc)!r}::DOUBLE + {at(i + 1, j + 1)} * {fr * fc!r}::DOUBLE)"


def _resampled(image: str) -> str:
    return "[" + ", ".join(_bilinear(image, 3.5 + LINEAR[0][0] * i + LINEAR[0][1] * j, 3.25 + LINEAR[1][0] * i + LINEAR[1][1] * j) for i in (-1, 0, 1) for j in (-1, 0, 1)) + "]"


@query("z3_affine_zncc", f"WITH tl AS (SELECT pid::INT AS ccd, patch::DOUBLE[] AS a FROM patches), pr AS (SELECT l.ccd, l.a, n.a AS b FROM tl l JOIN tl n ON n.ccd = l.ccd + 1) SELECT ccd, round({correlation(window('a', '3', '3'), _resampled('b'), 9)}, 6) + 0.0 AS score FROM pr")
def z3(spark, sf_dir):
    t = _tiles(spark, sf_dir)
    pairs = t.select("ccd", C("samples").alias("limg")).join(t.select((C("ccd") - 1).alias("ccd"), C("samples").alias("rimg")), "ccd")
    out = Z.affine_scores(pairs, SIDE, 3, 3, 3.5, 3.25, LINEAR, HALF)
    return out.select("ccd", r6(C("score")).alias("score"))


def _sobel() -> str:
    flip = lambda i: -i if i < 0 else 2 * (SIDE - 1) - i if i >= SIDE else i
    at = lambda r, c: f"a[{flip(r) * SIDE + flip(c) + 1}]"
    cells = []
    for r in range(SIDE):
        for c in range(SIDE):
            side = lambda d, along: " + ".join(f"{w} * ({at(r + (k if along else d), c + (d if along else k))})" for k, w in ((-1, 1), (0, 2), (1, 1)))  # noqa: B023, E731
            cells.append(f"abs(({side(1, True)}) - ({side(-1, True)})) + abs(({side(1, False)}) - ({side(-1, False)}))")
    return "[" + ", ".join(cells) + "]"


@query("z10_gradient_magnitude", f"WITH tl AS (SELECT pid::INT AS ccd, patch::DOUBLE[] AS a FROM patches), g AS (SELECT ccd, {_sobel()} AS g FROM tl) SELECT ccd, round(list_sum(g), 5) + 0.0 AS total, round(list_max(g), 5) + 0.0 AS top FROM g")
def z10(spark, sf_dir):
    g = Z.gradients(_tiles(spark, sf_dir))
    return g.select("ccd", r6(Z.total(C("gradient")), 5).alias("total"), r6(F.array_max("gradient"), 5).alias("top"))


_GRAY = "gl AS (SELECT pid::INT AS ccd, list_transform(patch, lambda x: greatest(0, least(255, floor(x::DOUBLE * 8 + 128)))::DOUBLE) AS a FROM patches), gp AS (SELECT l.ccd, l.a, n.a AS b FROM gl l JOIN gl n ON n.ccd = l.ccd + 1)"


@query("m5b_dense_match", f"""WITH {_GRAY}, ab AS (SELECT ccd, unnest(a)::INT AS x, unnest(b)::INT AS y FROM gp), jo AS (SELECT ccd, x, y, count(*) / 64.0::DOUBLE AS p FROM ab GROUP BY ALL), ma AS (SELECT ccd, x, count(*) / 64.0::DOUBLE AS p FROM ab GROUP BY ALL), mb AS (SELECT ccd, y, count(*) / 64.0::DOUBLE AS p FROM ab GROUP BY ALL),
po AS (SELECT ccd::BIGINT * 64 + r * 8 + c AS pid, r, c, r AS pr, c AS pc, a, b FROM gp, range(1, 7) x(r), range(1, 7) y(c)), {places('po', 1)},
en AS (SELECT ca.pid, rr, cc, i, j, s, ln((coalesce(jo.p, 0) + 1e-6) / (ma.p * coalesce(mb.p, 0) + 1e-6)) AS mi FROM ca JOIN ma ON ma.ccd = pid // 64 AND ma.x = a[r * 8 + c + 1]::INT LEFT JOIN mb ON mb.ccd = pid // 64 AND mb.y = b[rr * 8 + cc + 1]::INT LEFT JOIN jo ON jo.ccd = pid // 64 AND jo.x = a[r * 8 + c + 1]::INT AND jo.y = b[rr * 8 + cc + 1]::INT)
, be AS (SELECT * FROM en QUALIFY row_number() OVER (PARTITION BY pid ORDER BY round(1.0 - s + 0.1 * sqrt(i * i + j * j) + 0.05 * (1.0 - mi), 9), i, j) = 1) SELECT pid, rr * 1.0::DOUBLE AS mrow, cc * 1.0::DOUBLE AS mcol, round(s, 9) + 0.0 AS score FROM be WHERE s >= 0.3001""")
def m5b(spark, sf_dir):
    gray = F.transform("samples", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x.cast("double") * 8 + 128))).cast("float"))
    t = _tiles(spark, sf_dir).withColumn("samples", gray)
    pairs = t.select(C("ccd").alias("lccd")).join(t.select((C("ccd") - 1).alias("lccd")), "lccd").withColumn("rccd", C("lccd") + 1)
    cells = lambda lo, hi: pairs.withColumn("row", F.explode(F.sequence(F.lit(lo), F.lit(hi)))).withColumn("col", F.explode(F.sequence(F.lit(lo), F.lit(hi))))
    points = cells(1, 6).withColumns({"pid": C("lccd").cast("long") * 64 + C("row") * 8 + C("col"), "pr": C("row") * 1.0, "pc": C("col") * 1.0, "ar": C("row") * 1.0, "ac": C("col") * 1.0})
    same = cells(0, 7).withColumns({"mrow": C("row"), "mcol": C("col")})
    out = matching.dense_match(points, t, t, same, reach=1, half=HALF, smooth=0.1, mutual=0.05, least=0.3001)
    return out.select("pid", "mrow", "mcol", r6(C("score"), 9).alias("score"))
