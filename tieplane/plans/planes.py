"""Queries on map planes and on the spectra of residuals."""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import functions as F

from ..functions import projection
from ..operators import spectrum
from . import proxies as P
from .proxies import r6
from .registry import query

C = F.col
A, FLAT = 3396190.0, 1 / 169.8
_E = repr(sqrt(FLAT * (2 - FLAT)))
_K = projection.series(projection.FORWARD, FLAT)
_R = repr(0.9996 * projection.rectifying_radius(A, FLAT))
_HALF = "tan(radians(45 - {lat} / 2)) * power((1 + {e} * sin(radians({lat}))) / (1 - {e} * sin(radians({lat}))), {e} / 2)"
_M = f"cos(radians(71.0)) / sqrt(1 - power({_E} * sin(radians(71.0)), 2))"


@query("pr22_projected", f"""WITH g AS (SELECT pid, row / 499.3 - 44 AS lat, (col::BIGINT % 60) - 30.0::DOUBLE AS lon, 60 + floor(row)::BIGINT % 30 + 0.5::DOUBLE AS plat, col * 2 - 150 AS plon FROM pt),
t AS (SELECT *, sinh(atanh(sin(radians(lat))) - {_E} * atanh({_E} * sin(radians(lat)))) AS t FROM g), x AS (SELECT *, atan2(t, cos(radians(lon - 3))) AS x, atanh(sin(radians(lon - 3)) / sqrt(1 + t * t)) AS y FROM t)
SELECT pid, round({_R} * (y + {' + '.join(f'{c!r} * cos({2 * j} * x) * sinh({2 * j} * y)' for j, c in enumerate(_K, 1))}), 4) + 0.0 AS east, round({_R} * (x + {' + '.join(f'{c!r} * sin({2 * j} * x) * cosh({2 * j} * y)' for j, c in enumerate(_K, 1))}), 4) + 0.0 AS north,
round(-{A!r} * {_M} * ({_HALF.format(lat='plat', e=_E)}) / ({_HALF.format(lat='71.0', e=_E)}) * sin(radians(-(plon - 10))), 4) + 0.0 AS polar_east, round({A!r} * {_M} * ({_HALF.format(lat='plat', e=_E)}) / ({_HALF.format(lat='71.0', e=_E)}) * cos(radians(-(plon - 10))), 4) + 0.0 AS polar_north,
round(lat, 3) + 0.0 AS lat, round(lon, 3) + 0.0 AS lon, true AS back FROM x""")
def pr22(spark, sf_dir):
    """Places on both planes, and back from there."""
    g = P.pt(spark, sf_dir).select("pid", (C("row") / 499.3 - 44).alias("lat"), (C("col").cast("long") % 60 - 30.0).alias("lon"), (60 + C("row").cast("long") % 30 + 0.5).alias("plat"), (C("col") * 2 - 150).alias("plon"))
    east, north = projection.to_transverse_mercator(C("lat"), C("lon"), 3.0, A, FLAT)
    pe, pn = projection.to_polar_stereographic(-C("plat"), C("plon"), 10.0, A, FLAT, -71.0)
    d = g.select("pid", C("lat").alias("la"), C("lon").alias("lo"), C("plat").alias("pa"), C("plon").alias("po"), east.alias("e"), north.alias("n"), pe.alias("pe"), pn.alias("pn"))
    lat, lon = projection.from_transverse_mercator(C("e"), C("n"), 3.0, A, FLAT)
    plat, plon = projection.from_polar_stereographic(C("pe"), C("pn"), 10.0, A, FLAT, -71.0)
    turn = F.abs(F.pmod(plon - C("po") + 180.0, F.lit(360.0)) - 180.0)
    back = (F.abs(lat - C("la")) < 1e-7) & (F.abs(lon - C("lo")) < 1e-7) & (F.abs(plat + C("pa")) < 1e-7) & (turn < 1e-7)
    return d.select("pid", r6(C("e"), 4).alias("east"), r6(C("n"), 4).alias("north"), r6(C("pe"), 4).alias("polar_east"), r6(C("pn"), 4).alias("polar_north"), r6(lat, 3).alias("lat"), r6(lon, 3).alias("lon"), back.alias("back"))


#: Waves per second that are looked at; the planted one is 2.3, the same for all tiles but for its phase.
GRID = [0.25 * k for k in range(1, 41)]
_SERIES = f"s AS (SELECT ccd, row * 1e-4::DOUBLE AS t, 0.5 * sin({2 * pi * 2.3!r}::DOUBLE * (row * 1e-4::DOUBLE) + ccd) + ((pid * 7919) % 1000) * 6e-4::DOUBLE - 0.3::DOUBLE AS v FROM pt)"
_SPECTRUM = f"""WITH {_SERIES}, w AS (SELECT ccd, f AS frequency, v, cos({2 * pi!r}::DOUBLE * f * t) AS c, sin({2 * pi!r}::DOUBLE * f * t) AS s FROM s, (SELECT unnest({GRID!r}::DOUBLE[]) AS f)),
q AS (SELECT ccd, frequency, count(*) AS n, sum(c*c) - sum(c)*sum(c)/count(*) AS cc, sum(s*s) - sum(s)*sum(s)/count(*) AS ss, sum(c*s) - sum(c)*sum(s)/count(*) AS cs, sum(v*c) - sum(v)*sum(c)/count(*) AS vc, sum(v*s) - sum(v)*sum(s)/count(*) AS vs, sum(v*v) - sum(v)*sum(v)/count(*) AS vv FROM w GROUP BY ALL),
p AS (SELECT ccd, frequency, n, ((vc*ss - vs*cs) * vc + (vs*cc - vc*cs) * vs) / (cc*ss - cs*cs) / vv AS power FROM q)"""


def residuals(spark, sf_dir):
    """What is left of the links of a strip over time: a wave and noise that the point's number tells."""
    t = C("row") * 1e-4
    return P.pt(spark, sf_dir).select("ccd", t.alias("t"), (0.5 * F.sin(2 * pi * 2.3 * t + C("ccd")) + (C("pid") * 7919 % 1000) * 6e-4 - 0.3).alias("v"))


@query("h2_jitter_spectrum", _SPECTRUM + " SELECT ccd, frequency, n, round(power, 6) + 0.0 AS power FROM p")
def h2(spark, sf_dir):
    return spectrum.spectrum(residuals(spark, sf_dir), ["ccd"], "t", "v", GRID).select("ccd", "frequency", "n", r6(C("power")).alias("power"))


@query("h2b_jitter_peaks", _SPECTRUM + """, b AS (SELECT ccd, frequency AS f, power FROM p QUALIFY row_number() OVER (PARTITION BY ccd ORDER BY power DESC, frequency) = 1),
n AS (SELECT b.ccd, b.f, b.power, max(p.power) FILTER (WHERE abs(p.frequency - b.f + 0.25) < 0.05) AS l, max(p.power) FILTER (WHERE abs(p.frequency - b.f - 0.25) < 0.05) AS r FROM b JOIN p USING (ccd) GROUP BY ALL)
SELECT ccd, round(f + 0.25::DOUBLE * coalesce(CASE WHEN l - 2 * power + r < 0 THEN 0.5 * (l - r) / (l - 2 * power + r) END, 0.0), 5) + 0.0 AS frequency, round(power, 6) + 0.0 AS power FROM n""")
def h2b(spark, sf_dir):
    found = spectrum.peaks(spectrum.spectrum(residuals(spark, sf_dir), ["ccd"], "t", "v", GRID), ["ccd"], 0.25)
    return found.select("ccd", r6(C("frequency"), 5).alias("frequency"), r6(C("power")).alias("power"))
