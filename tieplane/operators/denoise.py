"""Point-cloud denoising: smooth surfaces from moments of cells, then spikes against the heights around.

Points are never copied to the cells around theirs. A cell's weighted moments are sums, which are moved to the centre of each cell near
it and added there; so a surface costs a row a cell and neighbour, and a cell of any number of points is summed before it moves.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..sources.shared import held
from .grid import halo
from .neighbours import BASIS, QUADRATIC
from .robust import SCALE, exact_quantiles

#: Weights reach zero at so many times the height at which a point counts as off the surface.
CUT = 1.5


def biweight(height: Column, spread: Column, reach: float) -> Column:
    """Tukey's weight of a height: 1 on the surface, falling smoothly to 0 at ``reach`` spreads; 1 where there is no spread."""
    t = height / (reach * spread)
    return F.when(spread <= 1e-12, 1.0).otherwise(F.when(F.abs(t) < 1, (1 - t * t) * (1 - t * t)).otherwise(0.0))


def _voted(cells: DataFrame, radius: int, value: str, out: str) -> DataFrame:
    """For each cell the median of the cells' values around it, each with as many votes as points n, and the points there."""
    around = halo(cells.select("ci", "cj", value, "n"), radius).groupBy("hi", "hj").agg(F.array_sort(F.collect_list(F.struct(F.col(value).alias("v"), "n"))).alias("_s"), F.sum("n").alias("_t"))  # (2 radius + 1)**2 at most
    pick = F.aggregate("_s", F.struct(F.lit(0).cast("long").alias("c"), F.lit(None).cast("double").alias("v")), lambda a, x: F.struct((a["c"] + x["n"]).alias("c"), F.when(2 * a["c"] < F.col("_t"), x["v"]).otherwise(a["v"]).alias("v")))
    return around.select(F.col("hi").alias("ci"), F.col("hj").alias("cj"), pick["v"].alias(out), F.col("_t").alias("around"))


@F.pandas_udf(ArrayType(DoubleType()))
def _surface(a: pd.Series, b: pd.Series) -> pd.Series:
    """Coefficients on the basis of BASIS of 21 upper products and 6 right sides: the quadratic, where that is as good as singular the
    plane, else the mean."""
    at = np.triu_indices(6)
    m = np.zeros((len(a), 6, 6))
    m[:, at[0], at[1]] = np.stack(a.to_numpy()) if len(a) else np.zeros((0, 21))
    m, v, out = m + np.triu(m, 1).transpose(0, 2, 1), np.stack(b.to_numpy()) if len(b) else np.zeros((0, 6)), np.zeros((len(a), 6))
    done = m[:, 0, 0] <= 0
    for size in (6, 3, 1):
        s = np.sqrt(np.maximum(np.einsum("kii->ki", m[:, :size, :size]), 1e-300))
        norm = m[:, :size, :size] / s[:, :, None] / s[:, None, :]
        fine = ~done & (np.linalg.eigvalsh(norm)[:, 0] > 1e-9)
        out[fine, :size] = np.linalg.solve(norm[fine], (v[fine, :size] / s[fine])[..., None])[..., 0] / s[fine]
        done |= fine
    return pd.Series(list(out))


def _surfaces(points: DataFrame, radius: int) -> DataFrame:
    """ci, cj, coefficients q of the weighted surface over each cell and those around it, in units of a cell about its centre."""
    power = lambda x, k: F.lit(1.0) if k == 0 else F.pow(x, F.lit(float(k)))
    w, u, v = F.col("w"), F.col("u"), F.col("v")
    own = points.groupBy("ci", "cj").agg(*(F.sum(w * power(u, i) * power(v, j)).alias(f"m{i}{j}") for i, j in QUADRATIC), *(F.sum(w * power(u, i) * power(v, j) * F.col("z")).alias(f"b{i}{j}") for i, j in BASIS))
    near = halo(own, radius).withColumns({"di": F.col("ci") - F.col("hi"), "dj": F.col("cj") - F.col("hj")})

    def moved(name: str, i: int, j: int) -> Column:
        """A moment about another centre: each power of a shifted coordinate is a sum of powers."""
        return sum((comb(i, a) * comb(j, b) * power(F.col("di"), i - a) * power(F.col("dj"), j - b) * F.col(f"{name}{a}{b}") for a in range(i + 1) for b in range(j + 1)), F.lit(0.0))

    full = near.groupBy("hi", "hj").agg(*(F.sum(moved("m", i, j)).alias(f"m{i}{j}") for i, j in QUADRATIC), *(F.sum(moved("b", i, j)).alias(f"b{i}{j}") for i, j in BASIS))
    products = F.array(*(f"m{BASIS[i][0] + BASIS[j][0]}{BASIS[i][1] + BASIS[j][1]}" for i in range(6) for j in range(i, 6)))
    solved = full.join(own.select(F.col("ci").alias("hi"), F.col("cj").alias("hj")), ["hi", "hj"], "left_semi")
    return solved.select(F.col("hi").alias("ci"), F.col("hj").alias("cj"), _surface(products, F.array(*(f"b{i}{j}" for i, j in BASIS))).alias("q"))


def _heights(points: DataFrame, surfaces: DataFrame, cell: float) -> DataFrame:
    """Adds the signed distance h of each point from its cell's surface, along the normal at the cell's centre."""
    q, u, v = F.col("q"), F.col("u"), F.col("v")
    over = F.col("z") - (q[0] + q[1] * u + q[2] * v + q[3] * u * u + q[4] * u * v + q[5] * v * v)
    slope = F.sqrt(1.0 + (q[1] / cell) * (q[1] / cell) + (q[2] / cell) * (q[2] / cell))
    return points.drop("h").join(surfaces, ["ci", "cj"]).withColumn("h", over / slope).drop("q")


def _spread(points: DataFrame, value: str, radius: int, out: str) -> DataFrame:
    """For each cell the voted median of the cells' own medians of |value|, times 1.4826, and the points around."""
    d = points.select("ci", "cj", F.abs(value).alias("_a"))
    own = exact_quantiles(d, ["ci", "cj"], "_a", [0.5], "_q").select("ci", "cj", (SCALE * F.get("_q", F.lit(0))).alias("s")).join(d.groupBy("ci", "cj").agg(F.count(F.lit(1)).alias("n")), ["ci", "cj"])
    return _voted(own, radius, "s", out)


def denoise(points: DataFrame, key: str, cell: float, radius: int = 1, least: int = 8, sigma: float = 3.0, spike: float = 3.0, rounds: int = 3, limit: float = 0.0) -> DataFrame:
    """Adds ``reason`` to points (x, y, z): 0 kept, 1 off the local surface, 2 a spike in height.

    The surface of a cell is a quadratic of height over place, fitted to the points of the cells within ``radius`` by iteratively
    reweighted least squares with Tukey's weights. A point is off it if its distance exceeds ``sigma`` spreads (or ``limit``, where that is
    less and above 0); the spread is 1.4826 times the median distance of a cell's points, the median of that over the cells around with a
    vote a point. A spike differs from the heights of the good points by more than ``spike`` spreads: each cell around votes with the
    median of its heights, and what is left of that or of the cell's own deviation, whichever is more, votes for the spread.
    Cells with fewer than ``least`` points around keep all. Rows go along as they are, so keys may repeat (``key`` is not read). Points with a coordinate that is null or no number get no reason.
    """
    rows = points.select("x", "y", "z", F.struct(*(F.col(c) for c in points.columns)).alias("_p"))
    fine = rows.filter("NOT (isnan(x) OR isnan(y) OR isnan(z)) AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    at = {"ci": F.floor(F.col("x") / cell).cast("long"), "cj": F.floor(F.col("y") / cell).cast("long")}
    d = fine.withColumns(at).select("_p", "ci", "cj", (F.col("x") / cell - F.col("ci") - 0.5).alias("u"), (F.col("y") / cell - F.col("cj") - 0.5).alias("v"), F.col("z").cast("double").alias("z"), F.lit(1.0).alias("w"))
    d, weighted = held(d.drop("w"), "cloud"), d
    for _ in range(max(1, rounds) + 1):  # a round leaves a row a cell; heights and weights of points follow from it and are not written
        surfaces = held(_surfaces(weighted, radius), "surfaces")
        cells = held(surfaces.join(_spread(_heights(d, surfaces, cell), "h", radius, "s"), ["ci", "cj"]), "fitted")
        weighted = _heights(d, cells, cell).withColumn("w", biweight(F.col("h"), F.col("s"), CUT * sigma))
    d = _heights(d, cells, cell)
    gate = sigma * F.col("s") if limit <= 0 else F.least(sigma * F.col("s"), F.lit(limit))
    off = (F.col("around") >= least) & (F.when(F.col("s") > 1e-12, F.abs("h") > gate).otherwise(F.abs("h") > limit if limit > 0 else F.lit(False)))
    d = d.select("_p", "ci", "cj", "z", off.alias("bad"))
    good = d.filter("NOT bad")
    own = exact_quantiles(good, ["ci", "cj"], "z", [0.5], "_q").select("ci", "cj", F.get("_q", F.lit(0)).alias("m"))
    away = good.join(own, ["ci", "cj"]).withColumn("_a", F.abs(F.col("z") - F.col("m")))
    mad = exact_quantiles(away, ["ci", "cj"], "_a", [0.5], "_q").select("ci", "cj", F.get("_q", F.lit(0)).alias("a"))
    cells = held(own.join(mad, ["ci", "cj"]).join(good.groupBy("ci", "cj").agg(F.count(F.lit(1)).alias("n")), ["ci", "cj"]), "cells")
    middle = _voted(cells, radius, "m", "mid")
    differing = halo(cells, radius).select(F.col("hi").alias("gi"), F.col("hj").alias("gj"), "m", "a", "n").join(middle.select(F.col("ci").alias("gi"), F.col("cj").alias("gj"), "mid", "around"), ["gi", "gj"])
    votes = differing.groupBy("gi", "gj").agg(F.max("mid").alias("mid"), F.max("around").alias("around"), F.array_sort(F.collect_list(F.struct(F.greatest("a", F.abs(F.col("m") - F.col("mid"))).alias("v"), "n"))).alias("_s"))
    pick = F.aggregate("_s", F.struct(F.lit(0).cast("long").alias("c"), F.lit(None).cast("double").alias("v")), lambda a, x: F.struct((a["c"] + x["n"]).alias("c"), F.when(2 * a["c"] < F.col("around"), x["v"]).otherwise(a["v"]).alias("v")))
    spikes = votes.select(F.col("gi").alias("ci"), F.col("gj").alias("cj"), "mid", "around", (SCALE * pick["v"]).alias("s"))
    reason = F.when(F.col("bad"), 1).when((F.col("around") >= least) & (F.col("s") > 1e-12) & (F.abs(F.col("z") - F.col("mid")) > spike * F.col("s")), 2).otherwise(0)
    odd = rows.filter("isnan(x) OR isnan(y) OR isnan(z) OR x IS NULL OR y IS NULL OR z IS NULL").select("_p.*", F.lit(None).cast("int").alias("reason"))
    return d.join(spikes, ["ci", "cj"], "left").select("_p.*", reason.alias("reason")).unionByName(odd)
