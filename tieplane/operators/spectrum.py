"""Spectra of unevenly sampled series by least squares, and the waves found in them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import held


def frequency_grid(span: float, most: float, per_line: int = 4) -> list[float]:
    """Frequencies from one wave in the span up to ``most``, ``per_line`` to a line's width."""
    step = 1.0 / (per_line * span)
    return [k * step for k in range(per_line, math.floor(most / step) + 1)]


def _wave(n: Column, s: dict[str, Column]) -> tuple[Column, Column, Column]:
    """Amplitudes of cosine and sine, and the share of the variance that they and a constant explain, of sums."""
    cc, ss, cs = s["cc"] - s["c"] * s["c"] / n, s["ss"] - s["s"] * s["s"] / n, s["cs"] - s["c"] * s["s"] / n
    vc, vs, vv = s["vc"] - s["v"] * s["c"] / n, s["vs"] - s["v"] * s["s"] / n, s["vv"] - s["v"] * s["v"] / n
    det = F.nullif(cc * ss - cs * cs, F.lit(0.0))
    a, b = (vc * ss - vs * cs) / det, (vs * cc - vc * cs) / det
    return a, b, (a * vc + b * vs) / F.nullif(vv, F.lit(0.0))


def spectrum(series: DataFrame, keys: list[str], t: str, v: str, frequencies: list[float]) -> DataFrame:
    """keys, frequency, n, amplitudes a (cosine) and b (sine) about the time 0, and power, the share of the variance that
    a wave explains (0 to 1; null where there are too few samples or all are alike).

    One aggregate over group and frequency: sums are added up before anything moves, so a group may have any number of samples.
    Rows with a null are no samples. The number of frequencies is that of the grid, whatever the input.
    """
    d = series.select(*keys, F.col(t).cast("double").alias("_t"), F.col(v).cast("double").alias("_v")).filter("_t IS NOT NULL AND _v IS NOT NULL")
    d = d.withColumn("frequency", F.explode(F.array(*map(F.lit, frequencies))))
    turn = 2.0 * math.pi * F.col("frequency") * F.col("_t")
    d = d.withColumns({"_c": F.cos(turn), "_s": F.sin(turn)})
    c, s, y = F.col("_c"), F.col("_s"), F.col("_v")
    terms = {"c": c, "s": s, "v": y, "cc": c * c, "ss": s * s, "cs": c * s, "vc": y * c, "vs": y * s, "vv": y * y}
    sums = d.groupBy(*keys, "frequency").agg(F.count(F.lit(1)).alias("n"), *(F.sum(e).alias(f"_{k}") for k, e in terms.items()))
    a, b, power = _wave(F.col("n"), {k: F.col(f"_{k}") for k in terms})
    return sums.select(*keys, "frequency", "n", a.alias("a"), b.alias("b"), power.alias("power"))


def peaks(spectra: DataFrame, keys: list[str], step: float) -> DataFrame:
    """Of each group the frequency of most power, of equal ones the lowest, moved to the top of the parabola through it and its
    neighbours on the grid (by less than half a step)."""
    best = spectra.filter("power IS NOT NULL").groupBy(*keys).agg(F.max(F.struct("power", (-F.col("frequency")).alias("f"))).alias("_b"))
    best = best.select(*keys, F.col("_b.power").alias("power"), (-F.col("_b.f")).alias("_f"))
    near = spectra.select(*keys, F.col("frequency").alias("_g"), F.col("power").alias("_p")).join(best, keys) if keys else spectra.select(F.col("frequency").alias("_g"), F.col("power").alias("_p")).join(F.broadcast(best))
    side = lambda k: F.max(F.when(F.abs(F.col("_g") - F.col("_f") - k * step) < step / 4, F.col("_p")))
    found = near.groupBy(*keys, "_f", "power").agg(side(-1).alias("_l"), side(1).alias("_r"))
    bend = F.col("_l") - 2.0 * F.col("power") + F.col("_r")
    shift = F.coalesce(F.when(bend < 0, 0.5 * (F.col("_l") - F.col("_r")) / bend), F.lit(0.0))
    return found.select(*keys, (F.col("_f") + step * shift).alias("frequency"), "power")


def jitter_waves(series: DataFrame, keys: list[str], t: str, v: str, most: float, waves: int = 1, least: float = 0.1) -> DataFrame:
    """The strongest waves of each group: keys, wave (from 0), frequency, power. A wave is taken out before the next is looked for; a
    group ends where the next explains less than ``least`` of what is left. ``most`` is the highest frequency."""
    span = series.agg((F.max(t) - F.min(t)).alias("s")).first()[0] or 1.0
    grid, left, out = frequency_grid(float(span), most), series.select(*keys, t, v), None
    for k in range(waves):
        one = held(peaks(spectrum(left, keys, t, v, grid), keys, grid[1] - grid[0] if len(grid) > 1 else grid[0]).filter(F.col("power") >= least), "peaks")
        out = (lambda d: d if out is None else out.unionByName(d))(one.withColumn("wave", F.lit(k)))
        if k + 1 == waves or one.isEmpty():
            break
        left = held(without_wave(left, one, keys, t, v), "left")
    return out.select(*keys, "wave", "frequency", "power")


def without_wave(series: DataFrame, waves: DataFrame, keys: list[str], t: str, v: str) -> DataFrame:
    """The series less a wave per group, fitted at the group's frequency; groups without one end."""
    d = series.join(waves.select(*keys, F.col("frequency").alias("_f")), keys) if keys else series.crossJoin(F.broadcast(waves.select(F.col("frequency").alias("_f"))))
    turn = 2.0 * math.pi * F.col("_f") * F.col(t)
    d = d.withColumns({"_c": F.cos(turn), "_s": F.sin(turn)})
    c, s, y = F.col("_c"), F.col("_s"), F.col(v)
    terms = {"c": c, "s": s, "v": y, "cc": c * c, "ss": s * s, "cs": c * s, "vc": y * c, "vs": y * s, "vv": y * y}
    sums = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *(F.sum(e).alias(f"_q{k}") for k, e in terms.items()))
    a, b, _ = _wave(F.col("_n"), {k: F.col(f"_q{k}") for k in terms})
    fitted = sums.select(*keys, a.alias("_a"), b.alias("_b"))
    d = d.join(fitted, keys) if keys else d.crossJoin(F.broadcast(fitted))
    return d.select(*keys, t, (y - F.coalesce("_a", F.lit(0.0)) * c - F.coalesce("_b", F.lit(0.0)) * s).alias(v))
