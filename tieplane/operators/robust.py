"""Robust statistics and neighbourhood filters. Medians are exact; deviations are of the population."""

from __future__ import annotations

from functools import reduce
from math import floor, inf

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .scans import scan_by_ranges

SCALE = 1.4826


#: Values of a group that one task sorts; where a group has more, ranks are found by a scan over ranges.
HELD = 1_000_000
#: Bins that values between two bounds are counted in, values that are sorted at last, and rounds of bins before ranks are found by a scan.
BINS, FEW, ROUNDS = 512, 200_000, 8


def small_groups(df: DataFrame, keys: list[str]) -> bool:
    """Whether each group fits into a task."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0) <= HELD


def exact_quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float], out: str, small: bool = False) -> DataFrame:
    """Per group the interpolated quantiles of a value, as an array; exact whatever the group's size.

    Groups that fit into a task are sorted there. Larger ones are counted in bins, of which those that hold a wanted rank are counted
    in bins again until what is left is few; so no task holds a group, and what moves does not grow with the rows, which are read three
    or four times. Where that finds no end, or a value is infinite, different values are counted and sorted in ranges, and running
    counts tell which have the wanted ranks. Nulls don't count. Without keys the result is one row. ``small`` says that each group
    fits, so sizes aren't counted.
    """
    named = [f"_k{i}" for i in range(len(keys))]
    d = df.select(*(F.col(k).alias(n) for k, n in zip(keys, named, strict=True)), F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    back = [F.col(n).alias(k) for k, n in zip(keys, named, strict=True)]
    sorted_in_task = lambda x: x.groupBy(*named).agg(F.percentile("_v", F.array(*(F.lit(float(s)) for s in shares))).alias(out)).select(*back, out)
    if small:
        return sorted_in_task(d)
    sizes = d.groupBy(*named).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    groups, large = sizes.agg(F.count(F.lit(1)), F.collect_list(F.when(F.col("_n") > HELD, F.struct("*")))).first()  # one row to HELD rows of the table
    if not large:
        return sorted_in_task(d)
    found = _by_bins(d, named, large, shares)
    if found is not None:
        kind = StructType([*d.select(*named).schema.fields, StructField(out, sizes.select(F.array("_lo").alias("a")).schema["a"].dataType)])
        part = d.sparkSession.createDataFrame([(*(r[k] for k in named), q) for r, q in zip(large, found, strict=True)], kind)
        if groups == len(large):
            return F.broadcast(part.select(*back, out))  # so that a join to it moves no group into one task
        same = reduce(lambda a, b: a & b, [d[k].eqNullSafe(F.col(f"_l.{k}")) for k in named], F.lit(True))
        return sorted_in_task(d.join(F.broadcast(part.select(*named).alias("_l")), same, "left_anti")).unionByName(part.select(*back, out))
    counted = d.groupBy(*named, "_v").agg(F.count(F.lit(1)).alias("_c"))
    run = scan_by_ranges(counted, named, ["_v"], {"_c": "_end"}, {"_c": "_n"})
    has = lambda rank: (F.col("_end") - F.col("_c") <= rank) & (rank < F.col("_end"))
    low = [F.floor(F.lit(float(s)) * (F.col("_n") - 1)) for s in shares]
    high = [F.least(x + 1, F.col("_n") - 1) for x in low]
    ends = run.groupBy(*named).agg(F.max("_n").alias("_n"), *(F.max(F.when(has(x), F.col("_v"))).alias(f"_{side}{i}") for side, ranks in (("a", low), ("z", high)) for i, x in enumerate(ranks)))
    part = lambda i: F.lit(float(shares[i])) * (F.col("_n") - 1) - low[i]
    return ends.select(*back, F.array(*(F.col(f"_a{i}") + (F.col(f"_z{i}") - F.col(f"_a{i}")) * part(i) for i in range(len(shares)))).alias(out))


def _by_bins(d: DataFrame, keys: list[str], groups: list, shares: list[float]) -> list[list[float]] | None:
    """For each of the ``groups`` (keys, number _n, least _lo and greatest _hi of the values _v) its quantiles; None if bins don't settle it."""
    wanted = [sorted({int(r) for s in shares for x in [floor(s * (g["_n"] - 1))] for r in (x, min(x + 1, g["_n"] - 1))}) for g in groups]
    known: list[dict] = [{} for _ in groups]
    open_ = [(g, 0, r["_n"], r["_lo"], r["_hi"]) for g, r in enumerate(groups)]  # group, values before, values, least, greatest
    kind = StructType([*d.select(*keys).schema.fields, StructField("_g", LongType()), StructField("_base", LongType()), StructField("_lo", DoubleType()), StructField("_hi", DoubleType())])
    fits = F.lit(True)
    for k in keys:
        fits = fits & F.col(f"d.{k}").eqNullSafe(F.col(f"b.{k}"))

    def between(bounds: list) -> DataFrame:
        table = d.sparkSession.createDataFrame([(*(groups[g][k] for k in keys), g, base, lo, hi) for g, base, _, lo, hi in bounds], kind)
        return d.alias("d").join(F.broadcast(table.alias("b")), fits & F.col("_v").between(F.col("_lo"), F.col("_hi")))  # a few rows a group

    for _ in range(ROUNDS):
        many = []
        for at in open_:
            g, base, n, lo, hi = at
            if lo == hi:
                known[g] |= {r: lo for r in wanted[g] if base <= r < base + n}
            elif not hi - lo < inf:  # infinite or no number
                return None
            elif n > FEW:
                many.append(at)
        few = [x for x in open_ if x[2] <= FEW and x[3] != x[4]]
        if few:
            ranks = {(g, base): [r - base for r in wanted[g] if base <= r < base + n] for g, base, n, _, _ in few}
            places = d.sparkSession.createDataFrame([(*k, r) for k, r in ranks.items()], "_g long, _base long, _r array<long>")
            ends = between(few).groupBy("_g", "_base").agg(F.array_sort(F.collect_list("_v")).alias("_s")).join(F.broadcast(places), ["_g", "_base"])
            for row in ends.select("_g", "_base", "_r", F.transform("_r", lambda r: F.get("_s", r.cast("int"))).alias("_q")).collect():
                known[row["_g"]] |= {row["_base"] + r: q for r, q in zip(row["_r"], row["_q"], strict=True)}
        if not many:
            break
        share = (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
        bins = between(many).groupBy("_g", "_base", F.least(F.lit(BINS - 1), F.floor(share * BINS).cast("int")).alias("_b")).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        run = F.coalesce(F.sum("_n").over(W.partitionBy("_g", "_base").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # of BINS rows
        ranks = d.sparkSession.createDataFrame([(g, w) for g, w in enumerate(wanted)], "_g long, _w array<long>")
        hit = F.exists("_w", lambda r: (r >= F.col("_from")) & (r < F.col("_from") + F.col("_n")))
        rows = bins.withColumn("_from", F.col("_base") + run).join(F.broadcast(ranks), "_g").filter(hit).collect()  # as many as ranks at most
        open_ = [(r["_g"], r["_from"], r["_n"], r["_lo"], r["_hi"]) for r in rows]
    else:
        return None
    out = []
    for g, r in enumerate(groups):
        at = [s * (r["_n"] - 1) for s in shares]
        ends = [(known[g][floor(x)], known[g][min(floor(x) + 1, r["_n"] - 1)]) for x in at]
        out.append([a + (z - a) * (x - floor(x)) for x, (a, z) in zip(at, ends, strict=True)])
    return out


def quantile_row(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row of quantiles over all rows: new name to (column, share)."""
    small = small_groups(df, [])
    rows = [exact_quantiles(df, [], c, [s], "_q", small).select(F.get("_q", F.lit(0)).alias(out)) for out, (c, s) in wanted.items()]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), rows)  # of one row each


def with_median(df: DataFrame, keys: list[str], value: str, out: str, small: bool = False) -> DataFrame:
    """Adds a group's median; an overall median comes from one row."""
    q = exact_quantiles(df, keys, value, [0.5], "_q", small).withColumn(out, F.get("_q", F.lit(0))).drop("_q")
    return df.join(q, keys, "left") if keys else df.join(F.broadcast(q))


def mad_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, med, mad, sigma (1.4826 mad, the deviation where that is next to nothing), outlier_pct."""
    d = df.select(*keys, value).filter(F.col(value).isNotNull())
    small = small_groups(d, keys)
    d = with_median(d, keys, value, "med", small).withColumn("_d", F.abs(F.col(value) - F.col("med")))
    d = with_median(d, keys, "_d", "mad", small)
    scale = SCALE * F.col("mad")
    out = F.when(scale < 1e-12, 0.0).when(F.col("_d") > 3.0 * scale, 1.0).otherwise(0.0)
    agg = [F.count(F.lit(1)).alias("n"), F.max("med").alias("med"), F.max("mad").alias("mad"), F.stddev_pop(value).alias("_std"), (F.avg(out) * 100.0).alias("outlier_pct")]
    return d.groupBy(*keys).agg(*agg).withColumn("sigma", F.when(SCALE * F.col("mad") <= 1e-12, F.col("_std")).otherwise(SCALE * F.col("mad"))).drop("_std")


def robust_z_filter(df: DataFrame, keys: list[str], values: list[str], k: float, least: int = 5) -> DataFrame:
    """Rows whose |0.6745 (v - med) / MAD| is at most k for all values. Groups of fewer than ``least`` pass
    whole; a MAD of zero gives z = 0."""
    out, small = df, small_groups(df, keys)
    for i, v in enumerate(values):
        out = with_median(out, keys, v, f"_m{i}", small).withColumn(f"_d{i}", F.abs(F.col(v) - F.col(f"_m{i}")))
        out = with_median(out, keys, f"_d{i}", f"_a{i}", small)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    out = out.join(sizes, keys) if keys else out.join(F.broadcast(sizes))
    fine = F.lit(True)
    for i in range(len(values)):
        fine = fine & F.when(F.col(f"_a{i}") == 0, True).otherwise(0.6745 * F.col(f"_d{i}") <= k * F.col(f"_a{i}"))
    return out.filter((F.col("_n") < least) | fine).select(*df.columns)


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str, tie: list[str], out: str = "wmedian", small: bool = False) -> DataFrame:
    """Lower weighted median: the first value at which the weights' running sum reaches half of their total.
    Negative weights count as zero; without any weight it is the middle value (of even counts the upper). ``small`` says that each group
    fits into a task, as a point's neighbours do; others are scanned in ranges."""
    d = df.withColumns({"_w": F.greatest(F.col(weight), F.lit(0.0)), "_one": F.lit(1)})
    if small:
        run, all_ = W.partitionBy(*keys).orderBy(value, *tie).rowsBetween(W.unboundedPreceding, 0), W.partitionBy(*keys)
        d = d.withColumns({"_acc": F.sum("_w").over(run), "_i": F.sum("_one").over(run), "_tot": F.sum("_w").over(all_), "_n": F.sum("_one").over(all_)})
    else:
        d = scan_by_ranges(d, keys, [value, *tie], {"_w": "_acc", "_one": "_i"}, {"_w": "_tot", "_one": "_n"})
    middle = F.min(F.when(F.col("_i") == F.floor(F.col("_n") / 2) + 1, F.col(value)))
    reached = F.min(F.when((F.col("_tot") > 0) & (F.col("_acc") >= 0.5 * F.col("_tot")), F.col(value)))
    return d.groupBy(*keys).agg(F.coalesce(reached, middle).alias(out))


def moments(pairs: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Count, means mr, mc, variances vr, vc and covariance cov of two values per group, from sums that are added up before the
    shuffle; for values of a size with their spread, such as disparities."""
    a, b, n = F.col(x), F.col(y), F.col("n")
    s = pairs.select(*keys, a.alias("_a"), b.alias("_b")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("_a").alias("_a"), F.sum("_b").alias("_b"), F.sum(F.col("_a") * F.col("_a")).alias("_aa"), F.sum(F.col("_b") * F.col("_b")).alias("_bb"), F.sum(F.col("_a") * F.col("_b")).alias("_ab"))
    mean = {"mr": F.col("_a") / n, "mc": F.col("_b") / n}
    zero = F.lit(0.0)
    return s.select(*keys, "n", *(v.alias(k) for k, v in mean.items()), F.greatest(zero, F.col("_aa") / n - mean["mr"] * mean["mr"]).alias("vr"), F.greatest(zero, F.col("_bb") / n - mean["mc"] * mean["mc"]).alias("vc"), (F.col("_ab") / n - mean["mr"] * mean["mc"]).alias("cov"))


def mahalanobis_ok(n: Column, mr: Column, mc: Column, vr: Column, vc: Column, cov: Column, dr: Column, dc: Column, k: float = 1.0, least: int = 5) -> Column:
    """Whether a disparity lies within k of its neighbours' distribution; variances count as 1 at least, and
    where they are as good as singular each axis is tested by itself."""
    a, b = F.greatest(vr, F.lit(1.0)), F.greatest(vc, F.lit(1.0))
    x, y, det = dr - mr, dc - mc, a * b - cov * cov
    single = (F.abs(x) / F.sqrt(a) <= k) & (F.abs(y) / F.sqrt(b) <= k)
    both = (b * x * x - 2.0 * cov * x * y + a * y * y) / F.nullif(det, F.lit(0.0)) <= k * k
    return (n >= least) & F.when(det < 1e-6, single).otherwise(both)


def affine_residual(row: Column, col: Column, mrow: Column, mcol: Column, f) -> tuple[Column, Column]:
    f0, f1, f2, f3, f4, f5 = (x if isinstance(x, Column) else F.lit(float(x)) for x in f)
    return mrow - (f0 * row + f1 * col + f2), mcol - (f3 * row + f4 * col + f5)


def affine_gate(vx: Column, vy: Column, radius: float, limit_x: float, limit_y: float) -> Column:
    """Strictly inside all three limits."""
    return (F.sqrt(vx * vx + vy * vy) < radius) & (F.abs(vx) < limit_x) & (F.abs(vy) < limit_y)


def rescue_gate(residual: Column, score: Column, sigma: float, least: float) -> Column:
    """Inside sigma, or inside twice that with a high score."""
    return (residual < sigma) | ((score >= least) & (residual < 2.0 * sigma))


def neighbour_filter(points: DataFrame, pairs: DataFrame, key: str, values: list[tuple[str, str]], k: float, isolated: bool, weight: Column | None = None) -> DataFrame:
    """Keeps points whose values differ from their neighbours' mean by less than k deviations (strictly).

    ``pairs`` has a row per neighbour with the point's key; ``values`` are (own column, neighbour column). A
    weight turns the mean into a weighted one, the deviation stays unweighted about it. Points without
    neighbours stay if ``isolated``; with equal neighbours the deviation is 0 and nothing passes.
    """
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, (_, v) in enumerate(values):
        mean = F.avg(v) if weight is None else F.sum(weight * F.col(v)) / F.sum(weight)
        aggs += [mean.alias(f"_m{i}"), F.avg(v).alias(f"_a{i}"), F.var_pop(v).alias(f"_v{i}")]
    joined = points.join(pairs.groupBy(key).agg(*aggs), key, "left")
    fine = F.lit(True)
    for i, (own, _) in enumerate(values):
        shift = F.col(f"_a{i}") - F.col(f"_m{i}")
        fine = fine & (F.abs(F.col(own) - F.col(f"_m{i}")) < k * F.sqrt(F.col(f"_v{i}") + shift * shift))
    return joined.filter(F.when(F.col("_n").isNull(), F.lit(isolated)).otherwise(fine)).select(*points.columns)


def moments_filter(points: DataFrame, sums: DataFrame, key: str, values: list[tuple[str, str]], k: float, isolated: bool, weighted: bool = False) -> DataFrame:
    """``neighbour_filter`` from the moments that ``neighbours.radius_moments`` or, if ``weighted``, ``radius_weighted`` gives."""
    joined, fine = points.join(sums, key, "left"), F.lit(True)
    for own, v in values:
        mean, flat = F.col(f"w_{v}" if weighted else f"m_{v}"), F.col(f"m_{v}")
        fine = fine & (F.abs(F.col(own) - mean) < k * F.sqrt(F.col(f"v_{v}") + (flat - mean) * (flat - mean)))
    return joined.filter(F.when(F.col("n").isNull(), F.lit(isolated)).otherwise(fine)).select(*points.columns)


def failure_reason(in_image: Column, has_window: Column, seeds: Column, least: int, score: Column, least_score: float, residual: Column, limit: float) -> Column:
    """Why a grid point has no match, the first that holds; null for a match."""
    return (
        F.when(~in_image, "outside").when(~has_window, "no_window").when(seeds < least, "few_seeds")
        .when(score.isNull(), "no_candidate").when(score < least_score, "low_score").when(residual >= limit, "affine_gate")
    )


def reason_report(rows: DataFrame, reason: str, bucket: str, key: str, most: int = 800) -> tuple[DataFrame, DataFrame]:
    """Counts by reason and bucket, and a sample: of each reason the ``most`` rows of smallest hash of the key."""
    counts = rows.groupBy(reason, bucket).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(reason).orderBy(F.md5(F.col(key).cast("string").cast("binary")), key)
    return counts, rows.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= most).drop("_k")


def valid_tiles(mosaic: DataFrame) -> DataFrame:
    """Tiles that have an extent."""
    return mosaic.filter("r1 > r0 AND c1 > c0")


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(weight * value) / F.nullif(F.sum(weight), F.lit(0.0))


def mutual_information(df: DataFrame, a: str, b: str, eps: float = 1e-6) -> DataFrame:
    """Per cell of the joint histogram its pointwise mutual information, from counts and marginals."""
    joint = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    total = joint.agg(F.sum("n").alias("_t"))
    ma, mb = joint.groupBy(a).agg(F.sum("n").alias("_a")), joint.groupBy(b).agg(F.sum("n").alias("_b"))
    j = joint.join(ma, a).join(mb, b).join(F.broadcast(total))
    return j.select(a, b, "n", F.ln((F.col("n") / F.col("_t") + eps) / (F.col("_a") / F.col("_t") * (F.col("_b") / F.col("_t")) + eps)).alias("mi"))


def solve_affine(df: DataFrame, keys: list[str], row: str, col: str, mrow: str, mcol: str) -> DataFrame:
    """Least-squares affine per group from one aggregate of sums and Cramer's rule, about the group's centre.
    Groups whose points lie on a line get nulls."""
    centre = df.groupBy(*keys).agg(F.avg(row).alias("_cr"), F.avg(col).alias("_cc"), F.avg(mrow).alias("_mr"), F.avg(mcol).alias("_mc"))
    d = df.join(centre, keys) if keys else df.join(F.broadcast(centre))
    x, y, u, v = F.col(row) - F.col("_cr"), F.col(col) - F.col("_cc"), F.col(mrow) - F.col("_mr"), F.col(mcol) - F.col("_mc")
    s = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(x * x).alias("xx"), F.sum(x * y).alias("xy"), F.sum(y * y).alias("yy"), F.sum(x * u).alias("xu"), F.sum(y * u).alias("yu"),
        F.sum(x * v).alias("xv"), F.sum(y * v).alias("yv"), *(F.max(c).alias(c) for c in ("_cr", "_cc", "_mr", "_mc")),
    )
    raw = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    det = F.when(raw > 1e-9 * F.col("xx") * F.col("yy"), raw)
    a, b = (F.col("xu") * F.col("yy") - F.col("yu") * F.col("xy")) / det, (F.col("yu") * F.col("xx") - F.col("xu") * F.col("xy")) / det
    c, e = (F.col("xv") * F.col("yy") - F.col("yv") * F.col("xy")) / det, (F.col("yv") * F.col("xx") - F.col("xv") * F.col("xy")) / det
    return s.select(*keys, "n", a.alias("f0"), b.alias("f1"), (F.col("_mr") - a * F.col("_cr") - b * F.col("_cc")).alias("f2"), c.alias("f3"), e.alias("f4"), (F.col("_mc") - c * F.col("_cr") - e * F.col("_cc")).alias("f5"))


def inside_border(row: Column, col: Column, rows: Column, cols: Column, border_r: float, border_c: float) -> Column:
    """A window of half sizes border_r, border_c about the point fits into the image."""
    return (row >= border_r) & (col >= border_c) & (row < rows - border_r) & (col < cols - border_c)


def window_touches(row: Column, col: Column, r0: float, r1: float, c0: float, c1: float, reach_r: float, reach_c: float) -> Column:
    """A search window about the point touches the box."""
    return (row + reach_r >= r0) & (row - reach_r <= r1) & (col + reach_c >= c0) & (col - reach_c <= c1)
