"""Model fits per group as Arrow kernels: affine RANSAC, local affine fields, surfaces, time polynomials."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import held
from .neighbours import BASIS, QUADRATIC

AFFINE = [f"f{i}" for i in range(6)]
IDENTITY = np.array([1.0, 0, 0, 0, 1, 0])
#: Rows of a group that triples are drawn from, about; different rows that one task scores, about; shares a group is dealt in.
DRAWN, BLOCK, SALTS = 10_000, 50_000, 64
#: Models of a large group that lead on the drawn rows and so are scored by all rows; what moves to its blocks does not grow with the trials.
LEADERS = 256


def least_squares_affine(p: np.ndarray, q: np.ndarray) -> np.ndarray | None:
    """Six parameters that take rows of p to q; None for points on a line."""
    centre, target = p.mean(axis=0), q.mean(axis=0)
    d = p - centre
    if len(p) < 3 or np.linalg.matrix_rank(d, tol=1e-9 * max(1.0, np.abs(d).max())) < 2:
        return None
    a = np.linalg.lstsq(d, q - target, rcond=None)[0].T
    t = target - a @ centre
    return np.array([a[0, 0], a[0, 1], t[0], a[1, 0], a[1, 1], t[1]])


def predict(f: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.stack([f[0] * p[:, 0] + f[1] * p[:, 1] + f[2], f[3] * p[:, 0] + f[4] * p[:, 1] + f[5]], axis=1)


def near(m: np.ndarray, points: np.ndarray, sigma: float) -> np.ndarray:
    """Whether each affine takes each point (row, col, mrow, mcol) to its match within sigma."""
    r, c, u, v = points.T
    f = m.T[:, :, None]
    return np.hypot(f[0] * r + f[1] * c + f[2] - u, f[3] * r + f[4] * c + f[5] - v) <= sigma


def near_plane(m: np.ndarray, points: np.ndarray, sigma: float) -> np.ndarray:
    """Whether each plane z = a x + b y + c is within sigma of each point (x, y, z), upwards."""
    x, y, z = points.T
    f = m.T[:, :, None]
    return np.abs(f[0] * x + f[1] * y + f[2] - z) <= sigma


def through_triples(points: np.ndarray, trials: int, seed: int) -> np.ndarray:
    """The linear maps of the first two coordinates and 1 to the others through seeded triples of points, a row each,
    output by output; triples on a line give none."""
    outputs = points.shape[1] - 2
    if len(points) < 3:
        return np.empty((0, 3 * outputs))
    pick = np.random.default_rng(seed).integers(0, len(points), (trials, 3))
    a = np.concatenate([points[pick][:, :, :2], np.ones((trials, 3, 1))], axis=2)
    fine = np.abs(np.linalg.det(a)) > 1e-9
    return np.linalg.solve(a[fine], points[pick[fine]][:, :, 2:]).transpose(0, 2, 1).reshape(-1, 3 * outputs)


def refit(s: np.ndarray, origin: np.ndarray, found: np.ndarray) -> np.ndarray:
    """The least-squares map from sums about an origin: n, the sums of x, y and the outputs, xx, xy, yy, and xu, yu for each
    output u; for points on a line what was found."""
    outputs = len(origin) - 2
    n, mean = s[0], s[1 : 3 + outputs] / s[0]
    x, y = mean[:2]
    xx, xy, yy = s[3 + outputs : 6 + outputs] - n * np.array([x * x, x * y, y * y])
    det = xx * yy - xy * xy
    if not det > 1e-9 * xx * yy:
        return found
    out = []
    for k in range(outputs):
        xu, yu = s[6 + outputs + 2 * k : 8 + outputs + 2 * k] - n * mean[2 + k] * mean[:2]
        a, b = (xu * yy - yu * xy) / det, (yu * xx - xu * xy) / det
        out += [a, b, origin[2 + k] + mean[2 + k] - a * (origin[0] + x) - b * (origin[1] + y)]
    return np.array(out)


def needed_trials(share: float, confidence: float = 0.999) -> float:
    """How many triples it takes to draw one of inliers only with that confidence."""
    return np.log(1 - confidence) / np.log1p(-min(max(share, 1e-9) ** 3, 1 - 1e-12))


#: Points that models are held against at once, and pairs of a model and a point: what a core's cache takes.
STRETCH, AT_ONCE = 8192, 65_536


def _supported(m: np.ndarray, p: np.ndarray, w: np.ndarray, inside_of, sigma: float) -> np.ndarray:
    """The weight of the points that each model is within sigma of."""
    out, weights = np.zeros(len(m), np.int64), w.astype(float)  # sums of whole numbers are exact
    for at in range(0, len(p), STRETCH):
        q, v = np.ascontiguousarray(p[at : at + STRETCH].T).T, weights[at : at + STRETCH]
        step = max(1, AT_ONCE // len(q))
        for lo in range(0, len(m), step):
            out[lo : lo + step] += (inside_of(m[lo : lo + step], q, sigma) @ v).astype(np.int64)
    return out


def _inlier_sums(p: np.ndarray, w: np.ndarray, f: np.ndarray, o: np.ndarray, inside_of, sigma: float) -> list[float]:
    """What ``refit`` needs of the points within sigma of a model, about an origin."""
    inside = inside_of(f[None], p, sigma)[0]
    q, w = (p[inside] - o).T, w[inside]
    terms = [np.ones(len(w)), *q, q[0] * q[0], q[0] * q[1], q[1] * q[1], *(q[i] * q[2 + k] for k in range(p.shape[1] - 2) for i in (0, 1))]
    return [float((w * t).sum()) for t in terms]


def _ransac_whole(d: DataFrame, keys: list[str], point: list[str], names: list[str], named: str, identity: np.ndarray, inside_of, sigma: float, trials: int, seed: int) -> DataFrame:
    """A group at a time, where no group has more rows than triples are drawn from; the same results as in blocks."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(point)
        p, w = pdf[point].to_numpy(), pdf["_w"].to_numpy()
        at = p.repeat(w, axis=0)
        m, o, f = through_triples(at, trials, seed), at.mean(axis=0), identity
        if len(m):
            best = m[int(_supported(m, p, w, inside_of, sigma).argmax())]
            s = np.array(_inlier_sums(p, w.astype(float), best, o, inside_of, sigma))
            f = refit(s, o, best) if s[0] >= 3 else identity
        return pd.DataFrame([[*pdf[keys].iloc[0], *f, w.sum(), w[inside_of(f[None], p, sigma)[0]].sum()]], columns=[*keys, *names, "n", "inliers"])

    return d.groupBy(*keys).applyInPandas(run, f"{named}{', '.join(f'{f} double' for f in names)}, n long, inliers long")


class _Groups:
    """What all rounds of a RANSAC read, made once: the different rows of each group with how often each stands, the groups' sizes and,
    where a group is large, its rows in blocks, a row each. So a round moves models and sums, not points."""

    def __init__(self, df: DataFrame, keys: list[str], point: list[str], seed: int):
        self.keys, self.point, self.seed = keys, point, seed
        self.different = held(df.groupBy(*keys, *(F.col(x).cast("double").alias(x) for x in point)).agg(F.count(F.lit(1)).alias("_w")))
        self.size = held(self.different.groupBy(*keys).agg(F.sum("_w").alias("_n"), F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("_blocks")))
        self._blocks = None

    def dealt(self, size: DataFrame) -> DataFrame:
        """Rows of the groups in ``size`` with their hash and their block."""
        hashed = self.different.withColumn("_h", F.xxhash64(*self.point, F.lit(self.seed))).withColumn("_s", F.pmod("_h", F.lit(SALTS)).cast("int"))
        salted = size.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return hashed.join(salted, [*self.keys, "_s"]).withColumn("_b", F.pmod(F.shiftrightunsigned("_h", 8), F.col("_blocks")).cast("int"))

    def blocks(self, named: str) -> DataFrame:
        if self._blocks is None:
            keys, point, by = self.keys, self.point, [*self.keys, "_b"]

            def pack(pdf: pd.DataFrame) -> pd.DataFrame:
                pdf = pdf.sort_values(point)
                return pd.DataFrame([[*pdf[by].iloc[0], pdf[point].to_numpy().ravel(), pdf["_w"].to_numpy()]], columns=[*by, "_p", "_w"])

            rows = self.dealt(self.size).select(*by, *point, "_w")
            self._blocks = held(rows.groupBy(*by).applyInPandas(pack, f"{named}_b int, _p array<double>, _w array<long>"))
        return self._blocks


#: Groups whose models are sent to all tasks, at most; those of more are dealt to their blocks.
SENT = 1000


def _ransac(g: _Groups, size: DataFrame, names: list[str], identity: np.ndarray, inside_of, sigma: float, trials: int) -> DataFrame:
    """One round for the groups in ``size``."""
    c, keys, point, seed = F.col, g.keys, g.point, g.seed
    kinds = {f.name: f.dataType.simpleString() for f in size.schema.fields}
    named = "".join(f"{k} {kinds[k]}, " for k in keys)
    largest, groups = size.agg(F.max("_n"), F.count(F.lit(1))).first()
    if (largest or 0) <= DRAWN:
        return _ransac_whole(g.different.join(size.select(*keys), keys, "left_semi"), keys, point, names, named, identity, inside_of, sigma, trials, seed)
    even = F.pmod(F.xxhash64(*point, F.lit(seed + 1)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    drawn = g.dealt(size).withColumn("_k", F.floor(c("_w") * F.least(F.lit(1.0), F.lit(float(DRAWN)) / c("_n")) + even)).filter("_k > 0")

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(point)
        at = pdf[point].to_numpy().repeat(pdf["_k"].to_numpy(), axis=0)
        m = through_triples(at, trials, seed)
        if len(m) > LEADERS:
            support = _supported(m, pdf[point].to_numpy(), pdf["_k"].to_numpy(), inside_of, sigma)
            m = m[np.sort(np.argsort(-support, kind="stable")[:LEADERS])]
        return pd.DataFrame([[*pdf[keys].iloc[0], pdf["_blocks"].iloc[0], m.ravel(), at.mean(axis=0)]], columns=[*keys, "_blocks", "_m", "_o"])

    def each_block(table: DataFrame, work, out: str) -> DataFrame:
        """``work(points, weights, row)`` of each block with its group's row of ``table``, next to the keys."""
        if groups <= SENT:
            met = g.blocks(named).join(F.broadcast(table), keys)
        else:
            met = g.blocks(named).join(table.withColumn("_b", F.explode(F.sequence(F.lit(0), c("_blocks") - 1))).hint("merge"), [*keys, "_b"])
        met = met.drop("_blocks")

        def run(batches):
            for pdf in batches:
                for _, row in pdf.iterrows():
                    p, w = np.reshape(row["_p"], (-1, len(point))), np.asarray(row["_w"])
                    yield pd.DataFrame([[*(row[k] for k in keys), *work(p, w, row)]], columns=columns)

        columns = [*keys, *(x.split()[0] for x in out.split(", "))]
        return met.mapInPandas(run, named + out)

    def score(p, w, row) -> list:
        return [_supported(np.reshape(row["_m"], (-1, len(names))), p, w, inside_of, sigma)]

    def add(p, w, row) -> list:
        return [row["_b"], _inlier_sums(p, w.astype(float), np.asarray(row["_f"]), np.asarray(row["_o"]), inside_of, sigma)]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        s = np.stack(pdf.sort_values("_b")["_sums"].to_numpy()).sum(axis=0)
        f = refit(s, np.array(pdf["_o"].iloc[0]), np.array(pdf["_f"].iloc[0])) if s[0] >= 3 else identity
        return pd.DataFrame([[*pdf[keys].iloc[0], *f]], columns=[*keys, *names])

    def count(p, w, row) -> list:
        f = np.array([row[x] for x in names], dtype=float)
        return [*f, w.sum(), w[inside_of(f[None], p, sigma)[0]].sum()]

    listed = ", ".join(f"{f} double" for f in names)
    models = held(drawn.select(*keys, "_blocks", *point, "_k").groupBy(*keys).applyInPandas(draw, f"{named}_blocks int, _m array<double>, _o array<double>"))
    counts = each_block(models.select(*keys, "_blocks", "_m"), score, "_c array<long>")
    total = counts.select(*keys, F.posexplode("_c").alias("_t", "_c")).groupBy(*keys, "_t").agg(F.sum("_c").alias("_c"))
    most = total.groupBy(*keys).agg(F.max(F.struct("_c", (-c("_t")).alias("_t"))).alias("_best"))
    best = held(models.join(most, keys).select(*keys, "_blocks", "_o", F.slice("_m", 1 - len(names) * c("_best._t"), len(names)).alias("_f")))
    sums = each_block(best, add, "_b int, _sums array<double>")
    solved = sums.join(best.select(*keys, "_o", "_f"), keys).groupBy(*keys).applyInPandas(solve, named + listed)
    fitted = size.select(*keys, "_blocks").join(solved, keys, "left").select(*keys, "_blocks", *(F.coalesce(f, F.lit(float(x))).alias(f) for f, x in zip(names, identity, strict=True)))
    counted = each_block(fitted, count, f"{listed}, _w long, _in long")
    return counted.groupBy(*keys, *names).agg(F.sum("_w").alias("n"), F.sum("_in").alias("inliers"))


def _until_sure(g: _Groups, trials: int, most: int, run) -> DataFrame:
    """``run(sizes, trials)`` of all groups, and again for the groups whose share of inliers leaves that number of triples unsure; those get
    as many as the worst of them needs, ``most`` at most."""
    keys = g.keys
    first = held(run(g.size, trials))
    share = F.greatest(F.col("inliers") / F.col("n"), F.lit(1e-3))
    need = first.select(*keys, F.ceil(F.lit(float(-np.log(1e-3))) / -F.log1p(-F.least(F.pow(share, F.lit(3.0)), F.lit(1 - 1e-12)))).alias("_need"), "inliers")
    unsure = need.filter((F.col("_need") > trials) & (F.col("inliers") >= 3))
    worst = unsure.agg(F.max("_need")).first()[0]
    if worst is None:
        return first
    groups = unsure.select(*keys)
    again = run(held(g.size.join(groups, keys, "left_semi")), int(min(worst, most)))
    return first.join(groups, keys, "left_anti").unionByName(again)


#: Triples of a group at most, and drawn at first.
MOST, FIRST = 150_000, 300


def affine_ransac(matches: DataFrame, keys: list[str], sigma: float = 150.0, trials: int = FIRST, seed: int = 0, most: int = MOST) -> DataFrame:
    """One affine per group of matches (row, col, mrow, mcol): f0..f5, n, inliers.

    Only the triples of the trials are drawn from about DRAWN rows of a group, spread evenly by hash. All its
    rows count for each trial, and the affine with most residuals inside sigma is refitted to all its inliers, both
    by sums over blocks of about BLOCK different rows, so no task holds a group. Groups in which a triple of inliers
    only may have been missed, by the share of inliers found and a confidence of 0.999, are tried again with as
    many triples as that takes, ``most`` at most. With fewer than three inliers the identity stays. ``inliers``
    counts all rows against the result.
    """
    point = ["row", "col", "mrow", "mcol"]
    g = _Groups(matches.select(*keys, *point), list(keys), point, seed)
    return _until_sure(g, trials, most, lambda size, n: _ransac(g, size, AFFINE, IDENTITY, near, sigma, n))


def plane_ransac(points: DataFrame, keys: list[str], sigma: float, trials: int = FIRST, seed: int = 0, most: int = MOST) -> DataFrame:
    """One plane z = a x + b y + c per group of points (x, y, z) like ``affine_ransac``: a, b, c, n, inliers. With fewer than
    three inliers the plane is z = 0."""
    point = ["x", "y", "z"]
    g = _Groups(points.select(*keys, *point), list(keys), point, seed)
    return _until_sure(g, trials, most, lambda size, n: _ransac(g, size, ["a", "b", "c"], np.zeros(3), near_plane, sigma, n))


def local_affine_field(matches: DataFrame, tile_r: float, tile_c: float, sigma: float = 20.0, trials: int = FIRST, least: int = 12, seed: int = 0, keys: list[str] = ()) -> DataFrame:
    """An affine per tile, fitted to the points of the tile grown by half a tile on each side: keys, tile_r, tile_c,
    f0..f5, n, inliers, valid. Each point goes to the four tiles at most whose grown area it lies in."""
    near = lambda x, size: F.array_distinct(F.array(F.floor(F.col(x) / size - 0.5), F.floor(F.col(x) / size + 0.5)))
    spread = matches.withColumn("tile_r", F.explode(near("row", tile_r))).withColumn("tile_c", F.explode(near("col", tile_c)))
    own = [*keys, "tile_r", "tile_c"]
    out = affine_ransac(spread.select(*own, "row", "col", "mrow", "mcol"), own, sigma, trials, seed)
    return out.withColumn("valid", (F.col("n") >= least) & (F.col("inliers") >= F.greatest(F.lit(3.0), 0.3 * F.col("n"))))


def quadratic_surface(pairs: DataFrame, keys: list[str], dr: str, dc: str, value: str, weight: str, out: str) -> DataFrame:
    """The value at the origin of a weighted quadratic in (dr, dc) per group; groups of fewer than six points,
    or in a degenerate place, get the weighted mean. Sums are pre-aggregated, kernels see 22 numbers a group."""
    power = lambda i, j: reduce(lambda x, y: x * y, [F.col(dr)] * i + [F.col(dc)] * j, F.col(weight))
    d = pairs.select(*keys, F.col(value).alias("_z"), *(power(i, j).alias(f"_m{i}{j}") for i, j in QUADRATIC))
    sums = [F.sum(f"_m{i}{j}").alias(f"_m{i}{j}") for i, j in QUADRATIC] + [F.sum(F.col(f"_m{i}{j}") * F.col("_z")).alias(f"_b0{i}{j}") for i, j in BASIS]
    return surfaces_of(d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *sums), keys, [out])


def surfaces_of(sums: DataFrame, keys: list[str], outs: list[str]) -> DataFrame:
    """keys, n and for each value its surface at the origin, of the sums _n, _mij and, of value k, _bkij."""

    @F.pandas_udf("double")
    def solve(n: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        at = np.triu_indices(6)
        m = np.zeros((len(n), 6, 6))
        m[:, at[0], at[1]] = np.stack(a.to_numpy()) if len(a) else np.zeros((0, 21))
        m = m + np.triu(m, 1).transpose(0, 2, 1)
        v = np.stack(b.to_numpy()) if len(b) else np.zeros((0, 6))
        mean = v[:, 0] / np.where(m[:, 0, 0] == 0, np.nan, m[:, 0, 0])
        scale = np.sqrt(np.maximum(np.einsum("kii->ki", m), 1e-300))
        norm = m / scale[:, :, None] / scale[:, None, :]
        left, pivot = norm.copy(), np.full(len(n), np.inf)
        for k in range(6):  # the least pivot of an elimination tells whether the system is as good as singular
            pivot = np.minimum(pivot, left[:, k, k])
            left = left - left[:, :, k, None] * left[:, None, k, :] / np.where(left[:, k, k] > 1e-9, left[:, k, k], np.inf)[:, None, None]
        fine = (n.to_numpy() >= 6) & (pivot > 1e-9)
        x = np.full(len(n), np.nan)
        if fine.any():
            x[fine] = np.linalg.solve(norm[fine], (v / scale)[fine][..., None])[:, 0, 0] / scale[fine, 0]
        return pd.Series(np.where(fine, x, mean))

    names = [f"_m{BASIS[i][0] + BASIS[j][0]}{BASIS[i][1] + BASIS[j][1]}" for i in range(6) for j in range(i, 6)]
    n = F.rint("_n").cast("long")
    return sums.select(*keys, n.alias("n"), *(solve(n, F.array(*names), F.array(*(f"_b{k}{i}{j}" for i, j in BASIS))).alias(out) for k, out in enumerate(outs)))


def time_polynomials(samples: DataFrame, keys: list[str], t: str, values: list[str], degree: int = 3) -> DataFrame:
    """Least-squares polynomials of each value in t - t0, t0 the first time of the group: keys, param, t0, coefs.

    One pass finds t0 and the span, a second sums powers of the scaled time; the small systems are solved in
    an Arrow kernel. Groups of fewer than degree + 1 samples get nulls.
    """
    base = samples.groupBy(*keys).agg(F.min(t).alias("t0"), F.greatest(F.max(t) - F.min(t), F.lit(1e-12)).alias("span"))
    d = (samples.join(base, keys) if keys else samples.crossJoin(F.broadcast(base))).withColumn("_u", (F.col(t) - F.col("t0")) / F.col("span"))
    power = lambda k: F.lit(1.0) if k == 0 else F.pow("_u", F.lit(float(k)))
    sums = [F.sum(power(k)).alias(f"_s{k}") for k in range(2 * degree + 1)] + [F.sum(power(k) * F.col(v)).alias(f"_{i}y{k}") for i, v in enumerate(values) for k in range(degree + 1)]
    s = d.groupBy(*keys, "t0", "span").agg(*sums)

    @F.pandas_udf("array<double>")
    def solve(a: pd.Series, b: pd.Series, span: pd.Series) -> pd.Series:
        out = []
        for p, y, w in zip(a, b, span, strict=True):
            m = np.array([[p[i + j] for j in range(degree + 1)] for i in range(degree + 1)])
            ok = p[0] > degree and np.linalg.cond(m) < 1e14
            out.append(np.linalg.solve(m, np.asarray(y)) / w ** np.arange(degree + 1) if ok else None)
        return pd.Series(out)

    powers = F.array(*(f"_s{k}" for k in range(2 * degree + 1)))
    each = F.explode(F.array(*(F.struct(F.lit(v).alias("param"), F.array(*(f"_{i}y{k}" for k in range(degree + 1))).alias("y")) for i, v in enumerate(values))))
    return s.withColumn("_p", powers).withColumn("_e", each).select(*keys, "_e.param", "t0", solve("_p", "_e.y", "span").alias("coefs"))
