"""Least squares on rays: points from two rays each, and the adjustment of trajectories with points eliminated."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import held

#: Side of a detector pixel in the units of the focal length.
PIXEL = 0.012
#: Pixels by which an adjustment's last step moves its observations at most (root mean square, an unknown at a time).
STILL = 1e-6


def rotation(phi, omega, kappa) -> np.ndarray:
    """Row-major matrices, (n, 3, 3); phi counts the other way round."""
    p, w, k = -np.asarray(phi), np.asarray(omega), np.asarray(kappa)
    sp, cp, sw, cw, sk, ck = np.sin(p), np.cos(p), np.sin(w), np.cos(w), np.sin(k), np.cos(k)
    rows = [cp * ck - sp * sw * sk, -cp * sk - sp * sw * ck, -sp * cw, cw * sk, cw * ck, -sw, sp * ck + cp * sw * sk, -sp * sk + cp * sw * ck, cp * cw]
    return np.stack(rows, axis=-1).reshape(*np.shape(p), 3, 3)


def project(x: np.ndarray, pose: np.ndarray, f: float, r: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Focal-plane places of points (n, 3) seen from poses (n, 6), and their 2x3 derivatives by the point. ``r``: the poses' matrices."""
    r = rotation(pose[:, 3], pose[:, 4], pose[:, 5]) if r is None else r
    v = np.einsum("nij,ni->nj", r, x - pose[:, :3])
    uv = f * v[:, :2] / v[:, 2:]
    j = f * (r[:, :, :2] / v[:, None, 2:] - v[:, None, :2] * r[:, :, 2:] / v[:, 2:, None] ** 2)
    return uv, j.transpose(0, 2, 1)


def pose_derivatives(x: np.ndarray, pose: np.ndarray, f: float) -> np.ndarray:
    """2x6 derivatives of places on the focal plane by place and angles of the camera."""
    r = rotation(pose[:, 3], pose[:, 4], pose[:, 5])
    d = x - pose[:, :3]
    v = np.einsum("nij,ni->nj", r, d)
    sp, cp, sw, cw = np.sin(-pose[:, 3]), np.cos(-pose[:, 3]), np.sin(pose[:, 4]), np.cos(pose[:, 4])
    sk, ck, zero = np.sin(pose[:, 5]), np.cos(pose[:, 5]), np.zeros(len(x))
    by_phi = np.stack([r[:, 2], np.zeros_like(r[:, 1]), -r[:, 0]], axis=1)  # phi counts the other way round
    by_omega = np.stack([-sp[:, None] * r[:, 1], np.stack([-sw * sk, -sw * ck, -cw], axis=1), cp[:, None] * r[:, 1]], axis=1)
    by_kappa = np.stack([r[:, :, 1], -r[:, :, 0], np.stack([zero] * 3, axis=1)], axis=2)
    dv = np.concatenate([-r.transpose(0, 2, 1), *(np.einsum("nij,ni->nj", m, d)[:, :, None] for m in (by_phi, by_omega, by_kappa))], axis=2)
    return f * (dv[:, :2] / v[:, 2, None, None] - v[:, :2, None] * dv[:, 2:] / v[:, 2, None, None] ** 2)


def intersect(pose: np.ndarray, uv: np.ndarray, point: np.ndarray, start: np.ndarray, f: float, rounds: int = 30, loss: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """All points at once: Gauss-Newton with Cauchy weights on the rays of each (``point`` numbers them).

    Returns the points and each ray's residual in pixels.
    """
    x, n, r = start.astype(float).copy(), len(start), rotation(pose[:, 3], pose[:, 4], pose[:, 5])
    even = n > 0 and len(point) % n == 0 and np.array_equal(point, np.repeat(np.arange(n), len(point) // n))
    for _ in range(rounds):
        at, j = project(x[point], pose, f, r)
        e = (uv - at) / PIXEL
        w = 1 / (1 + (e**2).sum(axis=1) / loss**2)
        j = j / PIXEL
        turned = (j * w[:, None, None]).transpose(0, 2, 1)
        ab = np.concatenate([turned @ j, turned @ e[..., None]], axis=2)
        if even:  # as many rays a point, in order
            ab = ab.reshape(n, -1, 3, 4).sum(axis=1)
        else:
            each, ab = ab, np.zeros((n, 3, 4))
            np.add.at(ab, point, each)
        a, b = ab[:, :, :3], ab[:, :, 3]
        scale = np.sqrt(np.maximum(np.einsum("nii->ni", a), 1e-300))
        step = np.linalg.solve(a / scale[:, :, None] / scale[:, None, :] + 1e-12 * np.eye(3), (b / scale)[..., None])[..., 0] / scale
        x += step
        if np.abs(step).max(initial=0) < 1e-6:
            break
    return x, np.linalg.norm((uv - project(x[point], pose, f)[0]) / PIXEL, axis=1)


def forward_intersection(rays: DataFrame, f: float = 11995.48, rays_per_point: int = 2) -> DataFrame:
    """Points from their first rays: point_id, X, Y, Z, res0, res1 (pixels).

    ``rays`` has point_id, ord, xp, yp, the pose Xs, Ys, Zs, phi, omega, kappa and the starting X, Y, Z. Points
    are independent: rays are gathered per point, then every Arrow batch is solved at once. Points with fewer
    rays are left out.
    """
    cols = ["xp", "yp", "Xs", "Ys", "Zs", "phi", "omega", "kappa", "X", "Y", "Z"]
    kind = rays.schema["point_id"].dataType.simpleString()
    packed = rays.groupBy("point_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("ord", *cols))), 1, rays_per_point).alias("r")).filter(F.size("r") == rays_per_point)
    flat = packed.select("point_id", F.flatten(F.transform("r", lambda s: F.array(*(s[c].cast("double") for c in cols)))).alias("v"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            v = np.stack(pdf["v"].to_numpy()).reshape(len(pdf), rays_per_point, len(cols))
            m, point = v.reshape(-1, len(cols)), np.repeat(np.arange(len(pdf)), rays_per_point)
            x, res = intersect(m[:, 2:8], m[:, :2], point, v[:, :, 8:].mean(axis=1), f)
            res = res.reshape(len(pdf), -1)
            yield pd.DataFrame({"point_id": pdf["point_id"], "X": x[:, 0], "Y": x[:, 1], "Z": x[:, 2], "res0": res[:, 0], "res1": res[:, min(1, rays_per_point - 1)]})

    return flat.mapInPandas(run, f"point_id {kind}, X double, Y double, Z double, res0 double, res1 double")


def time_basis(u: np.ndarray, t: np.ndarray, degree: int, frequencies: tuple[float, ...]) -> np.ndarray:
    """Powers of the scaled time u, then cosine and sine of each frequency (per unit of t): what a correction is made of."""
    waves = [f(2 * np.pi * w * t) for w in frequencies for f in (np.cos, np.sin)]
    return np.concatenate([u[:, None] ** np.arange(degree + 1), *(x[:, None] for x in waves)], axis=1)


def interior_basis(uv: np.ndarray) -> np.ndarray:
    """What a unit of each interior unknown adds to a place on the focal plane, (n, 2, 5): shifts, scales and a radial term, the last
    two relative to ten units off the centre."""
    u, v = uv.T
    zero, one, r2 = np.zeros(len(u)), np.ones(len(u)), (u * u + v * v) / 100.0
    return np.stack([np.stack([one, zero, u / 10, zero, u / 10 * r2], axis=1), np.stack([zero, one, zero, v / 10, v / 10 * r2], axis=1)], axis=1)


def block_adjustment(rays: DataFrame, poses: dict, f: float = 11995.48, degree: int = 1, rounds: int = 8, weights: tuple[float, float] = (20.0, 0.006), heights: tuple[float, float] | None = None, frequencies: tuple[float, ...] = (), fixed: tuple = (), interior: float | None = None) -> tuple[dict, list[float]]:
    """Corrections of trajectories: per image and pose parameter a polynomial of time and, for jitter, waves of the given
    ``frequencies``; all points are eliminated.

    ``rays``: point_id, image, et, xp, yp, pose, start X, Y, Z. ``poses``: image -> (t0, span). Unknowns are the
    6 * (degree + 1 + 2 * len(frequencies)) coefficients of each image but the ``fixed`` ones. Executors linearise and
    eliminate their points (the Schur complement), partial reduced systems are summed; the driver holds and solves only
    that system, whose size is that of the unknowns. Corrections are drawn to zero by the inverse squares of ``weights``
    (metres, radians); ``heights`` (radius, deviation) draws points to a sphere, as the jitter form has it. Without a fixed
    image and heights, a common shift, turn and scale of all stays free but for those weights.
    ``interior`` (a deviation in units of the focal length's) adds the camera's own unknowns, common to all images: shift and
    scale of each coordinate of the focal plane and a radial term; then the key "interior" holds those five.
    Rays with a number that is null, infinite or none are no observations.
    Returns the coefficients, per image an array of parameter by term, and the cost of each round.
    """
    spark = rays.sparkSession
    images, k = sorted(poses), degree + 1 + 2 * len(frequencies)
    outer = len(images) * 6 * k
    size = outer + 5 * (interior is not None)
    cols = ["xp", "yp", "et", "Xs", "Ys", "Zs", "phi", "omega", "kappa", "X", "Y", "Z"]
    number = F.create_map(*(x for i, im in enumerate(images) for x in (F.lit(im), F.lit(float(i)))))
    seen = rays.filter(" AND ".join(f"abs({c}) < 1e300" for c in cols))
    packed = seen.groupBy("point_id").agg(F.flatten(F.sort_array(F.collect_list(F.array(number[F.col("image")], *(F.col(c).cast("double") for c in cols))))).alias("v")).select("v")
    packed = held(packed)
    prior = np.tile(np.r_[np.full(3 * k, weights[0] ** -2), np.full(3 * k, weights[1] ** -2)], len(images))
    fixed_ = np.repeat([im in fixed for im in images], 6 * k)
    if interior is not None:
        prior, fixed_ = np.r_[prior, np.full(5, interior**-2)], np.r_[fixed_, np.zeros(5, bool)]
    theta, costs = np.zeros(size), []
    span = np.array([poses[im] for im in images], float)

    free = np.flatnonzero(~fixed_)
    place = np.where([im in fixed for im in images], -1, np.cumsum([0, *(6 * k * (im not in fixed) for im in images[:-1])]))  # an image's first free unknown

    def linearise(v: np.ndarray, c: np.ndarray):
        """Reduced normal matrix, right side and cost of one batch of points with a ray count in common, for the free unknowns."""
        n, m, _ = v.shape
        image = v[:, :, 0].astype(int)
        flat, at_image = v.reshape(-1, v.shape[2]), image.reshape(-1)
        t = flat[:, 3] - span[at_image, 0]
        basis = time_basis(t / span[at_image, 1], t, degree, frequencies)
        coef, uv = c[:outer].reshape(len(images), 6, k), flat[:, 1:3]
        if interior is not None:
            lens = interior_basis(uv)
            uv = uv + lens @ c[outer:]
        pose = flat[:, 4:10] + (coef[at_image] @ basis[..., None])[..., 0]
        point = np.repeat(np.arange(n), m)
        x, _ = intersect(pose, uv, point, v[:, :, 10:13].mean(axis=1), f, rounds=15)
        at, jx = project(x[point], pose, f)
        e = ((uv - at) / PIXEL).reshape(n, 2 * m)
        by_pose = (pose_derivatives(x[point], pose, f)[..., None] * (basis / PIXEL)[:, None, None, :]).reshape(n, m, 2, 6 * k)
        jx = (jx / PIXEL).reshape(n, 2 * m, 3)
        a = np.zeros((n, 2 * m + bool(heights), len(free)))
        for r in range(m):
            for im in np.unique(image[:, r]):
                if place[im] >= 0:
                    at_row = image[:, r] == im
                    a[at_row, 2 * r : 2 * r + 2, place[im] : place[im] + 6 * k] = by_pose[at_row, r]
        if interior is not None:
            a[:, : 2 * m, -5:] = -(lens / PIXEL).reshape(n, 2 * m, 5)
        if heights:
            rho = np.linalg.norm(x, axis=1)
            jx = np.concatenate([jx, (x / rho[:, None] / heights[1])[:, None]], axis=1)
            e = np.c_[e, (heights[0] - rho) / heights[1]]
        q_, _ = np.linalg.qr(jx)  # what the points can't take up
        a = a - q_ @ (q_.transpose(0, 2, 1) @ a)
        e = e - (q_ @ (q_.transpose(0, 2, 1) @ e[..., None]))[..., 0]
        a, e = a.reshape(-1, len(free)), e.reshape(-1)
        return a.T @ a, a.T @ e, float(e @ e), len(e)

    width = len(cols) + 1
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(theta)

        def reduce(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(free) ** 2 + len(free) + 2)
            for batch in batches:
                lists = batch.column(0)
                lengths, values = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy()
                starts = np.cumsum(lengths) - lengths
                for length in np.unique(lengths):
                    if length < 2 * width:
                        continue
                    begin = starts[lengths == length]
                    for lo in range(0, len(begin), 2000):
                        v = values[begin[lo : lo + 2000, None] + np.arange(length)].reshape(-1, length // width, width)
                        h, g, cost, n = linearise(v, now.value)
                        total += np.r_[h.ravel(), g, cost, n]
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(len(total)), pa.int32()), "s": pa.array(total)})

        sums = packed.mapInArrow(reduce, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).toPandas().sort_values("i")["s"].to_numpy()
        if not len(free) or not len(sums):
            break
        h, g = sums[: len(free) ** 2].reshape(len(free), -1), sums[len(free) ** 2 : -2]
        costs.append(float(sums[-2]))
        a = h + np.diag(prior[free])
        g = g - (prior * theta)[free]
        scale = np.sqrt(np.diag(a))
        step = np.linalg.solve(a / scale[:, None] / scale, g / scale) / scale
        theta[free] += step
        # an unknown's step alone moves the observations by less than this, root mean square, in pixels
        if np.abs(step * scale).max() < STILL * np.sqrt(max(1.0, sums[-1])):
            break
    found = {im: theta[:outer].reshape(len(images), 6, k)[i] for i, im in enumerate(images)}
    return found | ({"interior": theta[outer:]} if interior is not None else {}), costs


def residual_report(points: DataFrame) -> DataFrame:
    """Of points with res0 and res1 (pixels): how many, the mean and root mean square of each ray's residuals, and the share over one."""
    both = points.select(F.posexplode(F.array("res0", "res1")).alias("ray", "res"))
    return both.groupBy("ray").agg(F.count(F.lit(1)).alias("n"), F.avg("res").alias("mean"), F.sqrt(F.avg(F.col("res") * F.col("res"))).alias("rms"), F.avg((F.col("res") > 1).cast("double")).alias("over_one"))
