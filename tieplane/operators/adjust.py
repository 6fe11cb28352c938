"""Adjustment of many trajectories: normal equations as a table of blocks keyed by pairs of images.

A point is seen by a few images, so what it adds to the reduced normal equations are blocks of pairs of these. Executors sum them by pair,
scale them by the factors of the diagonal blocks and keep them; conjugate gradients then need one product with that table a step. What the driver
holds are vectors of the unknowns, never a matrix of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import held
from .triangulate import PIXEL, intersect, pose_derivatives, project, time_basis

COLUMNS = ["et", "xp", "yp", "Xs", "Ys", "Zs", "phi", "omega", "kappa", "X", "Y", "Z"]
#: Pairs of images whose blocks a task sums before it hands them on.
PAIRS = 64
_BLOCKS = "a int, b int, m binary"


def _packed(m: np.ndarray) -> bytes:
    return np.ascontiguousarray(m, float).tobytes()


def _matrix(b: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(b, float).reshape(rows, -1)


def linearised(v: np.ndarray, theta: np.ndarray, spans: np.ndarray, degree: int, frequencies: tuple, f: float, heights: tuple | None, loss: float | None) -> tuple[dict, dict, float]:
    """Blocks by pair of images, right sides by image and cost of points with a ray count in common; their places are eliminated."""
    n, m, _ = v.shape
    flat = v.reshape(n * m, -1)
    image, t, uv, k = flat[:, 0].astype(int), flat[:, 1] - spans[flat[:, 0].astype(int), 0], flat[:, 2:4], theta.shape[2]
    basis = time_basis(t / spans[image, 1], t, degree, frequencies)
    pose = flat[:, 4:10] + np.einsum("npk,nk->np", theta[image], basis)
    point = np.repeat(np.arange(n), m)
    x, _ = intersect(pose, uv, point, v[:, :, 10:13].mean(axis=1), f, rounds=15)
    at, jx = project(x[point], pose, f)
    e, jx, jp = (uv - at) / PIXEL, jx / PIXEL, pose_derivatives(x[point], pose, f) / PIXEL
    squares = (e**2).sum(axis=1)
    cost = float((loss**2 * np.log1p(squares / loss**2)).sum() if loss else squares.sum())
    if loss:  # Cauchy
        root = np.sqrt(1 / (1 + squares / loss**2))
        e, jx, jp = e * root[:, None], jx * root[:, None, None], jp * root[:, None, None]
    e, jx, jp, basis, image = e.reshape(n, 2 * m), jx.reshape(n, 2 * m, 3), jp.reshape(n, m, 2, 6), basis.reshape(n, m, k), image.reshape(n, m)
    if heights:
        rho = np.linalg.norm(x, axis=1)
        jx = np.concatenate([jx, (x / rho[:, None] / heights[1])[:, None]], axis=1)
        e = np.c_[e, (heights[0] - rho) / heights[1]]
        cost += float((e[:, -1] ** 2).sum())
    q, _ = np.linalg.qr(jx)  # what the points can't take up is left to the trajectories
    e = e - (q @ (q.transpose(0, 2, 1) @ e[..., None]))[..., 0]
    blocks: dict = {}
    sides: dict = {}
    for i in range(m):
        g = np.einsum("nra,nr->na", jp[:, i], e[:, 2 * i : 2 * i + 2])
        for a in np.unique(image[:, i]):
            s = image[:, i] == a
            sides[a] = sides.get(a, 0) + (g[s].T @ basis[s, i]).ravel()
        for j in range(m):
            left = -q[:, 2 * i : 2 * i + 2] @ q[:, 2 * j : 2 * j + 2].transpose(0, 2, 1) + (np.eye(2) if i == j else 0)
            w = np.einsum("nra,nrs,nsb->nab", jp[:, i], left, jp[:, j])
            pairs = image[:, i] * (1 << 31) + image[:, j]
            for pair in np.unique(pairs[image[:, i] <= image[:, j]]):
                s = pairs == pair
                a, b = divmod(int(pair), 1 << 31)
                block = np.empty((6, k, 6, k))
                for p in range(6):
                    for r in range(6):
                        block[p, :, r] = (basis[s, i] * w[s, p, r, None]).T @ basis[s, j]
                blocks[a, b] = blocks.get((a, b), 0) + block.reshape(6 * k, 6 * k)
    return blocks, sides, cost


def _normal(packed: DataFrame, theta: np.ndarray, spans: np.ndarray, linearise: Callable) -> tuple[DataFrame, np.ndarray, float]:
    """The summed blocks of pairs a < b and a = b, the right side and the cost at ``theta``."""
    now, size = packed.sparkSession.sparkContext.broadcast(theta), theta.shape[1] * theta.shape[2]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks, sides, cost = {}, {}, 0.0
        for pdf in batches:
            for length, part in pdf.groupby(pdf["v"].map(len)):
                m = length // (len(COLUMNS) + 1)
                if m < 2:
                    continue
                v = np.stack(part["v"].to_numpy()).reshape(len(part), m, len(COLUMNS) + 1)
                for lo in range(0, len(v), 2000):
                    more, g, c = linearise(v[lo : lo + 2000], now.value)
                    cost += c
                    for held_, new in ((blocks, more), (sides, g)):
                        for key, value in new.items():
                            held_[key] = held_.get(key, 0) + value
                if len(blocks) > PAIRS:
                    yield pd.DataFrame([(a, b, _packed(m)) for (a, b), m in blocks.items()], columns=["a", "b", "m"])
                    blocks = {}
        rows = [(a, b, _packed(m)) for (a, b), m in blocks.items()] + [(int(a), -1, _packed(g)) for a, g in sides.items()] + [(-1, -1, _packed(np.array([cost])))]
        yield pd.DataFrame(rows, columns=["a", "b", "m"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(pdf["m"].iloc[0], float).copy()
        for b in pdf["m"].iloc[1:]:
            total += np.frombuffer(b, float)
        return pd.DataFrame({"a": pdf["a"][:1], "b": pdf["b"][:1], "m": [_packed(total)]})

    sums = held(packed.mapInPandas(run, _BLOCKS).groupBy("a", "b").applyInPandas(add, _BLOCKS), "normal")
    g, cost = np.zeros((len(theta), size)), 0.0
    for r in sums.filter("b < 0").collect():  # vectors of the unknowns
        if r.a < 0:
            cost = float(np.frombuffer(r.m, float)[0])
        else:
            g[r.a] = np.frombuffer(r.m, float)
    return sums.filter("b >= 0"), g, cost


def _solved(blocks: DataFrame, g: np.ndarray, prior: np.ndarray, damping: float, free: np.ndarray, tol: float, most: int) -> np.ndarray:
    """The step of the damped system by conjugate gradients, preconditioned with the factors of the diagonal blocks."""
    spark, size = blocks.sparkSession, g.shape[1]
    sc = spark.sparkContext
    priors, frees = sc.broadcast(prior), sc.broadcast(free)

    def factors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for a, b in zip(pdf["a"], pdf["m"], strict=True):
                d = _matrix(b, size)
                d = d + np.diag(priors.value + damping * np.diag(d) + 1e-12)
                scale = np.sqrt(np.diag(d))
                out.append((a, _packed(np.linalg.inv(np.linalg.cholesky(d / scale[:, None] / scale + 1e-13 * np.eye(size))) / scale)))
            yield pd.DataFrame(out, columns=["a", "l"])

    inverse = held(blocks.filter("a = b").mapInPandas(factors, "a int, l binary"), "factors")
    left, right = inverse.withColumnRenamed("l", "la"), inverse.select(F.col("a").alias("b"), F.col("l").alias("lb"))

    def scaled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = [bool(frees.value[a] and frees.value[b]) for a, b in zip(pdf["a"], pdf["b"], strict=True)]
            pdf = pdf[keep]
            yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "m": [_packed(_matrix(x, size) @ _matrix(m, size) @ _matrix(y, size).T) for x, m, y in zip(pdf["la"], pdf["m"], pdf["lb"], strict=True)]})

    off = held(blocks.filter("a < b").join(left, "a").join(right, "b").select("a", "b", "m", "la", "lb").mapInPandas(scaled, _BLOCKS), "scaled")

    def through(table: DataFrame, matrix: str, vector: np.ndarray, turned: bool) -> np.ndarray:
        """L vector or L' vector, block by block."""
        sent = sc.broadcast(vector)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame([(a, _packed((_matrix(b, size).T if turned else _matrix(b, size)) @ sent.value[a])) for a, b in zip(pdf["a"], pdf[matrix], strict=True)], columns=["a", "v"])

        out = np.zeros_like(vector)
        for r in table.mapInPandas(run, "a int, v binary").collect():
            out[r.a] = np.frombuffer(r.v, float)
        return out

    def product(p: np.ndarray) -> np.ndarray:
        sent = sc.broadcast(p)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict = {}
            for pdf in batches:
                for a, b, x in zip(pdf["a"], pdf["b"], pdf["m"], strict=True):
                    m = _matrix(x, size)
                    sums[a] = sums.get(a, 0) + m @ sent.value[b]
                    sums[b] = sums.get(b, 0) + m.T @ sent.value[a]
            yield pd.DataFrame([(a, _packed(s)) for a, s in sums.items()], columns=["a", "v"])

        out = p.copy()  # scaled diagonal blocks are units
        for r in off.mapInPandas(run, "a int, v binary").collect():
            out[r.a] += np.frombuffer(r.v, float)
        return out * free[:, None]

    r = through(inverse, "l", g * free[:, None], False) * free[:, None]
    y, p, now = np.zeros_like(r), r.copy(), float((r * r).sum())
    goal = tol * tol * now
    for _ in range(most):
        if now <= goal:
            break
        q = product(p)
        step = now / float((p * q).sum())
        y, r = y + step * p, r - step * q
        now, before = float((r * r).sum()), now
        p = r + now / before * p
    return through(inverse, "l", y, True) * free[:, None]


def sparse_adjustment(rays: DataFrame, poses: dict, f: float = 11995.48, degree: int = 1, rounds: int = 8, weights: tuple[float, float] = (20.0, 0.006), heights: tuple[float, float] | None = None, frequencies: tuple[float, ...] = (), fixed: tuple = (), loss: float | None = None, tol: float = 1e-8, most: int = 200) -> tuple[dict, list[float]]:
    """Corrections of trajectories as ``triangulate.block_adjustment`` has them, for any number of images.

    ``rays``: point_id, image, et, xp, yp, pose, start X, Y, Z; rays with a null and points with one ray are left out. ``poses``: image ->
    (t0, span). Each round the executors eliminate their points and sum blocks by pair of images; conjugate gradients, up to ``most``
    steps, solve the damped system. A round that would raise the cost is taken back and damped more (Levenberg). ``loss`` (pixels) gives
    rays Cauchy weights, so that outliers count little. Returns per image an array of parameter by term, and the costs of the rounds kept.
    """
    images, k = sorted(poses), degree + 1 + 2 * len(frequencies)
    spans, spark = np.array([poses[im] for im in images], float), rays.sparkSession
    number = spark.createDataFrame([(im, float(i)) for i, im in enumerate(images)], ["image", "_i"])
    fine = rays.dropna(subset=["point_id", "image", *COLUMNS]).join(F.broadcast(number), "image")  # as many rows as images
    packed = held(fine.groupBy("point_id").agg(F.flatten(F.sort_array(F.collect_list(F.array("_i", *(F.col(c).cast("double") for c in COLUMNS))))).alias("v")).select("v"), "points")
    prior = np.r_[np.full(3 * k, weights[0] ** -2), np.full(3 * k, weights[1] ** -2)]
    free, theta = np.array([im not in fixed for im in images]), np.zeros((len(images), 6, k))
    damping, costs, kept = 1e-6, [], None
    for _ in range(rounds):
        blocks, g, cost = _normal(packed, theta, spans, lambda v, at: linearised(v, at, spans, degree, frequencies, f, heights, loss))
        cost += float((prior * theta.reshape(len(images), -1) ** 2).sum())
        if kept is not None and cost > costs[-1] * (1 + 1e-9):
            theta, blocks, g, damping = *kept, damping * 30
        else:
            costs.append(cost)
            damping = max(damping / 5, 1e-9)
        kept = theta, blocks, g
        side = g - prior * theta.reshape(len(images), -1)
        step = _solved(blocks, side, prior, damping, free, tol, most)
        theta = theta + step.reshape(theta.shape)
        if np.abs(step * np.sqrt(prior)).max() < 1e-9 or (len(costs) > 1 and costs[-2] - costs[-1] < 1e-10 * costs[-2]):
            break
    return {im: theta[i] for i, im in enumerate(images)}, costs


def corrected(rays: DataFrame, theta: dict, poses: dict, degree: int, frequencies: tuple[float, ...] = ()) -> DataFrame:
    """Rays with the corrections of ``sparse_adjustment`` added to their poses; rays of images that have none stay."""
    names = COLUMNS[3:9]
    rows = [(im, float(poses[im][0]), float(poses[im][1]), [float(x) for x in theta[im].ravel()]) for im in theta]
    sent = rays.sparkSession.createDataFrame(rows, "image int, _t0 double, _span double, _c array<double>")
    d = rays.join(F.broadcast(sent), "image", "left")  # as many rows as images
    t = F.col("et") - F.col("_t0")
    basis = [F.pow(t / F.col("_span"), F.lit(float(q))) for q in range(degree + 1)] + [w(2 * np.pi * x * t) for x in frequencies for w in (F.cos, F.sin)]
    k = len(basis)
    moved = {n: F.when(F.col("_c").isNull(), F.col(n)).otherwise(F.col(n) + sum((F.col("_c")[q * k + i] * b for i, b in enumerate(basis)), F.lit(0.0))) for q, n in enumerate(names)}
    return d.withColumns(moved).select(*rays.columns)
