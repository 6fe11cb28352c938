"""Detectors on images of any size: images are cut into blocks that carry a rim of their neighbours, so seams lose nothing.

An image is a table of lines (image, row, samples). A line goes to the blocks it lies in or is a rim of, cut to their columns; a task
takes a few blocks at a time. What is found depends on the image alone, not on how it was cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.shared import held

#: Side of a block in samples, and of the first scale's deviation.
BLOCK, FIRST = 512, 1.6
#: Scales to a doubling.
SCALES = 3
#: Samples, with rims, of the blocks that a task works on at once.
SAMPLES = 1 << 19


def blocks(lines: DataFrame, size: int, rim: int) -> DataFrame:
    """(image, br, bc, row, c0, part): of each line what lies in a block or its rim; c0 is the part's first column. Lines without
    samples are left out."""
    rows = F.sequence(F.floor((F.col("row") - rim) / size), F.floor((F.col("row") + rim) / size))
    cols = F.sequence(F.lit(0), F.floor((F.size("samples") - 1) / size).cast("int"))
    d = lines.filter("size(samples) > 0").select("image", "row", "samples", F.explode(F.filter(rows, lambda b: b >= 0)).alias("br"), cols.alias("_c")).withColumn("bc", F.explode("_c"))
    d = d.withColumn("c0", F.greatest(F.lit(0), F.col("bc") * size - rim).cast("int"))
    part = F.slice("samples", F.col("c0") + 1, F.least(F.size("samples"), (F.col("bc") + 1) * size + rim) - F.col("c0"))
    return d.select("image", F.col("br").cast("long").alias("br"), F.col("bc").cast("long").alias("bc"), "row", "c0", part.cast("array<double>").alias("part"))


def _in_blocks(lines: DataFrame, size: int, rim: int, found: Callable[[np.ndarray], pd.DataFrame], columns: str) -> DataFrame:
    """Runs ``found`` (of blocks with their rims, stacked; not-a-number where an image ends) and keeps what lies in a block itself.

    A task takes its blocks in order and ``SAMPLES`` of them at a time, so small images cost no call each and large ones no memory.
    """
    kind = lines.schema["image"].dataType.simpleString()
    side = size + 2 * rim
    many = max(1, SAMPLES // side**2)

    def solved(batch: pa.RecordBatch) -> pa.RecordBatch:
        block, inner = np.cumsum(batch.column("_first").to_numpy()) - 1, batch.column("row").to_numpy() // size == batch.column("br").to_numpy()
        batch = batch.filter(pa.array((np.bincount(block, inner) > 0)[block]))  # a block of rims alone has no places of its own
        br, bc, first = (batch.column(c).to_numpy() for c in ("br", "bc", "_first"))
        block, parts = np.cumsum(first) - 1, batch.column("part")
        a, n = np.full((int(first.sum()), side, side), np.nan), parts.value_lengths().to_numpy(zero_copy_only=False)
        line = np.repeat(np.arange(len(n)), n)
        row = batch.column("row").to_numpy() - br * size + rim
        col = batch.column("c0").to_numpy() - bc * size + rim
        a[block[line], row[line], np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n) + col[line]] = parts.flatten().to_numpy(zero_copy_only=False)
        out = found(a)
        own = out[(out["row"] >= rim) & (out["row"] < rim + size) & (out["col"] >= rim) & (out["col"] < rim + size)]
        head = np.flatnonzero(first)[own["block"].to_numpy()]
        whole = own.drop(columns="block").assign(row=own["row"].to_numpy() + br[head] * size - rim, col=own["col"].to_numpy() + bc[head] * size - rim)
        made = {"image": batch.column("image").take(pa.array(head)), **{c: pa.array(whole[c].to_numpy()) for c in whole}}
        return pa.RecordBatch.from_pydict({c: made[c] for c in ("image", *(x.split()[0] for x in f"row long, col long, {columns}".split(", ")))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, count = [], 0
        for batch in batches:
            first = np.flatnonzero(batch.column("_first").to_numpy(zero_copy_only=False))
            lo = 0
            for at in first:
                if count == many:
                    kept.append(batch.slice(lo, at - lo))
                    yield solved(pa.concat_batches([b for b in kept if b.num_rows]))
                    kept, count, lo = [], 0, at
                count += 1
            kept.append(batch.slice(lo))
        if count:
            yield solved(pa.concat_batches([b for b in kept if b.num_rows]))

    block = ["image", "br", "bc"]
    dealt = blocks(lines, size, rim).repartition(*block)
    before = lambda c: F.lag(c).over(W.partitionBy(*block).orderBy("row"))  # noqa: E731  the first line of a block has none
    named = dealt.select("*", before("br").isNull().cast("int").alias("_first"))
    return named.mapInArrow(run, f"image {kind}, row long, col long, {columns}")


def blur(a: np.ndarray, sigma: float, radius: int) -> np.ndarray:
    """Gaussian means over the samples that are there, in a square of ``radius``; not-a-number where the image ends."""
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    there = ~np.isnan(a)

    def along(x: np.ndarray) -> np.ndarray:
        for axis in (-2, -1):
            padded = np.pad(x, [(radius, radius) if k == axis else (0, 0) for k in range(-x.ndim, 0)])
            n = x.shape[axis]
            x = sum(w[k] * (padded[..., k : k + n, :] if axis == -2 else padded[..., k : k + n]) for k in range(2 * radius + 1))
        return x

    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(there, along(np.where(there, a, 0.0)) / along(there.astype(float)), np.nan)


def scale_radius(level: int, first: float = FIRST) -> int:
    """Samples on each side that a scale's mean takes."""
    return int(np.ceil(3.0 * first * 2.0 ** (level / SCALES)))


def extrema(a: np.ndarray, least: float, first: float, levels: int) -> pd.DataFrame:
    """Places in blocks (n, rows, columns) whose difference of Gaussians is above, or below, that of all 26 places around it in place and scale."""
    means = [blur(a, first * 2.0 ** (k / SCALES), scale_radius(k, first)) for k in range(levels + 3)]
    d = [y - x for x, y in zip(means, means[1:], strict=False)]
    padded, out = [np.pad(x, ((0, 0), (1, 1), (1, 1)), constant_values=np.nan) for x in d], []
    for k in range(1, levels + 1):
        b, r, c = np.nonzero(np.abs(d[k]) >= least)
        v = d[k][b, r, c]
        above, below = np.ones(len(v), bool), np.ones(len(v), bool)
        for s, i, j in ((s, i, j) for s in (-1, 0, 1) for i in (-1, 0, 1) for j in (-1, 0, 1) if (s, i, j) != (0, 0, 0)):
            other = padded[k + s][b, 1 + i + r, 1 + j + c]
            above, below = above & (v > other), below & (v < other)
            left = above | below
            b, r, c, v, above, below = b[left], r[left], c[left], v[left], above[left], below[left]
        out.append(pd.DataFrame({"block": b, "row": r, "col": c, "level": np.full(len(v), k, np.int32), "value": v}))
    return pd.concat(out)


def scale_extrema(lines: DataFrame, least: float = 1.0, first: float = FIRST, levels: int = SCALES, size: int = BLOCK) -> DataFrame:
    """Blobs: image, row, col, level, value of the extrema of differences of Gaussians over ``levels`` scales. A place at the image's edge
    has not all its neighbours and is none; samples that are null are as if the image ended there."""
    return _in_blocks(lines, size, scale_radius(levels + 2, first) + 1, lambda a: extrema(a, least, first, levels), "level int, value double")


def interest(a: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Weight and roundness of the error ellipse of a window's gradients (across the diagonals); not-a-number where the image ends."""
    u, v = a[:, 1:, 1:] - a[:, :-1, :-1], a[:, :-1, 1:] - a[:, 1:, :-1]
    grow = lambda x: np.pad(x, ((0, 0), (0, 1), (0, 1)), constant_values=np.nan)  # noqa: E731  kept at the upper left sample
    sums = []
    for p in (grow(u * u), grow(u * v), grow(v * v)):
        padded = np.pad(p, ((0, 0), (half, half), (half, half)), constant_values=np.nan)
        sums.append(sum(padded[:, i : i + a.shape[1], j : j + a.shape[2]] for i in range(2 * half + 1) for j in range(2 * half + 1)))
    trace, det = sums[0] + sums[2], sums[0] * sums[2] - sums[1] * sums[1]
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(trace > 0, det / trace, np.where(np.isnan(trace), np.nan, 0.0)), np.where(trace > 0, 4 * det / trace**2, np.where(np.isnan(trace), np.nan, 0.0))


def interest_points(lines: DataFrame, half: int = 2, round_: float = 0.75, share: float = 1.0, size: int = BLOCK) -> DataFrame:
    """Points of interest: image, row, col, weight of the places whose roundness is at least ``round_`` and whose weight is at least
    ``share`` of the image's mean weight and the greatest within ``half`` (of equal ones the first by row and column)."""
    rim = 2 * half + 1

    def summed(a: np.ndarray) -> pd.DataFrame:
        """The peaks, and on a block's first sample the sum of weights of its own places."""
        w, q = interest(a, half)
        there = ~np.isnan(w)
        padded = np.pad(np.where(there, w, -np.inf), ((0, 0), (half, half), (half, half)), constant_values=-np.inf)
        best = there & (q >= round_)
        for i in range(-half, half + 1):
            for j in range(-half, half + 1):
                if (i, j) != (0, 0):
                    other = padded[:, half + i : half + i + a.shape[1], half + j : half + j + a.shape[2]]
                    with np.errstate(invalid="ignore"):
                        best &= (w > other) if (i, j) < (0, 0) else (w >= other)
        b, r, c = np.nonzero(best)
        own = slice(rim, rim + size)
        count = there[:, own, own].sum(axis=(1, 2))
        total = np.where(there, w, 0.0)[:, own, own].sum(axis=(1, 2))
        peaks = pd.DataFrame({"block": b, "row": r, "col": c, "weight": w[b, r, c], "n": np.full(len(b), -1)})
        return pd.concat([peaks, pd.DataFrame({"block": np.arange(len(a)), "row": rim, "col": rim, "weight": total, "n": count})])

    rows = held(_in_blocks(lines, size, rim, summed, "weight double, n long"), "peaks")
    means = rows.filter("n >= 0").groupBy(F.col("image").alias("_i")).agg((F.sum("weight") / F.nullif(F.sum("n"), F.lit(0))).alias("_mean"))
    return rows.filter("n < 0").join(means, F.col("image").eqNullSafe(F.col("_i"))).filter(F.col("weight") >= share * F.col("_mean")).select("image", "row", "col", "weight")
