"""Patch similarity on arrays of samples: column expressions, and numpy kernels for what needs resampling."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-12


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def moments(a: Column) -> tuple[Column, Column]:
    """Sum and sum of squares: what one side of a comparison contributes, computed once per patch."""
    return total(F.transform(a, lambda x: x.cast("double"))), dot(a, a)


def zncc_from_moments(n: Column, sa: Column, qa: Column, sb: Column, qb: Column, ab: Column, floor: float = FLOOR) -> Column:
    va, vb = qa - sa * sa / n, qb - sb * sb / n
    return (ab - sa * sb / n) / F.sqrt(F.greatest(va, F.lit(floor)) * F.greatest(vb, F.lit(floor)))


def zncc(a: Column, b: Column) -> Column:
    """Zero-mean normalised cross-correlation of two patches of a size."""
    (sa, qa), (sb, qb) = moments(a), moments(b)
    return zncc_from_moments(F.size(a).cast("double"), sa, qa, sb, qb, dot(a, b))


def centre_weights(side: int) -> list[float]:
    """1 / (1 + d^2 / s^2) about the centre, s^2 = max(4, 0.16 h^2), h the half side."""
    h = (side - 1) / 2
    s2 = max(4.0, 0.16 * h * h)
    return [1.0 / (1.0 + ((r - h) ** 2 + (c - h) ** 2) / s2) for r in range(side) for c in range(side)]


def weighted_zncc(a: Column, b: Column, weights: list[float]) -> Column:
    w = F.array(*map(F.lit, weights))
    sw = F.lit(float(sum(weights)))
    wa, wb = F.zip_with(w, a, lambda x, y: x * y.cast("double")), F.zip_with(w, b, lambda x, y: x * y.cast("double"))
    sa, sb = total(wa), total(wb)
    va, vb, ab = dot(wa, a) - sa * sa / sw, dot(wb, b) - sb * sb / sw, dot(wa, b) - sa * sb / sw
    return ab / F.sqrt(F.greatest(va, F.lit(FLOOR)) * F.greatest(vb, F.lit(FLOOR)))


def census(a: Column, side: int) -> Column:
    """A bit per sample but the centre: 1 where it is darker than the centre, packed into a long (side <= 8)."""
    centre = (side // 2) * side + side // 2
    bits = F.transform(a, lambda x, i: F.when((i != centre) & (x < F.element_at(a, centre + 1)), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def census_similarity(a: Column, b: Column, bits: int) -> Column:
    """1 for equal signatures, -1 for opposite ones."""
    return 1.0 - 2.0 * F.bit_count(a.bitwiseXOR(b)) / float(bits)


def gradient_patch(a: Column, side: int) -> Column:
    """Absolute forward differences along rows and columns, added; the last row and column have one only."""
    at = lambda i: F.element_at(a, i + 1).cast("double")
    cells = []
    for r in range(side):
        for c in range(side):
            i = r * side + c
            parts = ([F.abs(at(i + 1) - at(i))] if c + 1 < side else []) + ([F.abs(at(i + side) - at(i))] if r + 1 < side else [])
            cells.append(sum(parts[1:], parts[0]) if parts else F.lit(0.0))
    return F.array(*cells)


def score_blend(gray: Column, gradient: Column, weighted: Column | None = None) -> Column:
    """0.90 gray + 0.10 gradient, or with a centre-weighted score 0.82, 0.13 and 0.05."""
    return 0.90 * gray + 0.10 * gradient if weighted is None else 0.82 * gray + 0.13 * weighted + 0.05 * gradient


def score_census(signature: Column, gray: Column) -> Column:
    return 0.8 * signature + 0.2 * gray


def sobel(image: np.ndarray) -> np.ndarray:
    """|Sx| + |Sy| with mirrored borders."""
    p = np.pad(image.astype(np.float64), 1, mode="reflect")
    sm = lambda a, axis: a.take(range(a.shape[axis] - 2), axis) + 2 * a.take(range(1, a.shape[axis] - 1), axis) + a.take(range(2, a.shape[axis]), axis)
    df = lambda a, axis: a.take(range(2, a.shape[axis]), axis) - a.take(range(a.shape[axis] - 2), axis)
    return np.abs(sm(df(p, 1), 0)) + np.abs(sm(df(p, 0), 1))


def bilinear(image: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Samples at fractional places; NaN outside the image."""
    h, w = image.shape
    inside = (rows >= 0) & (cols >= 0) & (rows <= h - 1) & (cols <= w - 1)
    r, c = np.clip(np.floor(rows).astype(int), 0, max(0, h - 2)), np.clip(np.floor(cols).astype(int), 0, max(0, w - 2))
    fr, fc = rows - r, cols - c
    r1, c1 = np.minimum(r + 1, h - 1), np.minimum(c + 1, w - 1)
    out = image[r, c] * (1 - fr) * (1 - fc) + image[r, c1] * (1 - fr) * fc + image[r1, c] * fr * (1 - fc) + image[r1, c1] * fr * fc
    return np.where(inside, out, np.nan)


def correlation(a: np.ndarray, b: np.ndarray, weights: np.ndarray | None = None) -> float:
    """Correlation of two sample arrays; NaN if any sample is missing."""
    w = np.ones(a.size) if weights is None else np.ravel(weights)
    x, y = np.ravel(a) - np.average(np.ravel(a), weights=w), np.ravel(b) - np.average(np.ravel(b), weights=w)
    return float((w * x * y).sum() / np.sqrt(max((w * x * x).sum(), FLOOR) * max((w * y * y).sum(), FLOOR)))


def affine_correlation(left: np.ndarray, right: np.ndarray, lr: int, lc: int, rr: float, rc: float, linear: np.ndarray, half: int) -> float:
    """Correlation of a left window with the right one resampled under a 2x2 linear map about (rr, rc)."""
    if lr < half or lc < half or lr + half >= left.shape[0] or lc + half >= left.shape[1]:
        return float("nan")
    d = np.stack(np.meshgrid(np.arange(-half, half + 1), np.arange(-half, half + 1), indexing="ij")).reshape(2, -1).astype(float)
    at = linear @ d + np.array([[rr], [rc]])
    return correlation(left[lr - half : lr + half + 1, lc - half : lc + half + 1].astype(float), bilinear(right.astype(float), at[0], at[1]))

#: Samples of windows that ``Search.find_all`` compares at once.
WINDOWS = 1 << 20



class Pair:
    """Two images whose windows are compared, many places at a time.

    ``kind`` is gray (correlation), blend (0.90 gray and 0.10 of the gradients) or census (0.8 of the signatures'
    agreement and 0.2 gray).
    """

    def __init__(self, left: np.ndarray, right: np.ndarray, kind: str = "gray", mutual: np.ndarray | None = None):
        self.images, self.kind, self.mutual = [left.astype(np.float64), right.astype(np.float64)], kind, mutual
        self.gradients = [sobel(x) for x in self.images] if kind == "blend" else None

    def fits(self, side: int, r: np.ndarray, c: np.ndarray, half: int) -> np.ndarray:
        h, w = self.images[side].shape
        return (r >= half) & (c >= half) & (r < h - half) & (c < w - half)

    @staticmethod
    def _windows(image: np.ndarray, r: np.ndarray, c: np.ndarray, half: int, which: np.ndarray | None = None) -> np.ndarray:
        """Windows about places; with ``which`` about these of them."""
        side = 2 * half + 1
        r, c = (r, c) if which is None else (r[which], c[which])
        return np.lib.stride_tricks.sliding_window_view(image, (side, side))[r - half, c - half].reshape(len(r), -1)

    @staticmethod
    def _correlate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
        x, y = one - one.mean(axis=1, keepdims=True), many - many.mean(axis=1, keepdims=True)
        return (x * y).sum(axis=1) / np.sqrt(np.maximum((x * x).sum(axis=1), FLOOR) * np.maximum((y * y).sum(axis=1), FLOOR))

    def information(self, r: int, c: int, rr: np.ndarray, cc: np.ndarray) -> np.ndarray:
        """The pointwise mutual information of the left sample with the right ones, by the table of 256 by 256 whole values."""
        whole = lambda x: np.clip(x, 0, 255).astype(np.int64)
        h, w = self.images[1].shape
        return self.mutual[whole(self.images[0][r, c]), whole(self.images[1][np.clip(rr, 0, h - 1), np.clip(cc, 0, w - 1)])]

    def scores(self, r: int, c: int, rr: np.ndarray, cc: np.ndarray, half: int) -> np.ndarray:
        """The score of the left window about (r, c) with the right one about each place; -inf where one doesn't fit."""
        out = np.full(len(rr), -np.inf)
        here = np.array([r]), np.array([c])
        if not self.fits(0, *here, half)[0]:
            return out
        ok = self.fits(1, rr, cc, half)
        if not ok.any():
            return out
        one, many = self._windows(self.images[0], *here, half), self._windows(self.images[1], rr[ok], cc[ok], half)
        gray = self._correlate(one, many)
        if self.kind == "blend":
            gray = 0.90 * gray + 0.10 * self._correlate(self._windows(self.gradients[0], *here, half), self._windows(self.gradients[1], rr[ok], cc[ok], half))
        elif self.kind == "census":
            mid = one.shape[1] // 2
            bits = [np.delete(x < x[:, mid : mid + 1], mid, axis=1) for x in (one, many)]
            gray = 0.8 * (1.0 - 2.0 * (bits[0] != bits[1]).mean(axis=1)) + 0.2 * gray
        out[ok] = gray
        return out


@dataclass(frozen=True)
class Search:
    """How a place is looked for near a prediction.

    Every ``stride``-th offset within the reach is tried first, then all within ``refine`` of the best, with windows
    of ``refine_half``; the least energy 1 - score + ``smooth`` * distance / reach decides, of equal ones the first in
    row order. Places further than ``gate`` from the affine's are passed over. With ``sharpness`` the result is
    the centroid of the places within ``window`` of the best under weights exp(-sharpness * energy), the energy being
    there 1 - (score + 1) / 2; ``mutual`` weighs 1 - mutual information of the samples into the energy; with ``blur`` that of all places of the reach under exp(-blur * (1 - score + smooth * distance)).
    """

    reach: int = 8
    half: int = 4
    stride: int = 2
    refine: int = 2
    refine_half: int | None = None
    smooth: float = 0.0
    gate: float | None = None
    sharpness: float | None = None
    window: int = 1
    blur: float | None = None
    kind: str = "gray"
    mutual: float = 0.0

    def find(self, pair: Pair, r: int, c: int, pr: int, pc: int, reach: tuple[int, int] | None = None, affine: tuple[float, float] | None = None) -> tuple[float, float, float] | None:
        """Row, column and score, or None if no window fits."""
        far = reach or (self.reach, self.reach)
        if self.blur is not None:
            i, j = self._grid(far, self.stride)
            s = pair.scores(r, c, pr + i, pc + j, self.half)
            w = np.where(np.isfinite(s), np.exp(-self.blur * (1 - s + self.smooth * np.hypot(i, j))), 0.0)
            return ((w * (pr + i)).sum() / w.sum(), (w * (pc + j)).sum() / w.sum(), float(s.max())) if w.sum() > 0 else None
        best = self._best(pair, r, c, pr, pc, far, self.stride, self.half, affine)
        if best is not None and self.stride > 1:
            fine = self._best(pair, r, c, best[0], best[1], (self.refine, self.refine), 1, self.refine_half or self.half, affine)
            best = fine if fine is not None and (fine[2] > best[2] or self.refine_half in (None, self.half)) else best
        if best is None or self.sharpness is None:
            return best
        i, j = self._grid((self.window, self.window), 1)
        s = pair.scores(r, c, best[0] + i, best[1] + j, self.refine_half or self.half)
        w = np.where(np.isfinite(s), np.exp(-self.sharpness * (1 - np.clip((np.where(np.isfinite(s), s, -1.0) + 1) / 2, 0, 1))), 0.0)
        return float((w * (best[0] + i)).sum() / w.sum()), float((w * (best[1] + j)).sum() / w.sum()), max(best[2], float(s.max()))

    def at_once(self) -> bool:
        """Whether ``find_all`` does the search: every place of the reach, gray windows, no centroid."""
        return self.blur is None and self.sharpness is None and self.stride == 1 and self.kind == "gray"

    def find_all(self, pair: Pair, r: np.ndarray, c: np.ndarray, pr: np.ndarray, pc: np.ndarray, affine: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``find`` for many points: rows, columns and scores, -inf where no window fits."""
        i, j = self._grid((self.reach, self.reach), 1)
        many = max(1, WINDOWS // (len(i) * (2 * self.half + 1) ** 2))
        out = []
        for lo in range(0, len(r), many):
            r_, c_, rr, cc = r[lo : lo + many], c[lo : lo + many], pr[lo : lo + many, None] + i, pc[lo : lo + many, None] + j
            ok = pair.fits(0, r_, c_, self.half)[:, None] & pair.fits(1, rr, cc, self.half)
            if self.gate is not None and affine is not None:
                ok &= (np.abs(affine[0][lo : lo + many, None] - rr) < self.gate) & (np.abs(affine[1][lo : lo + many, None] - cc) < self.gate)
            s, which = np.full(rr.shape, -np.inf), np.nonzero(ok)[0]
            if len(which):
                s[ok] = pair._correlate(pair._windows(pair.images[0], r_, c_, self.half, which), pair._windows(pair.images[1], rr[ok], cc[ok], self.half))
            energy = 1 - s + self.smooth * np.hypot(i, j) / max(1, self.reach)
            if self.mutual and pair.mutual is not None and len(which):
                energy[ok] += self.mutual * (1 - pair.information(r_[which], c_[which], rr[ok], cc[ok]))
            k, at = np.argmin(np.round(energy, 9), axis=1), np.arange(len(r_))
            out.append((rr[at, k], cc[at, k], s[at, k]))
        return tuple(np.concatenate(x) if x else np.zeros(0) for x in (zip(*out, strict=True) if out else ((), (), ())))

    @staticmethod
    def _grid(reach: tuple[int, int], stride: int) -> tuple[np.ndarray, np.ndarray]:
        i, j = np.meshgrid(np.arange(-reach[0], reach[0] + 1, stride), np.arange(-reach[1], reach[1] + 1, stride), indexing="ij")
        return i.ravel(), j.ravel()

    def _best(self, pair: Pair, r: int, c: int, pr: int, pc: int, reach: tuple[int, int], stride: int, half: int, affine) -> tuple[int, int, float] | None:
        i, j = self._grid(reach, stride)
        s = pair.scores(r, c, pr + i, pc + j, half)
        if self.gate is not None and affine is not None:
            s = np.where((np.abs(affine[0] - (pr + i)) < self.gate) & (np.abs(affine[1] - (pc + j)) < self.gate), s, -np.inf)
        energy = 1 - s + self.smooth * np.hypot(i, j) / max(1, *reach)
        if self.mutual and pair.mutual is not None and np.isfinite(s).any():
            energy = energy + self.mutual * (1 - pair.information(r, c, pr + i, pc + j))
        energy = np.round(energy, 9)
        k = int(np.argmin(energy))
        return (pr + int(i[k]), pc + int(j[k]), float(s[k])) if np.isfinite(s[k]) else None


def mutual_table(a: np.ndarray, b: np.ndarray, n: np.ndarray, eps: float = 1e-6) -> np.ndarray:
    """The pointwise mutual information of all 256 by 256 pairs of values, from counts n of the pairs (a, b) that occur."""
    joint = np.zeros((256, 256))
    np.add.at(joint, (a, b), n)
    joint /= max(joint.sum(), 1.0)
    return np.log((joint + eps) / (joint.sum(axis=1, keepdims=True) * joint.sum(axis=0, keepdims=True) + eps))


class MutualInformation:
    """``mutual_table`` looked up by arrays of values, without making all 256 by 256 of it."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, eps: float = 1e-6):
        self.eps, self.total = eps, max(float(n.sum()), 1.0)
        self.keys, at = np.unique(a * 256 + b, return_inverse=True)
        self.joint = np.r_[np.bincount(at, n, len(self.keys)), 0.0]
        self.left, self.right = np.bincount(a, n, 256) / self.total, np.bincount(b, n, 256) / self.total

    def __getitem__(self, values: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        a, b = np.broadcast_arrays(*values)
        key = a * 256 + b
        at = np.searchsorted(self.keys, key)
        at = np.where(np.r_[self.keys, -1][at] == key, at, len(self.keys))
        return np.log((self.joint[at] / self.total + self.eps) / (self.left[a] * self.right[b] + self.eps))


def search(left: np.ndarray, right: np.ndarray, lr: int, lc: int, pr: int, pc: int, reach: int, half: int, stride: int = 2) -> tuple[int, int, float] | None:
    """Best place near a prediction: every ``stride``-th offset first, then all within a stride of the best.
    Of equal scores the first in row order stays. None if no window fits."""
    return Search(reach, half, stride, refine=stride).find(Pair(left, right), lr, lc, pr, pc)


def register(left: np.ndarray, right: np.ndarray, rows: int, cols: int, half: int = 2, step: int = 16) -> tuple[int, int, float]:
    """The shift (i, j), |i| <= rows and 0 <= j < cols, at which left (r + i, c + j) looks like right (r, c): that with
    the highest mean correlation of windows every ``step`` samples of the overlap; of equal ones the first."""
    side, best = 2 * half + 1, (0, 0, -2.0)
    if min(*left.shape, *right.shape) < side:
        return best
    a, b = (np.lib.stride_tricks.sliding_window_view(x.astype(np.float64), (side, side)) for x in (left, right))
    norm = lambda x: (lambda d: d / np.sqrt(np.maximum((d * d).sum(axis=(2, 3), keepdims=True), FLOOR)))(x - x.mean(axis=(2, 3), keepdims=True))
    for i in range(-rows, rows + 1):
        for j in range(cols):
            h, w = min(a.shape[0] - max(0, i), b.shape[0] - max(0, -i)), min(a.shape[1] - j, b.shape[1])
            if h < 1 or w < 1:
                continue
            x = a[max(0, i) : max(0, i) + h : step, j : j + w : step]
            y = b[max(0, -i) : max(0, -i) + h : step, :w:step]
            m = round(float((norm(x) * norm(y)).sum(axis=(2, 3)).mean()), 9)
            if m > best[2]:
                best = (i, j, m)
    return best


def subpixel(scores: np.ndarray, sharpness: float = 30.0) -> tuple[float, float]:
    """Offset from a score window's centre to its centroid under weights exp(-sharpness (1 - score))."""
    h = scores.shape[0] // 2
    w = np.exp(-sharpness * (1 - np.nan_to_num(scores, nan=-1.0)))
    i, j = np.mgrid[-h : h + 1, -h : h + 1]
    return float((w * i).sum() / w.sum()), float((w * j).sum() / w.sum())


def harris(image: np.ndarray, k: float = 0.04, half: int = 2) -> np.ndarray:
    """Corner response det - k trace^2 of the gradients summed over a square window."""
    p = np.pad(image.astype(np.float64), 1, mode="edge")
    gy, gx = (p[2:, 1:-1] - p[:-2, 1:-1]) / 2, (p[1:-1, 2:] - p[1:-1, :-2]) / 2

    def window(a: np.ndarray) -> np.ndarray:
        s = np.pad(a, half).cumsum(0).cumsum(1)
        s = np.pad(s, ((1, 0), (1, 0)))
        n = 2 * half + 1
        return s[n:, n:] - s[:-n, n:] - s[n:, :-n] + s[:-n, :-n]

    xx, yy, xy = window(gx * gx), window(gy * gy), window(gx * gy)
    return xx * yy - xy * xy - k * (xx + yy) ** 2


def corners(image: np.ndarray, cell: int = 8, border: int = 4, least: float = 0.0) -> list[tuple[int, int, float]]:
    """The strongest corner of each cell, in row order of the cells; of equal ones the first."""
    response, out = harris(image), []
    for r in range(border, image.shape[0] - border, cell):
        for c in range(border, image.shape[1] - border, cell):
            block = response[r : min(r + cell, image.shape[0] - border), c : min(c + cell, image.shape[1] - border)]
            i, j = np.unravel_index(np.argmax(block), block.shape)
            if block[i, j] > least:
                out.append((r + int(i), c + int(j), float(block[i, j])))
    return out


def affine_scores(pairs, side: int, lr: int, lc: int, rr: float, rc: float, linear, half: int):
    """Adds score: the left window (column limg) about (lr, lc) against the right image (rimg) resampled about (rr, rc). A Pandas
    function over Arrow batches, as resampling has no column expression."""
    shape = lambda v: np.asarray(v, np.float64).reshape(side, side)

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([affine_correlation(shape(x), shape(y), lr, lc, rr, rc, np.array(linear), half) for x, y in zip(a, b, strict=True)], dtype="float64")

    return pairs.withColumn("score", F.nanvl(score("limg", "rimg"), F.lit(None).cast("double")))


def gradients(tiles):
    """Adds gradient, |Sx| + |Sy| of each sample of a tile (rows, cols, samples)."""

    @F.pandas_udf("array<double>")
    def magnitude(samples: pd.Series, rows: pd.Series, cols: pd.Series) -> pd.Series:
        return pd.Series([sobel(np.asarray(v).reshape(r, c)).ravel() for v, r, c in zip(samples, rows, cols, strict=True)])

    return tiles.withColumn("gradient", magnitude("samples", "rows", "cols"))
