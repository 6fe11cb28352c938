"""Sums over all neighbours within a radius, without a table of pairs.

The plane is cut into blocks; a point goes to its own block and, as a neighbour, to the blocks it can reach. Inside a block neighbours lie in
strips, each in order of row with running sums. Of a strip the stretch that is inside the circle whatever the column counts by a difference of
two running sums, only the rims meet point by point; so rows shuffled follow the number of points, whatever their density.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Neighbours that one task takes of a block at once; a fuller block is dealt out in pieces that meet each other.
PIECE = 200_000
#: Sides of a block in radii, the largest whose fullest block fits is taken; strips in a radius; pairs that are looked at together.
SIDES, STRIPS, PAIRS = (8, 4, 2, 1), 8, 1 << 21
#: Sides of a block where points are few, as each block costs a call: the largest whose fullest block has no more than FULL points of both
#: sides is taken; of small tables blocks are smaller, about as many as PARTS, but of no fewer points than FEW.
WIDE, FULL, FEW, PARTS = (4096, 1024, 256, 64, 16), 25_000, 2_000, 64
#: Exponents of the monomials whose weighted sums a quadratic needs.
QUADRATIC = [(i, d - i) for d in range(5) for i in range(d, -1, -1)]
BASIS = [(0, 0), (1, 0), (0, 1), (2, 0), (1, 1), (0, 2)]


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges [start, end): which one, and the integers in it."""
    size = np.maximum(end - start, 0)
    which = np.repeat(np.arange(len(start)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)


class Strips:
    """Neighbours by strip and row, with running sums of ``terms`` (a column per sum)."""

    def __init__(self, row: np.ndarray, col: np.ndarray, terms: np.ndarray, radius: float):
        self.width, self.radius = radius / STRIPS, radius
        strip = np.floor(col / self.width).astype(np.int64)
        order = np.lexsort((row, strip))
        self.order, self.row, self.col, self.strip = order, row[order], col[order], strip[order]
        self.terms = terms[order]
        self.sums = np.vstack([np.zeros((1, terms.shape[1])), np.cumsum(self.terms, axis=0)])
        self.names, self.begin = np.unique(self.strip, return_index=True)
        self.end = np.r_[self.begin[1:], len(row)]
        self.low = self.row.min() if len(row) else 0.0
        self.span = (self.row.max() - self.low if len(row) else 0.0) + 4 * radius + 1.0
        self.key = (self.row - self.low) + np.searchsorted(self.names, self.strip) * self.span

    def _at(self, strip: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The first neighbour of a strip at a row or beyond it."""
        inside = np.clip(row - self.low, -self.radius, self.span - 2 * self.radius)
        return np.clip(np.searchsorted(self.key, inside + strip * self.span), self.begin[strip], self.end[strip])

    def stretches(self, row: np.ndarray, col: np.ndarray):
        """Per query and strip: query, the strip's neighbours that may be inside [a, d) and those that surely are [b, c)."""
        own = np.floor(col / self.width).astype(np.int64)
        for shift in range(-STRIPS - 1, STRIPS + 2):
            at = np.searchsorted(self.names, own + shift)
            q = np.flatnonzero((at < len(self.names)) & (self.names[np.minimum(at, len(self.names) - 1)] == own + shift))
            if not len(q):
                continue
            s, left = at[q], (own[q] + shift) * self.width
            away = np.maximum(0.0, np.maximum(left - col[q], col[q] - left - self.width))
            far = np.maximum(np.abs(col[q] - left), np.abs(col[q] - left - self.width))
            slack = self.radius * 1e-9  # rims are wider than rounding errors
            outer = np.sqrt(np.maximum(0.0, (self.radius + slack) ** 2 - np.maximum(0.0, away - slack) ** 2)) + slack
            inner = np.sqrt(np.maximum(0.0, (self.radius - slack) ** 2 - (far + slack) ** 2)) - slack
            a, d = self._at(s, row[q] - outer), self._at(s, np.nextafter(row[q] + outer, np.inf))
            b, c = self._at(s, row[q] - inner), self._at(s, row[q] + inner)
            none = inner <= 0
            b, c = np.where(none, d, b), np.where(none, d, c)
            yield q, a, np.clip(b, a, d), np.clip(np.maximum(b, c), a, d), d


def _pairs(q: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Pairs of queries and the neighbours in their ranges, about PAIRS at a time."""
    size = np.maximum(end - start, 0)
    total = np.cumsum(size)
    lo = 0
    while lo < len(q):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIRS, side="right")))
        which, j = _ranges(start[lo:hi], end[lo:hi])
        if len(j):
            yield q[lo:hi][which], j
        lo = hi


def plain_sums(row, col, strips: Strips, closed: bool) -> np.ndarray:
    """Sums of the terms over each query's neighbours inside the radius."""
    out = np.zeros((len(row), strips.terms.shape[1]))
    limit = strips.radius * strips.radius
    for q, a, b, c, d in strips.stretches(row, col):
        out[q] += strips.sums[c] - strips.sums[b]
        for lo, hi in ((a, b), (c, d)):
            for i, j in _pairs(q, lo, hi):
                d2 = (row[i] - strips.row[j]) ** 2 + (col[i] - strips.col[j]) ** 2
                near = d2 <= limit if closed else d2 < limit
                i, j = i[near], j[near]
                for k in range(out.shape[1]):
                    out[:, k] += np.bincount(i, strips.terms[j, k], len(row))
    return out


def weighted_sums(row, col, strips: Strips, closed: bool, weigh: Callable, form: Callable) -> np.ndarray:
    """Sums over each query's neighbours of the columns that ``form`` makes of (dr, dc, terms, weight)."""
    out, limit = None, strips.radius * strips.radius
    for q, a, _, _, d in strips.stretches(row, col):
        for i, j in _pairs(q, a, d):
            x, y = strips.row[j] - row[i], strips.col[j] - col[i]
            d2 = x * x + y * y
            near = d2 <= limit if closed else d2 < limit
            i, j, x, y, d2 = i[near], j[near], x[near], y[near], d2[near]
            columns = form(x, y, strips.terms[j], weigh(d2))
            out = np.zeros((len(row), len(columns))) if out is None else out
            for k, v in enumerate(columns):
                out[:, k] += np.bincount(i, v, len(row))
    return out if out is not None else np.zeros((len(row), 0))


def _sums(radius: float, closed: bool, names: list[str], spread: list[tuple[int, int]], apart: bool, weigh: Callable | None, form: Callable | None) -> Callable:
    """Sums of one block's piece of queries over its piece of neighbours."""

    def run(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        at = lambda name, s: table[name].to_numpy()[side == s].astype(float)
        ids, other = table["id"].to_numpy()[side == 0], table["id"].to_numpy()[side == 1]
        (row, col), (r, c) = ((at("r", s), at("c", s)) for s in (0, 1))
        values = [at(f"v{k}", 1) for k in range(len([n for n in table.column_names if n.startswith("v")]))]
        terms = np.column_stack([np.ones(len(r)), *values, *(values[i] * values[j] for i, j in spread)]) if weigh is None else np.column_stack([np.ones(len(r)), *values])
        if len(ids) and len(other):
            strips = Strips(r, c, terms, radius)
            sums = plain_sums(row, col, strips, closed)[:, : len(names)] if weigh is None else None
            if sums is None:
                sums = weighted_sums(row, col, strips, closed, weigh, form)
                sums = sums if sums.shape[1] else np.zeros((len(row), len(names)))
            if apart:  # a point is no neighbour of itself
                order = np.argsort(other, kind="stable")
                first, last = np.searchsorted(other[order], ids), np.searchsorted(other[order], ids, side="right")
                i, j = _ranges(first, last)
                j = order[j]
                x, y = r[j] - row[i], c[j] - col[i]
                near = (x * x + y * y <= radius * radius) if closed else (x * x + y * y < radius * radius)
                i, j, x, y = i[near], j[near], x[near], y[near]
                own = terms[j].T if weigh is None else form(x, y, terms[j], weigh(x * x + y * y))
                for k, v in enumerate(own):
                    sums[:, k] -= np.bincount(i, v, len(ids))
            full = sums[:, 0] > 0.5
            ids, sums = ids[full], sums[full]
        else:
            ids, sums = ids[:0], np.zeros((0, len(names)))
        return pa.table({"id": pa.array(ids, pa.int64()), **{n: pa.array(sums[:, k], pa.float64()) for k, n in enumerate(names)}})

    return run


def _side(l: DataFrame, r: DataFrame, named: list[str], radius: float) -> tuple[int, int]:
    """The side of a block in radii, and in how many pieces a block's points are dealt out."""
    cell = lambda d, side: d.select(*named, F.floor(F.col("r") / (radius * side)).cast("long").alias("br"), F.floor(F.col("c") / (radius * side)).cast("long").alias("bc"))

    def most(finest: DataFrame, sides: tuple[int, ...]) -> dict:
        cells = finest.withColumn("side", F.explode(F.array(*(F.lit(s // sides[-1]) for s in sides))))
        fullest = cells.groupBy("side", *named, F.floor(F.col("br") / F.col("side")), F.floor(F.col("bc") / F.col("side"))).agg(F.sum("n").alias("n"))
        return {row["side"] * sides[-1]: (row["n"], row["t"]) for row in fullest.groupBy("side").agg(F.max("n").alias("n"), F.sum("n").alias("t")).collect()}

    counted = lambda d: d.groupBy(*d.columns).agg(F.count(F.lit(1)).alias("n"))
    wide = most(counted(cell(l, WIDE[-1]).unionAll(cell(r, WIDE[-1]))), WIDE)
    for side in WIDE:
        n, total = wide.get(side, (0, 0))
        if n <= min(FULL, PIECE, max(FEW, total // PARTS)):
            return side, 1
    near = most(counted(cell(r, SIDES[-1])), SIDES)
    for side in SIDES:
        n = near.get(side, (0, 0))[0]
        if n <= PIECE:
            break
    return side, -(-n // PIECE) or 1


def _blocked(left: DataFrame, right: DataFrame, left_at, right_at, ids, values, keys, radius) -> tuple[DataFrame, list[str], int]:
    """Queries (side 0) and neighbours (side 1) with the block and the pieces they go to."""
    named = [f"k{i}" for i in range(len(keys))]
    own = [F.col(k).alias(n) for k, n in zip(keys, named, strict=True)]
    fine = lambda d, at: d.filter(F.col(at[0]).isNotNull() & F.col(at[1]).isNotNull() & (F.abs(F.col(at[0])) < 1e15) & (F.abs(F.col(at[1])) < 1e15))
    l = fine(left, left_at).select(*own, F.col(ids[0]).cast("long").alias("id"), F.col(left_at[0]).cast("double").alias("r"), F.col(left_at[1]).cast("double").alias("c"))
    r = fine(right, right_at).select(*own, F.col(ids[1]).cast("long").alias("id"), F.col(right_at[0]).cast("double").alias("r"), F.col(right_at[1]).cast("double").alias("c"), *(F.col(v).cast("double").alias(f"v{k}") for k, v in enumerate(values)))
    block = lambda x, side: F.floor(x / (radius * side)).cast("long")
    side, pieces = _side(l, r, named, radius)
    size = radius * side
    reach = lambda x: F.sequence(F.floor((x - radius * 1.000001) / size).cast("long"), F.floor((x + radius * 1.000001) / size).cast("long"))
    l = l.withColumns({"side": F.lit(0), "br": block(F.col("r"), side), "bc": block(F.col("c"), side)})
    r = r.withColumn("side", F.lit(1)).withColumn("br", F.explode(reach(F.col("r")))).withColumn("bc", F.explode(reach(F.col("c"))))
    piece = F.pmod(F.xxhash64("id", "r", "c"), F.lit(pieces)).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.lit(pieces - 1)))
    l, r = l.withColumn("lp", piece).withColumn("rp", each), r.withColumn("rp", piece).withColumn("lp", each)
    return l.unionByName(r, allowMissingColumns=True), [*named, "br", "bc", "lp", "rp"], pieces


def _collected(left, right, left_at, right_at, ids, values, keys, radius, names, run) -> DataFrame:
    union, group, pieces = _blocked(left, right, left_at, right_at, ids, values, keys, radius)
    found = union.groupBy(*group).applyInArrow(run, "id long, " + ", ".join(f"{n} double" for n in names))
    found = found.groupBy("id").agg(*(F.sum(n).alias(n) for n in names)) if pieces > 1 else found
    return found.withColumnRenamed("id", ids[0])


def radius_moments(left: DataFrame, right: DataFrame, left_at: tuple[str, str], right_at: tuple[str, str], radius: float, ids: tuple[str, str], values: list[str], keys: list[str] = (), closed: bool = False, apart: bool = True) -> DataFrame:
    """Of each left point with a neighbour closer than ``radius`` (or as close, if closed) and equal in ``keys``: its id, the number n of
    neighbours, per value v its mean m_v and variance v_v (of the population), and of two values their covariance cov.

    Ids are integers and those of ``left`` differ; with ``apart`` a neighbour of the point's own id does not count. Rows with null, infinite
    or not-a-number coordinates are no points; an empty side gives an empty table; values must not be null.
    """
    spread = [(i, i) for i in range(len(values))] + ([(0, 1)] if len(values) == 2 else [])
    names = ["n", *(f"s{k}" for k in range(len(values))), *(f"q{i}{j}" for i, j in spread)]
    found = _collected(left, right, left_at, right_at, ids, values, list(keys), radius, names, _sums(radius, closed, names, spread, apart, None, None))
    n, out = F.col("n"), [F.col(ids[0]), F.rint("n").cast("long").alias("n")]
    for k, v in enumerate(values):
        mean = F.col(f"s{k}") / n
        out += [mean.alias(f"m_{v}"), F.greatest(F.lit(0.0), F.col(f"q{k}{k}") / n - mean * mean).alias(f"v_{v}")]
    if len(values) == 2:
        out.append((F.col("q01") / n - F.col("s0") / n * (F.col("s1") / n)).alias("cov"))
    return found.select(*out)


def gaussian(scale: float) -> Callable:
    """The weight exp(-d2 / scale)."""
    return lambda d2: np.exp(-d2 / scale)


def inverse_square(d2: np.ndarray) -> np.ndarray:
    """The weight 1 / (d2 + 1)."""
    return 1.0 / (d2 + 1.0)


def _mean_form(x, y, terms, w) -> list[np.ndarray]:
    return [terms[:, 0], w, *(c for k in range(1, terms.shape[1]) for c in (terms[:, k], terms[:, k] ** 2, w * terms[:, k]))]


def radius_weighted(left: DataFrame, right: DataFrame, left_at, right_at, radius: float, ids, values: list[str], weigh: Callable, keys: list[str] = (), closed: bool = False, apart: bool = True) -> DataFrame:
    """As ``radius_moments``, with the weighted mean w_v of each value; ``weigh`` makes weights of squared distances."""
    names = ["n", "w", *(f"{a}{k}" for k in range(len(values)) for a in ("s", "q", "ws"))]
    found = _collected(left, right, left_at, right_at, ids, values, list(keys), radius, names, _sums(radius, closed, names, [], apart, weigh, _mean_form))
    out, n = [F.col(ids[0]), F.rint("n").cast("long").alias("n")], F.col("n")
    for k, v in enumerate(values):
        mean = F.col(f"s{k}") / n
        out += [mean.alias(f"m_{v}"), F.greatest(F.lit(0.0), F.col(f"q{k}") / n - mean * mean).alias(f"v_{v}"), (F.col(f"ws{k}") / F.nullif(F.col("w"), F.lit(0.0))).alias(f"w_{v}")]
    return found.select(*out)


def _surface_form(many: int) -> Callable:
    def form(x, y, terms, w) -> list[np.ndarray]:
        px, py = [np.ones_like(x), x], [np.ones_like(y), y]
        for k in range(2, 5):
            px.append(px[-1] * x)
            py.append(py[-1] * y)
        m = {(i, j): w * px[i] * py[j] for i, j in QUADRATIC}
        return [terms[:, 0], *(m[e] for e in QUADRATIC), *(m[e] * terms[:, k + 1] for k in range(many) for e in BASIS)]

    return form


def radius_surface_sums(left: DataFrame, right: DataFrame, left_at, right_at, radius: float, ids, values: list[str], weigh: Callable, keys: list[str] = (), apart: bool = False) -> DataFrame:
    """The sums that ``fit.surfaces_of`` solves: id, _n, fifteen weighted moments _mij of the neighbours' places about the point, and of
    each value k the six sums _bkij."""
    names = ["_n", *(f"_m{i}{j}" for i, j in QUADRATIC), *(f"_b{k}{i}{j}" for k in range(len(values)) for i, j in BASIS)]
    return _collected(left, right, left_at, right_at, ids, values, list(keys), radius, names, _sums(radius, False, names, [], apart, weigh, _surface_form(len(values))))
