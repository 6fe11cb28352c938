"""Grid operators on tables with a row per cell; a missing row is a hole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.shared import held
from .robust import exact_quantiles, small_groups, with_median
from .scans import scan_by_ranges
from .upsert import best_cell


def regular_grid(tiles: DataFrame, rows: str, cols: str, step: int) -> DataFrame:
    """Upper left corners of the cells that fit whole, and their centres."""
    count = lambda n: F.floor(F.col(n) / step).cast("int")
    seq = lambda n: F.when(count(n) > 0, F.sequence(F.lit(0), count(n) - 1)).otherwise(F.array().cast("array<int>"))
    cells = tiles.withColumn("_i", F.explode(seq(rows))).withColumn("_j", F.explode(seq(cols)))
    return cells.withColumn("row", F.col("_i") * step).withColumn("col", F.col("_j") * step).withColumn("centre_row", F.col("row") + step / 2).withColumn("centre_col", F.col("col") + step / 2).drop("_i", "_j")


def rasterise(points: DataFrame, row: str, col: str, cell: float, score: str, ordinal: str, keys: list[str] = ()) -> DataFrame:
    """The best-scored point of each cell (ir, ic); coordinates are rounded half to even, of equal scores the
    later point stays, cells before the origin are dropped."""
    at = points.withColumn("ir", F.rint(F.col(row) / cell).cast("long")).withColumn("ic", F.rint(F.col(col) / cell).cast("long")).filter("ir >= 0 AND ic >= 0")
    return best_cell(at, [*keys, "ir", "ic"], score, ordinal)


def focal_median(cells: DataFrame, values: list[str], keys: list[str] = (), reach: int = 1) -> DataFrame:
    """Adds each value's median over the cells within ``reach``, itself included, and their number n_window."""
    steps = F.array(*(F.lit(i) for i in range(-reach, reach + 1)))
    spread = cells.select(*keys, "ir", "ic", *values).withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps))
    spread = spread.select(*keys, (F.col("ir") + F.col("_i")).alias("ir"), (F.col("ic") + F.col("_j")).alias("ic"), *values)
    near = spread.groupBy(*keys, "ir", "ic").agg(F.count(F.lit(1)).alias("n_window"), *(F.median(v).alias(f"{v}_median") for v in values))
    return cells.join(near, [*keys, "ir", "ic"])


def inconsistency(cells: DataFrame, x: str, y: str, keys: list[str] = ()) -> DataFrame:
    near = focal_median(cells, [x, y], keys)
    dx, dy = F.col(x) - F.col(f"{x}_median"), F.col(y) - F.col(f"{y}_median")
    return near.withColumn("inconsistency", F.sqrt(dx * dx + dy * dy))


def despike(cells: DataFrame, x: str, y: str, k: float = 3.0, least_threshold: float = 0.0, neighbours: int = 3, samples: int = 8) -> DataFrame:
    """Cells without those whose inconsistency passes median + k 1.4826 MAD and that have enough neighbours.
    Fewer than ``samples`` cells are left alone; with no spread the threshold is the median."""
    inc = inconsistency(cells, x, y)
    small = small_groups(cells, [])
    d = with_median(inc, [], "inconsistency", "_med", small).join(F.broadcast(inc.agg(F.count(F.lit(1)).alias("_n")))).withColumn("_d", F.abs(F.col("inconsistency") - F.col("_med")))
    d = with_median(d, [], "_d", "_mad", small)
    scale = 1.4826 * F.col("_mad")
    threshold = F.greatest(F.when(scale > 1e-12, F.col("_med") + k * scale).otherwise(F.col("_med")), F.lit(float(least_threshold)))
    bad = (F.col("_n") >= samples) & (F.col("inconsistency") > threshold) & (F.col("n_window") - 1 >= neighbours)
    return d.filter(~bad).select(*cells.columns)


def points_in_cells(points: DataFrame, kept: DataFrame, all_cells: DataFrame, row: str, col: str, cell: float) -> DataFrame:
    """Points but those that fall into a cell that was removed."""
    gone = all_cells.select("ir", "ic").join(kept.select("ir", "ic"), ["ir", "ic"], "left_anti")
    at = points.withColumn("ir", F.rint(F.col(row) / cell).cast("long")).withColumn("ic", F.rint(F.col(col) / cell).cast("long"))
    return at.join(gone, ["ir", "ic"], "left_anti").select(*points.columns)


def block_mean(pixels: DataFrame, k: int, value: str, keys: list[str] = ()) -> DataFrame:
    """Means of k by k blocks, cut to whole numbers. A mean that lacks a whole number by no more than what the order of its sum
    changes (1e-9) is that number, so results do not depend on partitions."""
    return pixels.groupBy(*keys, F.floor(F.col("r") / k).alias("r"), F.floor(F.col("c") / k).alias("c")).agg(F.floor(F.round(F.avg(value), 9)).alias(value))


def seam_blend(overlap: DataFrame, left: Column, right: Column, at: Column) -> DataFrame:
    """Mixes of two half images over four columns: 3:1, 2:2, 1:3, 1:3."""
    share = F.when(at == 0, 0.75).when(at == 1, 0.5).otherwise(0.25)
    return overlap.withColumn("blend", F.floor(share * left + (1.0 - share) * right))


def composite(pixels: DataFrame, tile: str) -> DataFrame:
    """Of the pixels that tiles put in one place that of the highest tile."""
    w = W.partitionBy("r", "c").orderBy(F.desc(tile))
    return pixels.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def upsample(cells: DataFrame, k: int) -> DataFrame:
    """Each cell as k by k cells."""
    seq = F.sequence(F.lit(0), F.lit(k - 1))
    return cells.withColumn("_i", F.explode(seq)).withColumn("_j", F.explode(seq)).withColumn("ir", F.col("ir") * k + F.col("_i")).withColumn("ic", F.col("ic") * k + F.col("_j")).drop("_i", "_j")


def _spread(cells: DataFrame, offsets: list[tuple[int, int]], keep: list[str]) -> DataFrame:
    o = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(i * i + j * j).alias("d2")) for i, j in offsets))
    s = cells.select("ir", "ic", *keep).withColumn("_o", F.explode(o))
    return s.select((F.col("ir") + F.col("_o.i")).alias("ir"), (F.col("ic") + F.col("_o.j")).alias("ic"), F.col("_o.d2").alias("d2"), F.col("ir").alias("from_r"), F.col("ic").alias("from_c"), *keep)


def disk(radius: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius]


def dilate(cells: DataFrame, radius: int, values: list[str]) -> DataFrame:
    """Cells within a disk of others take the nearest one's values; of equally near ones the first in row order."""
    w = W.partitionBy("ir", "ic").orderBy("d2", "from_r", "from_c")
    return _spread(cells, disk(radius), values).withColumn("_k", F.row_number().over(w)).filter("_k = 1").select("ir", "ic", "d2", *values)


def erode(cells: DataFrame, radius: int) -> DataFrame:
    """Cells whose whole disk is there."""
    n = len(disk(radius))
    full = _spread(cells, disk(radius), []).groupBy("ir", "ic").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == n)
    return full.select("ir", "ic")


def close(cells: DataFrame, radius: int) -> DataFrame:
    return erode(dilate(cells, radius, []), radius)


def holes_near(cells: DataFrame, gap: int) -> DataFrame:
    """Holes within ``gap`` of a cell."""
    return dilate(cells, gap, []).select("ir", "ic").join(cells.select("ir", "ic"), ["ir", "ic"], "left_anti")


def inland_holes(cells: DataFrame, rounds: int = 60) -> DataFrame:
    """Holes inside the bounding box that no path of 4-neighbouring holes joins to its border.

    Runs of holes along rows are the nodes, touching runs of adjacent rows the edges; all border runs are one node. Each round a
    node hooks to the least of its neighbours, chains of hooks are shortened by halves, and each tree becomes one node of a smaller
    graph; so a spiral of any length is done in a logarithm of rounds. Runs are as many as cells at most.
    """
    box = cells.agg(F.min("ir").alias("r0"), F.max("ir").alias("r1"), F.min("ic").alias("c0"), F.max("ic").alias("c1"))
    w = W.partitionBy("ir").orderBy("ic")
    there = cells.select("ir", "ic").distinct()
    inner = there.withColumn("_n", F.lead("ic").over(w)).filter(F.col("_n") > F.col("ic") + 1).select("ir", (F.col("ic") + 1).alias("a"), (F.col("_n") - 1).alias("b"), F.lit(False).alias("open"))
    ends = there.groupBy("ir").agg(F.min("ic").alias("_a"), F.max("ic").alias("_b")).join(F.broadcast(box))
    left = ends.filter("_a > c0").select("ir", F.col("c0").alias("a"), (F.col("_a") - 1).alias("b"), F.lit(True).alias("open"))
    right = ends.filter("_b < c1").select("ir", (F.col("_b") + 1).alias("a"), F.col("c1").alias("b"), F.lit(True).alias("open"))
    empty = box.filter("r0 IS NOT NULL").select(F.explode(F.sequence("r0", "r1")).alias("ir"), "c0", "c1").join(there.select("ir").distinct(), "ir", "left_anti").select("ir", F.col("c0").alias("a"), F.col("c1").alias("b"), F.lit(True).alias("open"))
    runs = inner.unionByName(left).unionByName(right).unionByName(empty).join(F.broadcast(box)).withColumn("open", F.col("open") | (F.col("ir") == F.col("r0")) | (F.col("ir") == F.col("r1"))).select("ir", "a", "b", "open")
    runs = held(runs.withColumn("id", F.when(F.col("open"), F.lit(-1)).otherwise(F.monotonically_increasing_id())), "runs")
    below = runs.select((F.col("ir") - 1).alias("ir"), F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("id").alias("v"))
    touching = runs.join(below, "ir").filter("a <= _b AND _a <= b").select(F.col("id").alias("u"), "v").filter("u <> v")
    root = component_roots(touching, rounds)
    outer = root.join(root.filter("node = -1").select(F.col("root").alias("_r")), F.col("root") == F.col("_r"), "left_semi").select(F.col("node").alias("id"))
    return runs.filter("NOT open").join(outer, "id", "left_anti").select("ir", F.explode(F.sequence("a", "b")).alias("ic"))


def component_roots(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of all nodes with an edge (u, v): nodes of one component have one root.

    Contraction: each node hooks to the least node beside it if that is less, else stays a root; hooks are followed by pointer
    jumping, edges are renamed to the roots, doubles and loops go. A round leaves at most half of the nodes that have edges.
    """
    now = held(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    names = held(now.select(F.col("u").alias("node")).unionByName(now.select(F.col("v").alias("node"))).distinct().withColumn("root", F.col("node")), "roots")
    for _ in range(rounds):
        if now.isEmpty():
            return names
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a node that is least of its neighbours takes the least of those in turn, else chains of least nodes would not shrink
        hooks = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p"))
        lone = hooks.filter("u = p").select("u").join(hooks.filter("u <> p").select(F.col("p").alias("u")).distinct(), "u", "left_anti")
        joined = both.join(lone, "u", "left_semi").groupBy("u").agg(F.min("v").alias("m"))
        hooks = held(hooks.join(joined, "u", "left").select("u", F.coalesce("m", "p").alias("p")), "hooks")
        for _ in range(rounds):
            far = held(hooks.join(hooks.select(F.col("u").alias("p"), F.col("p").alias("q")), "p").select("u", "p", "q"), "hooks")
            hooks = far.select("u", F.col("q").alias("p"))
            if far.filter("p <> q").isEmpty():
                break
        names = held(names.join(hooks.select(F.col("u").alias("root"), "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root")), "roots")
        moved = now.join(hooks.select("u", F.col("p").alias("pu")), "u").join(hooks.select(F.col("u").alias("v"), F.col("p").alias("pv")), "v")
        now = held(moved.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).filter("u <> v").distinct(), "edges")
    raise RuntimeError("components did not settle")


def plane_fill(cells: DataFrame, holes: DataFrame, value: str, sigma: float, reach: int) -> DataFrame:
    """Fills holes by Gaussian-weighted planes through the cells within ``reach``, solved in closed form; where
    the plane is undetermined or runs off, by the weighted mean. Holes without a cell in reach are left out."""
    disk_ = [(i, j) for i, j in disk(reach)]
    near = _spread(cells, disk_, [value]).join(holes.select("ir", "ic"), ["ir", "ic"])
    w = F.exp(-F.col("d2") / (2.0 * sigma * sigma))
    r, c, z = F.col("from_r") - F.col("ir"), F.col("from_c") - F.col("ic"), F.col(value)
    s = near.groupBy("ir", "ic").agg(*(F.sum(e).alias(n) for n, e in (("w", w), ("r", w * r), ("c", w * c), ("rr", w * r * r), ("rc", w * r * c), ("cc", w * c * c), ("z", w * z), ("rz", w * r * z), ("cz", w * c * z))))
    C = F.col  # noqa: N806
    k0, k1, k2 = C("rr") * C("cc") - C("rc") * C("rc"), C("c") * C("rc") - C("r") * C("cc"), C("r") * C("rc") - C("c") * C("rr")
    det = C("w") * k0 + C("r") * k1 + C("c") * k2
    size = F.abs(C("w")) + F.abs(C("rr")) + F.abs(C("cc")) + F.abs(C("r")) + F.abs(C("c")) + F.abs(C("rc")) + 1e-30
    mean = C("z") / C("w")
    plane = F.when(F.abs(det) > 1e-12 * size * size * size, (k0 * C("z") + k1 * C("rz") + k2 * C("cz")) / det)
    fine = plane.isNotNull() & (F.abs(plane - mean) <= 10.0 * (F.abs(mean) + 1.0))
    return s.filter("w > 1e-6").select("ir", "ic", F.when(fine, plane).otherwise(mean).alias(value), fine.alias("plane"))


def gap_fill(cells: DataFrame, values: list[str], sigma: float, gap: int, sparse: bool = False) -> DataFrame:
    """Cells and filled holes: inland ones, those near a cell and, if ``sparse``, those of the closed coverage."""
    holes = inland_holes(cells).unionByName(holes_near(cells, gap))
    if sparse:
        holes = holes.unionByName(close(cells, gap).join(cells.select("ir", "ic"), ["ir", "ic"], "left_anti"))
    holes, reach = holes.distinct(), max(1, int(4 * sigma + 0.5))
    filled = None
    for v in values:
        one = plane_fill(cells, holes, v, sigma, reach).select("ir", "ic", v)
        filled = one if filled is None else filled.join(one, ["ir", "ic"])
    return cells.select("ir", "ic", *values, F.lit(False).alias("filled")).unionByName(filled.withColumn("filled", F.lit(True)))


def dem_sample(points: DataFrame, dem: DataFrame, width: int, height: int, row: str, col: str, h: str) -> DataFrame:
    """Heights at fractional places as means of 3 by 3 pixels under weights exp(-d^2); columns wrap around,
    rows stop at the edge."""
    steps = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    p = points.withColumn("_r0", F.rint(row)).withColumn("_c0", F.rint(col)).withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps))
    d2 = F.pow(F.col("_r0") + F.col("_i") - F.col(row), 2) + F.pow(F.col("_c0") + F.col("_j") - F.col(col), 2)
    p = p.withColumn("_w", F.exp(-d2)).withColumn("_r", F.greatest(F.lit(0), F.least(F.lit(height - 1), F.col("_r0") + F.col("_i"))).cast("long")).withColumn("_c", F.pmod((F.col("_c0") + F.col("_j")).cast("long"), F.lit(width)))
    d = dem.select(F.col("r").cast("long").alias("_r"), F.col("c").cast("long").alias("_c"), F.col(h).alias("_h"))
    return p.join(d, ["_r", "_c"]).groupBy(*points.columns).agg((F.sum(F.col("_w") * F.col("_h")) / F.sum("_w")).alias(h))


def dem_nearest(points: DataFrame, dem: DataFrame, row: str, col: str, h: str) -> DataFrame:
    """The height of the pixel (r, c) that a fractional place rounds to, halves up; null outside the raster."""
    near = lambda x: F.floor(F.col(x) + 0.5).cast("long")
    d = dem.select(F.col("r").cast("long").alias("_r"), F.col("c").cast("long").alias("_c"), F.col(h).alias(h))
    return points.withColumn("_r", near(row)).withColumn("_c", near(col)).join(d, ["_r", "_c"], "left").drop("_r", "_c")


def buckets(points: DataFrame, x: str, y: str, size: float, keys: list[str] = ()) -> DataFrame:
    """Adds the cell (ci, cj) of each point, counted from the smallest coordinates."""
    low = points.agg(F.min(x).alias("_x0"), F.min(y).alias("_y0"))
    return points.join(F.broadcast(low)).withColumn("ci", F.floor((F.col(x) - F.col("_x0")) / size)).withColumn("cj", F.floor((F.col(y) - F.col("_y0")) / size)).drop("_x0", "_y0")


def halo(cells: DataFrame, radius: int) -> DataFrame:
    """Each row once for every cell within ``radius`` of its own, as (hi, hj), and whether that is its own."""
    steps = F.array(*(F.lit(i) for i in range(-radius, radius + 1)))
    return cells.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps)).withColumn("hi", F.col("ci") + F.col("_i")).withColumn("hj", F.col("cj") + F.col("_j")).withColumn("own", (F.col("_i") == 0) & (F.col("_j") == 0)).drop("_i", "_j")


def grid_step(points: DataFrame, value: str, keys: list[str] = ()) -> DataFrame:
    """The commonest rounded gap between neighbouring distinct coordinates, the smallest of equally common ones."""
    u = points.select(*keys, F.expr(f"rint({value} * 1000) / 1000").alias("_v")).distinct()
    gaps = scan_by_ranges(u, list(keys), ["_v"], before={"_v": "_b"}).withColumn("_g", F.col("_v") - F.col("_b"))
    n = gaps.filter("_g > 1e-3").withColumn("step", F.rint("_g").cast("long")).filter("step > 0").groupBy(*keys, "step").agg(F.count(F.lit(1)).alias("_n"))
    best = n.groupBy(*keys).agg(F.max(F.struct("_n", (-F.col("step")).alias("s"))).alias("_b"))
    return best.filter("_b IS NOT NULL").select(*keys, (-F.col("_b.s")).alias("step"))


def balance_columns(pixels: DataFrame, value: str, col: str, keys: list[str]) -> DataFrame:
    """Values less their column's mean plus their tile's; means come from one aggregate by column."""
    by_col = pixels.groupBy(*keys, col).agg(F.sum(value).alias("_s"), F.count(F.lit(1)).alias("_n"))
    by_tile = by_col.groupBy(*keys).agg((F.sum("_s") / F.sum("_n")).alias("_m"))
    d = pixels.join(by_col, [*keys, col]).join(by_tile, keys)
    return d.withColumn(value, F.col(value) - F.col("_s") / F.col("_n") + F.col("_m")).select(*pixels.columns)


def stretch(pixels: DataFrame, value: str, keys: list[str], low: float = 0.003, high: float = 0.997) -> DataFrame:
    """Values between two quantiles of their tile spread over 0 to 255, others cut off."""
    q = exact_quantiles(pixels, keys, value, [low, high], "_q")
    d = pixels.join(q, keys)
    x = (F.col(value) - F.col("_q")[0]) / F.nullif(F.col("_q")[1] - F.col("_q")[0], F.lit(0.0)) * 255.0
    return d.withColumn(value, F.greatest(F.lit(0.0), F.least(F.lit(255.0), x))).select(*pixels.columns)
