"""Matching strategies: compositions of the joins, fits, filters and patch kernels, driven level by level.

Images are tables of tiles: (seq, level, ccd, rows, cols, samples array<float>), one row per tile. Point tables
have seq, level, ccd, pid, row, col. Only affine parameters, a row per tile pair, pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patch as Z
from . import fit, joins, neighbours, robust
from .joins import held
from .upsert import first_by, upsert_by_score

C = F.col


#: Points that travel to an image as one list, about.
LIST = 2000


def listed(points: DataFrame, keys: list[str], columns: list[str], spread: list[str]) -> DataFrame:
    """Points as lists ``pts`` of about LIST each: keys of many points get several, so no row grows with the data."""
    slices = points.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / LIST).cast("int").alias("_of"))
    dealt = points.join(slices, keys).withColumn("_s", F.pmod(F.xxhash64(*spread), C("_of")))
    return dealt.groupBy(*keys, "_s").agg(F.collect_list(F.struct(*columns)).alias("pts")).drop("_s")


def downsample(tiles: DataFrame, k: int = 2) -> DataFrame:
    """The next pyramid level: block means cut to whole numbers, tile by tile in an Arrow kernel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                h, w = r.rows // k, r.cols // k
                a = np.asarray(r.samples, np.float64).reshape(r.rows, r.cols)[: h * k, : w * k].reshape(h, k, w, k).mean(axis=(1, 3))
                out.append((r.seq, r.level + 1, r.ccd, h, w, np.floor(a).astype(np.float32).ravel()))
            yield pd.DataFrame(out, columns=["seq", "level", "ccd", "rows", "cols", "samples"])

    return tiles.select("seq", "level", "ccd", "rows", "cols", "samples").mapInPandas(run, tiles.select("seq", "level", "ccd", "rows", "cols", "samples").schema)


def detect_corners(tiles: DataFrame, cell: int = 8, border: int = 4, least: float = 0.0) -> DataFrame:
    """The strongest corner of each cell of each tile: seq, level, ccd, row, col, response."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(r.seq, r.level, r.ccd, *c) for r in pdf.itertuples() for c in Z.corners(np.asarray(r.samples, np.float64).reshape(r.rows, r.cols), cell, border, least)]
            yield pd.DataFrame(out, columns=["seq", "level", "ccd", "row", "col", "response"])

    return tiles.mapInPandas(run, "seq string, level int, ccd int, row int, col int, response double")


def with_patches(points: DataFrame, tiles: DataFrame, half: int) -> DataFrame:
    """Adds the (2 half + 1)^2 samples about each point; points too near the border are dropped. Points of a
    tile travel to its image as one list, so an image is copied once and not once a point."""
    side = 2 * half + 1
    extra = [c for c in points.columns if c not in ("seq", "level", "ccd")]
    packed = listed(points, ["seq", "level", "ccd"], extra, ["row", "col"])
    cut = lambda p: F.flatten(F.transform(F.sequence(F.lit(-half), F.lit(half)), lambda i: F.slice("samples", ((p["row"] + i) * C("cols") + p["col"] - half + 1).cast("int"), side)))
    inside = lambda p: (p["row"] >= half) & (p["col"] >= half) & (p["row"] < C("rows") - half) & (p["col"] < C("cols") - half)
    both = packed.join(tiles, ["seq", "level", "ccd"])
    out = both.select("seq", "level", "ccd", F.explode(F.transform(F.filter("pts", inside), lambda p: F.struct(p.alias("p"), cut(p).alias("patch")))).alias("x"))
    return out.select("seq", "level", "ccd", "x.p.*", "x.patch")


def score_pairs(pairs: DataFrame, a: str = "lpatch", b: str = "rpatch", side: int = 9, blend: bool = True) -> DataFrame:
    """Adds score: gray and gradient correlation blended, or gray alone."""
    gray = Z.zncc(C(a), C(b))
    if not blend:
        return pairs.withColumn("score", gray)
    g = pairs.withColumns({"_ga": Z.gradient_patch(C(a), side), "_gb": Z.gradient_patch(C(b), side)})
    return g.withColumn("score", Z.score_blend(gray, Z.zncc(C("_ga"), C("_gb")))).drop("_ga", "_gb")


#: Patches of a side that one task of an exhaustive comparison holds, about.
SIDE = 2000


def best_by_patch(left: DataFrame, right: DataFrame, keys: list[str], least: float, but_itself: bool = False) -> DataFrame:
    """The right patch (rid, rpatch) that correlates best with each left one (pid, lpatch) of equal keys: keys, pid, rid, score (nine
    digits) from ``least`` on; of equal scores the smallest rid, with ``but_itself`` none of the point's own number.

    All pairs are compared, as products of normalised patches: a key's sides are cut into blocks of about SIDE, and a
    task takes two of them, so its memory is bounded; what moves grows with the number of blocks.
    """
    kinds = {f.name: f.dataType.simpleString() for f in [*left.schema.fields, *right.schema.fields]}
    cut = lambda d, n: d.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / SIDE).cast("int").alias(n))
    blocks = held(cut(left, "_ls").join(cut(right, "_rs"), keys))
    own = lambda d, n, of: d.withColumn(of, F.pmod(F.xxhash64(n), C(of + "s")).cast("int"))
    every = lambda of: F.explode(F.sequence(F.lit(0), C(of + "s") - 1)).alias(of)
    l = own(left.join(blocks, keys), "pid", "_l").select(*keys, "pid", "lpatch", "_l", every("_r"))
    r = own(right.join(blocks, keys), "rid", "_r").select(*(C(k).alias(k) for k in keys), "rid", "rpatch", "_r", every("_l"))

    def normal(v: pd.Series) -> np.ndarray:
        a = np.stack(v.to_numpy()).astype(np.float64)
        a = a - a.mean(axis=1, keepdims=True)
        return a / np.sqrt(np.maximum((a * a).sum(axis=1, keepdims=True), Z.FLOOR))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame(columns=[*keys, "pid", "rid", "score"])
        b = b.sort_values("rid")
        s = np.round(normal(a["lpatch"]) @ normal(b["rpatch"]).T, 9)
        if but_itself:
            s[a["pid"].to_numpy()[:, None] == b["rid"].to_numpy()[None]] = -np.inf
        k = s.argmax(axis=1)
        out = a[keys].assign(pid=a["pid"], rid=b["rid"].to_numpy()[k], score=s[np.arange(len(a)), k])
        return out[out["score"] >= least]

    schema = ", ".join(f"{k} {kinds[k]}" for k in [*keys, "pid", "rid"]) + ", score double"
    hits = l.groupBy(*keys, "_l", "_r").cogroup(r.groupBy(*keys, "_l", "_r")).applyInPandas(run, schema)
    return first_by(hits, ["pid"], [F.desc("score"), "rid"])


def match_exhaustively(left: DataFrame, right: DataFrame, keys: list[str], least: float) -> DataFrame:
    """The best right point of every left one within a tile pair; for the coarsest level, whose tiles are small."""
    best = best_by_patch(left.select(*keys, "pid", "lpatch"), right.select(*keys, "rid", "rpatch"), keys, least)
    return best.join(left, [*keys, "pid"]).join(right, [*keys, "rid"])


def match_in_band(left: DataFrame, right: DataFrame, keys: list[str], reach: float, least: float, score: str | None = None) -> DataFrame:
    """The best right point within 2 reach by reach of the prediction (pr, pc) of each left one. ``score`` names a column
    that holds it; without, patches are compared."""
    pairs = joins.band_join(left, right, ("pr", "pc"), ("rrow", "rcol"), 2.0 * reach, reach, keys)
    return joins.argmax_pairs(pairs.withColumn("score", C(score)) if score else score_pairs(pairs, blend=False), ["pid"], "score", least, ["rid"])


def predict_points(points: DataFrame, affines: DataFrame, keys: list[str], scale: float = 1.0) -> DataFrame:
    """Adds pr, pc by each group's affine, its translations scaled to another level."""
    p = points.join(affines.select(*keys, *fit.AFFINE), keys)
    return p.withColumn("pr", C("f0") * C("row") + C("f1") * C("col") + C("f2") * scale).withColumn("pc", C("f3") * C("row") + C("f4") * C("col") + C("f5") * scale).drop(*fit.AFFINE)


def pyramid_match(features: dict[int, tuple[DataFrame, DataFrame]], keys: list[str], snapshot, reach: float = 8.0, least: float = 0.6, sigma: float = 4.0, trials: int = fit.FIRST, tile: tuple[float, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """Matches from the coarsest level to the finest: argmax joins, one affine per group fitted and carried down, and with ``tile`` (a
    size at the finest level) a field of local ones that guides the search where it agrees with the affine.

    ``features`` maps level to (left, right) with keys, pid/rid, row/col or rrow/rcol and patches lpatch/rpatch.
    ``snapshot(df, name)`` writes and rereads a table, which cuts lineage between levels. Returns the matches
    of the finest level inside the gate, and the affines.
    """
    affines, found, before, local = None, None, None, None
    for level in sorted(features, reverse=True):
        left, right = features[level]
        if affines is None:
            hits = match_exhaustively(left, right, keys, least)
        else:
            scale = 2.0 ** (before - level)
            if local is None:
                placed = predict_points(left, affines, keys, scale)
            else:
                placed = predict_by_field(left, local, affines, tile[0] / 2**before, tile[1] / 2**before, reach, keys, scale).drop("local")
            hits = match_in_band(placed, right, keys, reach, least)
        named = hits.select(*keys, "pid", "row", "col", "rid", C("rrow").alias("mrow"), C("rcol").alias("mcol"), "score")
        found = snapshot(named, f"match{level}")
        pairs = found.select(*keys, "row", "col", "mrow", "mcol")
        affines = snapshot(fit.affine_ransac(pairs, keys, sigma, trials), f"affine{level}")
        if tile:
            local = snapshot(fit.local_affine_field(pairs, tile[0] / 2**level, tile[1] / 2**level, sigma, trials, keys=keys).filter("valid"), f"field{level}")
        before = level
    f = [C(x) for x in fit.AFFINE]
    kept = found.join(affines.select(*keys, *fit.AFFINE), keys)
    vx, vy = robust.affine_residual(C("row"), C("col"), C("mrow"), C("mcol"), f)
    return kept.filter(robust.rescue_gate(F.sqrt(vx * vx + vy * vy), C("score"), sigma, 0.9)).drop(*fit.AFFINE), affines


def densify(cells: DataFrame, seeds: DataFrame, keys: list[str], k: int = 8, start: float = 64.0) -> DataFrame:
    """Predicted places of grid centres from their k nearest seeds, weighted by inverse squares; at least three."""
    s = seeds.select(*keys, C("pid").alias("sid"), C("row").alias("srow"), C("col").alias("scol"), (C("mrow") - C("row")).alias("dr"), (C("mcol") - C("col")).alias("dc"))
    near = joins.knn_join(cells, s, ("centre_row", "centre_col"), ("srow", "scol"), k, [*keys, "centre_row", "centre_col"], ["d2", "sid"], keys, start)
    w = 1.0 / (C("d2") + 1.0)
    g = near.groupBy(*keys, "centre_row", "centre_col").agg(F.count(F.lit(1)).alias("seeds"), robust.weighted_mean(C("dr"), w).alias("dr"), robust.weighted_mean(C("dc"), w).alias("dc"))
    return g.filter("seeds >= 3").select(*keys, "centre_row", "centre_col", "seeds", (C("centre_row") + C("dr")).alias("pr"), (C("centre_col") + C("dc")).alias("pc"))


def grid_predictions(cells: DataFrame, seeds: DataFrame, affines: DataFrame, keys: list[str], radius: float = 500.0) -> DataFrame:
    """Semi-dense prediction: a quadratic surface of six seeds or more, the weighted mean of four or five, else
    the affine. Adds pr, pc, mode (surface, mean, affine)."""
    s = seeds.select(*keys, C("row").alias("srow"), C("col").alias("scol"), (C("mrow") - C("row")).alias("dr"), (C("mcol") - C("col")).alias("dc"))
    s = s.withColumn("sid", F.lit(0))  # seeds are no cells, so none is left out
    sums = neighbours.radius_surface_sums(cells, s, ("row", "col"), ("srow", "scol"), radius, ("pid", "sid"), ["dr", "dc"], neighbours.gaussian(radius * radius / 2), keys)
    p = predict_points(cells, affines, keys).join(fit.surfaces_of(sums, ["pid"], ["sr", "sc"]), "pid", "left")
    mode = F.when(C("n") >= 6, "surface").when(C("n") >= 4, "mean").otherwise("affine")
    use = C("n") >= 4
    return p.withColumn("mode", mode).withColumn("pr", F.when(use, C("row") + C("sr")).otherwise(C("pr"))).withColumn("pc", F.when(use, C("col") + C("sc")).otherwise(C("pc"))).drop("n", "sr", "sc")


def search_in_tiles(points: DataFrame, left: DataFrame, right: DataFrame, how: Z.Search, least: float, joint: DataFrame | None = None) -> DataFrame:
    """Looks for points (lccd, rccd, pid, row, col) near their predicted places (pr, pc) in the right tiles, as ``how``
    says. Returns pid, rccd, mrow, mcol, score of those that reach ``least``.

    Optional columns: reach_r, reach_c (a reach of each point's own) and ar, ac (the place by the affine, for the
    gate). Points travel to their images as lists of bounded length. ``joint`` (lccd, rccd, joint: counts of pairs of whole
    sample values) gives the tables of mutual information that ``how`` may weigh.
    """
    own = [c for c in ("reach_r", "reach_c", "ar", "ac") if c in points.columns]
    img = lambda t, p: t.select(C("ccd").alias(f"{p}ccd"), C("rows").alias(f"{p}rows"), C("cols").alias(f"{p}cols"), C("samples").alias(f"{p}img"))
    work = listed(points, ["lccd", "rccd"], ["pid", "row", "col", "pr", "pc", *own], ["pid"]).join(img(left, "l"), "lccd").join(img(right, "r"), "rccd")
    told = joint is not None
    if told:
        work = work.join(joint.select("lccd", "rccd", "joint"), ["lccd", "rccd"], "left")
    kind = points.schema["pid"].dataType.simpleString()
    nearest = lambda x: np.floor(x + 0.5).astype(np.int64)

    def lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Where each row's list begins and ends, and all lists in one; a null is as an empty list."""
        return np.r_[0, np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))], column.flatten()

    def found(pair: Z.Pair, pts: dict) -> np.ndarray:
        """Row, column and score of each point; no number where there is none."""
        r, c, pr, pc = (nearest(pts[x]) for x in ("row", "col", "pr", "pc"))
        affine = (pts["ar"], pts["ac"]) if "ar" in own else None
        if how.at_once() and "reach_r" not in own:
            return np.stack(how.find_all(pair, r, c, pr, pc, affine), axis=1)
        hits = (how.find(pair, int(r[k]), int(c[k]), int(pr[k]), int(pc[k]), (int(pts["reach_r"][k]), int(pts["reach_c"][k])) if "reach_r" in own else None, affine and (affine[0][k], affine[1][k])) for k in range(len(r)))
        return np.array([h or (np.nan, np.nan, -np.inf) for h in hits], float).reshape(-1, 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (at, points_), (li, left_), (ri, right_) = (lists(batch.column(c)) for c in ("pts", "limg", "rimg"))
            pts = {c: points_.field(c).to_numpy(zero_copy_only=False) for c in ("row", "col", "pr", "pc", *own)}
            left_, right_ = left_.to_numpy(zero_copy_only=False), right_.to_numpy(zero_copy_only=False)
            shape = {c: batch.column(c).to_numpy() for c in ("lrows", "lcols", "rrows", "rcols")}
            if told:
                ji, joints = lists(batch.column("joint"))
                counts, there = [joints.field(c).to_numpy().astype(np.int64) for c in ("a", "b", "n")], batch.column("joint").is_valid().to_numpy(zero_copy_only=False)
            out, kept = [], []
            for w in range(batch.num_rows):
                table = Z.MutualInformation(*(x[ji[w] : ji[w + 1]] for x in counts)) if told and there[w] else None
                pair = Z.Pair(left_[li[w] : li[w + 1]].reshape(shape["lrows"][w], shape["lcols"][w]), right_[ri[w] : ri[w + 1]].reshape(shape["rrows"][w], shape["rcols"][w]), how.kind, table)
                hits = found(pair, {c: x[at[w] : at[w + 1]] for c, x in pts.items()})
                fine = np.flatnonzero(np.isfinite(hits[:, 2]) & (hits[:, 2] >= least))
                out.append(hits[fine])
                kept.append(fine + at[w])
            hits, kept = np.concatenate([*out, np.zeros((0, 3))]), np.concatenate([*kept, np.zeros(0, np.int64)])
            rccd = np.repeat(batch.column("rccd").to_numpy(), np.array([len(x) for x in out], np.int64))
            yield pa.RecordBatch.from_pydict({"pid": points_.field("pid").take(pa.array(kept)), "rccd": pa.array(rccd, pa.int32()), **{c: pa.array(hits[:, k]) for k, c in enumerate(("mrow", "mcol", "score"))}})

    return work.mapInArrow(run, f"pid {kind}, rccd int, mrow double, mcol double, score double")


def predict_by_field(points: DataFrame, field: DataFrame, whole, tile_r: float, tile_c: float, reach: float, keys: list[str] = (), scale: float = 1.0) -> DataFrame:
    """Adds pr, pc by the affine of a point's tile (``field``: keys, tile_r, tile_c, f0..f5 of the valid ones); where there is none,
    or it is more than 4 reach off the affine ``whole`` (six numbers, or a table by keys) in either coordinate, by the
    latter. ``local`` says which. Tiles and translations grow by ``scale``, as from one level to a finer one."""
    keys = list(keys)
    tiled = points.withColumns({"tile_r": F.floor(C("row") / (tile_r * scale)), "tile_c": F.floor(C("col") / (tile_c * scale))})
    d = tiled.join(field.select(*keys, "tile_r", "tile_c", *(C(f).alias(f"_l{f}") for f in fit.AFFINE)), [*keys, "tile_r", "tile_c"], "left")
    if isinstance(whole, DataFrame):
        d = d.join(whole.select(*keys, *(C(f).alias(f"_g{f}") for f in fit.AFFINE)), keys)
        g = [C(f"_g{f}") for f in fit.AFFINE]
    else:
        g = [F.lit(float(x)) for x in whole]
    place = lambda f: (f[0] * C("row") + f[1] * C("col") + f[2] * scale, f[3] * C("row") + f[4] * C("col") + f[5] * scale)
    (gr, gc), (lr, lc) = place(g), place([C(f"_l{f}") for f in fit.AFFINE])
    near = F.coalesce((F.abs(lr - gr) <= 4 * reach) & (F.abs(lc - gc) <= 4 * reach), F.lit(False))
    out = d.withColumn("local", near).withColumns({"pr": F.when(C("local"), lr).otherwise(gr), "pc": F.when(C("local"), lc).otherwise(gc)})
    return out.drop("tile_r", "tile_c", *(f"_{s}{f}" for s in "lg" for f in fit.AFFINE))


def match_by_field(left: DataFrame, right: DataFrame, keys: list[str], field: DataFrame, whole: list[float], tile_r: float, tile_c: float, reach: float, least: float, score: str | None = None) -> DataFrame:
    """The best right point in the band about each left one's place by the local field. ``score`` names a column that
    holds it; without, patches are compared."""
    return match_in_band(predict_by_field(left, field, whole, tile_r, tile_c, reach), right, keys, reach, least, score)


def local_disparity(points: DataFrame, controls: DataFrame, radius: float, least: int = 5, most: int = 24, floor: float = 8.0) -> DataFrame:
    """Mean and deviation of the disparities of the controls (row, col, mrow, mcol) near each point: those within the radius,
    at least the ``least`` nearest, ``most`` at most, weighted by a Gaussian of half the radius. Returns pid, n, dr, dc, sr, sc of points
    with three or more; deviations count as ``floor`` at least. Without any control no point has them."""
    s = controls.select(C("row").alias("srow"), C("col").alias("scol"), (C("mrow") - C("row")).alias("vr"), (C("mcol") - C("col")).alias("vc"))
    order = ["d2", "vr", "vc"]  # controls that are equal in all of these are equal in all that counts
    nearest = joins.knn_join(points.select("pid", "row", "col"), s, ("row", "col"), ("srow", "scol"), most, ["pid"], order).drop("rk")
    near = joins.adaptive_neighbours(nearest, ["pid"], radius, least, most, order).withColumn("w", F.greatest(F.exp(-C("d2") / (radius * radius / 2)), F.lit(1e-6)))
    mean = near.groupBy("pid").agg(F.count(F.lit(1)).alias("n"), robust.weighted_mean(C("vr"), C("w")).alias("dr"), robust.weighted_mean(C("vc"), C("w")).alias("dc"), F.sum("w").alias("_w")).filter("n >= 3")
    spread = lambda v, m, out: F.greatest(F.sqrt(F.greatest(F.sum(C("w") * (C(v) - C(m)) * (C(v) - C(m))) / F.max("_w"), F.lit(1.0))), F.lit(floor)).alias(out)
    d = near.join(mean, "pid")
    return d.groupBy("pid").agg(F.max("n").alias("n"), F.max("dr").alias("dr"), F.max("dc").alias("dc"), spread("vr", "dr", "sr"), spread("vc", "dc", "sc"))


def cross_strip_places(points: DataFrame, controls: DataFrame, whole: list[float], reach: int, radius: float, most: int = 30, blind: int = 96) -> DataFrame:
    """Where points (pid, row, col in mosaic coordinates) are looked for in the other mosaic: pr, pc, reach_r, reach_c. Near
    controls by their mean disparity and three deviations (``most`` at most, ``reach`` at least), else by the affine and ``blind``."""
    d = points.join(local_disparity(points, controls, radius).select("pid", "dr", "dc", "sr", "sc"), "pid", "left")
    known, f = C("dr").isNotNull(), [F.lit(float(x)) for x in whole]
    place = lambda a, b, c: a * C("row") + b * C("col") + c
    far = lambda s: F.when(known, F.greatest(F.lit(reach), F.least(F.lit(most), F.floor(3.0 * s + 0.5)))).otherwise(max(reach, blind)).cast("int")
    return d.withColumns({
        "ar": place(*f[:3]), "ac": place(*f[3:]), "pr": F.when(known, C("row") + C("dr")).otherwise(place(*f[:3])), "pc": F.when(known, C("col") + C("dc")).otherwise(place(*f[3:])),
        "reach_r": far(C("sr")), "reach_c": far(C("sc")),
    }).drop("dr", "dc", "sr", "sc")


def in_two_phases(places: DataFrame, mosaic: DataFrame, find, least: float, wide: int = 160) -> DataFrame:
    """The best hit of each place: first in its candidate tiles; for places without a hit of ``least``, in all tiles around the
    affine's place with a reach of ``wide`` at least. ``find(places with tile)`` returns pid, tile, score and more."""
    best = lambda hits: first_by(hits, ["pid"], [F.desc("score"), "tile"])
    places = held(places)
    tried = held(best(find(joins.candidate_tiles(places, mosaic, "pr", "pc", C("reach_r"), C("reach_c")))))
    good = tried.filter(C("score") >= least)
    rest = places.join(good.select("pid"), "pid", "left_anti").withColumns({"pr": C("ar"), "pc": C("ac"), "reach_r": F.greatest("reach_r", F.lit(wide)), "reach_c": F.greatest("reach_c", F.lit(wide))})
    valid = mosaic.filter("r1 > r0 AND c1 > c0").agg(F.sort_array(F.collect_list("ccd")).alias("_t"))  # one row: a sensor's tiles
    again = rest.join(F.broadcast(valid)).withColumn("tile", F.explode("_t")).drop("_t").withColumn("tier", F.lit(4))
    poor = tried.filter(C("score") < least).join(rest.select("pid"), "pid", "left_semi")
    second = best(find(again).unionByName(poor)).filter(C("score") >= least)
    return good.withColumn("retried", F.lit(False)).unionByName(second.withColumn("retried", F.lit(True)))


def cross_strip_match(points: DataFrame, controls: DataFrame, source: DataFrame, target: DataFrame, whole: list[float], left: DataFrame, right: DataFrame, how: Z.Search, least: float, radius: float = 500.0, wide: int = 160) -> DataFrame:
    """Matches points (pid, ccd, row, col and the old rccd, mrow, mcol, score, null without) of one strip's tiles in the other
    strip: places in mosaic coordinates, two phases, and an upsert in which an old match of an equal score stays."""
    moved = joins.tile_lookup(points, source, "ccd", "s").select("pid", C("ccd").alias("lccd"), C("row").alias("lrow"), C("col").alias("lcol"), (C("row") + C("s_r0")).alias("row"), (C("col") + C("s_c0")).alias("col"))
    places = cross_strip_places(moved, controls, whole, how.reach, radius)

    def find(d: DataFrame) -> DataFrame:
        t = joins.tile_lookup(d, target, "tile", "t")
        asked = t.select("pid", "lccd", C("tile").alias("rccd"), C("lrow").alias("row"), C("lcol").alias("col"), (C("pr") - C("t_r0")).alias("pr"), (C("pc") - C("t_c0")).alias("pc"), "reach_r", "reach_c")
        return search_in_tiles(asked, left, right, how, -2.0).select("pid", C("rccd").alias("tile"), "mrow", "mcol", "score")

    hits = in_two_phases(places, target, find, least, wide).select("pid", C("tile").alias("rccd"), "mrow", "mcol", "score")
    return upsert_by_score(points, hits, ["pid"], ["rccd", "mrow", "mcol", "score"], "score", "rccd")


def within_strip(tiles: DataFrame, how: Z.Search, least: float, overlap: int = 48, step: tuple[int, int] = (48, 16)) -> DataFrame:
    """Links of each tile with the next of its strip: grid places in the last ``overlap`` columns, looked for at the same place of
    the overlap there. Returns ccd_l, row, col, ccd_r, mrow, mcol, score."""
    r, c = step
    rows = F.transform(F.sequence(F.lit(1), F.floor(C("rows") / r)), lambda i: ((i - 1) * r + r // 2).cast("int"))
    cols = F.filter(F.transform(F.sequence(F.lit(1), F.lit(overlap // c)), lambda j: ((j - 1) * c + c // 2 + C("cols") - overlap).cast("int")), lambda x: x >= 0)
    there = tiles.select(C("ccd").alias("_next")).distinct()
    grid = tiles.filter(C("rows") >= r).select(C("ccd").alias("lccd"), (C("ccd") + 1).alias("rccd"), "cols", F.explode(rows).alias("row"), cols.alias("_c"))
    points = grid.join(there, C("rccd") == C("_next")).select("lccd", "rccd", F.explode("_c").alias("col"), "row", "cols")
    points = points.withColumns({"pr": C("row").cast("double"), "pc": (C("col") - C("cols") + overlap).cast("double"), "pid": (C("lccd").cast("long") * (1 << 40)) + C("row") * (1 << 16) + C("col")})
    hits = search_in_tiles(points, tiles, tiles, how, least).drop("rccd")
    return points.select("pid", C("lccd").alias("ccd_l"), "row", "col", C("rccd").alias("ccd_r")).join(hits, "pid").drop("pid")


def refine_iteratively(matches: DataFrame, keys: list[str], rounds: int, snapshot, radius: float = 500.0, k: float = 3.0) -> DataFrame:
    """Alternates affine gate and neighbourhood filter; each round's table is a snapshot."""
    now = matches
    for i in range(rounds):
        f = fit.affine_ransac(now.select(*keys, "row", "col", "mrow", "mcol"), keys, 150.0, 300)
        d = now.join(f.select(*keys, *fit.AFFINE), keys)
        vx, vy = robust.affine_residual(C("row"), C("col"), C("mrow"), C("mcol"), [C(x) for x in fit.AFFINE])
        d = d.filter(robust.affine_gate(vx, vy, 500.0, 150.0, 250.0)).drop(*fit.AFFINE).withColumns({"_dr": C("mrow") - C("row"), "_dc": C("mcol") - C("col")})
        s = d.select(*keys, C("pid").alias("sid"), C("row").alias("srow"), C("col").alias("scol"), C("_dr").alias("ndr"), C("_dc").alias("ndc"))
        n = neighbours.radius_moments(d, s, ("row", "col"), ("srow", "scol"), radius, ("pid", "sid"), ["ndr", "ndc"], keys)
        now = snapshot(robust.moments_filter(d, n, "pid", [("_dr", "ndr"), ("_dc", "ndc")], k, isolated=False).drop("_dr", "_dc"), f"refine{i}")
    return now


def global_affine(matches: DataFrame, mosaic: DataFrame, sigma: float = 150.0, trials: int = fit.FIRST) -> DataFrame:
    """One affine for a pair of mosaics from the matches of all tiles, in whole mosaic coordinates."""
    m = joins.tile_lookup(joins.tile_lookup(matches, mosaic, "ccd", "l"), mosaic, "img_id", "r")
    cut = lambda x: x.cast("long").cast("double")
    on = m.select(F.lit(0).alias("g"), (cut(C("row")) + C("l_r0")).alias("row"), (cut(C("col")) + C("l_c0")).alias("col"), (cut(C("mrow")) + C("r_r0")).alias("mrow"), (cut(C("mcol")) + C("r_c0")).alias("mcol"))
    return fit.affine_ransac(on, ["g"], sigma, trials).drop("g")


def register_overlaps(tiles: DataFrame, overlap: int, rows: int, cols: int, half: int = 2, step: int = 16) -> DataFrame:
    """The shift of each tile against the next of its strip, from the last ``overlap`` columns of one and the first of the other:
    ccd, dr, dc, score. A task compares one pair of tiles."""
    right = tiles.select((C("ccd") - 1).alias("ccd"), C("rows").alias("rrows"), C("cols").alias("rcols"), C("samples").alias("rsamples"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            shape = lambda v, r, c: np.asarray(v, np.float64).reshape(r, c)
            out = [(w.ccd, *Z.register(shape(w.samples, w.rows, w.cols)[:, -overlap:], shape(w.rsamples, w.rrows, w.rcols)[:, :overlap], rows, cols, half, step)) for w in pdf.itertuples()]
            yield pd.DataFrame(out, columns=["ccd", "dr", "dc", "score"])

    return tiles.select("ccd", "rows", "cols", "samples").join(right, "ccd").mapInPandas(run, "ccd int, dr int, dc int, score double")


def reliable_prediction(points: DataFrame, pairs: DataFrame, expected: float, far: float = 40.0, share: float = 0.75) -> DataFrame:
    """The predicted row of points (pid, row) from their neighbours' disparities: pid, pr, rejected.

    ``pairs`` has pid, sid, d2 and dr. The weighted mean (inverse squares) is used unless it is off the expected disparity by more than
    ``far`` and the weighted median by less than ``share`` of that; then the median is, and the mean counts as rejected. Points without neighbours
    get no prediction.
    """
    w = pairs.withColumn("_w", 1.0 / (C("d2") + 1.0))
    mean = w.groupBy("pid").agg(robust.weighted_mean(C("dr"), C("_w")).alias("_mean"))
    both = robust.weighted_median(w, ["pid"], "dr", "_w", ["sid"], "_med", small=True).join(mean, "pid")
    off = lambda c: F.abs(C(c) - expected)
    d = points.join(both, "pid").withColumn("rejected", (off("_mean") > far) & (off("_med") < off("_mean") * share))
    whole = lambda x: F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x))
    return d.select("pid", (whole(C("row")) + whole(F.when(C("rejected"), C("_med")).otherwise(C("_mean")) + 0.5) + 0.0).alias("pr"), "rejected")


def rematch_features(points: DataFrame, seeds: DataFrame, right: DataFrame, affines: DataFrame, keys: list[str], radius: float = 500.0, near: float = 64.0, far: float = 128.0, seed_min: int = 3, least: float = 0.6, score: str | None = None) -> DataFrame:
    """Unmatched features again: three seeds or more around predict by their weighted mean and a narrow band,
    fewer leave the affine and a wide one. Hits are upserted by score."""
    s = seeds.select(*keys, C("row").alias("srow"), C("col").alias("scol"), (C("mrow") - C("row")).alias("dr"), (C("mcol") - C("col")).alias("dc"))
    g = neighbours.radius_weighted(points, s.withColumn("sid", F.lit(0)), ("row", "col"), ("srow", "scol"), radius, ("pid", "sid"), ["dr", "dc"], neighbours.inverse_square, keys, apart=False)
    g = g.select("pid", C("n").alias("_n"), C("w_dr").alias("_dr"), C("w_dc").alias("_dc"))
    p = predict_points(points, affines, keys).join(g, "pid", "left")
    local = F.coalesce(C("_n") >= seed_min, F.lit(False))
    close = p.filter(local).withColumn("pr", C("row") + C("_dr")).withColumn("pc", C("col") + C("_dc"))
    wide = p.filter(~local)
    hits = match_in_band(close.drop("_n", "_dr", "_dc"), right, keys, near, least, score).unionByName(match_in_band(wide.drop("_n", "_dr", "_dc"), right, keys, far, least, score))
    return first_by(hits, ["pid"], [F.desc("score"), "rid"])


def inter_tile_ties(left_links: DataFrame, cross: DataFrame, right_links: DataFrame) -> DataFrame:
    """Tie points over tile seams: a link inside the left strip whose ends both match across, and whose images
    are linked inside the right strip (equal places after rounding to whole pixels)."""

    side = lambda p: cross.select(C("ccd").alias(f"{p}ccd"), F.rint("row").alias(f"{p}r"), F.rint("col").alias(f"{p}c"), C("img_id").alias(f"{p}img"), F.rint("mrow").alias(f"{p}mr"), F.rint("mcol").alias(f"{p}mc"))
    l = left_links.select(C("ccd_l").alias("accd"), F.rint("row").alias("ar"), F.rint("col").alias("ac"), C("ccd_r").alias("bccd"), F.rint("mrow").alias("br"), F.rint("mcol").alias("bc"))
    r = right_links.select(C("ccd_l").alias("aimg"), F.rint("row").alias("amr"), F.rint("col").alias("amc"), C("ccd_r").alias("bimg"), F.rint("mrow").alias("bmr"), F.rint("mcol").alias("bmc"))
    return l.join(side("a"), ["accd", "ar", "ac"]).join(side("b"), ["bccd", "br", "bc"]).join(r, ["aimg", "amr", "amc", "bimg", "bmr", "bmc"])


def semi_dense(cells: DataFrame, left: DataFrame, right: DataFrame, keys: list[str], how: Z.Search = Z.Search(smooth=0.1, gate=128.0), least: float = 0.5) -> DataFrame:
    """Grid points matched around their predictions (pr, pc; the affine's place ar, ac for the gate) under an energy of score
    and distance, and upserted over all right tiles."""
    hits = search_in_tiles(cells, left, right, how, least)
    base = cells.select(*keys, "pid", "row", "col").dropDuplicates(["pid"]).select("*", F.lit(None).cast("int").alias("rccd"), *(F.lit(None).cast("double").alias(c) for c in ("mrow", "mcol", "score")))
    return upsert_by_score(base, hits, ["pid"], ["rccd", "mrow", "mcol", "score"], "score", "rccd")


def refine_globally(matches: DataFrame, left: DataFrame, right: DataFrame, reach: int = 2, half: int = 9, smooth: float = 0.0) -> DataFrame:
    """Sub-pixel places of matches (pid, lccd, rccd, row, col, mrow, mcol): the centroid of all places within reach under
    weights exp(-3 energy), without a gate. What has no window keeps its place."""
    asked = matches.select("pid", "lccd", "rccd", "row", "col", C("mrow").alias("pr"), C("mcol").alias("pc"))
    hits = search_in_tiles(asked, left, right, Z.Search(reach, half, 1, smooth=smooth, blur=3.0), -2.0)
    better = hits.select("pid", C("mrow").alias("_r"), C("mcol").alias("_c"), C("score").alias("_s"))
    d = matches.join(better, "pid", "left")
    out = {"mrow": F.coalesce("_r", "mrow"), "mcol": F.coalesce("_c", "mcol")} | ({"score": F.coalesce("_s", "score")} if "score" in matches.columns else {})
    return d.withColumns(out).drop("_r", "_c", "_s")


def ends_across(links: DataFrame, cross: DataFrame) -> DataFrame:
    """Links (ccd_l, row, col, ccd_r, mrow, mcol) both of whose ends match across (``cross``: ccd, row, col, img_id, mrow, mcol; equal
    places after rounding to whole pixels), with the places there: a_img, a_row, a_col, b_img, b_row, b_col."""
    side = lambda p: cross.select(C("ccd").alias(f"_{p}ccd"), F.rint("row").alias(f"_{p}r"), F.rint("col").alias(f"_{p}c"), C("img_id").alias(f"{p}_img"), C("mrow").alias(f"{p}_row"), C("mcol").alias(f"{p}_col"))
    l = links.withColumns({"_accd": C("ccd_l"), "_ar": F.rint("row"), "_ac": F.rint("col"), "_bccd": C("ccd_r"), "_br": F.rint("mrow"), "_bc": F.rint("mcol")})
    both = l.join(side("a"), ["_accd", "_ar", "_ac"]).join(side("b"), ["_bccd", "_br", "_bc"])
    return both.select("ccd_l", "row", "col", "ccd_r", "mrow", "mcol", "a_img", "a_row", "a_col", "b_img", "b_row", "b_col")


def tie_points(left: DataFrame, right: DataFrame, to_right, to_left, how: Z.Search, least: float, keep, overlap: int = 48, step: tuple[int, int] = (48, 16)) -> DataFrame:
    """Tie points over the seams of two strips: links inside the left strip, filtered by ``keep``, whose ends ``to_right`` matches across;
    and links inside the right strip, whose ends ``to_left`` does. ``strip`` says where a link lies."""
    out = None
    for name, tiles, cross in (("left", left, to_right), ("right", right, to_left)):
        links = held(keep(within_strip(tiles, how, least, overlap, step)))
        one = ends_across(links, held(cross(links))).withColumn("strip", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def joint_values(matches: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Counts of the pairs of whole sample values at matched places (lccd, rccd, row, col, mrow, mcol), 65,536 at most: lccd, rccd, joint."""
    img = lambda t, p: t.select(C("ccd").alias(f"{p}ccd"), C("cols").alias(f"{p}cols"), C("samples").alias(f"{p}img"))
    work = listed(matches, ["lccd", "rccd"], ["row", "col", "mrow", "mcol"], ["row", "col", "mrow", "mcol"]).join(img(left, "l"), "lccd").join(img(right, "r"), "rccd")
    whole = lambda image, cols, r, c: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.get(image, (F.rint(r) * cols + F.rint(c)).cast("int"))).cast("int")))
    pairs = work.select("lccd", "rccd", F.explode(F.transform("pts", lambda p: F.struct(whole(C("limg"), C("lcols"), p["row"], p["col"]).alias("a"), whole(C("rimg"), C("rcols"), p["mrow"], p["mcol"]).alias("b")))).alias("v"))
    counts = pairs.groupBy("lccd", "rccd", "v.a", "v.b").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("lccd", "rccd").agg(F.collect_list(F.struct("a", "b", "n")).alias("joint"))


def dense_match(points: DataFrame, left: DataFrame, right: DataFrame, matches: DataFrame, reach: int = 16, half: int = 7, smooth: float = 0.01, mutual: float = 0.01, gate: float = 256.0, least: float = 0.5) -> DataFrame:
    """Every point (lccd, rccd, pid, row, col, with its predicted place pr, pc and the affine's ar, ac) looked for under an energy of
    score, distance and mutual information of the samples, inside the affine gate; of equal scores the later right
    tile stays. Returns pid, rccd, mrow, mcol, score."""
    how = Z.Search(reach, half, 1, smooth=smooth, gate=gate, mutual=mutual)
    hits = search_in_tiles(points, left, right, how, least, joint_values(matches, left, right))
    return first_by(hits, ["pid"], [F.desc("score"), F.desc("rccd")])
