"""The steps of the graph for one stereo pair, made of the library's operators.

Tables that the steps pass on: left, right (tiles: seq, level, ccd, rows, cols, samples); mosaic_l, mosaic_r; levels_l, levels_r
(lists of tile tables, finest first); matches (pid, ccd, row, col, rccd, mrow, mcol, score); affines; affine; grid; ties;
observations; points. Each result is a snapshot under the work folder.
"""

from __future__ import annotations

import argparse
import json
import sys

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import patch as Z
from ..operators import adjust, fit, joins, matching, neighbours, observations, robust, triangulate
from ..sources import config as settings
from ..sources import sinks
from .pipeline import Step, batch

C = F.col
POSE = ("Xs", "Ys", "Zs", "phi", "omega", "kappa")


def stretched(tiles: DataFrame, low: float = 0.003, high: float = 0.997) -> DataFrame:
    """Samples balanced by column and spread over 0 to 255 between two quantiles, tile by tile in an Arrow kernel."""

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                a = np.asarray(r.samples, np.float64).reshape(r.rows, r.cols)
                a = a - a.mean(axis=0) + a.mean()
                lo, hi = np.quantile(a, [low, high])
                out.append(np.clip((a - lo) / max(hi - lo, 1e-12) * 255, 0, 255).astype(np.float32).ravel())
            yield pdf.assign(samples=pd.Series(out, index=pdf.index, dtype=object))

    return tiles.mapInPandas(run, tiles.schema)


def mosaic_of(tiles: DataFrame, overlap: int, rows: int, cols: int, step: int = 16) -> DataFrame:
    """Places of a strip's tiles: the shifts of each against the next, added up. A row per tile of a sensor."""
    shifts = matching.register_overlaps(tiles, overlap, rows, cols, step=step)
    d = tiles.select("ccd", "rows", "cols").join(shifts.select("ccd", "dr", "dc"), "ccd", "left")
    before = W.partitionBy(F.lit(0)).orderBy("ccd").rowsBetween(W.unboundedPreceding, -1)  # as many rows as tiles
    d = d.withColumns({"r0": F.coalesce(F.sum(F.coalesce("dr", F.lit(0))).over(before), F.lit(0)).cast("int"), "c0": F.coalesce(F.sum(C("cols") - overlap + F.coalesce("dc", F.lit(0))).over(before), F.lit(0)).cast("int")})
    return d.select("ccd", "r0", (C("r0") + C("rows")).alias("r1"), "c0", (C("c0") + C("cols")).alias("c1"))


def steps(spark: SparkSession, c: settings.Config, work: str, overlap: int = 48, levels: int = 5, half: int = 4, corner_cell: int = 8, shift: tuple[int, int] = (4, 8), wide: int = 160) -> dict[str, Step]:
    """Steps that run on tables ``left`` and ``right``; with io, timing and the polynomials polys_l, polys_r (or the trajectories eo_l, eo_r, which
    these are fitted to) also the adjustment. Levels end where a tile would be smaller than four corner cells."""
    keep = lambda df, name: sinks.snapshot(df, f"{work}/{name}")
    m, g = c.feature_match, c.grid_match
    step = max(1, overlap // 8)

    def features(tiles: DataFrame, side: str) -> DataFrame:
        pts = matching.detect_corners(tiles, corner_cell, half + 2).select("seq", "level", "ccd", "row", "col")
        cut = matching.with_patches(pts, tiles, half)
        key = C("ccd").cast("long") * (1 << 40) + C("row") * (1 << 20) + C("col")
        named = ("pid", "row", "col", "lpatch") if side == "l" else ("rid", "rrow", "rcol", "rpatch")
        return cut.select("ccd", key.alias(named[0]), C("row").cast("double").alias(named[1]), C("col").cast("double").alias(named[2]), C("patch").alias(named[3]))

    def preprocess(t):
        return {"left": keep(stretched(t["left"]), "left"), "right": keep(stretched(t["right"]), "right")}

    def mosaic(t):
        return {f"mosaic_{s}": keep(mosaic_of(t[n], overlap, *shift, step=step), f"mosaic_{s}") for s, n in (("l", "left"), ("r", "right"))}

    def downsample(t):
        out = {}
        for s, n in (("l", "left"), ("r", "right")):
            out[f"levels_{s}"] = [t[n]]
            side = t[n].agg(F.min(F.least("rows", "cols"))).first()[0] or 0
            for k in range(1, levels):
                if side >> k < 4 * corner_cell:
                    break
                out[f"levels_{s}"].append(keep(matching.downsample(out[f"levels_{s}"][-1]), f"{n}{k}"))
        return out

    def feature_match(t):
        by_level = {k: (features(t["levels_l"][k], "l"), features(t["levels_r"][k], "r")) for k in range(len(t["levels_l"]))}
        found, affines = matching.pyramid_match(by_level, ["ccd"], keep, reach=float(m.near_range), sigma=m.sigma, tile=(g.spacing * 8.0, g.spacing * 8.0))
        found = found.select("ccd", "pid", "row", "col", "rid", "mrow", "mcol", "score")
        if m.iterations:
            found = matching.refine_iteratively(found, ["ccd"], m.iterations, keep, m.seed_radius)
        matches = keep(found.withColumn("rccd", C("ccd")).select("pid", "ccd", "row", "col", "rccd", "mrow", "mcol", "score"), "matches")
        whole = matching.global_affine(matches.withColumn("img_id", C("rccd")), t["mosaic_l"], m.sigma).first()  # one row
        return {"matches": matches, "affines": affines, "affine": [whole[f] for f in fit.AFFINE]}

    def grid_match(t):
        size = t["left"].select("ccd", C("rows").alias("h"), C("cols").alias("w"))
        centre = F.lit(g.spacing // 2)
        at = F.explode(F.sequence(F.lit(0), F.floor(C("h") / g.spacing) - 1))
        rows = size.filter(C("h") >= g.spacing).select("ccd", "w", at.alias("i")).filter(C("w") >= g.spacing)
        cells = rows.select("ccd", "i", F.explode(F.sequence(F.lit(0), F.floor(C("w") / g.spacing) - 1)).alias("j"))
        cells = cells.select("ccd", (C("ccd").cast("long") * (1 << 40) + C("i") * (1 << 20) + C("j")).alias("pid"), (C("i") * g.spacing + centre).cast("double").alias("row"), (C("j") * g.spacing + centre).cast("double").alias("col"))
        # a tile without an affine of its own takes that of the whole strip
        own = t["affines"].filter("inliers >= 3").select("ccd", *(C(f).alias(f"own_{f}") for f in fit.AFFINE))
        affines = size.select("ccd").join(own, "ccd", "left").select("ccd", *(F.coalesce(f"own_{f}", F.lit(float(x))).alias(f) for f, x in zip(fit.AFFINE, t["affine"], strict=True)))
        guessed = matching.grid_predictions(cells, t["matches"].select("ccd", "row", "col", "mrow", "mcol"), affines, ["ccd"], m.seed_radius)
        plain = matching.predict_points(cells.select("ccd", "pid", "row", "col"), affines, ["ccd"]).select("pid", C("pr").alias("ar"), C("pc").alias("ac"))
        asked = guessed.join(plain, "pid").select("ccd", C("ccd").alias("lccd"), C("ccd").alias("rccd"), "pid", "row", "col", "pr", "pc", "ar", "ac")
        how = Z.Search(reach=g.search, half=g.window // 2, stride=1, smooth=g.lambda2, gate=float(g.weak_range), sharpness=30.0, kind="blend")
        return {"grid": keep(matching.semi_dense(asked, t["left"], t["right"], ["ccd"], how, g.min_score), "grid")}

    def inter_tile_match(t):
        how = Z.Search(4, half, sharpness=None, kind="blend")

        placed = joins.tile_lookup(joins.tile_lookup(t["matches"], t["mosaic_l"], "ccd", "l"), t["mosaic_r"], "rccd", "r")
        there = placed.select((C("row") + C("l_r0")).alias("row"), (C("col") + C("l_c0")).alias("col"), (C("mrow") + C("r_r0")).alias("mrow"), (C("mcol") + C("r_c0")).alias("mcol"))
        back = there.select(C("mrow").alias("row"), C("mcol").alias("col"), C("row").alias("mrow"), C("col").alias("mcol"))
        f = t["affine"]
        inverse = np.linalg.inv(np.array([f[:3], f[3:], [0, 0, 1]]))[:2].ravel().tolist()

        def across(controls, affine, source, target, left, right):
            def run(links):
                ends = links.select(C("ccd_l").alias("ccd"), "row", "col").unionByName(links.select(C("ccd_r").alias("ccd"), F.rint("mrow").alias("row"), F.rint("mcol").alias("col"))).distinct()
                ends = ends.select((C("ccd").cast("long") * (1 << 40) + C("row").cast("long") * (1 << 20) + C("col").cast("long")).alias("pid"), "ccd", C("row").cast("double").alias("row"), C("col").cast("double").alias("col"), F.lit(None).cast("int").alias("rccd"), *(F.lit(None).cast("double").alias(x) for x in ("mrow", "mcol", "score")))
                hits = matching.cross_strip_match(ends, controls, source, target, affine, left, right, Z.Search(4, half, 1, kind="blend"), g.min_score, m.seed_radius, wide=wide)
                return hits.filter("rccd IS NOT NULL").select("ccd", "row", "col", C("rccd").alias("img_id"), "mrow", "mcol")

            return run

        def agreeing(links):
            """Links whose shift is that of the links around them; one without any stays."""
            d = links.withColumns({"pid": C("ccd_l").cast("long") * (1 << 40) + C("row").cast("long") * (1 << 20) + C("col").cast("long"), "_dr": C("mrow") - C("row"), "_dc": C("mcol") - C("col")})
            s = d.select("ccd_l", C("pid").alias("sid"), C("row").alias("srow"), C("col").alias("scol"), C("_dr").alias("ndr"), C("_dc").alias("ndc"))
            n = neighbours.radius_moments(d, s, ("row", "col"), ("srow", "scol"), m.seed_radius, ("pid", "sid"), ["ndr", "ndc"], ["ccd_l"])
            flat = n.withColumns({v: F.greatest(v, F.lit(0.25)) for v in ("v_ndr", "v_ndc")})  # half a pixel is no disagreement
            return robust.moments_filter(d, flat, "pid", [("_dr", "ndr"), ("_dc", "ndc")], 3.0, isolated=True).drop("pid", "_dr", "_dc")

        to_right = across(there, f, t["mosaic_l"], t["mosaic_r"], t["left"], t["right"])
        to_left = across(back, inverse, t["mosaic_r"], t["mosaic_l"], t["right"], t["left"])
        return {"ties": keep(matching.tie_points(t["left"], t["right"], to_right, to_left, how, g.min_score, agreeing, overlap, (step, step)), "ties")}

    def trajectory(t):
        out = {}
        for s in "lr":
            if f"eo_{s}" in t:  # a row of polynomials a strip
                p = fit.time_polynomials(t[f"eo_{s}"].withColumn("_one", F.lit(0)), ["_one"], "et", list(POSE))
                rows = {r.param: [float(r.t0), *map(float, r.coefs)] for r in p.collect()}
                out[f"polys_{s}"] = spark.createDataFrame([tuple(rows[n] for n in POSE)], ", ".join(f"p{i} array<double>" for i in range(6)))
        return out

    def adjustment(t):
        """Grid matches that agree with those around them, their rays, the trajectories corrected by all rays, and points of the corrected
        rays. What the rays of two strips alone can't tell is held by the sphere's radius and the weights of the corrections."""
        own = t["grid"].filter("mrow IS NOT NULL").withColumns({"_dr": C("mrow") - C("row"), "_dc": C("mcol") - C("col")})
        s = own.select("ccd", C("pid").alias("sid"), C("row").alias("srow"), C("col").alias("scol"), C("_dr").alias("ndr"), C("_dc").alias("ndc"))
        n = neighbours.radius_moments(own, s, ("row", "col"), ("srow", "scol"), m.seed_radius, ("pid", "sid"), ["ndr", "ndc"], ["ccd"])
        flat = n.withColumns({v: F.greatest(v, F.lit(0.25)) for v in ("v_ndr", "v_ndc")})
        matched, both = robust.moments_filter(own, flat, "pid", [("_dr", "ndr"), ("_dc", "ndc")], 2.0, isolated=False), None
        for image, (row, col, ccd) in enumerate((("row", "col", "ccd"), ("mrow", "mcol", "rccd"))):
            pts = matched.select(C("pid").alias("point_id"), C(ccd).alias("ccd"), C(row).alias("row"), C(col).alias("col"))
            one = observations.observe(pts, image, "row", "col", "ccd", t["io"], t["timing"], t[f"polys_{'lr'[image]}"])
            both = one if both is None else both.unionByName(one)
        seen = keep(both, "observations")
        rays = seen.filter("X IS NOT NULL")
        poses = {r.image: (r.t0, max(r.span, 1e-9)) for r in rays.groupBy("image").agg(F.min("et").alias("t0"), (F.max("et") - F.min("et")).alias("span")).collect()}  # two images
        theta, costs = adjust.sparse_adjustment(rays, poses, degree=1, heights=(observations.geo.RADIUS, 500.0), loss=1.0)
        better = adjust.corrected(rays, theta, poses, 1)
        points = keep(triangulate.forward_intersection(better), "points")
        orbit = spark.createDataFrame([(im, name, term, float(theta[im][q][term])) for im in theta for q, name in enumerate(POSE) for term in range(2)], "image int, param string, term int, coef double")
        costs = spark.createDataFrame([(i, float(x)) for i, x in enumerate(costs)], "round int, cost double")
        return {"observations": seen, "points": points, "orbit": keep(orbit, "orbit"), "costs": costs, "residuals": keep(triangulate.residual_report(points), "residuals")}

    def export(t):
        sinks.write_matches(t["grid"].withColumn("img_id", C("rccd")).withColumn("line", F.row_number().over(W.partitionBy("ccd").orderBy("pid"))), f"{work}/text")
        return {}

    sensor = ["io", "timing", "polys_l", "polys_r"]
    return {
        "preprocess": Step(preprocess, ["left", "right"]), "mosaic": Step(mosaic, ["left", "right"]), "trajectory": Step(trajectory), "downsample": Step(downsample, ["left", "right"]),
        "feature_match": Step(feature_match, ["levels_l", "levels_r", "mosaic_l"]), "grid_match": Step(grid_match, ["matches", "affines", "affine"]),
        "inter_tile_match": Step(inter_tile_match, ["matches", "affine", "mosaic_l", "mosaic_r"]), "adjustment": Step(adjustment, ["grid", *sensor]), "export": Step(export, ["grid"]),
    }


def main(argv: list[str] | None = None) -> int:
    """Runs settings files, one a pair; each names its tiles as Parquet under its root (left.parquet, right.parquet)."""
    p = argparse.ArgumentParser(prog="tieplane.plans.stereo")
    p.add_argument("settings", nargs="+")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--continue", dest="keep_going", action="store_true")
    args = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    pairs = []
    for path in args.settings:
        with open(path, encoding="utf-8") as f:
            pairs.append(settings.parse(f.read()))

    def of(c: settings.Config) -> dict[str, Step]:
        read = Step(lambda t: {n: spark.read.parquet(f"{c.root}/{n}.parquet") for n in ("left", "right")})
        made = steps(spark, c, f"{c.root}/work")
        first = made["preprocess"].run
        return made | {"preprocess": Step(lambda t: first(t | read.run(t)))}

    log = batch(spark, pairs, of, args.keep_going, args.dry_run)
    for r in log.toJSON().collect():
        print(json.loads(r))
    return int(log.filter("status = 'failed'").count() > 0)


if __name__ == "__main__":
    sys.exit(main())
