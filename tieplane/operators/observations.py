"""Observation tables for the adjustment: sampled matches with focal-plane places, times and ground points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import geometry as geo
from ..sources.shared import held as kept
from .joins import ranked_by_ranges
from .scans import scan_by_ranges

C = F.col


def every_nth(matches: DataFrame, n: int, per_tile: bool, line: str = "line") -> DataFrame:
    """Every n-th match in the order of tile and line; the count starts anew in each tile or goes on over all."""
    ranked = ranked_by_ranges(matches, ["ccd"], [line], "_i") if per_tile else ranked_by_ranges(matches, [], ["ccd", line], "_i")
    return ranked.filter(C("_i") % n == 0).drop("_i")


def settled(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Adds columns by a generator of one row. Plain projections are merged, so that each use of a column
    repeats all that made it; over several stages of geometry such expressions grow beyond compiling."""
    made = F.explode(F.array(F.struct(*(c.alias(n) for n, c in cols.items()))))
    return df.withColumn("_made", made).select("*", "_made.*").drop("_made")


def pose_at(et: Column, params: list[tuple[Column, list[Column]]]) -> list[Column]:
    """Xs, Ys, Zs, phi, omega, kappa by polynomials (t0, coefficients from the constant up)."""
    return [geo.horner(et, t0, c) for t0, c in params]


def observe(points: DataFrame, image: int, row: str, col: str, ccd: str, io: DataFrame, timing: DataFrame, polys: DataFrame, binning: float = 1.0, tdi: float = 128.0, f: float = 11995.48, radius: float = geo.RADIUS) -> DataFrame:
    """One observation per point: point_id, image, xp, yp, et, pose and the ground point on the sphere.

    ``io`` has ccd and the ten orientation columns, ``timing`` ccd, begin, line_rate, ``polys`` a row with the
    arrays p0..p5 = [t0, c0, c1, c2, c3]; all three are sensor dimensions.
    """
    names = ["x0", "x_s", "x_l", "y0", "y_s", "y_l", "k0", "k1", "k2"]
    d = points.join(io.select(C("ccd").alias(ccd), *names), ccd).join(timing.select(C("ccd").alias(ccd), "begin", "line_rate"), ccd).crossJoin(F.broadcast(polys.limit(1)))
    xp, yp = geo.focal_plane(C(col), F.lit(binning), F.lit(tdi), [C(n) for n in names])
    d = settled(d, {"xp": xp, "yp": yp, "et": geo.line_time(C(row), C("begin"), C("line_rate"))})
    pose = pose_at(C("et"), [(C(f"p{i}")[0], [C(f"p{i}")[k] for k in range(1, 5)]) for i in range(6)])
    d = settled(d, dict(zip(("Xs", "Ys", "Zs", "phi", "omega", "kappa"), pose, strict=True)))
    d = settled(d, {f"_r{i}": x for i, x in enumerate(geo.rotation(C("phi"), C("omega"), C("kappa")))})
    d = settled(d, {f"_d{i}": x for i, x in enumerate(geo.ray([C(f"_r{i}") for i in range(9)], C("xp"), C("yp"), F.lit(f)))})
    x, y, z = geo.ray_sphere([C(f"_d{i}") for i in range(3)], [C("Xs"), C("Ys"), C("Zs")], F.lit(radius))
    return d.select("point_id", F.lit(image).alias("image"), F.lit(image).alias("ord"), "xp", "yp", "et", "Xs", "Ys", "Zs", "phi", "omega", "kappa", x.alias("X"), y.alias("Y"), z.alias("Z"))


def ray_dem(rays: DataFrame, keys: list[str], dem: DataFrame, rows: int, cols: int, tol: float = 0.01, rounds: int = 100, radius: float = geo.RADIUS, every: int = 4) -> DataFrame:
    """Where rays (direction d0..d2, origin o0..o2) meet a raster of heights (r, c, h; latitude downwards, longitude wrapping).

    Each round meets the sphere through the height found last and looks the height there up, by a join, so the
    raster may have any size. It ends when heights change by less than ``tol``. Returns keys, x, y, z, h, settled;
    rays that miss have nulls and are settled. Rays and each step of a round are made once, as merged expressions would repeat what made
    them for each use. Every few rounds the table is written to the shared folder, which cuts its plan,
    and only rays that are not settled go on.
    """
    from .grid import dem_nearest

    way = {f"{x}{i}": C(f"{x}{i}") for x in "do" for i in range(3)}
    rays = settled(rays.select(*keys, F.struct(*(c.alias(n) for n, c in way.items())).alias("_ray")), {n: C(f"_ray.{n}") for n in way}).drop("_ray")
    rays = settled(rays, dict(zip(("_qa", "_qb", "_qo"), geo.ray_products(list(way.values())[:3], list(way.values())[3:]), strict=True)))
    carried = [*keys, *way, "_qa", "_qb", "_qo"]
    now = rays.select(*carried, F.lit(0.0).alias("_h"), F.lit(False).alias("_done"), *(F.lit(None).cast("double").alias(c) for c in ("_x", "_y", "_z")))
    places, ended = dem.select("r", "c", C("h").alias("_n")), None
    for k in range(rounds):
        d = settled(now, {"_root": geo.sphere_root(C("_qa"), C("_qb"), C("_qo"), radius + C("_h"))})
        d = settled(d, {"_t": geo.nearer(C("_qa"), C("_qb"), C("_root"))})
        d = settled(d, {f"_g{x}": C("_t") * C(f"d{i}") + C(f"o{i}") for i, x in enumerate("xyz")})
        lat, lon, _ = geo.to_lat_lon(C("_gx"), C("_gy"), C("_gz"), radius)
        d = settled(d, {"_row": (90.0 - lat) / 180.0 * (rows - 1), "_col": (lon + 180.0) / 360.0 * (cols - 1)})
        d = dem_nearest(d, places, "_row", "_col", "_n")
        new = F.coalesce("_n", "_h")
        held = lambda was, now_: F.when(C("_done"), C(was)).otherwise(C(now_)).alias(was)
        now = d.select(*carried, F.when(C("_done"), C("_h")).otherwise(new).alias("_h"), (C("_done") | (F.abs(new - C("_h")) < tol) | C("_gx").isNull()).alias("_done"), held("_x", "_gx"), held("_y", "_gy"), held("_z", "_gz"))
        if k % every == every - 1:
            now = kept(now)
            ended = now.filter("_done") if ended is None else ended.unionByName(now.filter("_done"))
            now = now.filter("NOT _done")
            if now.isEmpty():
                break
    now = now if ended is None else ended.unionByName(now)
    return now.select(*keys, C("_x").alias("x"), C("_y").alias("y"), C("_z").alias("z"), F.when(C("_x").isNotNull(), C("_h")).alias("h"), C("_done").alias("settled"))


def footprint(rows: DataFrame, io: DataFrame, timing: DataFrame, polys: DataFrame) -> DataFrame:
    """Longitude, latitude and height of the four corners of each tile (ccd, rows, cols)."""
    corners = F.array(*(F.struct(F.lit(k).alias("k"), r.alias("row"), c.alias("col")) for k, (r, c) in enumerate([(F.lit(0.0), F.lit(0.0)), (F.lit(0.0), C("cols") * 1.0), (C("rows") * 1.0, F.lit(0.0)), (C("rows") * 1.0, C("cols") * 1.0)])))
    pts = rows.withColumn("_c", F.explode(corners)).select("ccd", (C("ccd") * 4 + C("_c.k")).alias("point_id"), C("_c.row").alias("row"), C("_c.col").alias("col"))
    o = observe(pts, 0, "row", "col", "ccd", io, timing, polys)
    lat, lon, h = geo.to_lat_lon(C("X"), C("Y"), C("Z"))
    return o.select(F.floor(C("point_id") / 4).cast("int").alias("ccd"), (C("point_id") % 4).cast("int").alias("corner"), lat.alias("lat"), lon.alias("lon"), h.alias("h"))


def feature_places(features: DataFrame, scale: int, io: DataFrame, timing: DataFrame, polys: DataFrame) -> DataFrame:
    """Latitude, longitude and height of features (ccd, r, c) of a level whose pixels are ``scale`` samples wide."""
    pts = features.select("ccd", F.struct("r", "c").alias("point_id"), (C("r") * float(scale)).alias("row"), (C("c") * float(scale)).alias("col"))
    o = observe(pts.withColumn("point_id", F.struct("ccd", "point_id")), 0, "row", "col", "ccd", io, timing, polys)
    lat, lon, h = geo.to_lat_lon(C("X"), C("Y"), C("Z"))
    return o.select("point_id.ccd", "point_id.point_id.r", "point_id.point_id.c", lat.alias("lat"), lon.alias("lon"), h.alias("h"))


def ground_to_image(points: DataFrame, begin: float, line_rate: float, params: list[list[float]], io: list[float], rows: int, f: float = 11995.48, binning: float = 1.0, tdi: float = 128.0, rounds: int = 100) -> DataFrame:
    """Image place of ground points (X, Y, Z): the scan line is found by iterating the line offset to below one.

    Vectorised over an Arrow batch. Adds img_row and img_col, null where it doesn't settle.
    """
    from .triangulate import project

    @F.pandas_udf("struct<img_row: double, img_col: double>")
    def locate(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.DataFrame:
        g = np.stack([x, y, z], axis=1).astype(float)
        et = np.full(len(g), begin + rows / 2 * line_rate * binning)
        line, sample = np.zeros(len(g)), np.zeros(len(g))
        for _ in range(rounds):
            d = [et - p[0] for p in params]
            pose = np.stack([p[1] + p[2] * t + p[3] * t**2 + p[4] * t**3 for p, t in zip(params, d, strict=True)], axis=1)
            uv, _ = project(g, pose, f)
            r2 = (uv**2).sum(axis=1)
            k = io[6] + io[7] * r2 + io[8] * r2**2
            a, b = uv[:, 0] * (1 + k) - io[0], uv[:, 1] * (1 + k) - io[3]
            det = io[1] * io[5] - io[2] * io[4]
            sample = ((a * io[5] - b * io[2]) / det + 1024) / binning + 0.5
            line = (b * io[1] - a * io[4]) / det - (tdi / 2 - 64 - (binning / 2 - 0.5))
            if not (np.abs(line) >= 1e-6).any():
                break
            et = et + np.where(np.isfinite(line), line, 0) * line_rate * binning
        ok = np.abs(line) < 1
        return pd.DataFrame({"img_row": np.where(ok, (et - begin) / line_rate, np.nan), "img_col": np.where(ok, sample, np.nan)})

    return points.withColumn("_p", locate("X", "Y", "Z")).select("*", F.nanvl("_p.img_row", F.lit(None)).alias("img_row"), F.nanvl("_p.img_col", F.lit(None)).alias("img_col")).drop("_p")


def trajectory_series(samples: DataFrame, keys: list[str], epoch: str = "2000-01-01 12:00:00", tie: list[str] = ()) -> DataFrame:
    """Poses (et, Xs, Ys, Zs, phi, omega, kappa) as a time series: utc (seconds after ``epoch`` as a timestamp's text), place, velocity to
    the next sample, quaternion and matrix. The last sample of a group has no velocity, nor has one whose next
    is at the same time; ``tie`` (numbers) orders these."""
    back = {f"_o{i}": -C(c) for i, c in enumerate(["et", *tie])}  # in falling order the next sample is the row before
    moved = {c: f"_n{c}" for c in ("et", "Xs", "Ys", "Zs")}
    samples = scan_by_ranges(samples.withColumns(back), keys, list(back), before=moved)
    d = settled(samples, {f"r{i}": x for i, x in enumerate(geo.rotation(C("phi"), C("omega"), C("kappa")))})
    dt = F.nullif(C("_net") - C("et"), F.lit(0.0))
    velocity = [((C(f"_n{c}") - C(c)) / dt).alias(f"V{c[0]}") for c in ("Xs", "Ys", "Zs")]
    q = [x.alias(f"q{n}") for n, x in zip("wxyz", geo.quaternion([C(f"r{i}") for i in range(9)]), strict=True)]
    seconds = F.unix_timestamp(F.lit(epoch).cast("timestamp")) + F.floor("et").cast("long")
    utc = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss")
    return d.select(*keys, *tie, utc.alias("utc"), "et", "Xs", "Ys", "Zs", *velocity, *q, *(C(f"r{i}") for i in range(9)))


def ground_match(rays: DataFrame, keys: list[str], dem: DataFrame, dem_rows: int, dem_cols: int, begin: float, line_rate: float, params: list[list[float]], io: list[float], lines: int) -> DataFrame:
    """Where what rays see on a raster of heights lies in another image: keys, X, Y, Z, h, img_row, img_col."""
    ground = ray_dem(rays, keys, dem, dem_rows, dem_cols).filter("x IS NOT NULL").select(*keys, C("x").alias("X"), C("y").alias("Y"), C("z").alias("Z"), "h")
    return ground_to_image(ground, begin, line_rate, params, io, lines)
