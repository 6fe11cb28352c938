import math

import numpy as np
from pyspark.sql import functions as F

from tieplane.functions import projection
from tieplane.operators import spectrum

CLARKE, INTERNATIONAL = 6378206.4, 6378388.0
flat = lambda e2: 1 - math.sqrt(1 - e2)


def test_published_transverse_mercator_place(spark):
    """Clarke 1866, 40 30 N 73 30 W about 75 W: 127106.5 m east, 4484124.4 m north of the equator."""
    e, n = projection.to_transverse_mercator(F.lit(40.5), F.lit(-73.5), -75.0, CLARKE, flat(0.00676866))
    r = spark.range(1).select(e.alias("e"), n.alias("n")).first()
    assert abs(r.e - 127106.5) < 0.1 and abs(r.n - 4484124.4) < 0.1


def test_published_polar_stereographic_place(spark):
    """International ellipsoid, true at 71 S about 100 W, 75 S 150 E: -1540033.6 m, -560526.4 m."""
    e, n = projection.to_polar_stereographic(F.lit(-75.0), F.lit(150.0), -100.0, INTERNATIONAL, flat(0.00672267), -71.0)
    r = spark.range(1).select(e.alias("e"), n.alias("n")).first()
    assert abs(r.e + 1540033.6) < 0.1 and abs(r.n + 560526.4) < 0.1


def test_both_ways(spark):
    rng = np.random.default_rng(1)
    rows = [(float(a), float(b)) for a, b in zip(rng.uniform(-89, 89, 300), rng.uniform(-60, 60, 300), strict=True)] + [(0.0, 0.0), (90.0, 0.0), (-90.0, 0.0)]
    df = spark.createDataFrame(rows, "lat double, lon double")
    e, n = projection.to_transverse_mercator(F.col("lat"), F.col("lon"), 5.0, 3396190.0, 1 / 169.8)
    d = df.select("lat", "lon", e.alias("e"), n.alias("n"))
    la, lo = projection.from_transverse_mercator(F.col("e"), F.col("n"), 5.0, 3396190.0, 1 / 169.8)
    for r in d.select("lat", "lon", la.alias("a"), lo.alias("o")).collect():
        assert abs(r.a - r.lat) < 2e-6 and (abs(r.lat) == 90 or abs(r.o - r.lon) < 2e-6)  # 65 degrees from the meridian
    for side, true_at in ((1, 90.0), (1, 70.0), (-1, -90.0), (-1, -71.0)):
        near = df.filter(F.col("lat") * side > 20)
        e, n = projection.to_polar_stereographic(F.col("lat"), F.col("lon"), 5.0, 3396190.0, 1 / 169.8, true_at)
        la, lo = projection.from_polar_stereographic(F.col("e"), F.col("n"), 5.0, 3396190.0, 1 / 169.8, true_at)
        rows = near.select("lat", "lon", e.alias("e"), n.alias("n")).select("lat", "lon", la.alias("a"), lo.alias("o")).collect()
        assert rows and all(abs(r.a - r.lat) < 1e-9 and (abs(r.lat) == 90 or abs(r.o - r.lon) < 1e-9) for r in rows)


def waves(n=900, seed=2):
    rng = np.random.default_rng(seed)
    t = np.sort(rng.uniform(0, 8, n))
    return [(g, float(x), float(3 + g + 0.8 * np.cos(2 * np.pi * 1.37 * x + g) + 0.4 * np.sin(2 * np.pi * 4.02 * x) + rng.normal(0, 0.2))) for g in (0, 1) for x in t]


def test_the_spectrum_is_that_of_least_squares(spark):
    rows = waves(60)
    got = spectrum.spectrum(spark.createDataFrame(rows + [(0, None, 1.0), (0, 1.0, None)], "g int, t double, v double"), ["g"], "t", "v", [0.5, 1.37]).collect()
    assert len(got) == 4
    for r in got:
        t, v = np.array([x[1:] for x in rows if x[0] == r.g]).T
        m = np.stack([np.cos(2 * np.pi * r.frequency * t), np.sin(2 * np.pi * r.frequency * t), np.ones(len(t))], axis=1)
        x, rest, *_ = np.linalg.lstsq(m, v, rcond=None)
        assert np.allclose([r.a, r.b, r.power], [*x[:2], 1 - rest[0] / ((v - v.mean()) ** 2).sum()]) and r.n == 60


def test_planted_waves_are_found(spark):
    found = spectrum.jitter_waves(spark.createDataFrame(waves(), "g int, t double, v double"), ["g"], "t", "v", 8.0, waves=3, least=0.3).collect()
    for g in (0, 1):
        own = sorted((r.wave, r.frequency) for r in found if r.g == g)
        assert [w for w, _ in own] == [0, 1] and abs(own[0][1] - 1.37) < 0.02 and abs(own[1][1] - 4.02) < 0.02


def test_series_without_a_wave(spark):
    df = spark.createDataFrame([(0, float(k), 5.0) for k in range(9)] + [(1, 0.0, 1.0)], "g int, t double, v double")
    assert spectrum.peaks(spectrum.spectrum(df, ["g"], "t", "v", [0.1, 0.2]), ["g"], 0.1).filter("power > 1e-9").collect() == []
    assert spectrum.jitter_waves(df.limit(0), ["g"], "t", "v", 1.0).collect() == []
