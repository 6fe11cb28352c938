import numpy as np
import pytest
from pyspark.sql import functions as F

from tieplane.operators import fit, joins, neighbours, robust

AT = (("row", "col"), ("srow", "scol"))


def tables(spark, n=400, span=60.0, seed=1):
    rng = np.random.default_rng(seed)
    grid = lambda: np.round(rng.random(n) * span * 2) / 2  # noqa: E731  many lie exactly on rims
    rows = [(int(k % 3), i, float(r), float(c), float(a), float(b)) for i, (k, r, c, a, b) in enumerate(zip(rng.integers(0, 9, n), grid(), grid(), rng.normal(5, 2, n), rng.normal(-1, 9, n), strict=True))]
    left = spark.createDataFrame([r[:4] for r in rows] + [(0, 9001, None, 1.0), (0, 9002, float("inf"), 1.0), (0, 9003, float("nan"), 1.0)], "ccd int, pid long, row double, col double")
    right = spark.createDataFrame(rows, "ccd int, sid long, srow double, scol double, a double, b double")
    return rows, left, right


def pairs_of(left, right, radius, closed):
    return joins.radius_join(left.filter("row < 1e9"), right, *AT, radius, ["ccd"], closed)


@pytest.mark.parametrize("radius, closed, piece", [(5.0, False, 10**6), (5.0, True, 10**6), (500.0, False, 10**6), (12.5, True, 40)])
def test_moments_equal_those_of_pairs(spark, monkeypatch, radius, closed, piece):
    monkeypatch.setattr(neighbours, "PIECE", piece)
    _, left, right = tables(spark)
    got = {r.pid: r for r in neighbours.radius_moments(left, right, *AT, radius, ("pid", "sid"), ["a", "b"], ["ccd"], closed).collect()}
    want = pairs_of(left, right, radius, closed).filter("pid <> sid").groupBy("pid").agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("m"), F.var_pop("b").alias("v"), F.covar_pop("a", "b").alias("c")).collect()
    assert set(got) == {r.pid for r in want}
    for r in want:
        assert got[r.pid].n == r.n and np.allclose([got[r.pid].m_a, got[r.pid].v_b, got[r.pid].cov], [r.m, r.v, r.c], atol=1e-9)


def test_weighted_sums_equal_those_of_pairs(spark):
    _, left, right = tables(spark, seed=2)
    got = {r.pid: r for r in neighbours.radius_weighted(left, right, *AT, 8.0, ("pid", "sid"), ["a"], neighbours.gaussian(30.0), ["ccd"], apart=False).collect()}
    w = F.exp(-F.col("d2") / 30.0)
    want = pairs_of(left, right, 8.0, False).groupBy("pid").agg(F.count(F.lit(1)).alias("n"), (F.sum(w * F.col("a")) / F.sum(w)).alias("w"), F.var_pop("a").alias("v")).collect()
    assert len(want) == len(got) and all(got[r.pid].n == r.n and np.allclose([got[r.pid].w_a, got[r.pid].v_a], [r.w, r.v], atol=1e-9) for r in want)


def test_surfaces_equal_those_of_pairs(spark):
    _, left, right = tables(spark, seed=3)
    sums = neighbours.radius_surface_sums(left, right, *AT, 9.0, ("pid", "sid"), ["a", "b"], neighbours.gaussian(40.0), ["ccd"])
    got = {r.pid: r for r in fit.surfaces_of(sums, ["pid"], ["za", "zb"]).collect()}
    p = pairs_of(left, right, 9.0, False).select("pid", (F.col("srow") - F.col("row")).alias("x"), (F.col("scol") - F.col("col")).alias("y"), "a", "b", F.exp(-F.col("d2") / 40.0).alias("w"))
    for v in ("a", "b"):
        want = fit.quadratic_surface(p, ["pid"], "x", "y", v, "w", "z").collect()
        assert len(want) == len(got) and all(got[r.pid].n == r.n and np.isclose(got[r.pid][f"z{v}"], r.z, atol=1e-6) for r in want)


def test_the_filter_from_moments_is_that_of_pairs(spark):
    _, left, right = tables(spark, seed=4)
    points = left.join(right.select(F.col("sid").alias("pid"), F.col("a").alias("own")), "pid")
    for isolated in (False, True):
        by_pairs = robust.neighbour_filter(points, pairs_of(left, right, 2.0, False).filter("pid <> sid"), "pid", [("own", "a")], 1.5, isolated)
        n = neighbours.radius_moments(left, right, *AT, 2.0, ("pid", "sid"), ["a"], ["ccd"])
        assert {r.pid for r in robust.moments_filter(points, n, "pid", [("own", "a")], 1.5, isolated).collect()} == {r.pid for r in by_pairs.collect()}


def test_rows_shuffled_follow_the_points(spark):
    """Four times the points in the same place have sixteen times the pairs; what is dealt out grows fourfold."""
    dealt = []
    for n in (500, 2000):
        _, left, right = tables(spark, n, seed=5)
        union, _, pieces = neighbours._blocked(left, right, *AT, ("pid", "sid"), ["a"], ["ccd"], 20.0)
        assert pieces == 1
        dealt.append(union.count())
    assert dealt[1] < 4.5 * dealt[0]


def test_empty_sides(spark):
    _, left, right = tables(spark, 20)
    for l, r in ((left.limit(0), right), (left, right.limit(0))):
        assert neighbours.radius_moments(l, r, *AT, 5.0, ("pid", "sid"), ["a"]).collect() == []


def test_knn_skips_points_without_a_place(spark):
    _, left, right = tables(spark, 30)
    near = joins.knn_join(left, right.unionByName(right.limit(1).withColumn("srow", F.lit(float("inf")))), *AT, 2, ["pid"], ["d2", "sid"])
    assert near.select("pid").distinct().count() == 30


def test_nearest_in_many_leaves_equal_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(joins, "LEAF", 24)
    rng = np.random.default_rng(7)
    dense = [(0, i, *(np.round(rng.random(2) * 8) / 4 + 40)) for i in range(150)]  # ties and many in one place
    wide = [(int(i % 2), 1000 + i, *(rng.random(2) * [3000.0, 90.0])) for i in range(250)]
    points = [(g, i, float(r), float(c)) for g, i, r, c in dense + wide]
    left = spark.createDataFrame(points + [(1, 9000, 1e6, -1e6), (3, 9001, 0.0, 0.0)], "ccd int, pid long, row double, col double")
    right = spark.createDataFrame([x for x in points if x[1] % 3], "ccd int, sid long, srow double, scol double")
    for k in (2, 9):
        got = sorted((r.pid, r.rk, r.sid, r.d2) for r in joins.knn_join(left, right, *AT, k, ["pid"], ["d2", "sid"], ["ccd"]).collect())
        d2 = (F.col("row") - F.col("srow")) * (F.col("row") - F.col("srow")) + (F.col("col") - F.col("scol")) * (F.col("col") - F.col("scol"))
        want = joins.nearest_k(left.join(right, "ccd").withColumn("d2", d2), ["pid"], k, ["d2", "sid"])
        assert got == sorted((r.pid, r.rk, r.sid, r.d2) for r in want.collect())


@pytest.mark.parametrize("few, full", [(50, 25_000), (2, 25_000), (400, 1), (2000, 25_000)])
def test_wide_blocks_give_what_narrow_ones_give(spark, monkeypatch, few, full):
    """Few points over a wide plane, in blocks of each kind: wide ones as many points as they may hold, or narrow ones where none fits."""
    monkeypatch.setattr(neighbours, "FEW", few)
    monkeypatch.setattr(neighbours, "FULL", full)
    _, left, right = tables(spark, 600, span=900.0, seed=6)
    left = left.withColumn("row", F.col("row") - 300)
    right = right.withColumn("srow", F.col("srow") - 300)
    got = {r.pid: r for r in neighbours.radius_moments(left, right, *AT, 6.5, ("pid", "sid"), ["a", "b"], ["ccd"]).collect()}
    want = pairs_of(left, right, 6.5, False).filter("pid <> sid").groupBy("pid").agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("m"), F.var_pop("b").alias("v")).collect()
    assert len(want) > 20 and set(got) == {r.pid for r in want}
    assert all(got[r.pid].n == r.n and np.allclose([got[r.pid].m_a, got[r.pid].v_b], [r.m, r.v], atol=1e-9) for r in want)
