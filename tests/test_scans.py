import numpy as np
from pyspark.sql import functions as F

from tieplane.operators import grid, observations, robust
from tieplane.operators.scans import scan_by_ranges
from tieplane.plans import catalog


def rows(seed=1, n=1500):
    """One group holds nine tenths of the rows; there are ties, null keys and groups of one."""
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.9, 1, rng.integers(2, 9, n))
    return [(None if k == 8 else int(k), float(v), i, int(w)) for i, (k, v, w) in enumerate(zip(key, rng.integers(0, 50, n), rng.integers(-2, 9, n), strict=True))] + [(99, 1.0, -1, 3)]


def test_a_scan_equals_one_group_at_a_time(spark):
    data = rows()
    df = spark.createDataFrame(data, "k int, v double, id long, w long")
    for parts in ("2", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {r.id: r for r in scan_by_ranges(df, ["k"], ["v", "id"], {"w": "run"}, {"w": "all"}, {"v": "last", "id": "last_id"}).collect()}
        assert len(got) == len(data)
        for k in {r[0] for r in data}:
            own, run, last = sorted((v, i, w) for key, v, i, w in data if key == k), 0, (None, None)
            total = sum(w for *_, w in own)
            for v, i, w in own:
                run += w
                assert (got[i].run, got[i].all, got[i].last, got[i].last_id) == (run, total, *last)
                last = (v, i)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_hot_group_is_split_into_ranges(spark):
    df = spark.createDataFrame(rows(2), "k int, v double, id long, w long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    hot = scan_by_ranges(df, ["k"], ["v", "id"], {"w": "run"}).filter("k = 1")
    assert hot.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    # windows are over groups and ranges; only the row that a range hands on meets by group alone
    text = scan_by_ranges(df, ["k"], ["v", "id"], {"w": "run"})._jdf.queryExecution().optimizedPlan().toString()
    alone = [line for line in text.splitlines() if "Window [" in line and "_part" not in line.split("[")[-2] and "_s_" not in line]
    assert not alone


def test_weighted_median_of_a_hot_group(spark):
    data = rows(3)
    got = {r.k: r.wmedian for r in robust.weighted_median(spark.createDataFrame(data, "k int, v double, id long, w double".replace("w double", "w long")), ["k"], "v", "w", ["id"]).collect()}
    for k in {r[0] for r in data}:
        own = sorted((v, i, max(w, 0)) for key, v, i, w in data if key == k)
        total, acc, want = sum(w for *_, w in own), 0, own[len(own) // 2][0]
        for v, _, w in own:
            acc += w
            if total > 0 and acc >= 0.5 * total:
                want = v
                break
        assert got[k] == want


def test_grid_step_without_keys(spark):
    values = [10.0 * i for i in range(50)] + [10.0 * i + 3 for i in range(5)]
    df = spark.createDataFrame([(v,) for v in values + values], "v double")
    assert [r.step for r in grid.grid_step(df, "v").collect()] == [10]


def test_velocities_with_equal_times(spark):
    poses = [(0, i, t, 10.0 * i) for i, t in enumerate([0.0, 1.0, 1.0, 3.0])] + [(1, 9, 5.0, 0.0)]
    df = spark.createDataFrame(poses, "strip int, oid long, et double, Xs double").selectExpr("*", "0D AS Ys", "0D AS Zs", "0D AS phi", "0D AS omega", "0D AS kappa")
    got = {r.oid: r.VX for r in observations.trajectory_series(df, ["strip"], tie=["oid"]).collect()}
    assert got == {0: 10.0, 1: None, 2: 5.0, 3: None, 9: None}


def test_quantiles_by_ranks_through_each_query(spark, data, monkeypatch):
    names = ["ag5_stage_metrics", "ag5b_grid_metrics", "w9_roi_centres", "j22_median_nearest_gap"]
    want = {n: sorted(map(repr, catalog.queries()[n](spark, data).collect())) for n in names}
    monkeypatch.setattr(robust, "HELD", 100)
    for n in names:
        assert sorted(map(repr, catalog.queries()[n](spark, data).collect())) == want[n]


def test_lines_of_a_file_are_numbered_over_ranges(spark):
    from tieplane.sources import text

    df = spark.createDataFrame([(i % 2, 7 * i % 300, str(i)) for i in range(300)], "f int, o int, value string")
    out = text.numbered(df, F.col("f").cast("string"), ["o"])
    want = {(str(f), k): v for f in (0, 1) for k, (_, v) in enumerate(sorted((7 * i % 300, str(i)) for i in range(300) if i % 2 == f), 1)}
    assert {(r.file, r.line): r.value for r in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert all("_part" in line for line in plan.splitlines() if "Window [row_number" in line or "Window [sum(_one" in line)


def test_large_groups_are_counted_in_bins_not_moved(spark, monkeypatch):
    rng = np.random.default_rng(8)
    values = {None: np.exp(rng.normal(0, 9, 5000)), 1: np.round(rng.normal(0, 3, 4000), 1), 2: np.full(3000, 7.0), 3: rng.normal(0, 1, 40)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs], "k int, v double")
    monkeypatch.setattr(robust, "HELD", 100)
    monkeypatch.setattr(robust, "BINS", 8)
    monkeypatch.setattr(robust, "FEW", 20)
    shares = [0.0, 0.31, 0.5, 1.0]
    scan = robust.scan_by_ranges
    monkeypatch.setattr(robust, "ROUNDS", 60)
    monkeypatch.setattr(robust, "scan_by_ranges", None)
    got = {r.k: r.q for r in robust.exact_quantiles(df, ["k"], "v", shares, "q").collect()}
    assert set(got) == set(values) and all(np.allclose(got[k], np.quantile(vs, shares), rtol=1e-12) for k, vs in values.items())
    monkeypatch.setattr(robust, "scan_by_ranges", scan)
    ends = spark.createDataFrame([(float(v),) for v in [float("inf"), -float("inf"), *range(299)]], "v double")
    assert robust.exact_quantiles(ends, [], "v", [0.5], "q").first().q == [149.0]  # infinite values: by ranges
