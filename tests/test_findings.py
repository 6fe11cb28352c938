"""What larger tables and odd places showed: points off the sphere, ties, longitudes beyond a turn."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tieplane.functions import geometry as geo
from tieplane.plans import catalog


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    """Events of users far beyond those of the small tables, so that their rays miss the sphere."""
    path = tmp_path_factory.mktemp("far")
    rows = ", ".join(f"({i}, TIMESTAMP '2024-01-01 00:00:00' + to_microseconds({us}::BIGINT), {u}, '{kind}', {v}, '{{\"k\": {i % 97}}}')" for i, (us, u, kind, v) in enumerate(
        ((i * 977_773_331 + 30_000 * (2 * i + 1) * (i % 2)) % 2_500_000_000_000, (i * 37) % 90 if i % 3 else 1500 + 881 * i, ("view", "error", "click")[i % 5 % 3], round(i * 0.37 % 50, 2)) for i in range(300)))
    duckdb.sql(f"COPY (SELECT e::BIGINT AS event_id, t AS ts, u::BIGINT AS user_id, k AS event_type, v::DOUBLE AS value, p AS props FROM (VALUES {rows}) x(e, t, u, k, v, p)) TO '{path}/events.parquet'")
    return str(path)


def same_as_sql(spark, far, name):
    con = duckdb.connect()
    for table in ("events", "lineitem", "orders", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{far if table == 'events' else '/root/testdata/sf0.001'}/{table}.parquet'")
    df = catalog.queries()[name](spark, far)
    want = con.execute(f"SELECT {', '.join(f'"{c}"' for c in df.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


def test_a_place_that_is_null_has_no_latitude(spark):
    lat, lon, h = geo.to_lat_lon(F.col("x"), F.col("x"), F.col("x"))
    assert tuple(spark.createDataFrame([(None,)], "x double").select(lat, lon, h).first()) == (None, None, None)


@pytest.mark.parametrize("name", ["b9_feature_ground_places", "pr28_footprint"])
def test_rays_that_miss_the_sphere(spark, far, name):
    same_as_sql(spark, far, name)


def test_points_beside_the_sphere(spark, far):
    same_as_sql(spark, far, "b3_forward_intersection")


@pytest.mark.parametrize("name", ["b4_block_adjustment", "b6_interior_calibration"])
def test_rays_without_numbers_are_no_observations(spark, far, name):
    same_as_sql(spark, far, name)


def test_lines_round_ties_as_their_sql(spark, tmp_path):
    path = str(tmp_path)
    duckdb.sql(f"COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01 00:00:00' + to_microseconds(30030000 + i * 60000) AS ts, i AS user_id, 'view' AS event_type, 1.0::DOUBLE AS value, '{{\"k\": 7}}' AS props FROM range(200) t(i)) TO '{path}/events.parquet'")
    same_as_sql(spark, path, "sk3_match_lines")


def test_block_means_do_not_hang_on_the_order_of_sums(spark):
    from tieplane.operators import grid

    values = [81.24, 90.59, 38.19, 56.64, 37.83, 7.51]  # their mean is 52; added in this order, less
    df = spark.createDataFrame([(0, 0, v) for v in values], "r long, c long, v double").coalesce(1)
    assert grid.block_mean(df, 4, "v").first().v == 52


def test_longitudes_beyond_a_turn(spark, far):
    same_as_sql(spark, far, "pr19_geodetic")


def test_copies_of_points_are_not_broadcast(spark, data):
    df = catalog.queries()["j3_band_argmax"](spark, data)
    df.collect()
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_settled_rays_are_not_carried_on(spark, monkeypatch):
    from tieplane.operators import observations

    written, keep = [], observations.kept
    monkeypatch.setattr(observations, "kept", lambda d: (lambda k: written.append(k.count()) or k)(keep(d)))
    dem = spark.createDataFrame([(r, c, float(c % 2) * 5000) for r in range(19) for c in range(37)], "r int, c int, h double")
    aim = lambda i: (1.0, i * 2e-2, 0.0)
    rays = spark.createDataFrame([(i, *aim(i), -4e6, 0.0, 0.0) for i in range(60)] + [(99, 0.0, 0.0, 1.0, -4e6, 0.0, 0.0)], "pid long, d0 double, d1 double, d2 double, o0 double, o1 double, o2 double")
    out = observations.ray_dem(rays, ["pid"], dem, 19, 37, rounds=8, every=1).collect()
    assert sorted(r.pid for r in out) == [*range(60), 99] and [r.x for r in out if r.pid == 99] == [None]
    assert written[0] == 61 and written[-1] < 61


def test_adjustment_stops_once_nothing_moves_and_keeps_its_plan_small(spark, data, monkeypatch):
    from tieplane.operators import triangulate

    seen, block, held = [], triangulate.block_adjustment, triangulate.held
    monkeypatch.setattr(triangulate, "block_adjustment", lambda *a, **k: seen.append(block(*a, **k)) or seen[-1])
    monkeypatch.setattr(triangulate, "held", lambda d, *a: seen.append(d) or held(d, *a))
    catalog.queries()["b5_jitter_adjustment"](spark, data)
    assert len(seen[1][1]) < 5  # exact rays: Gauss-Newton is done in a few rounds, whatever the number of points
    assert str(seen[0]._jdf.queryExecution().optimizedPlan()).count("cos(") < 60  # poses and rotations are made once each


@pytest.mark.parametrize("name", ["z11_scale_extrema", "z11b_interest_points"])
def test_small_images_are_worked_on_together(spark, data, name):
    from tieplane.operators import detect
    from tieplane.plans import images

    d = detect._in_blocks(images.small_tiles(spark, data), 8, 2, lambda a: detect.pd.DataFrame({"block": [0], "row": [2], "col": [2], "calls": [len(a)]}), "calls long")
    calls = [r.calls for r in d.collect()]
    images_ = images.small_tiles(spark, data).select("image").distinct().count()
    assert sum(calls) == images_ and len(calls) <= 8 < images_  # one call for many images, each of them once
    same_as_sql(spark, data, name)


def test_many_points_are_searched_as_each_alone():
    import numpy as np

    from tieplane.functions import patch as Z

    rng = np.random.default_rng(5)
    left, right = rng.integers(0, 256, (2, 20, 24)).astype(float)
    a, b, n = rng.integers(0, 256, 90), rng.integers(0, 256, 90), rng.integers(1, 5, 90)
    a, b = np.r_[a, left.astype(int).ravel()[:200]], np.r_[b, right.astype(int).ravel()[:200]]
    n = np.r_[n, np.ones(200, int)]
    table, looked = Z.mutual_table(a, b, n), Z.MutualInformation(a, b, n)
    assert np.allclose(looked[np.arange(256)[:, None], np.arange(256)], table, atol=1e-12)
    pair, how = Z.Pair(left, right, "gray", looked), Z.Search(2, 1, 1, smooth=0.1, gate=3.0, mutual=0.05)
    r, c, pr, pc = rng.integers(-1, 22, (4, 300))
    found = np.stack(how.find_all(pair, r, c, pr, pc, (pr + 1.5, pc - 1.0)), axis=1)
    for k in range(300):
        one = how.find(pair, int(r[k]), int(c[k]), int(pr[k]), int(pc[k]), None, (pr[k] + 1.5, pc[k] - 1.0))
        assert (one is None and found[k, 2] == -np.inf) or tuple(found[k]) == one


def test_ranges_follow_the_rows(spark, monkeypatch):
    from tieplane.operators import joins

    seen, held = [], joins.held
    monkeypatch.setattr(joins, "RANGE", 50, raising=False)
    monkeypatch.setattr(joins, "held", lambda d, *a: seen.append(held(d, *a)) or seen[-1])
    df = spark.range(1000).selectExpr("id % 3 AS k", "(id * 7919) % 1000 AS v")
    got = joins.ranked_by_ranges(df, ["k"], ["v"], "i").collect()
    want = {(k, v): i for k in range(3) for i, v in enumerate(sorted(x * 7919 % 1000 for x in range(k, 1000, 3)))}
    assert {(r.k, r.v): r.i for r in got} == want
    assert seen[0].select("_part").distinct().count() >= 15  # not merged into few as the bytes allow


def test_rounds_of_ransac_do_not_read_their_input_again(spark, monkeypatch):
    import numpy as np

    from tieplane.operators import fit

    for name, n in (("DRAWN", 200), ("BLOCK", 150), ("STRETCH", 64), ("AT_ONCE", 640)):
        monkeypatch.setattr(fit, name, n, raising=False)
    rng, read = np.random.default_rng(3), spark.sparkContext.accumulator(0)
    x, y = rng.uniform(0, 100, (2, 900))
    z = np.where(np.arange(900) % 5 == 0, 2 * x - y + 7, rng.uniform(-500, 500, 900))  # a fifth are inliers, so 3 triples are too few
    rows = spark.createDataFrame([(i % 2, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, z, strict=True))], "g int, x double, y double, z double")

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    asked, whole = [], fit._ransac
    monkeypatch.setattr(fit, "_ransac", lambda *a: asked.append(a[-1]) or whole(*a))
    points = rows.mapInPandas(counted, rows.schema)
    sent = [tuple(sorted(fit.plane_ransac(points, ["g"], 0.5, trials=3).collect()))]
    assert read.value == 900 and len(asked) == 2  # two rounds in blocks
    monkeypatch.setattr(fit, "SENT", 0, raising=False)  # models meet their blocks in a join
    sent.append(tuple(sorted(fit.plane_ransac(points, ["g"], 0.5, trials=3).collect())))
    assert sent[0] == sent[1]
    for r in sent[0]:
        assert (round(r.a, 6), round(r.b, 6), round(r.c, 4), r.n) == (2.0, -1.0, 7.0, 450) and r.inliers >= 90


def test_rays_are_made_once(spark, data, monkeypatch):
    from tieplane.operators import observations

    seen, keep = [], observations.kept
    monkeypatch.setattr(observations, "kept", lambda d: seen.append(str(d._jdf.queryExecution().optimizedPlan())) or keep(d))
    catalog.queries()["pr16_ray_dem"](spark, data)
    assert 0 < seen[0].upper().count("SQRT(") < 60 and seen[0].upper().count("COS(") < 60
    assert seen[0].lower().count("hour(") < 5


def test_places_of_the_match_filter_are_made_once(spark, data):
    plan = str(catalog.queries()["o5_match_get"](spark, data)._jdf.queryExecution().optimizedPlan())
    assert 0 < plan.count("regexp_extract(") < 8


@pytest.mark.parametrize("name", ["o5_match_get", "j5_rematch_features"])
def test_few_points_meet_in_few_blocks(spark, data, monkeypatch, name):
    from tieplane.operators import neighbours

    seen, blocked = [], neighbours._blocked
    monkeypatch.setattr(neighbours, "_blocked", lambda *a: seen.append(blocked(*a)) or seen[-1])
    catalog.queries()[name](spark, data)
    union, group, pieces = seen[0]
    assert pieces == 1 and union.select(*group).distinct().count() <= 40  # ten tiles of no more than 2000 points, with rims
