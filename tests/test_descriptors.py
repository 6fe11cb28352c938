import numpy as np

from tieplane.operators import descriptors


def table(spark, v, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<double>")


def brute(q, r, k, shift=0):
    out = {}
    for i, x in enumerate(q):
        d = ((r - x) ** 2).sum(axis=1).round(6)
        order = [j for j in np.lexsort((np.arange(len(r)), d)) if j != i + shift][:k]
        out[i + shift] = [(int(j), float(d[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.id, r.rank)):
        out.setdefault(r.id, []).append((r.rid, r.d2))
    return out


def test_lists_give_what_all_pairs_give(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = np.r_[rng.normal(0, 1, (300, 8)) + 6 * rng.integers(0, 5, (300, 1)), np.tile(rng.normal(0, 1, 8), (40, 1)), rng.normal(0, 50, (5, 8))].round(3)
    monkeypatch.setattr(descriptors, "PIECE", 30)
    for probes, lists in ((1, 16), (4, 3)):
        got = found(descriptors.nearest_descriptors(table(spark, v), table(spark, v), k=3, lists=lists, probes=probes))
        assert got == brute(v, v, 3)


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 2.0]), (3, None), (4, [1.0]), (5, [None, 1.0]), (6, [float("nan"), 0.0])], "id long, v array<double>")
    assert found(descriptors.nearest_descriptors(rows, rows, k=2)) == {1: [(2, 1.0)], 2: [(1, 1.0)]}
    assert descriptors.nearest_descriptors(rows, rows.limit(0)).collect() == []
    assert descriptors.nearest_descriptors(rows.limit(0), rows).collect() == []


def test_ratio(spark):
    near = spark.createDataFrame([(1, 5, 1, 1.0), (1, 6, 2, 9.0), (2, 5, 1, 4.0), (2, 7, 2, 5.0), (3, 8, 1, 1.0)], "id long, rid long, rank int, d2 double")
    assert sorted((r.id, r.rid) for r in descriptors.distinct_matches(near, 0.8).collect()) == [(1, 5), (3, 8)]


def test_planted_homographies(spark):
    rng, rows = np.random.default_rng(2), []
    truth = {0: np.array([1.02, 0.03, 5.0, -0.02, 0.98, -7.0, 1e-5, -2e-5, 1.0]), 1: np.array([0.9, 0.1, 0.0, -0.1, 1.1, 3.0, 0.0, 3e-5, 1.0])}
    for g, h in truth.items():
        p = rng.uniform(0, 2000, (3000, 2))
        q = descriptors.mapped(h, p) + rng.normal(0, 0.3, p.shape)
        q[:900] = rng.uniform(0, 2000, (900, 2))
        rows += [(g, *map(float, (*a, *b))) for a, b in zip(p, q, strict=True)]
    rows += [(2, 0.0, 0.0, 1.0, 1.0), (2, 5.0, 5.0, 6.0, 6.0), (3, None, 1.0, 1.0, 1.0)]
    got = {r.g: r for r in descriptors.homographies(spark.createDataFrame(rows, "g int, row double, col double, mrow double, mcol double"), ["g"], drawn=500).collect()}
    assert set(got) == {0, 1}
    for g, h in truth.items():
        p = rng.uniform(0, 2000, (100, 2))
        assert got[g].n == 3000 and got[g].inliers > 2050 and np.abs(descriptors.mapped(np.array(got[g].h), p) - descriptors.mapped(h, p)).max() < 1.5
