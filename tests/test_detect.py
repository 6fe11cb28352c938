import numpy as np
import pytest

from tieplane.operators import detect


def image(seed=1, shape=(70, 90)):
    rng = np.random.default_rng(seed)
    a = rng.uniform(0, 20, shape)
    for r, c, s in ((20, 31, 3.0), (33, 32, 2.5), (50, 64, 3.5), (31, 63, 2.0)):  # some lie on the seams of blocks of 32
        i, j = np.mgrid[: shape[0], : shape[1]]
        a += 120 * np.exp(-((i - r) ** 2 + (j - c) ** 2) / (2 * s * s))
    return a


def lines(spark, images):
    return spark.createDataFrame([(k, r, [float(x) for x in a[r]]) for k, a in enumerate(images) for r in range(len(a))], "image int, row long, samples array<double>")


@pytest.mark.parametrize("run, columns", [(lambda d, size: detect.scale_extrema(d, least=4.0, size=size), ("image", "row", "col", "level")), (lambda d, size: detect.interest_points(d, size=size), ("image", "row", "col"))])
def test_cut_images_give_what_whole_ones_give(spark, run, columns):
    d = lines(spark, [image(1), image(2, (40, 33))])
    found = [{tuple(r[c] for c in columns) for r in run(d, size).collect()} for size in (128, 32)]
    assert found[0] == found[1] and len(found[0]) > 3


def test_planted_blobs_are_extrema(spark):
    got = {(r.row, r.col) for r in detect.scale_extrema(lines(spark, [image(3)]), least=8.0, size=32).collect()}
    assert all(any(abs(r - a) <= 1 and abs(c - b) <= 1 for a, b in got) for r, c in ((20, 31), (33, 32), (50, 64)))


def test_a_corner_is_a_point_of_interest_and_an_edge_is_none(spark):
    a = np.zeros((40, 40))
    a[15:, 15:] = 100.0
    got = [(r.row, r.col) for r in detect.interest_points(lines(spark, [a]), size=16).collect()]
    assert got and all(abs(r - 14) <= 2 and abs(c - 14) <= 2 for r, c in got)


def test_flat_small_and_empty_images(spark):
    d = lines(spark, [np.full((30, 30), 7.0), np.full((1, 3), 1.0)])
    for run in (detect.scale_extrema, detect.interest_points):
        flat = run(d)
        assert run(d.limit(0)).collect() == [] and all(r.image == 0 for r in flat.collect())
    assert detect.scale_extrema(d).collect() == []
