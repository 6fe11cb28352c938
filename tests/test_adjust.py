import numpy as np

from tieplane.operators import adjust, triangulate

RAYS = "point_id int, image int, et double, xp double, yp double, Xs double, Ys double, Zs double, phi double, omega double, kappa double, X double, Y double, Z double"
F_, RADIUS = 11995.48, 3.39e6


def views(images, points, seed, noise=0.0, outliers=0.0, shift=None, span=4.0):
    """Points on a sphere under a row of cameras; each is seen by two neighbours or three. The poses that are told lack ``shift``."""
    rng, rows = np.random.default_rng(seed), []
    gap = 4e4
    for i in range(points):
        at = rng.uniform(0, (images - 1) * gap)
        x = np.array([rng.uniform(-3e4, 3e4), at, 0.0])
        x[2] = np.sqrt(RADIUS**2 - x[0] ** 2 - x[1] ** 2)
        near = np.argsort(np.abs(np.arange(images) * gap - at))[: rng.integers(2, 4)]
        for im in near:
            t = rng.uniform(0, span)
            told = np.array([0.0, im * gap, np.sqrt(RADIUS**2 - (im * gap) ** 2) + 3e5, 0.001, (im * gap) / RADIUS, 0.002])
            true = told + (shift(im, t) if shift else 0)
            uv = triangulate.project(x[None], true[None], F_)[0][0]
            uv = uv + rng.normal(0, noise, 2) + (rng.normal(0, 3.0, 2) if rng.random() < outliers else 0)
            rows.append((i, int(im), float(t), *map(float, (*uv, *told, *x))))
    return rows


def test_analytic_derivatives():
    rng = np.random.default_rng(1)
    pose = np.c_[rng.normal(0, 1e5, (20, 2)), np.full(20, 3.7e6), rng.normal(0, 0.1, (20, 3))]
    x = np.c_[rng.normal(0, 1e5, (20, 2)), np.full(20, 3.39e6)]
    got = adjust.pose_derivatives(x, pose, F_)
    for q, h in enumerate([1.0] * 3 + [1e-6] * 3):
        a, b = pose.copy(), pose.copy()
        a[:, q] -= h
        b[:, q] += h
        want = (triangulate.project(x, b, F_)[0] - triangulate.project(x, a, F_)[0]) / (2 * h)
        assert np.allclose(got[:, :, q], want, rtol=1e-5, atol=1e-9)


def test_the_table_of_blocks_gives_what_the_dense_system_gives(spark):
    shift = lambda im, t: np.array([2.0, -1.0, 0.5, 1e-5, -2e-5, 1e-5]) * im * (1 + 0.3 * t)
    rays = spark.createDataFrame(views(3, 90, 2, noise=1e-3, shift=shift), RAYS)
    how = {"degree": 1, "weights": (50.0, 1e-3), "heights": (RADIUS, 1.0), "fixed": (0,), "rounds": 6}
    poses = {im: (0.0, 4.0) for im in range(3)}
    dense, _ = triangulate.block_adjustment(rays, poses, **how)
    sparse, costs = adjust.sparse_adjustment(rays, poses, tol=1e-11, **how)
    for im in range(3):
        assert np.allclose(sparse[im][:3], dense[im][:3], atol=2e-2) and np.allclose(sparse[im][3:], dense[im][3:], atol=2e-8)
    assert costs == sorted(costs, reverse=True) and not sparse[0].any()


def test_noise_and_outliers(spark):
    shift = lambda im, t: np.array([0, 0, 0, 0, 2e-5, 3e-5]) * (im == 1)
    rays = spark.createDataFrame(views(2, 400, 3, noise=0.3 * triangulate.PIXEL, outliers=0.05, shift=shift), RAYS)
    how = {"degree": 0, "weights": (1e-3, 1e-2), "heights": (RADIUS, 0.5), "fixed": (0,), "rounds": 8}
    robust, _ = adjust.sparse_adjustment(rays, {0: (0.0, 4.0), 1: (0.0, 4.0)}, loss=1.0, **how)
    plain, _ = adjust.sparse_adjustment(rays, {0: (0.0, 4.0), 1: (0.0, 4.0)}, **how)
    off = lambda th: np.abs(th[1][4:, 0] - [2e-5, 3e-5])
    assert (off(robust) < 4e-6).all() and off(robust).sum() < off(plain).sum()


def test_fifty_images_with_318_unknowns_each(spark):
    waves = tuple(0.4 + 0.3 * k for k in range(25))
    shift = lambda im, t: np.array([0, 0, 0, 0, 3e-6, 5e-6]) * (im % 2)
    rays = spark.createDataFrame(views(50, 1200, 4, noise=0.2 * triangulate.PIXEL, outliers=0.05, shift=shift), RAYS)
    theta, costs = adjust.sparse_adjustment(rays, {im: (0.0, 4.0) for im in range(50)}, degree=2, frequencies=waves, weights=(1e-2, 1e-5), heights=(RADIUS, 1.0), loss=1.0, rounds=3, tol=1e-3, most=25)
    assert theta[7].shape == (6, 53) and len(theta) == 50
    assert costs[-1] < 0.9 * costs[0]


def test_points_with_one_ray_and_nulls(spark):
    rows = views(2, 30, 5)
    lone = (900, *rows[0][1:])
    theta, costs = adjust.sparse_adjustment(spark.createDataFrame(rows + [lone, (901, 0, *[None] * 12)], RAYS), {0: (0.0, 4.0), 1: (0.0, 4.0)}, degree=0, rounds=2, heights=(RADIUS, 1.0))
    assert costs[0] < 1e-3 and np.abs(theta[1]).max() < 1e-3
