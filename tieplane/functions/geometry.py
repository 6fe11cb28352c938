"""Frames, affine fields and the line-scan sensor model as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radius of the body in metres.
RADIUS = 3396190.0


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def trunc(x: Column) -> Column:
    """Towards zero, as a cast to an integer does."""
    return x.cast("long").cast("double")


def to_mosaic(row: Column, col: Column, r0: Column, c0: Column) -> tuple[Column, Column]:
    return row + r0, col + c0


def display(row: Column, col: Column, level: int, shown: int = 4) -> tuple[Column, Column]:
    """Coordinates of one pyramid level at the scale of another."""
    return row * (2.0**level / 2**shown), col * (2.0**level / 2**shown)


def affine(f, row: Column, col: Column) -> tuple[Column, Column]:
    f0, f1, f2, f3, f4, f5 = map(_c, f)
    return f0 * row + f1 * col + f2, f3 * row + f4 * col + f5


def affine_shift(f, r0l: Column, c0l: Column, r0r: Column, c0r: Column) -> list[Column]:
    """An affine between mosaic frames as one between the frames of a left and a right tile."""
    f0, f1, f2, f3, f4, f5 = map(_c, f)
    return [f0, f1, f2 + f0 * r0l + f1 * c0l - r0r, f3, f4, f5 + f3 * r0l + f4 * c0l - c0r]


def affine_inverse(f) -> list[Column]:
    """Null where the affine has no inverse."""
    a, b, c, d, e, g = map(_c, f)
    det = F.nullif(a * e - b * d, F.lit(0.0))
    return [e / det, -b / det, (b * g - e * c) / det, -d / det, a / det, (d * c - a * g) / det]


def affine_upsample(f, scale: float) -> list[Column]:
    f = [*map(_c, f)]
    return [f[0], f[1], f[2] * scale, f[3], f[4], f[5] * scale]


def horner(t: Column, t0: Column, coefs: list[Column]) -> Column:
    """A polynomial in t - t0 from its constant term up."""
    d, out = t - t0, coefs[-1]
    for c in reversed(coefs[:-1]):
        out = out * d + c
    return out


def fourier(t: Column, base: Column, terms: list[tuple[Column, Column]]) -> Column:
    """Sum of a_k cos(k base t) + b_k sin(k base t), k from 1."""
    out = F.lit(0.0)
    for k, (a, b) in enumerate(terms, 1):
        out = out + a * F.cos(base * t * k) + b * F.sin(base * t * k)
    return out


def line_time(row: Column, begin: Column, line_rate: Column) -> Column:
    return begin + row * line_rate


def rotation(phi: Column, omega: Column, kappa: Column) -> list[Column]:
    """Row-major 3x3 matrix of photogrammetric angles; phi counts the other way round."""
    p, w, k = -phi, omega, kappa
    sp, cp, sw, cw, sk, ck = F.sin(p), F.cos(p), F.sin(w), F.cos(w), F.sin(k), F.cos(k)
    return [cp * ck - sp * sw * sk, -(cp * sk) - sp * sw * ck, -(sp * cw), cw * sk, cw * ck, -sw, sp * ck + cp * sw * sk, -(sp * sk) + cp * sw * ck, cp * cw]


def focal_plane(sample: Column, binning: Column, tdi: Column, io: list[Column]) -> tuple[Column, Column]:
    """Pixel to focal plane with radial distortion; io: x0 x_s x_l y0 y_s y_l k0 k1 k2."""
    s = (sample - 0.5) * binning - 1024.0
    line = tdi / 2.0 - 64.0 - (binning / 2.0 - 0.5)
    x, y = io[0] + io[1] * s + io[2] * line, io[3] + io[4] * s + io[5] * line
    r2 = x * x + y * y
    d = io[6] + io[7] * r2 + io[8] * r2 * r2
    return x - d * x, y - d * y


def detector(xp: Column, yp: Column, binning: Column, tdi: Column, io: list[Column]) -> tuple[Column, Column]:
    """Focal plane to (line offset, sample): the linear part inverted after undoing the distortion once."""
    r2 = xp * xp + yp * yp
    d = io[6] + io[7] * r2 + io[8] * r2 * r2
    x, y = xp + d * xp - io[0], yp + d * yp - io[3]
    det = F.nullif(io[1] * io[5] - io[2] * io[4], F.lit(0.0))
    s, line = (x * io[5] - y * io[2]) / det, (y * io[1] - x * io[4]) / det
    return line - (tdi / 2.0 - 64.0 - (binning / 2.0 - 0.5)), (s + 1024.0) / binning + 0.5


def ray(r: list[Column], xp: Column, yp: Column, f: Column) -> list[Column]:
    return [r[3 * i] * xp + r[3 * i + 1] * yp + r[3 * i + 2] * f for i in range(3)]


def ray_sphere(direction: list[Column], origin: list[Column], radius: Column) -> list[Column]:
    """The nearer intersection (the root of smaller magnitude); null where the ray misses."""
    a, b, c = ray_products(direction, origin)
    t = nearer(a, b, sphere_root(a, b, c, radius))
    return [t * d + o for d, o in zip(direction, origin, strict=True)]


def ray_products(direction: list[Column], origin: list[Column]) -> tuple[Column, Column, Column]:
    """The three sums that a ray's way to any sphere hangs on."""
    a = sum((d * d for d in direction[1:]), direction[0] * direction[0])
    b = 2.0 * sum((d * o for d, o in zip(direction[1:], origin[1:], strict=True)), direction[0] * origin[0])
    return a, b, sum((o * o for o in origin[1:]), origin[0] * origin[0])


def sphere_root(a: Column, b: Column, c: Column, radius: Column) -> Column:
    """The root of the discriminant; null where the ray misses."""
    disc = b * b - 4.0 * a * (c - radius * radius)
    return F.when(disc >= 0, F.sqrt(disc))


def nearer(a: Column, b: Column, root: Column) -> Column:
    """How far along the ray the root of smaller magnitude is."""
    one, two = (-b + root) / 2.0 / a, (-b - root) / 2.0 / a
    return F.when(one * one > two * two, two).otherwise(one)


def ray_plane(direction: list[Column], origin: list[Column], z: float = 0.0) -> list[Column]:
    t = (F.lit(z) - origin[2]) / F.nullif(direction[2], F.lit(0.0))
    return [t * d + o for d, o in zip(direction, origin, strict=True)]


def ground_to_focal(r: list[Column], origin: list[Column], ground: list[Column], f: Column) -> tuple[Column, Column]:
    """Collinearity: the transposed rotation applied to the ray, scaled to the focal length."""
    d = [g - o for g, o in zip(ground, origin, strict=True)]
    v = [r[i] * d[0] + r[3 + i] * d[1] + r[6 + i] * d[2] for i in range(3)]
    scale = f / F.nullif(v[2], F.lit(0.0))
    return scale * v[0], scale * v[1]


def to_lat_lon(x: Column, y: Column, z: Column, radius: float = RADIUS) -> tuple[Column, Column, Column]:
    """Degrees and height; null where the place is null (``greatest`` and ``least`` would skip it) or the centre."""
    rho = F.sqrt(x * x + y * y + z * z)
    sine = z / F.nullif(rho, F.lit(0.0))
    return F.degrees(F.asin(F.when(sine.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sine))))), F.degrees(F.atan2(y, x)), rho - radius


def from_lat_lon(lat: Column, lon: Column, h: Column, radius: float = RADIUS) -> tuple[Column, Column, Column]:
    la, lo, rho = F.radians(lat), F.radians(lon), h + radius
    return rho * F.cos(la) * F.cos(lo), rho * F.cos(la) * F.sin(lo), rho * F.sin(la)


def to_geodetic(x: Column, y: Column, z: Column, a: float, flattening: float, rounds: int = 12) -> tuple[Column, Column, Column]:
    """Latitude, longitude (degrees) and height on an ellipsoid by fixed-point rounds, which end far below 1e-10; a loop inside one
    expression. Places on the axis have longitude 0."""
    e2 = flattening * (2 - flattening)
    p = F.sqrt(x * x + y * y)
    prime = lambda lat: a / F.sqrt(1.0 - e2 * F.sin(lat) * F.sin(lat))
    lat = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.atan2(z, p * (1.0 - e2)), lambda lat, _: F.atan2(z + e2 * prime(lat) * F.sin(lat), p))
    made = F.get(F.transform(F.array(lat), lambda v: F.struct(v.alias("lat"), (p * F.cos(v) + z * F.sin(v) - a * F.sqrt(1.0 - e2 * F.sin(v) * F.sin(v))).alias("h"))), F.lit(0))
    return F.degrees(made["lat"]), F.degrees(F.atan2(y, x)), made["h"]


def in_turn_of(lon: Column, told: Column) -> Column:
    """A longitude counted in the turn of a told one: the same direction, within half a turn of it."""
    return lon + 360.0 * F.rint((told - lon) / 360.0)


def from_geodetic(lat: Column, lon: Column, h: Column, a: float, flattening: float) -> tuple[Column, Column, Column]:
    la, lo, e2 = F.radians(lat), F.radians(lon), flattening * (2 - flattening)
    n = a / F.sqrt(1.0 - e2 * F.sin(la) * F.sin(la))
    return (n + h) * F.cos(la) * F.cos(lo), (n + h) * F.cos(la) * F.sin(lo), (n * (1.0 - e2) + h) * F.sin(la)


def local_frame(x: Column, y: Column, z: Column, cx: Column, cy: Column, cz: Column, radius: float = RADIUS, exaggeration: float = 5.0) -> tuple[Column, Column, Column]:
    """East, north about a centre, and the exaggerated height over the sphere instead of up."""
    rho = F.sqrt(cx * cx + cy * cy + cz * cz)
    flat = F.nullif(F.sqrt(cx * cx + cy * cy), F.lit(0.0))
    so, co, sa, ca = cy / flat, cx / flat, cz / rho, flat / rho
    dx, dy, dz = x - cx, y - cy, z - cz
    return -(so * dx) + co * dy, -(sa * co * dx) - sa * so * dy + ca * dz, (F.sqrt(x * x + y * y + z * z) - radius) * exaggeration


def quaternion(r: list[Column]) -> list[Column]:
    """w, x, y, z with w >= 0, from the branch whose divisor is largest."""
    t = r[0] + r[4] + r[8]
    s = [2.0 * F.sqrt(F.greatest(F.lit(0.0), x)) for x in (1.0 + t, 1.0 + r[0] - r[4] - r[8], 1.0 + r[4] - r[0] - r[8], 1.0 + r[8] - r[0] - r[4])]
    s = [F.nullif(x, F.lit(0.0)) for x in s]
    q = [
        [s[0] / 4.0, (r[7] - r[5]) / s[0], (r[2] - r[6]) / s[0], (r[3] - r[1]) / s[0]],
        [(r[7] - r[5]) / s[1], s[1] / 4.0, (r[1] + r[3]) / s[1], (r[2] + r[6]) / s[1]],
        [(r[2] - r[6]) / s[2], (r[1] + r[3]) / s[2], s[2] / 4.0, (r[5] + r[7]) / s[2]],
        [(r[3] - r[1]) / s[3], (r[2] + r[6]) / s[3], (r[5] + r[7]) / s[3], s[3] / 4.0],
    ]
    pick = lambda i: F.when(t > 0, q[0][i]).when((r[0] > r[4]) & (r[0] > r[8]), q[1][i]).when(r[4] > r[8], q[2][i]).otherwise(q[3][i])
    sign = F.when(pick(0) < 0, -1.0).otherwise(1.0)
    return [pick(i) * sign for i in range(4)]


def gaussian(d: Column, sigma: float) -> Column:
    return F.exp(-(d * d) / (2.0 * sigma * sigma))


def inverse_square(d2: Column) -> Column:
    return F.lit(1.0) / (d2 + 1.0)


def decay(d: Column, length: float = 400.0) -> Column:
    return F.exp(-d / length)


def clock_seconds(text: Column, ticks: float = 65536.0) -> Column:
    """Seconds of a spacecraft clock string such as 3/1307904494:30287; null for anything else."""
    main = F.regexp_extract(text, r"^(?:\d+/)?(\d+)(?::\d+)?$", 1)
    sub = F.regexp_extract(text, r":(\d+)$", 1)
    return F.when(main != "", main.cast("double") + F.when(sub != "", sub.cast("double")).otherwise(0.0) / ticks)
