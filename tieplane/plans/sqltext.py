"""Pieces of SQL that several queries state their results with."""

from __future__ import annotations


def solved(source: str, keys: str, a, b, n: int) -> str:
    """CTEs that solve symmetric n by n systems by elimination: from ``source`` with ``keys`` and the cells a(i, j), i <= j,
    and b(i), to ``xs`` with the keys, the least pivot and x0..x{n-1}. Cells are scaled by the diagonal first."""
    cells = [(i, j) for i in range(n) for j in range(i, n)]
    out = ["sc AS (SELECT *, " + ", ".join(f"sqrt(greatest({a(i, i)}, 1e-300)) AS sc{i}" for i in range(n)) + f" FROM {source})"]
    first = [f"{a(i, j)} / sc{i} / sc{j} AS m{i}_{j}" for i, j in cells] + [f"{b(i)} / sc{i} AS v{i}" for i in range(n)]
    kept = ", ".join(f"sc{i}" for i in range(n))
    out.append(f"g0 AS (SELECT {keys}, {kept}, " + ", ".join(first) + " FROM sc)")
    for k in range(n - 1):
        at = lambda i, j: f"m{min(i, j)}_{max(i, j)}"
        cols = [f"m{i}_{j}" if i <= k else f"m{i}_{j} - {at(k, i)} / m{k}_{k} * {at(k, j)} AS m{i}_{j}" for i, j in cells]
        cols += [f"v{i}" if i <= k else f"v{i} - {at(k, i)} / m{k}_{k} * v{k} AS v{i}" for i in range(n)]
        out.append(f"g{k + 1} AS (SELECT {keys}, {kept}, " + ", ".join(cols) + f" FROM g{k})")
    last = f"g{n - 1}"
    for k in range(n - 1, -1, -1):
        rest = "".join(f" - m{k}_{j} * y{j}" for j in range(k + 1, n))
        out.append(f"h{k} AS (SELECT *, (v{k}{rest}) / m{k}_{k} AS y{k} FROM {last})")
        last = f"h{k}"
    out.append(f"xs AS (SELECT {keys}, least(" + ", ".join(f"m{k}_{k}" for k in range(n)) + ") AS least_pivot, " + ", ".join(f"y{k} / sc{k} AS x{k}" for k in range(n)) + f" FROM {last})")
    return ", ".join(out)


def observed(source: str, radius: float = 3396190.0, f: float = 11995.48) -> str:
    """CTEs from ``source`` (any columns, and px, py before distortion, phi, omega, kappa, xo, yo, zo) to ``ob`` with xp, yp and the
    ground point gx, gy, gz on the sphere."""
    d = "(1e-4 + 2e-6 * (px * px + py * py) + 3e-9 * (px * px + py * py) * (px * px + py * py))"
    return f"""oa AS (SELECT *, px - {d} * px AS xp, py - {d} * py AS yp, -phi AS p FROM {source}),
om_ AS (SELECT *, cos(p)*cos(kappa) - sin(p)*sin(omega)*sin(kappa) AS r0, -(cos(p)*sin(kappa)) - sin(p)*sin(omega)*cos(kappa) AS r1, -(sin(p)*cos(omega)) AS r2, cos(omega)*sin(kappa) AS r3, cos(omega)*cos(kappa) AS r4, -sin(omega) AS r5,
  sin(p)*cos(kappa) + cos(p)*sin(omega)*sin(kappa) AS r6, -(sin(p)*sin(kappa)) + cos(p)*sin(omega)*cos(kappa) AS r7, cos(p)*cos(omega) AS r8 FROM oa),
od AS (SELECT *, r0*xp + r1*yp + r2*{f} AS da, r3*xp + r4*yp + r5*{f} AS db, r6*xp + r7*yp + r8*{f} AS dc FROM om_),
oq AS (SELECT *, da*da + db*db + dc*dc AS qa, 2.0 * (da*xo + db*yo + dc*zo) AS qb, xo*xo + yo*yo + zo*zo - {radius!r}::DOUBLE * {radius!r} AS qc FROM od),
os AS (SELECT *, CASE WHEN qb*qb - 4.0*qa*qc >= 0 THEN sqrt(qb*qb - 4.0*qa*qc) END AS root FROM oq),
ot AS (SELECT *, (-qb + root) / 2.0 / qa AS ta, (-qb - root) / 2.0 / qa AS tb FROM os),
ob AS (SELECT *, CASE WHEN ta*ta > tb*tb THEN tb ELSE ta END * da + xo AS gx, CASE WHEN ta*ta > tb*tb THEN tb ELSE ta END * db + yo AS gy, CASE WHEN ta*ta > tb*tb THEN tb ELSE ta END * dc + zo AS gz FROM ot)"""


def window(image: str, r: str, c: str, half: int = 1, side: int = 8) -> str:
    """The samples of a square about (r, c) of a row-major list."""
    return "[" + ", ".join(f"{image}[({r} + {i}) * {side} + {c} + {j} + 1]" for i in range(-half, half + 1) for j in range(-half, half + 1)) + "]"


def correlation(a: str, b: str, n: int) -> str:
    s, d = (lambda x: f"list_sum({x})"), (lambda x, y: f"list_dot_product({x}, {y})")
    # about the means, as the kernels have it
    x, y = (f"list_transform({z}, lambda t: t - {s(z)} / {n})" for z in (a, b))
    return f"({d(x, y)} / sqrt(greatest({d(x, x)}, 1e-12) * greatest({d(y, y)}, 1e-12)))"


def places(points: str, reach: int, stride: int = 1, half: int = 1, side: int = 8) -> str:
    """CTEs from ``points`` (pid, r, c, pr, pc and the images a, b) to ``ca``: the score s of each place rr, cc = pr + i, pc + j."""
    steps = f"(SELECT unnest(range({-reach}, {reach + 1}, {stride})) AS i)"
    fits = " AND ".join(f"{x} BETWEEN {half} AND {side - 1 - half}" for x in ("pr + p.i", "pc + q.i", "r", "c"))
    n = (2 * half + 1) ** 2
    return f"""cw AS (SELECT {points}.*, p.i AS i, q.i AS j, pr + p.i AS rr, pc + q.i AS cc, {window('a', 'r', 'c', half, side)} AS wa, {window('b', '(pr + p.i)', '(pc + q.i)', half, side)} AS wb FROM {points}, {steps} p, {steps} q WHERE {fits}),
ca AS (SELECT * EXCLUDE (wa, wb), {correlation('wa', 'wb', n)} AS s FROM cw)"""
