"""Queries on patches: arrays of 8 by 8 samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patch as Z
from . import proxies as P
from .proxies import r6
from .registry import query

C = F.col
SIDE, N = 8, 64

#: Each patch with the next of its tile.
_NEXT = "WITH nx AS (SELECT pid, ccd, patch::DOUBLE[] AS a, lead(patch) OVER (PARTITION BY ccd ORDER BY pid)::DOUBLE[] AS b FROM patches), pr AS (SELECT * FROM nx WHERE b IS NOT NULL)"


def _pairs(spark, sf_dir):
    from pyspark.sql import Window as W

    p = P.patches(spark, sf_dir).withColumn("b", F.lead("patch").over(W.partitionBy("ccd").orderBy("pid")))
    return p.filter("b IS NOT NULL").select("pid", "ccd", C("patch").alias("a"), "b")


def _zncc(a: str, b: str, floor: str = "1e-12") -> str:
    s, d = (lambda x: f"list_sum({x})"), (lambda x, y: f"list_dot_product({x}, {y})")
    va, vb = (f"({d(x, x)} - {s(x)} * {s(x)} / {N})" for x in (a, b))
    return f"(({d(a, b)} - {s(a)} * {s(b)} / {N}) / sqrt(greatest({va}, {floor}) * greatest({vb}, {floor})))"


@query("z1_zncc", _NEXT + f"SELECT pid, round({_zncc('a', 'b')}, 6) + 0.0 AS s FROM pr")
def z1(spark, sf_dir):
    return _pairs(spark, sf_dir).select("pid", r6(Z.zncc(C("a"), C("b"))).alias("s"))


_W = "[" + ", ".join(f"{w!r}::DOUBLE" for w in Z.centre_weights(SIDE)) + "]"
_SW = repr(float(sum(Z.centre_weights(SIDE))))


def _mul(x, y):
    return f"list_transform({x}, lambda v, i: v * {y}[i])"


@query("z2_weighted_zncc", _NEXT + f""", w AS (SELECT *, {_mul('a', _W)} AS wa, {_mul('b', _W)} AS wb FROM pr), t AS (SELECT pid, list_sum(wa) AS sa, list_sum(wb) AS sb, list_dot_product(wa, a) AS qa, list_dot_product(wb, b) AS qb, list_dot_product(wa, b) AS ab FROM w)
SELECT pid, round((ab - sa * sb / {_SW}) / sqrt(greatest(qa - sa * sa / {_SW}, 1e-12) * greatest(qb - sb * sb / {_SW}, 1e-12)), 6) + 0.0 AS s FROM t""")
def z2(spark, sf_dir):
    return _pairs(spark, sf_dir).select("pid", r6(Z.weighted_zncc(C("a"), C("b"), Z.centre_weights(SIDE))).alias("s"))


def _grad(x):
    cells = []
    for r in range(SIDE):
        for c in range(SIDE):
            i = r * SIDE + c + 1
            parts = ([f"abs({x}[{i + 1}] - {x}[{i}])"] if c + 1 < SIDE else []) + ([f"abs({x}[{i + SIDE}] - {x}[{i}])"] if r + 1 < SIDE else [])
            cells.append(" + ".join(parts) or "0.0::DOUBLE")
    return "[" + ", ".join(cells) + "]"


@query("z4_score_blend", _NEXT + f", g AS (SELECT *, {_grad('a')} AS ga, {_grad('b')} AS gb FROM pr) SELECT pid, round(0.90 * {_zncc('a', 'b')} + 0.10 * {_zncc('ga', 'gb')}, 6) + 0.0 AS s FROM g")
def z4(spark, sf_dir):
    g = _pairs(spark, sf_dir).withColumns({"ga": Z.gradient_patch(C("a"), SIDE), "gb": Z.gradient_patch(C("b"), SIDE)})
    return g.select("pid", r6(Z.score_blend(Z.zncc(C("a"), C("b")), Z.zncc(C("ga"), C("gb")))).alias("s"))


def _bits(x):
    return f"list_transform({x}, lambda v, i: CASE WHEN i <> 37 AND v < {x}[37] THEN 1 ELSE 0 END)"


@query("z5_census", _NEXT + f""", s AS (SELECT pid, a, b, 1.0 - 2.0 * list_sum(list_transform({_bits('a')}, lambda v, i: CASE WHEN v <> ({_bits('b')})[i] THEN 1 ELSE 0 END)) / 63.0 AS sig FROM pr)
SELECT pid, round(sig, 6) + 0.0::DOUBLE AS sig, round(0.8 * sig + 0.2 * {_zncc('a', 'b')}, 6) + 0.0 AS score FROM s""")
def z5(spark, sf_dir):
    sig = Z.census_similarity(Z.census(C("a"), SIDE), Z.census(C("b"), SIDE), N - 1)
    return _pairs(spark, sf_dir).withColumn("sig", sig).select("pid", r6(C("sig")).alias("sig"), r6(Z.score_census(C("sig"), Z.zncc(C("a"), C("b")))).alias("score"))


@query("j2_exhaustive_argmax", f"""WITH m AS (SELECT pid, ccd, patch::DOUBLE[] AS a FROM patches), p AS (SELECT l.pid, r.pid AS rid, round({_zncc('l.a', 'r.a')}, 9) AS s FROM m l JOIN m r ON l.ccd = r.ccd AND l.pid <> r.pid)
SELECT pid, rid, round(s, 6) + 0.0 AS s FROM p WHERE s >= 0.1 QUALIFY row_number() OVER (PARTITION BY pid ORDER BY s DESC, rid) = 1""")
def j2(spark, sf_dir):
    from ..operators.matching import best_by_patch

    p = P.patches(spark, sf_dir)
    out = best_by_patch(p.select("ccd", "pid", C("patch").alias("lpatch")), p.select("ccd", C("pid").alias("rid"), C("patch").alias("rpatch")), ["ccd"], 0.1, but_itself=True)
    return out.select("pid", "rid", r6(C("score")).alias("s"))
