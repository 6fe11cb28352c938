"""Exact nearest descriptors by inverted lists, and homographies of matched places by consensus.

Lists hold the rows nearest to one of some centres, which are fitted to a bounded sample. A query looks into its nearest lists first; by the
triangle inequality the distance it then has tells which other lists may hold anything nearer, and these are looked into as well. So
results are those of comparing all pairs, whatever the centres.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import held

#: Rows that centres are fitted to, at most; rows of a list that one task holds, about.
SAMPLE, PIECE = 20_000, 20_000


def centres_of(sample: np.ndarray, count: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Centres by Lloyd's rounds from rows drawn with a seed."""
    rng = np.random.default_rng(seed)
    c = sample[rng.permutation(len(sample))[:count]].astype(float)
    for _ in range(rounds):
        own = _squares(sample, c).argmin(axis=1)
        for k in np.unique(own):
            c[k] = sample[own == k].mean(axis=0)
    return c


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (a * a).sum(axis=1)[:, None] - 2.0 * a @ b.T + (b * b).sum(axis=1))


def nearest_descriptors(queries: DataFrame, rows: DataFrame, k: int = 2, lists: int = 64, probes: int = 4, id_col: str = "id", vector: str = "v", apart: bool = True) -> DataFrame:
    """Of each query (id, v) its ``k`` nearest rows: id, rid, rank from 1, d2 (six digits), of equal distances the smaller rid; with ``apart`` a
    row of the query's own id is none.

    Rows whose vector is null, holds nulls or has another length than most are left out; fewer rows than ``k`` give fewer; an empty side gives none.
    """
    spark = rows.sparkSession
    named = lambda d, i, v: d.select(F.col(id_col).cast("long").alias(i), F.col(vector).cast("array<double>").alias(v)).filter(F.col(v).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)))
    r, q = named(rows, "rid", "rv"), named(queries, "qid", "qv")
    width = r.groupBy(F.size("rv").alias("w")).count().orderBy(F.desc("count"), "w").first()
    schema = "qid long, rid long, d2 double"
    if width is None:
        return spark.createDataFrame([], "id long, rid long, rank int, d2 double")
    r, q = r.filter(F.size("rv") == width.w), q.filter(F.size("qv") == width.w)
    share = min(1.0, SAMPLE / max(1, width["count"]))
    drawn = r.filter(F.pmod(F.xxhash64("rid"), F.lit(1 << 20)) < share * (1 << 20)).limit(2 * SAMPLE).toPandas()  # a bounded sample
    sample = np.stack(drawn.sort_values("rid")["rv"].to_numpy()) if len(drawn) else np.zeros((1, width.w))
    centres = spark.sparkContext.broadcast(centres_of(sample, min(lists, len(sample))))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                d = _squares(np.stack(pdf["rv"].to_numpy()), centres.value)
                yield pdf.assign(list=d.argmin(axis=1).astype(np.int32), away=np.sqrt(d.min(axis=1)))

    filed = held(r.mapInPandas(assign, "rid long, rv array<double>, list int, away double"), "lists")
    facts = {x.list: (x.far, x.n) for x in filed.groupBy("list").agg(F.max("away").alias("far"), F.count(F.lit(1)).alias("n")).collect()}  # as many as centres
    known = np.array(sorted(facts))
    far, pieces = np.array([facts[k_][0] for k_ in known]), {int(k_): -(-facts[k_][1] // PIECE) for k_ in known}
    split = F.create_map(*(F.lit(x) for k_, n in pieces.items() for x in (k_, n)))
    filed = filed.withColumn("piece", F.pmod(F.xxhash64("rid"), split[F.col("list")]).cast("int"))

    def wanted(first: bool):
        """The lists that a query looks into: the nearest ones, or those that may hold something nearer than its ``reach``."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf):
                    continue
                d = np.sqrt(_squares(np.stack(pdf["qv"].to_numpy()), centres.value[known]))
                rank = d.argsort(axis=1, kind="stable").argsort(axis=1)
                hit = rank < probes
                if not first:
                    slack = 1e-6 * (1.0 + d)
                    hit = ~hit & (d - far <= np.sqrt(pdf["reach"].to_numpy())[:, None] + slack)
                i, j = np.nonzero(hit)
                out = pdf[["qid", "qv"]].iloc[i].assign(list=known[j].astype(np.int32))
                yield out.assign(pieces=[pieces[x] for x in out["list"]])

        return run

    def compare(keys: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame(columns=["qid", "rid", "d2"])
        b = b.sort_values("rid")
        x, y, out = np.stack(a["qv"].to_numpy()), np.stack(b["rv"].to_numpy()), []
        ids = b["rid"].to_numpy()
        for lo in range(0, len(x), 256):
            d = _squares(x[lo : lo + 256], y)
            if apart:
                d[a["qid"].to_numpy()[lo : lo + 256, None] == ids] = np.inf
            most = min(k + 8, d.shape[1])  # rounding can't move a row by more places than that, bar ties, which are exact
            near = np.argpartition(d, most - 1, axis=1)[:, :most]
            exact = ((x[lo : lo + 256, None, :] - y[near]) ** 2).sum(axis=2).round(6)
            exact[np.isinf(np.take_along_axis(d, near, axis=1))] = np.inf
            out.append(pd.DataFrame({"qid": np.repeat(a["qid"].to_numpy()[lo : lo + 256], most), "rid": ids[near].ravel(), "d2": exact.ravel()}))
        found = pd.concat(out)
        found = found[np.isfinite(found["d2"])].sort_values(["qid", "d2", "rid"])
        return found.groupby("qid", sort=False).head(k)

    def looked(asked: DataFrame) -> DataFrame:
        dealt = asked.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        return dealt.groupBy("list", "piece").cogroup(filed.groupBy("list", "piece")).applyInPandas(compare, schema)

    best = F.slice(F.array_sort(F.collect_list(F.struct("d2", "rid"))), 1, k)  # of a query's k of each piece it looked into
    one = held(looked(q.mapInPandas(wanted(True), "qid long, qv array<double>, list int, pieces int")).groupBy("qid").agg(best.alias("b")), "first")
    reach = F.when(F.size("b") == k, F.element_at("b", -1)["d2"]).otherwise(F.lit(float("inf")))
    rest = q.join(one.select("qid", reach.alias("reach")), "qid", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
    two = looked(rest.mapInPandas(wanted(False), "qid long, qv array<double>, list int, pieces int"))
    both = one.select("qid", F.inline("b")).select("qid", "rid", "d2").unionByName(two)
    final = both.groupBy("qid").agg(best.alias("b")).select(F.col("qid").alias("id"), F.posexplode("b").alias("_p", "_b"))
    return final.select("id", F.col("_b.rid").alias("rid"), (F.col("_p") + 1).alias("rank"), F.col("_b.d2").alias("d2"))


def distinct_matches(nearest: DataFrame, ratio: float = 0.8) -> DataFrame:
    """Matches whose nearest row is nearer than ``ratio`` times the second: id, rid, d2. A query with one row only has no second and stays."""
    pair = nearest.groupBy("id").agg(F.max(F.when(F.col("rank") == 1, F.struct("rid", "d2"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("d2"))).alias("b"))
    fine = F.col("b").isNull() | (F.col("a.d2") < ratio * ratio * F.col("b"))
    return pair.filter(F.col("a").isNotNull() & fine).select("id", F.col("a.rid").alias("rid"), F.col("a.d2").alias("d2"))


def through_fours(p: np.ndarray, q: np.ndarray, trials: int, seed: int) -> np.ndarray:
    """Homographies (the last entry 1) through seeded fours of places; fours with three on a line give none."""
    if len(p) < 4:
        return np.empty((0, 9))
    pick = np.random.default_rng(seed).integers(0, len(p), (trials, 4))
    x, y, u, v = p[pick][..., 0], p[pick][..., 1], q[pick][..., 0], q[pick][..., 1]
    one, zero = np.ones_like(x), np.zeros_like(x)
    a = np.concatenate([np.stack([x, y, one, zero, zero, zero, -u * x, -u * y], axis=2), np.stack([zero, zero, zero, x, y, one, -v * x, -v * y], axis=2)], axis=1)
    fine = np.abs(np.linalg.det(a)) > 1e-6
    h = np.linalg.solve(a[fine], np.concatenate([u, v], axis=1)[fine][..., None])[..., 0]
    return np.c_[h, np.ones(len(h))]


def mapped(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    w = h[6] * p[:, 0] + h[7] * p[:, 1] + h[8]
    return np.stack([h[0] * p[:, 0] + h[1] * p[:, 1] + h[2], h[3] * p[:, 0] + h[4] * p[:, 1] + h[5]], axis=1) / np.where(np.abs(w) < 1e-12, 1e-12, w)[:, None]


def homographies(matches: DataFrame, keys: list[str], sigma: float = 3.0, trials: int = 500, drawn: int = 2000, seed: int = 0) -> DataFrame:
    """One homography per group of places (row, col) and (mrow, mcol): keys, h (nine, the last 1), n, inliers of all rows.

    Fours come from about ``drawn`` hash-chosen rows of a group, which also choose the best; it is fitted again to its inliers among them. Groups
    of fewer than four places, or on a line, get none. All rows are counted, where they lie.
    """
    point = ["row", "col", "mrow", "mcol"]
    kinds = {f.name: f.dataType.simpleString() for f in matches.schema.fields}
    named = "".join(f"{k} {kinds[k]}, " for k in keys)
    d = matches.select(*keys, *(F.col(c).cast("double").alias(c) for c in point)).dropna(subset=point)
    size = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    even = F.pmod(F.xxhash64(*point, F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    some = d.join(size, keys).filter(even * F.col("_n") < drawn)

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(point)
        a, b = pdf[["row", "col"]].to_numpy(), pdf[["mrow", "mcol"]].to_numpy()
        shift = (a.mean(axis=0), max(a.std(), 1e-9), b.mean(axis=0), max(b.std(), 1e-9))
        p, q = (a - shift[0]) / shift[1], (b - shift[2]) / shift[3]
        models = through_fours(p, q, trials, seed)
        if not len(models):
            return pd.DataFrame(columns=[*keys, "h"])
        count = [int((np.hypot(*(mapped(h, p) - q).T) * shift[3] <= sigma).sum()) for h in models]
        h = models[int(np.argmax(count))]
        inside = np.hypot(*(mapped(h, p) - q).T) * shift[3] <= sigma
        if inside.sum() > 4:
            x, u = p[inside], q[inside]
            zero, one = np.zeros(len(x)), np.ones(len(x))
            m = np.r_[np.c_[x, one, zero, zero, zero, -u[:, :1] * x], np.c_[zero, zero, zero, x, one, -u[:, 1:] * x]]
            h = np.r_[np.linalg.lstsq(m, np.r_[u[:, 0], u[:, 1]], rcond=None)[0], 1.0]
        away = np.diag([1 / shift[1], 1 / shift[1], 1.0]) @ np.array([[1, 0, -shift[0][0]], [0, 1, -shift[0][1]], [0, 0, 1]])
        back = np.array([[shift[3], 0, shift[2][0]], [0, shift[3], shift[2][1]], [0, 0, 1]])
        full = back @ h.reshape(3, 3) @ away
        return pd.DataFrame([[*pdf[keys].iloc[0], (full / full[2, 2]).ravel()]], columns=[*keys, "h"])

    models = held(some.groupBy(*keys).applyInPandas(fitted, f"{named}h array<double>"), "homographies")
    h, x, y = F.col("h"), F.col("row"), F.col("col")
    w = h[6] * x + h[7] * y + h[8]
    off = F.hypot((h[0] * x + h[1] * y + h[2]) / w - F.col("mrow"), (h[3] * x + h[4] * y + h[5]) / w - F.col("mcol"))
    counted = d.join(models, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum((off <= sigma).cast("long")).alias("inliers"))
    return models.join(counted, keys)
