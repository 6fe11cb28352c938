"""Sessions over events that arrive late: each batch's merges, with the versions they retract.

A user's time is cut into blocks. Inside a block a union-find over the events activates them batch by batch and unites each with
its active predecessor and successor within the gap; roots carry extents, counts, sums and the standing version. Sessions that can
reach a neighbouring block become nodes of a chain, two a block, whose edges activate once and for good. A global version is then a
stretch of the chain at a batch: its ends are the nearest edges not yet active, found in a hierarchy of groups of edges, and its
counts are differences of running sums over all versions in the order of their stretches. So no task holds a user.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, lookup

GAP = 600
#: Seconds of a block; more than the gap, so only neighbouring blocks can meet.
BLOCK = 86_400
#: Edges of a chain that are searched in one group.
SPAN = 256
_LOCAL = "user long, kind int, batch long, start_s long, end_s long, n long, n_new long, n_retracted long, h long, retracted_batch long, retracted_start_s long, node long"
#: Kinds of local rows: a version that is final, a change of a node, where a node's session lies, an active edge.
INNER, CHANGE, PLACE, EDGE = range(4)


def _streamed(body: Callable, schema: str) -> Callable:
    """Runs ``body`` over groups of sorted rows that agree in their first two columns; batches may cut groups."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32()}[c.split()[1]] for c in schema.split(", ")]

    def pack(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, out = chain.from_iterable(zip(*(c.to_pylist() for c in b.columns), strict=True) for b in batches), []
        for key, group in groupby(rows, key=lambda r: r[:2]):
            out += body(key, [r[2:] for r in group])
            if len(out) >= 10_000:
                yield pack(out)
                out = []
        if out:
            yield pack(out)

    return run


class Forest:
    """Union-find over a block's events in order of time."""

    def __init__(self, times: list[int], gap: int):
        n = len(times)
        self.times, self.gap = times, gap
        self.up = list(range(n))
        self.live = [False] * n
        self.first, self.last = list(range(n)), list(range(n))
        self.n, self.h, self.standing = [0] * n, [0] * n, [()] * n

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def unite(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a == b:
            return
        if self.n[a] < self.n[b]:
            a, b = b, a
        self.up[b] = a
        self.first[a], self.last[a] = min(self.first[a], self.first[b]), max(self.last[a], self.last[b])
        self.n[a] += self.n[b]
        self.h[a] += self.h[b]
        self.standing[a] += self.standing[b]

    def activate(self, i: int, n: int, h: int) -> None:
        self.live[i], self.n[i], self.h[i] = True, n, h
        t, j = self.times[i], i - 1
        while j >= 0 and t - self.times[j] <= self.gap:
            if self.live[j]:
                self.unite(i, j)
                break
            j -= 1
        j = i + 1
        while j < len(self.times) and self.times[j] - t <= self.gap:
            if self.live[j]:
                self.unite(i, j)
                break
            j += 1


def _block(gap: int) -> Callable:
    """All versions of a block's sessions. Rows are (kind, time, batch, n, h): kind 0 has the last time of the block before or,
    in batch 1, the first of the next; kind 1 has events."""

    def run(key: tuple, rows: list[tuple]) -> list[tuple]:
        user, block = key
        events = sorted(((t, b, n, h) for kind, t, b, n, h in rows if kind), key=lambda e: e[:2])
        if not events:
            return []
        past = max((t for kind, t, b, _, _ in rows if not kind and b == 0), default=None)
        next_ = min((t for kind, t, b, _, _ in rows if not kind and b == 1), default=None)
        forest = Forest([e[0] for e in events], gap)
        order = sorted(range(len(events)), key=lambda i: events[i][1])
        versions: list[list] = []  # of a version: its local row, and whether it is a node's
        out, joined = [], False
        for batch, members in groupby(order, key=lambda i: events[i][1]):
            members = list(members)
            for i in members:
                forest.activate(i, *events[i][2:])
            new: dict[int, int] = {}
            for i in members:
                r = forest.root(i)
                new[r] = new.get(r, 0) + events[i][2]
            for r, n_new in new.items():
                start, end = forest.times[forest.first[r]], forest.times[forest.last[r]]
                left, right = past is not None and start - past <= gap, next_ is not None and next_ - end <= gap
                old = [versions[v] for v in forest.standing[r]]
                node = 2 * block + (not left) if left or right else None
                inner = [o for o in old if o["node"] is None]
                for o in inner:
                    o["by"] = (batch, start if node is None else None, node)
                forest.standing[r] = (len(versions),)
                versions.append({"batch": batch, "start": start, "end": end, "n": forest.n[r], "new": n_new, "old": len(old), "h": forest.h[r], "node": node, "by": (None, None, None)})
                if node is None:
                    continue
                known = [o for o in old if o["node"] is not None]
                gain = forest.n[r] - sum(o["n"] for o in known), forest.h[r] - sum(o["h"] for o in known)
                out.append((user, CHANGE, batch, start, end, gain[0], n_new, len(inner), gain[1], None, None, node))
                out += [(user, PLACE, batch, start, end, None, None, None, None, None, None, 2 * block + side) for side, there in enumerate((left, right)) if there]
                if left and right and not joined:
                    joined = True
                    out.append((user, EDGE, batch, None, None, None, None, None, None, None, None, 2 * block))
        return out + [(user, INNER, v["batch"], v["start"], v["end"], v["n"], v["new"], v["old"], v["h"], *v["by"]) for v in versions if v["node"] is None]

    return run


def _search(span: int) -> Callable:
    """Answers the searches of a group of edges: from an edge on, upwards or downwards, the first one not active at a batch.
    Rows are (kind, edge, batch, side): kind 0 has edges and when they become active, kind 1 has searches."""

    def run(key: tuple, rows: list[tuple]) -> list[tuple]:
        user, group = key
        active = {e: b for kind, e, b, _ in rows if not kind}
        out = []
        for _, edge, batch, side in (r for r in rows if r[0]):
            e = edge
            while e // span == group and e in active and active[e] <= batch:
                e += side
            out.append((user, group, edge, batch, side, e if e // span == group else None))
        return out

    return run


def inactive(edges: DataFrame, searches: DataFrame, scratch: Scratch, span: int, depth: int = 0) -> DataFrame:
    """Adds to each search (user, edge, batch, side) the nearest edge from there on, to that side, that is not active at the batch.

    ``edges`` has (user, edge, batch): what it lacks is never active. Groups of ``span`` edges answer what they can; the
    rest goes to an edge per group, which is active when the whole group is.
    """
    of_group = F.expr(f"floor(edge / {span})").alias("part")

    def ask(these: DataFrame, label: str) -> DataFrame:
        rows = edges.select("user", of_group, F.lit(0).alias("kind"), "edge", "batch", F.lit(0).alias("side")).unionByName(these.select("user", of_group, F.lit(1).alias("kind"), "edge", "batch", "side"))
        sorted_ = rows.repartition("user", "part").sortWithinPartitions("user", "part")
        return scratch.keep(sorted_.mapInArrow(_streamed(_search(span), "user long, part long, edge long, batch long, side int, found long"), "user long, part long, edge long, batch long, side int, found long"), f"{label}{depth}")

    asked = ask(searches.distinct(), "asked")
    done, open_ = asked.filter("found IS NOT NULL"), asked.filter("found IS NULL")
    columns = ["user", "edge", "batch", "side", "found"]
    if open_.isEmpty():
        return done.select(columns)
    upper = edges.groupBy("user", of_group).agg(F.count(F.lit(1)).alias("n"), F.max("batch").alias("batch")).filter(F.col("n") == span).select("user", F.col("part").alias("edge"), "batch")
    onward = open_.select("user", (F.col("part") + F.col("side")).alias("edge"), "batch", "side").distinct()
    groups = inactive(upper, onward, scratch, span, depth + 1).withColumnRenamed("found", "there")
    start = F.col("there") * span + F.when(F.col("side") > 0, 0).otherwise(span - 1)
    last = ask(groups.select("user", start.alias("edge"), "batch", "side").distinct(), "last").select("user", F.col("edge").alias("from"), "batch", "side", "found")
    reached = groups.withColumn("from", start).join(last, ["user", "from", "batch", "side"]).select("user", F.col("edge").alias("next"), "batch", "side", "found")
    late = open_.drop("found").withColumn("next", F.col("part") + F.col("side")).join(reached, ["user", "next", "batch", "side"])
    return done.select(columns).unionByName(late.select(columns))


def _running(rows: DataFrame, order: list[str], sums: dict[str, str], scratch: Scratch, name: str) -> DataFrame:
    """Running sums over all rows in ``order``: ranges of rows are summed by themselves, then moved by the sums of the ranges before,
    of which there are as many as partitions."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = scratch.keep(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), name)
    totals = dealt.groupBy("_part").agg(*(F.sum(c).alias(f"_{c}") for c in sums))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select("_part", *(F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in sums))
    over = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    inner = dealt.withColumns({out: F.sum(c).over(over) for c, out in sums.items()})
    return inner.join(F.broadcast(bases), "_part").withColumns({out: F.col(out) + F.col(f"_{c}") for c, out in sums.items()}).drop("_part", *(f"_{c}" for c in sums))


def _stitched(local: DataFrame, scratch: Scratch, gap: int, span: int) -> tuple[DataFrame, DataFrame]:
    """The versions of sessions that reach over blocks, and the final rows of versions that these retract."""
    changes = local.filter(F.col("kind") == CHANGE).select("user", "node", "batch", F.col("n").alias("gain"), F.col("h").alias("gain_h"), "n_new", "n_retracted")
    places = local.filter(F.col("kind") == PLACE).groupBy("user", "node", "batch").agg(F.min("start_s").alias("start"), F.max("end_s").alias("end"))
    places = scratch.keep(places, "places")
    within = local.filter(F.col("kind") == EDGE).select("user", F.col("node").alias("edge"), "batch")
    sides = places.filter("node % 2 <> 0").select("user", F.col("node").alias("edge"), "batch", F.col("end").alias("a"), F.lit(None).cast("long").alias("b")).unionByName(
        places.filter("node % 2 = 0").select("user", (F.col("node") - 1).alias("edge"), "batch", F.lit(None).cast("long").alias("a"), F.col("start").alias("b"))
    )
    so_far = W.partitionBy("user", "edge").orderBy("batch").rangeBetween(W.unboundedPreceding, W.currentRow)
    between = sides.select("user", "edge", "batch", (F.min("b").over(so_far) - F.max("a").over(so_far)).alias("apart")).filter(F.col("apart") <= gap).groupBy("user", "edge").agg(F.min("batch").alias("batch"))
    edges = scratch.keep(within.unionByName(between), "edges")
    ends = edges.select("user", F.col("edge").alias("node"), "batch").unionByName(edges.select("user", (F.col("edge") + 1).alias("node"), "batch"))
    touched = scratch.keep(places.select("user", "node", "batch").unionByName(ends).distinct(), "touched")
    both = touched.select("user", "node", "batch").unionByName(touched.select("user", "node", (F.col("batch") - 1).alias("batch")))
    searches = both.select("user", (F.col("node") - 1).alias("edge"), "batch", F.lit(-1).alias("side")).unionByName(both.select("user", F.col("node").alias("edge"), "batch", F.lit(1).alias("side")))
    found = scratch.keep(inactive(edges, searches, scratch, span), "found")
    down = found.filter("side < 0").select("user", (F.col("edge") + 1).alias("node"), "batch", (F.col("found") + 1).alias("low"))
    up = found.filter("side > 0").select("user", F.col("edge").alias("node"), "batch", F.col("found").alias("high"))
    reach = scratch.keep(down.join(up, ["user", "node", "batch"]), "reach")
    earlier = reach.select("user", "node", (F.col("batch") + 1).alias("batch"), F.col("low").alias("low0"), F.col("high").alias("high0"))
    first = places.groupBy("user", "node").agg(F.min("batch").alias("since"))
    parts = touched.join(reach, ["user", "node", "batch"]).join(earlier, ["user", "node", "batch"]).join(first, ["user", "node"]).filter("since < batch")
    parts = scratch.keep(parts.select("user", "low", "high", "batch", "low0", "high0").distinct(), "parts")

    at = ["user", "low", "high", "batch"]
    made = changes.join(reach, ["user", "node", "batch"]).groupBy(*at).agg(*(F.sum(c).alias(c) for c in ("gain", "gain_h", "n_new", "n_retracted")))
    made = made.join(parts.groupBy(*at).agg(F.count(F.lit(1)).alias("_parts")), at, "left").withColumn("n_retracted", F.col("n_retracted") + F.coalesce("_parts", F.lit(0))).drop("_parts")
    made = scratch.keep(made, "made")
    total = max(1, made.count())
    lows = made.groupBy("user", "low").agg(F.count(F.lit(1)).alias("_rows"))
    marks = lows.select("user", F.col("low").alias("high"), F.lit(0).alias("kind"), F.col("low").alias("down"), F.lit(None).cast("long").alias("batch"), F.lit(0).cast("long").alias("gain"), F.lit(0).cast("long").alias("gain_h"))
    line = made.select("user", "high", F.lit(1).alias("kind"), (-F.col("low")).alias("down"), "batch", "gain", "gain_h").unionByName(marks)
    summed = scratch.keep(_running(line, ["user", "high", "kind", "down", "batch"], {"gain": "sum_n", "gain_h": "sum_h"}, scratch, "line"), "summed")
    history = places.groupBy("user", "node").agg(F.collect_list(F.struct("batch", "start", "end")).alias("history"))
    of_low = lows.join(summed.filter("kind = 0").select("user", F.col("high").alias("low"), F.col("sum_n").alias("n0"), F.col("sum_h").alias("h0")), ["user", "low"]).join(history.withColumnRenamed("node", "low"), ["user", "low"])
    full = summed.filter("kind = 1").select("user", (-F.col("down")).alias("low"), "high", "batch", "sum_n", "sum_h").join(made, at)
    then = "array_max(filter(history, p -> p.batch <= batch))"
    full = lookup(full, of_low, ["user", "low"], "_rows", total).withColumn("start", F.expr(then)["start"]).drop("history", "_rows")
    of_high = made.groupBy("user", "high").agg(F.count(F.lit(1)).alias("_rows")).join(history.withColumnRenamed("node", "high"), ["user", "high"])
    full = lookup(full, of_high, ["user", "high"], "_rows", total).withColumn("end", F.expr(then)["end"]).drop("history", "_rows")
    full = scratch.keep(full, "full")
    starts = full.select(*at, "start")
    # a version stands until the first later one that has its stretch as a part
    taken = parts.join(starts, at).select("user", F.col("low0").alias("low"), F.col("high0").alias("high"), "batch", F.lit(0).alias("kind"), F.struct(F.col("batch").alias("b"), F.col("start").alias("s")).alias("by"))
    line = full.select(*at, F.lit(1).alias("kind"), F.lit(None).cast("struct<b: long, s: long>").alias("by")).unionByName(taken)
    later = W.partitionBy("user", "low", "high").orderBy(F.desc("batch"), F.desc("kind")).rowsBetween(W.unboundedPreceding, -1)
    ended = line.withColumn("by", F.last("by", ignorenulls=True).over(later)).filter("kind = 1").drop("kind")
    versions = full.join(ended, at).select(
        "user", "batch", F.col("start").alias("start_s"), F.col("end").alias("end_s"), (F.col("sum_n") - F.col("n0")).alias("n"), "n_new", "n_retracted", (F.col("sum_h") - F.col("h0")).alias("h"), F.col("by.b").alias("retracted_batch"), F.col("by.s").alias("retracted_start_s")
    )
    inner = local.filter((F.col("kind") == INNER) & F.col("node").isNotNull()).withColumn("own", F.col("batch"))
    where = reach.join(starts, at).select("user", "node", F.col("batch").alias("retracted_batch"), F.col("start").alias("by"))
    retracted = inner.join(where, ["user", "node", "retracted_batch"]).withColumn("retracted_start_s", F.col("by"))
    return versions, retracted.select(*versions.columns)


def merge_sessions(events: DataFrame, user: str = "user", seconds: str = "seconds", batch: str = "batch", value: str = "h", gap: int = GAP, block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """Every version of every session, one row each: user, batch, start_s, end_s, n_events, n_new, n_retracted, h_sum,
    retracted_batch, retracted_start_s (all long).

    Rows whose user, seconds or batch is null are no events; a null value counts as 0; repeated rows are events of their own;
    events of one time are in one session; batches may come in any order and be as late as they like; other columns are ignored;
    an empty table gives none. A user's events are first summed by second and batch, then cut by ``block`` seconds.
    """
    if block <= gap:
        raise ValueError("a block must be longer than the gap")
    scratch = Scratch(events.sparkSession, "sessions")
    rows = events.select(F.col(user).cast("long").alias("user"), F.col(seconds).cast("long").alias("t"), F.col(batch).cast("long").alias("batch"), F.coalesce(F.col(value).cast("long"), F.lit(0)).alias("h")).filter("user IS NOT NULL AND t IS NOT NULL AND batch IS NOT NULL")
    atoms = scratch.keep(rows.groupBy("user", "t", "batch").agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("h")).withColumn("block", F.expr(f"floor(t / {block})")), "atoms")
    nothing = F.lit(0).cast("long")
    extents = atoms.groupBy("user", "block").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    hints = extents.select("user", (F.col("block") + 1).alias("block"), F.lit(0).alias("kind"), F.col("last").alias("t"), nothing.alias("batch"), nothing.alias("n"), nothing.alias("h")).unionByName(
        extents.select("user", (F.col("block") - 1).alias("block"), F.lit(0).alias("kind"), F.col("first").alias("t"), (nothing + 1).alias("batch"), nothing.alias("n"), nothing.alias("h"))
    )
    line = atoms.select("user", "block", F.lit(1).alias("kind"), "t", "batch", "n", "h").unionByName(hints).repartition("user", "block").sortWithinPartitions("user", "block")
    local = scratch.keep(line.mapInArrow(_streamed(_block(gap), _LOCAL), _LOCAL), "local")
    columns = ["user", "batch", "start_s", "end_s", "n", "n_new", "n_retracted", "h", "retracted_batch", "retracted_start_s"]
    out = local.filter((F.col("kind") == INNER) & F.col("node").isNull()).select(*columns)
    if not local.filter(F.col("kind") == CHANGE).isEmpty():
        versions, retracted = _stitched(local, scratch, gap, span)
        out = out.unionByName(versions).unionByName(retracted)
    return out.withColumnsRenamed({"n": "n_events", "h": "h_sum"}).select("user", "batch", "start_s", "end_s", "n_events", "n_new", "n_retracted", "h_sum", "retracted_batch", "retracted_start_s")


def conversation_events(conversations: DataFrame) -> DataFrame:
    """(user, seconds, batch, h) of the turns of ``conversations``: turns without a number, or of no conversation, are none."""
    crc = lambda c: F.crc32(c.cast("binary"))
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    rows = conversations.select(conv.alias("conv_id"), turn.alias("turn")).filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    rows = rows.withColumns({"c": crc(F.col("conv_id").cast("string")), "h": crc(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))})
    rows = rows.withColumns({"g": F.expr("h div 600"), "seconds": F.expr("pmod(c div 2, 7200) + 300 * turn + h % 600")})
    return rows.select(F.expr("2 * floor(conv_id / 8) + c % 2").alias("user"), "seconds", F.expr("floor(seconds / 900) + if(g % 5 = 0, g % 4, 0)").alias("batch"), "h")
