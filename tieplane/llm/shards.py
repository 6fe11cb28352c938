"""Balanced label propagation of documents to shards, in DataFrame operations only."""

from __future__ import annotations

import itertools
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import HEAVY, Scratch, ranked

SHARDS = 16
#: Rounds go on while each cuts the number of cut edges by this share at least.
GAIN = 0.001
#: Share of its capacity by which a shard may be overfull between rounds, so that moves needn't all be swaps.
SLACK = 0.03
#: Requests of a pair of shards are granted bucket by bucket, the largest gains first.
BUCKETS = 64


def grant(requests: list, room: dict[int, int], shards: int) -> list[tuple[int, int, int, float]]:
    """Shares of requests that keep every shard within its room.

    ``requests`` has (source, target, bucket, documents). First what two shards ask of each other is swapped, then
    what more shards ask of each other in a ring; then the room of each target is given to the source that asks
    most, what that source gives up to the one that asks most of it, and so on. At most shards**2 * BUCKETS figures.
    """
    left: Counter = Counter()
    for s, t, _, n in requests:
        left[s, t] += n
    quota: Counter = Counter()

    def push(edges: list[tuple[int, int]], most: int) -> int:
        n = min([most, *(left[e] for e in edges)])
        for e in edges:
            left[e] -= n
            quota[e] += n
        return n

    def ring(start: int) -> list[tuple[int, int]]:
        """The edges of a shortest ring through a shard, or none."""
        came, queue = {}, [start]
        for s in queue:
            for t in range(shards):
                if left[s, t] > 0 and t not in came:
                    came[t] = s
                    queue.append(t)
                    if t == start:
                        path, at = [], t
                        while not path or at != start:
                            path.append((came[at], at))
                            at = came[at]
                        return path
        return []

    total = sum(left.values())
    for s, t in sorted(left):
        if left[s, t] and left[t, s]:
            push([(s, t), (t, s)], total)
    for s in range(shards):
        while path := ring(s):
            push(path, total)
    for end in sorted(room, key=lambda t: (-room[t], t)):
        free = room[end]
        while free > 0:
            path, at = [], end
            while asking := [s for s in range(shards) if left[s, at] > 0 and s != end and all(s != x for x, _ in path)]:
                s = max(asking, key=lambda x: (left[x, at], -x))
                path.append((s, at))
                at = s
            if not path:
                break
            free -= push(path, free)
    out = []
    for s, t, bucket, n in sorted(requests):
        got = min(n, quota[s, t])
        quota[s, t] -= got
        if got:
            out.append((s, t, bucket, got / n))
    return out


def balanced_shards(docs: DataFrame, shards: int = SHARDS, gain: float = GAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deals documents to shards whose row counts differ by one at most, with linked documents together.

    Documents are linked if their texts are equal; a text stands for the hub of its documents, so links are
    never listed pair by pair. Documents start dealt in turn. In each round every (text, shard) fragment looks at
    the shard with most of the text's documents and asks to move there; a join with the granted quotas
    moves whole fragments, or part of one that is larger than its quota. Quotas are the swaps that two
    shards or a ring of them ask of each other plus the room of targets, which is their capacity and SLACK less
    their linked documents. Rounds end when nothing is granted or a round gains less than ``gain`` of the cut edges. In the end what is past a capacity, and all documents without links, fill what is left. A text with more documents than fit in one
    shard has as many homes as it needs, its fullest shards.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, law ('rows'), shard, slot (gapless in a shard),
    grown_shard (null). A null text has size 1 and the crc32 of no bytes, and no links. Repeated rows are
    documents of their own; very long texts count as one row each, like any; ties are broken by hash, so results do not
    depend on partitions; a null id is allowed; an empty table gives no rows; other columns are ignored, whatever their names.
    Ranks are computed in two levels, so no task holds a shard or a text's documents as a whole.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    text = F.col(text_col).cast("string")
    base = docs.select(
        F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("hub"),
    )
    base = scratch.keep(base, "base")
    n = base.count()
    blocks = max(64, min(4 * HEAVY, n // 20_000))
    base = base.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(blocks)).cast("int"))
    start = scratch.keep(ranked(base, [], "block", ["doc_id", "hub"], "place").withColumn("label", F.pmod("place", F.lit(shards)).cast("int")).drop("place"), "start")
    capacity = {s: n // shards + (s < n % shards) for s in range(shards)}

    hubs = start.filter("hub IS NOT NULL").groupBy("hub", "label").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy("hub"))
    state = scratch.keep(hubs.withColumn("total", total).filter("total > 1"), "state0")
    load = {r.label: r.n for r in state.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    cut = None
    for k in itertools.count(1):
        room = {s: max(0, capacity[s] + int(capacity[s] * SLACK) - load.get(s, 0)) for s in range(shards)}
        by_size = W.partitionBy("hub").orderBy(F.desc("n"), F.desc(F.xxhash64("hub", "label")))
        homes = F.ceil(F.col("total") / max(1, min(capacity.values())))
        view = state.withColumn("rank", F.row_number().over(by_size)).withColumn("home", F.col("rank") <= homes)
        inviting = F.col("home") & (F.col("n") < F.array(*(F.lit(capacity[s]) for s in range(shards)))[F.col("label")])
        best = view.groupBy("hub").agg(F.sort_array(F.collect_list(F.when(inviting, F.struct((-F.col("rank")).alias("order"), "n", "label"))), asc=False).alias("best"))  # at most ``shards`` of them
        chosen = F.get("best", F.pmod(F.col("rank") - 1, F.greatest(F.size("best"), F.lit(1))))
        asks = view.join(best, "hub").withColumn("to", F.when(~F.col("home"), chosen)).select(
            "hub", "label", "n", "total", F.col("to.label").alias("target"), F.col("to").isNotNull().alias("moves"),
            (F.greatest(F.lit(0), F.lit(15) - F.floor(F.log2("to.n"))).cast("int") * 4 + F.pmod(F.xxhash64("hub"), F.lit(4)).cast("int")).alias("bucket"),
        )
        asks = scratch.keep(asks, f"asks{k}")
        wanted = [(r.label, r.target, r.bucket, r.n) for r in asks.filter("moves").groupBy("label", "target", "bucket").agg(F.sum("n").alias("n")).collect()]
        granted = grant(wanted, room, shards)
        if not granted:
            break
        quotas = F.broadcast(spark.createDataFrame(pd.DataFrame(granted, columns=["label", "target", "bucket", "share"]), "label int, target int, bucket int, share double"))  # at most shards**2 * BUCKETS rows
        moved = asks.join(quotas, ["label", "target", "bucket"], "left").withColumn("go", F.when(F.col("moves"), F.floor(F.col("n") * F.coalesce("share", F.lit(0.0)) + 1e-9)).otherwise(0).cast("long"))
        parts = F.array(F.struct(F.col("label").alias("label"), (F.col("n") - F.col("go")).alias("n")), F.struct(F.col("target").alias("label"), F.col("go").alias("n")))
        after = moved.select("hub", "total", F.inline(parts)).filter("n > 0").groupBy("hub", "label", "total").agg(F.sum("n").alias("n"))
        state = scratch.keep(after.select("hub", "label", "n", "total"), f"state{k}")
        load = {r.label: r.n for r in state.groupBy("label").agg(F.sum("n").alias("n")).collect()}
        before, cut = cut, state.groupBy("hub").agg((F.first("total") - F.max("n")).alias("cut")).agg(F.coalesce(F.sum("cut"), F.lit(0))).first()[0]
        if before is not None and cut > before * (1 - gain):
            break

    # documents of a text take its fragments in turn: ranks of a text's documents by (text, block) meet the intervals
    spans = state.groupBy("hub").agg(F.sort_array(F.collect_list(F.struct("label", "n"))).alias("f"), F.max("total").alias("total"))
    upto = F.transform(F.sequence(F.lit(1), F.size("f")), lambda i: F.struct(F.element_at("f", i)["label"].alias("label"), F.aggregate(F.slice("f", 1, i), F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("hi")))
    cells = start.filter("hub IS NOT NULL").groupBy("hub", "block").agg(F.count(F.lit(1)).alias("cell")).join(spans.select("hub", upto.alias("spans")), "hub")
    before = F.coalesce(F.sum("cell").over(W.partitionBy("hub").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select("hub", "block", "spans", before.alias("first"))
    inner = F.row_number().over(W.partitionBy("hub", "block").orderBy("doc_id")) - 1
    placed = start.withColumn("inner", inner).join(cells, ["hub", "block"], "left")
    place = F.col("first") + F.col("inner")
    linked = placed.withColumn("shard", F.when(F.col("spans").isNotNull(), F.filter("spans", lambda x: x["hi"] > place)[0]["label"]))
    linked = scratch.keep(linked.select("doc_id", "size", "text_crc32", "hub", "block", "shard"), "linked")
    if any(load.get(s, 0) > capacity[s] for s in range(shards)):  # what is past a shard's capacity is dealt like documents without links
        cap = F.array(*(F.lit(capacity[s]) for s in range(shards)))
        past = ranked(linked.filter("shard IS NOT NULL"), ["shard"], "block", ["hub", "doc_id"], "place")
        kept = past.withColumn("shard", F.when(F.col("place") < cap[F.col("shard")], F.col("shard"))).drop("place")
        linked = scratch.keep(kept.unionByName(linked.filter("shard IS NULL")), "within")
        load = {s: min(load.get(s, 0), capacity[s]) for s in range(shards)}
    ends, filled = [], 0
    for s in range(shards):
        filled += capacity[s] - load.get(s, 0)
        ends.append(filled)
    free = ranked(linked.filter("shard IS NULL").drop("shard"), [], "block", ["doc_id", "hub"], "place")
    into = F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= F.col("place")))
    dealt = linked.filter("shard IS NOT NULL").unionByName(free.withColumn("shard", into.cast("int")).drop("place"))
    # free documents went to shards in the order of their blocks; slots need blocks that cut across that
    dealt = scratch.keep(dealt.withColumn("block", F.pmod(F.xxhash64("text_crc32", "doc_id"), F.lit(blocks)).cast("int")), "dealt")
    out = ranked(dealt, ["shard"], "block", ["doc_id", "hub"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def cut_edges(placed: DataFrame) -> tuple[int, int, int]:
    """What the result of ``balanced_shards`` cuts: the documents that share their text with others; how many of them are
    not in the shard with most of their text's documents; and how many not in the fullest shards that their
    text needs at the least, which is 0 if nothing is cut without need."""
    capacity = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    texts = placed.filter("size > 1").groupBy("text_crc32", "size", "shard").agg(F.count(F.lit(1)).alias("n"))
    texts = texts.groupBy("text_crc32", "size").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list("n"), asc=False).alias("f")).filter("n > 1")  # a figure a shard
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    homes = F.slice("f", 1, F.ceil(F.col("n") / capacity).cast("int"))
    r = texts.agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in (F.col("n"), F.col("n") - F.get("f", F.lit(0)), F.col("n") - total(homes)))).first()
    return r[0], r[1], r[2]
