"""Removes byte strings that repeat anywhere in the corpus: suffix arrays over the places where texts may meet.

Each 200-byte string has an anchor, the least-hashed 100-byte gram in it, so equal strings have equal anchors and
meet in one group. Consecutive strings of one anchor make a segment of 200 to 300 bytes. A segment that stands twice is
repeated as a whole; the different segments of an anchor become one text, whose suffix array tells the strings that
two of them share. Where an anchor has more different segments than a task should hold, these are cut anew by the anchors of longer
grams, in the end into their strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lookup
from .shingles import mix
from .suffixes import suffix_arrays

#: Bytes of a string whose repeats are removed.
LEAST = 200
#: Bytes of an anchor, level by level; the last is the string itself.
GRAMS = (100, 160, 184, LEAST)
#: Different segments whose suffixes are sorted together, at most.
GROUP = 128
#: Bytes that are hashed at once, and of the longest piece of a text.
SLICE = 1 << 18
#: Bytes whose suffixes are sorted at once, about.
SORTED = 1 << 20
#: Bits of a filter that tells which anchors repeat; its size does not grow with the input.
FILTER_BITS = 26

_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64((1 << FILTER_BITS) - 1)
_PLACE = np.uint64((1 << 64) - (2 * SLICE))


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)], dtype=np.uint64)


class Hashes:
    """Sums of bytes times powers, so the hash of any stretch is a difference of two sums, moved to power 0."""

    def __init__(self, size: int = 2 * SLICE + 1):
        self.up, self.down = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)

    def sums(self, data: np.ndarray) -> np.ndarray:
        return np.r_[np.uint64(0), np.cumsum(_BYTE[data] * self.up[: len(data)], dtype=np.uint64)]

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def grams(self, sums: np.ndarray, size: int) -> np.ndarray:
        return mix((sums[size:] - sums[:-size]) * self.down[: len(sums) - size] + np.uint64(size))


def anchors(grams: np.ndarray, size: int) -> np.ndarray:
    """The place of the anchor of each string: the first of its least grams, by the upper bits of their hashes."""
    value = grams & _PLACE | np.arange(len(grams), dtype=np.uint64)
    width, span, least = LEAST - size + 1, 1, value
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(value) - width + 1], least[width - span :][: len(value) - width + 1])
    return (least & ~_PLACE).astype(np.int64)


def has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & _LOW  # anchors are least hashes, so only their lower bits are even
    return bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1) > 0


def slices(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches of whole texts, or pieces of a long one that overlap so that no string is lost: the bytes, and for each
    piece its text, its place in that text and its end in the bytes."""
    parts, rows, places, ends, total = [], [], [], [], 0
    for row, text in enumerate(texts):
        if len(text) < LEAST:
            continue
        for at in range(0, len(text) - LEAST + 1, SLICE - LEAST + 1):
            piece = text[at : at + SLICE] if len(text) > SLICE else text
            if total and total + len(piece) > SLICE:
                yield b"".join(parts), np.array(rows), np.array(places), np.array(ends)
                parts, rows, places, ends, total = [], [], [], [], 0
            total += len(piece)
            parts.append(piece)
            rows.append(row)
            places.append(at)
            ends.append(total)
    if total:
        yield b"".join(parts), np.array(rows), np.array(places), np.array(ends)


def segments(hashes: Hashes, data: bytes, ends: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Key, first string, end of strings and piece of each segment by anchors of ``size`` bytes, and the sums of hashes."""
    sums = hashes.sums(np.frombuffer(data, np.uint8))
    grams = hashes.grams(sums, size)
    place = anchors(grams, size)
    beyond = ends - LEAST + 1  # no string of a piece starts here
    first = np.sort(np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1, beyond, ends]))
    first = first[np.r_[True, first[1:] != first[:-1]] & (first < len(place))]
    end = np.r_[first[1:], len(place)]
    piece = np.searchsorted(ends, first, side="right")
    fits = first < beyond[piece]
    first, end, piece = first[fits], end[fits], piece[fits]
    return grams[place[first]], first, end, piece, sums


def _distinct(batch: pa.RecordBatch) -> tuple[list[bytes], list[bytes], np.ndarray]:
    """Keys and bytes of a batch's different texts, and how often each stands in it."""
    found: dict[bytes, list] = {}
    for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        if key in found:
            found[key][1] += 1
        elif len(text) >= LEAST:
            found[key] = [text, 1]
    return list(found), [t for t, _ in found.values()], np.array([n for _, n in found.values()], np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchor, hash of the segment and number of texts."""
    hashes = Hashes()
    for batch in batches:
        _, texts, copies = _distinct(batch)
        for data, rows, _, ends in slices(texts):
            key, first, end, piece, sums = segments(hashes, data, ends, GRAMS[0])
            print_ = hashes.of(sums, first, end + LEAST - 1)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(print_.view(np.int64)), pa.array(copies[rows[piece]])], ["anchor", "print", "n"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, flag in (("any", 1), ("many", 2)):
            keys = batch.column(0).to_numpy().view(np.uint64)[batch.column(1).to_numpy() >= flag]
            at = np.unique(keys & _LOW)
            word, start = np.unique(at >> np.uint64(6), return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), start) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(word), pa.string()), pa.array(word.view(np.int64)), pa.array(value.view(np.int64))], ["name", "word", "bits"])


def _filters(keys: DataFrame) -> dict[str, np.ndarray]:
    """Filters of all anchors ("any") and of those with flag 2 ("many"): 8 MB each, whatever the input."""
    words = keys.mapInArrow(_words, "name string, word long, bits long").groupBy("name", "word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = {}
    for name in ("any", "many"):
        own = words.filter(pc.equal(words["name"], name))
        out[name] = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
        out[name][own["word"].to_numpy()] = own["bits"].to_numpy().view(np.uint64)
    return out


def _digest(body: bytes) -> bytes:
    return hashlib.blake2b(body, digest_size=16).digest()


def _met(filters: dict):
    """Segments whose anchor the filters let pass: text, first string, number of strings, anchor, digest, copies in the batch,
    and once a batch the bytes where an anchor has several segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, any_, several = Hashes(), filters["any"].value, filters["many"].value
        for batch in batches:
            names, texts, copies = _distinct(batch)
            seen: set[bytes] = set()
            for data, rows, places, ends in slices(texts):
                key, first, end, piece, _ = segments(hashes, data, ends, GRAMS[0])
                at = np.flatnonzero(has(any_, key))
                key, first, end, piece = key[at], first[at], end[at], piece[at]
                begin = ends - np.diff(np.r_[0, ends])
                text, digests, bodies = rows[piece], [], []
                for a, b, m in zip(first.tolist(), end.tolist(), has(several, key).tolist(), strict=True):
                    body = data[a : b + LEAST - 1]
                    digests.append(d := _digest(body))
                    bodies.append(body if m and d not in seen else None)
                    if m:
                        seen.add(d)
                cols = [
                    pa.array([names[t] for t in text.tolist()], pa.binary()), pa.array(first - begin[piece] + places[piece]), pa.array(end - first), pa.array(key.view(np.int64)),
                    pa.array(digests, pa.binary()), pa.array(copies[text]), pa.array(bodies, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["key", "start", "strings", "anchor", "digest", "n", "body"])

    return run


def _refined(size: int):
    """Segments by anchors of ``size`` bytes inside given ones: whose part they are, from which string on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            whose, digest, n, bodies = (batch.column(k) for k in range(4))
            for data, rows, _, ends in slices(bodies.to_pylist()):
                key, first, end, piece, _ = segments(hashes, data, ends, size)
                at, begin = pa.array(rows[piece]), ends - np.diff(np.r_[0, ends])
                own = [data[a : b + LEAST - 1] for a, b in zip(first.tolist(), end.tolist(), strict=True)]
                cols = [whose.take(at), digest.take(at), pa.array(first - begin[piece]), pa.array(end - first), pa.array(key.view(np.int64)), pa.array([_digest(b) for b in own], pa.binary()), n.take(at), pa.array(own if size < LEAST else [None] * len(own), pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["whose", "part_of", "start", "strings", "anchor", "digest", "n", "body"])

    return run


def shared_strings(groups: list[list[bytes]]) -> list[list[list[tuple[int, int]]]]:
    """For each group of different segments, and each segment, the ranges [first, last] of strings that stand elsewhere
    in the group too, by the group's suffix array: neighbours that agree in LEAST bytes."""
    flat = [s for g in groups for s in g]
    size = np.array([len(s) + 1 for s in flat], np.int64)
    raw = b"\0".join(flat) + b"\0"
    symbols = np.frombuffer(raw, np.uint8).astype(np.int32) + 2
    ends = np.cumsum(size)
    begin = ends - size
    symbols[ends - 1] = 1
    last = np.cumsum([len(g) for g in groups]) - 1
    symbols[ends[last] - 1] = 0
    lengths = np.diff(np.r_[0, ends[last]])
    order = suffix_arrays(symbols, lengths)
    start = np.zeros(len(raw), bool)
    for a, n in zip(begin.tolist(), size.tolist(), strict=True):
        start[a : a + n - LEAST] = True
    whole = np.flatnonzero(start[order[:-1]] & start[order[1:]])
    group = np.repeat(np.arange(len(groups)), lengths)
    whole = whole[group[order[whole]] == group[order[whole + 1]]]
    x, y = order[whole].astype(np.int64), order[whole + 1].astype(np.int64)
    eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    for k in range(0, LEAST, 8):
        same = eight[x + k] == eight[y + k]
        if not same.all():
            x, y = x[same], y[same]
    twice = np.zeros(len(raw) + 1, bool)
    twice[x] = twice[y] = True
    edge = np.flatnonzero(np.diff(twice.astype(np.int8), prepend=0))
    out = [[] for _ in flat]
    of = np.searchsorted(ends, edge[::2], side="right")
    for s, a, b in zip(of.tolist(), edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        out[s].append((a - int(begin[s]), b - 1 - int(begin[s])))
    cut = np.r_[0, last + 1].tolist()
    return [out[a:b] for a, b in zip(cut, cut[1:], strict=False)]


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    for batch in batches:
        rows = batch.column(1).to_pylist()
        keys = batch.column(0).to_pylist()
        order = sorted(range(len(rows)), key=lambda k: sum(len(s["body"]) for s in rows[k]))  # texts of about one length advance together
        while order:
            now, total = [], 0
            while order and (not now or total < SORTED):
                now.append(order.pop())
                total += sum(len(s["body"]) for s in rows[now[-1]])
            found = shared_strings([[s["body"] for s in rows[k]] for k in now])
            out = [(keys[k], s["digest"], [{"first": a, "last": b} for a, b in spans]) for k, each in zip(now, found, strict=True) for s, spans in zip(rows[k], each, strict=True) if spans]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.binary()), pa.array([r[2] for r in out], kind)], ["anchor", "digest", "spans"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text: columns doc_id, text, copies, spans of repeated strings."""
    for batch in batches:
        n, gone, runs, kept = [], [], [], []
        for text, copies, spans in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
            if copies > 1 and len(text) >= LEAST:
                spans = [{"a": 0, "b": len(text) - LEAST}]
            left, at, cut, many = [], 0, 0, 0
            end = -1
            for s in sorted((s["a"], s["b"] + LEAST) for s in spans or ()):
                if s[0] > end:
                    if end >= 0:
                        many, cut = many + 1, cut + end - begin
                        left.append(text[at:begin])
                        at = end
                    begin, end = s
                else:
                    end = max(end, s[1])
            if end >= 0:
                many, cut = many + 1, cut + end - begin
                left.append(text[at:begin])
                at = end
            left.append(text[at:])
            n.append(len(text))
            gone.append(cut)
            runs.append(many)
            kept.append(hashlib.sha256(b"".join(left)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.int64()) for v in (n, gone, runs)), pa.array(kept, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


SPANS = "array<struct<first: long, last: long>>"


def _classes(parts: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The different segments, how often each stands in texts and in how many rows of ``parts``."""
    rows = parts.groupBy("anchor", "digest").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.first("body", ignorenulls=True).alias("body"))
    return scratch.keep(rows, name)


def _spread(parts: DataFrame, results: DataFrame, owner: list[str]) -> DataFrame:
    """The spans [a, b] of repeated strings of each owner of segments, where ``start`` is a segment's first string."""
    hits = lookup(parts, results, ["anchor", "digest"], "rows", max(1, parts.count())).filter("rows IS NOT NULL")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("first"), (F.col("strings") - 1).alias("last")))
    marks = hits.select(*owner, "start", F.explode(F.coalesce("spans", whole)).alias("s"))
    return marks.groupBy(*owner).agg(F.collect_set(F.struct((F.col("start") + F.col("s.first")).alias("a"), (F.col("start") + F.col("s.last")).alias("b"))).alias("spans"))


def _repeated(classes: DataFrame, scratch: Scratch, group: int, level: int = 0) -> DataFrame:
    """(anchor, digest, rows, spans) of the segments with a repeated string; no spans where all are."""
    out = classes.filter("n > 1").select("anchor", "digest", "rows", F.lit(None).cast(SPANS).alias("spans"))
    if level + 1 == len(GRAMS):  # each segment is one string
        return out
    sizes = classes.filter("body IS NOT NULL").groupBy("anchor").agg(F.count(F.lit(1)).alias("size"), F.sum((F.col("n") == 1).cast("long")).alias("single")).filter("size > 1 AND single > 0")
    sizes = scratch.keep(sizes, f"sizes{level}")
    met = lookup(classes.filter("body IS NOT NULL"), sizes, ["anchor"], "size", max(1, classes.count())).filter("size IS NOT NULL")
    groups = met.filter(F.col("size") <= group).groupBy("anchor").agg(F.collect_list(F.struct("digest", "body")).alias("segments"))
    found = groups.mapInArrow(_sorted_groups, f"anchor long, digest binary, spans {SPANS}")
    if not sizes.filter(F.col("size") > group).isEmpty():
        parts = met.filter(F.col("size") > group).select("anchor", "digest", "n", "body").mapInArrow(_refined(GRAMS[level + 1]), "whose long, part_of binary, start long, strings long, anchor long, digest binary, n long, body binary")
        parts = scratch.keep(parts, f"parts{level}")
        inner = scratch.keep(_repeated(_classes(parts, scratch, f"classes{level + 1}"), scratch, group, level + 1), f"inner{level}")
        spread = _spread(parts.filter("n = 1").select("whose", "part_of", "start", "strings", "anchor", "digest"), inner, ["whose", "part_of"])
        spans = F.transform("spans", lambda s: F.struct(s["a"].alias("first"), s["b"].alias("last")))
        found = found.unionByName(spread.select(F.col("whose").alias("anchor"), F.col("part_of").alias("digest"), spans.alias("spans")))
    return out.unionByName(classes.filter("n = 1").select("anchor", "digest", "rows").join(found, ["anchor", "digest"]))


def remove_repeats(docs: DataFrame, doc: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """Returns (doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per row of ``docs``: what is left of each text without
    the bytes of 200-byte strings that start anywhere else too, as judged on the input.

    A null text is an empty one; texts of fewer than 200 bytes, and an empty table, lose nothing. Equal texts, repeated rows
    among them, repeat each other, so they go wholly; a null doc_id is kept as it is; a text of any length is read whole;
    other columns are ignored, whatever their names.

    Texts are read twice: anchors are counted with partial sums, and filters of a fixed size tell the second reading which
    anchors repeat. Groups of more than ``group`` different segments are refined, so a group is a few kB. Places of a segment
    that stands very often meet its result by a bounded broadcast.
    """
    spark = docs.sparkSession
    scratch, sc = Scratch(spark, "repeats"), spark.sparkContext
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    docs = docs.select(F.col(doc).alias("doc_id"), F.unhex(F.substring(F.sha2(body, 256), 1, 32)).alias("key"), body.alias("text"))
    texts, total = docs.select("key", "text"), docs.count()
    seen = texts.mapInArrow(_counted, "anchor long, print long, n long").groupBy("anchor").agg(F.sum("n").alias("n"), F.min("print").alias("low"), F.max("print").alias("high")).filter("n > 1")
    seen = scratch.keep(seen.select("anchor", F.when(F.col("low") != F.col("high"), 2).otherwise(1).alias("flag")), "anchors")
    filters = {name: sc.broadcast(bits) for name, bits in _filters(seen).items()}
    scratch.release()
    met = scratch.keep(texts.mapInArrow(_met(filters), "key binary, start long, strings long, anchor long, digest binary, n long, body binary"), "met")
    results = scratch.keep(_repeated(_classes(met, scratch, "classes0"), scratch, group), "results")
    scratch.drop("anchors", *(f"{name}{k}" for name in ("classes", "sizes", "parts", "inner") for k in range(len(GRAMS))))
    scratch.release()
    marks = _spread(met.select("key", "start", "strings", "anchor", "digest"), results, ["key"])
    facts = docs.groupBy("key").agg(F.count(F.lit(1)).alias("copies")).join(marks, "key", "left").select("key", "copies", F.when(F.col("copies") == 1, F.col("spans")).alias("spans"))
    facts = scratch.keep(facts.filter("copies > 1 OR spans IS NOT NULL"), "facts")
    scratch.drop("results", "met")
    scratch.release()
    rows = lookup(docs, facts, ["key"], "copies", max(1, total)).select("doc_id", "text", F.coalesce("copies", F.lit(1)).alias("copies"), "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_removed, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
