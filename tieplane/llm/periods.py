"""Periodic runs of words: repeated k-grams leave the stretches that may hold runs; these are searched by halves.

A run of period q and at least max(6, 4q) words equals itself q words on, so each of its words lies in a 5-gram (the
least overlap) that stands twice in the document. All other words are masked. What survives is searched as Main and
Lorentz do: a run that crosses the middle of a stretch has a square on one side of it, whatever its period; the
halves are searched the same way, and all stretches of a batch at once.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import mix

#: A run has at least REPEATS periods and SHORTEST words.
REPEATS, SHORTEST = 4, 6
#: Words of any run that stand again a period later, at least.
OVERLAP = min(max(SHORTEST, REPEATS * q) - q for q in range(1, SHORTEST + 1))
#: Words that are searched at once, about; a document is never cut.
SLICE = 1 << 18
_BASE = 0x9E3779B97F4A7C15


class Prints:
    """Hashes of stretches of words: equal stretches have equal ones. They only choose what is compared word by word."""

    def __init__(self, words: np.ndarray):
        up = np.cumprod(np.r_[np.uint64(1), np.full(len(words), _BASE, np.uint64)], dtype=np.uint64)
        self.down = np.cumprod(np.r_[np.uint64(1), np.full(len(words), pow(_BASE, -1, 1 << 64), np.uint64)], dtype=np.uint64)
        self.sums = np.r_[np.uint64(0), np.cumsum(mix(words.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)]

    def of(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * self.down[start]


def surviving(words: np.ndarray, document: np.ndarray, prints: Prints) -> tuple[np.ndarray, np.ndarray]:
    """First and end of the stretches of words that lie in 5-grams standing twice in their document."""
    n, k = len(words), OVERLAP
    if n < SHORTEST:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(document[: n - k + 1] == document[k - 1 :])
    gram = mix(prints.of(at, k)) + mix(document[at].astype(np.uint64))
    order = np.argsort(gram, kind="stable")
    same = gram[order[1:]] == gram[order[:-1]]
    twice = np.zeros(n + 1, np.int32)
    hit = at[order[np.r_[same, False] | np.r_[False, same]]]
    np.add.at(twice, hit, 1)
    np.add.at(twice, hit + k, -1)
    covered = np.cumsum(twice)[:n] > 0
    edge = covered & np.r_[True, ~covered[:-1] | (document[1:] != document[:-1])]
    stop = covered & np.r_[~covered[1:] | (document[1:] != document[:-1]), True]
    first, end = np.flatnonzero(edge), np.flatnonzero(stop) + 1
    long = end - first >= SHORTEST
    return first[long], end[long]


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """Words in which two stretches agree from their front on."""
    at, step, n = 0, 64, min(len(a), len(b))
    while at < n:
        odd = np.flatnonzero(a[at : at + step] != b[at : at + step][: n - at])
        if len(odd):
            return at + int(odd[0])
        at, step = at + step, 2 * step
    return n


def runs_of(words: np.ndarray, first: np.ndarray, end: np.ndarray, prints: Prints) -> list[tuple[int, int, int]]:
    """All runs (first, end, period) in the stretches [first, end)."""
    found: list[tuple[int, int, int]] = []
    low, high, left, right = first, end, first, end  # halves, and the stretches that they are of
    while len(low):
        middle = (low + high) // 2
        most = (high - low) // REPEATS
        m, lo, hi = (np.repeat(x, most) for x in (middle, left, right))
        p = np.arange(len(m)) - np.repeat(np.cumsum(most) - most, most) + 1
        squares = []
        for start in (m, m - 2 * p):  # a run of four periods has two of them on one side of the middle
            fit = np.flatnonzero((start >= lo) & (start + 2 * p <= hi))
            fit = fit[prints.of(start[fit], p[fit]) == prints.of(start[fit] + p[fit], p[fit])]
            squares.append((start[fit], p[fit], lo[fit], hi[fit], m[fit]))
        start, p, lo, hi, m = (np.concatenate(x) for x in zip(*squares, strict=True))
        order = np.lexsort((p, m))
        start, p, lo, hi, m = start[order], p[order], lo[order], hi[order], m[order]
        open_ = np.ones(len(p), bool)
        for s, e, q in found:  # squares inside a known run are of multiples of its period
            a, b = np.searchsorted(m, [s, e + 1])
            open_[a:b] &= (start[a:b] < s) | (start[a:b] + 2 * p[a:b] > e) | (p[a:b] % q != 0)
        start, p, lo, hi, m = start[open_], p[open_], lo[open_], hi[open_], m[open_]
        edges = np.r_[np.flatnonzero(np.diff(m, prepend=-1)), len(m)].tolist()
        for a, b in zip(edges, edges[1:], strict=False):
            at = np.arange(a, b)
            while len(at):
                x, q, s, e = int(start[at[0]]), int(p[at[0]]), int(lo[at[0]]), int(hi[at[0]])
                at = at[1:]
                if _agree(words[x : x + q], words[x + q : x + 2 * q]) < q:
                    continue
                s = x - _agree(words[s:x][::-1], words[s + q : x + q][::-1])
                e = x + 2 * q + _agree(words[x + 2 * q : e], words[x + q : e - q])
                at = at[(start[at] < s) | (start[at] + 2 * p[at] > e) | (p[at] % q != 0)]
                if e - s >= max(SHORTEST, REPEATS * q):
                    found.append((s, e, q))
        low, high, left, right = np.r_[low, middle], np.r_[middle, high], np.r_[left, left], np.r_[right, right]
        keep = high - low >= SHORTEST
        low, high, left, right = low[keep], high[keep], left[keep], right[keep]
    return sorted(set(found))


def document_runs(documents: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """For each document's words its runs (start, length, period), by start, then period."""
    table: dict[bytes, int] = defaultdict(count().__next__)
    sizes = [len(d) for d in documents]
    words = np.fromiter((table[w] for d in documents for w in d), np.int64, sum(sizes))
    begin = np.cumsum(sizes) - sizes
    prints = Prints(words)
    first, end = surviving(words, np.repeat(np.arange(len(sizes)), sizes), prints)
    out: list[list] = [[] for _ in documents]
    for s, e, q in runs_of(words, first, end, prints):
        d = int(np.searchsorted(begin, s, side="right")) - 1
        out[d].append((s - int(begin[d]), e - s, q))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    if runs:
        drop = bytearray(len(words))
        for start, length, q in runs:
            drop[start + q : start + length] = b"\1" * (length - q)
        words = [w for w, gone in zip(words, drop, strict=True) if not gone]
    return b" ".join(words)


def _digests(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    numbers = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(runs), *numbers, hashlib.sha256(listed).hexdigest(), hashlib.sha256(collapsed(words, runs)).hexdigest()


def _slices(texts: list[bytes]) -> Iterator[list[list[bytes]]]:
    part, total = [], 0
    for text in texts:
        part.append(text.split())
        total += len(part[-1])
        if total >= SLICE:
            yield part
            part, total = [], 0
    if part:
        yield part


COLUMNS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 5 + [pa.string()] * 2
    for batch in batches:
        rows = [_digests(w, r) for part in _slices(batch.column(1).to_pylist()) for w, r in zip(part, document_runs(part), strict=True)]
        cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", *(c.split()[0] for c in COLUMNS.split(", "))])


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [collapsed(w, r) for part in _slices(batch.column(1).to_pylist()) for w, r in zip(part, document_runs(part), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["doc_id", "text"])


def _bytes(docs: DataFrame, doc: str, text: str) -> DataFrame:
    return docs.select(F.col(doc).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))


def periodic_runs(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Returns per row of ``docs``: doc_id, the number of its runs, the longest one (start, length, period, exponent in
    thousandths; nulls without a run) and the digests of all runs and of the text without their repeats.

    Words are what white space (0x20, 0x09 to 0x0D) leaves. A null text is an empty one; of it, of a blank one and of one
    with fewer than six words no run is told; texts of any length are searched whole; of runs of one length the first counts;
    repeated rows and a null doc_id are kept as they are; other columns are ignored; an empty table stays empty.
    Documents depend on nothing but themselves, so there is no shuffle.
    """
    kind = docs.schema[doc].dataType.simpleString()
    return _bytes(docs, doc, text).mapInArrow(_found, f"doc_id {kind}, {COLUMNS}")


def collapse_runs(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Returns (doc_id, text) with each run cut to its first period and words joined by one space; cases as in
    ``periodic_runs``."""
    kind = docs.schema[doc].dataType.simpleString()
    return _bytes(docs, doc, text).mapInArrow(_collapsed, f"doc_id {kind}, text binary").withColumn("text", F.col("text").cast("string"))


def with_planted_runs(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text), where a tenth of the documents, by the crc32 of their id, has words made periodic from some
    place on. Documents without an id or without words stay as they are."""
    words = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size("words")
    a = F.pmod("g", n)
    p = F.expr("1 + int((size(words) - a) div (3 + pmod(g, 8)))")
    periodic = F.expr("concat(slice(words, 1, a), slice(flatten(array_repeat(slice(words, a + 1, p), int(ceil((size(words) - a) / p)))), 1, size(words) - a))")
    base = docs.select(F.col(doc).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumns({"h": h, "g": g})
    some = base.filter("h % 10 = 0").withColumn("words", words).filter(n > 0).withColumn("a", a.cast("int")).withColumn("p", p).select("doc_id", F.concat_ws(" ", periodic).alias("text"))
    rest = base.filter(F.expr("h IS NULL OR h % 10 <> 0") | ~F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("doc_id", "text")
    return some.unionByName(rest)
