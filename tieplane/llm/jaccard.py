"""Exact n-gram Jaccard join: prefix tiles in size bands, bitmap bounds, sorted-array intersection."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HEAVY, Scratch, lookup
from .graph import components
from .shingles import batches_of, shingle_sets

#: A link is 100 * intersection >= THRESHOLD * union.
THRESHOLD = 80
#: Shingles count as common from 1/COMMON of all shingle occurrences, so there are at most COMMON of them.
COMMON, COMMON_LEAST = 1 << 20, 64
#: Entries of a run that one task sorts, about; longer runs are dealt to PIECES of them at most.
PIECE, PIECES = 512, 1 << 12
#: Entries of a run whose pairs are written down at once; those of longer runs meet in tiles.
SHORT = 64
#: Entries of a side of a tile, about.
BLOCK = 1024
#: Largest bitmap, in bits, and how many times as wide those of tiles are as those of single pairs.
WIDEST, WIDER = 1 << 16, 8
#: Shingles of a set up to which tiles know 16 bits of each, and not only a bitmap.
LISTED = 4096
#: Pairs of one set that are never split.
SPREAD = 2048
#: Bits of the filter that tells which texts' shingles are fetched.
FILTER_BITS = 24
#: Sets whose 64-bit names clash, at most: by chance there is one among 2**32.
RENAMED = 10_000


def needed(n):
    """The least intersection that a set of size n shares with any set it links to."""
    return -(-THRESHOLD * n // 100)


def set_digest(s: np.ndarray) -> bytes:
    """128 bits of BLAKE2b over the sorted shingles: what makes two texts one class."""
    return blake2b(s.tobytes(), digest_size=16).digest()


def namer(digest: Callable, renamed: frozenset = frozenset()) -> Callable:
    """The 64-bit name of a set: the first half of its digest, or where that is in ``renamed`` the second."""

    def name(s: np.ndarray) -> int:
        low, high = np.frombuffer(digest(s), np.int64).tolist()
        return high if low in renamed else low

    return name


def bitmap(s: np.ndarray, times: int = 1) -> bytes:
    """A bit per shingle, in a power of two of bits from ``times`` the set's size on."""
    width = min(WIDEST, max(64, 1 << (times * len(s) - 1).bit_length()))
    bits = np.zeros(width, np.uint8)
    bits[(s & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def may_link(n: np.ndarray, maps: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For pairs (i, j) of sets of n shingles: False only if the bitmaps prove that they share too little.

    Each bit that only one has stands for a shingle at least that the other lacks. Of bitmaps of two widths
    the wider is folded.
    """
    width = np.fromiter(map(len, maps), np.int64, len(maps))
    least, out = np.minimum(width[i], width[j]), np.zeros(len(i), bool)
    for w in np.unique(least).tolist():
        pairs = np.flatnonzero(least == w)
        used = np.unique(np.concatenate([i[pairs], j[pairs]]))
        bits = np.empty((len(used), w // 8), np.uint64)
        for own in np.unique(width[used]).tolist():
            at = np.flatnonzero(width[used] == own)
            wide = np.frombuffer(b"".join([maps[k] for k in used[at].tolist()]), np.uint64).reshape(len(at), own // w, w // 8)
            bits[at] = np.bitwise_or.reduce(wide, axis=1)
        ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        step = max(1, (1 << 22) // w)
        for lo in range(0, len(pairs), step):
            at = pairs[lo : lo + step]
            x, y = np.searchsorted(used, i[at]), np.searchsorted(used, j[at])
            both = np.bitwise_count(bits[x] & bits[y]).sum(axis=1, dtype=np.int64)
            most = both + np.minimum(n[i[at]] - ones[x], n[j[at]] - ones[y])
            out[at] = (100 + THRESHOLD) * most >= THRESHOLD * (n[i[at]] + n[j[at]])
    return out


def sketch(s: np.ndarray) -> bytes:
    """What tiles know of a set: the last 16 bits of each shingle, sorted; of more than LISTED shingles a bitmap."""
    return np.sort(s.astype(np.uint16)).tobytes() if len(s) <= LISTED else bitmap(s, WIDER)


def unlisted(n: int, fine: bytes) -> bytes:
    """The bitmap of a set of n shingles from its sketch."""
    return bitmap(np.frombuffer(fine, np.uint16), WIDER) if n <= LISTED else fine


def _stretches(x: np.ndarray) -> list[tuple]:
    """Begin and end of each stretch of equal values."""
    cuts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]).tolist() if len(x) else []
    return list(zip(cuts, [*cuts[1:], len(x)][: len(cuts)], strict=True))


def may_link_listed(n: np.ndarray, fine: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For pairs (i, j) of sets of n shingles, i ascending: False only if the lists of 16 bits prove that they share too little, as no
    shingle is common whose bits are not. Pairs without two lists pass."""
    out, used = np.ones(len(i), bool), np.unique(np.concatenate([i, j]))
    names, highest = {}, 0
    for k in used[n[used] <= LISTED].tolist():
        h = np.frombuffer(fine[k], np.uint16).astype(np.int64)
        names[k] = h + (np.arange(len(h)) - np.searchsorted(h, h)) * 65536  # of equal bits the first, second, ... are told apart
        highest = max(highest, int(names[k].max()))
    pairs = np.flatnonzero((n[i] <= LISTED) & (n[j] <= LISTED))
    has = np.zeros(highest + 1, bool)
    for lo, hi in _stretches(i[pairs]):
        at = pairs[lo:hi]
        k = int(i[at[0]])
        has[names[k]] = True
        starts = np.r_[0, np.cumsum(n[j[at]])[:-1]]
        shared = np.add.reduceat(has[np.concatenate([names[x] for x in j[at].tolist()])].astype(np.int64), starts)
        has[names[k]] = False
        out[at] = (100 + THRESHOLD) * shared >= THRESHOLD * (n[k] + n[j[at]])
    return out


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _profile(digest: Callable):
    """doc_id, n, the halves of the set's digest, its bitmaps once a batch, and on a batch's first row the
    shingles that stand in three of its sets at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, sig, wide, prefixes, seen = [], [], [], [], [], set()
            for _, texts in batches_of(batch.column(1)):
                for s in shingle_sets(texts):
                    n.append(len(s))
                    digests.append(digest(s) if len(s) else bytes(16))
                    if new := len(s) and digests[-1] not in seen:
                        seen.add(digests[-1])
                        prefixes.append(s[: 2 * (len(s) - needed(len(s)) + 1)])
                    sig.append(bitmap(s) if new else None)
                    wide.append(sketch(s) if new else None)
            keys, counts = np.unique(np.concatenate(prefixes), return_counts=True) if prefixes else (np.empty(0, np.uint64), np.empty(0, np.int64))
            often = [{"key": k, "n": c} for k, c in zip(keys[counts > 2].view(np.int64).tolist(), counts[counts > 2].tolist(), strict=True)]
            kind = pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int64())]))
            halves, empty = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2), np.array(n) == 0
            names = [pa.array(halves[:, k], pa.int64(), mask=empty) for k in (0, 1)]
            cols = [batch.column(0), pa.array(n, pa.int32()), *names, pa.array(sig, pa.binary()), pa.array(wide, pa.binary()), pa.array([often if i == 0 else [] for i in range(len(n))], kind)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "low", "high", "sig", "wide", "often"])

    return run


def _entries(common, name: Callable):
    """key, cid, n, pos for the prefix of each set, in the order: rare shingles by hash, then common ones by hash.

    The last bits of a key are no part of the shingle but the piece of its run that an entry is dealt to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, pieces = common.value
        marks = np.zeros(1 << 24, bool)
        marks[(hot >> np.uint64(40)).astype(np.int64)] = True

        def is_hot(s: np.ndarray) -> np.ndarray:
            out = marks[(s >> np.uint64(40)).astype(np.int64)]
            if out.any():
                at = np.flatnonzero(out)
                out[at] = hot[np.minimum(np.searchsorted(hot, s[at]), len(hot) - 1)] == s[at]
            return out

        def entries(keys: list, names: list, sizes: list) -> pa.RecordBatch:
            each = [len(k) for k in keys]
            place = np.concatenate([np.arange(e, dtype=np.int32) for e in each])
            key, cid = np.concatenate(keys), np.repeat(np.array(names, np.int64), each)
            at = np.flatnonzero(is_hot(key))
            piece = np.zeros(len(key), np.uint64)
            if len(at):
                piece[at] = (cid[at].view(np.uint64) >> np.uint64(17)) % pieces[np.searchsorted(hot, key[at])]
            key = key & ~np.uint64(PIECES - 1) | piece
            return pa.RecordBatch.from_arrays([signed(key), pa.array(cid), pa.array(np.repeat(np.array(sizes, np.int32), each)), pa.array(place)], ["key", "cid", "n", "pos"])

        for batch in batches:
            keys, names, sizes, seen, total = [], [], [], set(), 0
            for _, texts in batches_of(batch.column(0)):
                for s in shingle_sets(texts):
                    if not len(s) or (c := name(s)) in seen:
                        continue
                    seen.add(c)
                    p = len(s) - needed(len(s)) + 1
                    head = s[: p + p // 4 + 8]
                    rare = head[~is_hot(head)]
                    if len(rare) < p and len(head) < len(s):
                        h = is_hot(s)
                        rare = np.concatenate([s[~h], s[h]])
                    elif len(rare) < p:
                        rare = np.concatenate([rare, head[is_hot(head)]])
                    keys.append(rare[:p])
                    names.append(c)
                    sizes.append(len(s))
                    total += p
                if total > 200_000:
                    yield entries(keys, names, sizes)
                    keys, names, sizes, total = [], [], [], 0
            if keys:
                yield entries(keys, names, sizes)

    return run


def _runs(dealt):
    """From entries sorted by key, n, cid those whose key others have too, each with its run's size (as far as
    this batch goes) and the leader it is compared to first: the smallest set of the run or of the stretch
    whose sizes fit. Keeps one entry between batches.

    Two sets that link have enough left past their first common shingle, so an entry that comes too late in
    its set for even the smallest set of its run is dropped. Of a run that is ``dealt`` to pieces a task sees
    a part only, so all its entries stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, told, least = None, False, 0  # the current leader of the last run; whether it has been put out; the run's smallest n
        for batch in batches:
            key, cid, n, pos = (batch.column(i).to_numpy() for i in range(4))
            if not len(key):
                continue
            joined = carry is not None and carry[0] == key[0]
            if joined:
                key, cid, n, pos = np.r_[carry[0], key], np.r_[carry[1], cid], np.r_[np.int32(carry[2]), n], np.r_[np.int32(carry[3]), pos]
            part = np.isin(key // PIECES, dealt.value)
            same = np.r_[False, (key[1:] == key[:-1]) & (cid[1:] == cid[:-1])]
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            smallest = np.repeat(n[start], np.diff(np.r_[start, len(key)])).astype(np.int64)
            if joined:
                smallest[key == key[0]] = least
            least = int(smallest[-1])
            useful = ~same & (part | ((100 + THRESHOLD) * (n - pos).astype(np.int64) >= THRESHOLD * (n + smallest)))
            useful[0] |= joined
            last = key[-1]
            key, cid, n, pos, part = key[useful], cid[useful], n[useful], pos[useful], part[useful]
            if not len(key):
                carry = None
                continue
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[start, len(key)])
            lead = np.repeat(start, size)
            for r in np.unique(np.repeat(np.arange(len(start)), size)[100 * n[lead].astype(np.int64) < THRESHOLD * n.astype(np.int64)]).tolist():
                lo, hi = start[r], start[r] + size[r]
                at = lo
                while at < hi:  # n ascends, so a stretch ends where a set is too large for its leader
                    end = int(np.searchsorted(n[lo:hi], 100 * int(n[at]) // THRESHOLD, side="right")) + lo
                    lead[at:end] = at
                    at = end
            out, sizes = np.repeat(size > 1, size) | part, np.repeat(size, size)
            last_out = bool(out[-1])
            if joined and told:
                out[0] = False
            told = last_out
            k = lead[-1]
            carry = (key[-1], cid[k], n[k], pos[k]) if key[-1] == last else None
            if out.any():
                at, lead = np.flatnonzero(out), lead[out]
                cols = [key[at], cid[at], n[at].astype(np.int32), pos[at].astype(np.int32), cid[lead], sizes[at].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "cid", "n", "pos", "leader", "size"])

    return run


def _by_bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = np.concatenate([batch.column(k).to_numpy() for k in (1, 4)]).astype(np.int64)
        maps = [x for k in (2, 5) for x in batch.column(k).to_pylist()]
        at = np.arange(batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3)], ["a", "b"]).filter(pa.array(may_link(n, maps, at, at + len(at)), pa.bool_()))


def _fits(n: np.ndarray, rest: np.ndarray, label: np.ndarray, i, j) -> np.ndarray:
    """Whether entries i and j have different labels and enough of both sets left past this shingle; if it is the
    first that they share, no more than that can be common."""
    return (label[i] != label[j]) & ((100 + THRESHOLD) * np.minimum(rest[i], rest[j]) >= THRESHOLD * (n[i] + n[j]))


def _ordered(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each run that places do not rule out. Rows come sorted by run; a run has SHORT rows at most,
    and those of the last one are kept between batches."""
    kept = [np.empty(0, np.int64)] * 5
    for batch in batches:
        run, cid, label, n, pos = (np.concatenate([k, batch.column(i).to_numpy().astype(np.int64)]) for i, k in enumerate(kept))
        if not len(run):
            continue
        a, b = [], []
        old = len(kept[0])
        for d in range(1, SHORT):
            j = np.arange(max(d, old), len(run))  # the second row is new, so each pair is met once
            j = j[run[j] == run[j - d]]
            if len(j):
                i = j - d
                ok = _fits(n, n - pos, label, i, j)
                a.append(cid[i[ok]])
                b.append(cid[j[ok]])
        if a:
            yield _ordered(np.concatenate(a), np.concatenate(b))
        tail = int(np.searchsorted(run, run[-1]))
        kept = [x[tail:] for x in (run, cid, label, n, pos)]


def _tiles(whole: bool):
    """Pairs of each tile that neither places nor sketches rule out: all if ``whole``, else as many as connect the labels that the others
    would, and one row without a pair for a tile that has others. Rows come sorted by tile; a tile has about 2 * BLOCK rows at most."""

    def compare(tile: tuple, parts: list) -> Iterator[pa.RecordBatch]:
        side, cid, label, n, pos = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in range(5))
        fine = [x for p in parts for x in p[5]]
        maps = [unlisted(k, x) for k, x in zip(n.tolist(), fine, strict=True)]
        left, right, rest, a, b, more = np.flatnonzero(side == 0), np.flatnonzero(side == 1), n - pos, [], [], False
        within = not len(right)
        right = left if within else right
        step = max(1, (1 << 17) // len(right))
        joined = label.copy()
        for lo in range(0, len(left), step):
            i, j = (x.ravel() for x in np.meshgrid(left[lo : lo + step], right, indexing="ij"))
            ok = _fits(n, rest, label, i, j) & (i < j if within else True)
            i, j = i[ok], j[ok]
            if not whole:
                apart = joined[i] != joined[j]
                more |= not apart.all()
                i, j = i[apart], j[apart]
            ok = may_link(n, maps, i, j)
            i, j = i[ok], j[ok]
            ok = may_link_listed(n, fine, i, j)
            i, j = i[ok], j[ok]
            if not whole:
                kept = np.zeros(len(i), bool)
                for start, end in _stretches(i):
                    own = joined[i[start]]
                    new, first = np.unique(joined[j[start:end]], return_index=True)
                    kept[start + first[new != own]] = True
                    joined[np.isin(joined, new)] = own
                more |= not kept.all()
                i, j = i[kept], j[kept]
            a.append(cid[i])
            b.append(cid[j])
        if a and sum(map(len, a)):
            pairs = _ordered(np.concatenate(a), np.concatenate(b))
            yield pa.RecordBatch.from_arrays([*pairs.columns, *(pa.nulls(len(pairs), t) for t in (pa.int64(), pa.int32(), pa.int32()))], ["a", "b", "run", "i", "j"])
        if more:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([tile[0]], pa.int64()), *(pa.array([k], pa.int32()) for k in tile[1:])], ["a", "b", "run", "i", "j"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            where = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            rows = [batch.column(k).to_numpy() for k in range(3, 8)]
            fine = batch.column(8).to_pylist()
            cuts = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]).any(axis=1)]).tolist()
            for lo, hi in zip(cuts, [*cuts[1:], len(where)], strict=True):
                if parts and tuple(where[lo].tolist()) != tile:
                    yield from compare(tile, parts)
                    parts = []
                tile = tuple(where[lo].tolist())
                parts.append(([*(r[lo:hi] for r in rows), fine[lo:hi]]))
        if parts:
            yield from compare(tile, parts)

    return run


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = np.unique(np.concatenate([batch.column(k).to_numpy().view(np.uint64) for k in (0, 1)]) >> np.uint64(64 - FILTER_BITS))
        word, first = np.unique(at >> np.uint64(6), return_index=True)
        bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
        yield pa.RecordBatch.from_arrays([signed(word), signed(bits)], ["word", "bits"])


def _sets(wanted, name: Callable):
    """cid and sorted shingles of the texts that the filter lets pass, once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in batches:
            names, sets, seen = [], [], set()
            for _, texts in batches_of(batch.column(0)):
                for s in shingle_sets(texts):
                    if not len(s) or (c := name(s)) in seen:
                        continue
                    at = (c & (1 << 64) - 1) >> (64 - FILTER_BITS)
                    if int(bits[at >> 6]) >> (at & 63) & 1:
                        seen.add(c)
                        names.append(c)
                        sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.binary())], ["cid", "s"])

    return run


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, sa, sb = [], batch.column(1), batch.column(3)
        for i in range(len(sa)):
            x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (sa, sb))
            shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            keep.append((100 + THRESHOLD) * shared >= THRESHOLD * (len(x) + len(y)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def attach(pairs: DataFrame, side: str, facts: DataFrame, columns: dict[str, str], total: int) -> DataFrame:
    """Joins to each pair the ``columns`` of the set named in ``side``. A set with more than a HEAVYth of all pairs is copied, so
    that no task meets many more; there are fewer than HEAVY such sets."""
    other, most = "b" if side == "a" else "a", max(SPREAD, total // HEAVY)
    own = facts.select(F.col("cid").alias(side), *(F.col(c).alias(n) for c, n in columns.items()))
    heavy = pairs.groupBy(side).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_of")).filter("_of > 1").collect()
    if not heavy:
        return pairs.join(own, side)
    many = F.broadcast(pairs.sparkSession.createDataFrame(heavy, f"{side} long, _of int"))
    copies = F.coalesce("_of", F.lit(1))
    dealt = pairs.join(many, side, "left").withColumn("_copy", F.pmod(F.xxhash64(other), copies).cast("int")).drop("_of")
    own = own.join(many, side, "left").withColumn("_copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("_of")
    return dealt.join(own, [side, "_copy"]).drop("_copy")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable = set_digest) -> DataFrame:
    """Links texts whose word-shingle sets overlap by THRESHOLD percent and names each one's component.

    Returns doc_id, n_shingles, component_id (the smallest doc_id reachable over links, itself included).
    Texts with equal sets are one class from the start, so copies are never compared. Two sets that link
    share a shingle among the first n - needed(n) + 1 in any common order; here shingles that many texts
    have come last. Entries of one shingle, sorted by size, form a run; runs of very common shingles are dealt
    to pieces. First each entry is compared to its piece's leader, which joins groups of near copies at a cost
    linear in their size. In long runs it is also compared to the set that shares most. Then, of runs in
    which several components are left, short ones give their pairs; long ones are cut into blocks of near
    sizes, whose tiles of two blocks with fitting sizes and different labels are compared in place. Bitmaps bound each
    pair's overlap from above (in tiles also 16 bits of each shingle, so that what passes there is next to linked), what passes
    is decided by intersecting the sorted shingles. Of pairs that pass in a tile, first as many are decided as would connect its
    labels; then what is not connected by those that link is compared whole. Every pair that links is thus compared or in one component
    already; no candidate is capped.

    Null, empty and blank texts have no shingles, link to nothing and stay alone (also with each other);
    very long texts count whole, in pieces of bounded size; repeated rows are one class; a null doc_id never
    names a component of others; an empty table gives no rows; other columns are ignored, whatever their names.
    A class is known by 128 bits of BLAKE2b over its sorted shingles (``digest``); the 64-bit names that rows
    carry are checked to stand for one digest each, and changed where they do not. In an intersection, two
    shingles are equal when their 64 bits are.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    sc = spark.sparkContext
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    run_of: Column = F.shiftright("key", PIECES.bit_length() - 1)

    profile = scratch.keep(
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        .mapInArrow(_profile(digest), f"doc_id {kind}, n int, low long, high long, sig binary, wide binary, often array<struct<key: long, n: long>>"), "profile")
    total = profile.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = profile.select(F.explode("often").alias("o")).groupBy("o.key").agg(F.sum("o.n").alias("n"))
    hot = often.filter(F.col("n") >= max(COMMON_LEAST, -(-total // COMMON))).toPandas().sort_values("key", key=lambda k: k.to_numpy(np.int64).view(np.uint64))  # at most COMMON
    keys, pieces = hot["key"].to_numpy(np.int64), np.clip(-(-hot["n"].to_numpy(np.int64) // PIECE), 1, PIECES)
    common = sc.broadcast((keys.view(np.uint64), pieces.astype(np.uint64)))
    dealt = sc.broadcast(np.unique(keys[pieces > 1] // PIECES))
    renamed: frozenset = frozenset()
    while True:
        cid = F.when(F.col("low").isin(*renamed), F.col("high")).otherwise(F.col("low")) if renamed else F.col("low")
        known = profile.filter("low IS NOT NULL").withColumn("cid", cid).groupBy("cid")
        first_last = F.struct("low", "high")
        classes = scratch.keep(known.agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("sig").alias("sig"), F.max("wide").alias("wide"), F.count(F.lit(1)).alias("copies"), F.min(first_last).alias("x"), F.max(first_last).alias("y")), f"classes{len(renamed)}")
        clash = {r.cid for r in classes.filter("x <> y").select("cid").limit(RENAMED + 1).collect()}
        if not clash:
            break
        if len(clash) + len(renamed) > RENAMED or clash <= renamed:
            raise RuntimeError("set names clash")
        renamed |= clash
    name = namer(digest, renamed)
    rows = scratch.keep(profile.select("doc_id", "n", cid.alias("cid")), "rows")
    scratch.drop("profile")
    scratch.release()
    entries = texts.mapInArrow(_entries(common, name), "key long, cid long, n int, pos int")
    kept = scratch.keep(entries.repartition(parts, "key").sortWithinPartitions("key", "n", "cid").mapInArrow(_runs(dealt), "key long, cid long, n int, pos int, leader long, size int"), "kept")
    scratch.release()

    def fetch_and_intersect(pairs: DataFrame, label: str) -> DataFrame:
        words = pairs.mapInArrow(_bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
        bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)  # a fixed size, whatever the number of pairs
        bits[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
        sets = scratch.keep(texts.mapInArrow(_sets(sc.broadcast(bits), name), "cid long, s binary").dropDuplicates(["cid"]), f"sets-{label}")
        count = pairs.count()
        full = attach(attach(pairs, "a", sets, {"s": "sa"}, count), "b", sets, {"s": "sb"}, count)
        out = scratch.keep(full.select("a", "sa", "b", "sb").mapInArrow(_exact, "a long, b long"), f"edges-{label}")
        scratch.drop(f"sets-{label}")
        return out

    def by_bitmap(pairs: DataFrame, label: str) -> DataFrame:
        facts, count = classes.select("cid", "n", "sig"), pairs.count()
        both = attach(attach(pairs, "a", facts, {"n": "na", "sig": "sa"}, count), "b", facts, {"n": "nb", "sig": "sb"}, count)
        return scratch.keep(both.select("a", "na", "sa", "b", "nb", "sb").mapInArrow(_by_bitmap, "a long, b long"), label)

    stars = kept.filter("leader <> cid").select(F.col("leader").alias("a"), F.col("cid").alias("b"))
    # in longer runs also to the set that has most in common with others: the one that copies were made from
    shared = kept.groupBy("cid").agg(F.sum("size").alias("shared"))
    long = scratch.keep(kept.filter("size > 3").select("key", "cid", "n").join(shared, "cid"), "long")
    of_piece = long.groupBy("key").agg(F.max(F.struct("shared", "cid", "n")).alias("hub")).withColumn("run", run_of)
    of_run = of_piece.groupBy("run").agg(F.max("hub").alias("hub"))
    hubs = long.join(of_piece.select("key", "run").join(of_run, "run").select("key", "hub"), "key")
    hubs = hubs.filter((F.col("hub.cid") != F.col("cid")) & (100 * F.least("n", "hub.n") >= THRESHOLD * F.greatest("n", "hub.n")))
    stars = scratch.keep(stars.unionByName(hubs.select(F.col("hub.cid").alias("a"), F.col("cid").alias("b"))).distinct(), "met")
    likely = by_bitmap(stars, "likely")
    scratch.drop("long", "met")
    scratch.release()
    first = scratch.keep(components(fetch_and_intersect(likely, "stars")), "first")
    scratch.release()

    roots = first.select(F.col("node").alias("cid"), "root")
    labelled = scratch.keep(kept.select("key", "cid", "n", "pos").join(roots, "cid", "left").withColumn("label", F.coalesce("root", "cid")).drop("root"), "labelled")
    of_piece = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size")).withColumn("run", run_of)
    of_run = of_piece.groupBy("run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("size").alias("size")).filter("lo <> hi")
    mixed = scratch.keep(labelled.join(of_piece.select("key", "run").join(of_run.select("run", "size"), "run"), "key").select("key", "run", "cid", "label", "n", "pos", "size"), "mixed")
    scratch.drop("kept", "likely", "labelled")
    scratch.release()
    few = mixed.filter(F.col("size") <= SHORT).select("run", "cid", "label", "n", "pos").repartition(parts, "run").sortWithinPartitions("run")
    written = by_bitmap(scratch.keep(few.mapInArrow(_pairs, "a long, b long").distinct(), "written"), "pairs")
    scratch.drop("written")
    scratch.release()
    whole = mixed.filter((F.col("size") > SHORT) & (F.col("size") <= BLOCK)).select("run", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "cid", "label", "n", "pos")
    # sizes that link differ by a quarter at most, so blocks hold sizes of one band and meet those of the next
    banded = mixed.filter(F.col("size") > BLOCK).withColumn("band", F.floor(F.log("n") / float(np.log(100 / THRESHOLD))).cast("int"))
    of_piece = banded.groupBy("key", "run", "band").agg(F.count(F.lit(1)).alias("c"))
    cuts = of_piece.select("key", "run", "band").join(of_piece.groupBy("run", "band").agg(F.ceil(F.sum("c") / BLOCK).cast("int").alias("cuts")), ["run", "band"])
    blocked = banded.join(cuts.select("key", "band", "cuts"), ["key", "band"]).withColumn("block", F.col("band") * (1 << 24) + F.pmod(F.xxhash64("cid"), F.col("cuts")).cast("int"))
    blocked = scratch.keep(blocked.select("run", "block", "cid", "label", "n", "pos"), "blocked")
    facts = blocked.groupBy("run", "block").agg(F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("label").alias("l0"), F.max("label").alias("l1"))
    u, v = facts.alias("u"), facts.alias("v")
    one = (F.col("u.l0") == F.col("u.l1")) & (F.col("v.l0") == F.col("v.l1")) & (F.col("u.l0") == F.col("v.l0"))
    sizes = (100 * F.col("u.n1") >= THRESHOLD * F.col("v.n0")) & (100 * F.col("v.n1") >= THRESHOLD * F.col("u.n0"))
    met = u.join(v, (F.col("u.run") == F.col("v.run")) & (F.col("u.block") <= F.col("v.block")) & sizes & ~one).select("u.run", F.col("u.block").alias("i"), F.col("v.block").alias("j"))
    ends = F.when(F.col("i") == F.col("j"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    met = met.withColumn("side", F.explode(ends)).withColumn("block", F.when(F.col("side") == 0, F.col("i")).otherwise(F.col("j")))
    many = blocked.join(met, ["run", "block"]).select("run", "i", "j", "side", "cid", "label", "n", "pos")
    tiles = whole.unionByName(many).join(classes.select("cid", "wide"), "cid").select("run", "i", "j", "side", "cid", "label", "n", "pos", "wide")

    def compared(tiles: DataFrame, whole: bool, label: str) -> DataFrame:
        in_tiles = tiles.repartition(parts, "run", "i", "j").sortWithinPartitions("run", "i", "j")
        return scratch.keep(in_tiles.mapInArrow(_tiles(whole), "a long, b long, run long, i int, j int"), label)

    tiled = compared(tiles, False, "tiled")
    rest = scratch.keep(written.unionByName(tiled.filter("a IS NOT NULL").select("a", "b")).distinct(), "rest")
    second = fetch_and_intersect(rest, "tiles")
    links = first.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(second)
    final = components(links)
    again = tiled.filter("a IS NULL").select("run", "i", "j")
    if again.head(1):  # what was left out in a tile is compared there if its sets are not connected by now
        final = scratch.keep(final, "final")
        named = tiles.join(again, ["run", "i", "j"], "left_semi").join(final.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("label", F.coalesce("root", "cid"))
        third = compared(named.select(*tiles.columns), True, "again").select("a", "b").distinct()
        third = fetch_and_intersect(scratch.keep(third.join(rest, ["a", "b"], "left_anti"), "left"), "again")
        final = components(final.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(third))
    scratch.drop("mixed", "blocked")
    scratch.release()
    reps = final.join(classes.select(F.col("cid").alias("node"), "rep"), "node")
    named = reps.select("node", "root").join(reps.groupBy("root").agg(F.min("rep").alias("least")), "root").select(F.col("node").alias("cid"), "least")
    table = scratch.keep(classes.select("cid", "rep", "copies").join(named, "cid", "left").select("cid", F.coalesce("least", "rep").alias("component_id"), "copies"), "named")
    with_set = lookup(rows.filter("cid IS NOT NULL"), table, ["cid"], "copies", rows.count())
    alone = rows.filter("cid IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return with_set.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone).select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id")
