"""Packing of documents into sequences: best-fit decreasing, certified by dual feasible functions."""

from __future__ import annotations

import base64
import itertools
import json
import logging
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ranked

CAPACITY = 2048
#: Id that ends each document.
END = 0
#: Pieces that one packing task takes at most, about.
GROUP = 200_000
#: Share of a partition's free space that lies in the bins it hands out if it has a gap: its emptiest ones.
RELEASED = 0.9


@lru_cache(2)
def encoder(path: str, pattern: str, added: str | None):
    """The vocabulary of the json file ``added``: its rank file gives the same ids, several times as fast.

    Like the ``tokenizers`` library by default, it takes the strings of the json's added tokens wherever they
    stand in a text for those tokens; without ``added`` they are ordinary text.
    """
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    special = {}
    if added:
        with open(added, encoding="utf-8") as f:
            special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def vocabulary() -> tuple[str, str, str]:
    """The rank file, the pattern and the json file with the added tokens."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.json")


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing can beat: the largest of several dual feasible functions' sums.

    ``counts[s]`` is the number of items of size s, up to the capacity. Used are the identity; the step
    function that rounds sizes past capacity - k up and drops those below k; and x -> floor((m+1)x/c)/m,
    exact where (m+1)x/c is whole.
    """
    size = np.arange(len(counts), dtype=np.int64)
    best = -(-int((counts * size).sum()) // capacity)
    many, total = np.cumsum(counts), np.cumsum(counts * size)
    for k in range(1, capacity // 2 + 1):
        large, middle = int(many[-1] - many[capacity - k]), int(total[capacity - k] - total[k - 1])
        best = max(best, large - (-middle // capacity))
    for m in range(1, 65):
        whole = (m + 1) * size % capacity == 0
        # m * f(x), in units of 1/capacity, so that all is integer
        f = np.where(whole, m * size, (m + 1) * size // capacity * capacity)
        best = max(best, -(-int((counts * f).sum()) // (m * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the fill of each bin. A bit set of the free spaces finds the best fit."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    fill: list[int] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i, s in zip(order.tolist(), sizes[order].tolist(), strict=True):
        if fits := mask >> s:
            space = s + (fits & -fits).bit_length() - 1
            b = free[space].pop()
            if not free[space]:
                mask ^= 1 << space
        else:
            b, space = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += s
        if left := space - s:
            free[left].append(b)
            mask |= 1 << left
    return bins, offsets, np.array(fill, np.int64)


def tokenized_pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, path: str, pattern: str, added: str | None) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern, added)
        for batch in batches:
            rows, texts = [], batch.column(1)
            for i in range(len(texts)):
                ids = np.append(enc.encode_to_numpy(texts[i].as_py() or "", allowed_special="all"), END).astype("<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                rows += [(i, k, a, b - a, zlib.crc32(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            if rows:
                at, piece, start, length, crc = map(np.array, zip(*rows, strict=True))
                cols = [batch.column(0).take(pa.array(at)), *(pa.array(c, pa.int64()) for c in (start, length, crc))]
                yield pa.RecordBatch.from_arrays([cols[0], pa.array(piece, pa.int32()), *cols[1:]], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def packer(r: int, last: bool, capacity: int, names: list[str]):
    """Packs one partition of round r; marks what is done."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf["length"].to_numpy(np.int64)
        bins, offsets, fill = best_fit_decreasing(sizes, capacity)
        order, free = np.argsort(fill, kind="stable"), capacity - fill
        certified = len(fill) == lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
        given = 1 if certified else int(np.searchsorted(np.cumsum(free[order]), RELEASED * free.sum())) + 1
        kept = np.ones(len(fill), bool)
        kept[order[:given]] = False
        kept |= free == 0
        # 2**31 bins in each of 2**24 partitions in each of 2**8 rounds; a round keeps a tenth of the free space, so there are some dozens
        return pdf[names].assign(sequence_id=(r << 55) | (int(key[0]) << 31) | bins, offset=offsets, done=kept[bins] | last)

    return run


def gap(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """How many sequences there are, and the number that no packing of the same pieces can beat."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in packed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # at most ``capacity`` rows
        counts[r.length] = r.n
    return packed.select("sequence_id").distinct().count(), lower_bound(counts, capacity)


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` of 1 to ``capacity``.

    Each partition of about ``group`` pieces is packed best fit decreasing, and a lower bound from dual
    feasible functions certifies its bin count. A partition that meets its bound hands out its one emptiest bin, so that
    what partitions waste by rounding meets; one with a gap hands out its emptiest bins, with RELEASED of its
    free space. Their pieces are dealt anew among fewer partitions and packed again. It ends when one partition is
    left, or none gives pieces back; if several partitions give all their pieces back, so that a round
    brings nothing, the next one ends it and says so in the log. ``gap`` tells what is left to the bound. A task
    holds one partition; the driver holds a count.
    """
    spark = pieces.sparkSession
    scratch = Scratch(spark, "packing")
    fields = pieces.schema.simpleString()[len("struct<") : -1].replace(":", " ").split(",")
    names = pieces.columns
    schema = ", ".join([*fields, "sequence_id long", "offset long", "done boolean"])
    done, left, n = [], pieces, pieces.count()
    stuck = False
    for r in itertools.count():
        parts = max(1, -(-n // group))
        last = parts == 1 or stuck

        if parts == 1:
            dealt = left.withColumn("part", F.lit(0).cast("long"))
        else:  # in turn within each of 64 ranges of lengths, so that all partitions get the same mix
            mixed = left.withColumn("range", F.floor(F.col("length") * 64 / (capacity + 1)).cast("int")).withColumn("block", F.pmod(F.xxhash64(*names), F.lit(parts)).cast("int"))
            dealt = ranked(mixed, ["range"], "block", ["length", F.xxhash64(F.lit(r), *names)], "place").withColumn("part", F.pmod(F.col("place") + F.xxhash64(F.lit(r), "range") % parts, F.lit(parts)))
        packed = scratch.keep(dealt.groupBy("part").applyInPandas(packer(r, last, capacity, names), schema), f"round{r}")
        done.append(packed.filter("done").drop("done"))
        if last:
            break
        left, before = packed.filter("NOT done").select(*names), n
        n = left.count()
        if not n:
            break
        if stuck := n >= before:
            logging.getLogger(__name__).warning("packing: %d pieces in %d partitions were exchanged in vain", n, parts)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None, pattern: str | None = None, added: str | None = "") -> DataFrame:
    """Packs tokenized documents, each ended by END, into sequences of at most ``capacity`` tokens.

    Only longer documents are cut, into full pieces after a first one that may be shorter. Returns per
    piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null text counts as empty (one
    END); very long texts are cut and lose nothing; repeated rows and ties of length are packed each; an empty
    table gives no rows; other columns are ignored. ``added`` is the json file whose added tokens are recognised
    in texts, as the ``tokenizers`` library does by default; None takes their strings for ordinary text.
    """
    path, pattern, added = path or vocabulary()[0], pattern or vocabulary()[1], vocabulary()[2] if added == "" else added
    scratch = Scratch(docs.sparkSession, "pieces")
    return pack(scratch.keep(tokenized_pieces(docs, id_col, text_col, capacity, path, pattern, added), "pieces"), capacity)
