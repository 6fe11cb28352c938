"""Byte-level BPE encoding and decoding by merge replay over the words of a block of documents."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct words that a Python worker remembers between blocks; then it starts anew.
REMEMBERED = 400_000
#: Text bytes of a block, in which each distinct word is encoded once.
BLOCK = 16 << 20


class MergeReplay:
    """Encodes words by the ranks of a vocabulary file.

    ``encode`` puts the symbols of all new words in one array. An inverted index leads from the rank of a
    pair (the token that the pair would make) to the positions where the pair stands; a heap yields the
    ranks in order. Applying a merge touches its positions and their two neighbours only, whose new pairs
    enter the index. A word whose merges could have been ordered otherwise (a merge makes a pair of a lower
    rank) is replayed by itself, so results equal those of merging the lowest pair of each word again and
    again, leftmost first.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.text_of = [str(i) for i in range(len(self.tokens))]
        self.split = regex.compile(pattern).findall
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys, self.made = keys[order], np.fromiter(pairs.values(), np.int64, len(pairs))[order]
        self.known: dict[str, int] = {}
        self.ids, self.starts = np.empty(0, np.int32), np.zeros(1, np.int64)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that each pair makes; -1 for none."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], -1)

    def replay_one(self, word: bytes) -> list[int]:
        """The plain definition, with a heap and linked neighbours."""
        sym = self.byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(sym)
        after, before, alive = [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n
        rank = lambda i: self.ranks.get(self.tokens[sym[i]] + self.tokens[sym[after[i]]]) if after[i] < n else None
        heap = [(r, i) for i in range(n) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if not alive[i] or rank(i) != r:
                continue
            j = after[i]
            sym[i], alive[j], after[i] = r, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (x := rank(k)) is not None:
                    heapq.heappush(heap, (x, k))
        return [s for s, a in zip(sym, alive, strict=True) if a]

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words, end to end, and the number of each word's tokens."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        n = int(sizes.sum())
        sym = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(sizes)
        ends = ends[sizes > 0]
        after[ends - 1] = n
        before[np.r_[0, ends[:-1]] if len(ends) else ends] = -1
        alive, odd = np.ones(n, bool), np.zeros(len(words), bool)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(at: np.ndarray, rank: np.ndarray) -> None:
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])
            for r, lo, hi in zip(rank[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(at)], strict=True):
                if (found := index.get(r)) is None:
                    index[r] = [at[lo:hi]]
                    heapq.heappush(heap, r)
                else:
                    found.append(at[lo:hi])

        at = np.flatnonzero(after < n)
        rank = self.rank_of(sym[at], sym[after[at]])
        if (ok := rank >= 0).any():
            enter(at[ok], rank[ok])
        while heap:
            r = heapq.heappop(heap)
            found = index.pop(r)
            at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            at = at[alive[at]]
            at = at[after[at] < n]
            at = at[self.rank_of(sym[at], sym[after[at]]) == r]
            if not len(at):
                continue
            if len(at) > 1 and (chained := after[at[:-1]] == at[1:]).any():  # of overlapping pairs every other one, from the left
                start = np.r_[True, ~chained]
                place = np.arange(len(at)) - np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
                at = at[place % 2 == 0]
            gone = after[at]
            sym[at], alive[gone] = r, False
            nxt = after[gone]
            after[at] = nxt
            inner = nxt < n
            before[nxt[inner]] = at[inner]
            left = before[at]
            touched = np.unique(np.concatenate([left[left >= 0], at[inner]]))
            if len(touched):
                rank = self.rank_of(sym[touched], sym[after[touched]])
                ok = rank >= 0
                touched, rank = touched[ok], rank[ok]
                if len(low := touched[rank < r]):
                    odd[word[low]] = True
                if len(touched):
                    enter(touched, rank)
        out, counts = sym[alive], np.bincount(word[alive], minlength=len(words))
        if odd.any():
            parts = np.split(out, np.cumsum(counts)[:-1])
            for k in np.flatnonzero(odd).tolist():
                parts[k] = np.array(self.replay_one(words[k]), np.int64)
            out, counts = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return out.astype(np.int32), counts

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Token ids of each text."""
        if len(self.known) > REMEMBERED:
            self.known, self.ids, self.starts = {}, np.empty(0, np.int32), np.zeros(1, np.int64)
        known, old = self.known, len(self.known)
        number = lambda w: known.setdefault(w, len(known))
        coded = [np.fromiter(map(number, self.split(t)), np.int32) for t in texts]
        if len(known) > old:
            new = [w.encode() for w in list(known)[old:]]
            ids, counts = self.replay(new)
            self.ids = np.concatenate([self.ids, ids])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])
        for words in coded:
            lo = self.starts[words]
            size = self.starts[words + 1] - lo
            total = np.cumsum(size)
            n = int(total[-1]) if len(total) else 0
            yield self.ids[np.repeat(lo - total + size, size) + np.arange(n)] if n else np.empty(0, np.int32)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(2)
def replayer(path: str, pattern: str) -> MergeReplay:
    return MergeReplay(path, pattern)


def blocks(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about BLOCK bytes, each with its first row."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // BLOCK
    cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else []
    for lo, hi in zip(cuts, [*cuts[1:], len(group)], strict=True):
        yield lo, [t or "" for t in texts.slice(lo, hi - lo).to_pylist()]


def vocabulary() -> tuple[str, str]:
    """The installed vocabulary file and the pattern that goes with it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def bpe_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encodes each whole text, then decodes the ids.

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids joined by a space), decoded_sha256, and with
    ``with_ids`` the ids and the decoded bytes. Words depend on nothing outside themselves, so the corpus is
    replayed block by block where it lies, without a shuffle; a lost task is simply run again. Null is empty:
    no tokens. A very long text is encoded whole, in a block of its own. Repeated rows and ties give repeated results,
    a null id stays null, an empty table gives no rows, other columns are ignored, whatever their names. ``path``
    must exist on all machines.
    """
    path, pattern = path or vocabulary()[0], pattern or vocabulary()[1]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = replayer(path, pattern)
        for batch in batches:
            for lo, texts in blocks(batch.column(1)):
                rows = []
                for ids in bpe.encode(texts):
                    flat = ids.tolist()
                    back = bpe.decode(flat)
                    row = (len(flat), hashlib.sha256(" ".join(map(bpe.text_of.__getitem__, flat)).encode()).hexdigest(), hashlib.sha256(back).hexdigest())
                    rows.append((*row, flat, back) if with_ids else row)
                cols = [batch.column(0).slice(lo, len(rows)), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.binary()), strict=False))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(cols)])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
