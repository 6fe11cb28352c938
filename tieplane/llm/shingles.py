"""Word shingles of whole texts as sorted 64-bit values, computed for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np

WORDS = 5
#: Bytes that are split into words at once; longer stretches are cut at white space.
SEGMENT = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of a word that its 128 bits hold as they are, beside its length.
SPELLED = 15
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which each bit depends on all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: An odd multiplier for each half of a word and each place in a shingle.
_PLACE = (mix(np.arange(1, 2 * WORDS + 1, dtype=np.uint64)) | np.uint64(1)).reshape(2, WORDS)
_KEY = mix(np.arange(101, 103, dtype=np.uint64))


def _segment_words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 128 bits, as two columns, and the start of each word."""
    text = text.lower()  # of bytes, so A-Z only
    data = np.frombuffer(text, np.uint8)
    edge = np.flatnonzero(np.diff(np.r_[True, _SPACE[data], True].astype(np.int8)))
    starts, size = edge[::2], edge[1::2] - edge[::2]
    eight = np.ndarray(len(data) + 9, "<u8", text + b"\0" * 16, strides=(1,))  # the eight bytes from each place on
    low = eight[starts] & _MASK[np.minimum(size, 8)]
    high = eight[np.minimum(starts + 8, len(data))] & _MASK[np.clip(size - 8, 0, 7)] | size.astype(np.uint64) << np.uint64(56)
    for i in np.flatnonzero(size > SPELLED).tolist():
        digest = blake2b(text[starts[i] : starts[i] + size[i]], digest_size=16).digest()
        low[i], high[i] = int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little") | 0xFF << 56
    return low, high, starts


def words_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 128 bits, as two columns, and the start of each white-space separated word, A-Z lower-cased.

    A word of up to SPELLED bytes is its bytes and its length, so different ones differ; of a longer one
    it is a BLAKE2b digest.
    """
    if len(text) <= 2 * SEGMENT:
        return _segment_words(text)
    data, parts, lo = np.frombuffer(text, np.uint8), [], 0
    while lo < len(text):
        hi = lo + SEGMENT
        while hi < len(text) and not len(gap := np.flatnonzero(_SPACE[data[hi : hi + SEGMENT]])):
            hi += SEGMENT
        hi = len(text) if hi >= len(text) else hi + int(gap[0])
        low, high, starts = _segment_words(text[lo:hi])
        parts.append((low, high, starts + lo))
        lo = hi
    return tuple(map(np.concatenate, zip(*parts, strict=True)))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; of fewer than WORDS words the whole sequence.

    A shingle is 64 bits that mix the 128 of each of its words, so only chance, 2**-64 for two shingles,
    makes different ones equal.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    low, high, places = words_of(b" ".join([*texts, b""]))
    count = np.bincount(np.searchsorted(np.cumsum(sizes), places, side="right"), minlength=len(texts))
    first = np.r_[0, np.cumsum(count)]
    halves = mix(low * _PLACE[0, 0] + mix(high ^ _KEY[0])), mix(high * _PLACE[1, 0] + mix(low ^ _KEY[1]))
    k = max(0, len(low) - WORDS + 1)
    rolled = np.zeros((2, k), np.uint64)
    for half, own in enumerate(halves):
        for i in range(WORDS):
            rolled[half] += own[i : i + k] * _PLACE[half, i]
    rolled = mix(rolled[0] + mix(rolled[1]))
    out = []
    for lo, n in zip(first[:-1].tolist(), count.tolist(), strict=True):
        if n >= WORDS:
            s = np.sort(rolled[lo : lo + n - WORDS + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]] if len(s) > 1 else s)
        elif n:
            a, b = ((own[lo : lo + n] * _PLACE[half, :n]).sum(keepdims=True) + np.uint64(n) for half, own in enumerate(halves))
            out.append(mix(a + mix(b)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def batches_of(texts, size: int = SEGMENT) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of the texts of an Arrow column, about ``size`` bytes each, with the first row of each."""
    run, start, total = [], 0, 0
    for i in range(len(texts)):
        t = (texts[i].as_py() or "").encode()
        run.append(t)
        total += len(t)
        if total >= size:
            yield start, run
            run, start, total = [], i + 1, 0
    if run:
        yield start, run
