import hashlib
import random
from collections import Counter

import numpy as np

from tieplane.llm import repeats
from tieplane.llm.suffixes import suffix_arrays

from .cases import frame, texts


def expected(rows, least=200):
    all_ = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + least] for b in all_ for i in range(len(b) - least + 1))
    out = Counter()
    for (d, _), b in zip(rows, all_, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if seen[b[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()] += 1
    return out


def got(df):
    return Counter(map(tuple, df.collect()))


def passages(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijkléß") for _ in range(rng.randint(1, 9)))
    shared = [" ".join(word() for _ in range(rng.randint(20, 90))) for _ in range(8)]
    rows = []
    for k in range(150):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += [rng.choice(shared)[rng.randint(0, 40) :], " ".join(word() for _ in range(rng.randint(0, 60)))]
        rows.append((k, " ".join(parts)))
    return rows + [(500, "ab" * 400), (501, "x" * 199), (502, "x" * 200), (503, "x" * 201), (504, shared[0] * 2)]


def test_suffix_arrays_match_sorting():
    rng = random.Random(4)
    for _ in range(200):
        symbols, lengths, want = [], [], []
        for _ in range(rng.randint(1, 6)):
            t = [rng.randint(1, rng.choice([1, 2, 4, 26])) for _ in range(rng.randint(0, 50))] + [0]
            want += [len(symbols) + i for i in sorted(range(len(t)), key=lambda i: t[i:])]
            symbols += t
            lengths.append(len(t))
        assert suffix_arrays(np.array(symbols, np.int32), np.array(lengths)).tolist() == want


def test_matches_brute_force(spark):
    rows = texts()
    assert got(repeats.remove_repeats(frame(spark, rows))) == expected(rows)


def test_passages_that_texts_share(spark):
    rows = passages()
    assert got(repeats.remove_repeats(frame(spark, rows).repartition(7))) == expected(rows)


def test_large_groups_are_refined(spark):
    rows = passages(5)
    base = rows[0][1] + rows[1][1] + rows[2][1]
    rng = random.Random(6)
    for k in range(120):
        at = rng.randrange(len(base))
        rows.append((1000 + k, base[:at] + rng.choice("xyz") + base[at + 1 :]))
    want = expected(rows)
    assert got(repeats.remove_repeats(frame(spark, rows))) == want
    assert got(repeats.remove_repeats(frame(spark, rows), group=1)) == want
    assert got(repeats.remove_repeats(frame(spark, rows), group=10)) == want


def test_long_texts_are_read_in_pieces(spark, monkeypatch):
    rng = random.Random(7)
    long = "".join(rng.choice("abcd ") for _ in range(3 * repeats.SLICE // 2))
    at = repeats.SLICE - 150
    rows = [(1, long), (2, "start " + long[at : at + 300] + " end"), (3, "other " + long[-260:])]
    out = {r.doc_id: r for r in repeats.remove_repeats(frame(spark, rows)).collect()}
    assert [out[k].n_removed for k in (1, 2, 3)] == [560, 300, 260]
    assert [out[k].n_spans for k in (1, 2, 3)] == [2, 1, 1]


def test_empty_table(spark):
    assert repeats.remove_repeats(frame(spark, [])).collect() == []


def test_one_text_repeated_very_often(spark):
    rows = [(k, "all the same " * 20) for k in range(3000)] + passages(8)
    assert got(repeats.remove_repeats(frame(spark, rows))) == expected(rows)
