import random
import re
from itertools import combinations

import numpy as np
import pytest

from tieplane.llm import jaccard
from tieplane.llm.graph import components
from tieplane.llm.shingles import shingle_sets

from .cases import frame, lower, texts


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def expected(rows):
    sets = [shingles(t) for _, t in rows]
    root = [*range(len(rows))]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return sorted(((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def result(spark, rows):
    return sorted((tuple(r) for r in jaccard.jaccard_components(frame(spark, rows)).collect()), key=str)


def test_matches_brute_force(spark):
    rows = texts()
    assert result(spark, rows) == expected(rows)


def thue_morse(n):
    """A word of 2**n letters and its complement: polynomial hashes modulo a power of two take them for equal."""
    bits = [0]
    for _ in range(n):
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_polynomial_hashes_confuse(spark):
    a, b = thue_morse(10)
    short = thue_morse(3)
    rows = [(1, a), (2, b), (3, f"{a} x y z w"), (4, f"{b} x y z w"), (5, short[0]), (6, short[1]), (7, "p q"), (8, "pq"), (9, "a\0"), (10, "a"), (11, "x" * 15), (12, "x" * 16)]
    assert result(spark, rows) == expected(rows) == sorted(((i, 1, i) for i in range(1, 13)), key=str)


def test_sets_whose_names_clash_stay_apart(spark):
    def weak(s):  # one first half for all
        from tieplane.llm.jaccard import set_digest

        return b"one name" + set_digest(s)[8:]

    rows = chained(3, 30, 4)
    got = sorted((tuple(r) for r in jaccard.jaccard_components(frame(spark, rows), digest=weak).collect()), key=str)
    assert got == expected(rows)


def chained(seed, n, spread):
    """Near copies of one text, few of which link to the first, and texts with a passage in common."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base, passage = [word() for _ in range(90)], [word() for _ in range(60)]
    rows, now = [], list(base)
    for i in range(n):
        now = list(base if i % 3 else now)
        for _ in range(rng.randint(0, spread)):
            now[rng.randrange(90)] = word()
        rows.append((i, " ".join(now)))
    rows += [(n + i, " ".join([word() for _ in range(rng.randint(0, 30))] + passage + [word() for _ in range(rng.randint(0, 9))])) for i in range(n)]
    return rows


@pytest.mark.parametrize(("common", "block", "piece"), [(64, 1024, 512), (5, 4, 512), (2, 3, 4), (4, 1024, 3)])
def test_common_shingles_small_tiles_and_pieces_lose_no_link(spark, monkeypatch, common, block, piece):
    monkeypatch.setattr(jaccard, "COMMON_LEAST", common)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "PIECE", piece)
    monkeypatch.setattr(jaccard, "SPREAD", block)
    monkeypatch.setattr(jaccard, "HEAVY", 1 << 30)
    monkeypatch.setattr(jaccard, "SHORT", 2)
    rows = chained(common, 70, 4)
    want = expected(rows)
    assert result(spark, rows) == want
    assert len({r[2] for r in want}) > 5


def test_empty_table(spark):
    assert result(spark, []) == []


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 400)).astype(np.uint64))
        b = np.unique(np.r_[a[rng.random(len(a)) < rng.uniform(0.7, 1)], rng.integers(0, 2**63, rng.integers(0, 60)).astype(np.uint64)])
        both = len(np.intersect1d(a, b))
        linked = len(b) and 100 * both >= 80 * (len(a) + len(b) - both)
        if linked:
            for times in ((1, 1), (jaccard.WIDER, jaccard.WIDER), (1, jaccard.WIDER)):
                maps = [jaccard.bitmap(x, t) for x, t in zip((a, b), times, strict=True)]
                assert jaccard.may_link(np.array([len(a), len(b)]), maps, np.array([0]), np.array([1])).all()


def test_bitmaps_rule_out_most_that_do_not_link():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**63, 300).astype(np.uint64)) for _ in range(40)]
    i, j = map(np.array, zip(*combinations(range(40), 2), strict=True))
    assert not jaccard.may_link(np.array([len(x) for x in sets]), [jaccard.bitmap(x, jaccard.WIDER) for x in sets], i, j).any()


def test_shingles_do_not_depend_on_how_texts_are_cut(monkeypatch):
    from tieplane.llm import shingles as module

    parts = [t.encode() for _, t in texts() if t]
    whole = shingle_sets(parts)
    assert all(np.array_equal(a, shingle_sets([p])[0]) for a, p in zip(whole, parts, strict=True))
    monkeypatch.setattr(module, "SEGMENT", 64)
    assert all(np.array_equal(a, b) for a, b in zip(whole, shingle_sets(parts), strict=True))
    assert [len(s) for s in whole] == [len(shingles(p.decode())) for p in parts]


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(1000 + i, 1001 + i) for i in range(50)] + [(2000, 2000 + i) for i in range(1, 40)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_lists_never_rule_out_a_link_but_what_bitmaps_let_pass():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**63, 56).astype(np.uint64))]
    for k in range(200):
        s = sets[0].copy()
        s[rng.permutation(56)[: k % 20]] = rng.integers(0, 2**63, k % 20)
        sets.append(np.unique(s))
    i, j = map(np.array, zip(*combinations(range(len(sets)), 2), strict=True))
    n, fine = np.array([len(s) for s in sets]), [jaccard.sketch(s) for s in sets]
    shared = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i.tolist(), j.tolist(), strict=True)])
    linked = 180 * shared >= 80 * (n[i] + n[j])
    maps = [jaccard.unlisted(k, x) for k, x in zip(n.tolist(), fine, strict=True)]
    passed, listed = jaccard.may_link(n, maps, i, j), jaccard.may_link_listed(n, fine, i, j)
    assert listed[linked].all() and passed[linked].all()
    assert listed.sum() <= 1.01 * linked.sum() < passed.sum()


def test_tiles_of_near_copies_give_no_more_pairs_than_sets():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    base, n = np.unique(rng.integers(0, 2**63, 60).astype(np.uint64)), 250
    sets = [np.unique(np.r_[base[rng.permutation(60)[:57]], rng.integers(0, 2**63, 3).astype(np.uint64)]) for _ in range(n)]
    ids = np.arange(n)
    cols = [np.zeros(n, np.int64), np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32), ids, ids, np.array([len(s) for s in sets], np.int32), np.zeros(n, np.int32)]
    batch = pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array([jaccard.sketch(s) for s in sets], pa.binary())], names=["run", "i", "j", "side", "cid", "label", "n", "pos", "wide"])
    some, whole = (pa.Table.from_batches([*jaccard._tiles(w)(iter([batch]))]) for w in (False, True))
    pairs = [(a, b) for a, b in zip(some["a"].to_pylist(), some["b"].to_pylist(), strict=True) if a is not None]
    assert some.num_rows == n and len(pairs) == n - 1 and some["run"].null_count == n - 1  # a tree, and a row that tells of others
    root = [*range(n)]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    assert len({find(x) for x in range(n)}) == 1 and whole.num_rows > 20 * n
