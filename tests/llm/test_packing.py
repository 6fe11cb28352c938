import zlib
from collections import defaultdict

import numpy as np
import pytest
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tieplane.llm.packing import best_fit_decreasing, gap, lower_bound, pack, pack_documents

from .cases import frame, texts


@pytest.mark.parametrize("plain", [False, True])
def test_every_piece_is_there_and_sequences_are_gapless(spark, plain):
    """By default as the library does with add_special_tokens=False; ``plain`` with its encode_special_tokens too."""
    rows = [*texts(), (400, "word " * 5000), (401, "a b c <|endoftext|> d"), (402, "<|endoftext|>"), (403, "x<|endoftext|><|endoftext|>\n y <|ENDOFTEXT|> <|endoftext|"), (404, "Kept <|endoftext|>" * 900)]
    got = pack_documents(frame(spark, rows), **({"added": None} if plain else {})).collect()
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    if plain:
        tok.encode_special_tokens = True
    assert (50256 in tok.encode("a <|endoftext|> b", add_special_tokens=False).ids) != plain
    want = []
    for d, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want += [(d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= -(-sum(r.length for r in got) // 2048) + 1


def test_exchange_between_partitions(spark):
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 2049, 3000).tolist()
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "doc_id long, length long")
    packed = pack(df, group=100)
    got = packed.toPandas()
    assert sorted(got["doc_id"]) == [*range(3000)]
    fill = got.groupby("sequence_id")["length"].sum()
    bound = lower_bound(np.bincount(sizes, minlength=2049), 2048)
    alone = len(best_fit_decreasing(np.array(sizes), 2048)[2])
    assert gap(packed) == (len(fill), bound)
    assert fill.max() <= 2048 and bound <= len(fill) <= 1.02 * alone + 1  # of groups of a hundred pieces only


def test_empty_table(spark):
    assert pack_documents(frame(spark, [])).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=9))
def test_bound_holds_against_the_best_packing(sizes):
    def best(left, free, used):
        if not left:
            return used
        out = best(left[1:], [*free, 12 - left[0]], used + 1)
        for k in {f: i for i, f in enumerate(free) if f >= left[0]}.values():
            out = min(out, best(left[1:], [*free[:k], free[k] - left[0], *free[k + 1 :]], used))
        return out

    exact = best(sorted(sizes, reverse=True), [], 0)
    bound, found = lower_bound(np.bincount(sizes, minlength=13), 12), len(best_fit_decreasing(np.array(sizes), 12)[2])
    assert bound <= exact <= found
