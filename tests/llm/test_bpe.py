import hashlib
import random

import tiktoken

from tieplane.llm.bpe import MergeReplay, bpe_round_trip, vocabulary

from .cases import frame, texts

PATH, PATTERN = vocabulary()
REPLAY = MergeReplay(PATH, PATTERN)
PLAIN = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=REPLAY.ranks, special_tokens={})


def test_ids_equal_those_of_the_library():
    rng = random.Random(3)
    odd = ["".join(rng.choice("ab aAé中\n\t 12,.'s\u200bßİ😀") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    odd += ["a" * 20_000, "ab" * 5000, " " * 3000, "<|endoftext|>", "don't we'll I'M"]
    odd += ["".join(rng.choice("theing andr") for _ in range(300)) for _ in range(500)]
    assert [x.tolist() for x in REPLAY.encode(odd)] == [PLAIN.encode_ordinary(t) for t in odd]


def test_one_word_replay_equals_block_replay():
    words = [b"hello", b"aaaaaaa", b"abcabcabc", "éé中".encode(), b"", b"x"]
    ids, counts = REPLAY.replay(words)
    at = 0
    for w, n in zip(words, counts.tolist(), strict=True):
        assert ids[at : at + n].tolist() == REPLAY.replay_one(w)
        at += n


def test_odd_ranks_are_replayed_word_by_word(tmp_path):
    """In this vocabulary a merge makes a pair of a lower rank, which must come before the next merge."""
    import base64

    tokens = [bytes([b]) for b in range(256)] + [b"aba", b"ab", b"abab"]
    path = tmp_path / "odd.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))
    odd = MergeReplay(str(path), r"\S+|\s+")
    lib = tiktoken.Encoding("odd", pat_str=r"\S+|\s+", mergeable_ranks=odd.ranks, special_tokens={})
    rng = random.Random(4)
    for t in ["abab", "ababab", "aabab", *("".join(rng.choice("ab") for _ in range(12)) for _ in range(300))]:
        odd.known, odd.ids, odd.starts = {}, odd.ids[:0], odd.starts[:1]
        assert next(odd.encode([t])).tolist() == lib.encode_ordinary(t), t


def test_operator(spark):
    rows = texts()
    got = sorted((tuple(r) for r in bpe_round_trip(frame(spark, rows), with_ids=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded").collect()), key=str)
    want = []
    for d, t in rows:
        ids = PLAIN.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), bytearray((t or "").encode())))
    assert got == sorted(want, key=str)
    assert bpe_round_trip(frame(spark, [])).collect() == []
