import hashlib
import random
import zlib
from collections import Counter

from tieplane.llm import periods

from .cases import frame, texts


def brute_runs(words):
    out, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and (i, j + q) not in out:
                out[i, j + q] = q
            i = j
    return sorted((s, e - s, q) for (s, e), q in out.items())


def planted(d, words):
    h = zlib.crc32(str(d).encode())
    n, g = len(words), h // 10
    if d is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(rows, plant=False):
    out = Counter()
    for d, t in rows:
        words = (t or "").encode().split()
        words = planted(d, words) if plant else words
        runs = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
        drop = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        sha = lambda b: hashlib.sha256(b).hexdigest()
        kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
        out[d, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join("%d,%d,%d\n" % r for r in runs).encode()), sha(kept)] += 1
    return out


def cases(seed):
    rng = random.Random(seed)
    rows = [r for r in texts(seed) if len(r[1] or "") < 50_000]
    for k in range(250):
        words = []
        for _ in range(rng.randint(0, 8)):
            unit = [rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(1, 6))]
            words += (unit * rng.randint(1, 9))[: rng.randint(1, 60)]
        rows.append((5000 + k, rng.choice([" ", "\n", " \t"]).join(words)))
    return rows + [(9000, "a " * 700), (9001, ("a " * 5 + "b ") * 90), (9002, "a b " * 4), (9003, "a b " * 3 + "a"), (9004, "x " * 5), (9005, "x " * 6)]


def test_runs_match_brute_force():
    rng = random.Random(1)
    for k in range(60):
        docs = [[rng.choice([b"a", b"b", b"c"][: rng.randint(1, 3)]) for _ in range(rng.randint(0, 50))] for _ in range(20)]
        docs += [([b"a", b"b", b"b"][: rng.randint(1, 3)] * 30)[: rng.randint(0, 80)] + docs[0] for _ in range(5)]
        assert periods.document_runs(docs) == [sorted(brute_runs(d), key=lambda r: (r[0], r[2])) for d in docs]


def test_matches_brute_force(spark):
    rows = cases(2)
    assert Counter(map(tuple, periods.periodic_runs(frame(spark, rows)).collect())) == expected(rows)


def test_planted_runs(spark):
    rows = cases(3)
    assert Counter(map(tuple, periods.periodic_runs(periods.with_planted_runs(frame(spark, rows))).collect())) == expected(rows, True)


def test_collapsed_texts(spark):
    rows = [(1, "so  so so so so so it\tgoes"), (2, None), (3, "plain words")]
    assert {r.doc_id: r.text for r in periods.collapse_runs(frame(spark, rows)).collect()} == {1: "so it goes", 2: "", 3: "plain words"}


def test_slices_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(periods, "SLICE", 50)
    rows = cases(4)
    docs = [(t or "").encode().split() for _, t in rows]
    parts = [r for part in periods._slices([(t or "").encode() for _, t in rows]) for r in periods.document_runs(part)]
    assert parts == periods.document_runs(docs)


def test_very_long_and_empty(spark):
    rows = [(1, "word " * 300_000), (2, "one two three " * 100_000)]
    got = {r.doc_id: r for r in periods.periodic_runs(frame(spark, rows)).collect()}
    assert (got[1].length, got[1].period, got[2].length, got[2].period) == (300_000, 1, 300_000, 3)
    assert periods.periodic_runs(frame(spark, [])).collect() == []
