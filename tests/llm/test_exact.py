import hashlib
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tieplane.llm import exact

from .cases import frame, lower, texts


def expected(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[lower(t)].append(d)
    out = Counter()
    for text, ids in groups.items():
        keep = max((d for d in ids if d is not None), default=None)
        sha, seen = hashlib.sha256(text.encode()).hexdigest(), False
        for d in ids:
            out[d, keep, len(ids), d == keep and not seen, sha] += 1
            seen |= d == keep
    return out


def test_matches_brute_force(spark):
    rows = texts()
    assert Counter(map(tuple, exact.exact_groups(frame(spark, rows)).collect())) == expected(rows)


def test_ambiguous_identifiers_are_told_apart(spark, monkeypatch):
    rows = texts(2)
    few = lambda c: F.pmod(F.xxhash64(c), F.lit(7))
    assert Counter(map(tuple, exact.exact_groups(frame(spark, rows), identify=few).collect())) == expected(rows)
    monkeypatch.setattr(exact, "SPELLED", 2)
    assert Counter(map(tuple, exact.exact_groups(frame(spark, rows), identify=few).collect())) == expected(rows)


def test_chunks_join_to_the_text_and_are_cut_by_content(spark):
    rng = random.Random(8)
    long = " ".join(rng.choice(["words", "and", "more", "pencils", "for", "bread", "beds", "all", "in"]) for _ in range(12_000))
    df = spark.createDataFrame([(long,), ("x" * 10_000,), ("",), ("odd start " + long,)], "t string").select("t", exact.chunks(F.col("t")).alias("c"))
    got = df.collect()
    assert all("".join(r.c) == r.t for r in got)
    assert len(set(got[0].c) & set(got[3].c)) > 0.5 * len(set(got[0].c))  # cuts meet again after an insertion
    assert max(len(c) for r in got for c in r.c) <= 4096


def test_any_script_is_cut_by_content(spark):
    rng = random.Random(9)
    for first in (0x430, 0x4E00, 0x5D0, 0xE01, 0x1F600):
        long = "".join(" " if rng.random() < 0.1 else chr(first + rng.randrange(30)) for _ in range(20_000))
        a, b = spark.createDataFrame([(long,), (chr(first) * 5 + long,)], "t string").select(exact.chunks(F.col("t")).alias("c")).collect()
        assert "".join(a.c).encode("latin-1").decode() == long
        assert len(set(a.c) & set(b.c)) > 0.5 * len(set(a.c))


def test_empty_table(spark):
    assert exact.exact_groups(frame(spark, [])).collect() == []


def test_a_hot_group(spark):
    rows = [(i, "Copied Text") for i in range(3000)] + [(i, f"text {i // 2}") for i in range(3000, 4000)]
    assert Counter(map(tuple, exact.exact_groups(frame(spark, rows)).collect())) == expected(rows)


def test_one_row_repeated_very_often(spark):
    rows = [(7, "Same")] * 3000 + [(3, "same"), (None, "x"), (None, "x"), (1, "y")]
    assert Counter(map(tuple, exact.exact_groups(frame(spark, rows)).collect())) == expected(rows) | Counter()
