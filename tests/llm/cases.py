"""Small tables with the cases that every operator must take."""

import random

CLASHES = "key long, block int, h string, n double, cid string, label string, id string, part string"


def texts(seed: int = 1) -> list[tuple]:
    """doc_id, text: nulls, empty and blank texts, ties, repeated rows, a very long text, near copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randint(1, 9)))
    sentence = lambda n: " ".join(word() for _ in range(n))
    base = [sentence(rng.randint(30, 120)) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(base)]
    for k in range(60):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = word()
        rows.append((100 + k, " ".join(words)))
    rows += [(200, None), (201, None), (202, ""), (203, ""), (204, " \n\t "), (205, "One two"), (206, "one TWO"), (207, "É"), (208, "é"), (209, "a" * 9000), (210, "  "), (211, "one two")]
    rows += [(300, base[0].upper()), (301, base[0]), (301, base[0]), (None, base[1]), (302, sentence(30_000))]
    rng.shuffle(rows)
    return rows


def frame(spark, rows, clash=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if not clash:
        return df
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit(None).cast(c.split(" ")[1]).alias(c.split(" ")[0]) for c in CLASHES.split(", ")))


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
