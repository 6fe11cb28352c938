import random
import zlib

import numpy as np

from tieplane.llm import toxicity as tox


def corpus(n=600, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeionrst") for _ in range(rng.randint(2, 7)))
    rows, labels = [], []
    for i in range(n):
        words, bad = [word() for _ in range(rng.randint(10, 80))], i % 4 == 0
        if bad:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["Vermin", "cretin", "dimwit"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_rows_are_told_apart_and_never_learnt_from(spark):
    rows, labels = corpus()
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in tox.toxicity(docs, known).collect()}
    assert len(got) == len(rows)
    truth = dict(labels)
    out = [r for r in got.values() if r.held_out]
    assert {r.doc_id for r in out} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.95
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())
    swapped = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels], "doc_id long, toxic int")
    again = {r.doc_id: r.score for r in tox.toxicity(docs, swapped).collect()}
    assert again == {i: r.score for i, r in got.items()}


def test_odd_rows(spark):
    rows, labels = corpus(200)
    odd = [(900, None), (901, ""), (902, ""), (903, "cretin " * 300_000), (904, "x"), (0, rows[0][1]), (None, "vermin")]
    docs = spark.createDataFrame([(d, t, 1.0, "x") for d, t in rows + odd], "doc_id long, text string, score double, _label string")
    known = spark.createDataFrame([(*x, None) for x in labels] + [(5, None, None), (77777, 1, None), (None, 1, None)], "doc_id long, toxic int, weights string")
    got = tox.toxicity(docs, known).collect()
    assert len(got) == len(rows) + len(odd)
    score = {}
    for r in got:
        score.setdefault(r.doc_id, []).append(r.score)
    assert score[900] == score[901] == score[902] and score[903][0] > 0.5 and score[0][0] == score[0][1]


def test_no_labels_and_no_rows(spark):
    rows, labels = corpus(20)
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    assert {r.score for r in tox.toxicity(docs, known.limit(0)).collect()} == {0.5}
    assert tox.toxicity(docs.limit(0), known).collect() == []


def test_windows_change_nothing(monkeypatch):
    text = " ".join(t for _, t in corpus(60)[0])
    whole = set(tox.Grams()(text).tolist())
    monkeypatch.setattr(tox, "STEP", 100)
    parts = tox.Grams()(text).tolist()
    assert set(parts) == whole and len(parts) == len(whole)


def plain_slots(text):
    """Distinct slots of all substrings, one by one."""
    t = " " + "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "\t\n\r\x0b\x0c" else c for c in text) + " "
    out, mask = set(), (1 << 64) - 1
    for n in tox.GRAMS:
        for i in range(len(t) - n + 1):
            h = sum((ord(c) + 1) * int(p) for c, p in zip(t[i : i + n], tox.PLACE, strict=False)) * 0x9FB21C651E98DF25 & mask
            out.add(((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 & mask) >> (64 - tox.BITS))
    return out


def test_scores_match_a_plain_recomputation(spark):
    rows, labels = corpus(80, seed=5)
    rows = [(i, t + (" Ünï\tCÖDE 漢字" if i % 3 else "")) for i, t in rows]
    truth = dict(labels)
    known = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 5]
    sets, y = [plain_slots(t) for _, t in known], np.array([float(truth[i]) for i, _ in known])
    ratio = {}
    for slot in set().union(*sets):
        n, p = sum(slot in s for s in sets), sum(slot in s for s, v in zip(sets, y, strict=True) if v)
        r = np.log((p + 1) / (y.sum() + 2)) - np.log((n - p + 1) / (len(y) - y.sum() + 2))
        if n >= 3 and abs(r) >= 0.3:
            ratio[slot] = r
    used = sorted(ratio)
    dense = lambda s: np.array([ratio[k] * (k in s) for k in used]) / max(1, len(s)) ** 0.5
    x = np.array([dense(s) for s in sets])
    w, b, vw, vb = np.zeros(len(used)), 0.0, np.zeros(len(used)), 0.0
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    rate = 4.0 / ((x**2).sum(axis=1).mean() + 1)
    for _ in range(150):
        g = (1 / (1 + np.exp(-(x @ w + b))) - y) * weight
        vw, vb = 0.9 * vw - rate * (x.T @ g + 1e-4 * w), 0.9 * vb - rate * g.sum()
        w, b = w + vw, b + vb
    want = {i: 1 / (1 + np.exp(-(dense(plain_slots(t)) @ w + b))) for i, t in rows}
    got = tox.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(rows) and max(abs(r.score - want[r.doc_id]) for r in got) < 1e-3


def test_repeated_ids_and_the_bound_on_slots(spark):
    rows, labels = corpus(120, seed=6)
    many = spark.createDataFrame(rows, "doc_id long, text string").unionByName(spark.createDataFrame([(1, rows[1][1])], "doc_id long, text string").crossJoin(spark.range(10_000)).drop("id"))
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    once = tox.train(spark.createDataFrame(rows, "doc_id long, text string"), known)
    again = tox.train(many, known)
    assert np.array_equal(once.weights, again.weights) and once.bias == again.bias and once.learnt
    small = tox.train(many, known, slots=2000)
    assert small.learnt and not np.array_equal(small.weights, once.weights)
    assert not tox.train(many, known.filter("toxic = 1")).learnt
