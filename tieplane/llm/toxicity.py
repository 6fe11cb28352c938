"""Toxicity scores: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: n-grams of so many characters, within and across words.
GRAMS = (3, 4, 5, 6)
#: Features are hashed to 2**BITS slots.
BITS = 20
#: Labelled rows of each class that are learnt from, at most; the smallest hashes of id and text are taken.
SAMPLE = 2000
#: Distinct n-grams of the labelled rows of a class that are learnt from, at most, in all: rows past that are left out.
SLOTS = 1 << 24
#: Characters of text that one piece of scoring work handles; slots that travel in one row; entries that are summed at once.
STEP, ROW, CHUNK = 1 << 20, 512, 1 << 20
#: One odd multiplier for each place of an n-gram.
PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD], np.uint64)


def characters(text: str) -> np.ndarray:
    """The code points of a text between two spaces, A-Z lower-cased, white space of ASCII as spaces."""
    codes = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    codes[(codes >= 65) & (codes <= 90)] += np.uint64(32)
    codes[(codes >= 9) & (codes <= 13)] = 32
    return codes


class Grams:
    """Slots of a text's distinct n-grams, at most 2**BITS whatever the text's length."""

    def __init__(self):
        self.last = np.zeros(1 << BITS, np.int32)
        self.seen = np.zeros(1 << BITS, bool)

    def window(self, data: np.ndarray, starts: int) -> np.ndarray:
        """Distinct slots of the n-grams that start at the first ``starts`` characters."""
        data = data + np.uint64(1)
        found, part = [np.empty(0, np.int32)], np.zeros(len(data), np.uint64)
        for k in range(min(max(GRAMS), len(data))):
            part = part[: len(data) - k] + data[k:] * PLACE[k]
            if k + 1 in GRAMS:
                h = part[:starts] * np.uint64(0x9FB21C651E98DF25)
                found.append(((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int32))
        slots = np.concatenate(found)
        at = np.arange(len(slots), dtype=np.int32)
        self.last[slots] = at  # of equal slots the last one stays
        return slots[self.last[slots] == at]

    def __call__(self, text: str) -> np.ndarray:
        data = characters(text)
        if len(data) <= STEP:
            return self.window(data, len(data))
        parts = []
        for lo in range(0, len(data), STEP):
            slots = self.window(data[lo : lo + STEP + max(GRAMS) - 1], STEP)
            slots = slots[~self.seen[slots]]
            self.seen[slots] = True
            parts.append(slots)
        out = np.concatenate(parts)
        self.seen[out] = False
        return out


class Model:
    """Scores texts: the sum of the weights of a text's n-grams, by the root of their number, and a bias.

    ``learnt`` is False if there were not labels of both classes.
    """

    def __init__(self, weights: np.ndarray, bias: float, learnt: bool = True):
        self.weights, self.bias, self.learnt = weights, bias, learnt

    def score(self, texts: list[str]) -> np.ndarray:
        grams = Grams()
        z = np.array([self.weights[s].sum(dtype=np.float64) / max(1, len(s)) ** 0.5 for s in map(grams, texts)], np.float64)
        return 1 / (1 + np.exp(-np.clip(z + self.bias, -40, 40)))


def log_count_ratios(seen: np.ndarray, positive: np.ndarray, y: np.ndarray, smoothing: float) -> np.ndarray:
    """The naive Bayes log-count ratio of each slot; 0 if it is in fewer than three texts or hardly tied to a class."""
    ratio = np.log((positive + smoothing) / (y.sum() + 2 * smoothing)) - np.log((seen - positive + smoothing) / (len(y) - y.sum() + 2 * smoothing))
    ratio[(seen < 3) | (np.abs(ratio) < 0.3)] = 0
    return ratio


def fit(rows: list[np.ndarray], labels: np.ndarray, smoothing: float = 1.0, penalty: float = 1e-4, steps: int = 150) -> Model:
    """Logistic regression on presence features (the slots of each text) times their naive Bayes log-count ratios.

    Deterministic: full gradients with momentum, from zero. With one class only, all texts get that class's
    smoothed share.
    """
    y = labels.astype(np.float64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << BITS, np.float32), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), False)
    seen, p = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for r, label in zip(rows, y.tolist(), strict=True):
        seen[r] += 1
        p[r] += label
    ratio = log_count_ratios(seen, p, y, smoothing)
    size = np.array([max(1, len(r)) for r in rows]) ** -0.5
    for i, r in enumerate(rows):  # in place, so that what is left out is freed
        rows[i] = r[ratio[r] != 0]
    row, column = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows]), np.concatenate(rows)
    rows.clear()
    used = np.flatnonzero(np.bincount(column, minlength=1 << BITS))
    place = np.zeros(1 << BITS, np.int32)
    place[used] = np.arange(len(used))
    value = np.empty(len(row), np.float32)
    parts = [slice(lo, lo + CHUNK) for lo in range(0, len(row), CHUNK)]
    for k in parts:
        value[k] = ratio[column[k]] * size[row[k]]
        column[k] = place[column[k]]

    def summed(at: np.ndarray, weights, n: int) -> np.ndarray:
        total = np.zeros(n)
        for k in parts:
            total += np.bincount(at[k], weights=weights(k), minlength=n)
        return total

    w, b, vw, vb = np.zeros(len(used)), 0.0, np.zeros(len(used)), 0.0
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    rate = 4.0 / (summed(row, lambda k: value[k].astype(np.float64) ** 2, len(y)).mean() + 1)
    for _ in range(steps):
        z = summed(row, lambda k: value[k] * w[column[k]], len(y)) + b  # noqa: B023
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight
        vw = 0.9 * vw - rate * (summed(column, lambda k: value[k] * g[row[k]], len(used)) + penalty * w)  # noqa: B023
        vb = 0.9 * vb - rate * g.sum()
        w, b = w + vw, b + vb
    out = np.zeros(1 << BITS, np.float32)
    out[used] = w * ratio[used]
    return Model(out, float(b))


def held_out(id_col: str = "doc_id"):
    """Rows that are never learnt from: crc32 of the id's text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, slots: int = SLOTS) -> Model:
    """Learns from at most ``sample`` labelled rows of each class, those of the smallest id hashes, and of them no
    more than have ``slots`` n-grams in all.

    Labels of held-out rows are never read. Of rows with one id the smallest text counts, of repeated labels of
    one id the largest; null labels are ignored. Features are drawn in many tasks; the one that fits the
    model holds them, which ``sample`` and ``slots`` bound whatever the texts' number and length.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).dropna().filter(~held_out("id"))
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    chosen = [known.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(sample) for k in (0, 1)]
    few = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * sample rows
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(few, "id")
    texts = texts.groupBy("id", "label").agg(F.min("text").alias("text")).select(F.xxhash64("id").alias("h"), "label", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            for h, label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = grams(text)
                cuts = range(0, max(1, len(s)), ROW)
                cols = [[h] * len(cuts), [label] * len(cuts), [len(s)] + [0] * (len(cuts) - 1), [*range(len(cuts))], [s[lo : lo + ROW].tobytes() for lo in cuts]]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["h", "label", "n", "part", "slots"])

    rows = Scratch(docs.sparkSession, "toxicity").keep(texts.mapInArrow(features, "h long, label int, n long, part int, slots binary"), "features")
    sizes = rows.filter("part = 0").select("h", "label", "n").toPandas().sort_values("h")  # at most 2 * sample rows
    sizes = sizes[sizes.groupby("label")["n"].cumsum() <= slots]
    if not len(sizes):
        return fit([], np.empty(0))
    last = sizes.groupby("label")["h"].max()
    within = F.lit(False)
    for label, h in last.items():
        within = within | ((F.col("label") == int(label)) & (F.col("h") <= int(h)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for h, label, part, slots in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found.setdefault(h, []).append((part, label, slots))
        if not found:
            return
        texts, y = [], []
        for h in sorted(found):
            parts = sorted(found.pop(h))
            texts.append(np.frombuffer(b"".join(p[2] for p in parts), np.int32))
            y.append(parts[0][1])
        model = fit(texts, np.array(y))
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()]), pa.array([model.bias]), pa.array([model.learnt])], ["weights", "bias", "learnt"])

    (got,) = rows.filter(within).select("h", "label", "part", "slots").repartition(1).mapInArrow(run, "weights binary, bias double, learnt boolean").collect()
    return Model(np.frombuffer(got.weights, np.float32), got.bias, got.learnt)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """Adds the score of each whole text to all columns of ``docs``, which must not have one of that name; null
    counts as empty."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # 2**BITS floats
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for batch in batches:
            texts = batch.column(at)
            scores = np.concatenate([np.empty(0), *(own.score([t or "" for t in texts.slice(lo, 256).to_pylist()]) for lo in range(0, len(texts), 256))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, out])

    from pyspark.sql.types import DoubleType, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(out, DoubleType()))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learns toxicity from the labels and scores every document.

    Returns doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5). Empty and null texts get the
    score of two spaces; very long texts are scored whole, a stretch at a time; repeated rows and ties are scored
    alike; a null id is scored and never learnt from; without labels every score is 0.5; an empty table
    gives no rows. Only the text enters a score. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = score(rows, train(docs, labels, id_col, text_col))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
