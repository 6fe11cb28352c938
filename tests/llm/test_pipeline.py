import zlib

import corpus_pipeline as pipeline

from .cases import CLASHES, frame, lower, texts
from .test_jaccard import expected
from .test_toxicity import corpus


def tables(spark, path):
    rows, labels = corpus(240, seed=9)
    extra = [(1000, rows[1][1].upper(), "x"), (1001, rows[2][1], "x"), (1001, rows[2][1], "x"), (1002, None, None), (1003, "", "y"), (1004, rows[3][1] + " end", "x")]
    docs = [(i, t, "s") for i, t in rows] + extra
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return docs, dict(labels)


def test_stages_take_effect(spark, tmp_path):
    docs, toxic = tables(spark, str(tmp_path))
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    step = dict(pipeline.STAGES)

    clean = step["toxicity"](spark, table, str(tmp_path))
    assert clean.columns == table.columns
    left = [tuple(r) for r in clean.collect()]
    wrong = sum(toxic.get(r[0], 0) for r in left) + sum(1 for d in docs if d[0] in toxic and not toxic[d[0]] and d not in left)
    assert wrong <= 5 and set(left) <= set(docs)

    once = step["exact dedup"](spark, table, str(tmp_path))
    best = {}
    for d in docs:
        best[lower(d[1])] = max(best.get(lower(d[1]), d), d, key=lambda x: x[0])
    assert sorted(map(tuple, once.collect()), key=str) == sorted(best.values(), key=str)

    far = step["n-gram jaccard join"](spark, once, str(tmp_path))
    firsts = {d for d, _, c in expected([(d[0], d[1]) for d in best.values()]) if d == c}
    assert {r.doc_id for r in far.collect()} == firsts


def test_run(spark, tmp_path):
    docs, toxic = tables(spark, str(tmp_path))
    out = pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in out}
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out[0].asDict())
    assert len(kept & {i for i, t in toxic.items() if not t}) > 150 and len(kept & {i for i, t in toxic.items() if t}) < 10
    assert not {1, 2} & kept and len([r for r in out if r.doc_id == 1001]) == 1  # the copies with larger ids stay
    assert zlib.crc32(b"\0\0\0\0") in {r.ids_crc32 for r in out}  # an empty text is one end token


def test_odd_and_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []


def odd_columns(spark, rows):
    """The columns of documents and many that could clash with names that stages use themselves."""
    from pyspark.sql import functions as F

    more = ["_id", "_row", "_text", "_sha", "_first", "copy_row", "copy_text", "toxic_score", "_toxic_score", "first_id", "kept", "best", "keep_id", "text_sha256", "component_id", "n", "low", "row", "length", "piece", "h"]
    taken = {c.split(" ")[0] for c in CLASHES.split(", ")}
    return frame(spark, rows).select("*", *(F.lit(f"own {c}").alias(c) for c in more if c not in taken))


def test_stages_take_odd_rows_and_clashing_columns(spark, tmp_path):
    rows = texts(4) + [(800, "again and again")] * 300
    docs = odd_columns(spark, rows)
    spark.createDataFrame([(i, i % 2) for i in range(25)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        kept = out.collect()
        assert kept and all(r.copy_row == "own copy_row" and r.toxic_score == "own toxic_score" and r.h is None for r in kept), name
    once = [(r.doc_id, r.text) for r in pipeline.drop_copies(spark, docs, str(tmp_path)).collect()]
    groups = {}
    for d, t in rows:
        groups[lower(t)] = max((x for x in (groups.get(lower(t)), d) if x is not None), default=None)
    assert sorted(((d, lower(t)) for d, t in once), key=str) == sorted(((d, t) for t, d in groups.items()), key=str)
    empty = docs.limit(0)
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).collect() == [], name
    packed = pipeline.pack(spark, docs, str(tmp_path)).collect()
    assert sum(r.piece == 0 for r in packed) == len(rows)


def test_no_labels_keep_everything(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = frame(spark, texts(4))
    assert pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == docs.count()
