"""A corpus pipeline of four stages; each works on all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieplane.llm.common import HEAVY, Scratch, ascii_lower, fresh
from tieplane.llm.exact import exact_groups
from tieplane.llm.jaccard import jaccard_components
from tieplane.llm.packing import pack_documents
from tieplane.llm.toxicity import score, train


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the classifier, learnt from the labels of its own input, scores below 0.5.

    Null and empty texts, which have no n-grams, get the score of such a text; very long texts are scored whole;
    repeated rows and ties share a score and so a fate; without labels, or of one class only, nothing is known
    to be toxic and all rows stay; an empty table stays empty; all columns are kept, whatever their names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels)
    (name,) = fresh(docs, "toxic_score")
    if not model.learnt:
        return docs
    return score(docs, model, out=name).filter(F.col(name) < 0.5).drop(name)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of equal texts the row with the largest doc_id; of repeated rows with that id and text any one.

    Null and empty texts are equal; a null doc_id stays only where no other has that text; very long texts count
    whole; an empty table stays empty; all columns are kept, whatever their names.
    """
    row, text = fresh(docs, "copy_row", "copy_text")
    groups = exact_groups(docs).select(F.col("doc_id").alias(row), F.col("text_sha256").alias(text), "kept", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("best"))
    groups = Scratch(spark, "copies").keep(groups, "groups")
    kept, repeats = groups.filter("kept").select(row, text), groups.filter("best AND NOT kept")
    sha = F.sha2(ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("binary"), 256)
    named = docs.withColumns({row: F.col("doc_id"), text: sha})

    def among(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        left, right = left.alias("l"), right.alias("r")
        return left.join(right, F.col(f"l.{row}").eqNullSafe(F.col(f"r.{row}")) & (F.col(f"l.{text}") == F.col(f"r.{text}")), how)

    if not repeats.isEmpty():
        counts = repeats.groupBy(row, text).agg(F.count(F.lit(1)).alias("n"))
        hot = F.broadcast(counts.filter(F.col("n") > max(1, docs.count() // HEAVY)).select(row, text))  # fewer than HEAVY rows
        once = among(named, hot, "left_semi").dropDuplicates([row, text])  # partial results first, so no task meets a row's repeats
        named = among(named, hot, "left_anti")
        other = counts.select(row, text)
        again = among(among(named, other, "left_semi"), kept, "left_semi").dropDuplicates([row, text])
        out = among(among(named, other, "left_anti"), kept, "left_semi").unionByName(again).unionByName(once)
    else:
        out = among(named, kept, "left_semi")
    return out.drop(row, text)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked texts the document with the smallest doc_id.

    Rows that share a doc_id, which ``documents`` has not, stay together. Null, empty and blank texts link to
    nothing and stay; very long texts count whole; a null doc_id stays unless its group has another one; an
    empty table stays empty; all columns are kept, whatever their names.
    """
    (first,) = fresh(docs, "first_id")
    firsts = jaccard_components(docs).filter("component_id <=> doc_id").select(F.col("doc_id").alias(first)).distinct()
    left, right = docs.alias("l"), firsts.alias("r")
    return left.join(right, F.col("l.doc_id").eqNullSafe(F.col(f"r.{first}")), "left_semi")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the kept documents into sequences: one row a piece, as ``pack_documents`` defines for nulls, empty and
    very long texts, ties, repeated rows, empty tables and other columns."""
    return pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("n-gram jaccard join", drop_near_copies), ("best-fit packing", pack)]
#: A trained classifier and a tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(scratch.path(str(k)))
        docs = spark.read.parquet(scratch.path(str(k)))
        scratch.release()
    return docs
