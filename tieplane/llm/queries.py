"""Queries opN_<name> and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shards import balanced_shards

    return balanced_shards(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import bpe_round_trip

    return bpe_round_trip(_table(spark, sf_dir, "documents"))


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge, rules_frame

    return judge(_table(spark, sf_dir, "pages"), rules_frame(spark))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import notices, scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"), notices(spark))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact import exact_groups

    return exact_groups(_table(spark, sf_dir, "documents"))


def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import warc_round_trip

    return warc_round_trip(_table(spark, sf_dir, "pages"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_round_trip

    return media_round_trip(_table(spark, sf_dir, "documents"))


def op11_late_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sessions import conversation_events, merge_sessions

    return merge_sessions(conversation_events(_table(spark, sf_dir, "conversations")))


def op12_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periods import periodic_runs, with_planted_runs

    return periodic_runs(with_planted_runs(_table(spark, sf_dir, "documents")))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    from . import exact, licenses, urls, warc

    return {"op4_url_rules": urls.ORACLE, "op6_license_scan": licenses.ORACLE, "op8_exact_dedup": exact.ORACLE, "op9_warc_round_trip": warc.ORACLE}
