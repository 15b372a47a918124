"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, chat, host_rules, license_scan, ngram_join, packing, quality_fm, substring, toxicity


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(_read(spark, sf_dir, "documents"), k=4, pct=85).select("doc_id", "n_shingles", "component_id")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), vocabulary_path(), capacity=2048, end_id=1)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_read(spark, sf_dir, "documents"), vocabulary_path())


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_read(spark, sf_dir, "documents"), threshold=0.8)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string"))
    return chat.read_back(chat.format_windows(rows, vocabulary_path(), budget=1024, history=256))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), threshold=0.3, folds=4, held_out=2)


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_read(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20)


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = host_rules.apply_rules(_read(spark, sf_dir, "documents"), host="source")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), threshold=0.3, folds=5, held_out=0)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(_read(spark, sf_dir, "documents"), window=35)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_ngram_jaccard_join, op2_packing, op3_bpe, op4_license_scan, op5_chat, op6_toxicity, op7_ann, op8_host_rules, op9_quality_fm, op10_substring_dedup, pipeline)
    return {f.__name__: f for f in found}
