"""From documents to training sequences: the stages of the corpus pipeline.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept;
all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellmend.llm import ngram_join, packing, quality_fm, substring, toxicity
from cellmend.llm.queries import vocabulary_path
from cellmend.llm.store import Workspace, scope

#: Documents whose toxicity score reaches this are rejected.
TOXIC = 0.5
#: Documents whose quality score is below this are rejected.
GOOD = 0.3
#: Ids that are broadcast at most; above, the joins shuffle.
BROADCAST_IDS = 1_000_000


def _key(docs: DataFrame) -> DataFrame:
    """A key of a row's id and text: equal rows share it, and have the same scores."""
    return docs.withColumn("_key", F.xxhash64(F.col("doc_id").cast("string"), F.col("text")))


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` (with _key) less the rows of the keys in ``rejected``."""
    small = rejected.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(rejected) if small else rejected, "_key", "left_anti").drop("_key")


def _reject(spark: SparkSession, docs: DataFrame, name: str, score: Callable[[DataFrame], DataFrame], bad) -> DataFrame:
    """Score each row under its key and drop the rows for which ``bad`` holds."""
    keyed = _key(docs)
    renamed = keyed.drop("doc_id").withColumnRenamed("_key", "doc_id")
    scores = Workspace(spark, name).keep(score(renamed).where(bad).select(F.col("doc_id").alias("_key")).distinct(), "rejected")
    return _without(keyed, scores)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the documents that the toxicity model finds toxic; it learns from all labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, "toxic", folds=1, held_out=1)
    return _reject(spark, docs, "toxic", lambda d: toxicity.score(d, model), F.col("score") >= TOXIC)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the documents that the quality classifier scores low; it learns from all labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = quality_fm.fit(docs, labels, "quality", folds=1, held_out=1)
    return _reject(spark, docs, "quality", lambda d: quality_fm.score(d, machine), F.col("score") < GOOD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at 0.8 the one of the smallest doc_id
    stays (of several rows of that id one row stays); documents without words stay."""
    work = Workspace(spark, "near")
    linked = ngram_join.jaccard_join(docs, k=5, pct=80, work=work).where("n_shingles > 0")
    if _repeats(docs):
        # a doc_id may have texts of several groups: its rows are told apart by node
        rows = work.keep(linked.select("doc_id", "node", "component_id", "root").distinct(), "rows")
        stay = rows.where("doc_id = component_id").groupBy("root").agg(F.min("doc_id").alias("doc_id"), F.min("node").alias("node"))
        drop = rows.select("doc_id", "node").join(stay, ["doc_id", "node"], "left_anti")
        named = ngram_join.with_nodes(docs, 5)
        kept = named.join(drop, (named["doc_id"].cast("long") == drop["doc_id"]) & (named["node"] == drop["node"]), "left_anti")
        same = Window.partitionBy("doc_id", "node", F.when(F.col("n_shingles") == 0, F.col("text"))).orderBy("text")
        return kept.withColumn("_r", F.row_number().over(same)).where("_r = 1").select(*docs.columns)
    drop = work.keep(linked.where("doc_id <> component_id").select("doc_id").distinct(), "drop")
    small = drop.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(drop) if small else drop, docs["doc_id"].cast("long") == drop["doc_id"], "left_anti")


def _repeats(docs: DataFrame) -> bool:
    """Has a doc_id several rows?"""
    return bool(docs.groupBy("doc_id").count().where("count > 1").limit(1).count())


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 35 words and more that occur again; n_chars follows the text."""
    out = substring.remove_repeats(docs, window=35)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 2048 tokens."""
    return packing.pack(docs, vocabulary_path(), capacity=2048, end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality_classifier", drop_low_quality),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("packing", pack),
]

#: Trained models and connected components are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next.

    What a stage wrote goes when the next has been written, its intermediate tables at once.
    """
    work = Workspace(spark, "pipeline")
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scope():
            docs = work.keep(stage(spark, docs, sf_dir), name)
        if last:
            work.drop(last)
        last = name
    return STAGES[-1][1](spark, docs, sf_dir)
