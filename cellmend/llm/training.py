"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(folds: int):
    """crc32 of the doc_id as text, modulo ``folds``; a null doc_id has no remainder."""
    return F.crc32(F.col("doc_id").cast("string")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, max_docs: int) -> DataFrame:
    """``docs`` with their label (0 or 1), of at most about ``max_docs`` labelled documents.

    Left out are the held-out fold and labels that are null. Which documents are taken depends
    on a hash of their doc_id; where a document has several labels the largest counts.
    The ids that are broadcast are as many as the sample.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null")
    usable = usable.where(remainder(folds) != held_out).groupBy("doc_id").agg(F.max("label").alias("label"))
    n = usable.count()
    share = min(1.0, max_docs / max(1, n))
    taken = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20)))
    return docs.withColumn("doc_id", F.col("doc_id").cast("long")).join(F.broadcast(taken), "doc_id")
