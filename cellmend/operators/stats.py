"""Statistics of attribute values: counts, co-occurrences, correlations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import NULL, TID
from ..sources.tables import cells

_PAIR = ["a1", "a2", "v1", "v2"]


def single_counts(raw: DataFrame, attributes: list[str]) -> DataFrame:
    """(attribute, value, n), the sentinel included."""
    return cells(raw, attributes).groupBy("attribute", "value").agg(F.count("*").alias("n"))


def pair_counts(raw: DataFrame, attributes: list[str]) -> DataFrame:
    """(a1, a2, v1, v2, n) of each unordered pair of attributes, the sentinel included.

    A row gives one entry for each pair, which is counted before any shuffle.
    """
    if len(attributes) < 2:
        return raw.sparkSession.createDataFrame([], "a1 string, a2 string, v1 string, v2 string, n long")
    pairs = [F.struct(F.lit(a).alias("a1"), F.lit(b).alias("a2"), F.col(f"`{a}`").alias("v1"), F.col(f"`{b}`").alias("v2")) for a, b in combinations(attributes, 2)]
    return raw.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").groupBy(*_PAIR).agg(F.count("*").alias("n"))


def mirrored(pairs: DataFrame) -> DataFrame:
    """Both orders of each pair."""
    other = pairs.select(F.col("a2").alias("a1"), F.col("a1").alias("a2"), F.col("v2").alias("v1"), F.col("v1").alias("v2"), "n")
    return pairs.select(*_PAIR, "n").unionByName(other)


def without_null(counts: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        counts = counts.where(F.col(c) != NULL)
    return counts


def correlations(single: DataFrame, pairs: DataFrame, n_rows: int) -> DataFrame:
    """(x, y, corr): one less the entropy of x given y, in logs of base the number of x's values.

    From counts that include the sentinel: H(x|y) = H(x, y) - H(y). An x of one value has
    correlation 0 with everything; otherwise its own is 1.
    """
    part = -(F.col("n") / n_rows) * F.log(F.col("n") / n_rows)
    alone = single.groupBy("attribute").agg(F.sum(part).alias("h"), F.count("*").alias("ndv"))
    joint = mirrored(pairs.groupBy("a1", "a2").agg(F.sum(part).alias("n")).select("a1", "a2", F.lit("").alias("v1"), F.lit("").alias("v2"), "n")).select(F.col("a1").alias("x"), F.col("a2").alias("y"), F.col("n").alias("hxy"))
    x = alone.select(F.col("attribute").alias("x"), "ndv")
    y = alone.select(F.col("attribute").alias("y"), F.col("h").alias("hy"))
    corr = F.when(F.col("ndv") == 1, 0.0).otherwise(1.0 - (F.col("hxy") - F.col("hy")) / F.log("ndv"))
    other = joint.join(F.broadcast(x), "x").join(F.broadcast(y), "y").select("x", "y", corr.alias("corr"))  # a row for each attribute
    return other.unionByName(x.select("x", F.col("x").alias("y"), F.when(F.col("ndv") == 1, 0.0).otherwise(1.0).alias("corr")))


def correlated(corr: DataFrame, threshold: float) -> DataFrame:
    """(x, y) of different attributes with a correlation above the threshold."""
    return corr.where((F.col("corr") > threshold) & (F.col("x") != F.col("y"))).select("x", "y")


def pruned_pairs(pairs: DataFrame, single: DataFrame, threshold: float) -> DataFrame:
    """Ordered pairs, sentinel excluded, that occur more often than ``threshold`` times their first value."""
    freq = without_null(single, "value").select(F.col("attribute").alias("a1"), F.col("value").alias("v1"), F.col("n").alias("freq"))
    return mirrored(without_null(pairs, "v1", "v2")).join(freq, ["a1", "v1"]).where(F.col("n") > threshold * F.col("freq"))


def frequencies(single: DataFrame) -> DataFrame:
    return without_null(single, "value")


def co_occurrences(pairs: DataFrame) -> DataFrame:
    return mirrored(without_null(pairs, "v1", "v2"))


__all__ = ["TID", "co_occurrences", "correlated", "correlations", "frequencies", "mirrored", "pair_counts", "pruned_pairs", "single_counts", "without_null"]
