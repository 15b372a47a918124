"""Inferred values and the repaired table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import NULL, TID


def distributions(probs: DataFrame) -> DataFrame:
    """(_vid_, distribution): each cell's probabilities in the order of its domain."""
    pairs = F.array_sort(F.collect_list(F.struct("val_idx", "prob")))
    return probs.groupBy("_vid_").agg(F.transform(pairs, lambda s: s["prob"]).alias("distribution"))


def inferred_values(probs: DataFrame, domain: DataFrame) -> DataFrame:
    """(_vid_, inferred_val_idx, inferred_val, prob): the likeliest candidate, of equal ones the first."""
    best = probs.groupBy("_vid_").agg(F.max(F.struct("prob", (-F.col("val_idx")).alias("i"))).alias("b"))
    best = best.select("_vid_", (-F.col("b.i")).alias("inferred_val_idx"), F.col("b.prob").alias("prob"))
    return best.join(domain.select("_vid_", "domain"), "_vid_").select("_vid_", "inferred_val_idx", F.element_at("domain", F.col("inferred_val_idx") + 1).alias("inferred_val"), "prob")


def inferred_cells(domain: DataFrame, inferred: DataFrame) -> DataFrame:
    """(_tid_, attribute, rv_value)."""
    return domain.join(inferred, "_vid_").select(TID, "attribute", F.element_at("domain", F.col("inferred_val_idx") + 1).alias("rv_value"))


def repaired(raw: DataFrame, cells: DataFrame, attributes: list[str], nulls: bool = True) -> DataFrame:
    """``raw`` with the inferred values of ``cells`` (_tid_, attribute, rv_value); missing values are real nulls.

    nulls: False keeps the sentinel instead.
    """
    by_tid = cells.groupBy(TID).agg(F.map_from_entries(F.collect_list(F.struct("attribute", "rv_value"))).alias("_new"))
    rows = raw.join(by_tid, TID, "left")
    value = lambda a: F.coalesce(F.element_at("_new", F.lit(a)), F.col(f"`{a}`"))
    out = {a: F.when(value(a) != NULL, value(a)) if nulls else value(a) for a in attributes}
    return rows.select(*(out[c].alias(c) if c in out else F.col(f"`{c}`") for c in raw.columns))
