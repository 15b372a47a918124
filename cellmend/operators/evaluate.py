"""Repairs against ground truth.

Cells are compared in the long form, one join for all attributes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TID
from ..sources.tables import cells

_KEY = [TID, "attribute"]


@dataclass(frozen=True)
class EvalReport:
    precision: float
    recall: float
    repair_recall: float
    f1: float
    repair_f1: float
    detected_errors: int
    total_errors: int
    correct_repairs: int
    total_repairs: int
    total_repairs_grdt: int
    total_repairs_grdt_correct: int
    total_repairs_grdt_incorrect: int


def _truth(truth: DataFrame) -> DataFrame:
    return truth.select(TID, F.col("_attribute_").alias("attribute"), F.col("_value_").alias("truth"))


def errors(raw: DataFrame, attributes: list[str], truth: DataFrame) -> DataFrame:
    """(_tid_, attribute, value, truth) of the cells that differ from the truth."""
    return cells(raw, attributes).join(_truth(truth), _KEY).where("value <> truth")


def _counted(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias(name))


def total_errors(raw, attributes, truth) -> DataFrame:
    return _counted(errors(raw, attributes, truth), "total_errors")


def correct_repairs(raw, attributes, truth, inferred) -> DataFrame:
    found = errors(raw, attributes, truth).join(inferred, _KEY).where("rv_value = truth")
    return _counted(found, "correct_repairs")


def total_repairs(domain, inferred) -> DataFrame:
    return _counted(domain.join(inferred, _KEY).where("init_value <> rv_value"), "total_repairs")


def repairs_with_truth(domain, inferred, truth) -> DataFrame:
    """(on_correct, n): repairs of cells with a truth, by whether the initial value was right."""
    rows = domain.join(inferred, _KEY).where("init_value <> rv_value").join(_truth(truth), _KEY)
    return rows.groupBy((F.col("init_value") == F.col("truth")).alias("on_correct")).agg(F.count("*").alias("n"))


def detected_errors(domain, dk_cells, truth) -> DataFrame:
    rows = domain.join(_truth(truth), _KEY).join(dk_cells.select("_cid_"), "_cid_").where("init_value <> truth")
    return _counted(rows, "detected_errors")


def weak_label_stats(domain, dk_cells, truth, inferred) -> DataFrame:
    """Counts of cells by nine facts about them."""
    rows = domain.join(_truth(truth), _KEY).join(dk_cells.select(*_KEY, F.lit(True).alias("_dk")), _KEY, "left")
    rows = rows.join(inferred.select(*_KEY, "rv_value"), _KEY, "left")
    facts = [
        F.col("_dk").isNull().alias("is_clean"), F.col("fixed").alias("cell_status"), F.col("rv_value").isNotNull().alias("is_inferred"),
        (F.col("init_value") == F.col("truth")).alias("init_eq_grdth"), (F.col("init_value") == F.col("rv_value")).alias("init_eq_infer"),
        (F.col("weak_label") == F.col("init_value")).alias("wl_eq_init"), (F.col("weak_label") == F.col("truth")).alias("wl_eq_grdth"),
        (F.col("weak_label") == F.col("rv_value")).alias("wl_eq_infer"), (F.col("truth") == F.col("rv_value")).alias("infer_eq_grdth"),
    ]
    return rows.groupBy(*facts).agg(F.count("*").alias("count"))


def counts(raw, attributes, domain, dk_cells, truth, inferred) -> DataFrame:
    """One row of all counts: one pass over the cells that have a truth, and one over the repairs."""
    rows = cells(raw, attributes).join(_truth(truth), _KEY)
    rows = rows.join(domain.select(*_KEY, "init_value"), _KEY, "left").join(inferred.select(*_KEY, "rv_value"), _KEY, "left")
    rows = rows.join(dk_cells.select(*_KEY, F.lit(True).alias("dk")), _KEY, "left")
    how_many = lambda condition, name: F.coalesce(F.sum(F.expr(condition).cast("long")), F.lit(0)).alias(name)
    out = rows.agg(
        how_many("dk AND init_value <> truth", "detected_errors"), how_many("value <> truth", "total_errors"), how_many("value <> truth AND rv_value = truth", "correct_repairs"),
        how_many("init_value <> rv_value AND init_value = truth", "total_repairs_grdt_correct"), how_many("init_value <> rv_value AND init_value <> truth", "total_repairs_grdt_incorrect"),
    )
    return out.join(F.broadcast(total_repairs(domain, inferred)), F.lit(True))  # one row each


def _ratio(a, b):
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def _harmonic(p, r):
    return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def metrics(counted: DataFrame) -> DataFrame:
    """The counts with precision, recall and their harmonic means; a measure without a base is 0."""
    c = F.col
    out = counted.withColumn("total_repairs_grdt", c("total_repairs_grdt_correct") + c("total_repairs_grdt_incorrect"))
    out = out.withColumn("precision", _ratio(c("correct_repairs"), c("total_repairs_grdt"))).withColumn("recall", _ratio(c("correct_repairs"), c("total_errors"))).withColumn("repair_recall", _ratio(c("correct_repairs"), c("detected_errors")))
    return out.withColumn("f1", _harmonic(c("precision"), c("recall"))).withColumn("repair_f1", _harmonic(c("precision"), c("repair_recall")))


def report(raw, attributes, domain, dk_cells, truth, inferred) -> EvalReport:
    row = metrics(counts(raw, attributes, domain, dk_cells, truth, inferred)).first()
    return EvalReport(**{f: row[f] for f in EvalReport.__dataclass_fields__})
