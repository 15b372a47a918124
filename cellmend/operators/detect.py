"""Detectors of suspicious cells."""

from __future__ import annotations

import logging
from abc import ABC, abstractmethod
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import NULL, TID
from ..plans.violations import violating
from ..sources.tables import cells, known_errors, read_csv, read_table

log = logging.getLogger(__name__)


class Detector(ABC):
    """Gives (_tid_, attribute) of the cells that it suspects."""

    def __init__(self, name: str = ""):
        self.name = name or type(self).__name__

    def setup(self, dataset) -> None:
        self.dataset = dataset

    @abstractmethod
    def detect(self) -> DataFrame: ...


class NullDetector(Detector):
    """Cells without a value."""

    def detect(self) -> DataFrame:
        d = self.dataset
        return cells(d.raw, d.attributes).where(F.col("value") == NULL).select(TID, "attribute")


class ViolationDetector(Detector):
    """Cells of the first tuple of each violation, in the constraint's left attributes."""

    def detect(self) -> DataFrame:
        d = self.dataset
        if not d.constraints:
            log.warning("no constraints are set: no violations")
            return d.raw.select(TID, F.lit("").alias("attribute")).limit(0)
        found = []
        for dc in d.constraints:
            tids = violating(d.raw, dc, d.config.self_pairs)
            found.append(tids.select(TID, F.explode(F.array(*map(F.lit, dc.components))).alias("attribute")))
        return reduce(DataFrame.unionByName, found)


class ErrorsLoaderDetector(Detector):
    """Cells that a table of exactly (id_col, attr_col) names."""

    def __init__(self, errors: DataFrame, id_col: str = TID, attr_col: str = "attribute", name: str = ""):
        super().__init__(name)
        self.errors = known_errors(errors, id_col, attr_col)

    @classmethod
    def from_csv(cls, spark: SparkSession, path: str, id_col: str = TID, attr_col: str = "attribute", name: str = "") -> ErrorsLoaderDetector:
        """Errors of a CSV file with a header."""
        return cls(read_csv(spark, path, drop_empty=False, clean=False), id_col, attr_col, name)

    @classmethod
    def from_table(cls, spark: SparkSession, table: str, schema: str | None = None, id_col: str = TID, attr_col: str = "attribute", name: str = "", **jdbc: str) -> ErrorsLoaderDetector:
        """Errors of a catalog table, or with JDBC options of one of a database."""
        return cls(read_table(spark, table, schema, **jdbc), id_col, attr_col, name)

    def detect(self) -> DataFrame:
        return self.errors


def detect_errors(dataset, detectors: list[Detector]) -> DataFrame:
    """(_tid_, attribute, _cid_): each cell that a detector suspects, once."""
    for detector in detectors:
        detector.setup(dataset)
    found = reduce(DataFrame.unionByName, [d.detect().select(TID, "attribute") for d in detectors])
    return found.dropDuplicates([TID, "attribute"]).withColumn("_cid_", dataset.cell_id(F.col(TID), F.col("attribute")))
