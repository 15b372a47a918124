"""Suspicious cells of a stream of tuples: missing values and constraints of one tuple."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import NULL, TID
from ..plans.constraints import Constraint
from ..plans.violations import violating
from ..sources.tables import cells


def suspicious(rows: DataFrame, attributes: list[str], constraints: list[Constraint]) -> DataFrame:
    """(_tid_, attribute) of a streaming or static table with sentinels; stateless.

    Constraints between two tuples need the whole table and are refused.
    """
    if any(len({t for p in c.predicates for t in p.tuples}) > 1 for c in constraints):
        raise ValueError("a constraint between two tuples cannot be checked on a stream")
    found = [cells(rows, attributes).where(F.col("value") == NULL).select(TID, "attribute")]
    found += [violating(rows, c).select(TID, F.explode(F.array(*map(F.lit, c.components))).alias("attribute")) for c in constraints]
    return reduce(DataFrame.unionByName, found)
