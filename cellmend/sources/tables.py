"""Loading tables, known errors, constraints and ground truth; writing results."""

from __future__ import annotations

import logging
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import NULL, TID
from ..functions.text import na_to_null, normalize

log = logging.getLogger(__name__)

#: Rows of a table of values or counts that are broadcast at most to the cells that they meet; above, the join shuffles.
BROADCAST_VALUES = 200_000


def read_csv(spark: SparkSession, path: str, na_values=None, exclude: Iterable[str] = (TID,), drop_empty: bool = True, clean: bool = True) -> DataFrame:
    """A CSV file with a header, all columns as text; missing-value texts become null before anything else."""
    raw = spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"', multiLine=True, encoding="UTF-8")
    return prepare(raw, na_values, exclude, drop_empty, clean)


def prepare(df: DataFrame, na_values=None, exclude: Iterable[str] = (TID,), drop_empty: bool = True, clean: bool = True) -> DataFrame:
    """Columns as text, missing values null, columns without a value dropped, the others normalised."""
    df = df.select(*(na_to_null(F.col(f"`{c}`").cast("string"), na_values).alias(c) for c in df.columns))
    if drop_empty:
        df = drop_null_columns(df)
    keep = set(exclude)
    return df.select(*((normalize(F.col(f"`{c}`")).alias(c) if clean and c not in keep else F.col(f"`{c}`")) for c in df.columns))


def drop_null_columns(df: DataFrame) -> DataFrame:
    """Without the columns that are null in every row, in one pass over all columns; an empty table keeps its columns."""
    counts = df.agg(F.count("*").alias("n"), *(F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns))).first()
    empty = [c for i, c in enumerate(df.columns) if counts["n"] and not counts[f"c{i}"]]
    if empty:
        log.warning("columns without any value are dropped: %s", ", ".join(empty))
    return df.drop(*empty)


def read_table(spark: SparkSession, name: str, schema: str | None = None, **jdbc: str) -> DataFrame:
    """A catalog table, or with JDBC options (url, driver, ...) one of a database."""
    full = f"{schema}.{name}" if schema else name
    return spark.read.format("jdbc").options(dbtable=full, **jdbc).load() if jdbc else spark.table(full)


def read_sql(spark: SparkSession, name: str, query: str) -> DataFrame:
    """A query's result, registered under ``name``."""
    df = spark.sql(query)
    df.createOrReplaceTempView(name)
    return df


def with_tids(df: DataFrame, entity_col: str | None = None) -> DataFrame:
    """``_tid_`` as the first column: 0, 1, ... in the order of the input, or the numeric column ``entity_col``.

    An entity column that is not numeric is numbered by its sorted distinct values.
    """
    if entity_col is None:
        # rows are numbered by partition: one count for each partition, and no shuffle of rows
        marked = df.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
        counts = {r["_part"]: r["count"] for r in marked.groupBy("_part").count().collect()}
        base, before = {}, 0
        for part in sorted(counts):
            base[part], before = before, before + counts[part]
        sessions = df.sparkSession.createDataFrame(list(base.items()) or [(0, 0)], "_part long, _base long")
        out = marked.join(F.broadcast(sessions), "_part").withColumn(TID, F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1))
        return out.select(TID, *df.columns)
    rest = [c for c in df.columns if c != entity_col]
    if df.where(F.col(entity_col).isNotNull() & F.expr(f"try_cast(`{entity_col}` as bigint)").isNull()).limit(1).count():
        names = df.select(entity_col).where(F.col(entity_col).isNotNull()).distinct().orderBy(entity_col)
        names = with_tids(names.repartitionByRange(entity_col).sortWithinPartitions(entity_col))
        return df.join(names, entity_col).select(TID, *rest)
    return df.select(F.col(entity_col).cast("long").alias(TID), *rest)


def fill(df: DataFrame) -> DataFrame:
    """Nulls replaced by the sentinel, in all columns but ``_tid_``."""
    return df.select(*(F.col(c) if c == TID else F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(NULL)).alias(c) for c in df.columns))


def cells(raw: DataFrame, attributes: list[str]) -> DataFrame:
    """(_tid_, attribute, value): one row for each cell."""
    return raw.unpivot(TID, [f"`{a}`" for a in attributes], "attribute", "value") if attributes else raw.sparkSession.createDataFrame([], f"{TID} long, attribute string, value string")


def by_cell(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of two tables with a row for each tuple, cell or candidate: always a shuffle.

    Spark would broadcast one of them by the size of its files, which are compressed and hold
    candidates as lists, so that the driver would be sent many times what the files take.
    """
    return left.join(right.hint("merge"), on, how)


def by_value(rows: DataFrame, counts: DataFrame, on, how: str = "inner") -> DataFrame:
    """``rows`` of cells joined with a table of values or counts, which is counted and broadcast if it is small; the cells never are."""
    return rows.join(F.broadcast(counts) if counts.count() <= BROADCAST_VALUES else counts.hint("merge"), on, how)


def known_errors(df: DataFrame, id_col: str = TID, attr_col: str = "attribute") -> DataFrame:
    """A table of exactly (id_col, attr_col) as (_tid_ long, attribute string)."""
    if df.columns != [id_col, attr_col]:
        raise ValueError(f"The loaded errors table does not match the expected schema: {df.columns} instead of {[id_col, attr_col]}")
    return df.select(F.col(id_col).cast("long").alias(TID), F.col(attr_col).cast("string").alias("attribute"))


def constraint_lines(spark: SparkSession, path: str) -> list[str]:
    """Lines of a constraint file: trailing white space removed, blank lines and those that begin with # skipped."""
    lines = (r[0].rstrip() for r in spark.read.text(path).collect())  # a file written by hand
    return [x for x in lines if x and not x.startswith("#")]


def ground_truth(df: DataFrame, tid_col: str, attr_col: str, val_col: str, na_values=None) -> DataFrame:
    """(_tid_, _attribute_, _value_) of a long table; rows without a value are dropped."""
    text = lambda c: na_to_null(F.col(f"`{c}`").cast("string"), na_values)
    out = df.select(text(tid_col).cast("long").alias(TID), F.coalesce(text(attr_col), F.lit(NULL)).alias("_attribute_"), text(val_col).alias("_value_"))
    return out.where("_value_ is not null").withColumn("_value_", normalize(F.col("_value_")))


def store(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Register ``df`` as a view; with a path also write it there as Parquet and read from it."""
    if path:
        df.write.mode("overwrite").parquet(path)
        df = df.sparkSession.read.schema(df.schema).parquet(path)
    df.createOrReplaceTempView(name)
    return df
