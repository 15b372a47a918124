"""Intermediate tables of the operators, and the session's number of partitions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..sources.workspace import Workspace, scope, shared_dir

__all__ = ["Workspace", "partitions", "scope", "shared_dir"]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
