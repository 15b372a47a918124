"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Workspace, partitions

#: Rows that a task of a small step is meant to get.
PER_TASK = 50_000
#: Edges that a task holds and contracts at once.
BLOCK = 1 << 19


def tasks_for(rows: int) -> int:
    """Tasks for a step of so many rows, 8 at least."""
    return max(8, -(-rows // PER_TASK))


def few(df: DataFrame, tasks: int) -> DataFrame:
    """``df`` in no more than ``tasks`` tasks, without a shuffle: many small partitions cost more than their rows."""
    return df.coalesce(tasks) if tasks < partitions(df.sparkSession) else df


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root): the smallest node that each node of the edges (a, b) reaches by them; roots have no row."""
    names, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(names))
    while len(x):
        # the larger root of an edge's ends goes below the smallest root that it has an edge to
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        x, y = root[x], root[y]
        apart = x != y
        x, y = x[apart], y[apart]
    moved = np.flatnonzero(root != np.arange(len(names)))
    return names[moved], names[root[moved]]


def _contract(block: int):
    """Edges (a, b) as stars (u, v) of the same components, some ``block`` edges at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def stars() -> pa.RecordBatch:
            u, v = forest(*map(np.concatenate, zip(*held, strict=True)))
            return pa.record_batch({"u": pa.array(u), "v": pa.array(v)})

        for batch in batches:
            held.append((np.asarray(batch.column("a")), np.asarray(batch.column("b"))))
            n += batch.num_rows
            if n >= block:
                yield stars()
                held, n = [], 0
        if n:
            yield stars()

    return run


def components(edges: DataFrame, work: Workspace, name: str = "cc", max_rounds: int = 60, block: int = BLOCK) -> DataFrame:
    """(node, root): the smallest node that each end of an edge of ``edges`` (a, b) reaches.

    Each task first replaces its edges by stars, a block of edges at a time. What one block
    holds is done by that; the rest goes through alternating large-star and small-star rounds
    (Kiveris et al., 2014). Every round is an aggregation by node that combines before its
    shuffle and a join on it; tables are written between rounds. No edges, loops and repeated
    edges are fine; nodes without an edge to another, and roots themselves, have no row.
    ``edges`` is counted, so it should be a written table.
    """
    edges = edges.where("a <> b").select("a", "b")
    blocks = max(1, -(-edges.count() // block))
    stars = edges.coalesce(blocks).mapInArrow(_contract(block), "u long, v long")
    if blocks == 1:
        return work.keep(stars.select(F.col("u").alias("node"), F.col("v").alias("root")), name)
    now = work.keep(stars.distinct(), f"{name}-0")
    tasks = tasks_for(now.count())
    for r in range(1, max_rounds + 1):
        both = few(now, tasks).select("u", "v").unionByName(few(now, tasks).select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = few(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"), tasks)
        large = few(large.distinct(), tasks)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = few(large.join(least, "u").select("v", "m").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"), tasks)
        small = small.unionByName(few(least.select("u", F.col("m").alias("v")), tasks)).distinct()
        now = work.keep(few(small, tasks), f"{name}-{r}")
        work.drop(f"{name}-{r - 1}")
        # done when each node has one edge, to a node that has none
        ends = few(now, tasks).select(F.col("u").alias("n"), F.lit(1).alias("up")).unionByName(few(now.select(F.col("v").alias("n"), F.lit(0).alias("up")), tasks))
        again = few(ends.groupBy("n").agg(F.sum("up").alias("ups"), F.min("up").alias("low")).where("ups > 1 or ups > 0 and low = 0"), tasks)
        if not again.agg(F.count("*")).first()[0]:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    out = work.keep(now.select(F.col("u").alias("node"), F.col("v").alias("root")), name)
    work.drop(f"{name}-{r}")
    return out
