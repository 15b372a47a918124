"""Approximate nearest neighbours by multiprobe p-stable hashing.

Largest inner product becomes smallest distance on the unit sphere: x is divided by the
largest norm and gets the component that makes it a unit vector, a query is divided by
its own norm and gets a zero. A table hashes by M projections floor((a.x + b)/W) with
Gaussian a; a query visits its own bucket and those one step away in some projections, in
order of the estimated chance of holding neighbours, the sum of squared distances to the
crossed borders (Lv et al., 2007). Candidates of all tables are ranked by the exact product.

Equal vectors are one class, with its smallest ids; classes are hashed, dealt and searched, and
their ids come back at the end. M, W, the tables and the number of probes are fitted on a
bounded sample of queries, whose true neighbours an exact scan of all classes gives: the
cheapest choice that finds ``target`` of them, at every size. Buckets are dealt to parts of
bounded size, and a query goes to a part once with all its buckets there; large
buckets are split on both sides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .store import Workspace
from .textvec import U64, mix

#: Queries and rows that are collected to fit the tables.
SAMPLE_QUERIES, SAMPLE_ROWS = 64, 4096
#: Rows of a bucket that are compared in one piece; larger ones, at most rows * tables / BLOCK, are split.
BLOCK = 20_000
#: Entries (a row in a table) that a part is meant to get.
PER_PART = 8192
#: (projections, width) choices for each table; more rows are worth more projections.
CHOICES = ((4, 1.2), (5, 1.4), (6, 1.6), (6, 1.2), (8, 1.6), (8, 1.2), (10, 1.8), (10, 1.4))
TABLES = 6
#: A probe steps aside in so many projections at most.
STEPS = 3


@dataclass
class Tables:
    """``a`` has shape (tables, projections, dimension + 1)."""

    a: np.ndarray
    b: np.ndarray
    width: float
    probes: int

    @classmethod
    def draw(cls, dimension: int, projections: int, width: float, tables: int, probes: int = 1, seed: int = 11) -> Tables:
        rng = np.random.default_rng(seed)
        return cls(rng.normal(size=(tables, projections, dimension + 1)), rng.uniform(0, width, (tables, projections)), width, probes)

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell coordinates (row, table, projection) and the place within the cell, 0 to 1."""
        p = (np.einsum("nd,tmd->ntm", x, self.a) + self.b) / self.width
        cell = np.floor(p)
        return cell.astype(np.int64), p - cell

    def keys(self, cells: np.ndarray) -> np.ndarray:
        """A 64-bit name of each (row, table) bucket."""
        out = np.broadcast_to(np.arange(cells.shape[1], dtype=U64), cells.shape[:2]).copy()
        for m in range(cells.shape[2]):
            out = mix(out * U64(0x9E3779B97F4A7C15) + cells[:, :, m].astype(U64), 13)
        return out

    def steps(self) -> np.ndarray:
        """All perturbations of a cell by -1 or 1 in at most STEPS projections."""
        m = self.a.shape[1]
        out = [np.zeros(m, np.int64)]
        for j in range(1, min(STEPS, m) + 1):
            for places in combinations(range(m), j):
                for signs in product((-1, 1), repeat=j):
                    out.append(np.zeros(m, np.int64))
                    out[-1][list(places)] = signs
        return np.array(out)

    def order(self, within: np.ndarray) -> np.ndarray:
        """For each (row, table) the perturbations, likeliest first."""
        steps = self.steps()
        price = np.zeros((*within.shape[:2], len(steps)))
        for m in range(steps.shape[1]):
            f = within[:, :, m, None]
            each = np.concatenate((f, np.zeros_like(f), 1 - f), axis=2) ** 2
            price += each[:, :, steps[:, m] + 1]
        return np.argsort(price, axis=2, kind="stable")

    def probe_keys(self, q: np.ndarray) -> np.ndarray:
        """The buckets (row, table, probe) that each query visits."""
        cells, within = self.cells(q)
        best = self.order(within)[:, :, : self.probes]
        steps = self.steps()[best]  # row, table, probe, projection
        visited = cells[:, :, None, :] + steps
        n, t, p, m = visited.shape
        out = self.keys(visited.transpose(0, 2, 1, 3).reshape(n * p, t, m))
        return out.reshape(n, p, t).transpose(0, 2, 1)


def lift(x: np.ndarray, largest: float, query: bool) -> np.ndarray:
    if query:
        return np.concatenate((x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))), axis=1)
    x = x / largest
    return np.concatenate((x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))), axis=1)


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed component by component in order."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * q[d]
    return out


def _matrix(column, dimension: int) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([np.asarray(c.flatten(), np.float64).reshape(-1, dimension) for c in chunks]) if chunks else np.zeros((0, dimension))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    if len(ids) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        pick = np.flatnonzero(scores >= floor)
        if len(pick) > 4 * k:  # many ties at the border: of those the smallest ids
            over, ties = pick[scores[pick] > floor], pick[scores[pick] == floor]
            pick = np.concatenate((over, ties[np.argsort(ids[ties], kind="stable")[:k]]))
    else:
        pick = np.arange(len(ids))
    return pick[np.lexsort((ids[pick], -scores[pick]))[:k]]


FOUND = "query_id long, ids binary, scores binary"


def nearest(ids: np.ndarray, x: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact products of the k rows nearest to q, ties to the smaller id.

    A matrix product ranks them but for its rounding; those near the border are summed exactly.
    """
    rough = x @ q
    if len(ids) > 4 * k:
        slack = 1e-9 * max(1e-300, float(np.abs(rough).max()))
        pick = np.flatnonzero(rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - slack)
        ids, x = ids[pick], x[pick]
    scores = products(x, q)
    top = _best(ids, scores, k)
    return ids[top], scores[top]


def _result(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    return pa.table({"query_id": pa.array([r[0] for r in rows], pa.int64()), "ids": pa.array([r[1].astype("<i8").tobytes() for r in rows], pa.binary()), "scores": pa.array([r[2].astype("<f8").tobytes() for r in rows], pa.binary())})


def exact_scan(base: DataFrame, queries: list[tuple[int, list[float]]], k: int, dimension: int) -> DataFrame:
    """(query_id, found): the k nearest rows of a bounded list of queries, each batch giving its own k."""
    shared = base.sparkSession.sparkContext.broadcast((np.array([q for q, _ in queries], np.int64), np.array([v for _, v in queries], float).reshape(-1, dimension)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors = shared.value
        for batch in batches:
            if batch.num_rows:
                ids, x = np.asarray(batch.column("vec_id")), _matrix(batch.column("vector"), dimension)
                yield from _result([(name, *nearest(ids, x, q, k)) for name, q in zip(names.tolist(), vectors, strict=True)]).to_batches()

    return merged(base.select("vec_id", "vector").mapInArrow(run, FOUND), k)


def merged(found: DataFrame, k: int) -> DataFrame:
    """(query_id, found): the k best of a query's packed lists as an array of (s, id), s the product less than zero, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lists, scores in zip(batch.column("ids").to_pylist(), batch.column("scores").to_pylist(), strict=True):
                ids, first = np.unique(np.frombuffer(b"".join(lists), "<i8"), return_index=True)
                s = np.frombuffer(b"".join(scores), "<f8")[first]
                top = _best(ids, s, k)
                out.append([{"s": -b, "id": a} for a, b in zip(ids[top].tolist(), s[top].tolist(), strict=True)])
            yield pa.record_batch({"query_id": batch.column("query_id"), "found": pa.array(out, pa.list_(pa.struct([("s", pa.float64()), ("id", pa.int64())])))})

    # a query has a list from each part that it visits
    lists = found.groupBy("query_id").agg(F.collect_list(F.struct("ids", "scores")).alias("l")).select("query_id", F.col("l.ids").alias("ids"), F.col("l.scores").alias("scores"))
    return lists.mapInArrow(run, "query_id long, found array<struct<s:double,id:bigint>>")


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(vec_id, vector) of the rows that take part, and their dimension.

    Left out: null ids, null or zero vectors, null or non-finite components, and vectors of
    another dimension than most have (of equally many, the smaller). Of several rows of one
    id the largest vector, as arrays compare, stands for it.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where("vec_id is not null and vector is not null")
    rows = rows.where(F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("vector", lambda c: c != 0))
    sizes = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    dimension = sizes["d"] if sizes else 1
    return rows.where(F.size("vector") == dimension).groupBy("vec_id").agg(F.max("vector").alias("vector")), dimension


def classes_of(base: DataFrame, k: int) -> DataFrame:
    """(vec_id, vector, ids): the distinct vectors, each named by its smallest id, with its k smallest ids."""
    first = Window.partitionBy("vector").orderBy("vec_id")
    few = base.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k).drop("_r")
    return few.groupBy("vector").agg(F.min("vec_id").alias("vec_id"), F.array_sort(F.collect_list("vec_id")).alias("ids"))


def fit(base: DataFrame, queries: DataFrame, k: int, dimension: int, largest: float, n: int, target: float) -> Tables:
    """The cheapest tables and probes that find ``target`` of a query sample's true neighbours.

    Where no choice does, cells get wider and tables more until one does.
    """
    sample = [(r[0], r[1]) for r in queries.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(SAMPLE_QUERIES).collect()]
    if not sample:
        return Tables.draw(dimension, *CHOICES[0], TABLES)
    truth = exact_scan(base, sample, k + 1, dimension).select("query_id", F.explode("found.id").alias("vec_id")).where("vec_id <> query_id")
    truth = truth.join(base, "vec_id").select("query_id", "vector").toArrow()  # k rows for each of the sample
    place = {q: i for i, (q, _) in enumerate(sample)}
    owner = np.array([place[q] for q in truth.column("query_id").to_pylist()], np.int64)
    if not len(owner):
        return Tables.draw(dimension, *CHOICES[0], TABLES)
    near = lift(_matrix(truth.column("vector"), dimension), largest, False)
    some = base.where(F.pmod(F.xxhash64("vec_id", F.lit(4)), F.lit(1 << 20)) < int(min(1.0, SAMPLE_ROWS / n) * (1 << 20))).select("vector").toArrow()
    rows = lift(_matrix(some.column("vector"), dimension), largest, False)
    q = lift(np.array([v for _, v in sample], float), largest, True)
    wider, count = 1.0, TABLES
    while True:
        found = [t for c in CHOICES if (t := _fitted(Tables.draw(dimension, c[0], c[1] * wider, count), q, near, owner, rows, n, target))]
        if found:
            return min(found, key=lambda f: f[0])[1]
        wider, count = wider * 1.5, min(2 * count, 4 * TABLES)


def _fitted(tables: Tables, q: np.ndarray, near: np.ndarray, owner: np.ndarray, rows: np.ndarray, n: int, target: float) -> tuple[float, Tables] | None:
    """The price of a choice (comparisons a query, in shares of all rows) and the choice with its probes, if any number reaches the target."""
    count, m = tables.a.shape[:2]
    cells, within = tables.cells(q)
    order = tables.order(within)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(order.shape[2]), order.shape), 2)
    steps, weight = tables.steps(), 3 ** np.arange(m)[::-1]
    number = np.full(3**m, -1)
    number[((steps + 1) * weight).sum(axis=1)] = np.arange(len(steps))

    def reach(x: np.ndarray, who: np.ndarray | int) -> np.ndarray:
        """Probes after which each table comes to the row (row, table)."""
        step = tables.cells(x)[0] - cells[who]
        at = number[((np.clip(step, -1, 1) + 1) * weight).sum(axis=2)]
        ok = (np.abs(step) <= 1).all(axis=2) & (at >= 0)
        who = np.broadcast_to(np.asarray(who).reshape(-1, 1), at.shape)
        return np.where(ok, rank[who, np.arange(count)[None, :], np.maximum(at, 0)], 1 << 30)

    need = np.sort(reach(near, owner).min(axis=1))
    probes = int(need[int(np.ceil(target * len(need))) - 1]) + 1
    if probes > order.shape[2]:
        return None
    tables.probes = probes
    price = np.mean([(reach(rows, i) < probes).sum(axis=1).mean() for i in range(len(q))]) if len(rows) else 1.0
    # a probe costs as much as comparing some rows, a table as sending all
    return float(price + count * probes * 8 / n + count * 1e-3), tables


def _deal(tables: Tables, dimension: int, largest: float, query: bool, parts: int, hot: dict[int, tuple[int, int]], kind: str):
    """Rows (part, id, vector, keys): each vector once for each part that holds buckets of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64 if query else 1024):
                batch = whole.slice(at, 64 if query else 1024)
                ids, raw = np.asarray(batch.column("vec_id")), _matrix(batch.column("vector"), dimension)
                lifted, narrow = lift(raw, largest, query), raw.astype(kind)
                keys = (tables.probe_keys(lifted) if query else tables.keys(tables.cells(lifted)[0])).reshape(len(ids), -1)
                row = np.repeat(np.arange(len(ids)), keys.shape[1])
                key = keys.ravel()
                if hot:
                    row, key = _split(row, key, ids, query, hot)
                part = (mix(key, 17) % U64(parts)).astype(np.int64)
                order = np.lexsort((key, part, row))
                row, key, part = row[order], key[order], part[order]
                fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])))
                row, key, part = row[fresh], key[fresh], part[fresh]
                head = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (part[1:] != part[:-1]))))
                ends = np.append(head[1:], len(row))
                yield pa.record_batch({
                    "part": pa.array(part[head].astype(np.int32)), "id": pa.array(ids[row[head]]),
                    "vector": pa.array([narrow[r].tobytes() for r in row[head].tolist()], pa.binary()),
                    "buckets": pa.array([key[a:b].tobytes() for a, b in zip(head.tolist(), ends.tolist(), strict=True)], pa.binary()),
                })

    return run


def _split(row, key, ids, query, hot):
    """Large buckets become a grid of row shares by query shares; a row goes to all query shares of its row share."""
    rows, keys = [], []
    large = np.isin(key, np.array(list(hot), np.int64).view(U64))
    rows.append(row[~large])
    keys.append(key[~large])
    for r, k in zip(row[large].tolist(), key[large].tolist(), strict=True):
        sx, sq = hot[int(np.array(k, U64).view(np.int64))]
        mine = int(mix(ids[r : r + 1].astype(U64), 19)[0])
        for j in range(sx if query else sq):
            x, y = (j, mine % sq) if query else (mine % sx, j)
            keys.append(mix(np.array([k], U64) + U64(x * 65537 + y + 1), 23))
            rows.append(np.array([r]))
    return np.concatenate(rows), np.concatenate(keys)


def _search(k: int, dimension: int, kind: str, tables: int):
    """The k nearest classes of each query of a part, packed in one row.

    Rows stand sorted by bucket, so a bucket meets the queries that visit it in one matrix product. Of a
    query's products the k * tables largest are summed exactly: a row is there once for each table at most.
    """

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return _result([])
        ids = np.asarray(rows.column("id").combine_chunks())
        x = np.frombuffer(b"".join(rows.column("vector").to_pylist()), kind).reshape(-1, dimension)
        packed = rows.column("buckets").to_pylist()
        keys = np.frombuffer(b"".join(packed), U64)
        owner = np.repeat(np.arange(len(ids)), [len(p) // 8 for p in packed])
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        entries = x[owner].astype(np.float64)
        names = queries.column("id").to_pylist()
        asked = np.frombuffer(b"".join(queries.column("vector").to_pylist()), kind).reshape(-1, dimension).astype(np.float64)
        wanted = [np.frombuffer(w, U64) for w in queries.column("buckets").to_pylist()]
        out = []
        for at in range(0, len(names), 128):
            block = wanted[at : at + 128]
            who, key = np.repeat(np.arange(len(block)), [len(w) for w in block]), np.concatenate(block)
            low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            full = np.flatnonzero(high > low)
            full = full[np.argsort(low[full], kind="stable")]
            scores: list[list[np.ndarray]] = [[] for _ in block]
            places: list[list[np.ndarray]] = [[] for _ in block]
            cuts = np.flatnonzero(np.diff(low[full], prepend=-1, append=-1))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                i, j, visitors = int(low[full[a]]), int(high[full[a]]), who[full[a:b]]
                s, place = entries[i:j] @ asked[at + visitors].T, np.arange(i, j)
                for c, q in enumerate(visitors.tolist()):
                    scores[q].append(s[:, c])
                    places[q].append(place)
            for q in range(len(block)):
                if scores[q]:
                    s, place = np.concatenate(scores[q]), np.concatenate(places[q])
                    if len(s) > k * tables:
                        slack = 1e-9 * max(1e-300, float(np.abs(s).max()))
                        place = place[s >= np.partition(s, len(s) - k * tables)[len(s) - k * tables] - slack]
                    near = np.unique(owner[place])
                    exact = products(x[near].astype(np.float64), asked[at + q])
                    top = _best(ids[near], exact, k)
                    out.append((names[at + q], ids[near][top], exact[top]))
        return _result(out)

    return run


def search(vectors: DataFrame, queries, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", target: float = 0.95, work: Workspace | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product found for each query.

    queries is a condition on vec_id that tells which rows are queries; candidates are all
    other rows. Ties go to the smaller vec_id. Rows that usable() leaves out take no part.
    Queries that found fewer than k rows where there are more are answered by an exact scan. An empty
    table gives no rows; other columns of ``vectors`` are not read.
    """
    spark = vectors.sparkSession
    work = work or Workspace(spark, "ann")
    kind = "<f4" if isinstance(vectors.schema[vector_col].dataType.elementType, FloatType) else "<f8"
    base, dimension = usable(vectors, id_col, vector_col)
    base = work.keep(base, "base")
    # k + 1: a query's own row may be among them
    classes = work.keep(classes_of(base, k + 1), "classes")
    n, m, largest = base.count(), *classes.agg(F.count("*"), F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, c: a + c * c)))).first()
    largest = (largest or 1.0) * (1 + 1e-12)
    asked = work.keep(base.where(queries).join(classes.select("vector", F.col("vec_id").alias("class")), "vector").select("vec_id", "class"), "asked")
    points, asking = classes.select("vec_id", "vector"), work.keep(classes.join(asked.select(F.col("class").alias("vec_id")).distinct(), "vec_id").select("vec_id", "vector"), "asking")
    tables = fit(points, asking, k, dimension, largest, m, target)
    count = tables.a.shape[0]

    def keys_of(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 64 if query else 1024):
                    x = lift(_matrix(whole.slice(at, 64 if query else 1024).column("vector"), dimension), largest, query)
                    keys, n = np.unique(tables.probe_keys(x) if query else tables.keys(tables.cells(x)[0]), return_counts=True)
                    yield pa.record_batch({"key": pa.array(keys.view(np.int64)), "x": pa.array(np.zeros(len(n), np.int64) if query else n), "q": pa.array(n if query else np.zeros(len(n), np.int64))})

        return run

    hot = {}
    if m > BLOCK:  # else no bucket can be large
        loads = points.mapInArrow(keys_of(False), "key long, x long, q long").unionByName(asking.mapInArrow(keys_of(True), "key long, x long, q long"))
        loads = loads.groupBy("key").agg(F.sum("x").alias("x"), F.sum("q").alias("q")).where(f"(x > {BLOCK} or q > {BLOCK}) and x > 0 and q > 0")
        hot = {r["key"]: (-(-r["x"] // BLOCK), -(-r["q"] // BLOCK)) for r in loads.collect()}  # (rows * tables + queries * probes) / BLOCK of them at most
    parts = max(8, -(-m * count // PER_PART))
    schema = "part int, id long, vector binary, buckets binary"
    left = asking.mapInArrow(_deal(tables, dimension, largest, True, parts, hot, kind), schema)
    right = points.mapInArrow(_deal(tables, dimension, largest, False, parts, hot, kind), schema)
    found = left.groupBy("part").cogroup(right.groupBy("part")).applyInArrow(_search(k + 1, dimension, kind, count), FOUND)
    found = work.keep(expanded(merged(found, k + 1), classes, k + 1), "found")
    answers = asked.join(found.withColumnRenamed("query_id", "class"), "class", "left")
    others = F.filter("found", lambda x: x["id"] != F.col("vec_id"))
    answers = work.keep(answers.select("vec_id", "class", F.coalesce(F.slice(others, 1, k), F.array().cast("array<struct<s:double,id:bigint>>")).alias("found")), "answers")
    enough = F.size("found") >= min(k, n - 1)
    out = answers.where(enough)
    short = asking.join(answers.where(~enough).select(F.col("class").alias("vec_id")).distinct(), "vec_id")
    short = work.keep(short, "short")
    blocks = -(-short.count() // 4096)
    for i in range(blocks):
        block = short.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).collect()  # about 4096 queries
        scanned = work.keep(expanded(exact_scan(points, [(r[0], r[1]) for r in block], k + 1, dimension), classes, k + 1), f"scanned-{i}")
        late = answers.where(~enough).drop("found").join(scanned.withColumnRenamed("query_id", "class"), "class")
        out = out.unionByName(late.select("vec_id", "class", F.slice(others, 1, k).alias("found")))
    out = out.select(F.col("vec_id").alias("query_id"), F.posexplode("found").alias("at", "f"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("f.id").alias("vec_id"), (-F.col("f.s")).alias("score"))


def expanded(found: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(query_id, found) with classes replaced by their ids, the k best in order."""
    rows = found.select("query_id", F.explode("found").alias("f")).select("query_id", F.col("f.s").alias("s"), F.col("f.id").alias("vec_id"))
    rows = rows.join(classes.select("vec_id", "ids"), "vec_id").select("query_id", "s", "ids")
    each = F.flatten(F.transform(F.collect_list(F.struct("s", "ids")), lambda c: F.transform(c["ids"], lambda i: F.struct(c["s"].alias("s"), i.alias("id")))))
    return rows.groupBy("query_id").agg(F.slice(F.array_sort(each), 1, k).alias("found"))
