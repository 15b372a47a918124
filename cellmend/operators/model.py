"""A softmax over each cell's candidates whose weights are shared by all of them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..sources.tables import by_cell
from .domain import candidates, softmax
from .features import FeatInfo


@dataclass
class Weights:
    w: np.ndarray
    infos: list[FeatInfo]
    history: list[tuple[float, float]]

    def used(self, norm: bool) -> np.ndarray:
        return self.w / max(np.linalg.norm(self.w), 1e-12) if norm else self.w

    def report(self) -> list[dict]:
        """min, max, mean and mean absolute weight of each featurizer, and its weights by name, rounded to 3 digits."""
        out, at = [], 0
        for i in self.infos:
            w = self.w[at : at + i.size]
            at += i.size
            stats = {k: round(float(f(w)), 3) if len(w) else 0.0 for k, f in (("min", np.min), ("max", np.max), ("avg", np.mean), ("abs_avg", lambda x: np.mean(np.abs(x))))}
            out.append({"featurizer": i.name, "size": i.size} | stats | {"weights": {n: round(float(x), 3) for n, x in zip(i.names, w, strict=True)}})
        return out


def initial_weights(infos: list[FeatInfo], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights, uniform in (-1, 1) where they are learned and given where not, and which are learned."""
    rng = np.random.default_rng(seed)
    w, learn = [], []
    for i in infos:
        fixed = np.array(i.init_weight, float) if isinstance(i.init_weight, list) else np.full(i.size, float(i.init_weight))
        w.append(rng.uniform(-1, 1, i.size) if i.learnable else fixed)
        learn.append(np.full(i.size, i.learnable))
    return (np.concatenate(w), np.concatenate(learn)) if w else (np.zeros(0), np.zeros(0, bool))


class _Optimizer:
    def __init__(self, config: Config, size: int, rate: float | None = None):
        self.c, self.rate, self.t = config, rate or config.learning_rate, 0
        if config.optimizer not in ("adam", "sgd"):
            raise ValueError(f"optimizer is adam or sgd, not {config.optimizer!r}")
        self.m, self.v = np.zeros(size), np.zeros(size)

    def step(self, w: np.ndarray, g: np.ndarray, learn: np.ndarray) -> None:
        g = np.where(learn, g + self.c.weight_decay * w, 0.0)
        self.t += 1
        if self.c.optimizer == "adam":
            self.m = 0.9 * self.m + 0.1 * g
            self.v = 0.999 * self.v + 0.001 * g * g
            w -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)
        else:
            self.m = self.c.momentum * self.m + g if self.t > 1 else g
            w -= self.rate * self.m


def packed(features: DataFrame, domain: DataFrame, labels: DataFrame) -> DataFrame:
    """(_vid_, label, size, val_idx[], feat[], x[]) of each labelled cell."""
    cells = by_cell(domain.select("_vid_", "domain_size"), labels.where("label >= 0").select("_vid_", "label"), "_vid_")
    rows = features.groupBy("_vid_").agg(F.array_sort(F.collect_list(F.struct("val_idx", "feat", "x"))).alias("f"))
    rows = by_cell(cells, rows, "_vid_", "left")
    part = lambda name, kind: F.coalesce(F.col(f"f.{name}"), F.array().cast(f"array<{kind}>")).alias(name)
    return rows.select("_vid_", "label", F.col("domain_size").alias("size"), part("val_idx", "int"), part("feat", "int"), part("x", "double"))


@dataclass
class _Cells:
    """Some cells: candidates are numbered one after the other."""

    cand: np.ndarray
    feat: np.ndarray
    x: np.ndarray
    first: np.ndarray
    size: np.ndarray
    label: np.ndarray

    @classmethod
    def of(cls, table) -> _Cells:
        size = np.asarray(table.column("size")).astype(np.int64)
        first = np.cumsum(size) - size
        flat = lambda c: np.asarray((table.column(c).combine_chunks() if isinstance(table, pa.Table) else table.column(c)).flatten())
        lists = table.column("feat").combine_chunks() if isinstance(table, pa.Table) else table.column("feat")
        counts = np.asarray(lists.value_lengths()).astype(np.int64)
        return cls(flat("val_idx").astype(np.int64) + np.repeat(first, counts), flat("feat").astype(np.int64), flat("x").astype(float), first, size, np.asarray(table.column("label")).astype(np.int64))

    def gradient(self, w: np.ndarray) -> tuple[np.ndarray, float, int]:
        """Sum over the cells of the cross entropy's gradient, the entropy, and how many are right."""
        total = int(self.size.sum())
        score = np.bincount(self.cand, w[self.feat] * self.x, total)
        score -= np.repeat(np.maximum.reduceat(score, self.first), self.size)
        e = np.exp(score)
        p = e / np.repeat(np.add.reduceat(e, self.first), self.size)
        want = self.first + self.label
        loss = float(-np.log(np.maximum(p[want], 1e-300)).sum())
        right = int((p[want] >= np.maximum.reduceat(p, self.first) - 1e-15).sum())
        p[want] -= 1
        return np.bincount(self.feat, p[self.cand] * self.x, len(w)), loss, right

    def take(self, a: int, b: int) -> _Cells:
        lo, hi = int(self.first[a]), int(self.first[b - 1] + self.size[b - 1])
        i, j = np.searchsorted(self.cand, [lo, hi])
        return _Cells(self.cand[i:j] - lo, self.feat[i:j], self.x[i:j], self.first[a:b] - lo, self.size[a:b], self.label[a:b])


def fit(features: DataFrame, domain: DataFrame, labels: DataFrame, infos: list[FeatInfo], config: Config) -> Weights:
    """Train on the labelled cells.

    The exact trainer takes minibatches in order of _vid_ on the driver and leaves out a last batch
    that is not full. Of more than config.max_exact feature rows it holds one range of
    cells at a time; the steps are the same. The distributed trainer takes the full gradient by
    partition, ``epochs`` times at a hundred times the rate, and only where config.trainer asks for it.
    """
    if config.trainer not in ("auto", "exact", "distributed"):
        raise ValueError(f"trainer is auto, exact or distributed, not {config.trainer!r}")
    rows = packed(features, domain, labels).persist()  # read by every epoch; its inputs are written tables
    try:
        n, size = rows.agg(F.count("*"), F.sum(F.size("feat"))).first()
        if not n:
            raise ValueError("no cell has a label to learn from: prune less")
        w, learn = initial_weights(infos, config.seed)
        if config.trainer == "distributed":
            return _distributed(rows, n, w, learn, infos, config)
        return _exact(rows, n, size or 0, w, learn, infos, config)
    finally:
        rows.unpersist()


def _norm_gradient(w: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The gradient with respect to w of a function of w / |w|, given that of w / |w|."""
    length = max(np.linalg.norm(w), 1e-12)
    u = w / length
    return (g - u * (u @ g)) / length


def _ranges(rows: DataFrame, n: int) -> list:
    """Conditions on _vid_ that part the cells into about ``n`` ranges of like number, in order."""
    cuts = rows.agg(F.percentile_approx("_vid_", [i / n for i in range(1, n)], max(10_000, 10 * n))).first()[0]
    cuts = sorted(set(cuts))
    v = F.col("_vid_")
    return [v <= cuts[0], *((v > a) & (v <= b) for a, b in zip(cuts, cuts[1:], strict=False)), v > cuts[-1]]


def _exact(rows, n, size, w, learn, infos, config) -> Weights:
    optimizer, history = _Optimizer(config, len(w)), []
    batch = min(config.batch_size, n)
    whole = rows.toArrow().sort_by("_vid_") if size <= config.max_exact else None
    parts, ordered = [None], rows
    if whole is None:
        parts = _ranges(rows, 2 * -(-size // config.max_exact))
        ordered = rows.repartitionByRange(len(parts), "_vid_").sortWithinPartitions("_vid_").persist()
    try:
        for _ in range(config.epochs):
            loss, right, left = 0.0, 0, None
            for part in parts:
                table = whole if whole is not None else ordered.where(part).toArrow().sort_by("_vid_")
                if left is not None:
                    table = pa.concat_tables([left, table])
                full = table.num_rows // batch * batch
                left = table.slice(full)
                if not full:
                    continue
                data = _Cells.of(table.slice(0, full))
                for a in range(0, full, batch):
                    u = w / max(np.linalg.norm(w), 1e-12) if config.weight_norm else w
                    g, part_loss, good = data.take(a, a + batch).gradient(u)
                    loss, right = loss + part_loss, right + good
                    g = g / batch
                    optimizer.step(w, _norm_gradient(w, g) if config.weight_norm else g, learn)
            history.append((loss / n, right / n))
    finally:
        if ordered is not rows:
            ordered.unpersist()
    return Weights(w, infos, history)


def _distributed(rows, n, w, learn, infos, config) -> Weights:
    spark, history = rows.sparkSession, []
    optimizer = _Optimizer(config, len(w), 100 * config.learning_rate)
    for _ in range(config.epochs):
        shared = spark.sparkContext.broadcast(w / max(np.linalg.norm(w), 1e-12) if config.weight_norm else w)  # a weight for each feature

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total, loss, right = np.zeros(len(shared.value)), 0.0, 0
            for batch in batches:
                if batch.num_rows:
                    g, part, good = _Cells.of(batch).gradient(shared.value)
                    total, loss, right = total + g, loss + part, right + good
            yield pa.record_batch({"feat": pa.array(np.arange(len(total) + 2), pa.int32()), "g": pa.array(np.append(total, [loss, right]))})

        found = rows.mapInArrow(run, "feat int, g double").groupBy("feat").agg(F.sum("g").alias("g")).toArrow().sort_by("feat")  # a row for each feature
        *_, loss, right = g = np.asarray(found.column("g"))
        history.append((float(loss) / n, float(right) / n))
        g = g[:-2] / n
        optimizer.step(w, _norm_gradient(w, g) if config.weight_norm else g, learn)
        shared.unpersist()
    return Weights(w, infos, history)


def scores(features: DataFrame, domain: DataFrame, w: np.ndarray) -> DataFrame:
    """(_vid_, val_idx, score) of all candidates: the weighted sum of their features."""
    table = features.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(w)] or [(0, 0.0)], "feat int, w double")
    summed = features.join(F.broadcast(table), "feat").groupBy("_vid_", "val_idx").agg(F.sum(F.col("w") * F.col("x")).alias("score"))  # a weight for each feature
    return by_cell(candidates(domain).select("_vid_", "val_idx"), summed, ["_vid_", "val_idx"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def predict(features: DataFrame, domain: DataFrame, w: np.ndarray) -> DataFrame:
    """(_vid_, val_idx, prob) of all candidates."""
    return softmax(scores(features, domain, w))
