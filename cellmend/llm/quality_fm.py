"""Quality classifier: a factorisation machine on hashed words, structure and metadata.

A document's features are its distinct hashed words (each of value 1/sqrt of their number),
one bin for each structure statistic, and one for the declared length. The score is
sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairs take linear time
by the sum-of-squares identity, half of sum_f (sum v_if x_i)^2 - sum (v_if x_i)^2.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .host_rules import _per, text_stats
from .license_scan import _NORMAL
from .textvec import Words, slices, text_bytes
from .training import labelled_sample, remainder

#: Labelled documents to train on, about; their whole texts are used.
MAX_DOCS = 12_000
BITS, FACTORS, BINS = 17, 8, 16
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_CHARS = [np.isin(np.arange(256), [ord(c) for c in s]) for s in ("#*$%&", "|<>", "!?", ".,;:", "0123456789", "\n")]
#: Structure statistics: share of upper case, shares of six kinds of characters, log length, mean word length, duplicate lines, repeated words, distinct words, declared length.
N_STATS = 13
N_FEATURES = (1 << BITS) + N_STATS * BINS


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Bin 0 for none, then by powers of two up to all."""
    with np.errstate(divide="ignore", invalid="ignore"):
        x = np.log2(np.maximum(part, 1e-9) / np.maximum(whole, 1))
    return np.where(part <= 0, 0, np.clip(BINS - 1 + np.ceil(x * 1.5), 1, BINS - 1)).astype(np.int64)


def _log(x: np.ndarray) -> np.ndarray:
    return np.clip(np.log2(np.maximum(x, 0) + 1), 0, BINS - 1).astype(np.int64)


def features(texts: pa.Array, n_chars: pa.Array | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature ids and values of all texts, and where each text's begin and the last end."""
    data, offsets = text_bytes(texts)
    n = len(texts)
    plain = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.astype("<i8").tobytes()), pa.py_buffer(_NORMAL[data].tobytes())])
    words = Words(plain)
    doc = np.repeat(np.arange(n), words.counts)
    key = np.unique(doc << BITS | (words.hashes >> np.uint64(64 - BITS)).astype(np.int64))
    kind, owner = key & ((1 << BITS) - 1), key >> BITS
    distinct = np.bincount(owner, minlength=n)
    stats = text_stats(texts)
    size = np.diff(offsets)
    bins = [_share(_per(_UPPER[data], offsets), size)]
    bins += [_share(_per(c[data], offsets), size) for c in _CHARS]
    bins += [_log(size), np.clip((2 * stats["word_chars"]) // np.maximum(stats["n_words"], 1), 0, BINS - 1)]
    bins += [_share(stats["n_dup_lines"], _per(_CHARS[5][data], offsets) + 1), _share(stats["n_repeat_words"], stats["n_words"]), _share(distinct, words.counts)]
    declared = np.full(n, -1.0) if n_chars is None else np.nan_to_num(np.array([-1 if x is None else x for x in n_chars.to_pylist()], float), nan=-1.0)
    bins.append(np.where(declared < 0, 0, 1 + np.minimum(_log(declared), BINS - 2)))
    ids = np.concatenate([kind, *((1 << BITS) + i * BINS + b for i, b in enumerate(bins))])
    values = np.concatenate([1 / np.sqrt(distinct[owner]), np.ones(N_STATS * n)])
    owner = np.concatenate([owner, np.tile(np.arange(n), N_STATS)])
    order = np.argsort(owner, kind="stable")
    return ids[order], values[order], np.searchsorted(owner[order], np.arange(n + 1))


@dataclass
class Machine:
    w0: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, ids: np.ndarray, values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the sigmoid, and each document's factor sums."""
        vx = self.v[ids] * values[:, None]
        sums = np.add.reduceat(vx, at[:-1])
        squares = np.add.reduceat((vx * vx).sum(axis=1), at[:-1])
        return self.w0 + np.add.reduceat(self.w[ids] * values, at[:-1]) + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def score(self, ids: np.ndarray, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(ids, values, at)[0], -30, 30)))


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 10, batch: int = 128, rate: float = 0.1, decay: float = 1e-4, seed: int = 5) -> Machine:
    """AdaGrad on the cross entropy; only features met in a batch are touched.

    Without both labels the machine gives everything their mean.
    """
    rng = np.random.default_rng(seed)
    w, v = np.zeros(N_FEATURES), rng.normal(0, 0.02, (N_FEATURES, FACTORS))
    mean = float(labels.mean()) if len(labels) else 0.5
    if not 0 < mean < 1:
        return Machine(0.0 if not len(labels) else 30.0 if mean else -30.0, w, v * 0)
    m = Machine(float(np.log(mean / (1 - mean))), w, v)
    gw, gv, g0 = np.full(N_FEATURES, 1e-2), np.full((N_FEATURES, FACTORS), 1e-2), 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for a in range(0, len(order), batch):
            pick = order[a : a + batch]
            ids, values = (np.concatenate([docs[i][k] for i in pick]) for k in (0, 1))
            sizes = np.array([len(docs[i][0]) for i in pick])
            at = np.concatenate(([0], np.cumsum(sizes)))
            raw, sums = m.raw(ids, values, at)
            slope = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[pick]) / np.sqrt(len(pick))
            each = np.repeat(slope, sizes) * values
            grad = np.concatenate((each[:, None], each[:, None] * (np.repeat(sums, sizes, axis=0) - m.v[ids] * values[:, None])), axis=1)
            by = np.argsort(ids, kind="stable")
            mine, first = np.unique(ids[by], return_index=True)
            grad = np.add.reduceat(grad[by], first)
            dw, dv = grad[:, 0] + decay * m.w[mine], grad[:, 1:] + decay * m.v[mine]
            gw[mine] += dw * dw
            gv[mine] += dv * dv
            m.w[mine] -= rate * dw / np.sqrt(gw[mine])
            m.v[mine] -= rate * 0.3 * dv / np.sqrt(gv[mine])
            d0 = float(slope.sum())
            g0 += d0 * d0
            m.w0 -= rate * d0 / g0**0.5
    return Machine(m.w0, m.w.astype(np.float32), m.v.astype(np.float32))


def _input(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and, where there is one, the declared length n_chars."""
    declared = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), declared.alias("n_chars"), *more)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held_out: int = 0, max_docs: int = MAX_DOCS) -> Machine:
    """Train on about ``max_docs`` labelled documents outside the held-out fold; the sample's
    features come to the driver. Texts, declared lengths and labels are read, nothing else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ids, values, at = features(part.column("text"), part.column("n_chars"))
            ids, values = ids.astype(np.int32), values.astype(np.float32)
            yield pa.record_batch({
                "doc_id": part.column("doc_id"), "label": part.column("label"),
                "ids": pa.array([ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()),
                "vals": pa.array([values[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()),
            })

    sample = labelled_sample(_input(docs), labels, label, folds, held_out, max_docs)
    rows = sample.select("doc_id", "text", "n_chars", "label").mapInArrow(run, "doc_id long, label int, ids binary, vals binary").toArrow().sort_by("doc_id")
    pairs = [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)) for i, v in zip(rows.column("ids").to_pylist(), rows.column("vals").to_pylist(), strict=True)]
    return train(pairs, np.array(rows.column("label").to_pylist(), np.int64))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of each row's whole text; a null or empty text is scored by its bins.

    A null or missing n_chars is a bin of its own. Rows repeating a doc_id are scored one by
    one; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # a fixed table of some MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = features(part.column("text"), part.column("n_chars"))
            yield pa.record_batch({"doc_id": part.column("doc_id"), "score": pa.array(shared.value.score(*found).astype(float), pa.float64())})

    return _input(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs``, by a machine of ``labels``."""
    scored = score(docs, fit(docs, labels, "quality", folds, held_out))
    return scored.select("doc_id", F.coalesce(remainder(folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
