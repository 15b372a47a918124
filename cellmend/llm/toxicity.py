"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic function of the
weights of its hashed words, the document's is their noisy-or, 1 - prod(1 - p). Weights are
trained from document labels alone, on a bounded sample, and tell which sentences offend.
Only words whose documents differ in label beyond chance get one: by the rare words that only
it has, a model would learn each document of the sample by heart, and the offensive words too little.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_scan import _NORMAL
from .textvec import Words, slices, text_bytes
from .training import labelled_sample, remainder

#: Labelled documents to train on, about; their whole texts are used.
MAX_DOCS = 12_000
BITS = 18
#: Log-likelihood ratio from which a word tells of a label; chance gives one of some 16,000 words as much.
TELLING = 16.0
#: Steps of the training at least; a small sample is gone through more often.
STEPS = 640
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".!?\n"]] = True


def sentences(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words]:
    """Hashed words, the first word of each sentence, the text of each sentence, and the words.

    Sentences end at . ! ? and line feeds; those without a word are none.
    """
    data, offsets = text_bytes(column)
    plain = pa.Array.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(offsets.astype("<i8").tobytes()), pa.py_buffer(_NORMAL[data].tobytes())])
    words = Words(plain)
    cuts = np.searchsorted(words.starts, np.concatenate((np.flatnonzero(_BREAK[data]), offsets)))
    first = np.unique(cuts[cuts < len(words.starts)])
    return (words.hashes >> np.uint64(64 - BITS)).astype(np.int32), first, np.searchsorted(words.first, first, "right") - 1, words


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def sentence_scores(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        z = np.add.reduceat(self.weights[ids], first) if len(first) else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z + self.bias, -30, 30)))


def noisy_or(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """1 - prod(1 - p) for each of n documents; 0 without a sentence."""
    return -np.expm1(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), n))


def telling(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashed words occur in documents of one label more than chance explains: those of a
    log-likelihood ratio, over the table of label and occurrence, of TELLING at least; and the
    logarithm of the odds ratio of each of them."""
    seen = np.zeros((2, 1 << BITS))
    for (ids, _), y in zip(bags, labels.tolist(), strict=True):
        seen[y][np.unique(ids)] += 1
    total = np.bincount(labels, minlength=2)[:, None].astype(float)
    ratio = np.zeros(1 << BITS)
    for table in (seen, total - seen):
        expected = table.sum(axis=0) * total / total.sum()
        ratio += 2 * (table * np.log(np.maximum(table, 1) / np.where(table > 0, expected, 1))).sum(axis=0)
    known = ratio >= TELLING
    share = np.log((seen + 0.5) / (total + 1))
    return known, np.where(known, share[1] - share[0], 0.0)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, batch: int = 256, rate: float = 0.05, sparse: float = 2e-3, seed: int = 7) -> Model:
    """Adam on the noisy-or's cross entropy over the telling words, weights drawn to zero by
    ``sparse``; ``epochs`` times through the bags, more often where that makes fewer than STEPS steps.

    A bag is its word ids and the first word of each sentence. Without both labels the
    model gives everything their mean.
    """
    mean = float(labels.mean()) if len(labels) else 0.0
    if not 0 < mean < 1:
        return Model(np.zeros(1 << BITS), 30.0 if mean else -30.0)
    average = np.mean([max(1, len(f)) for _, f in bags])
    bias = float(np.log(mean / average))
    known, weights = telling(bags, labels)  # where all of them stand side by side, learning alone would leave some out
    words, places = [], []  # telling words of each bag, and the sentence of each
    for ids, first in bags:
        at = np.flatnonzero(known[ids])
        words.append(ids[at])
        places.append(np.searchsorted(first, at, "right") - 1)
    count = np.array([len(f) for _, f in bags])
    m, v, mb, vb, step = np.zeros_like(weights), np.zeros_like(weights), 0.0, 0.0, 0
    rng = np.random.default_rng(seed)
    for _ in range(max(epochs, -(-STEPS // -(-len(bags) // batch)))):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            pick = pick[count[pick] > 0]
            if not len(pick):
                continue
            ids = np.concatenate([words[i] for i in pick])
            base = np.cumsum(count[pick]) - count[pick]
            place = np.concatenate([places[i] + b for i, b in zip(pick, base.tolist(), strict=True)])
            doc = np.repeat(np.arange(len(pick)), count[pick])
            y = labels[pick]
            p = 1 / (1 + np.exp(-np.clip(np.bincount(place, weights[ids], len(doc)) + bias, -30, 30)))
            whole = np.clip(noisy_or(p, doc, len(pick)), 1e-6, 1 - 1e-6)
            slope = p * np.where(y == 1, -(1 - whole) / whole, 1.0)[doc] / len(pick)
            g = np.bincount(ids, slope[place], len(weights))
            gb, step = float(slope.sum()), step + 1
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            now = rate * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
            weights -= now * m / (np.sqrt(v) + 1e-4)
            weights = np.sign(weights) * np.maximum(np.abs(weights) - rate * sparse, 0)
            bias -= now * mb / (vb**0.5 + 1e-4)
    return Model(weights.astype(np.float32), bias)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, held_out: int = 2, max_docs: int = MAX_DOCS) -> Model:
    """Train on about ``max_docs`` labelled documents outside the held-out fold; the sample's
    word ids come to the driver. Only texts and labels are read."""

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ids, first, doc, words = sentences(part.column("text"))
            cut = np.searchsorted(doc, np.arange(part.num_rows + 1))
            a = words.first
            yield pa.record_batch({
                "doc_id": part.column("doc_id"), "label": part.column("label"),
                "ids": pa.array([ids[a[i] : a[i + 1]].tobytes() for i in range(part.num_rows)], pa.binary()),
                "first": pa.array([(first[cut[i] : cut[i + 1]] - a[i]).astype(np.int32).tobytes() for i in range(part.num_rows)], pa.binary()),
            })

    sample = labelled_sample(docs.select("doc_id", F.col("text").cast("string").alias("text")), labels, label, folds, held_out, max_docs)
    rows = sample.select("doc_id", "text", "label").mapInArrow(bags, "doc_id long, label int, ids binary, first binary").toArrow().sort_by("doc_id")
    pairs = [(np.frombuffer(i, np.int32), np.frombuffer(f, np.int32).astype(np.int64)) for i, f in zip(rows.column("ids").to_pylist(), rows.column("first").to_pylist(), strict=True)]
    return train(pairs, np.array(rows.column("label").to_pylist(), np.int64))


def score(docs: DataFrame, model: Model, locate: float | None = None) -> DataFrame:
    """doc_id and score of each row's whole text; a null, empty or wordless text scores 0.

    locate: also offending, the (start, length, score) in UTF-8 bytes of each sentence of at
    least that score. Rows repeating a doc_id are scored one by one; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ids, first, doc, words = sentences(part.column("text"))
            p = shared.value.sentence_scores(ids, first)
            out = {"doc_id": part.column("doc_id"), "score": pa.array(noisy_or(p, doc, part.num_rows), pa.float64())}
            if locate is not None:
                last = np.append(first[1:], len(ids)) - 1
                found: list[list] = [[] for _ in range(part.num_rows)]
                for s in np.flatnonzero(p >= locate).tolist():
                    start = int(words.starts[first[s]])
                    found[doc[s]].append({"start": start - int(words.offsets[doc[s]]), "length": int(words.ends[last[s]]) - start, "score": float(p[s])})
                out["offending"] = pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("score", pa.float64())])))
            yield pa.record_batch(out)

    kind = docs.schema["doc_id"].dataType.simpleString()
    more = "" if locate is None else ", offending array<struct<start:long,length:long,score:double>>"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double{more}")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs``, by a model of ``labels``."""
    scored = score(docs, fit(docs, labels, "toxic", folds, held_out))
    return scored.select("doc_id", F.coalesce(remainder(folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
