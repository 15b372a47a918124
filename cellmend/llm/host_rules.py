"""Quality rules with host-level verdicts.

Every document gets its rule statistics in one narrow pass. Failures are counted by host,
the beta prior of the hosts' failure rates is fitted by moments, and each host's rate
is shrunk to it: (failures + a) / (documents + a + b). Documents of hosts whose shrunk rate
is above a limit are rejected along with those that fail themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Workspace
from .textvec import Words, numbered, ragged, slices

#: Hosts whose verdicts are broadcast at most; above, the join shuffles.
BROADCAST_HOSTS = 200_000
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _per(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring offsets."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _again(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each (document, key): is it an earlier one's equal, and does it occur twice or more."""
    order = np.lexsort((keys, doc))
    keys, doc = keys[order], doc[order]
    first = np.concatenate(([True], (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1]))) if len(keys) else np.zeros(0, bool)
    later, many = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order] = ~first
    many[order] = ~first | np.append(~first[1:], False) if len(keys) else first
    return later, many


def text_stats(column: pa.Array, window: int = 5) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    w = Words(column)
    data, n = w.data, len(w.counts)
    inside = np.zeros(len(data) + 1, np.int64)
    np.add.at(inside, w.starts, 1)
    np.add.at(inside, w.ends, -1)
    inside = np.cumsum(inside[:-1]) > 0
    chars = _per(inside & ((data & 0xC0) != 0x80), w.offsets)
    symbols = _per(_SYMBOL[data], w.offsets)
    # lines: pieces between line feeds and text ends
    feeds = np.flatnonzero(data == 0x0A)
    begins = np.sort(np.concatenate((w.offsets[:-1], feeds + 1)))
    finish = np.sort(np.concatenate((w.offsets[1:], feeds)))
    line_doc = np.searchsorted(w.offsets, begins, "right") - 1  # of a line with a word
    has_word = np.searchsorted(w.starts, finish) > np.searchsorted(w.starts, begins)
    begins, finish, line_doc = begins[has_word], finish[has_word], line_doc[has_word]
    later, _ = _again(numbered(data, begins, finish), line_doc)
    dup_lines = np.bincount(line_doc[later], minlength=n)
    # words in windows that occur again
    keys, counts = w.windows(window)
    doc = np.repeat(np.arange(n), counts)
    _, many = _again(keys, doc)
    start = (np.repeat(w.first[:-1], counts) + ragged(counts))[many]
    cover = np.zeros(len(w.starts) + 1, np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + window, -1)
    repeated = _per(np.cumsum(cover[:-1]) > 0, w.first)
    return {"n_words": w.counts, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeated}


STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def document_stats(docs: DataFrame, window: int = 5) -> DataFrame:
    """doc_id, host and the statistics of each row of ``docs`` (doc_id, host, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            stats = text_stats(part.column("text"), window)
            yield pa.record_batch({"doc_id": part.column("doc_id"), "host": part.column("host")} | {k: pa.array(v, pa.int64()) for k, v in stats.items()})

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, host string, {STATS}")


def host_verdicts(docs: DataFrame, max_rate: float = 0.5, least: int = 2) -> DataFrame:
    """(host, n_docs, n_failed, rate, host_kept) from rows (host, base_failed).

    The prior is fitted by moments: m is the pooled rate of all hosts, v the variance of the
    rates of the hosts of ``least`` documents or more, weighted by documents, less what sampling
    adds; a + b = m(1 - m)/v - 1, held within [2, 1e6]. Without two such hosts, or where all of
    theirs fail or none, the prior is m with strength 2. A null host is no host: it has no row.
    """
    hosts = docs.where("host is not null").groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    seen = lambda x: F.sum(F.when(F.col("n_docs") >= least, x))
    # moments of all hosts are sums, so one row carries them
    sums = hosts.agg(
        F.sum("n_docs").alias("n"), F.sum("n_failed").alias("x"),
        seen(F.col("n_docs")).alias("sn"), seen(F.col("n_failed")).alias("sx"), F.count_if(F.col("n_docs") >= least).alias("h"),
        seen(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")).alias("sxx"), seen(F.col("n_docs") * F.col("n_docs")).alias("snn"),
    )
    s = sums.first()  # one row
    m = s["x"] / s["n"] if s["n"] else 0.0
    strength = 2.0
    if s["h"] > 1 and 0 < s["sx"] < s["sn"]:
        # between = sum n (p - r)^2, r the rate of these hosts; its mean is r(1 - r)(h - 1) + v (sn - snn/sn), v the variance of the true rates
        r = s["sx"] / s["sn"]
        between = s["sxx"] - s["sx"] ** 2 / s["sn"]
        v = (between - r * (1 - r) * (s["h"] - 1)) / (s["sn"] - s["snn"] / s["sn"])
        strength = min(1e6, max(2.0, m * (1 - m) / v - 1)) if v > 0 else 1e6
    rate = (F.col("n_failed") + F.lit(m * strength)) / (F.col("n_docs") + F.lit(strength))
    return hosts.withColumn("rate", rate).select("host", "n_docs", "n_failed", "rate", (F.col("rate") <= max_rate).alias("host_kept"))


def apply_rules(docs: DataFrame, host: str = "source", max_rate: float = 0.5, min_words: int = 10, max_repeat_pct: int = 20, work: Workspace | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host, host_rate, kept.

    A document fails by itself with fewer than ``min_words`` words or more than
    ``max_repeat_pct`` percent of words in repeated windows; it is kept if it does not fail
    and its host's shrunk failure rate is at most ``max_rate``. A null or wordless text
    has zeros and fails; a document of no host is judged by itself alone. Rows repeating a
    doc_id are judged one by one; other columns are not read.
    """
    spark = docs.sparkSession
    work = work or Workspace(spark, "rules")
    rows = docs.select("doc_id", F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    stats = document_stats(rows).withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words")))
    stats = work.keep(stats, "stats")
    verdicts = work.keep(host_verdicts(stats, max_rate), "hosts").select("host", F.col("rate").alias("host_rate"), "host_kept")
    verdicts = F.broadcast(verdicts) if verdicts.count() <= BROADCAST_HOSTS else verdicts
    out = stats.join(verdicts, "host", "left").withColumn("kept", ~F.col("base_failed") & F.coalesce("host_kept", F.lit(True)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host", "host_rate")
