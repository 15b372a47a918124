"""Removal of repeated passages with a log-structured index of window fingerprints.

A window of ``window`` words is known by its anchor, the smallest hash of its runs of
``ANCHOR`` words (the first of equal ones). Equal windows have equal anchors, and
neighbouring windows mostly the same one, so a text has some 2 anchors for each
window - ANCHOR + 2 words. The index holds anchors in sorted immutable runs,
bucketed by hash: a batch becomes a run, the run is merge-joined with the older ones, and
runs of one level are compacted into one of the next. Anchors that occur again are
candidates; their windows are verified by a hash of all their words.

A History keeps the runs of earlier batches in a folder, with the texts that verification
needs: each new batch is joined with them, deduplicated against them and itself, and added.

Window hashes travel packed. A window that occurs twice within a mapper's buffer needs no
proof elsewhere; one entry tells its bucket, so that a passage of very many documents
comes to a reducer once for each buffer.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Workspace, partitions
from .textvec import U64, Words, ragged, slices

#: Words of an anchor.
ANCHOR = 8
#: Windows that a mapper holds before it sends them on, and that a reducer is meant to get.
FLUSH, PER_BUCKET = 1 << 19, 1 << 20
#: Keys that are broadcast at most; above, the join shuffles.
BROADCAST_KEYS = 1_000_000


class FingerprintIndex:
    """Sorted immutable runs of (h, n): fingerprints, and how often each occurred.

    add() takes a batch of fingerprints, joins its run with all older ones and returns the
    fingerprints that occur again: twice in the batch, or in it and in an older run. All
    runs are tables of ``buckets`` buckets by h, sorted by it, so that joins need no shuffle.
    ``levels`` are the names of runs that are in ``path`` already. Compacted runs go at once, or,
    if the index is ``lasting``, at the next sweep().
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int, fanout: int = 2, levels: list[list[str]] | None = None, lasting: bool = False):
        self.spark, self.path, self.buckets, self.fanout, self.lasting = spark, path, buckets, fanout, lasting
        self.levels: list[list[str]] = [list(level) for level in levels or []]
        self.dead: list[str] = []
        for name in (r for level in self.levels for r in level):
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (h BIGINT, n BIGINT) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {buckets} BUCKETS LOCATION '{path}/{name}'")

    def _write(self, rows: DataFrame) -> str:
        name = f"run_{uuid.uuid4().hex}"
        rows.repartition(self.buckets, "h").write.bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def _compact(self) -> None:
        for level in range(len(self.levels)):
            while len(self.levels[level]) >= self.fanout:
                old, self.levels[level] = self.levels[level], []
                if level + 1 == len(self.levels):
                    self.levels.append([])
                rows = self.spark.table(old[0])
                for name in old[1:]:
                    more = self.spark.table(name).withColumnRenamed("n", "m")
                    rows = rows.join(more.hint("merge"), "h", "full").select("h", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
                self.levels[level + 1].append(self._write(rows))
                self.dead += old
                if not self.lasting:
                    self.sweep()

    def sweep(self) -> None:
        """Delete the runs that were compacted into others."""
        for name in self.dead:
            self._drop(name)
        self.dead = []

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        fs, path = _place(self.spark, f"{self.path}/{name}")
        fs.delete(path, True)

    def add(self, fingerprints: DataFrame) -> DataFrame:
        """(h) of the fingerprints (h, one row an occurrence) that occur again; not distinct."""
        self._compact()
        name = self._write(fingerprints.groupBy("h").agg(F.count("*").alias("n")))
        run = self.spark.table(name)
        hits = run.where("n > 1").select("h")
        for old in (r for level in self.levels for r in level):
            hits = hits.unionByName(run.select("h").join(self.spark.table(old).select("h").hint("merge"), "h", "left_semi"))
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(name)
        return hits

    def close(self) -> None:
        """Forget the tables, and delete them unless the index is lasting."""
        for name in [r for level in self.levels for r in level] + self.dead:
            if self.lasting:
                self.spark.sql(f"DROP TABLE {name}")
            else:
                self._drop(name)
        self.levels, self.dead = [], []


def _place(spark: SparkSession, path: str):
    """The file system and the path object of ``path``."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


class History:
    """What earlier batches held, in the folder ``path`` that driver and executors share.

    Runs of fingerprints, and for each batch its postings (row_key, anchors) and texts. A state file
    names them; it is written when a batch is complete and replaces the one before, so that a batch
    that fails leaves the history as it was (open it anew then) and may be given again. ``window`` is fixed
    by the first batch; another one is refused. One writer at a time. A path without a state is an empty history.
    """

    def __init__(self, spark: SparkSession, path: str, window: int = 35, buckets: int | None = None, fanout: int = 4):
        self.spark, self.path, self.window = spark, path.rstrip("/"), window
        self.number, self.batches = 0, []
        fs, where = _place(spark, self.path)
        states = sorted(f.getPath().getName() for f in (fs.listStatus(where) if fs.exists(where) else []) if f.getPath().getName().startswith("state-"))
        state = {"window": window, "anchor": ANCHOR, "buckets": buckets or partitions(spark), "levels": []}
        if states:
            state = json.loads(spark.read.text(f"{self.path}/{states[-1]}", wholetext=True).first()[0])
            if (state["window"], state["anchor"]) != (window, ANCHOR):
                raise ValueError(f"the history in {path} has windows of {state['window']} words and anchors of {state['anchor']}")
            self.number, self.batches = state["number"], state["batches"]
        self.index = FingerprintIndex(spark, self.path, state["buckets"], fanout, state["levels"], lasting=True)

    def _tables(self, kind: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{kind}-{b}" for b in self.batches))

    def candidates(self, hits: DataFrame) -> DataFrame | None:
        """(row_key, text, again) of the earlier rows that have fingerprints in ``hits`` (h, distinct)."""
        if not self.batches:
            return None
        postings = self._tables("postings", "row_key long, anchors array<long>").select("row_key", F.explode("anchors").alias("h"))
        again = postings.distinct().join(hits, "h", "left_semi").groupBy("row_key").agg(F.collect_list("h").alias("again"))
        return self._tables("texts", "row_key long, text string").join(again, "row_key").select("row_key", "text", "again")

    def commit(self, docs: DataFrame, survey: DataFrame) -> None:
        """Add the batch whose fingerprints are in the index: texts of ``docs``, anchors of ``survey`` (both with row_key)."""
        name = uuid.uuid4().hex
        long = survey.where(F.size("anchors") > 0).select("row_key", "anchors")
        long.write.option("compression", "zstd").parquet(f"{self.path}/postings-{name}")
        docs.select("row_key", F.col("text").cast("string").alias("text")).where("text IS NOT NULL").write.option("compression", "zstd").parquet(f"{self.path}/texts-{name}")
        self.batches, self.number = [*self.batches, name], self.number + 1
        state = {"number": self.number, "window": self.window, "anchor": ANCHOR, "buckets": self.index.buckets, "levels": self.index.levels, "batches": self.batches}
        fs, new = _place(self.spark, f"{self.path}/new-{name}")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not fs.rename(new, _place(self.spark, f"{self.path}/state-{self.number:09d}")[1]):
            raise RuntimeError(f"another writer has added to the history in {self.path}")
        fs.delete(_place(self.spark, f"{self.path}/state-{self.number - 1:09d}")[1], False)
        self.index.sweep()

    def close(self) -> None:
        """Forget the tables of this session; the folder stays."""
        self.index.close()


def anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all windows: first word, anchor's first word; hashes of anchors by first word; windows of each text."""
    k = min(ANCHOR, window)
    counts = np.maximum(words.counts - window + 1, 0)
    starts = np.repeat(words.first[:-1], counts) + ragged(counts)
    m = len(words.starts)
    grams = np.zeros(m, U64)
    if m >= k:
        grams[: m - k + 1] = words.spans(np.arange(m - k + 1), k)
    if not len(starts):
        return starts, starts, grams, counts
    # sliding minimum with the first place of it, by doubling
    span = window - k + 1
    value, place = grams.copy(), np.arange(m)
    size = 1
    while size * 2 <= span:
        right = np.minimum(np.arange(m) + size, m - 1)
        less = value[right] < value
        value, place = np.where(less, value[right], value), np.where(less, place[right], place)
        size *= 2
    left, right = starts, starts + span - size
    less = value[right] < value[left]
    return starts, np.where(less, place[right], place[left]), grams, counts


def _joined(words: Words, i: int, keep: np.ndarray | None = None) -> bytes:
    """Words of text i (those of ``keep``), joined by one space."""
    raw = words.data[words.offsets[i] : words.offsets[i + 1]].tobytes().split()
    if keep is not None:
        raw = [w for w, k in zip(raw, keep.tolist(), strict=True) if k]
    return b" ".join(raw)


def _survey(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = Words(part.column("text"))
            starts, at, grams, counts = anchors(words, window)
            chosen = np.unique(at)
            cut = np.searchsorted(chosen, words.first)
            sums = [hashlib.sha256(_joined(words, i)).hexdigest() for i in range(part.num_rows)]
            yield pa.record_batch({
                "doc_id": part.column("doc_id"), "row_key": part.column("row_key"), "n_words": pa.array(words.counts, pa.int64()), "sha": pa.array(sums, pa.string()),
                "anchors": pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(grams[chosen].view(np.int64))),
            })

    return run


def _pack(bucket: int, told: bool, hashes: np.ndarray, keys: np.ndarray, starts: np.ndarray) -> tuple:
    names, place = np.unique(keys, return_inverse=True)
    place = place.astype("<u2" if len(names) < 1 << 16 else "<u4")
    return bucket, told, hashes.astype("<u8").tobytes(), names.astype("<i8").tobytes(), place.tobytes(), starts.astype("<u4").tobytes()


_PACKED = ("hashes", "names", "place", "starts")


def _unpack(table: pa.Table) -> list[np.ndarray]:
    cols: list[list[np.ndarray]] = [[], [], [], []]
    for told, *raw in zip(*(table.column(c).to_pylist() for c in ("told", *_PACKED)), strict=True):
        h = np.frombuffer(raw[0], "<u8")
        place = np.frombuffer(raw[2], "<u2" if len(raw[2]) * 2 == len(raw[3]) else "<u4")
        cols[0].append(h)
        cols[1].append(np.frombuffer(raw[1], "<i8")[place])
        cols[2].append(np.frombuffer(raw[3], "<u4"))
        cols[3].append(np.full(len(place), told))
    return [np.concatenate(c) for c in cols]


def _flush(hashes: np.ndarray, keys: np.ndarray, starts: np.ndarray, bits: int, spread: int) -> Iterator[pa.RecordBatch]:
    order = np.argsort(hashes, kind="stable")
    hashes, keys, starts = hashes[order], keys[order], starts[order]
    first = np.concatenate(([True], hashes[1:] != hashes[:-1]))
    many = ~first
    many[:-1] |= ~first[1:]
    rows = []
    if many.any():  # proven here: only where they stand is sent on
        rows.append(_pack(-1 - spread, True, hashes[:0], keys[many], starts[many]))
    for told in (False, True):
        pick = ~many if not told else many & first
        h, k, s = hashes[pick], keys[pick], starts[pick]
        at = (h >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
        cut = np.searchsorted(at, np.arange((1 << bits) + 1))
        rows += [_pack(b, told, *(x[cut[b] : cut[b + 1]] for x in (h, k, s))) for b in np.flatnonzero(np.diff(cut)).tolist()]
    for i in range(0, len(rows), 256):
        cols = list(zip(*rows[i : i + 256], strict=True))
        yield pa.record_batch({"bucket": pa.array(cols[0], pa.int32()), "told": pa.array(cols[1], pa.bool_())} | {c: pa.array(x, pa.binary()) for c, x in zip(_PACKED, cols[2:], strict=True)})


def _emit(window: int, bits: int):
    """Hashes of the windows whose anchor occurs again, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n, flushes, task = 0, 0, TaskContext.get().partitionId()
        for part in slices(batches):
            words = Words(part.column("text"))
            starts, at, grams, counts = anchors(words, window)
            again = part.column("again")
            doc = np.repeat(np.arange(part.num_rows), counts)
            # a text's own candidates; one that is another's only costs a comparison
            known = np.unique(np.asarray(again.flatten())).view(U64)
            keep = np.isin(grams[at], known)
            starts, doc = starts[keep], doc[keep]
            keys = np.asarray(part.column("row_key"))[doc]
            held.append((words.spans(starts, window), keys, starts - words.first[doc]))
            n += len(starts)
            if n >= FLUSH:
                yield from _flush(*map(np.concatenate, zip(*held, strict=True)), bits, (task * 31 + flushes) % 4096)
                held, n, flushes = [], 0, flushes + 1
        if n:
            yield from _flush(*map(np.concatenate, zip(*held, strict=True)), bits, (task * 31 + flushes) % 4096)

    return run


def _verified(table: pa.Table) -> pa.Table:
    """(row_key, starts) of the windows of a bucket that occur again."""
    hashes, keys, starts, told = _unpack(table)
    if len(hashes):
        order = np.argsort(hashes, kind="stable")
        hashes, keys, starts, told = hashes[order], keys[order], starts[order], told[order]
        head = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
        size = np.diff(np.append(head, len(hashes)))
        proven = np.repeat((size > 1) | np.logical_or.reduceat(told, head), size) & ~told  # told ones are marked already
        keys, starts = keys[proven], starts[proven]
    order = np.lexsort((starts, keys))
    keys, starts = keys[order], starts[order]
    # runs of neighbouring starts as (first, last)
    head = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (starts[1:].astype(np.int64) != starts[:-1].astype(np.int64) + 1)))) if len(keys) else np.zeros(0, np.int64)
    tail = np.append(head[1:], len(keys)) - 1 if len(head) else head
    return pa.table({"row_key": pa.array(keys[head]), "low": pa.array(starts[head].astype(np.int32)), "high": pa.array(starts[tail].astype(np.int32))})


def covered(spans: list[dict], n_words: int, window: int) -> np.ndarray:
    """Which of n words are covered by windows that begin in the spans (low to high)."""
    edge = np.zeros(n_words + 1, np.int64)
    for s in spans:
        edge[s["low"]] += 1
        edge[min(n_words, s["high"] + window)] -= 1
    return np.cumsum(edge[:-1]) > 0


class Repeats:
    """Where windows of ``window`` words of ``docs`` occur again, anywhere.

    survey: doc_id, row_key, n_words, sha of each row (the SHA-256 of its words joined by a
    space). marked: the rows of docs with such windows, and their spans (low, high) of window starts.
    Rows are told apart by row_key, a hash of doc_id and text: equal rows share it, and
    what holds for one holds for the other. Null texts are empty. Columns other than doc_id and
    text are carried along in marked. Fingerprints are taken in ``batches`` batches. With a
    ``history`` windows that an earlier batch of it had occur again too; its index gets the fingerprints.
    """

    def __init__(self, docs: DataFrame, window: int, batches: int = 4, work: Workspace | None = None, history: History | None = None):
        spark = docs.sparkSession
        self.window = window
        self.work = work = work or Workspace(spark, "repeats")
        self.docs = docs = docs.withColumn("row_key", F.xxhash64(F.col("doc_id").cast("string"), F.col("text")))
        kind = docs.schema["doc_id"].dataType.simpleString()
        narrow = docs.select("doc_id", "row_key", F.col("text").cast("string").alias("text"))
        survey = narrow.mapInArrow(_survey(window), f"doc_id {kind}, row_key long, n_words long, sha string, anchors array<long>")
        self.full = survey = work.keep(survey, "survey")
        self.survey = survey.drop("anchors")
        index = history.index if history else FingerprintIndex(spark, f"{work.path}/index", partitions(spark))
        hits = None
        try:
            for b in range(batches):
                mine = survey.where(F.pmod("row_key", F.lit(batches)) == b)
                found = work.keep(index.add(mine.select(F.explode("anchors").alias("h"))), f"hits-{b}")
                hits = found if hits is None else hits.unionByName(found)
        finally:
            if not history:
                index.close()
        postings = survey.select("row_key", F.explode("anchors").alias("h")).distinct()
        again = postings.join(hits.distinct(), "h").groupBy("row_key").agg(F.collect_list("h").alias("again"))
        again = work.keep(again, "again")
        n, total = again.agg(F.count("*"), F.sum(F.size("again"))).first()
        some = again.select("row_key")
        texts = docs.join(F.broadcast(some), "row_key", "left_semi") if n <= BROADCAST_KEYS else docs
        self.texts = work.keep(texts.join(again.hint("shuffle_hash"), "row_key"), "texts")
        windowed = self.texts.select("row_key", F.col("text").cast("string").alias("text"), "again")
        earlier = history.candidates(hits.distinct()) if history else None
        if earlier is not None:
            earlier = work.keep(earlier, "earlier")
            total = (total or 0) + (earlier.agg(F.sum(F.size("again"))).first()[0] or 0)
            windowed = windowed.unionByName(earlier)
        work.drop("again", *(f"hits-{b}" for b in range(batches)))
        # some (window - ANCHOR + 2) / 2 windows share an anchor
        windows = (total or 0) * (window - min(ANCHOR, window) + 2) // 2
        bits = max(0, math.ceil(math.log2(max(1, windows) / PER_BUCKET)), min(12, math.ceil(math.log2(partitions(spark)))))
        packed = windowed.mapInArrow(_emit(window, bits), "bucket int, told boolean, hashes binary, names binary, place binary, starts binary")
        spans = packed.groupBy("bucket").applyInArrow(_verified, "row_key long, low int, high int")
        spans = spans.distinct().groupBy("row_key").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
        self.marked = self.texts.drop("again").join(spans.hint("shuffle_hash"), "row_key")

    def unmarked(self, rows: DataFrame, marked: DataFrame) -> DataFrame:
        """``rows`` (with row_key) that are not in ``marked``."""
        keys = marked.select("row_key").distinct()
        return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, "row_key", "left_anti")


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = Words(part.column("text"))
            spans = part.column("spans").to_pylist()
            removed, kept = [], []
            for i in range(part.num_rows):
                gone = covered(spans[i], int(words.counts[i]), window)
                removed.append(int(gone.sum()))
                kept.append(_joined(words, i, ~gone))
            base = part.drop_columns(["spans"])
            at = base.schema.get_field_index("text")
            base = base.set_column(at, base.schema.field("text"), pa.array(kept, pa.binary()).cast(base.schema.field("text").type))
            yield base.append_column("_n", pa.array(words.counts, pa.int64())).append_column("n_removed", pa.array(removed, pa.int64()))

    return run


def digests(docs: DataFrame, window: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row: words covered by a window that
    starts anywhere else too, same document included, are removed; the kept ones are joined
    by one space. A null, empty or wordless text has 0 words and the digest of nothing."""
    found = Repeats(docs.select("doc_id", "text"), window)
    work = found.work
    rows = found.marked.select("doc_id", "row_key", F.col("text").cast("string").alias("text"), "spans")
    rows = rows.mapInArrow(_kept(window), f"{_ddl(rows, 'spans')}, _n long, n_removed long")
    changed = work.keep(rows.select("doc_id", "row_key", F.col("_n").alias("n_words"), "n_removed", F.sha2("text", 256).alias("kept_sha256")), "changed")
    work.drop("texts")
    rest = found.unmarked(found.survey, changed).select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"))
    return changed.drop("row_key").unionByName(rest)


def remove_repeats(docs: DataFrame, window: int = 35, history: History | None = None) -> DataFrame:
    """``docs`` with repeated passages removed from text, and n_removed, the number of words.

    Texts without any stay as they are; of the others the kept words are joined by one space.
    A column n_removed (or row_key, again, spans) of ``docs`` is replaced or left out; all others stay.

    With a ``history`` passages that an earlier batch of it had go as well (judged on the batches as
    they came, not on what was left of them), and ``docs``, read several times, becomes its next
    batch before this returns. A batch given twice loses all its windows the second time.
    """
    docs = docs.drop("n_removed", "row_key", "again", "spans")
    if history and history.window != window:
        raise ValueError(f"the history has windows of {history.window} words")
    found = Repeats(docs, window, history=history)
    rows = found.marked.select("row_key", *docs.columns, "spans").withColumn("text", F.col("text").cast("string"))
    changed = rows.mapInArrow(_kept(window), f"{_ddl(rows, 'spans')}, `_n` long, n_removed long").drop("_n")
    changed = found.work.keep(changed, "changed")
    found.work.drop("texts", "earlier")
    if history:
        history.commit(found.docs, found.full)
    rest = found.unmarked(found.docs, changed).withColumn("n_removed", F.lit(0).cast("long"))
    return changed.drop("row_key").unionByName(rest.drop("row_key"))


def _ddl(df: DataFrame, *but: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in but)
