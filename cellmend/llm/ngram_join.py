"""N-gram Jaccard join by PartEnum signatures.

A document's set is its distinct k-word shingles. Two sets of Jaccard similarity J >= t
and sizes a, b differ in at most (a + b)(1 - t)/(1 + t) shingles. Sizes are cut into bands
[l, l/t]; similar sets lie in one band or in neighbours. For each pair of neighbouring
bands the domain of shingles is split by hash into ``n1`` partitions, so that one of them
has at most ``k2`` differences, and each partition into ``n2`` parts, of which the
n2 - k2 without a difference are some subset; the sums of hashes over each such subset are
the signatures. Similar sets share one (Arasu, Ganti and Kaushik, VLDB 2006), so no link
is missed; candidates are verified on the full sets.

Work is spent on distinct sets (classes), and only on those that can have a partner: of a
set of n shingles that has a similar other set, at most n(1 - t) occur in no other set, in all or in
half of the domain. One pass counts those of that half, and sets with more are set aside
before any signature is made. Signatures travel packed, some thousands a row. Of the signatures with the
same members one stays. Members of a signature are linked through a star around the member that has most shared
signatures. Sets that a star leaves in different components meet by their rarest shingles instead: of those that
sets of two components hold, a set and its similar one share one of the rarest (Chaudhuri, Ganti and Kaushik, ICDE 2006).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .graph import components, few, tasks_for
from .store import Workspace, partitions
from .textvec import U64, Words, mix, slices

#: Signatures that a mapper holds before it sends them on, and that a reducer is meant to get.
FLUSH, PER_BUCKET = 1 << 19, 1 << 20
#: Bits of a signature beyond those of its bucket.
SIG_BITS = 40
#: Columns of a set's sketch.
SKETCH = [f"p{i}" for i in range(8)]
#: Rows of (doc_id) that are broadcast at most; above, the join shuffles.
BROADCAST_IDS = 1_000_000
STAR_ROUNDS = 4
#: Pairs for each row, in signatures, that the last round may take on when star rounds find little.
LAST = 256
#: With so many left for each row the last round comes at once, as another star round would read all the rows again.
FEW = 64
#: Sets with a shingle that one task of the last round compares with all others that have it.
HOT = 512


@dataclass(frozen=True)
class Instance:
    """Parameters for sets of bands ``band - 1`` and ``band``."""

    band: int
    n1: int
    k2: int
    n2: int


def bands(largest: int, pct: int) -> list[tuple[int, int]]:
    """Size bands [l, r]: r is the largest size that a set of size l can link to."""
    out, low = [], 1
    while low <= largest:
        high = low * 100 // pct
        out.append((low, high))
        low = high + 1
    return out


def plan(sizes: list[tuple[int, int]], pct: int) -> tuple[list[tuple[int, int]], list[Instance]]:
    """Bands and the cheapest parameters of each instance, from (band index, number of sets).

    The price of a choice is its signatures plus the accidental candidates expected of
    unrelated sets, which fall as exp(-2 * size * share of the domain in a signature).
    """
    top = max((b for b, _ in sizes), default=-1)
    limits, low = [], 1
    for _ in range(top + 1):
        limits.append((low, low * 100 // pct))
        low = limits[-1][1] + 1
    count = dict(sizes)
    out: list[Instance] = []
    if top < 0:
        return limits, out
    for j in range(top + 2):
        low, high = limits[max(0, j - 1)][0], limits[min(j, top)][1]
        n = count.get(j - 1, 0) + count.get(j, 0)
        k = 2 * high * (100 - pct) // (100 + pct)
        best = None
        for k2 in range(min(k, 4) + 1):
            n1 = k // (k2 + 1) + 1
            for n2 in range(k2 + 1, k2 + 6) if k2 else (1,):
                signatures = n1 * math.comb(n2, k2)
                # members are about in the middle of the two bands
                chance = min(1.0, signatures * math.exp(-2 * math.sqrt(low * high) * (n2 - k2) / (n2 * n1)))
                price = signatures * n + 80 * n * n * chance
                best = min(best or (math.inf,), (price, n1, k2, n2))
        out.append(Instance(j, *best[1:]))
    return limits, out


def _sets(words: Words, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, counts = words.windows(k, short=True)
    ends = np.cumsum(counts)
    out = []
    for a, b in zip(ends - counts, ends, strict=True):
        s = np.sort(h[a:b])
        out.append(s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s)
    return out


def _node(sets: list[np.ndarray]) -> np.ndarray:
    """One 64-bit name for each set, of its content only; equal sets share it."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.zeros(len(sets), U64)
    if full := np.flatnonzero(sizes).tolist():
        flat = mix(np.concatenate([sets[i] for i in full]), 7)
        out[full] = np.add.reduceat(flat, np.cumsum(sizes[full]) - sizes[full])
    return mix(out + sizes.astype(U64), 8)


def _digests(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = _sets(Words(part.column("text"), lower=True), k)
            bits = _sketches(sets)
            yield pa.record_batch({"doc_id": part.column("doc_id").cast(pa.int64()), "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "node": pa.array(_node(sets).view(np.int64))} | {c: pa.array(bits[:, i].copy()) for i, c in enumerate(SKETCH)})

    return run


def _sketches(sets: list[np.ndarray]) -> np.ndarray:
    """512 bits of each set: the parities of the numbers of its shingles in 512 classes.

    Two sets' sketches differ in at most as many bits as the sets in shingles.
    """
    sizes = [len(s) for s in sets]
    flat = mix(np.concatenate(sets), 12) if sum(sizes) else np.zeros(0, U64)
    cell = np.repeat(np.arange(len(sets)) * 512, sizes) + (flat >> U64(55)).astype(np.int64)
    odd = np.bincount(cell, minlength=512 * len(sets)).reshape(len(sets), 512) & 1
    return np.packbits(odd.astype(bool), axis=1).view("<i8")


def signatures(sets: list[np.ndarray], limits: list[tuple[int, int]], instances: list[Instance]) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of each (non-empty) set, and the index of the set of each."""
    size = np.array([len(s) for s in sets], np.int64)
    band = np.searchsorted([high for _, high in limits], size)
    flat, found, owner = mix(np.concatenate(sets), 3), [], []
    content = mix(flat, 4)
    n1s, n2s, k2s = (np.array([getattr(i, f) for i in instances], np.int64) for f in ("n1", "n2", "k2"))
    for up in (0, 1):
        at = band + up
        n1, n2 = n1s[at], n2s[at]
        part = ((flat >> U64(32)) * np.repeat(n1.astype(U64), size)) >> U64(32)
        sub = ((flat & U64(0xFFFFFFFF)) * np.repeat(n2.astype(U64), size)) >> U64(32)
        base = np.cumsum(n1 * n2) - n1 * n2
        cell = (np.repeat(base, size) + (part * np.repeat(n2.astype(U64), size) + sub).astype(np.int64))
        total = int((n1 * n2).sum())
        # sums modulo 2**64 from exact sums of the two halves
        low = np.bincount(cell, (content & U64(0xFFFFFFFF)).astype(float), total).astype(U64)
        high = np.bincount(cell, (content >> U64(32)).astype(float), total).astype(U64)
        sums = low + (high << U64(32))
        shape = k2s[at] * 64 + n2
        for s in np.unique(shape):
            mine = np.flatnonzero(shape == s)
            k2, m = int(s) // 64, int(s) % 64
            rows = n1[mine]
            who = np.repeat(mine, rows)
            which = np.arange(len(who)) - np.repeat(np.cumsum(rows) - rows, rows)
            cells = sums[(np.repeat(base[mine], rows) + which * m)[:, None] + np.arange(m)]
            cells = cells * mix(np.arange(m, dtype=U64), 5)
            label = mix((at[who].astype(U64) << U64(40)) + which.astype(U64), 6)
            for c, keep in enumerate(combinations(range(m), m - k2)):
                found.append(mix(cells[:, list(keep)].sum(axis=1, dtype=U64) + label * U64(2 * c + 1), 9))
                owner.append(who)
    return np.concatenate(found), np.concatenate(owner)


def _pack(bucket: int, live: bool, sig: np.ndarray, node: np.ndarray) -> tuple:
    """Sorted signatures as high and low halves (the high ones compress to nothing), and
    each one's set as a place in a short list of sets."""
    names, place = np.unique(node, return_inverse=True)
    place = place.astype("<u2" if len(names) < 1 << 16 else "<u4")
    return bucket, live, (sig >> U64(32)).astype("<u4").tobytes(), sig.astype("<u4").tobytes(), names.tobytes(), place.tobytes()


_PACKED = "bucket int, live boolean, high binary, low binary, names binary, place binary"


def _unpack(table: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    sigs, nodes = [], []
    for high, low, names, place in zip(*(table.column(c).to_pylist() for c in ("high", "low", "names", "place")), strict=True):
        sigs.append(np.frombuffer(high, "<u4").astype(U64) << U64(32) | np.frombuffer(low, "<u4").astype(U64))
        nodes.append(np.frombuffer(names, U64)[np.frombuffer(place, "<u2" if len(place) * 2 == len(low) else "<u4")])
    return sigs, nodes


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    bucket, live, *packed = zip(*rows, strict=True)
    return pa.record_batch({"bucket": pa.array(bucket, pa.int32()), "live": pa.array(live, pa.bool_())} | {c: pa.array(x, pa.binary()) for c, x in zip(("high", "low", "names", "place"), packed, strict=True)})


def _runs(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values of a sorted array."""
    starts = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
    return starts, np.diff(np.append(starts, len(sig)))


def _distinct(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    if len(sig):
        keep = np.concatenate(([True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])))
        sig, node = sig[keep], node[keep]
    return sig, node


def _flush(sig: np.ndarray, node: np.ndarray, bits: int, spread: int) -> Iterator[pa.RecordBatch]:
    """Packed rows. A signature that two sets here share needs no proof elsewhere: its
    members go on as live, spread evenly, and one entry tells the signature's bucket.
    Signatures keep SIG_BITS bits beyond their bucket: equal ones by chance cost a comparison."""
    sig, node = _distinct(sig >> U64(64 - SIG_BITS - bits), node)
    starts, lengths = _runs(sig)
    shared = np.repeat(lengths > 1, lengths)
    lead = np.zeros(len(sig), bool)
    lead[starts] = True
    rows = []
    if shared.any():
        rows.append(_pack(-1 - spread, True, sig[shared], node[shared]))
    for told in (False, True):
        pick = ~shared if not told else lead & shared
        s, n = sig[pick], node[pick]
        at = (s >> U64(SIG_BITS)).astype(np.int64)
        cut = np.searchsorted(at, np.arange((1 << bits) + 1))
        rows += [_pack(b, told, s[cut[b] : cut[b + 1]], n[cut[b] : cut[b + 1]]) for b in np.flatnonzero(np.diff(cut)).tolist()]
    for i in range(0, len(rows), 256):
        yield _rows(rows[i : i + 256])


def _emit(k: int, limits, instances, bits: int):
    """Signatures of the sets of rows (node, text), packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, n, flushes = [], 0, 0
        task = TaskContext.get().partitionId()
        for part in slices(batches):
            sets, names = _wanted(part, k)
            fresh = []
            for i, name in enumerate(names.tolist()):
                if name not in seen:  # a copy has the same signatures
                    seen.add(name)
                    fresh.append(i)
            if len(seen) > 500_000:
                seen.clear()
            if fresh:
                sig, who = signatures([sets[i] for i in fresh], limits, instances)
                held.append((sig, names[fresh].view(U64)[who]))
                n += len(sig)
            if n >= FLUSH:
                yield from _flush(*map(np.concatenate, zip(*held, strict=True)), bits, (task * 31 + flushes) % 4096)
                held, n, flushes = [], 0, flushes + 1
        if n:
            yield from _flush(*map(np.concatenate, zip(*held, strict=True)), bits, (task * 31 + flushes) % 4096)

    return run


def _live(table: pa.Table) -> pa.Table:
    """(sig, node) of the signatures of a bucket that two sets share; the members of one
    that are told live elsewhere come from there."""
    sigs, nodes = _unpack(table)
    told = table.column("live").to_pylist()
    if table.column("bucket")[0].as_py() < 0:
        sig, node = np.concatenate(sigs), np.concatenate(nodes)
    else:
        sig, node = _distinct(np.concatenate(sigs), np.concatenate(nodes))
        _, lengths = _runs(sig)
        keep = np.repeat(lengths > 1, lengths)
        if any(told):
            keep |= np.isin(sig, np.concatenate([s for s, t in zip(sigs, told, strict=True) if t]))
        sig, node = sig[keep], node[keep]
    return pa.table({"sig": pa.array(sig.view(np.int64)), "node": pa.array(node.view(np.int64))})


def _wanted(part: pa.RecordBatch, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The sets of the texts whose node is the one they were fetched for, and their nodes; a doc_id may have other texts."""
    sets = _sets(Words(part.column("text"), lower=True), k)
    node = np.asarray(part.column("node"))
    at = np.flatnonzero(_node(sets).view(np.int64) == node)
    return [sets[i] for i in at.tolist()], node[at]


def _texts_to_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets, node = _wanted(part, k)
            yield pa.record_batch({"node": pa.array(node), "hashes": pa.array([x.tobytes() for x in sets], pa.binary())})

    return run


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingle, node, root) of the sets of rows (node, root, hashes)."""
    for batch in batches:
        # some thousands of sets would be one batch of millions of rows
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column("hashes")]
            size = [len(x) for x in sets]
            yield pa.record_batch({"shingle": pa.array(np.concatenate(sets))} | {c: pa.array(np.repeat(np.asarray(part.column(c)), size)) for c in ("node", "root")})


def _verify(pct: int):
    """Keep the pairs whose sets have 100 * intersection >= pct * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                both = np.concatenate((np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)))
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= pct * (len(both) - common))
            yield pa.record_batch({c: batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")})

    return run


def _spread(k: int, bits: int):
    """32 leading bits of the shingles of each set in half of the domain, packed by bucket; a
    value that two sets here share is sent on once, as told."""

    def flush(value: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        value, node = _distinct(value, node)
        starts, lengths = _runs(value)
        once = np.repeat(lengths == 1, lengths)
        lead = np.zeros(len(value), bool)
        lead[starts] = True
        rows = []
        for told in (False, True):
            pick = once if not told else lead & ~once
            v, n = value[pick], node[pick]
            cut = np.searchsorted(v >> U64(32 - bits), np.arange((1 << bits) + 1))
            rows += [_pack(b, told, v[cut[b] : cut[b + 1]], n[cut[b] : cut[b + 1]]) for b in np.flatnonzero(np.diff(cut)).tolist()]
        for i in range(0, len(rows), 256):
            yield _rows(rows[i : i + 256])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, n = [], 0
        for part in slices(batches):
            sets = _sets(Words(part.column("text"), lower=True), k)
            names, fresh = _node(sets), []
            for i, name in enumerate(names.tolist()):
                if len(sets[i]) and name not in seen:
                    seen.add(name)
                    fresh.append(i)
            if len(seen) > 500_000:
                seen.clear()
            if not fresh:
                continue
            flat, owner = np.concatenate([sets[i] for i in fresh]), np.repeat(names[fresh], [len(sets[i]) for i in fresh])
            half = flat & U64(1) == 0
            held.append((flat[half] >> U64(32), owner[half]))
            n += len(held[-1][0])
            if n >= FLUSH:
                yield from flush(*map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
        if n:
            yield from flush(*map(np.concatenate, zip(*held, strict=True)))

    return run


def _alone(groups: int):
    """The number of values of a bucket that each set has alone, packed by groups of sets."""

    def run(table: pa.Table) -> pa.Table:
        values, nodes = _unpack(table)
        told = np.repeat(table.column("live").to_pylist(), [len(v) for v in values])
        value, node = np.concatenate(values), np.concatenate(nodes)
        order = np.argsort(value, kind="stable")
        value, node, told = value[order], node[order], told[order]
        starts, lengths = _runs(value)
        names, counts = np.unique(node[starts[(lengths == 1) & ~told[starts]]], return_counts=True)
        group = (names % U64(groups)).astype(np.int64)
        by = np.argsort(group, kind="stable")
        names, counts, group = names[by], counts[by].astype("<u4"), group[by]
        head = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.zeros(0, np.int64)
        cuts = list(zip(head.tolist(), [*head[1:].tolist(), len(group)], strict=True)) if len(head) else []
        return pa.table({"part": pa.array(group[head].astype(np.int32)), "names": pa.array([names[a:b].tobytes() for a, b in cuts], pa.binary()), "counts": pa.array([counts[a:b].tobytes() for a, b in cuts], pa.binary())})

    return run


def _sum_alone(table: pa.Table) -> pa.Table:
    names = np.frombuffer(b"".join(table.column("names").to_pylist()), U64)
    counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), "<u4")
    distinct, which = np.unique(names, return_inverse=True)
    return pa.table({"node": pa.array(distinct.view(np.int64)), "alone": pa.array(np.bincount(which, counts, len(distinct)).astype(np.int64))})


def jaccard_join(docs: DataFrame, k: int = 5, pct: int = 80, work: Workspace | None = None) -> DataFrame:
    """(doc_id, n_shingles, node, component_id) of each row of ``docs`` (doc_id, text).

    Documents whose lower-cased (A-Z) k-word shingle sets have 100 * |A n B| >= pct * |A u B|
    are linked; component_id is the smallest doc_id that links reach. node names the
    document's set: equal sets, equal node. A text of fewer than k words is one shingle;
    a null or wordless text has no shingle, n_shingles 0 and is linked with nothing, its
    component being itself. Rows repeating a doc_id stay separate rows of one document.
    A row with a null doc_id stays: its component is that of its set, and a set that only
    such rows have is linked with nothing and has none. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    work = work or Workspace(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    digest = work.keep(docs.mapInArrow(_digests(k), "doc_id long, n_shingles long, node long" + "".join(f", {c} long" for c in SKETCH)), "digest")
    nodes = work.keep(digest.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), *(F.max(c).alias(c) for c in SKETCH)), "nodes")

    n, total = nodes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = min(20, max(3, math.ceil(math.log2(max(1, total / 2) / PER_BUCKET))))
    counts = docs.mapInArrow(_spread(k, bits), _PACKED).groupBy("bucket").applyInArrow(_alone(n // 50_000 + 1), "part int, names binary, counts binary")
    alone = counts.groupBy("part").applyInArrow(_sum_alone, "node long, alone long")
    nodes = nodes.join(alone, "node", "left").withColumn("most", F.col("n") - F.coalesce("alone", F.lit(0))).drop("alone")
    nodes = work.keep(nodes, "weighed")
    work.drop("nodes")
    # a similar set holds at least pct percent of the set's shingles
    able = work.keep(nodes.where(F.expr(f"100 * most >= {pct} * n")), "able")

    largest = able.agg(F.max("n")).first()[0] or 0
    limits = bands(largest, pct)
    edges_of = F.array(*[F.lit(high) for _, high in limits]) if limits else F.array(F.lit(0))
    sizes = [(r["band"], r["n"]) for r in able.groupBy(F.size(F.filter(edges_of, lambda h: h < F.col("n"))).alias("band")).agg(F.count("*").alias("n")).collect()]  # one row for each band: their number is the logarithm of the longest text
    limits, instances = plan(sizes, pct)
    total = 0
    for b, n in sizes:
        total += n * sum(i.n1 * math.comb(i.n2, i.k2) for i in instances[b : b + 2])
    bits = min(20, max(3, math.ceil(math.log2(max(1, total) / PER_BUCKET))))

    def texts(which: DataFrame) -> DataFrame:
        wanted = which.select("node", "doc_id")
        wanted = F.broadcast(wanted) if which.count() <= BROADCAST_IDS else wanted
        return docs.join(wanted, "doc_id").select("node", "text")

    def fetch(which: DataFrame, name: str) -> DataFrame:
        return work.keep(texts(which).mapInArrow(_texts_to_sets(k), "node long, hashes binary").dropDuplicates(["node"]), name)

    packed = texts(able).mapInArrow(_emit(k, limits, instances, bits), _PACKED)
    live = work.keep(packed.groupBy("bucket").applyInArrow(_live, "sig long, node long"), "live")

    suspects = work.keep(live.groupBy("node").agg(F.count("*").alias("degree")).join(able, "node"), "suspects")
    work.drop("able")
    live = _once(live, work)

    roots = _resolve(live, suspects, fetch, pct, work)
    work.drop("once", "suspects")
    named = nodes.join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    lowest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_node = work.keep(named.join(lowest, "root").select("node", "component_id", "root"), "of_node")
    work.drop("weighed", *(f"cc-{r}" for r in range(1, STAR_ROUNDS + 2)))
    return digest.drop(*SKETCH).join(of_node, "node", "left").select("doc_id", "n_shingles", "node", F.coalesce("component_id", "doc_id").alias("component_id"), "root")


def with_nodes(docs: DataFrame, k: int) -> DataFrame:
    """``docs`` with the node and n_shingles that jaccard_join gives each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = _sets(Words(part.column("text"), lower=True), k)
            yield pa.record_batch([*part.columns, pa.array(_node(sets).view(np.int64)), pa.array([len(s) for s in sets], pa.int64())], [*part.schema.names, "node", "n_shingles"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("node", LongType()), StructField("n_shingles", LongType())]))


def _compare(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """The pairs (a, b) that pass; few pairs go to the sets, many meet them in a shuffle."""
    small = pairs.count() <= BROADCAST_IDS
    side = lambda e: sets.select(F.col("node").alias(e), F.col("hashes").alias(f"set_{e}"))
    left = side("a").join(F.broadcast(pairs) if small else pairs, "a")
    return left.join(side("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(_verify(pct), "a long, b long")


def _possible(pct: int, x: str = "", y: str = "2") -> str:
    """May two sets, by their sizes, shareable shingles and sketches, be similar enough?"""
    apart = " + ".join(f"bit_count({c}{x} ^ {c}{y})" for c in SKETCH)
    most = f"least(most{x}, most{y})"
    return f"100 * {most} >= {pct} * (n{x} + n{y} - {most}) AND ({apart}) * {100 + pct} <= (n{x} + n{y}) * {100 - pct}"


def _once(live: DataFrame, work: Workspace) -> DataFrame:
    """``live`` without the signatures whose members are those of another one, which asks for the same pairs.

    Near copies share most of their signatures with each other only. Lists of members are told apart by
    their length and the sums of the halves of their members' hashes; a member listed twice counts twice.
    """
    h = F.xxhash64("node")
    lists = live.groupBy("sig").agg(F.count("*").alias("c"), F.sum(h.bitwiseAND(0xFFFFFFFF)).alias("low"), F.sum(F.shiftrightunsigned(h, 32)).alias("high"))
    first = work.keep(lists.groupBy("c", "low", "high").agg(F.min("sig").alias("sig")).select("sig"), "first")
    small = first.count() <= BROADCAST_IDS
    once = work.keep(live.join(F.broadcast(first) if small else first.hint("merge"), "sig", "left_semi"), "once")
    work.drop("live", "first")
    return once


def _rarest(sets: DataFrame, rest: DataFrame, pct: int, work: Workspace) -> DataFrame:
    """(shingle, most) of the rarest shingles of each set of ``rest``, with its columns.

    Only shingles count that sets of two components hold. most is the number of them from this one on, in
    order of the number of sets that hold one. At the first that two sets share it bounds their intersection,
    which for similar sets is pct percent of either: each of the two has a row for that shingle.
    """
    tasks = tasks_for(rest.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    small = lambda df: few(df, tasks)
    held = small(sets.join(rest.select("node", "root"), "node")).mapInArrow(_shingles, "shingle long, node long, root long")
    shared = small(held.groupBy("shingle").agg(F.count("*").alias("c"), F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("shingle", "c"))
    order = Window.partitionBy("node").orderBy(F.desc("c"), F.desc("shingle"))
    ranked = small(held.select("shingle", "node").join(shared, "shingle")).select("shingle", "node", F.row_number().over(order).alias("most"))
    rarest = ranked.join(rest, "node").where(f"100 * most >= {pct} * n").select("shingle", "most", "node", "root", "n", *SKETCH)
    return work.keep(small(rarest), "rarest")


def _meet(rarest: DataFrame, pct: int) -> DataFrame:
    """The pairs of sets of different components that share one of their rarest shingles and may be similar enough."""
    # sets with a frequent shingle are dealt over several tasks, each of which meets all others
    large = rarest.groupBy("shingle").agg(F.ceil(F.count("*") / HOT).cast("int").alias("shares")).where("shares > 1")
    x = rarest.join(large, "shingle", "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
    y = x.select("shingle", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), *(F.col(c).alias(f"{c}2") for c in x.columns if c not in ("shingle", "shares")))
    x = x.withColumn("share", F.pmod(F.xxhash64("node", F.lit(-1)), "shares").cast("int")).drop("shares")
    return x.join(y, ["shingle", "share"]).where("node < node2 and root <> root2").where(_possible(pct))


def _resolve(live: DataFrame, suspects: DataFrame, fetch, pct: int, work: Workspace) -> DataFrame:
    """(node, root) of the components of linked sets, from verified links between sets that share a signature.

    A star round compares each member of a signature with one other member, in the first of
    highest degree, while such rounds find links. Signatures whose members are in one
    component then are done. In the last round the members of the rest meet by their rarest
    shingles, and those in different components that were not compared are, so that no
    connection is lost. Sizes, shingles that can be shared and sketches rule out most pairs; what
    they pass is compared in full. A round's links are added to the components of the one before
    it. Its tables go when the next has read them.
    """
    tasks = tasks_for(live.count())
    small = lambda df: few(df, tasks)
    members = small(live.join(suspects.select("node", "degree", "n", "most"), "node"))
    facts = suspects.select("node", "n", "most", *SKETCH)
    done = comp = None
    tried = won = 0
    for r in range(STAR_ROUNDS + 1):
        if r:
            open_ = small(members.join(comp, "node", "left").select("sig", "node", "degree", "n", "most", F.coalesce("root", "node").alias("root")))
            # of two members, the first round has compared the pair
            unsettled = open_.groupBy("sig").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("c"), F.min("n").alias("low")).where("x <> y and c > 2").select("sig", "low")
            # most bounds any intersection of a set, and so its similarity to sets of the sizes that share the signature
            bound = F.expr(f"100 * most >= {pct} * (n + greatest(low, most) - most)")
            open_ = work.keep(small(open_.join(unsettled, "sig").where(bound).drop("low")), f"open-{r}")
            work.drop(f"open-{r - 1}")
            members = open_.drop("root")
            size = small(open_.groupBy("sig", "root").agg(F.count("*").alias("c"))).groupBy("sig").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("s"))
            left, rows = small(size).agg(F.sum((F.col("m") * F.col("m") - F.col("s")) / 2), F.sum("m")).first()
            if not rows:
                break
        else:
            open_ = members.withColumn("root", F.col("node"))
            left = rows = 0
        last = r == STAR_ROUNDS or (r and (left <= FEW * rows or tried > 50 * won and left <= LAST * rows))
        if last:
            open_ = work.keep(small(open_.select("node", "root").distinct()).join(suspects.drop("degree", "most"), "node"), "rest")
            full = fetch(open_, f"full-{r}")
            pairs = _meet(_rarest(full, open_, pct, work), pct)
        else:
            # later rounds take leads in another order
            order = F.col("degree") if not r else F.xxhash64("node", F.lit(r))
            lead = open_.groupBy("sig").agg(F.max(F.struct(order.alias("o"), "node", "root")).alias("l"))
            lead = lead.select("sig", F.col("l.node").alias("node2"), F.col("l.root").alias("root2"))
            pairs = open_.join(lead, "sig").where("node <> node2 and root <> root2")
        pairs = small(pairs.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"))).distinct()
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = work.keep(small(pairs), f"pairs-{r}")
        likely = pairs
        if not last:
            for e in "ab":
                likely = likely.join(facts.select(F.col("node").alias(e), *(F.col(c).alias(f"{c}_{e}") for c in ("n", "most", *SKETCH))), e)
                likely = small(likely)
            likely = work.keep(likely.where(_possible(pct, "_a", "_b")).select("a", "b"), f"likely-{r}")
            ends = small(likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct())
            full = fetch(suspects.join(ends, "node", "left_semi"), f"full-{r}")
        found = work.keep(small(_compare(likely, full, pct)), f"found-{r}")
        work.drop(f"full-{r}", f"likely-{r}")
        tried, won = pairs.count(), found.count()
        stars = found if comp is None else found.unionByName(comp.select(F.col("node").alias("a"), F.col("root").alias("b")))
        if won or comp is None:
            comp = components(stars, work, f"cc-{r + 1}")
        done = pairs if done is None else done.unionByName(pairs)
        if last:
            break
    work.drop("rest", "rarest", *(f"{t}-{i}" for t in ("open", "pairs", "found") for i in range(STAR_ROUNDS + 1)))
    return comp
