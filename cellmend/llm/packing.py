"""Packing of tokenised documents into sequences by the sum-of-squares rule.

Each document's ids are cut into full sequences and a rest. Rests are placed one after the
other: with N(h) the number of open sequences filled to level h, a rest of size s goes to
the level h (0 is a new sequence) for which the sum of the squares of N after the placement
is smallest (Csirik et al., 2006). N is one array of as many levels as a sequence has
tokens. When a task's documents end, the fullest of the sequences still open, as many as all
their tokens fill, stay as they were placed and are topped up with the documents of the emptiest, cut
where a sequence is full; what is left at last, less than one sequence, is cut at powers
of two, where no padding is due. Tasks pack on their own, so there is no shuffle, and a
lost task packs the same again.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import CHUNK_BYTES, Encoder, load_vocabulary
from .textvec import slices


class SumOfSquares:
    """Open sequences of ``capacity`` tokens; bins hold (piece, size) lists."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(capacity + 1)]

    def place(self, piece, size: int) -> list | None:
        """Put a piece of 1 to capacity - 1 tokens; returns the sequence that it fills, if it does."""
        top = self.capacity - size
        level = self.count[: top + 1]
        # change of the sum of squares: one less at h (none at 0), one more at h + size (none when full)
        cost = 2 * self.count[size : self.capacity + 1] + 1 - (2 * level - 1)
        cost[0] = 2 * self.count[size] + 1
        cost[top] = 1 - 2 * level[top] if top else 0
        cost[1:][level[1:] == 0] = np.iinfo(np.int64).max
        h = top - int(np.argmin(cost[::-1]))  # of equal ones the fullest
        if h:
            self.count[h] -= 1
            content = self.open[h].pop()
        else:
            content = []
        content.append((piece, size))
        if h + size == self.capacity:
            return content
        self.count[h + size] += 1
        self.open[h + size].append(content)
        return None

    def dissolve(self) -> list[list]:
        """The open sequences, fullest first; none stays open."""
        out = [c for level in reversed(self.open) for c in level]
        self.count[:] = 0
        self.open = [[] for _ in range(self.capacity + 1)]
        return out


def _pow2(n: int) -> list[int]:
    """n as a sum of powers of two, the largest first."""
    return [1 << b for b in reversed(range(n.bit_length())) if n >> b & 1]


class Packer:
    """Packs documents one by one; pieces are (document, start, length, sequence, offset)."""

    def __init__(self, capacity: int):
        self.capacity, self.bins, self.sequence = capacity, SumOfSquares(capacity), 0
        #: Tokens of rests that stay where the rule placed them, and of those that were cut up to top sequences up.
        self.placed = self.moved = 0

    def _close(self, pieces: list[tuple]) -> list[tuple]:
        """One sequence of pieces (document, start, length)."""
        out, offset = [], 0
        for doc, start, length in pieces:
            out.append((doc, start, length, self.sequence, offset))
            offset += length
        self.sequence += 1
        return out

    def add(self, doc, size: int) -> list[tuple]:
        out = []
        full = size // self.capacity
        for i in range(full):
            out += self._close([(doc, i * self.capacity, self.capacity)])
        if rest := size - full * self.capacity:
            done = self.bins.place((doc, full * self.capacity), rest)
            if done:
                out += self._close([(*p, n) for p, n in done])
                self.placed += self.capacity
        return out

    def finish(self) -> list[tuple]:
        """Close the open sequences: the fullest are topped up with the documents of the emptiest."""
        out = []
        bins = [[(*p, n) for p, n in content] for content in self.bins.dissolve()]
        sizes = [sum(n for *_, n in content) for content in bins]
        full = sum(sizes) // self.capacity
        spare = deque(piece for content in bins[full:] for piece in content)
        for content, size in zip(bins[:full], sizes, strict=False):
            out += self._close(content + self._take(spare, self.capacity - size))
        self.placed += sum(sizes[:full])
        left = sum(sizes) - full * self.capacity
        self.moved += sum(sizes[full:])
        for goal in _pow2(left):
            out += self._close(self._take(spare, goal))
        return out

    def _take(self, spare: deque, goal: int) -> list[tuple]:
        """Pieces of ``goal`` tokens from the front, the last one cut."""
        out = []
        while goal:
            doc, start, size = spare.popleft()
            take = min(size, goal)
            out.append((doc, start, take))
            goal -= take
            if take < size:
                spare.appendleft((doc, start + take, size - take))
        return out


SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its whole text by the vocabulary at ``path``, then ``end_id``;
    a null or empty text is the end id alone. Each id is in exactly one piece. Sequences are
    full, but for at most log2(capacity) of a power of two for each task. sequence_id is the
    task's number times 2**40 plus the sequence's in the task. Rows repeating a doc_id are
    documents of their own and a null doc_id stays null; other columns are not read. Held
    are the ids of documents with an open rest, cut down to that rest.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(load_vocabulary(spark, path))
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = Encoder(shared.value), Packer(capacity)
        base = TaskContext.get().partitionId() << 40
        held: dict[int, tuple] = {}  # document's number -> (doc_id, its size, where ids begin, ids, ids not yet in a sequence)
        number = 0
        id_type = None

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            out = []
            for n, start, length, sequence, offset in pieces:
                doc_id, size, at, ids, left = held[n]
                out.append((doc_id, start, length, zlib.crc32(ids[4 * (start - at) : 4 * (start - at + length)]), size, base + sequence, offset))
                if left == length:
                    del held[n]
                else:
                    held[n] = (doc_id, size, at, ids, left - length)
            cols = list(zip(*out, strict=True))
            return pa.record_batch([pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for part in slices(batches, limit=CHUNK_BYTES):
            id_type = part.column("doc_id").type
            ids, at = encoder.encode(part.column("text"))
            raw, at, pieces, touched = ids.astype("<u4").tobytes(), at.tolist(), [], []
            end = int(end_id).to_bytes(4, "little")
            for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
                size = at[i + 1] - at[i] + 1
                held[number] = (doc_id, size, 0, raw[4 * at[i] : 4 * at[i + 1]] + end, size)
                pieces += packer.add(number, size)
                touched.append(number)
                number += 1
            if pieces:
                yield rows(pieces)
            for n in touched:  # of what waits, only the rest is kept
                if n in held and held[n][4] < held[n][1]:
                    doc_id, size, _, text, left = held[n]
                    held[n] = (doc_id, size, size - left, text[4 * (size - left) :], left)
        if number and (pieces := packer.finish()):
            yield rows(pieces)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind.simpleString()}, {SCHEMA}")
