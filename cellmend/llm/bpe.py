"""Byte-level BPE encoding and decoding of whole text columns.

Texts are cut into pre-tokens and the distinct pre-tokens of a task are encoded together:
an index maps each mergeable pair, by its rank, to all positions where it stands; the
active ranks are applied in ascending order, each to all its positions at once, and the lists
of the pairs that a merge creates are extended. All steps are NumPy operations on a chunk.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import U64, hashed, numbered, ragged, slices, text_bytes

#: Distinct pre-tokens that a task remembers; beyond, it forgets them all and goes on.
REMEMBERED = 600_000
#: Text bytes encoded at once.
CHUNK_BYTES = 2 << 20
#: Ids decoded at once.
DECODED = 1 << 19
_LETTER, _NUMBER, _SPACE, _OTHER = range(4)
_classes: list[np.ndarray] = []


def _class_table() -> np.ndarray:
    """The class of each code point, for the byte-level pattern's \\p{L}, \\p{N} and \\s."""
    if not _classes:
        points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
        text = "".join(map(chr, points))
        table = np.full(0x110000, _OTHER, np.uint8)
        for kind, what in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
            for m in regex.finditer(what, text):
                table[points[m.start()] : points[m.end() - 1] + 1] = kind
        table[0xD800:0xE000] = _OTHER
        _classes.append(table)
    return _classes[0]


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary, read from the text of a tokenizer file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("a byte-level BPE vocabulary without prefix space and normalizer is needed")
        vocab, letters = spec["model"]["vocab"], _byte_letters()
        self.special = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            if token.encode() not in self.special:
                self.bytes_of[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.left, self.right = left, right
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = left << 20 | right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order
        self.byte_id = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64)
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.at = np.cumsum(self.lengths) - self.lengths

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 if it has none; symbols below 0 have none."""
        key = a << 20 | b
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, self.ranks[i], -1)

    def encode_words(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the byte strings at ``starts`` of ``data``, one after the other, and their number for each."""
        # symbols of all words in one array, a barrier of -1 before each word and after the last
        n = len(starts)
        size = int(lengths.sum()) + n + 1
        first = np.cumsum(lengths + 1) - lengths
        sym = np.full(size, -1, np.int64)
        inside = np.repeat(first, lengths) + (off := ragged(lengths))
        sym[inside] = self.byte_id[data[np.repeat(starts, lengths) + off]]
        nxt, prv = np.arange(1, size + 1), np.arange(-1, size - 1)
        nxt[-1], prv[0] = size - 1, 0
        alive = np.ones(size, bool)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(ranks: np.ndarray, places: np.ndarray) -> None:
            keep = ranks >= 0
            ranks, places = ranks[keep], places[keep]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cut = np.flatnonzero(np.concatenate(([True], ranks[1:] != ranks[:-1])))
            for r, part in zip(ranks[cut].tolist(), np.split(places, cut[1:]), strict=True):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(active, r)

        add(self.rank(sym[:-1], sym[1:]), np.arange(size - 1))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            p = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b, new = self.left[r], self.right[r], self.made[r]
            p = p[alive[p] & (sym[p] == a)]
            p = p[sym[nxt[p]] == b]
            if a == b and len(p) > 1:  # of a run, every other place from the left
                p = np.sort(p)
                free, kept = -1, []
                for i, j in zip(p.tolist(), nxt[p].tolist(), strict=True):
                    if i != free:
                        kept.append(i)
                        free = j
                p = np.array(kept, np.int64)
            if not len(p):
                continue
            q = nxt[p]
            after = nxt[q]
            sym[p], alive[q], nxt[p] = new, False, after
            prv[after] = p
            before = prv[p]
            places = np.concatenate((before, p))
            add(self.rank(sym[places], sym[np.concatenate((p, after))]), places)
        left = alive & (sym >= 0)
        total = np.concatenate(([0], np.cumsum(left)))
        return sym[left], total[first + lengths] - total[first]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the ids, and where each id's begin and the last end."""
        size = self.lengths[ids]
        return self.flat[np.repeat(self.at[ids], size) + ragged(size)], np.concatenate(([0], np.cumsum(size)))


class Encoder:
    """Encodes columns of texts, remembering the pre-tokens that it has met.

    Pre-tokens of a chunk are told apart by their bytes, and known from chunk to chunk by
    hashes of them that a random seed of this encoder keys.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.seed = secrets.randbits(24)
        self._forget()

    def _forget(self) -> None:
        self.keys, self.where, self.size = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(1 << 16, np.int32)
        self.filled = 0

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts of the pre-tokens, the end of the last, the index of the text of each
        and, for special tokens, their id (else -1)."""
        raw = data.tobytes()
        forced: list[tuple[int, int, int]] = []
        for token, i in self.vocabulary.special.items():
            at = raw.find(token)
            while at >= 0:
                doc = int(np.searchsorted(offsets, at, "right")) - 1
                if at + len(token) <= offsets[doc + 1]:
                    forced.append((at, at + len(token), i))
                    at = raw.find(token, at + len(token))
                else:
                    at = raw.find(token, at + 1)
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        byte_at = np.concatenate(([0], np.cumsum(width)))
        n = len(points)
        kind = _class_table()[points]
        edge = np.zeros(n + 1, bool)
        edge[np.searchsorted(byte_at, offsets)] = True
        for a, b, _ in forced:
            edge[np.searchsorted(byte_at, [a, b])] = True
        edge[[0, n]] = True
        run = edge[:n].copy()
        run[1:] |= kind[1:] != kind[:-1]
        begin = run.copy()
        space = kind == _SPACE
        # the last of a run of white space that a text goes on after stands apart; a blank there joins what follows
        last = np.zeros(n, bool)
        last[:-1] = space[:-1] & ~space[1:] & ~edge[1:n]
        begin |= last
        begin[1:] &= ~(last[:-1] & (points[:-1] == 32))
        # contractions
        quote = np.flatnonzero((points == 39) & begin & ~np.append(edge[1:n], True))
        if len(quote):
            padded = np.concatenate((points, np.zeros(3, np.uint32)))
            one, two = padded[quote + 1], padded[quote + 2]
            inside = ~edge[np.minimum(quote + 2, n)]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = inside & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
            for hit, size in ((short, 2), (long, 3)):
                q = quote[hit]
                begin[q + 1] = False
                if size == 3:
                    begin[q + 2] = False
                then = q + size
                then = then[then < n]
                # where the next is a blank it begins a token of its own rules; letters begin one here
                begin[then[kind[then] == _LETTER]] = True
        special = np.full(n, -1, np.int64)
        for a, b, i in forced:
            x, y = np.searchsorted(byte_at, [a, b])
            begin[x:y] = False
            begin[x] = True
            special[x] = i
        at = np.flatnonzero(begin)
        starts = byte_at[at]
        return starts, np.searchsorted(offsets, starts, "right") - 1, special[at]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's begin and the last end.

        Long texts are worked on in pieces that end where a pre-token does.
        """
        data, offsets = text_bytes(column)
        borders = np.unique(np.concatenate((offsets, self._borders(data, offsets))))
        ids, sizes, a = [], [], 0
        while a < len(borders) - 1:
            b = max(a + 1, int(np.searchsorted(borders, borders[a] + CHUNK_BYTES, "right")) - 1)
            some, at = self._encode(data[borders[a] : borders[b]], borders[a : b + 1] - borders[a])
            ids.append(some)
            sizes.append(np.diff(at))
            a = b
        total = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))) if sizes else np.zeros(1, np.int64)
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), total[np.searchsorted(borders, offsets)]

    def _borders(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Places in texts longer than a chunk before a blank between two ASCII letters, about a chunk apart."""
        out = []
        if any(b" " in token for token in self.vocabulary.special):
            return np.zeros(0, np.int64)
        for i in np.flatnonzero(np.diff(offsets) > CHUNK_BYTES).tolist():
            a, end = int(offsets[i]), int(offsets[i + 1])
            while end - a > CHUNK_BYTES:
                part = data[a : a + CHUNK_BYTES]
                letter = ((part | 32) >= 97) & ((part | 32) <= 122)
                good = np.flatnonzero((part[1:-1] == 32) & letter[:-2] & letter[2:])
                if not len(good):
                    break  # nowhere to cut: the rest stays whole
                a += int(good[-1]) + 1
                out.append(a)
        return np.array(out, np.int64)

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        starts, doc, special = self._cut(data, offsets)
        ends = np.append(starts[1:], len(data))
        which = numbered(data, starts, ends)
        # numbers grow where a pre-token is new
        one = np.flatnonzero(np.diff(np.maximum.accumulate(which), prepend=-1) > 0)
        names = hashed(data, starts[one], ends[one], self.seed) & ~U64(1)
        own = np.flatnonzero(special >= 0)
        if len(own):  # told apart from texts of the same bytes
            ids, first, of = np.unique(special[own], return_index=True, return_inverse=True)
            which[own] = len(one) + of
            one = np.concatenate((one, own[first]))
            names = np.concatenate((names, ids.astype(U64) * U64(2) + U64(1)))
        order = np.argsort(names, kind="stable")
        names = names[order]
        place = np.searchsorted(self.keys, names)
        known = self.keys[np.minimum(place, len(self.keys) - 1)] == names if len(self.keys) else np.zeros(len(names), bool)
        if len(self.keys) + int((~known).sum()) > REMEMBERED and len(self.keys):
            self._forget()
            place, known = np.zeros(len(names), np.int64), np.zeros(len(names), bool)
        if not known.all():
            new = one[order][~known]
            self._learn(names[~known], place[~known], data, starts[new], ends[new] - starts[new], special[new])
        row = np.empty(len(names), np.int64)
        row[order] = np.searchsorted(self.keys, names)
        row = row[which]
        size = self.size[row]
        ids = self.pool[np.repeat(self.where[row], size) + ragged(size)]
        total = np.concatenate(([0], np.cumsum(size)))
        return ids, total[np.searchsorted(doc, np.arange(len(offsets)))]

    def _learn(self, keys, place, data, starts, lengths, special) -> None:
        ids, counts = self.vocabulary.encode_words(data, starts, np.where(special < 0, lengths, 0))
        begins = np.cumsum(counts) - counts
        own = np.flatnonzero(special >= 0)
        if len(own):
            begins[own] = len(ids) + np.arange(len(own))
            counts[own] = 1
            ids = np.concatenate((ids, special[own]))
        need = self.filled + len(ids)
        if need > len(self.pool):
            self.pool = np.concatenate((self.pool[: self.filled], np.zeros(max(need, 2 * len(self.pool)) - self.filled, np.int32)))
        self.pool[self.filled : need] = ids
        self.keys = np.insert(self.keys, place, keys)
        self.where = np.insert(self.where, place, begins + self.filled)
        self.size = np.insert(self.size, place, counts)
        self.filled = need


def load_vocabulary(spark, path: str) -> Vocabulary:
    """Read a tokenizer file: the driver's own, or one in a store that Spark reads."""
    try:
        with open(path, encoding="utf-8") as f:
            return Vocabulary(f.read())
    except FileNotFoundError:
        return Vocabulary(spark.read.text(path, wholetext=True).first()[0])


def _encode_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for part in slices(batches, limit=CHUNK_BYTES):
            ids, at = encoder.encode(part.column("text"))
            ids = pa.array(ids, pa.int32())
            yield pa.record_batch({"doc_id": part.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(at, pa.int32()), ids)})

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): the token ids of each row's whole text, in one narrow pass.

    As the vocabulary's own library without added special tokens: the string of a special
    token in a text becomes its id. A null or empty text has no ids. Rows keep their
    doc_id, null or repeated; other columns are not read. Pre-tokens are told
    apart by their bytes and keyed hashes of them, see Encoder.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(load_vocabulary(spark, path))  # a fixed table of some MB
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_encode_rows(shared), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); bytes that are no UTF-8 become U+FFFD. Null ids give a null text."""
    spark = tokens.sparkSession
    shared = spark.sparkContext.broadcast(load_vocabulary(spark, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("ids")
            texts = []
            for x in column:
                texts.append(None if not x.is_valid else shared.value.decode(np.asarray(x.values, np.int64))[0].tobytes().decode("utf-8", "replace"))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoded and decoded again in one pass."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(load_vocabulary(spark, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        encoder = Encoder(vocabulary)
        for part in slices(batches, limit=CHUNK_BYTES):
            ids, at = encoder.encode(part.column("text"))
            sums, texts = [hashlib.sha256() for _ in range(part.num_rows)], [hashlib.sha256() for _ in range(part.num_rows)]
            a = 0
            while a < part.num_rows:
                b = max(a + 1, int(np.searchsorted(at, at[a] + DECODED, "right")) - 1)  # texts decoded at once
                first, last = int(at[a]), int(at[b])
                utf8 = codecs.getincrementaldecoder("utf-8")("replace")
                for low in range(first, max(last, first + 1), DECODED):  # more than one piece only of one long text
                    high = min(last, low + DECODED)
                    text, ends = vocabulary.decode(ids[low:high])
                    raw, text = memoryview(ids[low:high].astype("<u4").tobytes()), memoryview(text.tobytes())
                    for i in range(a, b):
                        x, y = max(0, int(at[i]) - low), min(high, int(at[i + 1])) - low
                        sums[i].update(raw[4 * x : 4 * y])
                        texts[i].update(utf8.decode(text[ends[x] : ends[y]], high == last).encode())
                a = b
            sums, texts = [x.hexdigest() for x in sums], [x.hexdigest() for x in texts]
            yield pa.record_batch({"doc_id": part.column("doc_id"), "n_tokens": pa.array(np.diff(at), pa.int64()), "ids_sha256": pa.array(sums, pa.string()), "decoded_sha256": pa.array(texts, pa.string())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
