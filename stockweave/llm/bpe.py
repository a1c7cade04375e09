"""Byte-level BPE encoding and decoding with length-bucketed numpy matrices.

Texts are split by the vocabulary's pattern. Pieces of like length stand as rows
of one padded matrix of token ids. In each round every row merges its leftmost
pair of minimum rank: a hash table of pairs gives the rank, the merged row is
compacted, and rows without a pair leave the matrix. A piece above ``LONG`` bytes
merges the same pairs in the same order with a heap, as shifting a long row for each merge
would take quadratic time.

Rank files and pattern are parameters. The tables built from them are bounded by
the vocabulary and sent to the tasks once.

Cases: null text counts as empty and gives no ids; ids and texts of any length
are taken whole; rows that repeat stay; empty tables give empty results; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockweave.llm.batches import slices

NONE = np.int32(2**31 - 1)
LONG = 512
CACHED_PIECES = 200_000
BUCKETS = (*range(1, 17), 20, 24, 32, 48, 64, 96, 128, 192, 256, 384, LONG)
#: Characters that are split into pieces at a time; bounds the memory of a task beside the batch itself.
SLICE_CHARS = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Lines of base64 token and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PairTable:
    """Hash table from (left id, right id) to the id of the merged token; open addressing, looked up for arrays."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        found = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    found[left << 32 | right] = rank
        self.bits = max(4, int(len(found) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        keys = np.fromiter(found.keys(), np.int64, len(found))
        values = np.fromiter(found.values(), np.int32, len(found))
        slots = self._slot(keys)
        while keys.size:
            free = self.keys[slots] == -1
            self.keys[slots[free]] = keys[free]  # of several rows for one slot the last stays, the others go on
            settled = self.keys[slots] == keys
            self.values[slots[settled]] = values[settled]
            keys, values, slots = keys[~settled], values[~settled], (slots[~settled] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    @cached_property
    def as_dict(self) -> dict[int, int]:
        """The same table for single look-ups, made when the first long piece comes."""
        used = self.keys >= 0
        return dict(zip(self.keys[used].tolist(), self.values[used].tolist()))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it has none or a side is padding (-1)."""
        out = np.full(left.shape, NONE, np.int32)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left.ravel()[at].astype(np.int64) << 32 | right.ravel()[at]
        slots, flat = self._slot(keys), out.ravel()
        while at.size:
            here = self.keys[slots]
            hit = here == keys
            flat[at[hit]] = self.values[slots[hit]]
            on = ~hit & (here != -1)
            at, keys, slots = at[on], keys[on], (slots[on] + 1) & ((1 << self.bits) - 1)
        return flat.reshape(left.shape)


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.pairs = PairTable(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as the bytes of an int32 array."""
        out: list[bytes] = [b""] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        low = 0
        for high in BUCKETS:
            at = np.flatnonzero((sizes > low) & (sizes <= high))
            low = high
            if at.size:
                self._merge_rows([pieces[i] for i in at], sizes[at], high, at, out)
        for i in np.flatnonzero(sizes > LONG):
            out[i] = self._merge_long(pieces[i])
        return out

    def _merge_rows(self, rows: list[bytes], sizes: np.ndarray, width: int, at: np.ndarray, out: list[bytes]) -> None:
        padded = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(len(rows), width)
        ids = np.where(np.arange(width) < sizes[:, None], self.byte_ids[padded], np.int32(-1))
        sizes = sizes.copy()
        ranks = self.pairs.ranks(ids[:, :-1], ids[:, 1:])
        while True:
            n, width = ids.shape
            every = np.arange(n)
            best = ranks.argmin(axis=1) if width > 1 else np.zeros(n, np.int64)  # the leftmost of equal ranks
            least = ranks[every, best] if width > 1 else np.full(n, NONE)
            done = least == NONE
            if done.any():
                for i, size, row in zip(at[done].tolist(), sizes[done].tolist(), ids[done]):
                    out[i] = row[:size].tobytes()
                on = ~done
                ids, ranks, sizes, at, best, least = ids[on], ranks[on], sizes[on], at[on], best[on], least[on]
                n = len(at)
                if not n:
                    return
                every = every[:n]
            # Each row merges one pair, so each loses one id and one rank.
            ids[every, best] = least
            stay = np.ones((n, width), bool)
            stay[every, best + 1] = False
            ids = ids[stay].reshape(n, width - 1)
            stay = stay[:, : width - 1]
            stay[:] = True
            stay[every, best] = False
            ranks = ranks[stay].reshape(n, width - 2)
            sizes -= 1
            left, right = np.flatnonzero(best > 0), np.flatnonzero(best < width - 2)
            row, first = np.concatenate([left, right]), np.concatenate([best[left] - 1, best[right]])
            ranks[row, first] = self.pairs.ranks(ids[row, first], ids[row, first + 1])

    def _merge_long(self, piece: bytes) -> bytes:
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        ahead, behind = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.pairs.ranks(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32))
        heap = [(int(r), i) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        rank_at = first.tolist()

        rank_at.append(none := int(NONE))
        pair_rank = self.pairs.as_dict.get

        def fresh(i: int) -> None:
            j = ahead[i]
            rank = rank_at[i] = pair_rank(ids[i] << 32 | ids[j], none) if j < n else none
            if rank != none:
                heapq.heappush(heap, (rank, i))

        while heap:
            rank, i = heapq.heappop(heap)
            if ids[i] < 0 or rank_at[i] != rank:
                continue
            j = ahead[i]
            ids[i], ids[j] = rank, -1
            ahead[i] = ahead[j]
            if ahead[i] < n:
                behind[ahead[i]] = i
            fresh(i)
            if behind[i] >= 0:
                fresh(behind[i])
        return np.array([x for x in ids if x >= 0], np.int32).tobytes()

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens, one after another."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if ids.size else 0
        return self.data[np.repeat(self.starts[ids] - ends + lengths, lengths) + np.arange(total)]


def _encoded(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, pattern: str) -> Iterator[pa.RecordBatch]:
    """Batches (doc_id, ids) of batches (doc_id, text), of about ``SLICE_CHARS`` each."""
    import regex

    split = regex.compile(pattern).findall
    known: dict[str, bytes] = {}

    def ids_of(texts: list[str]) -> list[bytes]:
        pieces = [split(t) for t in texts]
        if len(known) > CACHED_PIECES:
            known.clear()
        new = list(set().union(*pieces).difference(known))
        known.update(zip(new, vocabulary.encode([p.encode() for p in new])))
        return [b"".join(map(known.__getitem__, found)) for found in pieces]

    for batch in batches:
        for part in slices(batch, "text", SLICE_CHARS):
            got = ids_of([t or "" for t in part.column("text").to_pylist()])
            offsets = np.concatenate([[0], np.cumsum([len(g) // 4 for g in got])]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(got), np.int32))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["doc_id", "ids"]
            )


def _decoded(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    """Batches (doc_id, ids, data) of batches (doc_id, ids)."""
    for batch in batches:
        for part in slices(batch, "ids", SLICE_CHARS):
            column = part.column("ids")
            ids = column.flatten().to_numpy(zero_copy_only=False)
            data = vocabulary.decode(ids)
            counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            sums = np.concatenate([[0], np.cumsum(vocabulary.lengths[ids])])
            ends = sums[np.concatenate([[0], np.cumsum(counts)])]
            made = pa.Array.from_buffers(
                pa.binary(), len(part), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())]
            )
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), column, made], names=["doc_id", "ids", "data"])


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the token ids of each text, without special tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    id_type = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _encoded(batches, Vocabulary(shared.value), pattern)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, ids, data): the bytes that the ids stand for."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    id_type = encoded.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _decoded(batches, Vocabulary(shared.value))

    return encoded.select("doc_id", "ids").mapInArrow(
        run, f"doc_id {id_type.simpleString()}, ids array<int>, data binary"
    )


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, data): what ``decode`` makes of ``encode``, with both steps in one Python worker a task.

    Chained, the two would run in two workers a task at once, each with its own vocabulary, and the ids of whole
    Arrow batches would go through the executor in between.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    id_type = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shared.value)
        return _decoded(_encoded(batches, vocabulary, pattern), vocabulary)

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {id_type.simpleString()}, ids array<int>, data binary"
    )


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 (of the decoded bytes)."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return round_trip(docs, ranks_path, pattern).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2(F.col("data"), 256).alias("decoded_sha256"),
    )
