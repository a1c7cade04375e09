"""Substring dedup by sliding sentence spans.

A text is cut into sentences, and these behind the word of least hash of every ``WINDOW`` words inside them,
so cuts depend on the words around them only and no piece has more than ``WINDOW`` words.
A passage of over 50 words is cut alike wherever it stands, but for the up to ``WINDOW`` words at each end
that a sentence around it shares with it: at least 28 words are left, more than two pieces, so a run.
Scripts without spaces have a word per character. Pieces are called sentences below. Every run of ``RUN`` consecutive sentences is
hashed and joined over the whole corpus. The first occurrence of a run, by doc_id
and place, stays; the sentences of all others are covered. Covered sentences
that follow each other form a span, and spans of ``LEAST`` words or more are removed; shorter ones are
chance meetings of short sentences, or headings, and stay.

A text is split once; where its sentences end is kept beside the hashes. Occurrences are counted before they are
joined, so only runs that repeat travel a second time; the list of a document's covered runs is bounded by the document.

Cases: null text counts as empty and stays null; a null doc_id comes last in
order; rows that repeat doc_id and text are one document, and each gets its
result; texts with fewer than ``RUN`` sentences stay whole; empty tables give
empty results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockweave.llm.batches import slices
from stockweave.llm.common import join_same, text_key
from stockweave.session import cut_lineage

RUN = 3
WINDOW = 12
LEAST = 25
SLICE_CHARS = 2_000_000
#: A sentence with the white space after it: up to an end mark that white space follows, a full-width end mark, or a line end.
SENTENCE = re.compile(r"[^\n.!?…。！？]*+(?:[.!?…]++(?![\s\"'”’)\]。！？])[^\n.!?…。！？]*+)*+(?:[.!?…。！？]++[\"'”’)\]」』）]*+)?\s*+")
#: Characters of scripts that put no space between words: Thai, Lao, Burmese, Khmer, Japanese and Chinese.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD = re.compile(rf"\s*+(?:[{UNSPACED}]|[^\s{UNSPACED}]++)")


@lru_cache(maxsize=1 << 16)
def _word_hash(word: str) -> int:
    from xxhash import xxh32_intdigest

    return xxh32_intdigest(word.strip().lower().encode("utf-8", "surrogatepass"))


def _least(words: list[str], sentence: np.ndarray, window: int) -> np.ndarray:
    """Places of the words of least hash, the last of equal ones, in every window inside a sentence."""
    low = np.uint64(0xFFFFFFFF)
    key = np.fromiter(map(_word_hash, words), np.uint64, len(words)) << np.uint64(32)
    key |= low - np.arange(len(words), dtype=np.uint64)
    least, width = key, 1
    while width < window:
        step = min(width, window - width)
        least, width = np.minimum(least[:-step], least[step:]), width + step
    inside = sentence[: len(least)] == sentence[window - 1 :]
    return np.unique(low - (least[inside] & low)).astype(np.int64)


def sentences(text: str, window: int = WINDOW) -> list[str]:
    """The pieces of a text in order; joined they give the text again."""
    pieces = [p for p in SENTENCE.findall(text) if p]
    words, owner, cuts = [], [], {}
    for i, piece in enumerate(pieces):
        if len(piece) >= window and len(found := WORD.findall(piece)) >= window:
            words += found
            owner += [i] * len(found)
    if not words:
        return pieces
    sentence = np.array(owner)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    first = np.searchsorted(sentence, sentence)
    ends -= np.where(first > 0, ends[first - 1], 0)
    for at in _least(words, sentence, window).tolist():
        if at + 1 < len(words) and owner[at + 1] == owner[at]:
            cuts.setdefault(owner[at], []).append(int(ends[at]))
    out = []
    for i, piece in enumerate(pieces):
        start = 0
        for end in cuts.get(i, ()):
            out.append(piece[start:end])
            start = end
        out.append(piece[start:])
    return out


def n_words(text: str) -> int:
    return len(WORD.findall(text))


def _normal(sentence: str) -> bytes:
    return " ".join(sentence.lower().split()).encode("utf-8", "surrogatepass")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _lists(rows: list[np.ndarray], kind: type) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*rows, np.zeros(0, kind)])))


def runs(docs: DataFrame, run: int = RUN) -> DataFrame:
    """(doc_id, text_key, runs, ends): the hash of each run of ``run`` sentences, and where each sentence ends."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            for part in slices(batch, "text", SLICE_CHARS):
                lists, ends = [], []
                for text in part.column("text").to_pylist():
                    pieces = sentences(text or "")
                    ends.append(np.cumsum([len(s) for s in pieces], dtype=np.int32))
                    h = np.array([xxh3_64_intdigest(_normal(s)) for s in pieces], np.uint64)
                    n = max(0, len(h) - run + 1)
                    total = np.zeros(n, np.uint64)
                    for i in range(run):
                        total = _mix(total + h[i : i + n])
                    lists.append(total.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), _lists(lists, np.int64), _lists(ends, np.int32)],
                    names=["doc_id", "text_key", "runs", "ends"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text").mapInArrow(
        hashed, f"doc_id {kind}, text_key long, runs array<long>, ends array<int>"
    )


def covered_runs(listed: DataFrame) -> DataFrame:
    """(doc_id, text_key, starts) from the table of ``runs``: where runs begin that occurred before, here or elsewhere."""
    every = listed.select("doc_id", "text_key", F.posexplode("runs").alias("at", "run"))
    counted = every.groupBy("run").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    repeated = cut_lineage(counted)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", "at")
    again = cut_lineage(every.join(repeated, "run"))
    first = cut_lineage(again.groupBy("run").agg(F.min(place).alias("first")))
    return (
        again.join(first, "run")
        .where(place != F.col("first"))
        .groupBy("doc_id", "text_key")
        .agg(F.sort_array(F.collect_set("at")).alias("starts"))
    )


def removed_sentences(pieces: list[str], starts: list[int], run: int, least: int) -> list[bool]:
    """Which sentences go: those of covered spans with ``least`` words or more."""
    cover = np.zeros(len(pieces) + 1, np.int64)
    for at in starts:
        cover[at] += 1
        cover[min(at + run, len(pieces))] -= 1
    inside = np.cumsum(cover[:-1]) > 0
    gone = [False] * len(pieces)
    i = 0
    while i < len(pieces):
        j = i
        while j < len(pieces) and inside[j] == inside[i]:
            j += 1
        if inside[i] and sum(map(n_words, pieces[i:j])) >= least:
            gone[i:j] = [True] * (j - i)
        i = j
    return gone


def deduplicate(docs: DataFrame, run: int = RUN, least: int = LEAST) -> DataFrame:
    """(doc_id, text, n_sentences, n_removed, removed_words): each document without its repeated spans."""
    key = ["doc_id", "text_key"]
    listed = cut_lineage(runs(docs, run))
    starts = cut_lineage(covered_runs(listed))
    found = join_same(listed.drop("runs").dropDuplicates(key), starts, key, "left").select(
        *key, F.size("ends").cast("long").alias("n_sentences"), "starts", F.when(F.col("starts").isNotNull(), F.col("ends")).alias("ends")
    )
    text = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_CHARS):
                rows = []
                for text, starts, ends in zip(*(part.column(c).to_pylist() for c in ("text", "starts", "ends"))):
                    if not starts:
                        rows.append((text, 0, 0))
                        continue
                    pieces = [text[a:b] for a, b in zip([0, *ends], ends)]
                    gone = removed_sentences(pieces, starts, run, least)
                    left = "".join(p for p, g in zip(pieces, gone) if not g).rstrip() if any(gone) else text
                    rows.append((left, sum(gone), sum(n_words(p) for p, g in zip(pieces, gone) if g)))
                left, removed, words = zip(*rows) if rows else ([], [], [])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(left, pa.string()),
                        part.column("n_sentences"),
                        pa.array(removed, pa.int64()),
                        pa.array(words, pa.int64()),
                    ],
                    names=["doc_id", "text", "n_sentences", "n_removed", "removed_words"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return join_same(text, found, key).select("doc_id", "text", "n_sentences", "starts", "ends").mapInArrow(
        cut, f"doc_id {kind}, text string, n_sentences long, n_removed long, removed_words long"
    )
