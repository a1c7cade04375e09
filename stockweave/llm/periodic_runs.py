"""Periodic runs in word sequences, by recompression.

A run is a stretch of words with smallest period q and at least max(``LEAST``, 2 q) words that no neighbouring word
extends with that period.

Grammar. The words of a slice of documents stand in one sequence, with a mark of its own between two documents.
Rounds of block compression (equal neighbours become one symbol with an exponent) and pair compression (a random half of
the symbols may stand left, the others right, and every left-right pair becomes a symbol) go on until no symbol repeats.
Symbols get equal names only if they are equal, so comparisons are exact. The longest common extension of two places
climbs through the rounds while the symbols agree, and comes down again where they differ: a step per round, for
all candidates at once. Extensions to the left use the mirrored rounds.

Candidates. For a period q the places i on a grid of step max(q, LEAST - q) are paired with i + q; every run holds such
a pair. Pairs whose words, or four neighbouring words to one side, differ are no part of a run and go at once. The
others are extended to both sides. Multiples of a period give the same stretch again, and the smallest period stays.
No suffix array or table of all pairs is made; grids shrink as the period grows, n log n in all.

Cases: null text counts as empty; a document without runs has an empty list; a null ``tail`` changes nothing; rows that
repeat a doc_id are documents of their own; empty tables give empty results; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.llm.batches import slices
from stockweave.llm.common import SPACE

LEAST = 12
SLICE_BYTES = 8_000_000
#: Candidates that are extended at a time.
CHUNK = 1 << 19


@dataclass(frozen=True)
class Round:
    """A sequence and how the next one groups it: ``first`` has the start of each group, and the end of the last."""

    symbols: np.ndarray
    group: np.ndarray
    first: np.ndarray
    blocks: bool


def _name(left: np.ndarray, right: np.ndarray, used: int) -> tuple[np.ndarray, int]:
    """Equal numbers, from ``used`` on, for equal pairs."""
    pairs, names = np.unique(left * (right.max() + 1) + right, return_inverse=True)
    return used + names, used + len(pairs)


def _half(symbols: np.ndarray, turn: int) -> np.ndarray:
    """A random half of the symbols, another in each turn."""
    x = symbols.astype(np.uint64) + np.uint64(turn * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) & np.uint64(1) == 1


def _grouped(symbols: np.ndarray, starts: np.ndarray, blocks: bool) -> Round:
    first = np.append(starts, len(symbols))
    return Round(symbols, np.repeat(np.arange(len(starts)), np.diff(first)), first, blocks)


def recompress(words: np.ndarray) -> list[Round]:
    """The rounds of a sequence of numbers from 0; in the last one all symbols differ and stand alone."""
    symbols, used, turn, rounds = words.astype(np.int64), int(words.max()) + 1, 0, []
    while len(np.unique(symbols)) < len(symbols):
        starts = np.append(0, np.flatnonzero(symbols[1:] != symbols[:-1]) + 1)
        if len(starts) < len(symbols):
            rounds.append(_grouped(symbols, starts, True))
            times = np.diff(rounds[-1].first)
            symbols = symbols[starts]
            more = np.flatnonzero(times > 1)
            symbols[more], used = _name(symbols[more], times[more], used)
        half = _half(symbols, turn)
        turn += 1
        pairs = [np.flatnonzero(a[:-1] & b[1:]) for a, b in ((half, ~half), (~half, half))]
        at = max(pairs, key=len)
        if len(at):
            inner = np.ones(len(symbols), bool)
            inner[at + 1] = False
            starts = np.flatnonzero(inner)
            rounds.append(_grouped(symbols, starts, False))
            names, used = _name(symbols[at], symbols[at + 1], used)
            symbols = symbols.copy()
            symbols[at] = names
            symbols = symbols[starts]
    rounds.append(_grouped(symbols, np.arange(len(symbols)), False))
    return rounds


def mirrored(rounds: list[Round]) -> list[Round]:
    """The rounds of the sequence read backwards."""
    return [
        Round(
            r.symbols[::-1],
            len(r.first) - 2 - r.group[::-1],
            len(r.symbols) - r.first[::-1],
            r.blocks,
        )
        for r in rounds
    ]


def common_extension(rounds: list[Round], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words from the places ``a`` and ``b`` on are equal; a and b differ, and no extension ends the sequence."""
    at_a, at_b = a.astype(np.int64), b.astype(np.int64)
    live, stopped = np.arange(len(a)), []
    for r in rounds:
        x, y = at_a[live], at_b[live]
        gx, gy = r.group[x], r.group[y]
        same = r.symbols[x] == r.symbols[y]
        inside = (r.first[gx] != x) | (r.first[gy] != y)
        left_x, left_y = r.first[gx + 1] - x, r.first[gy + 1] - y
        step = np.where(same & inside, np.minimum(left_x, left_y), 0)
        x, y = x + step, y + step
        climbs = same & (~inside | (left_x == left_y))
        at_a[live], at_b[live] = x, y
        stopped.append(live[~climbs])
        live = live[climbs]
        at_a[live], at_b[live] = r.group[x[climbs]], r.group[y[climbs]]
    down = np.zeros(0, np.int64)
    for r, here in zip(reversed(rounds), reversed(stopped)):
        if len(down):
            gx, gy = at_a[down], at_b[down]
            x, y = r.first[gx], r.first[gy]
            most = np.minimum(r.first[gx + 1] - x, r.first[gy + 1] - y) if r.blocks else 1
            step = np.where(r.symbols[x] == r.symbols[y], most, 0)
            at_a[down], at_b[down] = x + step, y + step
        down = np.concatenate([down, here])
    return at_a - a


@dataclass(frozen=True)
class Layout:
    """Documents by falling length in one sequence, marks around them, and a margin at both ends."""

    words: np.ndarray
    #: Number, place of the first word and length of each document.
    docs: np.ndarray
    places: np.ndarray
    lengths: np.ndarray
    margin: int

    def owner(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.places, places, side="right") - 1


def _layout(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, docs: np.ndarray, margin: int) -> Layout:
    docs = docs[np.argsort(-lengths[docs], kind="stable")]
    size = lengths[docs]
    places = margin + 1 + np.cumsum(size + 1) - (size + 1)
    total = margin + 1 + int((size + 1).sum()) + margin
    words = -np.arange(1, total + 1, dtype=np.int64)
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    words[np.repeat(places, size) + inside] = codes[np.repeat(starts[docs], size) + inside]
    return Layout(words, docs, places, size, margin)


def _candidates(layout: Layout, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i and periods q, by rising period, where i and i + q and the words beside them fit to a run."""
    if not len(layout.docs):
        return
    words, low, margin = layout.words, layout.margin, layout.margin
    ends = layout.places + layout.lengths

    def fitting(i: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        right = left = np.ones(len(i), bool)
        for t in range(1, margin + 1):
            right = right & (words[i + t] == words[i + q + t])
            left = left & (words[i - t] == words[i + q - t])
        fits = right | left
        return i[fits], q[fits]

    held, periods, n = [], [], 0
    rising = -layout.lengths
    for q in range(1, int(layout.lengths[0]) // 2 + 1):
        docs = int(np.searchsorted(rising, -max(least, 2 * q), side="right"))
        if not docs:
            break
        high, step = int(ends[docs - 1]), max(q, least - q)
        at = np.flatnonzero(words[low : high - q : step] == words[low + q : high : step])
        if len(at):
            held.append(low + step * at)
            periods.append(np.full(len(at), q))
            n += len(at)
        if n >= CHUNK:
            yield fitting(np.concatenate(held), np.concatenate(periods))
            held, periods, n = [], [], 0
    if n:
        yield fitting(np.concatenate(held), np.concatenate(periods))


def find_runs(codes: np.ndarray, lengths: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (document, start, length, period) of all runs, by document, start and period.

    ``codes`` has the words of the documents one after another as numbers from 0, ``lengths`` how many each has.
    """
    starts, margin = np.cumsum(lengths) - lengths, (least + 1) // 4
    long = np.flatnonzero(lengths >= least)
    if not len(long):
        return np.zeros((0, 4), np.int64)
    layout = _layout(codes, starts, lengths, long, margin)
    owners = [np.unique(layout.owner(i)) for i, _ in _candidates(layout, least)]
    some = layout.docs[np.unique(np.concatenate(owners))] if owners else long[:0]
    if not len(some):
        return np.zeros((0, 4), np.int64)
    layout = _layout(codes, starts, lengths, some, margin)
    rounds = recompress(layout.words - layout.words.min())
    back, total = mirrored(rounds), len(layout.words)
    found = np.zeros((0, 3), np.int64)
    for i, q in _candidates(layout, least):
        right = common_extension(rounds, i, i + q)
        left = common_extension(back, total - i, total - i - q)
        length = left + right + q
        runs = (right > 0) & (length >= np.maximum(least, 2 * q))
        rows = np.column_stack([(i - left)[runs], length[runs], q[runs]])
        found = np.concatenate([found, rows])
        # Periods rise, so the first of equal stretches has the smallest.
        _, first = np.unique(found[:, 0] * (total + 1) + found[:, 1], return_index=True)
        found = found[np.sort(first)]
    owner = layout.owner(found[:, 0])
    rows = np.column_stack([layout.docs[owner], found[:, 0] - layout.places[owner], found[:, 1], found[:, 2]])
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _with_tail(starts: np.ndarray, lengths: np.ndarray, tails: list[int | None]) -> np.ndarray:
    """Which original word stands at each place, after the periodic tails that the contract asks for."""
    source = np.arange(int(lengths.sum()))
    for start, n, h in zip(starts.tolist(), lengths.tolist(), tails):
        if n and h is not None and h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            source[start + a : start + n] = start + a + np.arange(n - a) % p
    return source


def _collapsed(runs: np.ndarray, starts: np.ndarray, total: int) -> np.ndarray:
    """Which words stay: all but those behind the first period of a run that holds them."""
    change = np.zeros(total + 1, np.int64)
    begin = starts[runs[:, 0]] + runs[:, 1]
    np.add.at(change, begin + runs[:, 3], 1)
    np.add.at(change, begin + runs[:, 2], -1)
    return np.cumsum(change[:-1]) == 0


RUNS = "array<struct<start: long, length: long, period: long>>"


def detect(docs: DataFrame, tail: Column | None = None, least: int = LEAST) -> DataFrame:
    """(doc_id, n, runs, collapsed): the number of words, the runs by start, and the words that stay, joined by a space.

    ``tail`` gives each document the number that says whether and how its end is made periodic before the search.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                pieces = pc.split_pattern_regex(part.column("text"), SPACE)
                flat = pieces.flatten()
                filled = pc.not_equal(flat, "")
                before = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])
                bounds = np.concatenate([[0], np.cumsum(pieces.value_lengths().to_numpy())])
                starts, lengths = before[bounds[:-1]], np.diff(before[bounds])
                source = _with_tail(starts, lengths, part.column("tail").to_pylist())
                words = flat.filter(filled)
                codes = words.dictionary_encode().indices.to_numpy()[source]
                runs = find_runs(codes, lengths, least)
                stays = _collapsed(runs, starts, len(codes))
                kept = np.concatenate([[0], np.cumsum(stays)])[np.append(starts, len(codes))]
                lists = pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), words.take(pa.array(source[stays])))
                offsets = np.searchsorted(runs[:, 0], np.arange(len(part) + 1)).astype(np.int32)
                rows = pa.StructArray.from_arrays(
                    [pa.array(runs[:, c]) for c in (1, 2, 3)], names=["start", "length", "period"]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(lengths, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets), rows),
                        pc.binary_join(lists, " "),
                    ],
                    names=["doc_id", "n", "runs", "collapsed"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    tail = F.lit(None) if tail is None else tail
    return docs.select("doc_id", tail.cast("long").alias("tail"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n long, runs {RUNS}, collapsed string"
    )


def digests(detected: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of found runs."""
    best = F.array_max(
        F.transform(
            "runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))
        )
    )
    line = F.transform(
        "runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    )
    return detected.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-best["start"]).alias("start"),
        best["length"].alias("length"),
        (-best["period"]).alias("period"),
        F.floor(best["length"] * 1000 / -best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
