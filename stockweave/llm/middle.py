"""Fill-in-middle over seekable compressed frames.

A text is cut into units, words with the white space before them. Packing stores it as zstandard frames of
``FRAME_CHARS`` characters, each of which can be decompressed alone, with the number of units that end up to and with
the frame. The frames are written as a table. To cut behind the k-th unit, the counts name the one frame to decompress;
nothing else of the text is read for it. The transformed text is again a list of frames, in which whole frames of the
text are taken over as they are, and digests stream through it frame by frame. Restoring reads only the transformed
frames and the form: it finds the marks and streams prefix, middle and suffix in their old order.

The draws come from a digest of seed and doc_id, so they depend on no order and no task.

Cases: null text counts as empty; texts that are empty or hold a mark stay plain; a null doc_id draws as an empty
name; rows that repeat a doc_id draw alike, each for its own text; a unit may be longer than a frame; empty tables give
empty results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockweave.llm.batches import slices
from stockweave.session import cut_lineage

FRAME_CHARS = 1 << 14
SLICE_BYTES = 4_000_000
#: Marks and shares of the contract. Fixed values.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
MIDDLE_SHARE = 50
SPM_SHARE = 80

STORED = pa.list_(pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("data", pa.binary())]))
OUTPUT = pa.list_(pa.struct([("chars", pa.int64()), ("data", pa.binary())]))


def _ends(text: str, last: bool) -> np.ndarray:
    """Places behind the units that end in ``text``; at its own end only if ``last``.

    A word ends before white space; white space that no word follows is a unit of its own, at the end of all.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = (codes == 0x20) | ((codes >= 0x09) & (codes <= 0x0D))
    found = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.append(found, len(codes)) if last and len(codes) else found


def pack_text(text: str, frame_chars: int, compressor: zstandard.ZstdCompressor) -> list[dict]:
    """The frames of a text, with the units that end up to and with each."""
    if not text:
        return []
    ends = _ends(text, True)
    stops = np.append(np.arange(frame_chars, len(text), frame_chars), len(text))
    counts = np.searchsorted(ends, stops, side="right").tolist()
    frames, start = [], 0
    for stop, units in zip(stops.tolist(), counts):
        data = compressor.compress(text[start:stop].encode())
        frames.append({"units": units, "chars": stop - start, "data": data})
        start = stop
    return frames


def pack(docs: DataFrame, seed: int = SEED, frame_chars: int = FRAME_CHARS) -> DataFrame:
    """(doc_id, h1, h2, h3, h4, marked, frames): the stored form of each text and its draws."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                frames = [pack_text(t, frame_chars, compressor) for t in part.column("text").to_pylist()]
                names = ["doc_id", "h1", "h2", "h3", "h4", "marked"]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), pa.array(frames, STORED)], names=[*names, "frames"]
                )

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    text = F.coalesce("text", F.lit(""))
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", *draws, marked.alias("marked"), text.alias("text")).mapInArrow(
        run, f"doc_id {kind}, h1 long, h2 long, h3 long, h4 long, marked boolean, frames array<struct<units: long, chars: long, data: binary>>"
    )


class Frames:
    """A text as frames; pieces of it are read through the frames that hold them."""

    def __init__(self, frames: list[dict], decompressor: zstandard.ZstdDecompressor) -> None:
        self.frames, self.decompressor = frames, decompressor
        self.stops = np.cumsum([f["chars"] for f in frames], dtype=np.int64)

    def __len__(self) -> int:
        return int(self.stops[-1]) if self.frames else 0

    @property
    def n_units(self) -> int:
        return self.frames[-1]["units"] if self.frames else 0

    def text(self, number: int) -> str:
        return self.decompressor.decompress(self.frames[number]["data"]).decode()

    def behind(self, unit: int) -> int:
        """The number of characters up to the end of the unit; one frame is decompressed."""
        if unit == 0:
            return 0
        number = bisect_left(self.frames, unit, key=lambda f: f["units"])
        before = self.frames[number - 1]["units"] if number else 0
        # Only the frame after it tells whether a word ends with the frame; if no end inside is the one, it does.
        inside = _ends(self.text(number), False)
        start = int(self.stops[number - 1]) if number else 0
        place = unit - before - 1
        return start + int(inside[place]) if place < len(inside) else int(self.stops[number])

    def piece(self, start: int, stop: int, compressor: zstandard.ZstdCompressor) -> Iterator[dict]:
        """The frames of a part of the text; whole frames are taken over, cut ones compressed anew."""
        if start >= stop:
            return
        for number in range(int(np.searchsorted(self.stops, start, side="right")), len(self.frames)):
            low = int(self.stops[number - 1]) if number else 0
            if low >= stop:
                return
            a, b = max(start - low, 0), min(stop - low, self.frames[number]["chars"])
            if b - a == self.frames[number]["chars"]:
                yield self.frames[number]
            else:
                yield {"chars": b - a, "data": compressor.compress(self.text(number)[a:b].encode())}

    def stream(self, start: int, stop: int) -> Iterator[str]:
        """A part of the text, a frame at a time."""
        if start >= stop:
            return
        for number in range(int(np.searchsorted(self.stops, start, side="right")), len(self.frames)):
            low = int(self.stops[number - 1]) if number else 0
            if low >= stop:
                return
            yield self.text(number)[max(start - low, 0) : stop - low]

    def find(self, mark: str, start: int) -> int:
        """Where ``mark`` first stands at or after ``start``, also across frames."""
        held, place = "", start
        for text in self.stream(start, len(self)):
            held += text
            at = held.find(mark)
            if at >= 0:
                return place + at
            keep = min(len(held), len(mark) - 1)
            place += len(held) - keep
            held = held[len(held) - keep :]
        raise ValueError(f"no {mark} in the text")

    def digest(self) -> str:
        found = hashlib.sha256()
        for number in range(len(self.frames)):
            found.update(self.decompressor.decompress(self.frames[number]["data"]))
        return found.hexdigest()


def _form(frames: Frames, row: dict) -> str:
    if not len(frames) or row["marked"] or row["h3"] % 100 >= MIDDLE_SHARE:
        return "plain"
    return "spm" if row["h4"] % 100 < SPM_SHARE else "psm"


def transform(packed: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): the transformed texts as frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor, decompressor = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        marks = {m: {"chars": len(m), "data": compressor.compress(m.encode())} for m in (PREFIX, SUFFIX, MIDDLE)}
        for batch in batches:
            found = {"n": [], "form": [], "prefix_chars": [], "middle_chars": [], "output": []}
            for row in batch.select(["h1", "h2", "h3", "h4", "marked", "frames"]).to_pylist():
                text = Frames(row["frames"], decompressor)
                form, n = _form(text, row), text.n_units
                first = second = None
                if form == "plain":
                    output = row["frames"]
                else:
                    low, high = sorted((row["h1"] % (n + 1), row["h2"] % (n + 1)))
                    first, second = text.behind(low), text.behind(high)
                    prefix = list(text.piece(0, first, compressor))
                    middle = list(text.piece(first, second, compressor))
                    suffix = list(text.piece(second, len(text), compressor))
                    if form == "psm":
                        output = [marks[PREFIX], *prefix, marks[SUFFIX], *suffix, marks[MIDDLE], *middle]
                    else:
                        output = [marks[SUFFIX], *suffix, marks[PREFIX], *prefix, marks[MIDDLE], *middle]
                values = (n, form, first, None if first is None else second - first, output)
                for column, value in zip(found.values(), values):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(found["n"], pa.int64()),
                    pa.array(found["form"], pa.string()),
                    pa.array(found["prefix_chars"], pa.int64()),
                    pa.array(found["middle_chars"], pa.int64()),
                    pa.array(found["output"], OUTPUT),
                ],
                names=["doc_id", *found],
            )

    kind = packed.schema["doc_id"].dataType.simpleString()
    return packed.mapInArrow(
        run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output array<struct<chars: long, data: binary>>"
    )


def restored(output: Frames, form: str) -> Iterator[str]:
    """The text that a transformed text was made from, a frame at a time."""
    if form == "plain":
        yield from output.stream(0, len(output))
        return
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one = len(first)
    two = output.find(second, one)
    three = output.find(MIDDLE, two + len(second))
    spans = {first: (one, two), second: (two + len(second), three), MIDDLE: (three + len(MIDDLE), len(output))}
    for mark in (PREFIX, MIDDLE, SUFFIX):
        yield from output.stream(*spans[mark])


def digests(transformed: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of transformed texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompressor = zstandard.ZstdDecompressor()
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
        for batch in batches:
            of_output, of_text = [], []
            for row in batch.select(["form", "output"]).to_pylist():
                output, text = Frames(row["output"], decompressor), hashlib.sha256()
                for piece in restored(output, row["form"]):
                    text.update(piece.encode())
                of_output.append(output.digest())
                of_text.append(text.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(of_output, pa.string()), pa.array(of_text, pa.string())],
                names=[*names, "output_sha256", "restored_sha256"],
            )

    kind = transformed.schema["doc_id"].dataType.simpleString()
    return transformed.mapInArrow(
        run,
        f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string",
    )


def texts(transformed: DataFrame) -> DataFrame:
    """(doc_id, form, text): transformed texts as plain strings, for a trainer that wants no frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompressor = zstandard.ZstdDecompressor()
        for batch in batches:
            for row in range(len(batch)):
                output = Frames(batch.column("output")[row].as_py(), decompressor)
                text = "".join(output.stream(0, len(output)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, 1), batch.column("form").slice(row, 1), pa.array([text])],
                    names=["doc_id", "form", "text"],
                )

    kind = transformed.schema["doc_id"].dataType.simpleString()
    return transformed.mapInArrow(run, f"doc_id {kind}, form string, text string")


def fill_in_middle(docs: DataFrame, seed: int = SEED, frame_chars: int = FRAME_CHARS) -> DataFrame:
    """The transformed texts of ``docs``, through a stored table of frames."""
    return transform(cut_lineage(pack(docs, seed, frame_chars)))
