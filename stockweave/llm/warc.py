"""WARC archives written and read as a table of record chunks.

Writing. A payload becomes rows (record, chunk number, bytes) of bounded size,
which stream to the archive of their task; its length and SHA-256 are known
beforehand, so no task puts a whole record together. Payloads of at least
``revisit_bytes`` that equal the payload of a record with a smaller page_id are
written as revisit records, with the header block of the full response.

Reading. A task streams through an archive and gives rows (record, chunk number,
bytes) with the digest of the payload up to and with the chunk; the last chunk
of a record carries the digest of all.

An archive gets its name only when it is complete, and a repeated task writes
the same bytes under the same name, so lost executors leave no broken archives.
Folders are paths that pyarrow's file systems open on every executor.

Cases: null html is an empty payload, null page_id and url are absent headers;
line breaks in a url are escaped; rows that repeat a page_id and payload are each written with
the same type; empty tables give no archives and empty results; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockweave.session import cut_lineage

CHUNK_BYTES = 1 << 16
REVISIT_BYTES = 100
#: WARC-Date of all records, as pages carry no date.
DATE = "1970-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def records(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) for each page."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    page = pages.select(
        "page_id",
        "url",
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_digest"),
    )
    # Only payloads that occur under more than one page_id matter, which are few as a rule.
    repeated = cut_lineage(
        page.where(F.col("payload_bytes") >= revisit_bytes)
        .groupBy(F.col("payload_digest").alias("_digest"))
        .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
        .where("_rows > 1 AND _first IS NOT NULL")
        .drop("_rows")
    )
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return page.join(repeated, F.col("payload_digest") == F.col("_digest"), "left").select(
        *page.columns,
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("_first")).alias("refers_to"),
    )


def chunk_rows(record: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A row for each chunk of a payload; a record without payload, or a revisit, has one empty chunk."""
    whole = F.col("record_type") == "response"
    last = F.when(whole, F.floor(F.greatest(F.col("payload_bytes") - 1, F.lit(0)) / chunk_bytes)).otherwise(0)
    meta = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    # The chunk numbers come first, so a row holds one chunk and never an array of all.
    numbered = record.select(*meta, "payload", last.cast("int").alias("last_chunk")).withColumn(
        "chunk_no", F.explode(F.sequence(F.lit(0), F.col("last_chunk")))
    )
    data = F.substring("payload", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes))
    return numbered.select(*meta, "last_chunk", "chunk_no", F.when(whole, data).otherwise(F.lit(b"")).alias("data"))


def _record_id(name: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, str(name))}>"


def _head(row: dict, position: int) -> bytes:
    """The header block of a record and of the response in it."""
    page, url = row["page_id"], row["url"]
    http = HTTP.format(row["payload_bytes"])
    body = row["payload_bytes"] if row["record_type"] == "response" else 0
    fields = {
        "WARC-Type": row["record_type"],
        "WARC-Record-ID": _record_id(page if page is not None else f"{position} {row['payload_digest']}"),
        "WARC-Date": DATE,
        "WARC-Target-URI": url and url.replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": f"sha256:{row['payload_digest']}",
        "X-Page-Id": page,
        "WARC-Refers-To": row["refers_to"] is not None and _record_id(row["refers_to"]) or None,
        "X-Refers-To-Page-Id": row["refers_to"],
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        if row["record_type"] == "revisit"
        else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(http) + body,
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n{http}".encode()


def write(pages: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES, revisit_bytes: int = REVISIT_BYTES) -> list[str]:
    """Writes the archives and returns their paths, one per task that had rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        name = f"{root}/part-{task.partitionId():06d}.warc"
        attempt = f"{root}/_attempt-{task.taskAttemptId()}"
        out, position, size = None, 0, 0
        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names}
            for i in range(len(batch)):
                if out is None:
                    system.create_dir(root, recursive=True)
                    out = system.open_output_stream(attempt, buffer_size=1 << 20)
                row = {c: v[i].as_py() for c, v in columns.items() if c != "data"}
                if row["chunk_no"] == 0:
                    size += out.write(_head(row, task.partitionId() << 33 | position))
                    position += 1
                size += out.write(columns["data"][i].as_buffer())
                if row["chunk_no"] == row["last_chunk"]:
                    size += out.write(b"\r\n\r\n")
        if out is not None:
            out.close()
            system.move(attempt, name)
            yield pa.RecordBatch.from_pydict(
                {"path": [f"part-{task.partitionId():06d}.warc"], "records": [position], "bytes": [size]}
            )

    rows = chunk_rows(records(pages, revisit_bytes), chunk_bytes)
    written = rows.mapInArrow(run, "path string, records long, bytes long").select("path").collect()
    return sorted(f"{folder}/{r.path}" for r in written)


class _Stream:
    """Reads lines and bounded pieces from a file, one block in memory."""

    def __init__(self, file, block: int) -> None:
        self.file, self.block, self.data, self.at = file, block, b"", 0

    def _more(self) -> bool:
        block = self.file.read(self.block)
        self.data, self.at = self.data[self.at :] + block, 0
        return bool(block)

    def line(self) -> bytes | None:
        """Up to the next line end, without it; None at the end of the file."""
        while (end := self.data.find(b"\r\n", self.at)) < 0:
            if not self._more():
                return None
        line, self.at = self.data[self.at : end], end + 2
        return line

    def pieces(self, size: int, most: int) -> Iterator[bytes]:
        """``size`` bytes in pieces of ``most`` bytes; the last is shorter."""
        while size > 0:
            while len(self.data) - self.at < min(size, most):
                if not self._more():
                    raise EOFError("the archive ends inside a record")
            piece = self.data[self.at : self.at + min(size, most)]
            self.at += len(piece)
            size -= len(piece)
            yield piece


def _fields(stream: _Stream) -> tuple[dict[str, str], int]:
    """The header fields up to the empty line, and the bytes that they take."""
    found, taken = {}, 0
    while line := stream.line():
        taken += len(line) + 2
        key, _, value = line.decode().partition(": ")
        found[key.lower()] = value
    return found, taken + 2


SCHEMA = pa.schema(
    [
        ("archive", pa.string()),
        ("record_id", pa.string()),
        ("record_type", pa.string()),
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("refers_to", pa.int64()),
        ("declared_bytes", pa.int64()),
        ("declared_digest", pa.string()),
        ("chunk_no", pa.int32()),
        ("bytes_so_far", pa.int64()),
        ("digest_so_far", pa.string()),
        ("last", pa.bool_()),
        ("data", pa.binary()),
    ]
)
DDL = (
    "archive string, record_id string, record_type string, page_id long, url string, refers_to long,"
    " declared_bytes long, declared_digest string, chunk_no int, bytes_so_far long, digest_so_far string,"
    " last boolean, data binary"
)


def _chunks(archive: str, chunk_bytes: int, data: bool) -> Iterator[dict]:
    system, path = fs.FileSystem.from_uri(archive)
    with system.open_input_stream(path) as file:
        stream = _Stream(file, max(chunk_bytes, 1 << 16))
        while (line := stream.line()) is not None:
            if not line.startswith(b"WARC/"):
                continue
            fields, _ = _fields(stream)
            stream.line()  # the status line of the response
            http, head = _fields(stream)
            left = int(fields["content-length"]) - head - len("HTTP/1.1 200 OK\r\n")
            digest, size = hashlib.sha256(), 0
            base = {
                "archive": archive,
                "record_id": fields["warc-record-id"],
                "record_type": fields["warc-type"],
                "page_id": int(fields["x-page-id"]) if "x-page-id" in fields else None,
                "url": fields.get("warc-target-uri"),
                "refers_to": int(fields["x-refers-to-page-id"]) if "x-refers-to-page-id" in fields else None,
                "declared_bytes": int(http["content-length"]),
                "declared_digest": fields["warc-payload-digest"].removeprefix("sha256:"),
            }
            number = 0
            for piece in stream.pieces(left, chunk_bytes) if left > 0 else [b""]:
                digest.update(piece)
                size += len(piece)
                yield base | {
                    "chunk_no": number,
                    "bytes_so_far": size,
                    "digest_so_far": digest.hexdigest(),
                    "last": size >= left,
                    "data": piece if data else None,
                }
                number += 1


def read_chunks(spark: SparkSession, archives: list[str], chunk_bytes: int = CHUNK_BYTES, data: bool = True) -> DataFrame:
    """The chunk rows of all records of the archives, one task per archive; ``data=False`` leaves the bytes out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                rows, held = [], 0
                for row in _chunks(archive, chunk_bytes, data):
                    rows.append(row)
                    held += len(row["data"] or b"") + 500
                    if held > 8_000_000:
                        yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    listed = spark.createDataFrame([(a,) for a in archives], "archive string").repartition(max(1, len(archives)))
    return listed.mapInArrow(run, DDL)


def read_records(spark: SparkSession, archives: list[str], chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A row per record from its last chunk: lengths and digests of the full payload; for a response both are
    counted from the bytes read, and ``intact`` says whether they match what the headers declare."""
    chunk = read_chunks(spark, archives, chunk_bytes, data=False).where("last")
    response = F.col("record_type") == "response"
    return chunk.select(
        "archive",
        "record_id",
        "page_id",
        "url",
        F.when(response, F.col("bytes_so_far")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
        F.when(response, F.col("digest_so_far")).otherwise(F.col("declared_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
        (
            ~response
            | ((F.col("bytes_so_far") == F.col("declared_bytes")) & (F.col("digest_so_far") == F.col("declared_digest")))
        ).alias("intact"),
    )
