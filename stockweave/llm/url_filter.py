"""URL filters over a sorted array of digests.

An index holds texts of four kinds, each with a verdict:

* ``rule``  host and path prefix, for the host and its subdomains; the longest rule that fits decides, a longer
  host before a shorter one where two are as long;
* ``host``  a host that is judged with its subdomains;
* ``url``   host and path of one page;
* ``word``  a word of a host name, between dots and hyphens.

Building sorts the texts by their 64-bit xxhash over the cluster and writes a file per part: the keys as one array and
the texts beside them. Probing turns a url into the few texts that can fit it, looks all keys of a batch up in the
memory-mapped arrays by vectorised binary search, and compares the stored text wherever a key is found, so a collision
never decides. Where the folder is no mounted file system, a task reads the parts it needs, of at most
``PART_ENTRIES`` texts each.

A url that no rule fits is judged by the other kinds: blocked if one of its texts is listed, else allowed.

Cases: a null url, or one without ``://``, has an empty host and path, which nothing fits, so it is allowed; null
entries are left out, and of entries that repeat a text the blocking one counts; rows that repeat a page_id are judged
each; an empty index allows all, and an empty table gives an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PART_ENTRIES = 2_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words of host names that stand for adult pages, gambling, drug sales, spam and fraud.
BLOCK_WORDS = (
    "adult anal bet bets betting bingo camgirl camgirls casino casinos cialis cum escort escorts fetish gambling hentai"
    " jackpot keygen levitra lottery milf nude nudes payday phishing pill pills poker porn porno pornstar replica roulette"
    " sex sexcam sexy slots spam tits torrent torrents tramadol viagra warez webcams xnxx xxx"
).split()
#: Rules of the query's contract. Fixed values.
RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]


@dataclass(frozen=True)
class Part:
    path: str
    first_key: int
    entries: int


@dataclass(frozen=True)
class Index:
    """Parts in key order, and what bounds the texts to probe for a url."""

    parts: tuple[Part, ...]
    labels: int
    path_lengths: tuple[int, ...]
    key_bits: int


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def _key(text: Column, bits: int) -> Column:
    """The digest of a text; fewer bits make texts collide, for tests."""
    key = F.xxhash64(text)
    return key if bits == 64 else F.shiftrightunsigned(key, 64 - bits)


def default_entries(spark: SparkSession) -> DataFrame:
    """(kind, entry, verdict): the contract's rules and the blocked host words."""
    rows = [("rule", entry, verdict) for entry, verdict in RULES] + [("word", word, "block") for word in BLOCK_WORDS]
    return spark.createDataFrame(rows, "kind string, entry string, verdict string")


def build(entries: DataFrame, folder: str, part_entries: int = PART_ENTRIES, key_bits: int = 64) -> Index:
    """Writes the index of (kind, entry, verdict) to ``folder``, which every executor can open."""
    text = F.concat_ws(":", "kind", "entry")
    unique = (
        entries.where("kind IS NOT NULL AND entry IS NOT NULL AND verdict IS NOT NULL")
        .groupBy(text.alias("text"))
        .agg(F.max("verdict").alias("verdict"))
    )
    keyed = unique.select(_key(F.col("text"), key_bits).alias("key"), "text", "verdict")
    host = F.regexp_extract("text", r"^[a-z]+:([^/]*)", 1)
    path = F.regexp_extract("text", r"^rule:[^/]*(.*)", 1)
    shape = keyed.agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.size(F.split(host, r"\."))).alias("labels"),
        F.collect_set(F.when(F.col("text").startswith("rule:"), F.length(path))).alias("lengths"),
    ).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches((b.cast(SCHEMA) for b in batches), SCHEMA).combine_chunks()
        if len(table) == 0:
            return
        system, root = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        name, attempt = f"{root}/part-{task.partitionId():06d}.arrow", f"{root}/_attempt-{task.taskAttemptId()}"
        system.create_dir(root, recursive=True)
        with system.open_output_stream(attempt) as out, pa.ipc.new_file(out, SCHEMA) as file:
            file.write_batch(table.to_batches()[0])
        system.move(attempt, name)
        yield pa.RecordBatch.from_pydict(
            {"path": [f"part-{task.partitionId():06d}.arrow"], "first_key": [table["key"][0].as_py()], "entries": [len(table)]}
        )

    ordered = keyed.repartitionByRange(1 + shape.n // part_entries, "key").sortWithinPartitions("key", "text")
    parts = ordered.mapInArrow(run, "path string, first_key long, entries long").collect()
    found = sorted((r.first_key, r.path, r.entries) for r in parts)
    return Index(
        tuple(Part(f"{folder}/{path}", first, n) for first, path, n in found),
        shape.labels or 0,
        tuple(sorted(shape.lengths)),
        key_bits,
    )


SCHEMA = pa.schema([("key", pa.int64()), ("text", pa.string()), ("verdict", pa.string())])


@lru_cache(maxsize=64)
def _open(path: str) -> pa.RecordBatch:
    """A part of the index; memory-mapped where the folder is mounted."""
    system, place = fs.FileSystem.from_uri(path)
    if isinstance(system, fs.LocalFileSystem):
        source = pa.memory_map(place)
    else:
        with system.open_input_file(place) as file:
            source = pa.BufferReader(file.read_buffer())
    return pa.ipc.open_file(source).get_batch(0)


def lookup(index: Index, keys: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Which of ``texts`` are in the index, as places in the array, and their verdicts."""
    places, verdicts = [], []
    if not index.parts:
        return np.zeros(0, np.int64), []
    firsts = np.array([p.first_key for p in index.parts], np.int64)
    owner = np.searchsorted(firsts, keys, side="right") - 1
    for number in np.unique(owner[owner >= 0]).tolist():
        part = _open(index.parts[number].path)
        stored = part.column("key").to_numpy()
        mine = np.flatnonzero(owner == number)
        at = np.searchsorted(stored, keys[mine])
        inside = at < len(stored)
        mine, at = mine[inside], at[inside]
        same = stored[at] == keys[mine]
        for place, row in zip(mine[same].tolist(), at[same].tolist()):
            text = texts[place].as_py()
            while row < len(stored) and stored[row] == keys[place]:
                if part.column("text")[row].as_py() == text:
                    places.append(place)
                    verdicts.append(part.column("verdict")[row].as_py())
                    break
                row += 1
    order = np.argsort(np.array(places, np.int64), kind="stable")
    return np.array(places, np.int64)[order], [verdicts[i] for i in order]


def _probes(index: Index) -> Column:
    """The texts that can fit a url: rules for each host suffix and rule path length, listed hosts, the page, words."""

    def suffixes(host: Column) -> Column:
        labels = F.split(host, r"\.")
        most = F.least(F.size(labels), F.lit(index.labels))
        return F.when(host == "", F.array().cast("array<string>")).otherwise(
            F.transform(
                F.filter(F.sequence(F.lit(0), most), lambda n: n > 0),
                lambda n: F.array_join(F.slice(labels, -n, n), "."),
            )
        )

    bare = F.regexp_replace("host", r"^.*@|:[0-9]*$", "")
    lengths = F.array(*[F.lit(n) for n in index.path_lengths]).cast("array<int>")
    heads = F.transform(
        F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n)
    )
    rules = F.flatten(
        F.transform(suffixes(F.col("host")), lambda h: F.transform(heads, lambda p: F.concat(F.lit("rule:"), h, p)))
    )
    hosts = F.transform(suffixes(bare), lambda h: F.concat(F.lit("host:"), h))
    page = F.array(F.concat(F.lit("url:"), bare, "path"))
    named = F.filter(F.array_distinct(F.split(bare, r"[.\-]")), lambda w: w != "")
    return F.concat(rules, hosts, page, F.transform(named, lambda w: F.concat(F.lit("word:"), w)))


def judge(pages: DataFrame, index: Index) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, listed) for each url; ``listed`` has the other texts that fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            probes, keys = batch.column("probes"), batch.column("keys").flatten().to_numpy()
            texts = probes.flatten()
            places, verdicts = lookup(index, keys, texts)
            ends = np.concatenate([[0], np.cumsum(probes.value_lengths().to_numpy())])
            counts = np.searchsorted(places, ends)
            offsets = pa.array(counts.astype(np.int32))
            found = pa.StructArray.from_arrays([texts.take(pa.array(places)), pa.array(verdicts, pa.string())], ["text", "verdict"])
            columns = [batch.column(c) for c in ("page_id", "url", "host", "path")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.ListArray.from_arrays(offsets, found)], names=["page_id", "url", "host", "path", "found"]
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    parsed = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    probed = parsed.withColumn("probes", _probes(index)).withColumn(
        "keys", F.transform("probes", lambda t: _key(t, index.key_bits))
    )
    found = probed.mapInArrow(
        run,
        f"page_id {kind}, url string, host string, path string, found array<struct<text string, verdict string>>",
    )
    rule = F.array_max(
        F.transform(
            F.filter("found", lambda f: f["text"].startswith("rule:")),
            lambda f: F.struct(
                F.length(f["text"]).alias("length"),
                F.instr(f["text"], "/").alias("host_length"),
                F.substring(f["text"], 6, 1 << 30).alias("entry"),
                f["verdict"].alias("verdict"),
            ),
        )
    )
    listed = F.transform(F.filter("found", lambda f: ~f["text"].startswith("rule:")), lambda f: f["text"])
    blocked = F.exists("found", lambda f: ~f["text"].startswith("rule:") & (f["verdict"] == "block"))
    return found.select(
        "page_id",
        "url",
        "host",
        "path",
        rule["entry"].alias("rule"),
        F.coalesce(rule["verdict"], F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        listed.alias("listed"),
    )
