"""Named table sets: read, write, snapshot and compare."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockweave.schemas import LOAD_ORDER, layout
from stockweave.session import STORED_COMPRESSION


class Tables(Mapping):
    """Table name -> DataFrame, each built on first use and then kept."""

    def __init__(self, builders: Mapping[str, Callable[[], DataFrame]]):
        self._builders = dict(builders)
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)

    def replaced(self, **frames: DataFrame) -> "Tables":
        """The same set with some tables swapped."""
        return Tables({**self._builders, **{n: (lambda f=f: f) for n, f in frames.items()}})


def read_tables(
    spark: SparkSession, folder: str, names: list[str] | None = None, declared: bool = True
) -> Tables:
    """Tables stored as one Parquet folder each, with their declared or their stored layout."""

    def reader(name: str):
        source = spark.read.schema(layout(name)) if declared else spark.read
        return lambda: source.parquet(f"{folder}/{name}")

    return Tables({name: reader(name) for name in (names or LOAD_ORDER)})


def scan_table(tables: Mapping[str, DataFrame], name: str, columns: list[str] | None = None) -> DataFrame:
    """All rows of a table, or only some of its columns."""
    return tables[name].select(*columns) if columns else tables[name]


def scan_by_key(tables: Mapping[str, DataFrame], name: str, **key) -> DataFrame:
    """The rows of a table with the given key values; the filter reaches the scan."""
    condition = reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in key.items()])
    return tables[name].filter(condition)


def write_snapshot(tables: Mapping[str, DataFrame], folder: str) -> list[str]:
    """Write every table below ``folder``, parents first; returns the names written."""
    written = [name for name in LOAD_ORDER if name in tables]
    for name in written:
        tables[name].write.mode("errorifexists").parquet(f"{folder}/{name}")
    return written


def row_counts(tables: Mapping[str, DataFrame], names: list[str]) -> DataFrame:
    """(table_name, row_count) for the given tables, as one plan."""
    counts = [
        tables[name].agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name in names
    ]
    return reduce(DataFrame.unionByName, counts)


def publish_snapshot(tables: Mapping[str, DataFrame], folder: str) -> int:
    """Writes every table to a new place below ``folder`` and makes all of them visible at once; returns the version.

    The manifest, a small table that lists where the tables of a version are, is written last. A write that ends before
    it, or inside it, leaves the versions before as they were; its files are in nobody's list, and its number stays free
    of use.
    """
    names = [name for name in LOAD_ORDER if name in tables]
    spark = tables[names[0]].sparkSession
    version = 1 + max([0, *begun_versions(folder)])
    place = f"data/{version:08d}-{uuid.uuid4().hex}"
    for name in names:
        tables[name].write.mode("errorifexists").option("compression", STORED_COMPRESSION).parquet(f"{folder}/{place}/{name}")
    rows = [(version, name, f"{place}/{name}") for name in names]
    manifest = spark.createDataFrame(rows, "version long, table_name string, path string").coalesce(1)
    manifest.write.mode("errorifexists").parquet(f"{folder}/manifests/{version:08d}")
    return version


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The versions whose manifest is complete."""
    return sorted({number for number, name in _manifest_files(folder) if name == "_SUCCESS"})


def begun_versions(folder: str) -> list[int]:
    """The versions whose manifest is complete, being written, or was cut off."""
    return sorted({number for number, _ in _manifest_files(folder)})


def _manifest_files(folder: str) -> list[tuple[int, str]]:
    """The version and name of all that lies below the manifests of a folder."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    found = system.get_file_info(fs.FileSelector(f"{root}/manifests", allow_not_found=True, recursive=True))
    return [(int(info.path.rpartition("/manifests/")[2].split("/")[0]), info.base_name) for info in found]


def read_snapshot(spark: SparkSession, folder: str, version: int | None = None) -> Tables:
    """The tables that the manifest of the latest, or of the given, version lists."""
    known = versions(spark, folder)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"no published snapshot {version or ''} in {folder}")
    listed = spark.read.parquet(f"{folder}/manifests/{version or known[-1]:08d}").collect()
    return Tables({r.table_name: (lambda path=r.path: spark.read.parquet(f"{folder}/{path}")) for r in listed})


def fingerprints(tables: Mapping[str, DataFrame], names: list[str]) -> DataFrame:
    """(table_name, row_count, fingerprint) for the given tables: the content whatever the order of rows and columns.

    The fingerprint adds up two 64-bit hashes of each row, so it needs one pass and a row per task to move.
    """

    def of(name: str) -> DataFrame:
        columns = [F.col(c) for c in sorted(tables[name].columns)]
        # A hash passes over NULLs, so where they are is hashed as well.
        values = [*columns, *[c.isNull() for c in columns]]
        halves = [F.sum(F.xxhash64(F.lit(i), *values).cast("decimal(38,0)")).alias(f"half_{i}") for i in (0, 1)]
        text = F.concat_ws(":", "row_count", "half_0", "half_1")
        return (
            tables[name]
            .agg(F.count("*").alias("row_count"), *halves)
            .select(F.lit(name).alias("table_name"), "row_count", text.alias("fingerprint"))
        )

    return reduce(DataFrame.unionByName, [of(name) for name in names])


def snapshot_check(source: Mapping[str, DataFrame], restored: Mapping[str, DataFrame], names: list[str]) -> DataFrame:
    """Row counts of both sides per table, and whether their contents agree."""
    left = fingerprints(source, [n for n in names if n in source]).withColumnsRenamed(
        {"row_count": "source_rows", "fingerprint": "left"}
    )
    right = fingerprints(restored, [n for n in names if n in restored]).withColumnsRenamed(
        {"row_count": "restored_rows", "fingerprint": "right"}
    )
    return left.join(right, "table_name", "full").select(
        "table_name", "source_rows", "restored_rows", F.coalesce(F.col("left") == F.col("right"), F.lit(False)).alias("matches")
    )
