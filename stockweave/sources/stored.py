"""Stored tables whose writes replace only the files that hold changed keys.

A table is a folder of Parquet files and one manifest per version, which lists the files that make up the version and the
columns by whose ranges they are cut. A write reads the files with changed keys, writes what they become to new files, and
then the manifest, last. A write that ends before leaves the version before it; files are never changed, so every version
stays readable, and two versions differ only in files that one of them lists alone.

A manifest that was cut off looks like one being written. So the next write stops, unless it is told ``after_crash``: that
the writer is known to be gone. Two writers of one version cannot both publish it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockweave.functions.joins import in_parts, parts_of
from stockweave.session import STORED_COMPRESSION
from stockweave.sources.tables import begun_versions, versions

#: Most rows of a file.
FILE_ROWS = 2_000_000

#: Spark's default form of timestamps has no least and greatest value per file, so readers could not skip files by time.
TIMESTAMP_SETTING = ("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")


def create(rows: DataFrame, folder: str, by: list[str], file_rows: int = FILE_ROWS) -> int:
    """Stores the rows as version 1, cut by ranges of ``by`` into files of at most ``file_rows`` rows; returns 1.

    ``by`` is best the key that writes come by, as their rows then meet few files.
    """
    spark = rows.sparkSession
    if begun_versions(folder):
        raise FileExistsError(f"a stored table is in {folder}")
    return _publish(spark, folder, 1, _write(rows, folder, by, file_rows), by)


def read(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The rows of the latest, or of the given, version."""
    files, _ = _listed(spark, folder, version or latest(spark, folder))
    return _read(spark, folder, files)


def latest(spark: SparkSession, folder: str) -> int:
    """The number of the latest version."""
    known = versions(spark, folder)
    if not known:
        raise FileNotFoundError(f"no stored table in {folder}")
    return known[-1]


def files_with(
    spark: SparkSession,
    folder: str,
    keys: DataFrame,
    columns: list[str],
    blank_as_null: tuple[str, ...] = (),
    version: int | None = None,
) -> list[str]:
    """The files of the latest, or of the given, version that hold a row with one of the keys; reads the key columns only.

    In ``blank_as_null`` columns NULL and '' are the same; elsewhere NULL equals nothing. Beside its key, a row carries
    the number of its file, not the name, which is longer than most keys.
    """

    def value(column: str):
        return F.coalesce(F.col(column), F.lit("")) if column in blank_as_null else F.col(column)

    files, _ = _listed(spark, folder, version or latest(spark, folder))
    stored = _read(spark, folder, files)
    names = [f"k{i}" for i in range(len(columns))]
    numbers = spark.createDataFrame([(f.split("/")[-1], i) for i, f in enumerate(files)], "file string, number int")
    parts = parts_of(stored)

    def keyed(rows: DataFrame, *more: Column) -> DataFrame:
        found = rows.select(*[value(c).alias(n) for c, n in zip(columns, names)], *more)
        return found.filter(reduce(and_, [F.col(n).isNotNull() for n in names]))

    probe = keyed(stored, F.col("_metadata.file_name").alias("file")).join(F.broadcast(numbers), "file").drop("file")
    probe, wanted = in_parts(probe, parts, *names), in_parts(keyed(keys).distinct(), parts, *names)
    hit = {r.number for r in probe.join(wanted, names, "left_semi").select("number").distinct().collect()}
    return [f for i, f in enumerate(files) if i in hit]


def rewrite(
    folder: str,
    changes: DataFrame,
    columns: list[str],
    change: Callable[[DataFrame], DataFrame],
    adds_rows: bool = False,
    blank_as_null: tuple[str, ...] = (),
    file_rows: int = FILE_ROWS,
    base: int | None = None,
    after_crash: bool = False,
) -> int:
    """Replaces the files that hold a key of ``changes`` by ``change`` of their rows; returns the version, which is the one
    before where nothing is to be written.

    ``change`` gets only the rows of these files and must leave rows of other keys as they are. With ``adds_rows``
    it is called even if there are none, as new keys are in no file. ``base`` is the version to change, if not the latest.
    """
    spark = changes.sparkSession
    before, number = _next(spark, folder, base, after_crash)
    files, by = _listed(spark, folder, before)
    hit = files_with(spark, folder, changes, columns, blank_as_null, before)
    if not hit and not adds_rows:
        return before
    rows = _read(spark, folder, hit) if hit else spark.createDataFrame([], _read(spark, folder, files).schema)
    new = _write(change(rows), folder, by, file_rows)
    return _publish(spark, folder, number, [f for f in files if f not in set(hit)] + new, by)


def append(
    folder: str, rows: DataFrame, file_rows: int = FILE_ROWS, base: int | None = None, after_crash: bool = False
) -> int:
    """Adds the rows, which have the columns of the table, in files of their own; returns the version."""
    spark = rows.sparkSession
    before, number = _next(spark, folder, base, after_crash)
    files, by = _listed(spark, folder, before)
    return _publish(spark, folder, number, files + _write(rows, folder, by, file_rows), by)


def compact(
    spark: SparkSession, folder: str, file_rows: int = FILE_ROWS, base: int | None = None, after_crash: bool = False
) -> int:
    """Puts the rows of files with less than half of ``file_rows`` rows, as appends leave them, together in new files.

    Returns the version, which is the one before where there is at most one such file. Other files stay as they are, and so
    do all rows.
    """
    before, number = _next(spark, folder, base, after_crash)
    files, by = _listed(spark, folder, before)
    path = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file")
    full = _read(spark, folder, files).select(path).groupBy("file").count().where(F.col("count") >= file_rows / 2)
    kept = {r.file for r in full.collect()}
    small = [f for f in files if f.split("/")[-1] not in kept]
    if len(small) < 2:
        return before
    new = _write(_read(spark, folder, small), folder, by, file_rows)
    return _publish(spark, folder, number, [f for f in files if f not in set(small)] + new, by)


def changed_rows(spark: SparkSession, folder: str, old: int, new: int) -> tuple[DataFrame, DataFrame]:
    """The rows of the files that only version ``old`` has, and of those that only ``new`` has.

    All other rows stand in both versions, so what differs between these two is what differs between the versions.
    """
    left, right = _listed(spark, folder, old)[0], _listed(spark, folder, new)[0]
    schema = _read(spark, folder, left or right).schema

    def only(files: list[str], others: list[str]) -> DataFrame:
        own = [f for f in files if f not in set(others)]
        return _read(spark, folder, own) if own else spark.createDataFrame([], schema)

    return only(left, right), only(right, left)


def _next(spark: SparkSession, folder: str, base: int | None, after_crash: bool) -> tuple[int, int]:
    """The version to change and the number of the new one, which no write has begun.

    A writer that names its base has a list of its own of the versions that count, so a manifest cut off is none of them.
    """
    begun = begun_versions(folder)
    before = base or latest(spark, folder)
    if base is None and not after_crash and begun[-1] > before:
        raise RuntimeError(f"version {begun[-1]} of {folder} is being written, or its writer ended; see after_crash")
    return before, begun[-1] + 1


def _read(spark: SparkSession, folder: str, files: list[str]) -> DataFrame:
    return spark.read.parquet(*[f"{folder}/{f}" for f in files])


def _write(rows: DataFrame, folder: str, by: list[str], file_rows: int) -> list[str]:
    """Writes the rows to a new place and returns its files, as paths below ``folder``."""
    place = f"data/{uuid.uuid4().hex}"
    cut = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    conf, (setting, value) = rows.sparkSession.conf, TIMESTAMP_SETTING
    before = conf.get(setting)
    conf.set(setting, value)
    try:
        cut.write.mode("errorifexists").option("compression", STORED_COMPRESSION).option("maxRecordsPerFile", file_rows).parquet(f"{folder}/{place}")
    finally:
        conf.set(setting, before)
    written = rows.sparkSession.read.parquet(f"{folder}/{place}").inputFiles()
    return sorted(f"{place}/{path.split('/')[-1]}" for path in written)


def _publish(spark: SparkSession, folder: str, version: int, files: list[str], by: list[str]) -> int:
    """Writes the manifest; fails if another writer has published this version."""
    rows = [(version, f, by) for f in files]
    manifest = spark.createDataFrame(rows, "version long, path string, cut_by array<string>").coalesce(1)
    manifest.write.mode("errorifexists").parquet(f"{folder}/manifests/{version:08d}")
    return version


def _listed(spark: SparkSession, folder: str, version: int) -> tuple[list[str], list[str]]:
    """The files of a version and the columns they are cut by."""
    rows = spark.read.parquet(f"{folder}/manifests/{version:08d}").orderBy("path").collect()
    return [r.path for r in rows], list(rows[0].cut_by)
