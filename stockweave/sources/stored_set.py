"""Stored tables whose changes become visible together.

A set is a folder with a stored table per name (``tables/``) and a manifest per version of the set, which says what version
of each table belongs to it. Readers look at the manifests of the set only. A transaction writes new versions of the tables
it changes and the manifest of the set last, so a reader sees all of its changes or none, and a transaction that ends before
leaves table versions that no manifest lists.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockweave.functions.scan import numbered
from stockweave.operators.audit import audit_diff
from stockweave.schemas import AUDITED_TABLES, LOAD_ORDER, PRIMARY_KEYS, STORED_BY
from stockweave.session import cut_lineage
from stockweave.sources import stored
from stockweave.sources.tables import Tables, begun_versions, versions


class Conflict(RuntimeError):
    """Another transaction was committed since this one began."""


def create_set(tables: Mapping[str, DataFrame], folder: str, file_rows: int = stored.FILE_ROWS) -> int:
    """Stores the tables, each cut by its columns in ``STORED_BY`` or else its key, as version 1 of a set; returns 1.

    A run that was cut off is done again in another folder.
    """
    names = [name for name in LOAD_ORDER if name in tables]
    spark = tables[names[0]].sparkSession
    if begun_versions(folder):
        raise FileExistsError(f"a set of stored tables is in {folder}")
    made = {}
    for name in names:
        by = [c for c in STORED_BY.get(name, PRIMARY_KEYS[name]) if c in tables[name].columns]
        made[name] = stored.create(tables[name], _folder(folder, name), by, file_rows)
    return _publish(spark, folder, 1, made)


def read_set(spark: SparkSession, folder: str, version: int | None = None) -> Tables:
    """The tables of the latest, or of the given, version."""
    listed = _listed(spark, folder, version or latest(spark, folder))
    return Tables({n: (lambda n=n, v=v: stored.read(spark, _folder(folder, n), v)) for n, v in listed.items()})


def latest(spark: SparkSession, folder: str) -> int:
    """The number of the latest version."""
    known = versions(spark, folder)
    if not known:
        raise FileNotFoundError(f"no set of stored tables in {folder}")
    return known[-1]


class Transaction:
    """Changes to tables of a set, all made to the version that is the latest when the transaction begins.

    ``tables`` are those of that version; they do not show the changes. A commit fails with ``Conflict`` if another one
    came between, as what was decided from ``tables`` may no longer hold; the caller then runs its work again. The
    manifest of a commit that was cut off looks like one being written, so the next transaction stops unless it is told
    ``after_crash``: that the writer is known to be gone.
    """

    def __init__(self, spark: SparkSession, folder: str, file_rows: int = stored.FILE_ROWS, after_crash: bool = False):
        self._spark, self._folder, self._file_rows = spark, folder, file_rows
        self.base = latest(spark, folder)
        self._number = begun_versions(folder)[-1] + 1
        if self._number > self.base + 1 and not after_crash:
            raise RuntimeError(f"a version of {folder} is being written, or its writer ended; see after_crash")
        self.tables = read_set(spark, folder, self.base)
        self._was = _listed(spark, folder, self.base)
        self._now = dict(self._was)

    def now(self, name: str) -> DataFrame:
        """A table with the changes made so far."""
        return stored.read(self._spark, _folder(self._folder, name), self._now[name])

    def rewrite(
        self, name: str, keys: DataFrame, columns: list[str], change: Callable[[DataFrame], DataFrame], adds_rows: bool = False
    ) -> None:
        """``stored.rewrite`` of a table; what ``change`` returns is cast to the columns of the table."""

        def conformed(rows: DataFrame) -> DataFrame:
            return _conformed(change(rows), rows)

        self._now[name] = stored.rewrite(
            _folder(self._folder, name),
            keys,
            columns,
            conformed,
            adds_rows,
            file_rows=self._file_rows,
            base=self._now[name],
        )

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds rows; columns that they lack are NULL."""
        fixed = cut_lineage(_conformed(rows, self.now(name)))
        if not fixed.isEmpty():
            self._now[name] = stored.append(
                _folder(self._folder, name), fixed, self._file_rows, base=self._now[name]
            )

    def compact(self, name: str) -> None:
        """``stored.compact`` of a table."""
        place = _folder(self._folder, name)
        self._now[name] = stored.compact(self._spark, place, self._file_rows, base=self._now[name])

    def insert(self, name: str, rows: DataFrame, order: str) -> None:
        """Adds rows under the next free numbers of the table's key, in the order of a unique column of the rows."""
        (key,) = PRIMARY_KEYS[name]
        last = self.now(name).agg(F.coalesce(F.max(key), F.lit(0)).alias("last")).scalar()
        self.append(name, numbered(cut_lineage(rows.drop(key)), order, key, start=last))

    def audit(self, changed_at: datetime, user_id: int | None = None, ip_address: str | None = None) -> None:
        """Adds to ``audit_log`` a row per row that the transaction has changed in an audited table.

        Only files that it wrote, and those that these replace, are read.
        """
        found = None
        for name in self._now:
            if name not in AUDITED_TABLES or self._now[name] == self._was[name]:
                continue
            old, new = stored.changed_rows(self._spark, _folder(self._folder, name), self._was[name], self._now[name])
            rows = audit_diff(old, new, list(PRIMARY_KEYS[name]), name, changed_at, user_id, ip_address)
            found = rows if found is None else found.unionByName(rows)
        if found is not None:
            place = F.concat_ws(" ", "table_name", "record_id").alias("place")
            self.insert("audit_log", found.select("*", place), "place")

    def commit(self) -> int:
        """Makes the changes visible and returns the version, which is the one before where nothing has changed."""
        if self._now == self._was:
            return self.base
        if latest(self._spark, self._folder) != self.base:
            raise Conflict(f"version {self.base} of {self._folder} is no longer the latest")
        return _publish(self._spark, self._folder, self._number, self._now)


def _folder(folder: str, name: str) -> str:
    return f"{folder}/tables/{name}"


def _conformed(rows: DataFrame, like: DataFrame) -> DataFrame:
    """The rows with the columns and types of another table; columns that they lack are NULL."""
    have = set(rows.columns)
    return rows.select(
        *[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema]
    )


def _publish(spark: SparkSession, folder: str, version: int, listed: dict[str, int]) -> int:
    """Writes the manifest; fails if another transaction has begun to publish this version."""
    rows = [(version, name, number) for name, number in listed.items()]
    manifest = spark.createDataFrame(rows, "version long, table_name string, table_version long").coalesce(1)
    manifest.write.mode("errorifexists").parquet(f"{folder}/manifests/{version:08d}")
    return version


def _listed(spark: SparkSession, folder: str, version: int) -> dict[str, int]:
    """The version of each table in a version of the set."""
    rows = spark.read.parquet(f"{folder}/manifests/{version:08d}").collect()
    return {r.table_name: r.table_version for r in rows}
