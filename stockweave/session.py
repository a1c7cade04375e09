"""Session settings the operators rely on."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings that change results or plans. Cluster sizing stays with the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

#: Compression of the tables that operators write; ids and texts take less than half of the space of Spark's default.
STORED_COMPRESSION = "zstd"


def local_session(cpus: str | int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("stockweave")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.default.parallelism", str(shuffle_partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local session without one gets a folder of its own; on a cluster that
    is an error, because a folder on one machine is lost with that machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="stockweave-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Whether a write removes the files of its shuffles when it ends; else they stay until the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back.

    Later steps then neither repeat its work nor lose it with an executor, and nothing that was shuffled for it is kept.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", STORED_COMPRESSION).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: The largest table that Spark broadcasts, going by its guess of the size and going by the rows that a shuffle has counted.
_GUESSED, _COUNTED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"

#: Times that rows in memory may exceed their files.
_PACKED = 100


@contextmanager
def counted_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark broadcasts a table whose rows it has counted up to its limit, and by a guess only a far smaller one.

    It guesses the size of a table from its files. Ids and codes in our files are packed so well that a guess below the
    limit may stand for many millions of rows, which the driver then has to hold.
    """
    most = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if most <= 0:
        yield
        return
    before = {setting: spark.conf.get(setting, None) for setting in (_GUESSED, _COUNTED)}
    spark.conf.set(_GUESSED, str(most // _PACKED))
    if before[_COUNTED] is None:
        spark.conf.set(_COUNTED, str(most))
    try:
        yield
    finally:
        for setting, value in before.items():
            spark.conf.unset(setting) if value is None else spark.conf.set(setting, value)
