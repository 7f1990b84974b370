"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

CHECKPOINT_KEY = "spark.checkpoint.dir"
PARTITION_BYTES = 128 << 20


def build_session(
    app: str = "chartloom", master: str | None = None, shuffle_bytes: int | None = None, **conf: str
) -> SparkSession:
    """A session with adaptive execution on, UTC timestamps and the caller's overrides.

    ``shuffle_bytes`` is the size of the largest exchange expected (about the size of the
    text): exchanges start with one partition per 128 MB of it, at least 200, and adaptive
    execution merges small ones. Keyword names use ``__`` for dots:
    ``spark__sql__shuffle__partitions="8"``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    if shuffle_bytes is not None:
        initial = max(200, -(-shuffle_bytes // PARTITION_BYTES))
        settings["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = str(initial)
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a fresh temporary folder; on a cluster a
    machine-local folder would not survive the loss of the machine.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
    return _local_dir(spark.sparkContext.applicationId)


@lru_cache
def _local_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def cut_lineage(df: DataFrame, schema: StructType | None = None) -> DataFrame:
    """``df`` as a table written to the shared folder and read back, as ``schema`` if its stored layout is that of ``df``.

    Later reads neither recompute ``df`` nor depend on executors that computed it. Unlike
    ``DataFrame.checkpoint``, the last stage runs once, and the planner learns the size.
    """
    return _stored(df, schema)[0]


def _stored(df: DataFrame, schema: StructType | None = None) -> tuple[DataFrame, str]:
    path = f"{shared_dir(df.sparkSession)}/table-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path), path


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it wants it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def folder_exists(spark: SparkSession, path: str) -> bool:
    system, target = file_system(spark, path)
    return system.exists(target)


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` reads, whatever it filters."""
    found = (file_system(df.sparkSession, path) for path in df.inputFiles())
    return sum(system.getFileStatus(target).getLen() for system, target in found)


SHUFFLE_CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside the block, the shuffle files of a query are deleted when it ends, not when the driver happens to collect garbage.

    For queries of several steps that each end in a stored table, whose disk would otherwise hold the exchanges of all steps. A query of another
    thread of this session that ends meanwhile is tidied too, which changes no result.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP_KEY, None)
    spark.conf.set(SHUFFLE_CLEANUP_KEY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP_KEY)
        else:
            spark.conf.set(SHUFFLE_CLEANUP_KEY, before)


class Scratch:
    """Tables as ``cut_lineage`` writes them, deleted on ``drop`` or when the ``with`` block ends, for readers that end before it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, []

    def __enter__(self) -> Scratch:
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        stored, path = _stored(df)
        self.tables.append((stored, path))
        return stored

    def drop(self, *stored: DataFrame) -> None:
        """Delete these tables now: no reader is left."""
        for _, path in (t for t in self.tables if any(t[0] is df for df in stored)):
            system, target = file_system(self.spark, path)
            system.delete(target, True)
        self.tables = [t for t in self.tables if not any(t[0] is df for df in stored)]

    def __exit__(self, *_) -> None:
        self.drop(*(df for df, _ in self.tables))
