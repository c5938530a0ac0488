"""Stage tables: Parquet written to the shared checkpoint folder between stages.

Suffix sorting runs in rounds and every round is decided by a small count, so each round's
result is written once and read back.  This cuts the lineage and survives lost executors; the
folder is the one the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder for stage tables: ``spark.checkpoint.dir`` or the context's checkpoint folder.

    Only a session on a local master falls back to a temporary folder of its own, which is
    removed when Python exits.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="lexorder-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)
    return folder


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme; without one it is in Spark's default file system."""
    named = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = named.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(named).toString()


REMOVES_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Parquet of rows whose numbers rise or lie close together: differences, no dictionaries.
RISING = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"}


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind once it is written.

    Otherwise they stay until the driver happens to collect its garbage, those of all rounds at
    once.  Nothing that is written is computed a second time.
    """
    before = spark.conf.get(REMOVES_SHUFFLES, None)
    spark.conf.set(REMOVES_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(REMOVES_SHUFFLES)
        else:
            spark.conf.set(REMOVES_SHUFFLES, before)


class Stages:
    """The stage tables of one run, in one folder of their own."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or f"{shared_dir(spark)}/stages-{uuid.uuid4().hex}"

    def inner(self, name: str) -> Stages:
        """A folder for tables that can go before the others do."""
        return Stages(self.spark, f"{self.folder}/{name}")

    def save(self, df: DataFrame, name: str, rising: bool = False) -> DataFrame:
        """Write ``df`` as table ``name`` and return the table as read back.

        ``rising``: rows that lie in an order in which numbers differ little from row to row.
        """
        path = f"{self.folder}/{name}"
        with shuffles_removed(self.spark):
            df.write.options(compression="zstd", **(RISING if rising else {})).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self, name: str = "") -> None:
        """Delete a table, or the whole folder, that no later plan reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def parallelism(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, 1)


def default_tasks(spark: SparkSession) -> int:
    """Task count where the rows are not counted: two waves, or what the session asks for."""
    return max(2 * parallelism(spark), int(spark.conf.get("spark.sql.shuffle.partitions")))


# What one sort task should hold.
ROWS_PER_TASK = 1_000_000
BYTES_PER_TASK = 256 << 20


def tasks_for(spark: SparkSession, rows: int, size: int = 0) -> int:
    """Task count for an exchange of ``rows`` rows, in full waves of the cluster's cores.

    ``size`` are the bytes exchanged, where the rows are not narrow.
    """
    wave = parallelism(spark)
    return max(1, -(-rows // (ROWS_PER_TASK * wave)), -(-size // (BYTES_PER_TASK * wave))) * wave
