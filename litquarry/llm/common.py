"""What the operators share: the cluster's shared folder, written tables and ASCII text rules."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The six characters that end a word or pad a line: space, tab, line feed, vertical tab, form feed, return.
BLANKS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a session of one machine (tests) gets a local one where none is set."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file:///tmp/checkpoints/{sc.applicationId}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Shuffle files of a job go when it ends: what comes after reads the table that it wrote.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, path: str, *partition_by: str) -> None:
    """Write ``df`` to ``path`` as Parquet (zstd) and let go of the shuffle files that this took."""
    conf = df.sparkSession.conf
    was = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        df.write.partitionBy(*partition_by).option("compression", "zstd").parquet(path)
    finally:
        conf.set(_CLEANUP, was)


def written(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: the lineage ends here."""
    spark = df.sparkSession
    path = path or new_folder(spark, label)
    write_table(df, path)
    return spark.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store that no later step reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def giving_back(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` on a task's batches; at its end the worker, which idles on beside later stages, gives unused memory back."""

    def run(batches: Iterator) -> Iterator:
        import ctypes
        from contextlib import suppress

        import pyarrow as pa

        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # only the C library of Linux has this
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


class Workspace:
    """One folder of the shared store for the tables of one job, removed as a whole when no later step reads them."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.folder, self.made = spark, new_folder(spark, label), 0

    def place(self, label: str) -> str:
        self.made += 1
        return f"{self.folder}/{self.made:03d}-{label}"

    def written(self, df: DataFrame, label: str) -> DataFrame:
        return written(df, label, self.place(label))

    def remove(self) -> None:
        remove_folder(self.spark, self.folder)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` is the same, and much faster, where all bytes are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)
