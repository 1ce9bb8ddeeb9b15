"""Session settings every job relies on."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings that suit any cluster. Skewed joins are split even when that costs one more
# exchange, because a single business number, director name or address may hold a third of all rows.
_RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Large tables that are joined with few rows are reduced by a Bloom filter where they are read, before any shuffle.
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "32MB",
    "spark.sql.session.timeZone": "UTC",
}

# One machine only: stages that compare names cost far more than their bytes suggest.
_LOCAL = {
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in _RUNTIME.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A small session for tests and the local benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("fundtrace")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in {**_RUNTIME, **_LOCAL}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the session names in ``spark.checkpoint.dir``.

    Only a ``local`` session (tests, a laptop) that names none gets a scratch folder: elsewhere executors
    would each write to a disk of their own and read back a part of the table.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="fundtrace-checkpoint-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` as a table in the shared checkpoint folder and read it back.

    A Parquet table keeps what an RDD checkpoint loses: column pruning, compression and the true
    size, from which later joins choose their strategy. It outlives any executor.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for tables in _SCOPES:
        tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


_SCOPES: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``checkpoint`` makes inside are removed at the end; results must be stored by then."""
    tables: list[str] = []
    _SCOPES.append(tables)
    try:
        yield
    finally:
        _SCOPES.pop()
        for table in tables:
            path = spark._jvm.org.apache.hadoop.fs.Path(table)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
