"""Shared intermediate tables and session settings of the text operators."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundtrace.session import checkpoint

# Joins that keep few rows of a large table filter its scan with a Bloom filter before the shuffle;
# shuffle files go when the query that wrote them has ended; skewed joins are split.
_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1MB",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4MB",
    "spark.sql.session.timeZone": "UTC",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators rely on to a session somebody else created."""
    for key, value in _SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def table(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: lineage ends there."""
    return checkpoint(df)


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``table`` that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/table-" not in name:
                raise ValueError(f"not an intermediate table: {name}")
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Return the memory of what the driver no longer holds, such as a training sample, to the system."""
    gc.collect()
    trim()


def trim() -> None:
    """Return freed memory to the system.

    A Python worker serves later stages too; what a batch's arrays took would stay with it beside theirs.
    """
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if release is not None:
        release(0)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents table, or some of its columns."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def fold(column: str, modulus: int) -> F.Column:
    """Remainder of the crc32 of an id as text, by which labelled rows are set apart for testing."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus
