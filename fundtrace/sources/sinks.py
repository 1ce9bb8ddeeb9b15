"""Stored reports: rings and crossover as Parquet or JSON, with a live fallback (SRC3, SRC4, SNK1, SNK2)."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession

from fundtrace.sources.warehouse import empty, is_absent

# Error conditions of files that are there but hold no table.
UNREADABLE = ("FAILED_READ_FILE", "UNABLE_TO_INFER_SCHEMA", "CANNOT_READ_FILE_FOOTER")


def store_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def store_json(df: DataFrame, path: str) -> None:
    """Nested rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def load_parquet(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A stored table, empty where it is missing or its files are no Parquet. Other failures are raised."""
    try:
        return spark.read.parquet(path)
    except (PySparkException, Py4JJavaError) as error:
        # A footer that cannot be read fails a task, so its condition is in the text.
        if not any(condition in str(error) for condition in ("PATH_NOT_FOUND", *UNREADABLE)):
            raise
        return empty(spark, ddl)


def load_json_or(
    spark: SparkSession, path: str, schema, fallback: Callable[[], DataFrame]
) -> DataFrame:
    """Stored rings, or the live plan where nothing is stored."""
    try:
        stored = spark.read.schema(schema).json(path)
    except AnalysisException as error:
        if not is_absent(error):
            raise
        return fallback()
    return fallback() if stored.isEmpty() else stored
