"""Bronze boundary: which feed rows are accepted, and why others are not (ST3-ST6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fundtrace import schemas
from fundtrace.functions import ids, values

BRONZE_COLUMNS = ["_batch_id", "_row_hash", "_bronze_validated_at"]
# What parsing adds to a row: its text, its field names and its place in the feed.
PARSED_COLUMNS = ["_raw", "_keys", "_order"]


def parse_feed(lines: DataFrame, value: str = "value") -> DataFrame:
    """Feed lines as rows, whatever else they hold: the known fields as text, the line itself as ``_raw``.

    ``_keys`` lists the fields a line has, null for one that is no JSON object; such a line has no
    known field and stays. ``_order`` is kept where ``lines`` has it.
    """
    text = F.col(value)
    fields = F.try_parse_json(text)
    known = StructType.fromDDL(schemas.FEED).fieldNames() + ["total_gifts", "name"]
    columns = [F.try_variant_get(fields, f"$['{name}']", "string").alias(name) for name in known]
    kept = [F.col("_order")] if "_order" in lines.columns else []
    return lines.filter(F.trim(text) != "").select(*columns, text.alias("_raw"), F.json_object_keys(text).alias("_keys"), *kept)


def _number_error(df: DataFrame, column: str) -> list[Column]:
    if column not in df.columns:
        return []
    value = F.col(f"`{column}`")
    bad = value.isNotNull() & (value != "") & values.feed_number(value).isNull()
    return [F.when(bad, f"{column} must be a number")]


def _source_errors(df: DataFrame, source: str) -> list[Column]:
    if source == "fed_grants":
        return _number_error(df, "agreement_value")
    if source == "cra_donees":
        return _number_error(df, "Total Gifts")
    if source == "cra_t3010" and "BN" in df.columns:
        blank = F.trim(F.coalesce("BN", F.lit(""))) == ""
        # A parsed line says whether it has the field; an absent number is accepted, a blank or null one is not.
        given = F.array_contains("_keys", "BN") if "_keys" in df.columns else F.lit(True)
        return [F.when(blank & F.coalesce(given, F.lit(False)), "BN is required")]
    return []


KNOWN_SOURCES = ("fed_grants", "cra_t3010", "cra_donees")


def checked(rows: DataFrame, source: str, batch_id: Column) -> DataFrame:
    """Rows with their hash and an ``_errors`` list, empty where the row is valid.

    A source without rules passes as it is. The hash of a parsed line covers all its fields, in name order.
    """
    payload = [c for c in rows.columns if c not in BRONZE_COLUMNS + PARSED_COLUMNS]
    row_hash = ids.row_hash(rows, payload)
    if "_raw" in rows.columns:
        whole = F.to_json(F.try_parse_json("_raw"))
        row_hash = F.sha2(F.coalesce(whole, F.col("_raw")), 256)
    errors: list[Column] = []
    if source in KNOWN_SOURCES:
        missing = F.trim(F.coalesce(F.col("_id").cast("string"), F.lit(""))) == ""
        errors = [F.when(missing, "_id is required"), *_source_errors(rows, source)]
    found = F.array_compact(F.array(*errors)) if errors else F.array().cast("array<string>")
    return rows.withColumns(
        {
            "_batch_id": batch_id,
            "_row_hash": row_hash,
            "_errors": found,
        }
    )


def valid_rows(rows: DataFrame) -> DataFrame:
    return (
        rows.filter(F.size("_errors") == 0)
        .drop("_errors")
        .withColumn("_bronze_validated_at", F.current_timestamp())
    )


def quarantine(rows: DataFrame, source: str) -> DataFrame:
    """Rejected rows as JSON, parsed lines as they came, with the reasons."""
    payload = sorted(c for c in rows.columns if c not in (*BRONZE_COLUMNS, *PARSED_COLUMNS, "_errors"))
    as_json = F.to_json(F.struct(*[F.col(f"`{c}`") for c in payload]), {"ignoreNullFields": "false"})
    return rows.filter(F.size("_errors") > 0).select(
        F.col("_batch_id").alias("batch_id"),
        F.lit(source).alias("source"),
        F.col("_id").cast("string").alias("external_id"),
        F.col("_row_hash").alias("row_hash"),
        (F.col("_raw") if "_raw" in rows.columns else as_json).alias("raw_row"),
        F.array_join("_errors", "; ").alias("error"),
    )


def ledger(rows: DataFrame, source: str) -> DataFrame:
    """Raw, valid and quarantined row counts per batch."""
    ok = F.size("_errors") == 0
    return rows.groupBy(F.col("_batch_id").alias("batch_id")).agg(
        F.lit(source).alias("source"),
        F.count("*").alias("raw_row_count"),
        F.count_if(ok).alias("valid_row_count"),
        F.count_if(~ok).alias("quarantined_row_count"),
    )


def source_progress(rows: DataFrame, source: str) -> DataFrame:
    """Cursor (largest numeric id) and row count of one batch."""
    return rows.agg(
        F.lit(source).alias("name"),
        F.max(F.col("_id").cast("string").try_cast("bigint")).alias("last_cursor"),
        F.count("*").alias("rows_added"),
        F.current_timestamp().alias("run_at"),
    )


def source_state(progress: DataFrame) -> DataFrame:
    """Last run, cursor (the newest known one) and running total per source."""
    return progress.groupBy("name").agg(
        F.max("run_at").alias("last_run_at"),
        F.max_by("last_cursor", F.when(F.col("last_cursor").isNotNull(), F.col("run_at"))).alias(
            "last_cursor"
        ),
        F.sum("rows_added").alias("rows_fetched_total"),
    )


def newest(rows: DataFrame, limit: int = 500) -> DataFrame:
    """The feed report: the ``limit`` rows with the highest numeric id."""
    return rows.orderBy(F.desc(F.col("_id").try_cast("bigint")), F.col("_id")).limit(limit)


def unseen(rows: DataFrame, seen: DataFrame, source: str) -> DataFrame:
    """Rows whose (source, external id) is not in ``seen``."""
    known = seen.filter(F.col("source") == source).select(F.col("external_id").alias("_id"))
    return rows.join(known, "_id", "left_anti")
