"""Resolved feed rows to findings, and what is shown of them (ST7, ST9-ST11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundtrace.functions import values
from fundtrace.operators import rings as ring_ops
from fundtrace.operators.entities import top
from fundtrace.operators.resolve import MatchIndex
from fundtrace.session import checkpoint
from fundtrace.sources.warehouse import Warehouse

NOISE_BELOW = 1_000
PRIOR_FINDINGS = 2_000

# How a feed is called in a label.
SOURCE_LABELS = {
    "cra_donees": "CRA T1236 donees",
    "cra_t3010": "CRA T3010 directors",
    "fed_grants": "Federal grants",
}
SEVERITY_MARKS = {"urgent": "🔴", "review": "🟡", "info": "🔵"}


def feed_amount(rows: DataFrame, source: str) -> Column:
    """Amount a feed row stands for; unreadable or missing amounts count as zero."""
    if source == "fed_grants":
        return values.parse_amount(F.col("agreement_value"))
    if source == "cra_donees":
        fields = [c for c in ("Total Gifts", "total_gifts") if c in rows.columns]
        given = [F.nullif(F.col(f"`{c}`"), F.lit("")) for c in fields]
        return values.parse_amount(F.coalesce(*given))
    return F.lit(0.0)


def _text(rows: DataFrame, *columns: str) -> Column:
    present = [F.nullif(F.col(f"`{c}`"), F.lit("")) for c in columns if c in rows.columns]
    return F.coalesce(*present, F.lit(""))


def triggers(rows: DataFrame, source: str, order: str | None = None) -> DataFrame:
    """The last row per external id with its amount; tiny amounts are noise, zero is kept."""
    last = Window.partitionBy("external_id").orderBy(F.desc("_order"), F.desc("trigger_row_hash"))
    return (
        rows.filter("_id IS NOT NULL")
        .select(
            F.col("_id").cast("string").alias("external_id"),
            (F.lit(0) if order is None else F.col(order)).alias("_order"),
            F.col("_row_hash").alias("trigger_row_hash"),
            F.col("_batch_id").alias("batch_id"),
            feed_amount(rows, source).alias("amount"),
            _text(rows, "recipient_legal_name", "name").alias("trigger_name"),
        )
        .withColumn("_rn", F.row_number().over(last))
        .filter("_rn = 1")
        .filter(~((F.col("amount") > 0) & (F.col("amount") < NOISE_BELOW)))
        .drop("_rn", "_order")
    )


def analyze(
    wh: Warehouse,
    rows: DataFrame,
    resolved: DataFrame,
    index: MatchIndex,
    source: str,
    prior_ring_ids: DataFrame,
    order: str | None = None,
    limit: int | None = 5000,
) -> DataFrame:
    """One finding per ring that a resolved row touches, with the largest trigger.

    The best trigger is kept per match key, then per entity, then per ring, so no key, entity or
    ring ever carries all the rows that hit it.
    """
    best_first = F.struct(-F.col("amount"), F.col("external_id"))
    payload = F.struct(
        "external_id",
        "amount",
        "trigger_name",
        "trigger_row_hash",
        "batch_id",
        "mapping_method",
        "confidence_score",
    )
    per_key = (
        resolved.join(triggers(rows, source, order), "external_id")
        .select("*", F.inline("keys"))
        .groupBy("kind", "key")
        .agg(F.min_by(payload, best_first).alias("t"))
    )
    trigger_order = F.struct(-F.col("t.amount"), F.col("t.external_id"))
    per_entity = (
        per_key.join(index.entities, ["kind", "key"])
        .groupBy("entity_id")
        .agg(F.min_by("t", trigger_order).alias("t"))
    )
    rings = checkpoint(ring_ops.cycle_rings(wh, limit))
    members = ring_ops.ring_members(rings).select("ring_id", "entity_id").distinct()
    per_ring = (
        per_entity.join(members, "entity_id")
        .groupBy("ring_id")
        .agg(
            F.min_by(
                F.struct("entity_id", "t"),
                F.struct(-F.col("t.amount"), F.col("t.external_id"), F.col("entity_id")),
            ).alias("b")
        )
        .select("ring_id", F.col("b.entity_id").alias("seed"), "b.t.*")
    )
    touched = checkpoint(rings.join(per_ring, "ring_id"))
    named = ring_ops.with_member_names(wh, touched, prefix="")
    known = prior_ring_ids.select("ring_id").distinct().withColumn("_known", F.lit(True))
    others = F.filter("entity_ids", lambda e: e != F.col("seed"))
    ring_amount = F.col("total_amount")
    return named.join(known, "ring_id", "left").select(
        F.lit(source).alias("source"),
        F.when(F.col("_known"), "expanded_ring").otherwise("new_ring").alias("finding_type"),
        F.concat(F.array("seed"), others).alias("entity_ids"),
        "ring_id",
        F.col("external_id").alias("trigger_external_id"),
        values.finding_narrative(
            F.lit(source),
            F.col("amount"),
            F.col("trigger_name"),
            F.col("external_id"),
            F.col("ring_id"),
            ring_amount,
            F.col("canonical_names"),
        ).alias("narrative"),
        F.coalesce(F.nullif(ring_amount, F.lit(0.0)), "amount").alias("total_amount"),
        values.severity(F.greatest(ring_amount, "amount"), F.lit(1)).alias("severity"),
        "batch_id",
        "trigger_row_hash",
        "mapping_method",
        "confidence_score",
        F.lit("pending").alias("review_status"),
    )


def list_findings(findings: DataFrame, since: str | None = None, limit: int | None = 50) -> DataFrame:
    chosen = findings if since is None else findings.filter(F.col("created_at") >= F.lit(since).cast("timestamp"))
    return top(chosen, limit, F.desc("created_at"), "source", "ring_id")


def default_finding(findings: DataFrame) -> DataFrame:
    """The most severe finding, the newest of them."""
    return findings.orderBy(
        values.severity_rank(F.col("severity")), F.desc("created_at"), "source", "ring_id"
    ).limit(1)


def count_findings(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count("*").alias("n"))


def _by_word(table: dict[str, str], key: Column, otherwise: Column) -> Column:
    pairs = [F.lit(text) for item in table.items() for text in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), otherwise)


def rings_from_findings(findings: DataFrame, rings: DataFrame) -> DataFrame:
    """Ring payload of each finding: names and persons of the known ring, else placeholders."""
    known = rings.select(
        "ring_id",
        F.col("ring_type").alias("_type"),
        F.col("entity_ids").alias("_ids"),
        F.col("canonical_names").alias("_names"),
        F.col("shared_persons").alias("_persons"),
        F.lit(True).alias("_cached"),
    )
    placeholder = F.transform(
        "entity_ids", lambda e: F.concat(F.lit("Entity "), e.cast("string"))
    )
    return findings.join(known, "ring_id", "left").select(
        "ring_id",
        "source",
        "trigger_external_id",
        "severity",
        F.col("_type").alias("ring_type"),
        F.when(F.size("_ids") > 0, F.col("_ids")).otherwise(F.col("entity_ids")).alias("entity_ids"),
        F.when(F.col("_cached"), F.col("_names")).otherwise(placeholder).alias("canonical_names"),
        F.coalesce("_persons", F.array().cast("array<string>")).alias("shared_persons"),
        F.coalesce("total_amount", F.lit(0.0)).alias("total_amount"),
        F.array("finding_type").alias("flags"),
    )


def finding_labels(findings: DataFrame, rings: DataFrame) -> DataFrame:
    """Display label: severity mark, feed, amount and the first two names."""
    known = rings.select(
        "ring_id", F.filter("canonical_names", lambda n: n != "").alias("_names")
    )
    fallback = F.transform(
        F.slice("entity_ids", 1, 3), lambda e: F.concat(F.lit("Entity "), e.cast("string"))
    )
    names = F.when(F.size("_names") > 0, F.col("_names")).otherwise(fallback)
    preview = F.concat(
        F.array_join(F.slice(names, 1, 2), ", "),
        F.when(
            F.size(names) > 2,
            F.concat(F.lit(" (+"), (F.size(names) - 2).cast("string"), F.lit(" more)")),
        ).otherwise(""),
    )
    amount = F.when(
        F.col("total_amount") != 0, F.concat(F.lit("$"), F.format_number("total_amount", 0))
    ).otherwise("—")
    mark = _by_word(SEVERITY_MARKS, F.lower(F.coalesce("severity", F.lit("info"))), F.lit("⚪"))
    return findings.join(known, "ring_id", "left").select(
        "source",
        "ring_id",
        F.concat(
            mark,
            F.lit(" "),
            _by_word(SOURCE_LABELS, F.col("source"), F.coalesce("source", F.lit("source"))),
            F.lit(" · "),
            amount,
            F.lit(" · "),
            F.coalesce(F.nullif(preview, F.lit("")), "ring_id", F.lit("unknown ring")),
        ).alias("label"),
    )


def live_summary(findings: DataFrame, states: DataFrame) -> DataFrame:
    """Finding count, urgent count, sources that ran and the last run."""
    one = F.lit(1).alias("_k")
    return (
        findings.agg(
            F.count("*").alias("findings"),
            F.count_if(F.col("severity") == "urgent").alias("urgent"),
            one,
        )
        .join(
            states.agg(
                F.count_distinct(F.when(F.col("last_run_at").isNotNull(), F.col("name"))).alias(
                    "active_sources"
                ),
                F.max("last_run_at").alias("last_run_at"),
                one,
            ),
            "_k",
        )
        .drop("_k")
    )
