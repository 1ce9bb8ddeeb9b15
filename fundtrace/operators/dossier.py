"""Case dossier and crossover summary tables (CD1-CD4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundtrace.functions import ids, values
from fundtrace.operators import cycles, entities
from fundtrace.operators.rings import ring_members
from fundtrace.sources.warehouse import Warehouse


def entity_table(wh: Warehouse, rings: DataFrame, finding_source: F.Column | None = None) -> DataFrame:
    """Attributes, source-link total and badges of each ring's member entities."""
    live = F.lit(None).cast("string") if finding_source is None else finding_source
    listed = ring_members(rings).select("ring_id", "entity_id").distinct()
    wanted = listed.select("entity_id").distinct()
    # A handful of schemas per entity: the set stays tiny.
    linked = (
        entities.source_summary(wh, wanted)
        .groupBy("entity_id")
        .agg(
            F.sum("link_count").alias("links"),
            F.collect_set(F.lower(F.nullif("source_schema", F.lit("")))).alias("schemas"),
        )
    )
    schemas = F.coalesce("schemas", F.array().cast("array<string>"))
    return (
        listed.join(entities.entities_by_ids(wh, wanted), "entity_id")
        .join(linked, "entity_id", "left")
        .select(
            "ring_id",
            "entity_id",
            "canonical_name",
            "entity_type",
            F.array_join(F.transform("datasets", F.upper), ", ").alias("datasets"),
            F.coalesce(F.nullif("links", F.lit(0)), "source_link_count", F.lit(0)).alias(
                "source_links"
            ),
            F.array_join(values.source_badges(schemas, live), ", ").alias("badges"),
        )
    )


def header(wh: Warehouse, rings: DataFrame) -> DataFrame:
    """Flow and hops of each ring: from its cycle where it has one, else from the ring itself."""
    keyed = rings.select(
        "ring_id",
        F.col("total_amount").alias("_ring_amount"),
        ids.cycle_id_of_ring(F.col("ring_id")).alias("cycle_id"),
    )
    chosen = keyed.select("cycle_id").filter("cycle_id IS NOT NULL")
    counted = cycles.cycle_edges(wh, chosen).groupBy("cycle_id").agg(F.count("*").alias("n_edges"))
    summary = cycles.cycle_summary(wh).join(chosen, "cycle_id", "left_semi").drop("path_bns")
    return (
        keyed.join(summary, "cycle_id", "left")
        .join(counted, "cycle_id", "left")
        .select(
            "ring_id",
            F.coalesce(F.nullif("total_amount", F.lit(0.0)), "_ring_amount", F.lit(0.0)).alias(
                "cycle_flow"
            ),
            F.coalesce(
                F.nullif(F.col("hop_count").cast("bigint"), F.lit(0)), "n_edges", F.lit(0)
            ).alias("hops"),
            "min_year",
            "max_year",
        )
    )


def crossover_totals(table: DataFrame) -> DataFrame:
    """Pair count, both sums and the number of distinct directors, in one row."""
    people = table.select(F.explode("shared_directors").alias("d")).agg(
        F.count_distinct("d").alias("distinct_directors")
    )
    sums = table.agg(
        F.count("*").alias("pair_count"),
        F.coalesce(F.sum(F.col("total_grant_amount").cast("decimal(28,2)")), F.lit(0))
        .cast("double")
        .alias("total_grants"),
        F.coalesce(F.sum(F.col("total_contract_amount").cast("decimal(28,2)")), F.lit(0))
        .cast("double")
        .alias("total_contracts"),
    )
    # Two single-row frames side by side.
    one = F.lit(1)
    return sums.withColumn("_k", one).join(people.withColumn("_k", one), "_k").drop("_k")


def crossover_selector(table: DataFrame, limit: int = 50) -> DataFrame:
    """Labels of the first pairs by (contract, grant, charity, contractor)."""
    ranked = entities.top(
        table,
        limit,
        F.desc("total_contract_amount"),
        F.desc("total_grant_amount"),
        "charity_entity_id",
        "contractor_entity_id",
    )
    return ranked.select(
        "charity_entity_id",
        "contractor_entity_id",
        F.concat(
            F.coalesce("charity_name", F.lit("?")),
            F.lit(" ↔ "),
            F.coalesce("contractor_name", F.lit("?")),
            F.lit(" · $"),
            F.format_number(F.coalesce("total_contract_amount", F.lit(0.0)), 0),
            F.lit(" contract"),
        ).alias("label"),
    )


def ring_split(rings: DataFrame) -> DataFrame:
    """Which tab a ring belongs to: round-trip, shared person, or both."""
    return rings.select(
        "ring_id",
        (ids.ring_type(F.col("ring_type"), F.col("ring_id")) == "round_trip").alias("round_trip"),
        (F.size("shared_persons") > 0).alias("has_shared_person"),
    )
