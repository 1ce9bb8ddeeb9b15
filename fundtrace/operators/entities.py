"""Golden records: listing, lookup, related records, address clusters, counts (Q1, Q7, Q10, Q11, Q16, Q26)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundtrace.functions import ids, values
from fundtrace.sources.warehouse import Warehouse

PUBLIC_SCHEMAS = ("fed", "ab")


def id_by_root(entities: DataFrame, id_name: str = "entity_id", root_name: str = "bn_root") -> DataFrame:
    """The (root, id) pairs records are joined through; several ids may share a root."""
    return entities.filter(F.col("bn_root").isNotNull()).select(
        F.col("bn_root").alias(root_name), F.col("id").alias(id_name)
    )


def funded_ids(wh: Warehouse) -> DataFrame:
    """Entities with at least one federal or provincial source link."""
    return wh.links.filter(F.col("source_schema").isin(*PUBLIC_SCHEMAS)).select("entity_id").distinct()


def top(df: DataFrame, limit: int | None, *order) -> DataFrame:
    """Ordered rows, cut to the first ``limit`` where a report asks for that."""
    ordered = df.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)


def golden_records(
    wh: Warehouse, limit: int | None = None, dataset_filter: str | None = None
) -> DataFrame:
    counted = wh.links.groupBy("entity_id").agg(F.count("id").alias("counted"))
    chosen = wh.active_entities
    if dataset_filter is not None:
        chosen = chosen.filter(F.array_contains("dataset_sources", dataset_filter))
    listed = chosen.join(counted, chosen["id"] == counted["entity_id"], "left").select(
        F.col("id").alias("entity_id"),
        "canonical_name",
        F.coalesce("entity_type", F.lit("unknown")).alias("entity_type"),
        "bn_root",
        F.coalesce("bn_variants", F.array().cast("array<string>")).alias("bn_variants"),
        F.coalesce("aliases", F.lit("[]")).alias("aliases"),
        F.coalesce("dataset_sources", F.array().cast("array<string>")).alias("datasets"),
        F.coalesce("source_link_count", "counted", F.lit(0)).alias("source_link_count"),
    )
    return top(listed, limit, F.desc("source_link_count"), "entity_id")


def entities_by_ids(wh: Warehouse, wanted: DataFrame) -> DataFrame:
    """Attributes of the entities whose id is in the ``entity_id`` column of ``wanted``."""
    return (
        wh.entities.withColumnRenamed("id", "entity_id")
        .join(wanted.select("entity_id"), "entity_id", "left_semi")
        .select(
            "entity_id",
            "canonical_name",
            F.coalesce("entity_type", F.lit("unknown")).alias("entity_type"),
            "bn_root",
            F.coalesce("bn_variants", F.array().cast("array<string>")).alias("bn_variants"),
            F.coalesce("aliases", F.lit("[]")).alias("aliases"),
            F.coalesce("dataset_sources", F.array().cast("array<string>")).alias("datasets"),
            "source_link_count",
        )
    )


def source_summary(wh: Warehouse, wanted: DataFrame | None = None) -> DataFrame:
    links = wh.links
    if wanted is not None:
        links = links.join(wanted.select("entity_id"), "entity_id", "left_semi")
    return links.groupBy("entity_id", "source_schema", "source_table").agg(
        F.count("*").alias("link_count")
    )


def related_entities(wh: Warehouse) -> DataFrame:
    """One row per entry of an entity's related list, with the default type and confidence filled in."""
    entry = F.col("entry")
    return (
        wh.entities.select(
            F.col("id").alias("entity_id"),
            F.explode(values.json_array(F.col("related_entities"), "string")).alias("entry"),
        )
        .select(
            "entity_id",
            values.json_first(entry, "$.entity_id", "$.id").cast("bigint").alias("related_entity_id"),
            F.coalesce(
                values.json_first(entry, "$.relationship_type", "$.type"), F.lit("RELATED")
            ).alias("relationship_type"),
            F.coalesce(
                values.json_first(entry, "$.confidence_score", "$.confidence").cast("double"),
                F.lit(1.0),
            ).alias("confidence_score"),
            F.col("entry").alias("evidence"),
        )
    )


def address_clusters(
    wh: Warehouse, min_rows: int = 3, limit: int | None = 5000, wanted: DataFrame | None = None
) -> DataFrame:
    """Funded entities at a (postal code, city) that at least ``min_rows`` address rows name."""
    at = F.explode(
        values.json_array(F.col("addresses"), "struct<postal_code:string,city:string>")
    ).alias("a")
    rows = (
        wh.entities.select(F.col("id").alias("entity_id"), at)
        .select(
            "entity_id",
            F.lower(F.trim("a.postal_code")).alias("postal"),
            F.lower(F.trim("a.city")).alias("city"),
        )
        .filter(F.col("postal").isNotNull() & F.col("city").isNotNull())
    )
    # Rows are counted per entity first, so a crowded address shuffles one row per entity.
    per_entity = rows.groupBy("postal", "city", "entity_id").agg(F.count("*").alias("n"))
    sizes = (
        per_entity.groupBy("postal", "city")
        .agg(F.sum("n").alias("cluster_size"))
        .filter(F.col("cluster_size") >= min_rows)
    )
    members = per_entity.join(funded_ids(wh), "entity_id", "left_semi")
    if wanted is not None:
        members = members.join(wanted.select("entity_id"), "entity_id", "left_semi")
    found = members.join(sizes, ["postal", "city"]).select("entity_id", "cluster_size").distinct()
    return top(found, limit, F.desc("cluster_size"), "entity_id")


def smoke_counts(wh: Warehouse) -> DataFrame:
    """One row of four counts over the whole warehouse."""
    d = wh.directors.select(
        F.lower(F.trim(F.concat_ws(" ", "first_name", "initials", "last_name"))).alias("name"),
        ids.bn_left(F.col("bn")).alias("bn_root"),
    ).distinct()
    busy = (
        d.join(id_by_root(wh.entities), "bn_root")
        .select("name", "entity_id")
        .distinct()
        .groupBy("name")
        .count()
        .filter("count >= 3")
        .agg(F.count("*").alias("n"))
        .select(F.lit("directors_with_3_plus_orgs").alias("what"), "n")
    )

    def counted(what: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")

    parts = [
        counted("golden_records", wh.entities),
        busy,
        counted("precomputed_cycles", wh.loops),
        counted("funding_edges", wh.gifts.filter("total_gifts > 0")),
        counted("funding_edges", wh.table("grants_contributions").filter("agreement_value > 0")),
        *[
            counted("funding_edges", wh.table(name).filter("amount > 0"))
            for name in ("ab_grants", "ab_contracts", "ab_sole_source")
        ],
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    # At most eight one-row counts reach this pivot.
    return union.groupBy().agg(
        *[
            F.coalesce(F.sum(F.when(F.col("what") == what, F.col("n"))), F.lit(0)).alias(what)
            for what in (
                "golden_records",
                "directors_with_3_plus_orgs",
                "funding_edges",
                "precomputed_cycles",
            )
        ]
    )


def alias_rows(entities: DataFrame) -> DataFrame:
    """(entity_id, alias) with the alias as VARIANT, one row per list entry."""
    return entities.select(
        F.col("id").alias("entity_id"),
        F.explode(F.from_json("aliases", "array<variant>")).alias("alias"),
    )


def named(df: DataFrame, wh: Warehouse, id_column: str, name_column: str) -> DataFrame:
    """Add the canonical name of ``id_column``, falling back to ``Entity <id>``."""
    lookup = wh.entities.select(F.col("id").alias(id_column), F.col("canonical_name").alias("_n"))
    return (
        df.join(lookup, id_column, "left")
        .withColumn(name_column, ids.entity_label(F.col("_n"), F.col(id_column)))
        .drop("_n")
    )

