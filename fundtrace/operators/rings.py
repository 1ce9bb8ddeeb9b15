"""Ring payloads: related-party rings, neighbourhoods, prewarmed and ranked rings (G8-G10, SC3).

A report starts from a fixed number of cycles and director pairs (200 and 200 at most by default)
and is stored once it is formed. How many entities share a business number is not bounded, so member
lists carry no broadcast hint: the size of the stored report decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundtrace.functions import ids, names, values
from fundtrace.operators import cycles, directors, pairs
from fundtrace.operators.directors import NAME
from fundtrace.operators.edges import ring_funding_edges
from fundtrace.operators.entities import top
from fundtrace.session import checkpoint
from fundtrace.sources.warehouse import Warehouse

ROUND_TRIP = "Round-trip funding (CRA-confirmed)"
DIRECTOR_FLAG = "Director controls multiple funded entities"

_STRINGS = "array<string>"


def ring_members(rings: DataFrame) -> DataFrame:
    """(ring_id, ord, entity_id), one row per listed member."""
    return rings.select("ring_id", F.posexplode("entity_ids").alias("ord", "entity_id"))


def with_member_names(wh: Warehouse, rings: DataFrame, prefix: str) -> DataFrame:
    """Add ``canonical_names`` in member order; an unknown id shows as ``prefix`` + id."""
    listed = ring_members(rings)
    wanted = listed.select(F.col("entity_id").alias("id")).distinct()
    lookup = wh.entities.join(wanted, "id", "left_semi").select(
        F.col("id").alias("entity_id"), "canonical_name"
    )
    named = (
        listed.join(lookup, "entity_id", "left")
        .withColumn(
            "name",
            F.coalesce(
                F.nullif("canonical_name", F.lit("")),
                F.concat(F.lit(prefix), F.col("entity_id").cast("string")),
            ),
        )
        .groupBy("ring_id")
        .agg(F.sort_array(F.collect_list(F.struct("ord", "entity_id", "name"))).alias("m"))
        .select("ring_id", F.col("m.name").alias("canonical_names"))
    )
    return rings.join(named, "ring_id", "left").withColumn(
        "canonical_names", F.coalesce("canonical_names", F.array().cast(_STRINGS))
    )


def with_shared(rings: DataFrame, shared: DataFrame) -> DataFrame:
    """Add ``shared_persons`` from (ring_id, name) rows."""
    lists = shared.groupBy("ring_id").agg(
        F.sort_array(F.collect_set(NAME)).alias("shared_persons")
    )
    return rings.join(lists, "ring_id", "left").withColumn(
        "shared_persons", F.coalesce("shared_persons", F.array().cast(_STRINGS))
    )


def _evidence(source: str, row_id) -> F.Column:
    return F.array(
        F.struct(
            F.lit(source).alias("source"),
            row_id.cast("string").alias("source_row_id"),
            F.lit("authoritative").alias("mapping_method"),
            F.lit(1.0).alias("confidence_score"),
        )
    )


def cycle_rings(wh: Warehouse, limit: int | None) -> DataFrame:
    """The largest cycles as rings, those with fewer than two member entities left out."""
    return (
        cycles.precomputed_cycles(wh, limit=limit)
        .filter(F.size("entity_ids") >= 2)
        .select(
            ids.cycle_ring_id(F.col("cycle_id")).alias("ring_id"),
            F.lit("round_trip").alias("ring_type"),
            "entity_ids",
            "total_amount",
            _evidence("cra_gift", F.col("cycle_id")).alias("evidence"),
            F.array(F.lit("cra")).alias("datasets_touched"),
        )
    )


def pair_rings(table: DataFrame) -> DataFrame:
    """The stored director pairs as rings of two."""
    name = F.trim(F.coalesce(NAME, F.lit("")))
    return table.select(
        ids.pair_ring_id(name, F.col("entity_id_a"), F.col("entity_id_b")).alias("ring_id"),
        F.lit("shared_director").alias("ring_type"),
        F.array("entity_id_a", "entity_id_b").alias("entity_ids"),
        "total_amount",
        _evidence("cra_director_funding", F.col("source_row_id")).alias("evidence"),
        F.array(F.lit("cra")).alias("datasets_touched"),
        F.array("name_a", "name_b").alias("canonical_names"),
        F.when(name != "", F.array(name)).otherwise(F.array().cast(_STRINGS)).alias("shared_persons"),
        F.array(F.lit(DIRECTOR_FLAG)).alias("flags"),
    )


def find_related_party_rings(
    wh: Warehouse,
    min_total_amount: float = 50_000,
    head: int = 200,
    director_pairs: DataFrame | None = None,
) -> DataFrame:
    """Rings from the ``head`` largest cycles and from director pairs, one per member set.

    The amount filter applies after the head. Of two rings with the same members the larger stays,
    the cycle on a tie. Rings made up of large institutions only are dropped.
    """
    rings = checkpoint(cycle_rings(wh, head).filter(F.col("total_amount") >= min_total_amount))
    from_cycles = with_shared(
        with_member_names(wh, rings, prefix=""),
        directors.shared_by_all(wh, ring_members(rings)),
    ).withColumn("flags", F.array(F.lit(ROUND_TRIP)))
    table = pairs.director_rings_table(wh) if director_pairs is None else director_pairs
    from_pairs = pair_rings(table.filter(F.col("total_amount") >= min_total_amount))
    best = Window.partitionBy("_key").orderBy(
        F.desc("total_amount"), F.asc("ring_type"), F.asc("ring_id")
    )
    return (
        from_cycles.unionByName(from_pairs)
        .withColumn("_key", F.array_join(F.array_sort("entity_ids"), ","))
        .withColumn("_rn", F.row_number().over(best))
        .filter("_rn = 1")
        .drop("_key", "_rn")
        .filter(~names.all_large_institutions(F.col("canonical_names")))
        .orderBy(F.desc("total_amount"), "ring_id")
    )


def analyze_neighborhood(
    wh: Warehouse, seeds: DataFrame, min_total_amount: float = 0.0, limit: int | None = 5000
) -> DataFrame:
    """Cycles that touch any of ``seeds.entity_id`` and which seeds those are."""
    rings = checkpoint(cycle_rings(wh, limit).filter(F.col("total_amount") >= min_total_amount))
    # A seed counts once however often it is given.
    touched = (
        seeds.select("entity_id")
        .distinct()
        .join(ring_members(rings), "entity_id")
        .groupBy("ring_id")
        .agg(F.sort_array(F.collect_set("entity_id")).alias("seeds_touched"))
    )
    found = checkpoint(rings.join(touched, "ring_id"))
    return with_member_names(wh, found, prefix="").orderBy(
        F.desc("total_amount"), "ring_id"
    )


def prewarmed_rings(wh: Warehouse, head: int = 80, keep: int = 30) -> DataFrame:
    """The demo report: top cycles with names on at least two members, scored and ranked."""
    listed = checkpoint(cycle_rings(wh, head))
    rings = with_member_names(wh, listed, prefix="Entity ").filter(
        ~names.all_large_institutions(F.col("canonical_names"))
    )
    shared = directors.shared_by_two(wh, ring_members(listed))
    has_shared = F.size("shared_persons") > 0
    scored = with_shared(rings, shared).withColumns(
        {
            "total_score": values.ring_score(F.col("total_amount"), has_shared),
            "flags": F.when(has_shared, F.array(F.lit(ROUND_TRIP), F.lit(DIRECTOR_FLAG))).otherwise(
                F.array(F.lit(ROUND_TRIP))
            ),
        }
    )
    return top(scored, keep, F.desc(has_shared), F.desc("total_amount"), "ring_id")


def edges_inside(rings: DataFrame, edges: DataFrame) -> DataFrame:
    """(ring_id, edge) for edges with both ends among the ring's members."""
    listed = ring_members(rings).select("ring_id", "entity_id").distinct()
    at_from = listed.withColumnRenamed("entity_id", "from_entity_id")
    at_to = listed.withColumnRenamed("entity_id", "to_entity_id")
    return edges.join(at_from, "from_entity_id").join(at_to, ["ring_id", "to_entity_id"])


def top_rings(wh: Warehouse, n: int = 20, rings: DataFrame | None = None, gift_limit: int | None = 2000) -> DataFrame:
    """Rings with the gifts inside them as evidence, scored; the ``n`` best by score and amount.

    Evidence comes from the ``gift_limit`` largest gifts among all rings' members (``None``: all gifts).
    """
    rings = checkpoint(find_related_party_rings(wh) if rings is None else rings)
    gifts = ring_funding_edges(wh, ring_members(rings), gift_limit)
    edge = F.struct(
        F.col("from_entity_id"),
        F.col("to_entity_id"),
        F.col("amount").cast("double").alias("amount"),
        F.col("date"),
        F.col("source"),
        F.col("source_row_id"),
        F.col("mapping_method"),
        F.col("confidence_score"),
    )
    # With a limit the gift report is that long at most, and so is a ring's list.
    inside = (
        edges_inside(rings, gifts)
        .groupBy("ring_id")
        .agg(F.sort_array(F.collect_list(edge)).alias("funding_edges"))
    )
    listed = F.transform(
        "funding_edges",
        lambda e: F.struct(
            e["source"].alias("source"),
            e["source_row_id"].alias("source_row_id"),
            e["mapping_method"].alias("mapping_method"),
            e["confidence_score"].alias("confidence_score"),
        ),
    )
    scored = rings.join(inside, "ring_id", "left").withColumns(
        {
            "evidence": F.coalesce(listed, F.col("evidence")),
            "total_score": values.ring_score(
                F.col("total_amount"), F.size("shared_persons") > 0
            ),
        }
    )
    return top(scored, n, F.desc("total_score"), F.desc("total_amount"), "ring_id")
