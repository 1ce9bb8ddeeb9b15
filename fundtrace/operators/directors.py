"""Directors of entities and who they have in common (Q2, Q14, Q25, G6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundtrace.functions import ids, names
from fundtrace.operators.entities import funded_ids, id_by_root, top
from fundtrace.session import checkpoint
from fundtrace.sources.warehouse import Warehouse

NAME = "director_name_normalized"


def named_filings(wh: Warehouse) -> DataFrame:
    """Director filings with a name (initials count) and its normalised form, which may be ``''``."""
    return wh.directors.filter(
        names.full_name_present(F.col("first_name"), F.col("initials"), F.col("last_name"))
    ).select(
        ids.bn_left(F.col("bn")).alias("bn_root"),
        names.director_norm(F.col("first_name"), F.col("last_name")).alias(NAME),
        F.year("fpe").alias("t3010_year"),
        ids.filing_row_id(F.col("bn"), F.col("fpe"), F.col("sequence_number")).alias("source_row_id"),
    )


def directors_for_org(wh: Warehouse, wanted: DataFrame | None = None) -> DataFrame:
    """Distinct (entity, name, year, filing row) for all entities or those in ``wanted``."""
    entities = id_by_root(wh.entities)
    if wanted is not None:
        # Stored, so that its size is known: few entities are sent to the filings.
        entities = checkpoint(entities.join(wanted.select("entity_id"), "entity_id", "left_semi"))
    return (
        named_filings(wh)
        .join(entities, "bn_root")
        .select("entity_id", NAME, "t3010_year", "source_row_id")
        .distinct()
    )


def name_entities(
    wh: Warehouse, active_only: bool = False, funded_only: bool = False
) -> DataFrame:
    """Distinct (name, entity). Yearly filings collapse per business number before the join."""
    entities = id_by_root(wh.active_entities if active_only else wh.entities)
    if funded_only:
        entities = entities.join(funded_ids(wh), "entity_id", "left_semi")
    return (
        named_filings(wh)
        .select(NAME, "bn_root")
        .distinct()
        .join(entities, "bn_root")
        .select(NAME, "entity_id", "bn_root")
        .distinct()
    )


def shared_director_counts(wh: Warehouse, min_orgs: int = 3, limit: int | None = 5000) -> DataFrame:
    """Names directing at least ``min_orgs`` (two at the least) funded, active entities."""
    counts = (
        name_entities(wh, active_only=True, funded_only=True)
        .groupBy(NAME)
        .agg(F.count("*").alias("org_count"))
        .filter(F.col("org_count") >= max(min_orgs, 2))
    )
    return top(counts, limit, F.desc("org_count"), NAME)


def shared_director_candidates(
    wh: Warehouse, min_orgs: int = 3, limit: int | None = 5000
) -> DataFrame:
    """The same names, one row per entity they direct, so no name's list sits in one row."""
    chosen = shared_director_counts(wh, min_orgs, limit)
    if limit is not None and limit <= 10_000:
        chosen = F.broadcast(chosen)
    return (
        name_entities(wh, active_only=True, funded_only=True)
        .join(chosen, NAME)
        .select(NAME, "org_count", "entity_id")
    )


def directors_bulk(wh: Warehouse, wanted: DataFrame, min_length: int = 5) -> DataFrame:
    """Distinct (entity, name) for the wanted entities, names of five letters or more."""
    # Stored, so that its size is known: few entities are sent to the filings.
    entities = checkpoint(
        id_by_root(wh.entities).join(wanted.select("entity_id").distinct(), "entity_id", "left_semi")
    )
    return (
        named_filings(wh)
        .filter(F.length(NAME) >= min_length)
        .join(entities, "bn_root")
        .select("entity_id", NAME)
        .distinct()
    )


def shared_by_all(wh: Warehouse, members: DataFrame) -> DataFrame:
    """(ring_id, name) for names directing every entity of a ring.

    ``members`` holds (ring_id, entity_id); an entity listed twice counts once.
    """
    distinct_members = members.select("ring_id", "entity_id").distinct()
    sizes = distinct_members.groupBy("ring_id").agg(F.count("*").alias("ring_size"))
    held = (
        distinct_members.join(
            directors_bulk(wh, distinct_members, min_length=1), "entity_id"
        )
        .groupBy("ring_id", NAME)
        .agg(F.count("*").alias("held"))
    )
    return held.join(sizes, "ring_id").filter("held = ring_size").select("ring_id", NAME)


def shared_by_two(wh: Warehouse, members: DataFrame) -> DataFrame:
    """(ring_id, name) for names on at least two members; a repeated member counts each time."""
    return (
        members.select("ring_id", "entity_id")
        .join(directors_bulk(wh, members), "entity_id")
        .groupBy("ring_id", NAME)
        .agg(F.count("*").alias("held"))
        .filter("held >= 2")
        .select("ring_id", NAME)
    )
