"""Risk rules and scores (RU1-RU5, SC1, SC4)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


from fundtrace.operators import cycles, directors, edges, entities
from fundtrace.operators.directors import NAME
from fundtrace.operators.rings import DIRECTOR_FLAG, ROUND_TRIP
from fundtrace.session import checkpoint
from fundtrace.sources.warehouse import Warehouse

CONCENTRATED = "Concentrated funding sources"
SOLE_SOURCE = "Sole-source pattern"
RELATED = "Funding flows to related entity"

# Weight, order and label of each rule.
RULES = {
    "funding_concentration": (0.30, 1, CONCENTRATED),
    "cycle_member": (0.40, 2, ROUND_TRIP),
    "shared_director": (0.30, 3, DIRECTOR_FLAG),
    "sole_source": (0.35, 4, SOLE_SOURCE),
    "related_entity": (0.25, 5, RELATED),
}


# Cycles, director names and sole-source rows a score looks at by default.
LARGEST = 5_000


def _evidence(rows: DataFrame, rule: str, source, row_id, method=None, confidence=None) -> DataFrame:
    weight, order, label = RULES[rule]
    return rows.select(
        "entity_id",
        F.lit(rule).alias("rule"),
        F.lit(order).alias("rule_order"),
        F.lit(weight).cast("decimal(4,2)").alias("weight"),
        F.lit(label).alias("label"),
        source.alias("source"),
        row_id.cast("string").alias("source_row_id"),
        (F.lit("authoritative") if method is None else method).alias("mapping_method"),
        (F.lit(1.0) if confidence is None else confidence).alias("confidence_score"),
    )


def rule_funding_concentration(wh: Warehouse) -> DataFrame:
    hit = edges.fed_concentration(wh).filter("hhi_score > 0.5")
    return _evidence(
        hit, "funding_concentration", F.lit("fed_concentration"), F.col("entity_id"),
        F.lit(None).cast("string"), F.lit(None).cast("double"),
    )


def _largest_cycle_members(wh: Warehouse, limit: int | None) -> DataFrame:
    few = limit is not None and limit <= cycles.BROADCAST_LOOPS
    return cycles.members(wh, cycles.top_cycles(wh, limit), bounded=few)


def rule_cycle_member(wh: Warehouse, limit: int | None = LARGEST) -> DataFrame:
    """One evidence row per cycle an entity is in, among the ``limit`` largest; None takes all."""
    hit = (
        _largest_cycle_members(wh, limit)
        .select("entity_id", "cycle_id")
        .distinct()
    )
    return _evidence(hit, "cycle_member", F.lit("cra_cycle"), F.col("cycle_id"))


def rule_shared_director(wh: Warehouse, min_orgs: int = 3, limit: int | None = LARGEST) -> DataFrame:
    """One evidence row per director filing whose name is among the ``limit`` first candidates."""
    chosen = directors.shared_director_counts(wh, min_orgs, limit)
    if limit is not None and limit <= cycles.BROADCAST_LOOPS:
        chosen = F.broadcast(chosen)
    hit = directors.directors_for_org(wh).join(chosen, NAME)
    return _evidence(hit, "shared_director", F.lit("cra_director"), F.col("source_row_id"))


def rule_sole_source(wh: Warehouse) -> DataFrame:
    hit = edges.sole_source_flags(wh, limit=None).filter("repeat_vendor_flag OR splitting_flag")
    return _evidence(hit, "sole_source", F.lit("ab_sole_source"), F.col("entity_id"))


def rule_related_entity(wh: Warehouse) -> DataFrame:
    """Edges of an entity that lead to or from a related one.

    An entity that lists itself sees all its edges count. A null related id matches nothing.
    """
    related = (
        entities.related_entities(wh)
        .filter("related_entity_id IS NOT NULL")
        .select("entity_id", "related_entity_id")
        .distinct()
    )
    lists_itself = related.filter("entity_id = related_entity_id").select(
        "entity_id", F.lit(True).alias("_self")
    )
    # Few entities list others: their edges are looked up, the rest are never copied per entity.
    listing = related.select("entity_id").distinct()
    copies = edges.funding_edges(wh).join(listing, "entity_id", "left_semi").withColumn(
        "related_entity_id",
        F.when(F.col("role") == "out", F.col("to_entity_id")).otherwise(F.col("from_entity_id")),
    )
    hit = (
        copies
        .join(related.withColumn("_other", F.lit(True)), ["entity_id", "related_entity_id"], "left")
        .join(lists_itself, "entity_id", "left")
        .filter("_other OR _self")
    )
    return _evidence(
        hit, "related_entity", F.col("source"), F.col("source_row_id"),
        F.col("mapping_method"), F.col("confidence_score"),
    )


def all_evidence(wh: Warehouse, limit: int | None = LARGEST) -> DataFrame:
    """Evidence of all five rules, one row per finding; ``limit`` bounds cycles and director names."""
    return reduce(
        DataFrame.unionByName,
        [
            rule_funding_concentration(wh),
            rule_cycle_member(wh, limit),
            rule_shared_director(wh, limit=limit),
            rule_sole_source(wh),
            rule_related_entity(wh),
        ],
    )


def score_entities(evidence: DataFrame) -> DataFrame:
    """Capped score, flags in rule order and evidence count per entity.

    Evidence is counted per rule first, so an entity shuffles five rows at most.
    """
    per_rule = evidence.groupBy("entity_id", "rule_order", "weight", "label").agg(
        F.count("*").alias("n")
    )
    return per_rule.groupBy("entity_id").agg(
        F.least(F.sum("weight"), F.lit(1)).cast("double").alias("total_score"),
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("rule_order", "label"))), lambda f: f["label"]
            ),
            ", ",
        ).alias("flags_csv"),
        F.sum("n").alias("evidence_count"),
    )


def candidate_entities(wh: Warehouse, limit: int | None = LARGEST) -> DataFrame:
    """Members of the largest cycles, of shared-director candidates and of sole-source vendors' clients."""
    return (
        _largest_cycle_members(wh, limit)
        .select("entity_id")
        .unionByName(directors.shared_director_candidates(wh, 3, limit).select("entity_id"))
        .unionByName(edges.sole_source_flags(wh, limit).select("entity_id"))
        .distinct()
    )


def score_all(wh: Warehouse, top_n: int | None = 200, limit: int | None = LARGEST) -> DataFrame:
    """The ``top_n`` best-scored candidates with their names.

    ``limit`` bounds the cycles, director names and sole-source rows that are looked at; None lifts it.
    """
    # Read by every rule: evidence is only gathered for candidates.
    wanted = checkpoint(candidate_entities(wh, limit))
    evidence = all_evidence(wh, limit).join(wanted, "entity_id", "left_semi")
    scored = score_entities(evidence)
    lookup = wh.entities.select(F.col("id").alias("entity_id"), "canonical_name")
    named = (
        scored.filter("total_score > 0")
        .join(lookup, "entity_id", "left")
        .select(
            "entity_id",
            F.coalesce("canonical_name", F.col("entity_id").cast("string")).alias("canonical_name"),
            "total_score",
            "flags_csv",
            "evidence_count",
        )
    )
    return entities.top(named, top_n, F.desc("total_score"), "entity_id")


def node_scores(nodes: DataFrame, rings: DataFrame, top_n: int = 10) -> DataFrame:
    """Per ring the ``top_n`` non-person nodes by their own score, else the ring's if a member, else 0.

    ``nodes`` holds (ring_id, node_id, canonical_name, entity_type, total_score).
    """
    members = rings.select(
        "ring_id",
        F.explode(F.array_distinct("entity_ids").cast("array<string>")).alias("node_id"),
        F.col("total_score").alias("ring_score"),
    )
    rank = Window.partitionBy("ring_id").orderBy(F.desc("score"), F.asc("node_id"))
    return (
        nodes.filter("entity_type <> 'person'")
        .join(members, ["ring_id", "node_id"], "left")
        .withColumn("score", F.coalesce("total_score", "ring_score", F.lit(0.0)))
        .withColumn("_rn", F.row_number().over(rank))
        .filter(F.col("_rn") <= top_n)
        .select("ring_id", "node_id", "canonical_name", "entity_type", "score")
    )


