"""The funding edge table and what is computed straight from it (Q3, Q8, Q9, Q18, WN1)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundtrace.functions import ids
from fundtrace.operators.entities import id_by_root, top
from fundtrace.schemas import EDGE_COLUMNS
from fundtrace.session import checkpoint
from fundtrace.sources.warehouse import Warehouse


def current_grants(wh: Warehouse) -> DataFrame:
    """Latest amendment per reference number; rows without a number form one group.

    ``row_number() = 1`` keeps one row per task before the exchange, so the group without a
    number may be of any size.
    """
    if wh.has("agreement_current"):
        return wh.table("agreement_current")
    latest = Window.partitionBy("ref_number").orderBy(
        F.desc_nulls_last("amendment_number"), F.asc("_id")
    )
    return (
        wh.table("grants_contributions")
        .withColumn("_rn", F.row_number().over(latest))
        .filter("_rn = 1")
        .drop("_rn")
    )


def linked(wh: Warehouse, schema: str, table: str, key: str, key_type: str) -> DataFrame:
    """Source links into one table, with the key read from the link's JSON."""
    return wh.links.filter(
        (F.col("source_schema") == schema) & (F.col("source_table") == table)
    ).select(
        "entity_id",
        "match_method",
        "match_confidence",
        F.get_json_object("source_pk", f"$.{key}").try_cast(key_type).alias("_key"),
    )


def _mapped(amount, date, source, row_id) -> list:
    return [
        F.lit(None).cast("bigint").alias("from_entity_id"),
        F.col("entity_id").alias("to_entity_id"),
        amount.alias("amount"),
        date.cast("date").alias("date"),
        source.alias("source"),
        row_id.cast("string").alias("source_row_id"),
        F.col("match_method").alias("mapping_method"),
        F.coalesce("match_confidence", F.lit(1.0)).alias("confidence_score"),
    ]


def public_edges(wh: Warehouse, wanted: DataFrame | None = None) -> DataFrame:
    """Federal agreements and provincial grants, contracts and sole-source awards (to entities in ``wanted``)."""

    def links(*source: str) -> DataFrame:
        found = linked(wh, *source)
        if wanted is None:
            return found
        # Few links are stored, so that they are sent to the awards and no award is shuffled.
        return checkpoint(found.join(wanted.select("entity_id").distinct(), "entity_id", "left_semi"))

    grants = current_grants(wh).filter("agreement_value > 0")
    fed = (
        links("fed", "grants_contributions", "_id", "bigint")
        .join(grants, F.col("_key") == F.col("_id"))
        .select(
            *_mapped(
                F.col("agreement_value"),
                F.col("agreement_start_date"),
                F.when(F.col("agreement_type") == "C", "fed_contribution").otherwise("fed_grant"),
                F.col("_id"),
            )
        )
    )
    branches = [fed]
    for table, key_type, date, label in (
        ("ab_grants", "bigint", F.col("payment_date"), "ab_grant"),
        ("ab_contracts", "string", F.lit(None), "ab_contract"),
        ("ab_sole_source", "string", F.col("start_date"), "ab_sole_source"),
    ):
        awards = wh.table(table).filter("amount > 0")
        branches.append(
            links("ab", table, "id", key_type)
            .join(awards, F.col("_key") == F.col("id"))
            .select(*_mapped(F.col("amount"), date, F.lit(label), F.col("id")))
        )
    return reduce(DataFrame.unionByName, branches)


def gift_columns(gifts: DataFrame) -> DataFrame:
    return gifts.filter("total_gifts > 0 AND donee_bn IS NOT NULL").select(
        ids.bn_left(F.col("bn")).alias("src_root"),
        ids.bn_left(F.col("donee_bn")).alias("dst_root"),
        F.col("total_gifts").alias("amount"),
        F.col("fpe").alias("date"),
        ids.filing_row_id(F.col("bn"), F.col("fpe"), F.col("sequence_number")).alias("source_row_id"),
    )


def _roots(chosen: DataFrame) -> DataFrame:
    """Stored distinct business numbers of the entities ``chosen``: few are sent to the gifts instead of shuffling these.

    The filter, which all numbers pass, tells the optimizer that these may be few, so it reduces the gifts where they are read.
    """
    return checkpoint(id_by_root(chosen).select("bn_root").distinct()).filter("bn_root >= ''")


def gift_edges(wh: Warehouse, wanted: DataFrame | None = None) -> DataFrame:
    """Gifts with donor and donee mapped to entities, either of which may stay unmapped.

    With ``wanted`` only gifts from or to the business number of an entity in it.
    """
    src = id_by_root(wh.entities, "from_entity_id", "src_root")
    dst = id_by_root(wh.entities, "to_entity_id", "dst_root")
    gifts = gift_columns(wh.gifts)
    if wanted is not None:
        few = wanted.select(F.col("entity_id").alias("id")).distinct()
        roots = _roots(wh.entities.join(few, "id", "left_semi"))
        donors, donees = (roots.withColumnRenamed("bn_root", side) for side in ("src_root", "dst_root"))
        given = gifts.join(donors, "src_root", "left_semi")
        gifts = given.unionByName(gifts.join(donors, "src_root", "left_anti").join(donees, "dst_root", "left_semi"))
    return (
        gifts
        .join(src, "src_root", "left")
        .join(dst, "dst_root", "left")
        .filter("from_entity_id IS NOT NULL OR to_entity_id IS NOT NULL")
        .withColumns(
            {
                "source": F.lit("cra_gift"),
                "mapping_method": F.lit("authoritative"),
                "confidence_score": F.lit(1.0),
            }
        )
        .select(*EDGE_COLUMNS)
    )


def money_edges(wh: Warehouse, wanted: DataFrame | None = None) -> DataFrame:
    """Every money edge once. Gift edges ignore the status of their entities.

    With ``wanted`` all edges of the entities in it, and others of their business numbers; meant for few entities.
    """
    return gift_edges(wh, wanted).unionByName(public_edges(wh, wanted))


def by_entity(edges: DataFrame, direction: str = "both") -> DataFrame:
    """One copy of an edge per entity it belongs to; a self-gift gives two under ``both``."""
    copies = []
    if direction in ("both", "out"):
        copies.append(
            F.when(
                F.col("from_entity_id").isNotNull(),
                F.struct(F.col("from_entity_id").alias("entity_id"), F.lit("out").alias("role")),
            )
        )
    if direction in ("both", "in"):
        copies.append(
            F.when(
                F.col("to_entity_id").isNotNull(),
                F.struct(F.col("to_entity_id").alias("entity_id"), F.lit("in").alias("role")),
            )
        )
    return edges.select(F.inline(F.array_compact(F.array(*copies))), *EDGE_COLUMNS)


def funding_edges(
    wh: Warehouse, direction: str = "both", wanted: DataFrame | None = None
) -> DataFrame:
    """Edges of every entity (or of those in ``wanted``), keyed by ``entity_id`` and ``role``."""
    edges = money_edges(wh) if direction in ("both", "in") else gift_edges(wh)
    copies = by_entity(edges, direction)
    return copies if wanted is None else copies.join(wanted.select("entity_id"), "entity_id", "left_semi")


def ring_funding_edges(wh: Warehouse, members: DataFrame, limit: int | None = 2000) -> DataFrame:
    """Gifts with both ends among ``members.entity_id``, without self-gifts, largest first."""
    chosen = wh.entities.join(
        members.select(F.col("entity_id").alias("id")).distinct(), "id", "left_semi"
    )
    # Stored, so that its size is known: few members are sent to the gifts and cut them before any shuffle.
    chosen = checkpoint(chosen.select("id", "bn_root"))
    roots = _roots(chosen)
    inside = (
        gift_columns(wh.gifts)
        .join(roots.withColumnRenamed("bn_root", "src_root"), "src_root", "left_semi")
        .join(roots.withColumnRenamed("bn_root", "dst_root"), "dst_root", "left_semi")
        .join(id_by_root(chosen, "from_entity_id", "src_root"), "src_root")
        .join(id_by_root(chosen, "to_entity_id", "dst_root"), "dst_root")
        .filter("from_entity_id <> to_entity_id")
        .withColumns(
            {
                "source": F.lit("cra_gift"),
                "mapping_method": F.lit("authoritative"),
                "confidence_score": F.lit(1.0),
            }
        )
        .select(*EDGE_COLUMNS)
    )
    return top(
        inside, limit, F.desc("amount"), "source_row_id", "from_entity_id", "to_entity_id"
    )


def sole_source_flags(
    wh: Warehouse, limit: int | None = 5000, wanted: DataFrame | None = None
) -> DataFrame:
    """Awards per (entity, vendor) with repeat and splitting flags; zero amounts count too."""
    links = linked(wh, "ab", "ab_sole_source", "id", "string")
    if wanted is not None:
        links = links.join(wanted.select("entity_id"), "entity_id", "left_semi")
    small = F.count_if(F.col("amount").between(9_000, 100_000))
    flags = (
        links.join(wh.table("ab_sole_source"), F.col("_key") == F.col("id"))
        .groupBy("entity_id", F.col("vendor").alias("vendor_name"))
        .agg(
            F.count("*").alias("contract_count"),
            F.coalesce(F.sum("amount"), F.lit(0)).cast("double").alias("total_amount"),
            (F.count("*") >= 2).alias("repeat_vendor_flag"),
            (small >= 2).alias("splitting_flag"),
        )
    )
    return top(flags, limit, F.desc("total_amount"), "entity_id", "vendor_name")


def fed_concentration(wh: Warehouse) -> DataFrame:
    """HHI, department count and top share per entity; 0, 0, 0 without federal agreements.

    Sum of squared shares equals sum of squares over the squared sum, so two nested group-bys are
    enough. Agreements without a department count as one department.
    """
    by_dept = (
        linked(wh, "fed", "grants_contributions", "_id", "bigint")
        .join(current_grants(wh).filter("agreement_value > 0"), F.col("_key") == F.col("_id"))
        .groupBy("entity_id", "owner_org")
        .agg(F.sum("agreement_value").cast("double").alias("amount"))
    )
    total = F.sum("amount")
    shares = by_dept.groupBy("entity_id").agg(
        (F.sum(F.col("amount") * F.col("amount")) / (total * total)).alias("hhi_score"),
        F.count("*").alias("dept_count"),
        (F.max("amount") / total).alias("top_dept_share"),
    )
    return (
        wh.entities.select(F.col("id").alias("entity_id"))
        .join(shares, "entity_id", "left")
        .na.fill(0.0, ["hhi_score", "top_dept_share"])
        .na.fill(0, ["dept_count"])
    )
