"""Charity filing checks: compensation share and gifts to non-qualified donees (Q15, Q17)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundtrace.functions import ids, values
from fundtrace.operators.entities import funded_ids, id_by_root, top
from fundtrace.sources.warehouse import Warehouse

SINCE = dt.date(2022, 1, 1)


def high_overhead(
    wh: Warehouse,
    since: dt.date = SINCE,
    limit: int | None = 2000,
    wanted: DataFrame | None = None,
) -> DataFrame:
    """Filings paying out over half of their spending, of funded entities or loop members."""
    in_loops = wh.table("loop_participants").select(ids.bn_left(F.col("bn")).alias("bn_root")).distinct()
    roots = id_by_root(wh.entities)
    suspects = (
        funded_ids(wh)
        .unionByName(roots.join(in_loops, "bn_root", "left_semi").select("entity_id"))
        .distinct()
    )
    entities = roots.join(suspects, "entity_id", "left_semi")
    if wanted is not None:
        entities = entities.join(wanted.select("entity_id"), "entity_id", "left_semi")
    share = values.safe_ratio(F.col("field_390"), F.col("field_5100"))
    paid = wh.table("cra_compensation").filter((F.col("fpe") >= F.lit(since)) & (F.col("field_390") > 0))
    spent = wh.table("cra_financial_details").filter("field_5100 > 0 AND field_5100 < 100000000")
    filings = (
        paid.join(spent, ["bn", "fpe"])
        .filter(share > 0.5)
        .withColumn("fiscal_year", F.year("fpe"))
        .join(wh.table("cra_identification"), ["bn", "fiscal_year"])
        .withColumn("bn_root", ids.bn_left(F.col("bn")))
    )
    found = filings.join(entities, "bn_root").select(
        "entity_id",
        "legal_name",
        F.col("field_5100").cast("double").alias("total_expenditures"),
        F.col("field_390").cast("double").alias("total_compensation"),
        F.round(share * 100, 1).cast("double").alias("comp_pct"),
    )
    return top(
        found, limit, F.desc("comp_pct"), "entity_id", "total_expenditures", "total_compensation"
    )


def nonqualified_donees(
    wh: Warehouse,
    since: dt.date = SINCE,
    limit: int | None = 2000,
    wanted: DataFrame | None = None,
) -> DataFrame:
    """Entities with two or more cash grants to non-qualified donees; totals per number first."""
    entities = id_by_root(wh.entities)
    if wanted is not None:
        entities = entities.join(wanted.select("entity_id"), "entity_id", "left_semi")
    totals = (
        _cash_grants(wh, since)
        .groupBy("bn_root")
        .agg(F.count("*").alias("grant_count"), F.sum("cash_amount").alias("total"))
        .filter("grant_count >= 2")
    )
    found = totals.join(entities, "bn_root").select(
        "entity_id", "bn_root", "grant_count", F.col("total").cast("double").alias("total_cash")
    )
    return top(found, limit, F.desc("total_cash"), "entity_id")


def nonqualified_recipients(
    wh: Warehouse,
    since: dt.date = SINCE,
    limit: int | None = 2000,
    wanted: DataFrame | None = None,
) -> DataFrame:
    """The same entities, one row per distinct recipient name; null where no name is known."""
    flagged = nonqualified_donees(wh, since, limit, wanted)
    if limit is not None and limit <= 10_000:
        flagged = F.broadcast(flagged)
    recipients = (
        _cash_grants(wh, since)
        .filter("recipient_name IS NOT NULL")
        .join(flagged.select("bn_root"), "bn_root", "left_semi")
        .select("bn_root", "recipient_name")
        .distinct()
    )
    return flagged.join(recipients, "bn_root", "left").select(
        "entity_id", "grant_count", "total_cash", "recipient_name"
    )


def _cash_grants(wh: Warehouse, since: dt.date) -> DataFrame:
    return (
        wh.table("cra_non_qualified_donees")
        .filter((F.col("fpe") >= F.lit(since)) & (F.col("cash_amount") > 0))
        .select(ids.bn_left(F.col("bn")).alias("bn_root"), "cash_amount", "recipient_name")
    )
