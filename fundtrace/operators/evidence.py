"""Raw source rows behind edges, as JSON (Q12)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundtrace.operators.cycles import cycle_edge_evidence
from fundtrace.session import checkpoint
from fundtrace.sources.warehouse import Warehouse

# Edge source -> (shown table name, warehouse table, key column).
KEYED = {
    "fed_grant": ("fed.grants_contributions", "grants_contributions", "_id"),
    "fed_contribution": ("fed.grants_contributions", "grants_contributions", "_id"),
    "ab_grant": ("ab.ab_grants", "ab_grants", "id"),
    "ab_contract": ("ab.ab_contracts", "ab_contracts", "id"),
    "ab_sole_source": ("ab.ab_sole_source", "ab_sole_source", "id"),
}
FILED = {
    "cra_gift": ("cra.cra_qualified_donees", "cra_qualified_donees"),
    "cra_director": ("cra.cra_directors", "cra_directors"),
}


def _packed(df: DataFrame) -> F.Column:
    """The whole row as one column; it becomes JSON only where a request has found it."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_whole")


def _row_json() -> F.Column:
    return F.to_json("_whole", {"ignoreNullFields": "false"})


def _smallest(found: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """One row a request: the smallest JSON text of those its key has.

    Grouping by the join's keys too lets the rows stay where the join put them, so no JSON text is shuffled. A request has
    one value of each key.
    """
    return (
        found.groupBy(*dict.fromkeys([*keys, "source", "source_row_id"]))
        .agg(F.min(_row_json()).alias("row"))
        .select("source", "source_row_id", F.lit(label).alias("table_name"), "row")
    )


def evidence_for_edges(wh: Warehouse, requests: DataFrame) -> DataFrame:
    """The source row of each (source, source_row_id) request.

    Where several rows carry one key the smallest JSON text is given. Requests of an unknown source
    or without a row give nothing.
    """
    # Read once per source table below.
    wanted = checkpoint(requests.select("source", "source_row_id").distinct())
    parts = F.split("source_row_id", r"\|")
    found = []
    filed = ["bn", "fpe", "sequence_number"]
    for source, (label, table) in FILED.items():
        rows = wh.table(table)
        keys = (
            wanted.filter((F.col("source") == source) & (F.size(parts) >= 3))
            .select(
                "source",
                "source_row_id",
                parts[0].alias("bn"),
                parts[1].try_cast("date").alias("fpe"),
                parts[2].try_cast("bigint").alias("sequence_number"),
            )
        )
        found.append(_smallest(rows.select(*filed, _packed(rows)).join(keys, filed), label, filed))
    pairs = (
        wanted.filter((F.col("source") == "cra_gift") & (F.size(parts) == 2))
        .select(
            "source",
            "source_row_id",
            parts[0].alias("cycle_id"),
            parts[1].try_cast("int").alias("edge_order"),
        )
    )
    found.append(
        pairs.join(cycle_edge_evidence(wh), ["cycle_id", "edge_order"])
        .groupBy("cycle_id", "edge_order", "source", "source_row_id", "table_name")
        .agg(F.min("row").alias("row"))
        .select("source", "source_row_id", "table_name", "row")
    )
    for label, table, key in sorted(set(KEYED.values())):
        sources = [s for s, spec in KEYED.items() if spec[1] == table]
        rows = wh.table(table)
        keyed = rows.select(F.col(key).cast("string").alias("source_row_id"), _packed(rows))
        found.append(_smallest(wanted.filter(F.col("source").isin(sources)).join(keyed, "source_row_id"), label, ["source_row_id"]))
    return reduce(DataFrame.unionByName, found)
