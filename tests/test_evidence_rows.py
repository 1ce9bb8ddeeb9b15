"""Evidence keeps the smallest row of a key and shuffles no JSON text."""

from __future__ import annotations

import datetime as dt
import json
import re
from decimal import Decimal

import fixtures
from fundtrace.operators import evidence, graph
from fundtrace.sources.warehouse import Warehouse


def test_smallest_row_of_each_request_without_a_shuffle_of_rows(spark):
    day = dt.date(2000, 1, 1)
    gifts = [("1", day, 1, "2", 9), ("1", day, 1, "2", 5), ("1", day, 2, None, 7), ("3", None, None, "4", 1)]
    grants = [(10, "b"), (10, "a"), (11, "c")]
    wh = Warehouse(
        spark,
        {
            "cra_qualified_donees": spark.createDataFrame([(*g[:4], Decimal(g[4])) for g in gifts], "bn string, fpe date, sequence_number long, donee_bn string, total_gifts decimal(18,2)"),
            "grants_contributions": spark.createDataFrame(grants, "_id long, ref_number string"),
        },
    )
    asked = [("cra_gift", "1|2000-01-01|1"), ("cra_gift", "1|2000-1-1|1"), ("cra_gift", "1|2000-01-01|1"), ("cra_gift", "1|2000-01-01|2")]
    asked += [("cra_gift", "3||"), ("cra_gift", "9|2000-01-01|1"), ("fed_grant", "10"), ("fed_contribution", "10"), ("ab_grant", "10"), ("none", "10")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = evidence.evidence_for_edges(wh, spark.createDataFrame(asked, "source string, source_row_id string"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = [(r.source, r.source_row_id, json.loads(r.row)) for r in found.collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search(r"hashpartitioning\([^)]*table_name", plan)
    assert sorted((s, k, row.get("total_gifts", row.get("ref_number"))) for s, k, row in got) == [
        ("cra_gift", "1|2000-01-01|1", 5),
        ("cra_gift", "1|2000-01-01|2", 7),
        ("cra_gift", "1|2000-1-1|1", 5),
        ("fed_contribution", "10", "a"),
        ("fed_grant", "10", "a"),
    ]


def test_nodes_are_listed_without_a_shuffle_of_whole_edges(spark):
    wh = fixtures.three_entities(spark)
    nodes = graph.vertices(wh)
    assert "confidence_score" not in nodes._jdf.queryExecution().optimizedPlan().toString()
    ends = {end for r in graph.graph_edges(wh).collect() for end in (r.src, r.dst) if ":" in end}
    assert ends and sorted(r.node_id for r in nodes.collect()) == sorted({"1001", "1002", "1003"} | ends)
