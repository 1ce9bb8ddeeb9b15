"""Edges of few entities are found without forming or shuffling all edges."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from conftest import rows
from fundtrace.operators import edges, graph, pairs
from fundtrace.sources.warehouse import Warehouse

DAY = dt.date(2000, 1, 1)
GIFTS = "bn string, fpe date, sequence_number long, donee_bn string, total_gifts decimal(18,2)"


def warehouse(spark, gifts=None):
    bn = lambda n: None if n is None else f"10000000{n}RR0001"
    given = [(1, 2), (1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (None, 1), (None, 5), (5, None), (1, 1), (7, 2), (2, 8), (6, 4)]
    listed = [(bn(a), DAY, i // 2, bn(b), Decimal(10 + i)) for i, (a, b) in enumerate(given)]
    roots = [(1, "100000001"), (2, "100000002"), (3, "100000003"), (4, "100000004"), (5, "100000005"), (6, None), (12, "100000002"), (12, "100000002"), (None, "100000004")]
    grants = [(i, f"r{i}", i, None, Decimal(5 + i), DAY, "C") for i in range(6)]
    links = [(f"f{i}", e, "fed", "grants_contributions", f'{{"_id": {i}}}', "exact", None) for i, e in enumerate([1, 2, 12, 5, None, 9])]
    links += [(f"a{i}", e, "ab", "ab_grants", f'{{"id": {i}}}', None, 0.5) for i, e in enumerate([1, 1, 4])]
    return Warehouse(
        spark,
        {
            "entity_golden_records": spark.createDataFrame([(i, f"E{i}", r, "active") for i, r in roots], "id long, canonical_name string, bn_root string, status string"),
            "cra_qualified_donees": spark.createDataFrame(listed, GIFTS) if gifts is None else gifts,
            "cra_directors": spark.createDataFrame([(bn(n), DAY, n, "Ann", "J", f"Lee{n % 2}") for n in (1, 2, 3, 5)], "bn string, fpe date, sequence_number long, first_name string, initials string, last_name string"),
            "grants_contributions": spark.createDataFrame(grants, "_id long, ref_number string, amendment_number long, owner_org string, agreement_value decimal(18,2), agreement_start_date date, agreement_type string"),
            "ab_grants": spark.createDataFrame([(i, Decimal(3), DAY) for i in range(3)], "id long, amount decimal(18,2), payment_date date"),
            "entity_source_links": spark.createDataFrame(links, "id string, entity_id long, source_schema string, source_table string, source_pk string, match_method string, match_confidence double"),
        },
    )


def test_edges_of_few_entities_are_those_of_all_edges(spark, monkeypatch):
    wh = warehouse(spark)
    members = spark.createDataFrame([("a", 1), ("a", 12), ("a", 12), ("b", 3), ("b", None), ("c", 6), ("c", 99)], "ring_id string, entity_id long")
    seeds = spark.createDataFrame([(1,), (1,), (6,), (None,)], "entity_id long")

    def found():
        return rows(graph.ring_graph(wh, members)), rows(graph.ego_graph(wh, seeds, 2)), rows(graph.ego_graph(wh, seeds, 1))

    asked = []
    money = edges.money_edges
    monkeypatch.setattr(edges, "money_edges", lambda wh, wanted=None: (asked.append(wanted is not None), money(wh, wanted))[1])
    few = found()
    assert asked and all(asked)
    monkeypatch.setattr(graph, "FEW_ENTITIES", 0)
    assert few == found()
    assert len(few[0]) > 10 and len(few[1]) > len(few[2]) > 5


def joined_gifts(spark, folder):
    """Gifts that come from a join, as in the demo warehouse."""
    donors = spark.range(50).selectExpr("id AS k", "if(id = 7, null, concat(cast(100000001 + id % 9 AS string), 'RR0001')) AS bn")
    given = spark.range(200).selectExpr("id % 50 AS k", "concat(cast(100000001 + id % 7 AS string), 'RR0001') AS donee_bn", "id AS sequence_number", "cast(id + 1 AS decimal(18,2)) AS total_gifts")
    donors.write.parquet(f"{folder}/donors")
    given.write.parquet(f"{folder}/given")
    return spark.read.parquet(f"{folder}/given").join(spark.read.parquet(f"{folder}/donors"), "k").selectExpr("bn", "date'2000-01-01' AS fpe", "sequence_number", "donee_bn", "total_gifts")


def test_gifts_are_reduced_where_they_are_read(spark, tmp_path):
    wh = warehouse(spark, joined_gifts(spark, tmp_path))
    members = spark.createDataFrame([(1,), (2,)], "entity_id long")
    pair = spark.createDataFrame([("100000001", "100000002"), ("100000003", "100000003")], "root_x string, root_y string")
    size = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    settings = {size: "1b", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        reports = [edges.ring_funding_edges(wh, members), pairs._with_first_row(wh, pair, 200)]
        plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in reports]
        inside, first = (rows(df) for df in reports)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert all("might_contain" in plan for plan in plans)
    gifts = [(r.bn and r.bn[:9], r.donee_bn[:9], r.sequence_number, r.bn) for r in wh.gifts.collect()]
    wanted = {"100000001": [1], "100000002": [2]}
    assert sorted(r[5] for r in inside) == sorted(f"{bn}|2000-01-01|{n}" for a, b, n, bn in gifts if a != b and a in wanted and b in wanted)
    # A gift without a donor's number stands under its donee's.
    ids = lambda x, y: min("|".join(filter(None, (bn, "2000-01-01", str(n)))) for a, b, n, bn in gifts if {a or b, b} == {x, y})
    assert sorted(r[0] for r in first) == sorted([ids("100000001", "100000002"), ids("100000003", "100000003")])
