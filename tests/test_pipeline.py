"""The three-entity case end to end: rings, graph, scores, dossier."""

from __future__ import annotations

import itertools
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import fixtures
from conftest import rows
from fundtrace.operators import (
    cycles,
    directors,
    dossier,
    edges,
    entities,
    evidence,
    graph,
    pairs,
    rings,
    scoring,
)
from fundtrace.sources import sinks
from fundtrace.sources.warehouse import Warehouse

NAME = "harwick jennifer"


@pytest.fixture(scope="module")
def wh(spark):
    return fixtures.three_entities(spark)


def test_related_party_rings(wh):
    ring = rings.find_related_party_rings(wh).collect()
    assert len(ring) == 1
    assert ring[0]["ring_id"] == "cra-cycle-1"
    assert sorted(ring[0]["entity_ids"]) == [1001, 1002]
    assert ring[0]["shared_persons"] == [NAME]
    assert ring[0]["total_amount"] == 179000


def test_director_pair_and_cycle_with_same_members_keep_the_cycle_on_a_tie(wh):
    table = pairs.director_rings_table(wh, min_amount=100_000)
    assert rows(table, "entity_id_a", "entity_id_b", "gift_count", "name_a") == [
        (1001, 1002, 2, "Northern Pathways Community Society")
    ]
    found = rings.find_related_party_rings(wh, director_pairs=table).collect()
    assert [r["ring_type"] for r in found] == ["round_trip"]


def test_top_rings_carry_gifts_as_evidence(wh):
    ring = rings.top_rings(wh).first()
    assert ring["total_score"] == 0.8
    assert "Round-trip funding (CRA-confirmed)" in ring["flags"]
    assert [e["source_row_id"] for e in ring["evidence"]] == [
        "123456789|2023-12-31|4",
        "234567890|2023-12-31|7",
    ]


def test_scores(wh):
    scored = {r["entity_id"]: r for r in scoring.score_all(wh).collect()}
    assert scored[1001]["total_score"] == 1.0
    assert scored[1002]["total_score"] == 0.7
    assert scored[1003]["total_score"] == 0.65
    assert scored[1003]["flags_csv"] == "Director controls multiple funded entities, Sole-source pattern"


def test_funding_edges_by_direction(wh):
    both = edges.funding_edges(wh)
    assert both.filter("entity_id = 1001").count() == 3
    assert edges.funding_edges(wh, "out").filter("entity_id = 1001").count() == 1
    flags = edges.sole_source_flags(wh).first()
    assert (flags["contract_count"], flags["repeat_vendor_flag"], flags["splitting_flag"]) == (2, True, False)


def test_self_gift_shows_twice_and_unmapped_donee_once(spark):
    wh = Warehouse(
        spark,
        {
            "entity_golden_records": fixtures.frame(
                spark, "entity_golden_records", [fixtures.golden(1, "A", "111111111")]
            ),
            "cra_qualified_donees": fixtures.frame(
                spark,
                "cra_qualified_donees",
                [
                    ("111111111RR0001", fixtures.D, 1, "111111111RR0002", Decimal(5)),
                    ("111111111RR0001", fixtures.D, 2, "999999999RR0001", Decimal(5)),
                    ("111111111RR0001", fixtures.D, 3, None, Decimal(5)),
                    ("111111111RR0001", fixtures.D, 4, "111111111", Decimal(0)),
                ],
            ),
        },
    )
    got = rows(edges.funding_edges(wh), "role", "from_entity_id", "to_entity_id", "source_row_id")
    assert got == [
        ("in", 1, 1, "111111111RR0001|2023-12-31|1"),
        ("out", 1, 1, "111111111RR0001|2023-12-31|1"),
        ("out", 1, None, "111111111RR0001|2023-12-31|2"),
    ]


def test_graph_has_both_directions_and_the_director(wh):
    found = {(r["src"], r["dst"]) for r in graph.graph_edges(wh).collect()}
    assert {("1001", "1002"), ("1002", "1001"), (f"person:{NAME}", "1003")} <= found
    assert ("source:fed_grant:88001", "1001") in found
    kinds = dict(rows(graph.vertices(wh), "node_id", "entity_type"))
    assert kinds["1003"] == "business" and kinds["source:fed_grant:88001"] == "gov"


def test_zero_confidence_becomes_one(wh):
    df = edges.money_edges(wh).withColumn("confidence_score", F.lit(0.0))
    assert {r["confidence_score"] for r in graph.funding_graph_edges(df).collect()} == {1.0}


def test_ego_graph_grows_with_radius(spark):
    roots = {i: f"{i}" * 9 for i in range(1, 6)}
    chain = [
        (roots[i] + "RR0001", fixtures.D, i, roots[i + 1] + "RR0001", Decimal(10)) for i in range(1, 5)
    ]
    wh = Warehouse(
        spark,
        {
            "entity_golden_records": fixtures.frame(
                spark, "entity_golden_records", [fixtures.golden(i, f"E{i}", r) for i, r in roots.items()]
            ),
            "cra_qualified_donees": fixtures.frame(spark, "cra_qualified_donees", chain),
        },
    )
    seeds = spark.createDataFrame([(1,), (3,)], "entity_id bigint")
    for radius, want in (
        (1, {(1, "1", "2"), (3, "2", "3"), (3, "3", "4")}),
        (2, {(1, "1", "2"), (1, "2", "3"), *((3, str(i), str(i + 1)) for i in range(1, 5))}),
        (3, {(1, "1", "2"), (1, "2", "3"), (1, "3", "4"), *((3, str(i), str(i + 1)) for i in range(1, 5))}),
    ):
        got = graph.ego_graph(wh, seeds, radius)
        assert {tuple(r) for r in got.select("seed", "src", "dst").collect()} == want


def test_evidence_rows(spark, wh):
    asked = spark.createDataFrame(
        [
            ("cra_gift", "123456789|2023-12-31|4"),
            ("cra_gift", "1|2"),
            ("fed_grant", "88001"),
            ("ab_sole_source", "u1"),
            ("nonsense", "1"),
            ("cra_gift", "x|not-a-date|y"),
        ],
        "source string, source_row_id string",
    )
    got = {(r["source_row_id"]): r["row"] for r in evidence.evidence_for_edges(wh, asked).collect()}
    assert set(got) == {"123456789|2023-12-31|4", "1|2", "88001", "u1"}
    assert '"amount":37000.00' in got["1|2"]


def test_dossier(wh):
    report = rings.find_related_party_rings(wh)
    table = {r["entity_id"]: r for r in dossier.entity_table(wh, report, F.lit("fed_grants")).collect()}
    assert table[1001]["badges"] == "FED, live-triggered, cycle-member"
    assert table[1001]["source_links"] == 1
    head = dossier.header(wh, report).first()
    assert (head["cycle_flow"], head["hops"]) == (179000, 2)


def test_absent_tables_are_empty(spark):
    wh = Warehouse(spark, {})
    assert edges.funding_edges(wh).count() == 0
    assert entities.smoke_counts(wh).first().asDict() == {
        "golden_records": 0,
        "directors_with_3_plus_orgs": 0,
        "funding_edges": 0,
        "precomputed_cycles": 0,
    }
    assert Warehouse.from_parquet(spark, "/nonexistent").entities.count() == 0


def test_status_column_is_optional(spark):
    df = fixtures.frame(
        spark, "entity_golden_records", [fixtures.golden(1, "A", "1" * 9, status="merged")]
    )
    assert Warehouse(spark, {"entity_golden_records": df}).active_entities.count() == 0
    assert Warehouse(spark, {"entity_golden_records": df.drop("status")}).active_entities.count() == 1


def test_latest_amendment_with_missing_reference_numbers(spark):
    data = [
        (1, "a", 0, "d", Decimal(1), None, "G"),
        (2, "a", 2, "d", Decimal(1), None, "G"),
        (3, "a", None, "d", Decimal(1), None, "G"),
        (4, None, 1, "d", Decimal(1), None, "G"),
        (5, None, 5, "d", Decimal(1), None, "G"),
    ]
    wh = Warehouse(spark, {"grants_contributions": fixtures.frame(spark, "grants_contributions", data)})
    assert rows(edges.current_grants(wh), "_id") == [(2,), (5,)]


def test_stored_reports(spark, wh, tmp_path):
    report = rings.top_rings(wh)
    path = str(tmp_path / "rings.json")
    live = sinks.load_json_or(spark, path, report.schema, lambda: report)
    assert live.count() == 1
    sinks.store_json(report, path)
    stored = sinks.load_json_or(spark, path, report.schema, lambda: report.limit(0))
    assert stored.first()["ring_id"] == "cra-cycle-1"
    assert sinks.load_parquet(spark, str(tmp_path / "none"), "a int").count() == 0


def brute_loops(pairs_, longest):
    nodes = sorted({n for p in pairs_ for n in p})
    links = set(pairs_)
    found = set()
    for size in range(2, longest + 1):
        for path in itertools.permutations(nodes, size):
            if path[0] == min(path) and all(
                (a, b) in links for a, b in zip(path, path[1:] + path[:1])
            ):
                found.add("-".join(path))
    return found


def test_loops_match_brute_force(spark):
    import random

    rng = random.Random(5)
    roots = [f"{i}0000000{i}" for i in range(1, 8)]
    links = {(a, b) for a in roots for b in roots if a != b and rng.random() < 0.45}
    gifts = [(a + "RR", fixtures.D, 1, b + "RR", Decimal(100)) for a, b in links]
    gifts += [(roots[0] + "RR", fixtures.D, 2, roots[0] + "RR", Decimal(900))]
    gifts += [(roots[0] + "RR", fixtures.D, 2, roots[5] + "XX", Decimal(1))]
    df = fixtures.frame(spark, "cra_qualified_donees", gifts)
    found = cycles.detect(df, min_edge_amount=100)
    assert {r["id"] for r in found["loops"].collect()} == brute_loops(links, 6)
    lengths = {r["hops"] == len(r["path_bns"]) for r in found["loops"].collect()}
    assert lengths == {True}


def test_shared_director_needs_all_members(spark, wh):
    members = spark.createDataFrame(
        [("r1", 1001), ("r1", 1002), ("r1", 1001), ("r2", 1001), ("r2", 55)],
        "ring_id string, entity_id bigint",
    )
    assert rows(directors.shared_by_all(wh, members)) == [("r1", NAME)]


def test_gifts_inside_rings_beyond_the_limit(wh):
    """``gift_limit`` cuts the gifts that are evidence; None takes every gift inside a ring."""
    found = rings.find_related_party_rings(wh)
    gifts = rings.ring_funding_edges(wh, rings.ring_members(found), None)
    every = rings.edges_inside(found, gifts).count()
    size = {limit: sum(len(r["funding_edges"] or ()) for r in rings.top_rings(wh, rings=found, gift_limit=limit).collect()) for limit in (None, 1)}
    assert every > 1 and size[None] == every and size[1] == 1
