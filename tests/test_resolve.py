from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

import fixtures
from conftest import rows
from fundtrace import schemas
from fundtrace.operators import resolve
from fundtrace.sources.warehouse import Warehouse

CANDIDATE = (
    "candidate_id string, entity_id_l bigint, entity_id_r bigint, legal_name_l string, legal_name_r string, "
    "source_count_l bigint, source_count_r bigint, match_probability double"
)
DECISION = "candidate_id string, status string, reviewed_by string, review_note string, reviewed_at timestamp"
T1, T2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)


@pytest.fixture(scope="module")
def wh(spark):
    return Warehouse(
        spark,
        {
            "entity_golden_records": fixtures.frame(
                spark,
                "entity_golden_records",
                [
                    fixtures.golden(1, "Acme Legal Foundation", "111111111", aliases='["Acme Legal", {"name": "Acme Object"}]'),
                    fixtures.golden(2, "Acme Operating Co.", "222222222"),
                ],
            )
        },
    )


def feed(spark, *items):
    data = [
        (str(k), i.get("name"), i.get("bn"), i.get("amount"), None, None, None, None)
        for k, i in enumerate(items)
    ]
    return spark.createDataFrame(data, schemas.FEED)


def resolved(spark, wh, items, candidates=(), decisions=()):
    overrides = resolve.Overrides.none(wh)
    if candidates:
        decided = resolve.decide(
            spark.createDataFrame(list(candidates), CANDIDATE),
            spark.createDataFrame(list(decisions), DECISION),
        )
        overrides = resolve.approved_overrides(decided)
    index = resolve.build_index(wh, overrides)
    found = resolve.resolve_rows(feed(spark, *items), "fed_grants", index)
    listed = resolve.resolved_entities(found, index)
    return rows(listed, "external_id", "entity_id", "mapping_method", "confidence_score")


def test_number_name_and_string_alias(spark, wh):
    got = resolved(
        spark,
        wh,
        [
            {"bn": "111111111 RR0001", "name": "whatever"},
            {"bn": "999999999", "name": "ACME OPERATING CO"},
            {"name": "acme-legal"},
            {"name": "Acme Object"},
            {"name": "No"},
        ],
    )
    assert got == [
        ("0", 1, "bn_root", 1.0),
        ("1", 2, "exact_name_or_alias", 0.9),
        ("2", 1, "exact_name_or_alias", 0.9),
    ]


def test_approved_alias(spark, wh):
    candidate = ("c", 1, 2, "Acme Legal Foundation", "Acme Operating", 5, 2, 0.98)
    approved = [("c", "same", "me", None, T1)]
    got = resolved(spark, wh, [{"name": "Acme Operating"}], [candidate], approved)
    assert got == [("0", 1, "splink_alias_override", 0.98)]


def test_approved_survivor(spark, wh):
    candidate = ("c", 1, 2, "Acme Legal Foundation", "Acme Operating Co.", 5, 2, 0.99)
    approved = [("c", "same", "me", None, T1)]
    got = resolved(spark, wh, [{"bn": "222222222"}], [candidate], approved)
    assert got == [("0", 1, "splink_survivor_override", 0.99)]


def test_unapproved_candidate_has_no_effect(spark, wh):
    candidate = ("c", 1, 2, "Acme Legal Foundation", "Acme Operating", 5, 2, 0.98)
    assert resolved(spark, wh, [{"name": "Acme Operating"}], [candidate], [("c", "different", "me", None, T1)]) == []


def test_last_decision_counts(spark, wh):
    candidate = ("c", 1, 2, "Acme Legal Foundation", "Acme Operating", 5, 2, 0.98)
    taken_back = [("c", "same", "me", None, T1), ("c", "needs_review", "you", "why", T2)]
    assert resolved(spark, wh, [{"name": "Acme Operating"}], [candidate], taken_back) == []


def test_survivor_is_the_better_linked_then_the_smaller(spark):
    data = [
        ("a", 1, 2, "x x x", "y y y", 1, 3, 0.9),
        ("b", 7, 5, "x x x", "y y y", 2, 2, 0.8),
        ("c", 9, 9, "x x x", "y y y", 2, 2, 0.8),
    ]
    decided = spark.createDataFrame(data, CANDIDATE).withColumns(
        {"status": F.lit("same"), "reviewed_at": F.lit(T1)}
    )
    got = resolve.survivor_overrides(decided)
    assert rows(got, "duplicate_entity_id", "survivor_entity_id") == [(1, 2), (7, 5)]


def test_status_bands_keep_an_explicit_status(spark):
    df = spark.createDataFrame(
        [(0.97, None), (0.96, None), (0.5, None), (0.5, "same")], "match_probability double, status string"
    )
    assert [r["status"] for r in resolve.with_status(df).collect()] == [
        "likely_same",
        "needs_review",
        "audit",
        "same",
    ]


def test_donee_rows_use_both_numbers(spark, wh):
    data = [("7", None, None, None, "111111111", "222222222RR0001", "x", "5")]
    index = resolve.build_index(wh)
    found = resolve.resolve_rows(spark.createDataFrame(data, schemas.FEED), "cra_donees", index)
    assert rows(resolve.resolved_entities(found, index), "entity_id") == [(1,), (2,)]


def _overrides(spark):
    aliases = spark.createDataFrame([("acme b", 2, 0.9)], "alias_norm string, entity_id bigint, confidence double")
    survivors = spark.createDataFrame([(3, 1, 0.9), (9, 2, 0.8)], "duplicate_entity_id bigint, survivor_entity_id bigint, confidence double")
    return resolve.Overrides(aliases, survivors)


def _wide_warehouse(spark):
    records = [
        fixtures.golden(1, "Acme A", "111111111", aliases='["ACME  a", "Acme-A", "X", {"name": "Acme Object"}, null, 7]'),
        fixtures.golden(2, "Co", "222222222", aliases='["Acme, B."]'),
        fixtures.golden(3, "Acme A", "111111111"),
        fixtures.golden(4, None, None),
        fixtures.golden(5, "acme a", ""),
    ]
    return Warehouse(spark, {"entity_golden_records": fixtures.frame(spark, "entity_golden_records", records)})


def test_index_names_are_normalised_after_their_shuffle(spark, monkeypatch):
    plans = []
    store = resolve.checkpoint
    monkeypatch.setattr(resolve, "checkpoint", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), store(df))[1])
    index = resolve.build_index(_wide_warehouse(spark), _overrides(spark))
    lines = plans[0].splitlines()
    normalised = [i for i, line in enumerate(lines) if "regexp_replace" in line]
    shuffled = [i for i, line in enumerate(lines) if "Aggregate [name#" in line]
    assert normalised and shuffled and max(normalised) <= min(shuffled)
    listed = rows(index.entities.distinct(), "kind", "key", "entity_id")
    assert listed == [
        ("name", "acme a", 1),
        ("name", "acme a", 5),
        ("name", "acme b", 2),
        ("number", "111111111", 1),
        ("number", "222222222", 2),
    ]
    assert rows(index.keys, "kind", "key", "moved", "is_alias") == [
        ("name", "acme a", False, None),
        ("name", "acme b", False, True),
        ("number", "111111111", True, None),
        ("number", "222222222", False, None),
    ]


def test_keys_of_a_feed_row_are_formed_as_columns(spark):
    index = resolve.build_index(_wide_warehouse(spark), _overrides(spark))
    data = [
        ("1", None, None, None, "111111111", "111111111RR0001", "Acme B", "5"),
        ("2", None, None, None, "", None, "ACME (a)", "5"),
        ("3", None, None, None, None, "999999999", "acme b", "5"),
        ("4", None, None, None, None, None, "no", "5"),
        (None, None, None, None, "222222222", None, None, "5"),
    ]
    found = resolve.resolve_rows(spark.createDataFrame(data, schemas.FEED), "cra_donees", index)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # Keys are plain columns: functions on lists are interpreted row by row, with the patterns inside them.
    assert plan.count("[^0-9]") == 4 and "lambda" not in plan
    listed = resolve.resolved_entities(found, index)
    assert rows(listed, "external_id", "entity_id", "mapping_method") == [
        ("1", 1, "splink_survivor_override"),
        ("2", 1, "exact_name_or_alias"),
        ("2", 5, "exact_name_or_alias"),
        ("3", 2, "splink_alias_override"),
    ]
