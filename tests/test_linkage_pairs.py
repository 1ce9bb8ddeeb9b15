"""Candidate pairs carry their columns, and names are compared many at once."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

import fixtures
from fundtrace.functions import similarity
from fundtrace.operators import linkage
from fundtrace.sources.warehouse import Warehouse


def _rows(spark, n=60):
    rng = random.Random(5)
    pick = lambda *texts: rng.choice([*texts, None])
    rows = {(pick("1", "2", "3"), pick("NORTH A", "NORTH B", "SOUTH"), pick("X", "Y"), pick("AB", "BC"), pick("charity")) for _ in range(n)}
    data = [(f"p{i:02d}", *row, 1) for i, row in enumerate(sorted(rows, key=str))]
    return data, spark.createDataFrame(data, "profile_id string, bn_root string, cleaned_name string, city string, province string, entity_type string, n_records long")


def test_pairs_of_all_rules_are_distinct_and_carry_both_sides(spark):
    data, rows = _rows(spark)

    def keys(r):
        prefix = r[2] and r[2][:5]
        both = lambda x: (x, prefix) if x and prefix else None
        return [r[1], r[2], both(r[4]), both(r[3])]

    want = sorted(
        (a[0], b[0], a[2], b[2])
        for a in data
        for b in data
        if a[0] < b[0] and any(x is not None and x == y for x, y in zip(keys(a), keys(b)))
    )
    key = lambda t: tuple(x or "" for x in t)
    for tile in (2_000, 3):
        found = linkage.rule_pairs(rows, [linkage._rule_key(rule) for rule in linkage.blocking_rules()], ["cleaned_name"], tile)
        got = [(r.profile_l, r.profile_r, r.cleaned_name_l, r.cleaned_name_r) for r in found.collect()]
        assert sorted(got, key=key) == sorted(want, key=key)


def test_pairs_are_neither_shuffled_nor_joined_again(spark):
    _, rows = _rows(spark)
    plan = linkage.compared_pairs(rows)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(profile_l" not in plan and "keys=[profile_l" not in plan


def test_names_compared_at_once_score_like_single_pairs():
    rng = random.Random(1)
    text = lambda: "".join(rng.choice("abAé😀 ") for _ in range(rng.choice([0, 1, 2, 3, 5, 20, 63, 64, 65, 90])))
    left, right = [], []
    for _ in range(1_500):
        a = text()
        b = [rng.choice("abA ") if rng.random() < 0.1 else c for c in a]
        rng.random() < 0.3 and b and b.insert(0, b.pop())
        left.append(a)
        right.append("".join(b) if rng.random() < 0.7 else text())
    got = similarity.jaro_winkler_pairs(np.array(left, object), np.array(right, object))
    assert got.tolist() == [similarity.jaro_winkler_pair(a, b) for a, b in zip(left, right)]


def test_missing_names_stay_unknown(spark):
    rows = spark.createDataFrame([("ab", "ab"), ("ab", None), (None, None), ("", "a"), ("abcd", "abdc")], "a string, b string")
    got = rows.select(similarity.jaro_winkler(F.col("a"), F.col("b")).alias("s"), similarity.name_level(F.col("a"), F.col("b")).alias("n")).collect()
    assert [r.s for r in got] == [1.0, None, None, 0.0, similarity.jaro_winkler_pair("abcd", "abdc")]
    assert [r.n for r in got] == [3, -1, -1, 0, 2]


def test_predictions_form_pairs_without_shuffling_them(spark):
    _, rows = _rows(spark)
    model = linkage.starting_model()
    model.prior = 0.2
    found = linkage.predict(rows, model, 0.1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(profile_l" not in plan and "keys=[profile_l" not in plan
    pairs = [(r.profile_l, r.profile_r) for r in found.collect()]
    assert pairs and len(pairs) == len(set(pairs))


def test_pairs_with_a_side_that_lacks_its_number(spark):
    data, rows = _rows(spark, 120)
    want = sorted((a[0], b[0], a[1], b[1]) for a in data for b in data if a[0] < b[0] and a[3] is not None and a[3] == b[3] and None in (a[1], b[1]))
    for tile in (2_000, 3):
        found = linkage.rule_pairs(rows, [F.col("city")], ["bn_root"], tile, ["bn_root"])
        got = [(r.profile_l, r.profile_r, r.bn_root_l, r.bn_root_r) for r in found.collect()]
        key = lambda t: tuple(x or "" for x in t)
        assert sorted(got, key=key) == sorted(want, key=key)


def test_names_that_need_an_unknown_number_make_one_block(spark):
    model = linkage.starting_model()
    for column, top in (("bn_root", 0.999), ("cleaned_name", 0.5), ("city", 0.9), ("province", 0.9), ("entity_type", 0.9)):
        n = linkage.LEVELS[column]
        model.m[column] = np.array([(1 - top) / (n - 1)] * (n - 1) + [top])
        model.u[column] = np.array([0.96, 0.03, 0.008, 0.002] if n == 4 else [0.95, 0.05])
    model.prior = 5e-5
    bounds = linkage.reach(model, 0.4)
    assert bounds.number_lacking
    keys, lacking = linkage._keys_within_reach(model, 0.4)
    assert lacking[:3] == [None] * 3 and lacking[3:] == ["bn_root"]
    # The pairs left out are none that reach the threshold.
    rng = random.Random(3)
    names_ = ["NORTH A", "NORTH B", "NORTH AB", "NORTH LAKES", "SOUTH"]
    data = {(rng.choice(["1", "2", "3", None]), rng.choice(names_), rng.choice(["X", "Y", None]), rng.choice(["AB", "BC"]), "charity") for _ in range(80)}
    schema = "profile_id string, bn_root string, cleaned_name string, city string, province string, entity_type string, n_records long"
    rows = spark.createDataFrame([(f"p{i:02d}", *r, 1) for i, r in enumerate(sorted(data, key=str))], schema)
    got = {(r.profile_l, r.profile_r): round(r.match_weight, 6) for r in linkage.predict(rows, model).collect()}
    rated = rows.join(linkage._frequencies(rows, "bn_root"), "bn_root", "left").join(linkage._frequencies(rows, "cleaned_name"), "cleaned_name", "left")
    columns = [*linkage.COMPARED, "tf_bn_root", "tf_cleaned_name"]
    every = linkage.with_gammas(linkage.candidate_pairs(rated, columns=columns))
    weight = sum((linkage._weight(model, c) for c in linkage.COMPARED), F.lit(model.prior_weight))
    least = float(np.log2(0.4 / 0.6))
    want = {(r.profile_l, r.profile_r): round(r.w, 6) for r in every.withColumn("w", weight).filter(F.col("w") >= least).collect()}
    assert got == want and any(w for w in want)


def test_link_names_are_cleaned_once_per_distinct_name(spark):
    schema = "id string, entity_id long, source_schema string, source_table string, source_name string"
    links = spark.createDataFrame([("a", 1, "s", "t", "North Ltd"), ("b", 1, "s", "t", "North Ltd")], schema)
    entity = spark.createDataFrame([(1, "North", "active")], "id long, canonical_name string, status string")
    found = linkage.extract_records(Warehouse(spark, {"entity_golden_records": entity, "entity_source_links": links}))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    grouped = plan[plan.index("Aggregate [entity_id") :]
    assert "source_name" in grouped and "regexp_replace(" not in grouped
    assert sorted(r.record_id for r in found.collect()) == ["entity:1:canonical", "source_link:a"]


def test_entities_of_one_profile_are_all_candidates_of_each_other(spark):
    """Seven entities share a profile that reaches the threshold: 21 pairs, in one tile and in many."""
    listed = [fixtures.golden(i, "Same Name Inc.", "123456789") for i in (9, 2, 4, 7, 1, 5, 3)]
    listed += [fixtures.golden(i, f"Other {i} Club", f"{i:09d}") for i in range(100, 120)]
    wh = Warehouse(spark, {"entity_golden_records": fixtures.frame(spark, "entity_golden_records", listed)})
    want = {(a, b) for a in (1, 2, 3, 4, 5, 7, 9) for b in (1, 2, 3, 4, 5, 7, 9) if a < b}
    run = linkage.run_linkage(wh, threshold=1e-9)
    small = linkage.build_candidates(run.records, run.predictions, all_pairs=True, tile=2)
    for found in (run.candidates, small):
        got = [(r.entity_id_l, r.entity_id_r) for r in found.filter("cleaned_name_l = 'SAME NAME'").collect()]
        assert len(got) == len(want) and set(got) == want
    own = {r.match_probability for r in run.predictions.filter("profile_l = profile_r").collect()}
    assert {r.match_probability for r in run.candidates.filter("cleaned_name_l = 'SAME NAME'").collect()} == own
