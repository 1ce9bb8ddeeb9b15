"""Hot keys: results stay whole and equal to brute force, and plans hold no pairwise blow-up."""

from __future__ import annotations

import itertools
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import fixtures
from conftest import rows
from fundtrace.operators import cycles, linkage, pairs
from fundtrace.sources.warehouse import Warehouse


def crossover_warehouse(spark, seed):
    """Every second entity is directed by the same person; ties are frequent."""
    rng = random.Random(seed)
    n = 40
    ids = range(1, n + 1)
    root = {i: f"{i:09d}" for i in ids}
    people = [("Common", "Person"), *((f"First{k}", f"Last{k}") for k in range(6))]
    boards = {i: {rng.choice(people[1:])} | ({people[0]} if i % 2 else set()) for i in ids}
    grants, contracts, links = [], [], []
    for i in ids:
        if rng.random() < 0.7:
            grants.append((i, str(i), 0, "d", Decimal(rng.choice([30_000, 40_000])), None, "G"))
            links.append((f"f{i}", i, "fed", "grants_contributions", f'{{"_id": {i}}}', None, "m", 1.0))
        if rng.random() < 0.7:
            contracts.append((f"c{i}", Decimal(rng.choice([20_000, 50_000]))))
            links.append((f"l{i}", i, "ab", "ab_contracts", f'{{"id": "c{i}"}}', None, "m", 1.0))
    tables = {
        "entity_golden_records": [fixtures.golden(i, f"E{i}", root[i]) for i in ids],
        "cra_directors": [(root[i] + "RR", fixtures.D, 1, a, b, None) for i in ids for a, b in boards[i]],
        "grants_contributions": grants,
        "ab_contracts": contracts,
        "entity_source_links": links,
    }
    wh = Warehouse(spark, {k: fixtures.frame(spark, k, v) for k, v in tables.items()})
    money_in = {g[0]: float(g[4]) for g in grants}
    money_ab = {int(c[0][1:]): float(c[1]) for c in contracts}
    listed = []
    for charity, contractor in itertools.product(money_in, money_ab):
        shared = sorted(f"{a} {b}".lower() for a, b in boards[charity] & boards[contractor])
        if charity != contractor and shared:
            listed.append((charity, contractor, money_in[charity], money_ab[contractor], shared))
    listed.sort(key=lambda p: (-p[3], -p[2], p[0], p[1]))
    return wh, listed


@pytest.mark.parametrize("limit", [1, 7, 50, None])
def test_crossover_equals_brute_force_under_a_hot_name(spark, limit):
    wh, listed = crossover_warehouse(spark, seed=limit or 0)
    got = pairs.crossover(wh, limit=limit).select(
        "charity_entity_id", "contractor_entity_id", "total_grant_amount", "total_contract_amount", "shared_directors"
    )
    want = listed if limit is None else listed[:limit]
    assert rows(got) == sorted(want, key=repr)


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


def test_pair_queries_have_no_cross_or_nested_loop_join(spark):
    wh, _ = crossover_warehouse(spark, 3)
    for df in (
        pairs.shared_director_funding_pairs(wh),
        pairs.director_funding_pairs_fast(wh),
        pairs.crossover(wh),
    ):
        text = plan_of(df)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_pairs_drive_from_gifts_and_count_one_number_with_two_records(spark):
    wh = Warehouse(
        spark,
        {
            "entity_golden_records": fixtures.frame(
                spark,
                "entity_golden_records",
                [fixtures.golden(1, "A", "1" * 9), fixtures.golden(2, "B", "1" * 9), fixtures.golden(3, "C", "3" * 9)],
            ),
            "cra_directors": fixtures.frame(
                spark,
                "cra_directors",
                [(bn + "RR", fixtures.D, s, "Ann", "Leeson", None) for bn in ("1" * 9, "3" * 9) for s in (1, 2)],
            ),
            "cra_qualified_donees": fixtures.frame(
                spark,
                "cra_qualified_donees",
                [
                    ("1" * 9, fixtures.D, 1, "1" * 9, Decimal(100)),
                    ("3" * 9, fixtures.D, 1, "1" * 9, Decimal(60)),
                    ("1" * 9, fixtures.D, 2, "3" * 9, Decimal(60)),
                ],
            ),
        },
    )
    fast = pairs.director_funding_pairs_fast(wh, min_amount=100)
    assert rows(fast, "entity_id_a", "entity_id_b", "total_amount", "gift_count") == [
        (1, 2, 200.0, 2),
        (1, 3, 120.0, 2),
        (2, 3, 120.0, 2),
    ]


def profile_rows(spark, n=60, seed=1):
    rng = random.Random(seed)
    stems = ["NORTHERN PATHWAYS", "NORTHERN PATHWAY", "NORTHERN LIGHTS", "BOREAL FUTURES", "BOREAL FUTURE"]
    data = {
        (
            rng.choice(["111111111", "222222222", None, f"{k:09d}"]),
            rng.choice(stems) + rng.choice(["", " WEST", " EAST"]),
            rng.choice(["LAVAL", "REGINA", None]),
            rng.choice(["QC", "SK", None]),
            rng.choice(["charity", "business"]),
        )
        for k in range(n)
    }
    ddl = "bn_root string, cleaned_name string, city string, province string, entity_type string"
    counted = spark.createDataFrame(sorted(data, key=repr), ddl).withColumn("n_records", F.lit(1))
    return counted.select(linkage.profile_id().alias("profile_id"), *linkage.COMPARED, "n_records")


@pytest.mark.parametrize("tile", [1, 3, 1000])
def test_tiled_blocks_give_every_pair_once(spark, tile):
    df = profile_rows(spark)
    got = linkage.block_pairs(df, [F.col("bn_root")], tile=tile).collect()
    listed = df.collect()
    want = {
        tuple(sorted((a["profile_id"], b["profile_id"])))
        for a, b in itertools.combinations(listed, 2)
        if a["bn_root"] is not None and a["bn_root"] == b["bn_root"]
    }
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_pruned_blocking_loses_no_prediction(spark):
    df = profile_rows(spark, n=150, seed=2)
    model = linkage.train(df)
    for threshold in (0.05, 0.4, 0.9):
        kept = linkage.predict(df, model, threshold)
        everything = linkage.predict.__globals__["pairs_within_reach"]
        try:
            linkage.pairs_within_reach = lambda rows_, *_: linkage.candidate_pairs(rows_)
            full = linkage.predict(df, model, threshold).collect()
        finally:
            linkage.pairs_within_reach = everything
        key = lambda r: (r["profile_l"], r["profile_r"])
        assert sorted(map(key, kept.collect())) == sorted(map(key, full))


def test_clusters_equal_brute_force(spark):
    rng = random.Random(4)
    nodes = [f"n{i:02d}" for i in range(40)]
    links = [tuple(sorted(rng.sample(nodes, 2))) for _ in range(24)] + [
        (nodes[i], nodes[i + 1]) for i in range(30, 39)
    ]
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    node_df = spark.createDataFrame([(n,) for n in nodes], "profile_id string")
    pair_df = spark.createDataFrame(links, "profile_l string, profile_r string")
    assert rows(linkage.clusters(node_df, pair_df)) == sorted((n, find(n)) for n in nodes)
    assert linkage.clusters(node_df, pair_df.limit(0)).filter("profile_id = cluster_id").count() == 40


def test_copies_of_a_record_stay_linear(spark):
    """Fifty entities with one and the same profile that matches itself: a star of 49 candidates."""
    wh = Warehouse(
        spark,
        {
            "entity_golden_records": fixtures.frame(
                spark,
                "entity_golden_records",
                [fixtures.golden(i, "Same Name Inc.", "123456789") for i in range(1, 51)]
                + [fixtures.golden(i, f"Other {i} Club", f"{i:09d}") for i in range(100, 140)],
            )
        },
    )
    records = linkage.extract_records(wh)
    profile = records.withColumn("profile_id", linkage.profile_id()).filter("entity_id <= 50").select("profile_id").distinct()
    assert profile.count() == 1
    own = profile.select(
        F.col("profile_id").alias("profile_l"), F.col("profile_id").alias("profile_r"),
        F.lit(9.0).alias("match_weight"), F.lit(0.99).alias("match_probability"),
    )
    # Every one of them once, with the smallest: the group, not its pairs.
    found = linkage.build_candidates(records, own)
    assert sorted(rows(found, "entity_id_l", "entity_id_r")) == [(1, i) for i in range(2, 51)]
    assert linkage.entity_profiles(records).filter("cleaned_name = 'SAME NAME'").count() == 50


def test_training_counts_every_pair_of_a_large_block(spark):
    from collections import Counter

    held = [(f"p{k:05d}", str(k % 7) if k % 5 else None, "hot name", f"c{k}", f"v{k % 3}", None if k % 4 == 0 else "x", 1 + (k % 50 == 0)) for k in range(1300)]
    rows = spark.createDataFrame(held, "profile_id string, bn_root string, cleaned_name string, city string, province string, entity_type string, n_records long")
    level = lambda a, b: -1 if a is None or b is None else int(a == b)
    want = Counter()
    for i, a in enumerate(held):
        for b in held[:i]:
            want[tuple(level(a[c], b[c]) for c in (1, 3, 4, 5))] += a[6] * b[6]
        want[tuple(level(a[c], a[c]) for c in (1, 3, 4, 5))] += a[6] * (a[6] - 1) // 2
    for kwargs in ({}, {"tile": 300}):
        got = linkage.training_patterns(rows, "cleaned_name", **kwargs).collect()
        assert {tuple(r)[:4]: r.w for r in got} == +want


def profiles_with_nulls(spark, count, seed, hot=0):
    rng = random.Random(seed)
    names = ["alpha house", "alpha hause", "alpha housing", "beta", "gamma group", "gamma groups", None]
    some = lambda *values: rng.choice([None, *values])
    found = {
        (some("1", "2", "3") if i >= hot else "9", rng.choice(names), some("x", "y"), some("ab", "on"), some("charity", "business")) for i in range(count)
    }
    listed = [(f"p{i}", *values, rng.randint(1, 4)) for i, values in enumerate(sorted(found, key=repr))]
    return spark.createDataFrame(listed, "profile_id string, bn_root string, cleaned_name string, city string, province string, entity_type string, n_records bigint")


@pytest.mark.parametrize("block", ["bn_root", "cleaned_name"])
def test_patterns_from_group_sizes_equal_all_pairs(spark, block):
    listed = profiles_with_nulls(spark, 250, 3)
    gammas = [f"g_{c}" for c in linkage.COMPARED if c != block]
    want = {tuple(r[g] for g in gammas): r["w"] for r in linkage.training_patterns(listed, block).collect()}
    got = {tuple(p[g] for g in gammas): p["w"] for p in linkage.pattern_counts(listed, block, tile=2)}
    assert got == want and len(want) > 20


def test_a_hot_name_needs_no_pairs(spark):
    """200,000 profiles of one name: 2e10 pairs, counted from group sizes."""
    n = 200_000
    listed = spark.range(n).selectExpr(
        "concat('p', id) AS profile_id", "cast(id AS string) AS bn_root", "'one name' AS cleaned_name", "cast(id % 2 AS string) AS city",
        "cast(NULL AS string) AS province", "'charity' AS entity_type", "1L AS n_records",
    )
    got = {(p["g_bn_root"], p["g_city"], p["g_province"], p["g_entity_type"]): p["w"] for p in linkage.pattern_counts(listed, "cleaned_name")}
    half = n // 2
    assert got == {(0, 1, -1, 1): half * (half - 1.0), (0, 0, -1, 1): float(half) * half}


def test_loops_never_pass_a_hub_in_the_middle(spark):
    """A hub gives to and takes from 400 nodes: 160,000 paths of two edges lead through it, none is formed."""
    rng = random.Random(4)
    leaves = [f"L{i:03d}" for i in range(400)]
    links = {("HUB", x) for x in leaves} | {(x, "HUB") for x in leaves}
    links |= {(rng.choice(leaves), rng.choice(leaves)) for _ in range(60)}
    links = {(a, b) for a, b in links if a != b}
    edges = spark.createDataFrame([(a, b, Decimal(len(b)), 2000, 2001) for a, b in links], "src string, dst string, amt decimal(28,2), min_year int, max_year int")
    _, numbered = cycles.numbered(edges)
    two = cycles._grow(cycles._first(numbered, "src", "dst"), numbered, "src", "dst", 1)
    assert two.count() < 4 * len(links)
    nexts: dict = {}
    for a, b in links:
        nexts.setdefault(a, []).append(b)
    want = set()
    for start in sorted(nexts):
        paths = [[start]]
        for _ in range(4):
            longer = [[*p, x] for p in paths for x in nexts.get(p[-1], ()) if x == start or (x > start and x not in p)]
            want |= {"-".join(p[:-1]) for p in longer if p[-1] == start}
            paths = [p for p in longer if p[-1] != start]
    assert {r["id"] for r in cycles.find_loops(edges, 4).select("id").collect()} == want


def test_pruning_ends_at_the_fixed_point(spark):
    chain = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(12)] + [("a", "b"), ("b", "a")]
    edges = spark.createDataFrame([(a, b, Decimal(1), 2000, 2000) for a, b in chain], "src string, dst string, amt decimal(28,2), min_year int, max_year int")
    assert rows(cycles.prune(edges, goes_on=0), "src", "dst") == [("a", "b"), ("b", "a")]
