"""Every registered query: name -> callable(spark, sf_dir) over the derived warehouse."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fundtrace.functions import ids, names, similarity, values
from fundtrace.operators import (
    cycles,
    directors,
    dossier,
    edges,
    entities,
    evidence,
    graph,
    linkage,
    pairs,
    patterns,
    resolve,
    rings,
    risk,
    scoring,
)
from fundtrace.session import checkpoint, tune
from fundtrace.sources import demo
from fundtrace.streaming import findings, validate

# The derived filings run from 1995 to 2001.
SINCE = dt.date(1998, 1, 1)

Query = Callable[["Run"], DataFrame]
REGISTRY: dict[str, Query] = {}


class Run:
    """What a query gets: the session, the folder and the warehouse derived from it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = tune(spark)
        self.sf_dir = sf_dir
        self.wh = demo.warehouse(spark, sf_dir)

    def table(self, name: str) -> DataFrame:
        return demo.derived(self.spark, self.sf_dir)[name]

    @property
    def feed(self) -> DataFrame:
        return demo.feed(self.spark, self.sf_dir)

    def feed_of(self, source: str) -> DataFrame:
        return self.feed.filter(F.col("source") == source).drop("source")

    @property
    def decided(self) -> DataFrame:
        return resolve.decide(self.table("review_candidates"), self.table("review_decisions"))

    @property
    def overrides(self) -> resolve.Overrides:
        return resolve.approved_overrides(checkpoint(self.decided))


def query(name: str) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        REGISTRY[name] = function
        return function

    return add


def flat(df: DataFrame) -> DataFrame:
    """Plain columns for comparison: lists joined, whole numbers as bigint, money as double."""
    out = []
    for field in df.schema.fields:
        col, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, T.ArrayType):
            col = F.array_join(col.cast("array<string>"), ",")
        elif isinstance(kind, (T.IntegerType, T.ShortType)):
            col = col.cast("bigint")
        elif isinstance(kind, T.DecimalType):
            col = col.cast("double")
        elif isinstance(kind, (T.DateType, T.TimestampType)):
            col = col.cast("string")
        out.append(col.alias(field.name))
    return df.select(*out)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(function: Query):
        return lambda spark, sf_dir: flat(function(Run(spark, sf_dir)))

    return {name: bound(function) for name, function in REGISTRY.items()}


# --- named queries ----------------------------------------------------------------------------


@query("q01_golden_records")
def _(r: Run):
    return entities.golden_records(r.wh)


@query("q01_golden_records_fed")
def _(r: Run):
    return entities.golden_records(r.wh, limit=100, dataset_filter="fed").select(
        "entity_id", "canonical_name", "source_link_count"
    )


@query("q02_directors_for_org")
def _(r: Run):
    return directors.directors_for_org(r.wh)


@query("q03_funding_edges")
def _(r: Run):
    return edges.funding_edges(r.wh)


@query("q03_funding_edges_out")
def _(r: Run):
    return edges.funding_edges(r.wh, "out")


@query("q04_precomputed_cycles")
def _(r: Run):
    return cycles.precomputed_cycles(r.wh)


@query("q05_cycle_edges")
def _(r: Run):
    return cycles.cycle_edges(r.wh)


@query("q06_cycle_summary")
def _(r: Run):
    return cycles.cycle_summary(r.wh)


@query("q07_source_summary")
def _(r: Run):
    return entities.source_summary(r.wh)


@query("q08_sole_source_flags")
def _(r: Run):
    return edges.sole_source_flags(r.wh)


@query("q09_fed_concentration")
def _(r: Run):
    return edges.fed_concentration(r.wh).withColumns(
        {c: F.round(c, 9) for c in ("hhi_score", "top_dept_share")}
    )


@query("q10_related_entities")
def _(r: Run):
    return entities.related_entities(r.wh).drop("evidence")


@query("q11_entities_by_ids")
def _(r: Run):
    wanted = r.wh.table("entity_source_links").select("entity_id")
    return entities.entities_by_ids(r.wh, wanted)


@query("q12_evidence_for_edges")
def _(r: Run):
    gifts = edges.money_edges(r.wh).select("source", "source_row_id")
    people = directors.directors_for_org(r.wh).select(
        F.lit("cra_director").alias("source"), "source_row_id"
    )
    loops = cycles.cycle_edges(r.wh).select("source", "source_row_id")
    return evidence.evidence_for_edges(r.wh, gifts.unionByName(people).unionByName(loops))


@query("q13_cycle_edge_evidence")
def _(r: Run):
    return cycles.cycle_edge_evidence(r.wh)


@query("q14_shared_director_candidates")
def _(r: Run):
    return directors.shared_director_candidates(r.wh)


@query("q15_high_overhead")
def _(r: Run):
    return risk.high_overhead(r.wh, since=SINCE)


@query("q16_address_clusters")
def _(r: Run):
    return entities.address_clusters(r.wh)


@query("q17_nonqualified_donees")
def _(r: Run):
    return risk.nonqualified_recipients(r.wh, since=SINCE)


@query("q18_ring_funding_edges")
def _(r: Run):
    members = rings.ring_members(rings.find_related_party_rings(r.wh))
    return edges.ring_funding_edges(r.wh, members)


@query("q19_shared_director_funding_pairs")
def _(r: Run):
    return pairs.shared_director_funding_pairs(r.wh)


@query("q20_director_funding_pairs_fast")
def _(r: Run):
    return pairs.director_rings_table(r.wh, min_amount=60_000)


@query("q21_contractor_directors")
def _(r: Run):
    return pairs.contractor_directors(r.wh)


@query("q22_charities_for_directors")
def _(r: Run):
    return pairs.charities_for_directors(r.wh, pairs.contractor_directors(r.wh))


@query("q23_crossover")
def _(r: Run):
    return pairs.crossover_table(r.wh)


@query("q23_crossover_display")
def _(r: Run):
    return pairs.crossover_display(pairs.crossover_table(r.wh))


@query("q24_top_cycles")
def _(r: Run):
    return cycles.precomputed_cycles(r.wh, limit=30).drop("min_year", "max_year")


@query("q25_shared_directors_bulk")
def _(r: Run):
    return directors.directors_bulk(r.wh, r.wh.entities.select(F.col("id").alias("entity_id")))


@query("q26_smoke_counts")
def _(r: Run):
    return entities.smoke_counts(r.wh)


# --- graph ------------------------------------------------------------------------------------


@query("g01_vertices")
def _(r: Run):
    return graph.vertices(r.wh).drop("aliases")


@query("g02_edges")
def _(r: Run):
    return graph.graph_edges(r.wh)


@query("g03_ego_graph")
def _(r: Run):
    everyone = r.wh.entities.select(F.col("id").alias("entity_id"))
    return graph.ego_graph(r.wh, everyone, radius=1).select(
        "seed", "src", "dst", "source", "amount", "source_row_id"
    )


@query("g03_ego_graph_of_top_cycle")
def _(r: Run):
    seeds = cycles.members(r.wh, cycles.top_cycles(r.wh, limit=1), bounded=True)
    return graph.ego_graph(r.wh, seeds, radius=2).select(
        "seed", "src", "dst", "source", "amount", "source_row_id"
    )


@query("g04_ring_graph")
def _(r: Run):
    return graph.ring_graph(r.wh, graph.members_of(rings.prewarmed_rings(r.wh)))


@query("g05_cycle_graph")
def _(r: Run):
    return graph.cycle_graph(r.wh)


@query("g06_shared_directors")
def _(r: Run):
    return directors.shared_by_all(r.wh, _all_members(r))


def _all_members(r: Run) -> DataFrame:
    """Members of every ring candidate: cycles and director pairs."""
    loops = cycles.members(r.wh, cycles.top_cycles(r.wh), bounded=True).select(
        ids.cycle_ring_id(F.col("cycle_id")).alias("ring_id"), "entity_id"
    )
    pair_rows = pairs.director_funding_pairs_fast(r.wh, min_amount=60_000)
    pair_members = pair_rows.select(
        ids.pair_ring_id(
            F.col(directors.NAME), F.col("entity_id_a"), F.col("entity_id_b")
        ).alias("ring_id"),
        F.explode(F.array("entity_id_a", "entity_id_b")).alias("entity_id"),
    )
    return loops.unionByName(pair_members)


@query("g07_ring_edges")
def _(r: Run):
    return graph.ring_edges(r.wh, graph.members_of(rings.prewarmed_rings(r.wh)))


@query("g08_related_party_rings")
def _(r: Run):
    return _ring_columns(rings.find_related_party_rings(r.wh))


def _ring_columns(df: DataFrame, *more: str) -> DataFrame:
    return df.select(
        "ring_id",
        "ring_type",
        "entity_ids",
        "canonical_names",
        "shared_persons",
        "total_amount",
        "flags",
        *more,
    )


@query("g09_analyze_neighborhood")
def _(r: Run):
    seeds = r.feed.select(
        (F.substring(ids.normalize_bn(F.coalesce("recipient_business_number", "BN")), 4, 6).cast("bigint") - 1).alias(
            "entity_id"
        )
    ).filter("entity_id IS NOT NULL")
    return rings.analyze_neighborhood(r.wh, seeds).select(
        "ring_id", "entity_ids", "canonical_names", "total_amount", "seeds_touched"
    )


@query("g10_prewarmed_rings")
def _(r: Run):
    return _ring_columns(rings.prewarmed_rings(r.wh), "total_score")


@query("g11_export_nodes")
def _(r: Run):
    top_ring = cycles.members(r.wh, cycles.top_cycles(r.wh, limit=1), bounded=True)
    hot = top_ring.select(F.col("entity_id").cast("string").alias("node_id"))
    return graph.export_nodes(graph.vertices(r.wh), hot)


@query("g11_export_edges")
def _(r: Run):
    return graph.export_edges(graph.graph_edges(r.wh)).select(
        "id", "from", "to", "label", "color", "amount"
    )


@query("g12_evidence_table")
def _(r: Run):
    return graph.evidence_table(r.wh, graph.graph_edges(r.wh))


@query("g13_crossover_edges")
def _(r: Run):
    return graph.crossover_graph_edges(pairs.crossover_table(r.wh)).select(
        "charity_entity_id", "contractor_entity_id", "src", "dst", "source", "amount"
    )


@query("g13_crossover_nodes")
def _(r: Run):
    return graph.crossover_graph_nodes(pairs.crossover_table(r.wh))


@query("g14_director_overlay")
def _(r: Run):
    return graph.director_overlay(r.wh, rings.prewarmed_rings(r.wh)).select(
        "ring_id", "src", "dst", "source", "amount", "date"
    )


@query("g15_light_ring_edges")
def _(r: Run):
    return graph.light_ring_edges(rings.top_rings(r.wh)).select(
        "ring_id", "src", "dst", "source", "amount", "date"
    )


@query("g15_light_ring_nodes")
def _(r: Run):
    return graph.light_ring_nodes(rings.prewarmed_rings(r.wh))


@query("g16_cycle_detection")
def _(r: Run):
    found = cycles.detect(r.wh.gifts, min_edge_amount=90_000)
    return found["loops"]


@query("g16_all_short_loops")
def _(r: Run):
    return cycles.detect(r.wh.gifts, min_edge_amount=None, max_hops=3)["loops"]


@query("g16_loop_edges")
def _(r: Run):
    return r.wh.loop_edges


@query("g16_loop_participants")
def _(r: Run):
    return r.wh.table("loop_participants")


# --- policy patterns --------------------------------------------------------------------------


@query("x1_conduits")
def _(r: Run):
    """The derived money is thin, so a hundredth passed on counts here, with or without shared directors."""
    return patterns.conduits(r.wh, min_share=0.01, min_shared=0)


@query("x2_pass_through")
def _(r: Run):
    return patterns.pass_through(r.wh, min_share=0.05)


@query("x3_department_concentration")
def _(r: Run):
    return patterns.department_concentration(r.wh)


@query("x4_lobbyist_charities")
def _(r: Run):
    return patterns.lobbyist_charities(r.wh)


@query("x6_revolving_door")
def _(r: Run):
    return patterns.revolving_door(r.wh)


@query("x6_contact_before_award")
def _(r: Run):
    return patterns.contact_before_award(r.wh)


# --- scoring ----------------------------------------------------------------------------------


@query("ru1_funding_concentration")
def _(r: Run):
    return scoring.rule_funding_concentration(r.wh)


@query("ru2_cycle_member")
def _(r: Run):
    return scoring.rule_cycle_member(r.wh)


@query("ru3_shared_director")
def _(r: Run):
    return scoring.rule_shared_director(r.wh)


@query("ru4_sole_source")
def _(r: Run):
    return scoring.rule_sole_source(r.wh)


@query("ru5_related_entity_funding")
def _(r: Run):
    return scoring.rule_related_entity(r.wh)


@query("sc1_score_all")
def _(r: Run):
    return scoring.score_all(r.wh)


@query("sc2_ring_score")
def _(r: Run):
    shared = directors.shared_by_two(r.wh, _cycle_members(r)).select("ring_id").distinct()
    headers = cycles.top_cycles(r.wh).select(
        ids.cycle_ring_id(F.col("cycle_id")).alias("ring_id"), "total_amount"
    )
    return headers.join(shared.withColumn("_s", F.lit(True)), "ring_id", "left").select(
        "ring_id",
        values.ring_score(F.col("total_amount"), F.coalesce("_s", F.lit(False))).alias("total_score"),
    )


def _cycle_members(r: Run) -> DataFrame:
    return cycles.members(r.wh, cycles.top_cycles(r.wh), bounded=True).select(
        ids.cycle_ring_id(F.col("cycle_id")).alias("ring_id"), "entity_id"
    )


@query("sc3_top_rings")
def _(r: Run):
    return _ring_columns(rings.top_rings(r.wh), "total_score")


@query("sc3_top_ring_evidence")
def _(r: Run):
    return rings.top_rings(r.wh).select("ring_id", F.inline("evidence"))


@query("sc4_node_scores")
def _(r: Run):
    report = rings.prewarmed_rings(r.wh)
    drawn = graph.vertices_of(r.wh, graph.director_overlay(r.wh, report), ["ring_id"])
    nodes = drawn.withColumn("total_score", F.lit(None).cast("double"))
    return scoring.node_scores(nodes, report)


# --- entity resolution ------------------------------------------------------------------------


@query("er1_extract_records")
def _(r: Run):
    return linkage.extract_records(r.wh)


@query("er2_candidate_pairs")
def _(r: Run):
    return _pair_text(linkage.candidate_pairs(_profiles(r), columns=linkage.COMPARED))


def _profiles(r: Run) -> DataFrame:
    return checkpoint(linkage.profiles(linkage.extract_records(r.wh)))


def _text_of(side: str = "") -> Column:
    return F.concat_ws("/", *[F.coalesce(F.col(f"{c}{side}"), F.lit("-")) for c in linkage.COMPARED])


def _pair_text(found: DataFrame, *more) -> DataFrame:
    """Pairs that carry their compared columns, as texts."""
    texts = [_text_of("_l"), _text_of("_r")]
    return found.select(F.least(*texts).alias("a"), F.greatest(*texts).alias("b"), *more)


def _profile_text(found: DataFrame, rows: DataFrame, *more) -> DataFrame:
    text = _text_of()
    left = rows.select(F.col("profile_id").alias("profile_l"), text.alias("left_text"))
    right = rows.select(F.col("profile_id").alias("profile_r"), text.alias("right_text"))
    return (
        found.join(left, "profile_l")
        .join(right, "profile_r")
        .select(
            F.least("left_text", "right_text").alias("a"),
            F.greatest("left_text", "right_text").alias("b"),
            *more,
        )
    )


@query("er3_pair_comparison")
def _(r: Run):
    return (
        linkage.compared_pairs(_profiles(r))
        .groupBy(*linkage.GAMMAS)
        .agg(F.count("*").alias("pair_count"))
    )


@query("er3_compared_pairs")
def _(r: Run):
    """The pairs themselves with their levels, as texts."""
    return _pair_text(linkage.compared_pairs(_profiles(r)), *linkage.GAMMAS)


# A model of given numbers, so that predictions can be recomputed elsewhere.
FIXED_MODEL = linkage.Model(
    m={
        "bn_root": np.array([0.1, 0.9]),
        "cleaned_name": np.array([0.05, 0.05, 0.1, 0.8]),
        "city": np.array([0.2, 0.8]),
        "province": np.array([0.1, 0.9]),
        "entity_type": np.array([0.1, 0.9]),
    },
    u={
        "bn_root": np.array([0.999, 0.001]),
        "cleaned_name": np.array([0.97, 0.015, 0.01, 0.005]),
        "city": np.array([0.9, 0.1]),
        "province": np.array([0.8, 0.2]),
        "entity_type": np.array([0.5, 0.5]),
    },
    prior=0.001,
)


@query("er4_fixed_predictions")
def _(r: Run):
    rows = _profiles(r)
    found = checkpoint(linkage.predict(rows, FIXED_MODEL))
    rounded = [F.round("match_weight", 6).alias("match_weight"), F.round("match_probability", 6).alias("match_probability")]
    return _profile_text(found, rows, *linkage.GAMMAS, *rounded)


@query("er4_fixed_clusters")
def _(r: Run):
    """Each profile with the alphabetically first of its cluster."""
    rows = _profiles(r)
    placed = linkage.clusters(rows, checkpoint(linkage.predict(rows, FIXED_MODEL)))
    text = F.concat_ws("/", *[F.coalesce(F.col(c), F.lit("-")) for c in linkage.COMPARED])
    named = placed.join(rows.select("profile_id", text.alias("profile")), "profile_id")
    first = named.groupBy("cluster_id").agg(F.min("profile").alias("first_profile"))
    return named.join(first, "cluster_id").select("profile", "first_profile")


@query("er4b_entity_profiles")
def _(r: Run):
    """The groups behind the candidates: which entities share a whole profile."""
    return linkage.entity_profiles(linkage.extract_records(r.wh)).drop("profile_id")


@query("er4_predictions")
def _(r: Run):
    return linkage.run_linkage(r.wh).predictions


@query("er4_clusters")
def _(r: Run):
    return linkage.run_linkage(r.wh).clusters


@query("er4b_candidates")
def _(r: Run):
    return linkage.run_linkage(r.wh).candidates


@query("er5_resolve_fed_grants")
def _(r: Run):
    return _resolved(r, "fed_grants")


@query("er5_resolve_cra_t3010")
def _(r: Run):
    return _resolved(r, "cra_t3010")


@query("er5_resolve_cra_donees")
def _(r: Run):
    return _resolved(r, "cra_donees")


def _resolved(r: Run, source: str) -> DataFrame:
    index = resolve.build_index(r.wh, r.overrides)
    rows = r.feed_of(source)
    return resolve.resolved_entities(resolve.resolve_rows(rows, source, index, "seq"), index)


@query("er6_coverage")
def _(r: Run):
    index = resolve.build_index(r.wh, r.overrides)
    rows = r.feed_of("cra_donees")
    return resolve.coverage(rows, resolve.resolve_rows(rows, "cra_donees", index, "seq"))


@query("er6_index_stats")
def _(r: Run):
    return resolve.index_stats(resolve.build_index(r.wh, r.overrides), r.overrides)


@query("er7_candidate_status")
def _(r: Run):
    return resolve.with_status(r.table("review_candidates")).select(
        "candidate_id", "match_probability", "status"
    )


@query("er8_survivor_overrides")
def _(r: Run):
    return resolve.survivor_overrides(r.decided)


@query("er8_alias_overrides")
def _(r: Run):
    return resolve.alias_overrides(r.decided)


@query("er8b_decided_candidates")
def _(r: Run):
    return r.decided


@query("er9_approved_overrides")
def _(r: Run):
    approved = r.overrides
    survivors = approved.survivors.select(
        F.lit("survivor").alias("kind"),
        F.col("duplicate_entity_id").cast("string").alias("key"),
        F.col("survivor_entity_id").alias("entity_id"),
        "confidence",
    )
    return survivors.unionByName(
        approved.aliases.select(
            F.lit("alias").alias("kind"), F.col("alias_norm").alias("key"), "entity_id", "confidence"
        )
    )


@query("er10_review_queue")
def _(r: Run):
    return resolve.review_queue(r.decided, "needs_review", limit=100).select(
        "candidate_id", "match_probability", "status"
    )


@query("er10_review_summary")
def _(r: Run):
    return resolve.review_summary(r.decided)


@query("er11_run_record")
def _(r: Run):
    rows = linkage.extract_records(r.wh)
    decided = r.decided
    groups = decided.select(F.col("status").alias("cluster_id"))
    return resolve.run_record("run-1", 0.4, rows, decided, groups).drop("completed_at")


# --- ingest -----------------------------------------------------------------------------------

SOURCES = ("fed_grants", "cra_t3010", "cra_donees")


def _checked(r: Run, source: str) -> DataFrame:
    return validate.checked(r.feed_of(source), source, F.col("batch_id"))


def _union(parts: list[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query("src5_newest_rows")
def _(r: Run):
    return validate.newest(r.feed_of("fed_grants"), 500).select("_id", "seq")


@query("st1_unseen_rows")
def _(r: Run):
    earlier = F.col("batch_id").isin("b0", "b1")
    seen = r.feed.filter(earlier).select("source", F.col("_id").alias("external_id")).distinct()
    return _union(
        [
            validate.unseen(r.feed.filter(~earlier & (F.col("source") == s)), seen, s).select(
                "source", "_id", "seq"
            )
            for s in SOURCES
        ]
    )


@query("st2_source_state")
def _(r: Run):
    progress = [
        validate.source_progress(r.feed_of(s).filter(F.col("batch_id") == b), s).withColumn(
            "run_at", F.lit(f"2024-01-0{i + 1} 00:00:00").cast("timestamp")
        )
        for s in SOURCES
        for i, b in enumerate(("b0", "b1", "b2", "b3"))
    ]
    return validate.source_state(_union(progress))


@query("st3_valid_rows")
def _(r: Run):
    return _union(
        [
            validate.valid_rows(_checked(r, s)).select(
                F.lit(s).alias("source"), F.col("_id").alias("external_id"), "seq", "_batch_id"
            )
            for s in SOURCES
        ]
    )


@query("st4_row_hash")
def _(r: Run):
    rows = r.feed_of("cra_t3010").select("_id", "BN", "seq")
    return validate.valid_rows(validate.checked(rows, "cra_t3010", F.lit("b"))).select(
        "seq", "_batch_id", "_row_hash"
    )


@query("st5_quarantine")
def _(r: Run):
    parts = []
    for s in SOURCES:
        bad = validate.quarantine(_checked(r, s), s)
        parts.append(
            bad.select("batch_id", "source", "external_id", "error", F.get_json_object("raw_row", "$.seq").alias("seq"))
        )
    return _union(parts)


@query("st6_batch_ledger")
def _(r: Run):
    return _union([validate.ledger(_checked(r, s), s) for s in SOURCES])


def _findings(r: Run, source: str) -> DataFrame:
    index = resolve.build_index(r.wh, r.overrides)
    good = validate.valid_rows(_checked(r, source))
    resolved = resolve.resolve_rows(good.drop("batch_id"), source, index, "seq")
    prior = cycles.top_cycles(r.wh, limit=50).select(
        ids.cycle_ring_id(F.col("cycle_id")).alias("ring_id")
    )
    return findings.analyze(r.wh, good, resolved, index, source, prior, order="seq").withColumn(
        "created_at",
        F.timestamp_seconds(F.coalesce(F.col("trigger_external_id").try_cast("bigint"), F.lit(0))),
    )


@query("st7_findings_fed_grants")
def _(r: Run):
    return _findings(r, "fed_grants").drop("trigger_row_hash", "created_at")


@query("st7_findings_cra_donees")
def _(r: Run):
    return _findings(r, "cra_donees").drop("trigger_row_hash", "created_at")


@query("st9_list_findings")
def _(r: Run):
    return findings.list_findings(
        _findings(r, "fed_grants"), since="1970-01-01 00:10:00", limit=50
    ).select("ring_id", "trigger_external_id", "severity")


@query("st9_count_findings")
def _(r: Run):
    return findings.count_findings(_findings(r, "cra_donees"))


@query("st10_finding_labels")
def _(r: Run):
    return findings.finding_labels(_findings(r, "fed_grants"), rings.prewarmed_rings(r.wh))


@query("st10_rings_from_findings")
def _(r: Run):
    return findings.rings_from_findings(
        _findings(r, "fed_grants"), rings.prewarmed_rings(r.wh)
    ).select("ring_id", "ring_type", "entity_ids", "canonical_names", "total_amount", "flags")


@query("st11_live_summary")
def _(r: Run):
    states = r.feed.groupBy(F.col("source").alias("name")).agg(
        F.timestamp_seconds(F.max("seq")).alias("last_run_at")
    )
    return findings.live_summary(_findings(r, "fed_grants"), states)


# --- dossier ----------------------------------------------------------------------------------


@query("cd1_dossier_entities")
def _(r: Run):
    return dossier.entity_table(r.wh, rings.find_related_party_rings(r.wh), F.lit("fed_grants"))


@query("cd2_dossier_header")
def _(r: Run):
    return dossier.header(r.wh, rings.find_related_party_rings(r.wh))


@query("cd3_crossover_totals")
def _(r: Run):
    return dossier.crossover_totals(pairs.crossover_table(r.wh))


@query("cd3_crossover_selector")
def _(r: Run):
    return dossier.crossover_selector(pairs.crossover_table(r.wh))


@query("cd4_ring_split")
def _(r: Run):
    return dossier.ring_split(rings.find_related_party_rings(r.wh))


# --- functions --------------------------------------------------------------------------------


@query("fn01_director_norm")
def _(r: Run):
    first, last = F.col("first_name"), F.col("last_name")
    return r.wh.directors.select(
        first, last, names.director_norm(first, last).alias("director_name_normalized")
    ).distinct()


@query("fn02_director_simple")
def _(r: Run):
    first, last = F.col("first_name"), F.col("last_name")
    return r.wh.directors.select(names.director_simple(first, last).alias("director_norm")).distinct()


@query("fn03_bn_left")
def _(r: Run):
    return r.wh.gifts.groupBy(ids.bn_left(F.col("donee_bn")).alias("bn_root")).agg(
        F.count("*").alias("gifts")
    )


@query("fn04_normalize_bn")
def _(r: Run):
    raw = F.coalesce("recipient_business_number", "BN")
    return r.feed.select("seq", ids.normalize_bn(raw).alias("bn"))


@query("fn05_bn_root")
def _(r: Run):
    padded = F.concat(F.left("bn_root", F.lit(1)), F.lit("00000000 RR"), F.right("bn_root", F.lit(4)))
    value = F.when(F.col("id") % 3 == 0, padded).otherwise(F.element_at("bn_variants", 1))
    return r.wh.entities.select("id", ids.bn_root(value).alias("root"))


@query("fn06_normalize_name")
def _(r: Run):
    return r.wh.links.groupBy(names.normalize_name(F.col("source_name")).alias("name")).agg(
        F.count("*").alias("n")
    )


@query("fn07_clean_name")
def _(r: Run):
    both = F.concat("canonical_name", F.lit(" / Fondation "), "canonical_name")
    name = F.when(F.col("id") % 2 == 0, both).otherwise(F.col("canonical_name"))
    listed = r.wh.entities.select(name.alias("raw")).unionByName(
        r.wh.links.filter("source_name IS NOT NULL").select(F.col("source_name").alias("raw"))
    )
    return listed.distinct().select("raw", names.clean_name(F.col("raw")).alias("cleaned"))


@query("fn08_row_hash")
def _(r: Run):
    rows = r.wh.table("ab_contracts")
    return rows.select("id", ids.row_hash(rows).alias("row_hash"))


@query("fn09_stable_id")
def _(r: Run):
    return r.wh.entities.select(
        "id",
        ids.stable_id(F.col("canonical_name"), F.col("bn_root"), F.col("entity_type")).alias("stable_id"),
    )


@query("fn10_address_field")
def _(r: Run):
    a = F.col("addresses")
    return r.wh.entities.select(
        "id",
        values.address_field(a, "city", "municipality").alias("city"),
        values.address_field(a, "province", "province_code", "state").alias("province"),
        values.address_field(a, "postal_code", "postal", "zip").alias("postal"),
    )


@query("fn11_alias_text")
def _(r: Run):
    listed = r.wh.entities.select("id", F.explode(F.from_json("aliases", "array<variant>")).alias("a"))
    return listed.select(
        "id",
        names.alias_text(F.col("a")).alias("alias"),
        names.alias_string(F.col("a")).alias("string_alias"),
    )


@query("fn12_filing_row_id")
def _(r: Run):
    row_id = ids.filing_row_id(F.col("bn"), F.col("fpe"), F.col("sequence_number"))
    return r.wh.directors.groupBy(row_id.alias("row_id")).agg(F.count("*").alias("n"))


@query("fn13_safe_ratio")
def _(r: Run):
    ratio = values.safe_ratio(F.col("field_390"), F.col("field_5100"))
    return (
        r.wh.table("cra_compensation")
        .join(r.wh.table("cra_financial_details"), ["bn", "fpe"])
        .select("bn", "fpe", F.round(ratio * 100, 1).alias("pct"))
    )


@query("fn14_year")
def _(r: Run):
    return r.wh.gifts.groupBy(F.year("fpe").alias("year")).agg(F.sum("total_gifts").alias("gifts"))


@query("fn15_row_json")
def _(r: Run):
    return r.wh.table("ab_contracts").select(F.to_json(F.struct("id", "amount")).alias("row"))


@query("fn16_json_field")
def _(r: Run):
    return entities.related_entities(r.wh).groupBy("relationship_type", "confidence_score").agg(
        F.count("related_entity_id").alias("n")
    )


@query("fn17_parse_amount")
def _(r: Run):
    raw = F.coalesce("agreement_value", "Total Gifts")
    return r.feed.select("seq", values.parse_amount(raw).alias("amount"))


@query("fn18_probability_band")
def _(r: Run):
    p = F.col("match_probability")
    return r.table("review_candidates").select(
        "candidate_id",
        values.probability_band(p).alias("band"),
        values.candidate_status(p).alias("status"),
    )


@query("fn19_severity")
def _(r: Run):
    amount, found = F.col("agreement_value") * 4, F.coalesce("amendment_number", F.lit(0))
    return r.wh.table("grants_contributions").select(
        "_id", values.severity(amount, found).alias("severity")
    )


@query("fn20_narrative")
def _(r: Run):
    listed = rings.with_member_names(r.wh, rings.cycle_rings(r.wh, 5000), prefix="")
    return listed.select(
        "ring_id",
        values.finding_narrative(
            F.lit("fed_grants"),
            F.col("total_amount") / 2,
            F.element_at("canonical_names", 1),
            F.lit("42"),
            F.col("ring_id"),
            F.col("total_amount"),
            F.col("canonical_names"),
        ).alias("narrative"),
    )


@query("fn21_ring_type")
def _(r: Run):
    loops = r.wh.loops.select(
        ids.cycle_ring_id(F.col("id")).alias("ring_id"),
        F.when(F.col("hops") % 2 == 0, " Shared_Director ").alias("given"),
    )
    other = r.wh.links.select(F.col("id").alias("ring_id"), F.lit("").alias("given"))
    return loops.unionByName(other).groupBy(
        ids.ring_type(F.col("given"), F.col("ring_id")).alias("ring_type")
    ).agg(F.count("*").alias("n"))


@query("fn22_severity_rank")
def _(r: Run):
    ranked = r.wh.table("grants_contributions").select(
        values.severity(F.col("agreement_value") * 4, F.coalesce("amendment_number", F.lit(0))).alias("severity"),
        F.col("agreement_start_date").cast("timestamp").alias("created_at"),
        F.col("owner_org").alias("source"),
        F.col("_id").cast("string").alias("ring_id"),
    )
    return findings.default_finding(ranked).select(
        "severity", values.severity_rank(F.col("severity")).alias("rank"), "ring_id"
    )


@query("fn23_badges")
def _(r: Run):
    # Three schemas exist, so the set stays tiny.
    held = r.wh.links.groupBy("entity_id").agg(F.collect_set("source_schema").alias("schemas"))
    return held.select(
        "entity_id", F.array_join(values.source_badges(F.col("schemas"), F.lit("fed_grants")), ", ").alias("badges")
    )


@query("fn24_jaro_winkler")
def _(r: Run):
    named = _profiles(r).select(F.col("cleaned_name").alias("profile_id"), "bn_root").distinct()
    found = (
        linkage.block_pairs(named, [F.col("bn_root")])
        .select(F.col("profile_l").alias("a"), F.col("profile_r").alias("b"))
        .distinct()
    )
    return found.select(
        "a", "b", F.round(similarity.jaro_winkler(F.col("a"), F.col("b")), 9).alias("score")
    )


@query("fn25_ring_ids")
def _(r: Run):
    ring = ids.cycle_ring_id(F.col("id"))
    pair = ids.pair_ring_id(F.lit("jane doe"), F.col("hops").cast("bigint"), F.col("min_year").cast("bigint"))
    return r.wh.loops.select(
        ring.alias("ring_id"), ids.cycle_id_of_ring(ring).alias("cycle_id"), pair.alias("pair_id")
    )


@query("fn26_feed_keys")
def _(r: Run):
    keyed = resolve.feed_keys(r.feed_of("cra_donees"), "cra_donees", "seq")
    return keyed.select(
        "external_id",
        F.col("_order").alias("seq"),
        F.array_join(F.col("numbers.key"), "+").alias("numbers"),
        F.element_at("name", 1)["key"].alias("name"),
    )
