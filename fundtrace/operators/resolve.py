"""Feed rows to canonical entities, and the review of match candidates (ER5-ER11).

Matching is kept at the level of keys: a business number or a name points to its entities once,
and feed rows point to keys. A key that many rows and many entities share is therefore never
multiplied out until somebody asks for the (row, entity) listing.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundtrace import schemas
from fundtrace.functions import ids, names, values
from fundtrace.operators.entities import top
from fundtrace.session import checkpoint
from fundtrace.sources.warehouse import Warehouse, empty

# Feed fields per source. A source without a name field never matches by name.
FEED_FIELDS = {
    "fed_grants": {
        "bn": ["recipient_business_number"],
        "name": "recipient_legal_name",
        "external_id": "_id",
    },
    "cra_t3010": {"bn": ["BN"], "name": None, "external_id": "_id"},
    "cra_donees": {"bn": ["BN", "Donee BN"], "name": "Donee Name", "external_id": "_id"},
}

# Mapping methods.
BY_NUMBER = "bn_root"
BY_NAME = "exact_name_or_alias"
BY_ALIAS_OVERRIDE = "splink_alias_override"
BY_SURVIVOR = "splink_survivor_override"


class Overrides(NamedTuple):
    """Approved alias and survivor overrides."""

    aliases: DataFrame
    survivors: DataFrame

    @classmethod
    def none(cls, wh: Warehouse) -> Overrides:
        return cls(
            empty(wh.spark, schemas.ALIAS_OVERRIDE), empty(wh.spark, schemas.SURVIVOR_OVERRIDE)
        )


class MatchIndex(NamedTuple):
    """``keys`` has one row per key with what a match by it means; ``entities`` its ids, which may be listed twice."""

    keys: DataFrame
    entities: DataFrame


def _confidence() -> Column:
    return F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(1.0))


def _collapse(rows: DataFrame, survivors: DataFrame) -> DataFrame:
    """Replace duplicates by their survivor, one hop; ``hop_confidence`` where that happened."""
    hops = survivors.select(
        F.col("duplicate_entity_id").alias("entity_id"),
        F.col("survivor_entity_id").alias("_to"),
        _confidence().alias("hop_confidence"),
    )
    return (
        rows.join(hops, "entity_id", "left")
        .withColumn("moved", F.coalesce(F.col("_to") != F.col("entity_id"), F.lit(False)))
        .withColumn("entity_id", F.coalesce("_to", "entity_id"))
        .drop("_to")
    )


def build_index(wh: Warehouse, overrides: Overrides | None = None) -> MatchIndex:
    """Numbers, canonical names, string aliases and approved aliases of active entities."""
    overrides = overrides or Overrides.none(wh)
    active = wh.active_entities
    numbers = active.filter("bn_root IS NOT NULL AND bn_root <> ''").select(
        F.lit("number").alias("kind"), F.left("bn_root", F.lit(9)).alias("key"), F.col("id").alias("entity_id")
    )
    # Names are shuffled as they are written and normalised after that: the records lie in few files, so in few tasks.
    canonical = active.select(F.col("canonical_name").alias("name"), F.col("id").alias("entity_id"))
    listed = active.select(
        F.explode(F.from_json("aliases", "array<variant>")).alias("a"), F.col("id").alias("entity_id")
    ).select(names.alias_string(F.col("a")).alias("name"), "entity_id")
    approved = overrides.aliases.filter("alias_norm IS NOT NULL AND entity_id IS NOT NULL")
    by_name = (
        canonical.unionByName(listed)
        .filter("name IS NOT NULL")
        .distinct()
        .select(names.normalize_name(F.col("name")).alias("key"), "entity_id")
        .unionByName(approved.select(F.col("alias_norm").alias("key"), "entity_id"))
    )
    # Names are collapsed when the index is built and once more when they match.
    by_name = (
        _collapse(by_name, overrides.survivors)
        .select(F.lit("name").alias("kind"), "key", "entity_id")
        .distinct()
    )
    alias_confidence = approved.select(
        F.lit("name").alias("kind"),
        F.col("alias_norm").alias("key"),
        "entity_id",
        _confidence().alias("alias_confidence"),
    )
    override_names = approved.select(
        F.lit("name").alias("kind"), F.col("alias_norm").alias("key"), F.lit(True).alias("is_alias")
    ).distinct()
    loaded = (
        numbers.distinct()
        .unionByName(by_name)
        .join(alias_confidence, ["kind", "key", "entity_id"], "left")
    )
    # The index is stored once and read by every batch. Names too short for a key drop out here: a filter further up would
    # be moved to the records and normalise every name there too.
    final = checkpoint(_collapse(loaded, overrides.survivors)).filter("key IS NOT NULL")
    keys = (
        final.groupBy("kind", "key")
        .agg(
            F.max("moved").alias("moved"),
            F.min("hop_confidence").alias("hop_confidence"),
            F.max("alias_confidence").alias("alias_confidence"),
        )
        .join(override_names, ["kind", "key"], "left")
    )
    return MatchIndex(checkpoint(keys), final.select("kind", "key", "entity_id"))


def index_stats(index: MatchIndex, overrides: Overrides) -> DataFrame:
    return (
        index.keys.agg(
            F.count_if(F.col("kind") == "number").alias("bn_keys"),
            F.count_if(F.col("kind") == "name").alias("name_keys"),
            F.count_if("is_alias").alias("splink_alias_keys"),
        )
        .withColumn("_k", F.lit(1))
        .join(
            overrides.survivors.agg(
                F.count_distinct("duplicate_entity_id").alias("splink_survivor_overrides")
            ).withColumn("_k", F.lit(1)),
            "_k",
        )
        .drop("_k")
    )


def _key_columns(rows: DataFrame, source: str, order: str | None) -> tuple[DataFrame, list[str]]:
    """Feed rows with one column per business number and ``by_name``, and the names of the number columns."""
    spec = FEED_FIELDS[source]
    numbers = {f"number_{i}": ids.normalize_bn(F.col(f"`{c}`")) for i, c in enumerate(spec["bn"])}
    name = F.lit(None).cast("string")
    if spec["name"]:
        name = names.normalize_name(F.col(f"`{spec['name']}`"))
    keyed = rows.filter(F.col(spec["external_id"]).isNotNull()).select(
        F.col(spec["external_id"]).cast("string").alias("external_id"),
        (F.lit(0) if order is None else F.col(order)).alias("_order"),
        ids.row_hash(rows).alias("_row"),
        *[number.alias(column) for column, number in numbers.items()],
        name.alias("by_name"),
    )
    return keyed, list(numbers)


def _key(kind: str, column: str) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.col(column).alias("key"))


def feed_keys(rows: DataFrame, source: str, order: str | None = None) -> DataFrame:
    """External id, arrival order and match keys of each feed row; rows without an id drop out."""
    keyed, numbers = _key_columns(rows, source, order)
    given = F.array_distinct(F.array_compact(F.array(*numbers)))
    return keyed.select(
        "external_id",
        "_order",
        "_row",
        F.transform(given, lambda n: F.struct(F.lit("number").alias("kind"), n.alias("key"))).alias("numbers"),
        F.when(F.col("by_name").isNotNull(), F.array(_key("name", "by_name"))).alias("name"),
    )


def resolve_rows(
    rows: DataFrame, source: str, index: MatchIndex, order: str | None = None
) -> DataFrame:
    """Per external id: the keys it matched by (three at most), the method and the confidence.

    Numbers come first, names only where no number matched. Of several rows with one external id
    the last that matched counts.
    """
    keyed, numbers = _key_columns(rows, source, order)
    listed = (
        keyed.select(
            "external_id",
            "_order",
            "_row",
            F.inline(F.array(*[_key("number", column) for column in numbers], _key("name", "by_name"))),
        )
        .filter("key IS NOT NULL")
        .distinct()
    )
    matched = listed.join(index.keys, ["kind", "key"])
    number = F.col("kind") == "number"
    per_row = matched.groupBy("external_id", "_order", "_row").agg(
        F.max(number).alias("by_number"),
        F.collect_list(F.when(number, F.struct("kind", "key"))).alias("number_keys"),
        F.collect_list(F.when(~number, F.struct("kind", "key"))).alias("name_keys"),
        F.max(F.when(number, F.col("moved"))).alias("number_moved"),
        F.min(F.when(number, F.col("hop_confidence"))).alias("number_hop"),
        F.max(F.when(~number, F.col("moved"))).alias("name_moved"),
        F.min(F.when(~number, F.col("hop_confidence"))).alias("name_hop"),
        F.max(F.when(~number, F.coalesce("is_alias", F.lit(False)))).alias("is_alias"),
        F.max("alias_confidence").alias("alias_confidence"),
    )
    use_alias = ~F.col("by_number") & F.coalesce("is_alias", F.lit(False))
    moved = F.when(F.col("by_number"), F.col("number_moved")).otherwise(F.col("name_moved"))
    hop = F.coalesce(F.when(F.col("by_number"), F.col("number_hop")).otherwise(F.col("name_hop")), F.lit(1.0))
    base = F.when(F.col("by_number"), 1.0).otherwise(0.9)
    last = Window.partitionBy("external_id").orderBy(F.desc("_order"), F.desc("_row"))
    return (
        per_row.select(
            "external_id",
            "_order",
            "_row",
            F.when(F.col("by_number"), F.col("number_keys")).otherwise(F.col("name_keys")).alias("keys"),
            F.when(use_alias, BY_ALIAS_OVERRIDE)
            .when(moved, BY_SURVIVOR)
            .when(F.col("by_number"), BY_NUMBER)
            .otherwise(BY_NAME)
            .alias("mapping_method"),
            F.when(use_alias, F.coalesce("alias_confidence", F.lit(1.0)))
            .when(moved, F.least(base, hop))
            .otherwise(base)
            .alias("confidence_score"),
        )
        .withColumn("_rn", F.row_number().over(last))
        .filter("_rn = 1")
        .drop("_rn", "_order", "_row")
    )


def resolved_entities(resolved: DataFrame, index: MatchIndex) -> DataFrame:
    """The listing: one row per (external id, entity)."""
    return (
        resolved.select("external_id", "mapping_method", "confidence_score", F.inline("keys"))
        .join(index.entities, ["kind", "key"])
        .select("external_id", "entity_id", "mapping_method", "confidence_score")
        .distinct()
    )


def coverage(rows: DataFrame, resolved: DataFrame) -> DataFrame:
    one = F.lit(1).alias("_k")
    return (
        resolved.agg(F.count("*").alias("matched"), one)
        .join(rows.agg(F.count("*").alias("total"), one), "_k")
        .select("matched", "total")
    )


def with_status(candidates: DataFrame) -> DataFrame:
    """Candidates with a review status: the one they carry, else by probability."""
    explicit = F.col("status") if "status" in candidates.columns else None
    return candidates.withColumn(
        "status", values.candidate_status(F.col("match_probability"), explicit)
    )


def decide(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply the latest review decision per candidate.

    ``decisions`` holds (candidate_id, status, reviewed_by, review_note, reviewed_at); an approval
    has the status ``same``.
    """
    newest = Window.partitionBy("candidate_id").orderBy(F.desc("reviewed_at"), F.desc("status"))
    latest = (
        decisions.withColumn("_rn", F.row_number().over(newest))
        .filter("_rn = 1")
        .select(
            "candidate_id",
            F.col("status").alias("_status"),
            F.col("reviewed_by").alias("_by"),
            F.col("review_note").alias("_note"),
            F.col("reviewed_at").alias("_at"),
        )
    )
    kept = [c for c in candidates.columns if c not in ("status", "reviewed_by", "review_note", "reviewed_at")]
    return with_status(candidates).join(latest, "candidate_id", "left").select(
        *kept,
        F.coalesce("_status", "status").alias("status"),
        F.col("_by").alias("reviewed_by"),
        F.col("_note").alias("review_note"),
        F.col("_at").alias("reviewed_at"),
    )


def survivor_overrides(decided: DataFrame) -> DataFrame:
    """Duplicate-to-survivor rows of the approved candidates, the latest per duplicate.

    The entity with more source links survives, the smaller id on a tie.
    """
    links_l, links_r = F.coalesce("source_count_l", F.lit(0)), F.coalesce("source_count_r", F.lit(0))
    left, right = F.col("entity_id_l"), F.col("entity_id_r")
    survivor = F.when(links_l > links_r, left).when(links_r > links_l, right).otherwise(F.least(left, right))
    approved = decided.filter(
        (F.col("status") == "same") & left.isNotNull() & right.isNotNull() & (left != right)
    ).withColumn("survivor_entity_id", survivor)
    rows = approved.select(
        F.when(F.col("survivor_entity_id") == left, right).otherwise(left).alias("duplicate_entity_id"),
        "survivor_entity_id",
        F.coalesce("match_probability", F.lit(0.0)).alias("confidence"),
        "candidate_id",
        "reviewed_at",
    )
    return _latest(rows, ["duplicate_entity_id"])


def alias_overrides(decided: DataFrame) -> DataFrame:
    """Names of each side of an approved candidate as aliases of the other side, latest per key."""
    left, right = F.col("entity_id_l"), F.col("entity_id_r")
    both = F.array(
        F.struct(F.col("legal_name_l").alias("alias"), F.coalesce(right, left).alias("entity_id")),
        F.struct(F.col("legal_name_r").alias("alias"), F.coalesce(left, right).alias("entity_id")),
    )
    rows = (
        decided.filter((F.col("status") == "same") & (left.isNotNull() | right.isNotNull()))
        .select(
            F.inline(both),
            F.coalesce("match_probability", F.lit(0.0)).alias("confidence"),
            "candidate_id",
            "reviewed_at",
        )
        .withColumn("alias_norm", names.normalize_name(F.col("alias")))
        .filter("alias_norm IS NOT NULL AND entity_id IS NOT NULL")
    )
    return _latest(rows, ["alias_norm", "entity_id"])


def _latest(rows: DataFrame, key: list[str]) -> DataFrame:
    newest = Window.partitionBy(*key).orderBy(F.desc("reviewed_at"), F.desc("candidate_id"))
    return rows.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1").drop("_rn")


def approved_overrides(decided: DataFrame) -> Overrides:
    """The two override sets resolution reads."""
    return Overrides(
        alias_overrides(decided).select("alias_norm", "entity_id", "confidence"),
        survivor_overrides(decided).select("duplicate_entity_id", "survivor_entity_id", "confidence"),
    )


def review_queue(candidates: DataFrame, status: str | None = None, limit: int = 200) -> DataFrame:
    chosen = candidates
    if status and status != "all":
        chosen = candidates.filter(F.col("status") == status)
    return top(chosen, limit, F.desc("match_probability"), F.desc("candidate_id"))


def review_summary(candidates: DataFrame) -> DataFrame:
    return candidates.agg(
        F.count("*").alias("candidates"),
        F.count_if(F.col("match_probability") >= values.LIKELY_SAME).alias("likely_same"),
        F.count_if(F.col("status").isin("needs_review", "likely_same")).alias("needs_review"),
        F.count_if(F.col("status") == "same").alias("approved"),
    )


def run_record(
    run_id: str, threshold: float, records: DataFrame, candidates: DataFrame, clusters: DataFrame
) -> DataFrame:
    """One finished-run row for the append-only run table, counted in a single pass each."""
    one = F.lit(1).alias("_k")
    return (
        records.agg(F.count("*").alias("record_count"), one)
        .join(candidates.agg(F.count("*").alias("candidate_count"), one), "_k")
        .join(clusters.agg(F.count_distinct("cluster_id").alias("cluster_count"), one), "_k")
        .select(
            F.lit(run_id).alias("run_id"),
            F.lit(float(threshold)).alias("threshold"),
            F.current_timestamp().alias("completed_at"),
            "record_count",
            "candidate_count",
            "cluster_count",
            F.lit("completed").alias("status"),
        )
    )
