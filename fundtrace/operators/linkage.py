"""Probabilistic linkage of entity records (ER1-ER4b).

Records that agree on every compared column are one *profile*. Blocking, comparison and scoring run
on profiles, so copies of a record are never paired with each other; ``profile_members`` maps
profiles back to records and entities.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundtrace.functions import ids, names, similarity, values
from fundtrace.session import checkpoint
from fundtrace.sources.warehouse import Warehouse

COMPARED = ["bn_root", "cleaned_name", "city", "province", "entity_type"]
GAMMAS = [f"g_{c}" for c in COMPARED]
LEVELS = {"bn_root": 2, "cleaned_name": 4, "city": 2, "province": 2, "entity_type": 2}
EXACT = {c: n - 1 for c, n in LEVELS.items()}
PREFIX = 5
PRIOR = 1 / 50_000
FLOOR = 1e-6

# A block of more profiles than this is cut into tiles that are joined pair by pair of tiles.
TILE = 2_000
# Default of ``train``: random pairs for the chance of agreement.
U_PAIRS = 1_000_000


# --- ER1: records -----------------------------------------------------------------------------


def extract_records(wh: Warehouse) -> DataFrame:
    """One record per canonical name, alias and source-link name of active entities.

    Records without a cleaned name drop out; of records equal in (entity, cleaned name, number,
    city, province, dataset) the first stays: canonical, then aliases, then links, by record id.
    """
    active = wh.active_entities
    addresses = F.col("addresses")
    datasets = F.array_join(F.coalesce("dataset_sources", F.array().cast("array<string>")), ",")
    meta = active.select(
        F.col("id").alias("entity_id"),
        "canonical_name",
        "aliases",
        ids.bn_root(F.col("bn_root")).alias("bn_root"),
        values.address_field(addresses, "city", "municipality").alias("city"),
        values.address_field(addresses, "province", "province_code", "state").alias("province"),
        F.replace(
            values.address_field(addresses, "postal_code", "postal", "zip"), F.lit(" "), F.lit("")
        ).alias("postal_code"),
        "entity_type",
        F.coalesce(F.nullif(datasets, F.lit("")), F.lit("golden")).alias("source_dataset"),
        F.coalesce("source_link_count", F.lit(0)).alias("source_count"),
    )
    kept = ["entity_id", "bn_root", "city", "province", "postal_code", "entity_type", "source_count"]
    prefix = F.concat(F.lit("entity:"), F.col("entity_id").cast("string"))
    canonical = meta.select(
        *kept,
        "source_dataset",
        F.lit(0).alias("_kind"),
        F.concat(prefix, F.lit(":canonical")).alias("record_id"),
        F.col("canonical_name").alias("legal_name"),
    )
    aliases = (
        meta.select("*", F.explode(F.from_json("aliases", "array<variant>")).alias("_a"))
        .withColumn("legal_name", names.alias_text(F.col("_a")))
        .filter("legal_name IS NOT NULL AND legal_name <> ''")
        .select(
            *kept,
            "source_dataset",
            F.lit(1).alias("_kind"),
            F.concat(prefix, F.lit(":alias:"), ids.stable_id(F.col("legal_name"))).alias("record_id"),
            "legal_name",
        )
    )
    # Equal link names of an entity and table collapse to the first link before the join. The name is taken out of the
    # aggregate, not of its keys: a filter on the cleaned name would otherwise move below it and clean every link's name.
    links = (
        wh.links.filter("source_name IS NOT NULL")
        .groupBy(
            "entity_id",
            F.concat_ws(".", "source_schema", "source_table").alias("source_dataset"),
            "source_name",
        )
        .agg(F.min("id").alias("_link"), F.any_value("source_name").alias("legal_name"))
        .drop("source_name")
        .join(meta.select(*kept), "entity_id")
        .select(
            *kept,
            "source_dataset",
            F.lit(2).alias("_kind"),
            F.concat(F.lit("source_link:"), "_link").alias("record_id"),
            "legal_name",
        )
    )
    first = Window.partitionBy(
        "entity_id", "cleaned_name", "bn_root", "city", "province", "source_dataset"
    ).orderBy("_kind", "record_id")
    return (
        canonical.unionByName(aliases)
        .unionByName(links)
        .withColumn("legal_name", F.trim("legal_name"))
        # As a generated column it is computed once a row; the filter would otherwise compute it again below.
        .select("*", F.explode(F.array(names.clean_name(F.col("legal_name")))).alias("cleaned_name"))
        .filter("legal_name <> '' AND cleaned_name <> ''")
        .withColumn("_rn", F.row_number().over(first))
        .filter("_rn = 1")
        .drop("_rn", "_kind")
    )


def profiles(records: DataFrame) -> DataFrame:
    """Distinct combinations of the compared columns, with how many records carry each."""
    return records.groupBy(*COMPARED).agg(F.count("*").alias("n_records")).select(
        profile_id().alias("profile_id"), *COMPARED, "n_records"
    )


def profile_id() -> Column:
    """Digest of the compared columns; a null differs from every text."""
    marked = [F.coalesce(F.concat(F.lit("="), c), F.lit("~")) for c in COMPARED]
    return F.md5(F.concat_ws("\u001f", *marked))


def profile_members(records: DataFrame) -> DataFrame:
    """(profile_id, record_id, entity_id and the shown columns) for every record."""
    return records.withColumn("profile_id", profile_id())


# --- ER2: blocking ----------------------------------------------------------------------------


def blocking_rules() -> list[list[Column]]:
    prefix = F.left("cleaned_name", F.lit(PREFIX))
    return [
        [F.col("bn_root")],
        [F.col("cleaned_name")],
        [F.col("province"), prefix],
        [F.col("city"), prefix],
    ]


def _keyed(rows: DataFrame, parts: list[Column]) -> DataFrame:
    known = reduce(lambda a, b: a & b, [p.isNotNull() for p in parts])
    return rows.filter(known).withColumn("_block", F.concat_ws("\u001f", *parts))


def block_pairs(rows: DataFrame, parts: list[Column], tile: int = TILE) -> DataFrame:
    """(profile_l, profile_r) with equal, non-null block parts; each unordered pair once.

    A block of up to ``tile`` profiles is one equi-join group. A larger one is cut into tiles by a
    hash of the profile, and each pair of tiles is its own group, so no task holds a whole block.
    """
    return _paired(_keyed(rows, parts).select("profile_id", "_block"), [], [], tile)


def _paired(keyed: DataFrame, columns: list[str], before: list[str], tile: int, lacking: str | None = None) -> DataFrame:
    """Pairs of one block, smaller profile first, with ``columns`` of both sides.

    Pairs that agree on a known key of ``before`` are left out, and with ``lacking`` those that both know that column.
    """
    if lacking is not None:
        pairs = _met_lacking(keyed, [*columns, *before], tile, lacking)
    else:
        pairs = _met_all(keyed, [*columns, *before], tile)
    for key in before:
        pairs = pairs.filter(~F.coalesce(F.col(f"{key}_l") == F.col(f"{key}_r"), F.lit(False)))
    turned = F.col("profile_l") > F.col("profile_r")
    return pairs.select(
        F.least("profile_l", "profile_r").alias("profile_l"),
        F.greatest("profile_l", "profile_r").alias("profile_r"),
        *[F.when(turned, F.col(f"{c}_r")).otherwise(F.col(f"{c}_l")).alias(f"{c}_l") for c in columns],
        *[F.when(turned, F.col(f"{c}_l")).otherwise(F.col(f"{c}_r")).alias(f"{c}_r") for c in columns],
    )


def _met_all(keyed: DataFrame, held: list[str], tile: int) -> DataFrame:
    """All pairs of a block, each once, in tiles."""
    sizes = keyed.groupBy("_block").agg(F.ceil(F.count("*") / tile).cast("int").alias("_tiles"))
    placed = keyed.join(sizes.filter("_tiles > 1"), "_block", "left").withColumn("_tiles", F.coalesce("_tiles", F.lit(1)))
    placed = placed.withColumn("_tile", F.pmod(F.xxhash64("profile_id"), F.col("_tiles")).cast("int"))

    def half(side: str, *tiles: Column) -> DataFrame:
        return placed.select(F.col("profile_id").alias(f"profile_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in held], "_block", *tiles)

    left = half("l", F.col("_tile").alias("_i"), F.explode(F.sequence("_tile", F.col("_tiles") - 1)).alias("_j"))
    right = half("r", F.explode(F.sequence(F.lit(0), "_tile")).alias("_i"), F.col("_tile").alias("_j"))
    return left.join(right, ["_block", "_i", "_j"]).filter("_i < _j OR profile_l < profile_r")


def _met_lacking(keyed: DataFrame, held: list[str], tile: int, lacking: str) -> DataFrame:
    """Pairs of a block of which one side at least lacks a column: those that lack it meet all, in tiles."""
    absent = F.col(lacking).isNull()
    sizes = keyed.groupBy("_block").agg(
        F.ceil(F.count_if(absent) / tile).cast("int").alias("_rows"), F.ceil(F.count("*") / tile).cast("int").alias("_columns")
    )
    # A block without such a row has no pair; most blocks have one tile a side and need no entry.
    large = sizes.filter("_rows > 1 OR _columns > 1")
    placed = keyed.join(large, "_block", "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("_rows", "_columns")})
    placed = placed.withColumn("_rows", F.greatest("_rows", F.lit(1))).withColumn("_absent", absent)

    def half(df: DataFrame, side: str, *tiles: Column) -> DataFrame:
        named = [F.col(c).alias(f"{c}_{side}") for c in [*held, "_absent"]]
        return df.select(F.col("profile_id").alias(f"profile_{side}"), *named, "_block", *tiles)

    def tile_of(size: str) -> Column:
        return F.pmod(F.xxhash64("profile_id"), F.col(size)).cast("int")

    left = half(placed.filter("_absent"), "l", tile_of("_rows").alias("_i"), F.explode(F.sequence(F.lit(0), F.col("_columns") - 1)).alias("_j"))
    right = half(placed, "r", F.explode(F.sequence(F.lit(0), F.col("_rows") - 1)).alias("_i"), tile_of("_columns").alias("_j"))
    return left.join(right, ["_block", "_i", "_j"]).filter("NOT _absent_r OR profile_l < profile_r")


def _rule_key(parts: list[Column], where: Column | None = None) -> Column:
    known = reduce(lambda a, b: a & b, [p.isNotNull() for p in parts] + ([] if where is None else [where]))
    return F.when(known, F.concat_ws("\u001f", *parts))


def rule_pairs(
    rows: DataFrame, keys: list[Column], columns: list[str], tile: int = TILE, lacking: list[str | None] | None = None
) -> DataFrame:
    """Profile pairs that agree on at least one of ``keys``, with ``columns`` of both sides.

    Where ``lacking`` names a column of ``columns`` for a key, only pairs with a side that lacks it come from that key.

    A pair comes from the first key it agrees on, so the pairs of all keys are distinct as they are formed: they are
    neither shuffled nor joined with their profiles again, however many they are.
    """
    named = [f"_k{i}" for i in range(len(keys))]
    held = rows.select("profile_id", *columns, *[k.alias(n) for k, n in zip(keys, named)])
    parts = []
    for i, name in enumerate(named):
        keyed = held.filter(F.col(name).isNotNull()).select("profile_id", *columns, *named[:i], F.col(name).alias("_block"))
        parts.append(_paired(keyed, columns, named[:i], tile, lacking and lacking[i]))
    return reduce(DataFrame.unionByName, parts)


def candidate_pairs(rows: DataFrame, rules: list[list[Column]] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Distinct profile pairs that agree under at least one blocking rule, with ``columns`` of both sides."""
    return rule_pairs(rows, [_rule_key(rule) for rule in rules or blocking_rules()], columns or [])


# --- ER3: comparison --------------------------------------------------------------------------


def _side(rows: DataFrame, side: str) -> DataFrame:
    return rows.select(
        F.col("profile_id").alias(f"profile_{side}"),
        *[F.col(c).alias(f"{c}_{side}") for c in [*COMPARED, "n_records"]],
    )


def _equal(column: str) -> Column:
    left, right = F.col(f"{column}_l"), F.col(f"{column}_r")
    return (
        F.when(left.isNull() | right.isNull(), -1).when(left == right, 1).otherwise(0)
    )


def with_gammas(pairs: DataFrame, columns: list[str] = COMPARED) -> DataFrame:
    """Comparison levels per column: -1 unknown, the highest for equality."""
    for column in columns:
        level = (
            similarity.name_level(F.col("cleaned_name_l"), F.col("cleaned_name_r"))
            if column == "cleaned_name"
            else _equal(column)
        )
        pairs = pairs.withColumn(f"g_{column}", level)
    return pairs


def compare(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Candidate pairs with both sides' columns and comparison levels."""
    both = pairs.join(_side(rows, "l"), "profile_l").join(_side(rows, "r"), "profile_r")
    return with_gammas(both)


def compared_pairs(rows: DataFrame) -> DataFrame:
    """What ``compare`` gives for all candidate pairs, without a join of pairs and profiles."""
    return with_gammas(candidate_pairs(rows, columns=[*COMPARED, "n_records"]))


# --- ER4: model -------------------------------------------------------------------------------


@dataclass
class Model:
    """Level probabilities per compared column; a few dozen numbers."""

    m: dict[str, np.ndarray] = field(default_factory=dict)
    u: dict[str, np.ndarray] = field(default_factory=dict)
    prior: float = PRIOR

    def weight(self, column: str, level: int) -> float:
        if level < 0:
            return 0.0
        return float(np.log2(self.m[column][level] / self.u[column][level]))

    @property
    def prior_weight(self) -> float:
        return float(np.log2(self.prior / (1 - self.prior)))


def starting_model() -> Model:
    model = Model()
    for column, n in LEVELS.items():
        rest = 0.1 / (n - 1)
        model.m[column] = np.array([rest] * (n - 1) + [0.9])
        model.u[column] = np.full(n, 1.0 / n)
    return model


def _chance_equality(rows: DataFrame) -> dict[str, float]:
    """Exact probability that two random records agree on a column, from its value counts."""
    parts = []
    for column in COMPARED:
        counts = (
            rows.filter(F.col(column).isNotNull())
            .groupBy(column)
            .agg(F.sum("n_records").cast("double").alias("n"))
        )
        parts.append(
            counts.agg(
                (F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("p")
            ).select(F.lit(column).alias("column"), "p")
        )
    return {r["column"]: r["p"] or 0.0 for r in reduce(DataFrame.unionByName, parts).collect()}


def estimate_u(model: Model, rows: DataFrame, pairs_wanted: int = U_PAIRS) -> Model:
    """Chance agreement: exact for equality, from random pairs for the name-similarity levels.

    Two independent hashes of a profile put it in a left and a right bucket; equal buckets form
    random pairs, as many as wanted, without any cross join.
    """
    equal = _chance_equality(rows)
    n = rows.count()
    buckets = max(1, int(np.ceil(n * n / pairs_wanted)))
    sample = rows.select("profile_id", "cleaned_name")
    left = sample.select(
        F.pmod(F.xxhash64("profile_id", F.lit(1)), F.lit(buckets)).alias("_b"),
        F.col("profile_id").alias("profile_l"),
        F.col("cleaned_name").alias("cleaned_name_l"),
    )
    right = sample.select(
        F.pmod(F.xxhash64("profile_id", F.lit(2)), F.lit(buckets)).alias("_b"),
        F.col("profile_id").alias("profile_r"),
        F.col("cleaned_name").alias("cleaned_name_r"),
    )
    # About half of the wanted pairs remain; that many rows spread over all cores are a small shuffle.
    random_pairs = (
        left.join(right, "_b")
        .filter("cleaned_name_l < cleaned_name_r")
        .repartition(rows.sparkSession.sparkContext.defaultParallelism)
    )
    level = similarity.name_level(F.col("cleaned_name_l"), F.col("cleaned_name_r"))
    seen = {r["level"]: r["count"] for r in random_pairs.select(level.alias("level")).groupBy("level").count().collect()}
    total = max(sum(seen.values()), 1)
    for column in COMPARED:
        top = min(max(equal.get(column, 0.0), FLOOR), 1 - FLOOR)
        n_levels = LEVELS[column]
        if n_levels == 2:
            model.u[column] = np.array([1 - top, top])
        else:
            lower = np.array([max(seen.get(k, 0) / total, FLOOR) for k in range(n_levels - 1)])
            model.u[column] = np.append(lower / lower.sum() * (1 - top), top)
    return model


def training_patterns(rows: DataFrame, block: str, partners: int | None = None, tile: int = TILE) -> DataFrame:
    """Counts of comparison patterns among pairs that agree on ``block``.

    All pairs are compared, those of a block of more than ``tile`` profiles pair by pair of tiles. With ``partners``
    each profile of a larger block meets about that many, picked by hash, and their counts are scaled up.
    """
    columns = [c for c in COMPARED if c != block]
    keyed = rows.filter(F.col(block).isNotNull())
    sizes = keyed.groupBy(block).agg(F.ceil(F.count("*") / (partners or tile)).cast("int").alias("_t"))
    placed = keyed.join(sizes.filter("_t > 1"), block, "left").withColumn("_t", F.coalesce("_t", F.lit(1)))

    def half(side: str, *buckets: Column) -> DataFrame:
        return placed.select(
            F.col(block).alias("_key"),
            *([F.col("_t")] if side == "l" else []),
            F.col("profile_id").alias(f"profile_{side}"),
            *[F.col(c).alias(f"{c}_{side}") for c in [*columns, "n_records"]],
            *buckets,
        )

    def bucket(seed: int) -> Column:
        return F.pmod(F.xxhash64("profile_id", F.lit(seed)), F.col("_t")).cast("int")

    weight = F.col("n_records_l") * F.col("n_records_r")
    if partners is None:
        left = half("l", bucket(1).alias("_i")).withColumn("_j", F.explode(F.sequence("_i", F.col("_t") - 1)))
        right = half("r", bucket(1).alias("_j"), F.sequence(F.lit(0), bucket(1)).alias("_up")).withColumn("_i", F.explode("_up")).drop("_up")
        pairs = left.join(right, ["_key", "_i", "_j"]).filter("_i < _j OR profile_l < profile_r")
    else:
        # With one bucket both halves hold the whole block and the order condition keeps half the pairs.
        pairs = half("l", bucket(1).alias("_i")).join(half("r", bucket(2).alias("_i")), ["_key", "_i"]).filter("profile_l < profile_r")
        weight = weight * F.col("_t")
    pairs = pairs.withColumn("w", weight.cast("double"))
    copies = rows.filter(F.col(block).isNotNull() & (F.col("n_records") > 1)).select(
        *[F.when(F.col(c).isNull(), -1).otherwise(EXACT[c]).alias(f"g_{c}") for c in columns],
        (F.col("n_records") * (F.col("n_records") - 1) / 2).alias("w"),
    )
    gammas = [f"g_{c}" for c in columns]
    return (
        with_gammas(pairs, columns)
        .select(*gammas, "w")
        .unionByName(copies.select(*gammas, "w"))
        .groupBy(*gammas)
        .agg(F.sum("w").alias("w"))
    )


def _equality_counts(rows: DataFrame, block: str, columns: list[str]) -> np.ndarray:
    """Record pairs of one block by comparison pattern, one axis a column: unknown, unequal, equal.

    No pair is formed. For a set S of columns, the records of a block that agree on S are a group, and a group of n records
    holds n (n - 1) / 2 pairs equal on S; restricted to records that know the columns T too, pairs equal on S and known on
    T. Differences of these counts along each axis (unknown = any - known, unequal = known - equal) are the patterns.
    """
    masks = range(1 << len(columns))
    inside = [[c for i, c in enumerate(columns) if mask >> i & 1] for mask in masks]
    known = rows.filter(F.col(block).isNotNull())
    n = known.groupBy(block, *columns).agg(F.sum("n_records").alias("n"))
    missing = reduce(lambda a, b: a + b, [F.when(F.col(c).isNull(), 1 << i).otherwise(0) for i, c in enumerate(columns)], F.lit(0))
    n = n.withColumn("_missing", missing).withColumn("_s", F.explode(F.array([F.lit(m) for m in masks])))
    n = n.filter(F.col("_s").bitwiseAND(F.col("_missing")) == 0)
    parts = [F.when(F.col("_s").bitwiseAND(1 << i) != 0, F.col(c)).alias(c) for i, c in enumerate(columns)]
    sums = [F.sum(F.when(F.col("_missing").bitwiseAND(t) == 0, F.col("n")).otherwise(0)).alias(f"_{t}") for t in masks]
    groups = n.select(block, "_s", *parts, "n", "_missing").groupBy(block, "_s", *columns).agg(*sums)
    pairs = [F.sum(F.col(f"_{t}").cast("double") * (F.col(f"_{t}") - 1) / 2).alias(f"_{t}") for t in masks]
    found = {r["_s"]: r for r in groups.groupBy("_s").agg(*pairs).collect()}
    counts = np.zeros([3] * len(columns))
    for s, t in product(masks, masks):
        if not s & t and s in found:
            at = tuple(2 if c in inside[s] else 1 if c in inside[t] else 0 for c in columns)
            counts[at] = found[s][f"_{t}"] or 0.0
    for axis in range(len(columns)):
        free, both, equal = np.moveaxis(counts, axis, 0)
        counts = np.stack([free - both, both - equal, equal], axis)
    return counts


def _similar_names(rows: DataFrame, block: str, tile: int) -> DataFrame:
    """(block, a, b, level): unequal names of one block at level 1 or 2, each distinct pair of names compared once."""
    held = rows.filter(F.col(block).isNotNull() & F.col("cleaned_name").isNotNull()).groupBy(block, "cleaned_name").agg(F.count(F.lit(1)).alias("_n"))
    listed = checkpoint(held.select(F.col("cleaned_name").alias("profile_id"), F.col(block).alias("_key")))
    met = block_pairs(listed, [F.col("_key")], tile).distinct()
    level = similarity.name_level(F.col("profile_l"), F.col("profile_r"))
    close = checkpoint(met.withColumn("level", level).filter("level IN (1, 2)"))
    at_a = listed.select(F.col("profile_id").alias("profile_l"), "_key")
    at_b = listed.select(F.col("profile_id").alias("profile_r"), "_key")
    return close.join(at_a, "profile_l").join(at_b, ["profile_r", "_key"]).select(F.col("_key").alias(block), F.col("profile_l").alias("a"), F.col("profile_r").alias("b"), "level")


def pattern_counts(rows: DataFrame, block: str, tile: int = TILE) -> list[dict]:
    """What ``training_patterns`` counts over all pairs of a block, from group sizes instead of pairs.

    Equality levels come from ``_equality_counts``, so a block may hold any number of records. Only pairs of similar but
    unequal names are formed, by distinct name; all other unequal names are the rest.
    """
    columns = [c for c in COMPARED if c != block]
    counts = _equality_counts(rows, block, columns)
    levels = {c: (-1, 0, EXACT[c]) for c in columns}
    out: dict[tuple, float] = {}
    for at in product(range(3), repeat=len(columns)):
        if counts[at] > 0:
            out[tuple(levels[c][k] for c, k in zip(columns, at))] = float(counts[at])
    if "cleaned_name" in columns:
        rest = [c for c in columns if c != "cleaned_name"]
        side = lambda x, name: rows.groupBy(block, "cleaned_name", *rest).agg(F.sum("n_records").alias("n")).select(
            F.col(block).alias("_key"), F.col("cleaned_name").alias(name), *[F.col(c).alias(f"{c}_{x}") for c in rest], F.col("n").alias(f"n_{x}")
        )
        close = _similar_names(rows, block, tile).withColumnRenamed(block, "_key")
        pairs = close.join(side("l", "a"), ["_key", "a"]).join(side("r", "b"), ["_key", "b"])
        weight = F.col("n_l").cast("double") * F.col("n_r")
        seen = with_gammas(pairs, rest).groupBy("level", *[f"g_{c}" for c in rest]).agg(F.sum(weight).alias("w"))
        for r in seen.collect():
            similar, unlike = (tuple(name if c == "cleaned_name" else r[f"g_{c}"] for c in columns) for name in (r["level"], 0))
            out[similar] = out.get(similar, 0.0) + r["w"]
            out[unlike] -= r["w"]
    return [{**{f"g_{c}": k for c, k in zip(columns, key)}, "w": w} for key, w in sorted(out.items()) if w > 0]


def fit(patterns: list[dict], columns: list[str], model: Model, rounds: int = 50) -> dict:
    """Expectation maximisation over pattern counts (a few hundred rows at most)."""
    if not patterns:
        return {}
    levels = np.array([[p[f"g_{c}"] for c in columns] for p in patterns])
    w = np.array([p["w"] for p in patterns], dtype=float)
    m = {c: model.m[c].copy() for c in columns}
    share = 0.5
    for _ in range(rounds):
        log_m, log_u = np.zeros(len(w)), np.zeros(len(w))
        for i, c in enumerate(columns):
            known = levels[:, i] >= 0
            log_m[known] += np.log(m[c][levels[known, i]])
            log_u[known] += np.log(model.u[c][levels[known, i]])
        odds = np.log(share) - np.log1p(-share) + log_m - log_u
        match = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        share = float(np.clip((w * match).sum() / w.sum(), 1e-6, 1 - 1e-6))
        moved = 0.0
        for i, c in enumerate(columns):
            sums = np.array([(w * match)[levels[:, i] == k].sum() for k in range(LEVELS[c])])
            fresh = np.maximum(sums / max(sums.sum(), 1e-12), FLOOR)
            fresh /= fresh.sum()
            moved = max(moved, float(np.abs(fresh - m[c]).max()))
            m[c] = fresh
        if moved < 1e-6:
            break
    return m


def train(rows: DataFrame, partners: int | None = None, u_pairs: int = U_PAIRS) -> Model:
    """u from chance agreement, m by EM in the number and name blocks, averaged over both."""
    model = estimate_u(starting_model(), rows, u_pairs)
    found: dict[str, list[np.ndarray]] = {c: [] for c in COMPARED}
    for block in ("bn_root", "cleaned_name"):
        columns = [c for c in COMPARED if c != block]
        if partners is None:
            patterns = pattern_counts(rows, block)
        else:
            patterns = [r.asDict() for r in training_patterns(rows, block, partners).collect()]
        for column, m in fit(patterns, columns, model).items():
            found[column].append(m)
    for column, estimates in found.items():
        if estimates:
            model.m[column] = np.mean(estimates, axis=0)
    return model


@dataclass
class Reach:
    """What a pair needs at least to get to the threshold under a model."""

    number_frequency: float
    name_frequency: float
    with_province: list[str] | None
    with_city: list[str] | None
    number_lacking: bool


def reach(model: Model, threshold: float) -> Reach:
    """Bounds that leave out only pairs whose probability cannot reach ``threshold``.

    Equal numbers and names weigh log2(m / frequency), so a frequent one can be ruled out unless
    both are equal. For pairs equal in neither, the columns equal in every pattern that reaches the
    threshold become part of the block.
    """
    needed = float(np.log2(threshold / (1 - threshold))) - model.prior_weight
    small = ["city", "province", "entity_type"]
    rest_levels = [(-1, 0, 1)] * 3

    def rest_weight(levels: tuple) -> float:
        return sum(model.weight(c, k) for c, k in zip(small, levels))

    best_rest = max(rest_weight(levels) for levels in product(*rest_levels))
    best_other_name = max(model.weight("cleaned_name", k) for k in (-1, 0, 1, 2))
    best_other_number = max(model.weight("bn_root", k) for k in (-1, 0))
    number = model.m["bn_root"][1] / 2 ** (needed - best_rest - best_other_name)
    name = model.m["cleaned_name"][3] / 2 ** (needed - best_rest - best_other_number)

    def required(equal_column: str) -> list[str] | None:
        patterns = [
            levels
            for levels in product(*rest_levels)
            if levels[small.index(equal_column)] == 1
            and rest_weight(levels) + best_other_name + best_other_number >= needed
        ]
        if not patterns:
            return None
        return [c for i, c in enumerate(small) if all(p[i] == 1 for p in patterns)]

    # Two different known numbers may rule a pair out that is equal in neither; then one side must lack its number.
    different = max(rest_weight(levels) for levels in product(*rest_levels)) + best_other_name + model.weight("bn_root", 0)
    return Reach(float(number), float(name), required("province"), required("city"), bool(different < needed - 1e-6))


def _frequencies(rows: DataFrame, column: str) -> DataFrame:
    known = rows.filter(F.col(column).isNotNull())
    counts = known.groupBy(column).agg(F.sum("n_records").alias("n"))
    # The total is a single number.
    total = known.agg(F.sum("n_records")).first()[0] or 1
    return counts.select(column, (F.col("n") / F.lit(float(total))).alias(f"tf_{column}"))


def pairs_within_reach(rows: DataFrame, model: Model, threshold: float) -> DataFrame:
    """Candidate pairs of the four blocking rules less those that cannot reach the threshold.

    ``rows`` carries tf_bn_root and tf_cleaned_name.
    """
    keys, lacking = _keys_within_reach(model, threshold)
    pairs = rule_pairs(rows, keys, ["bn_root"], lacking=lacking)
    return pairs.select("profile_l", "profile_r")


def _keys_within_reach(model: Model, threshold: float) -> tuple[list[Column], list[str | None]]:
    """Block keys, and for each the column that one side of a pair must lack."""
    bounds = reach(model, threshold)
    prefix = F.left("cleaned_name", F.lit(PREFIX))
    number, name = F.col("bn_root"), F.col("cleaned_name")
    keys = [
        _rule_key([number, name]),
        _rule_key([number], F.col("tf_bn_root") <= bounds.number_frequency),
        _rule_key([name], F.col("tf_cleaned_name") <= bounds.name_frequency),
    ]
    lacking = [None] * len(keys)
    # Every pair within a block of more columns is within one of fewer, so only the smallest sets make blocks.
    sets = [{base, *needed} for needed, base in ((bounds.with_province, "province"), (bounds.with_city, "city")) if needed is not None]
    for i, columns in enumerate(sets):
        if not any(other < columns or (other == columns and j < i) for j, other in enumerate(sets)):
            keys.append(_rule_key([prefix, *[F.col(c) for c in sorted(columns)]]))
            lacking.append("bn_root" if bounds.number_lacking else None)
    return keys, lacking


def _weight(model: Model, column: str) -> Column:
    """Weight of a column's level; equality of number or name uses the value's own frequency."""
    level = F.col(f"g_{column}")
    result = F.lit(0.0)
    for k in range(LEVELS[column]):
        result = F.when(level == k, F.lit(model.weight(column, k))).otherwise(result)
    if column in ("bn_root", "cleaned_name"):
        exact = F.log2(F.lit(float(model.m[column][EXACT[column]])) / F.col(f"tf_{column}_l"))
        result = F.when(level == EXACT[column], exact).otherwise(result)
    return result


def predict(rows: DataFrame, model: Model, threshold: float = 0.40) -> DataFrame:
    """Profile pairs with weight and probability, those at or above the threshold."""
    rows = checkpoint(
        rows.join(_frequencies(rows, "bn_root"), "bn_root", "left").join(
            _frequencies(rows, "cleaned_name"), "cleaned_name", "left"
        )
    )
    shown = [*COMPARED, "tf_bn_root", "tf_cleaned_name"]
    keys, lacking = _keys_within_reach(model, threshold)
    pairs = rule_pairs(rows, keys, shown, lacking=lacking)
    # Names are compared only where the other columns leave the threshold within reach of some similarity.
    others = [c for c in COMPARED if c != "cleaned_name"]
    pairs = with_gammas(pairs, others)
    best_other_name = max(model.weight("cleaned_name", k) for k in (-1, 0, 1, 2))
    most = reduce(lambda a, b: a + b, [_weight(model, c) for c in others], F.lit(model.prior_weight + best_other_name))
    needed = float(np.log2(threshold / (1 - threshold))) - 1e-6
    same_name = F.coalesce(F.col("cleaned_name_l") == F.col("cleaned_name_r"), F.lit(False))
    compared = with_gammas(pairs.filter(same_name | (most >= needed)), ["cleaned_name"])
    total = F.lit(model.prior_weight) + reduce(
        lambda a, b: a + b, [_weight(model, c) for c in COMPARED]
    )
    # Copies of one profile agree on everything that is known.
    copies = rows.filter("n_records > 1").select(
        F.col("profile_id").alias("profile_l"),
        F.col("profile_id").alias("profile_r"),
        *[F.when(F.col(c).isNull(), -1).otherwise(EXACT[c]).alias(f"g_{c}") for c in COMPARED],
        F.col("tf_bn_root").alias("tf_bn_root_l"),
        F.col("tf_cleaned_name").alias("tf_cleaned_name_l"),
    )
    return (
        compared.select(*copies.columns)
        .unionByName(copies)
        .withColumn("match_weight", total)
        .withColumn("match_probability", 1 / (1 + F.pow(F.lit(2.0), -F.col("match_weight"))))
        .filter(F.col("match_probability") >= threshold)
        .select("profile_l", "profile_r", *GAMMAS, "match_weight", "match_probability")
    )


def clusters(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(profile_id, cluster_id): connected components, named by their smallest profile.

    Alternating large-star and small-star rounds; each is a minimum per node (combined map-side)
    and one join, until no link changes. Only a row count and a checksum reach the driver.
    """
    links = checkpoint(
        pairs.filter("profile_l <> profile_r")
        .select(F.greatest("profile_l", "profile_r").alias("u"), F.least("profile_l", "profile_r").alias("v"))
        .distinct()
    )
    state = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: larger neighbours of a node point to the node's minimum.
        large = (
            both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        # Small star: a node and its smaller neighbours point to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u")
        small = (
            moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .filter("u <> v")
            .distinct()
        )
        links = checkpoint(small)
        mark = links.agg(
            F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")
        ).first()
        if (mark["n"], mark["h"]) == state:
            break
        state = (mark["n"], mark["h"])
    named = links.select(F.col("u").alias("profile_id"), F.col("v").alias("cluster_id"))
    return nodes.select("profile_id").join(named, "profile_id", "left").select(
        "profile_id", F.coalesce("cluster_id", "profile_id").alias("cluster_id")
    )


# --- ER4b: candidates -------------------------------------------------------------------------

_SHOWN = ["record_id", "legal_name", "cleaned_name", "bn_root", "city", "province", "source_dataset"]


def entity_profiles(records: DataFrame) -> DataFrame:
    """One row per (profile, entity) with the entity's first record of that profile."""
    return (
        profile_members(records)
        .groupBy("profile_id", "entity_id")
        .agg(
            F.min(F.struct("record_id", *[c for c in _SHOWN if c != "record_id"])).alias("r"),
            F.max("source_count").alias("source_count"),
        )
        .select("profile_id", "entity_id", "r.*", "source_count")
    )


def build_candidates(
    records: DataFrame, predictions: DataFrame, all_pairs: bool = False, tile: int = TILE
) -> DataFrame:
    """Best prediction per unordered pair of different entities.

    With ``all_pairs`` entities that share a whole profile are paired with each other, a large group in tiles. Without, they
    are listed against the profile's smallest entity; the rest of such a group follows from ``entity_profiles``.
    """
    held = entity_profiles(records)
    columns = ["entity_id", *_SHOWN, "source_count"]

    def side(df: DataFrame, s: str) -> DataFrame:
        return df.select(
            F.col("profile_id").alias(f"profile_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in columns]
        )

    scored = predictions.select("profile_l", "profile_r", "match_weight", "match_probability")
    across = (
        scored.filter("profile_l <> profile_r")
        .join(side(held, "l"), "profile_l")
        .join(side(held, "r"), "profile_r")
    )
    own = scored.filter("profile_l = profile_r")
    if all_pairs:
        # The score goes with each entity, so no pair is joined with its prediction.
        scores = ["match_weight", "match_probability"]
        mates = held.join(own.select(F.col("profile_l").alias("profile_id"), *scores), "profile_id").select(
            F.col("entity_id").alias("profile_id"), F.col("profile_id").alias("_block"), *columns, *scores
        )
        within = _paired(mates, [*columns, *scores], [], tile).withColumnsRenamed({f"{c}_l": c for c in scores})
        within = within.drop(*[f"{c}_r" for c in scores])
    else:
        heads = held.groupBy("profile_id").agg(F.min("entity_id").alias("entity_id"))
        first = held.join(heads, ["profile_id", "entity_id"], "left_semi")
        within = own.join(side(first, "l"), "profile_l").join(side(held, "r"), "profile_r")
    shown = [*[f"{c}_{s}" for s in ("l", "r") for c in columns], "match_weight", "match_probability"]
    listed = across.select(*shown).unionByName(within.select(*shown)).filter("entity_id_l <> entity_id_r")
    payload = [f"{c}_{s}" for s in ("l", "r") for c in columns]
    best = F.max_by(
        F.struct(*payload, "match_weight", "match_probability"),
        F.struct("match_probability", "record_id_l", "record_id_r"),
    )
    return (
        listed.groupBy(
            F.least("entity_id_l", "entity_id_r").alias("_a"),
            F.greatest("entity_id_l", "entity_id_r").alias("_b"),
        )
        .agg(best.alias("c"))
        .select(
            F.concat_ws("-", F.col("_a").cast("string"), F.col("_b").cast("string")).alias("candidate_id"),
            "c.*",
            F.lit("splink_link_and_dedupe").alias("method"),
        )
    )


@dataclass
class LinkageRun:
    records: DataFrame
    predictions: DataFrame
    clusters: DataFrame
    candidates: DataFrame
    model: Model


def run_linkage(
    wh: Warehouse,
    threshold: float = 0.40,
    partners: int | None = None,
    u_pairs: int = U_PAIRS,
) -> LinkageRun:
    """Extract, train, predict, cluster and list candidates."""
    records = checkpoint(extract_records(wh))
    rows = checkpoint(profiles(records))
    model = train(rows, partners, u_pairs)
    predictions = checkpoint(predict(rows, model, threshold))
    return LinkageRun(
        records,
        predictions,
        clusters(rows, predictions),
        build_candidates(records, predictions, all_pairs=True),
        model,
    )
