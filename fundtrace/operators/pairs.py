"""Entity pairs that share a director and exchange money (Q19-Q23)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundtrace.functions import ids, names
from fundtrace.operators.directors import NAME, name_entities
from fundtrace.operators.edges import linked
from fundtrace.operators.entities import id_by_root, named, top
from fundtrace.session import checkpoint
from fundtrace.sources.warehouse import Warehouse


def _pair_gifts(wh: Warehouse, gifts: DataFrame | None = None) -> DataFrame:
    a, b = ids.bn_left(F.col("bn")), ids.bn_left(F.col("donee_bn"))
    return (wh.gifts if gifts is None else gifts).filter("total_gifts > 0 AND donee_bn IS NOT NULL").select(
        F.least(a, b).alias("root_x"),
        F.greatest(a, b).alias("root_y"),
        "total_gifts",
        ids.filing_row_id(F.col("bn"), F.col("fpe"), F.col("sequence_number")).alias("source_row_id"),
    )


def gift_pair_totals(wh: Warehouse) -> DataFrame:
    """Gifts per unordered pair of business numbers, summed before any entity is joined."""
    return (
        _pair_gifts(wh)
        .groupBy("root_x", "root_y")
        .agg(F.sum("total_gifts").alias("total"), F.count("*").alias("gift_count"))
    )


def _with_first_row(wh: Warehouse, chosen: DataFrame, limit: int | None) -> DataFrame:
    """Replace root_x and root_y by the smallest gift row id of that pair of numbers.

    It is looked up for the reported pairs alone: a report of bounded length is sent to the gifts, and its numbers to
    both ends of them, so they are not shuffled a second time.
    """
    keys = ["root_x", "root_y"]
    # Used by the look-up and by the report.
    chosen = checkpoint(chosen)
    wanted = chosen.select(*keys).distinct()
    # A gift without a donor's number counts under its donee's alone, so the empty number is one of them. The filter, which
    # all numbers pass, tells the optimizer that these may be few.
    numbers = checkpoint(wanted.select(F.explode(F.array(*keys, F.lit(None).cast("string"))).alias("number")).distinct())
    numbers = numbers.filter(F.coalesce("number", F.lit("")) >= "")
    if limit is not None and limit <= 10_000:
        wanted, numbers = F.broadcast(wanted), F.broadcast(numbers)
    gifts = wh.gifts
    for end in ("bn", "donee_bn"):
        gifts = gifts.join(numbers, ids.bn_left(F.col(end)).eqNullSafe(F.col("number")), "left_semi")
    first = _pair_gifts(wh, gifts).join(wanted, keys).groupBy(*keys).agg(F.min("source_row_id").alias("source_row_id"))
    return chosen.join(first, keys).drop(*keys)


def _entity_pairs(totals: DataFrame, entities: DataFrame) -> DataFrame:
    """Pairs of numbers as pairs of entities, the smaller id first."""
    return (
        totals.join(id_by_root(entities, "x", "root_x"), "root_x")
        .join(id_by_root(entities, "y", "root_y"), "root_y")
        .filter("(root_x <> root_y AND x <> y) OR (root_x = root_y AND x < y)")
        .withColumns({"entity_id_a": F.least("x", "y"), "entity_id_b": F.greatest("x", "y")})
    )


def _sharing_a_name(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs once per director name both entities have: two equi-joins driven by the pairs."""
    at_a = held.select(F.col("entity_id").alias("entity_id_a"), NAME)
    at_b = held.select(F.col("entity_id").alias("entity_id_b"), NAME)
    return pairs.join(at_a, "entity_id_a").join(at_b, ["entity_id_b", NAME])


def shared_director_funding_pairs(
    wh: Warehouse, min_total_amount: float = 50_000, limit: int | None = 500
) -> DataFrame:
    """(director, pair) with gifts either way, among funded and active entities.

    No two entities are paired for sharing a name; money finds the pairs and the names are then
    looked up, which bounds the work by the gifts.
    """
    totals = gift_pair_totals(wh).filter(F.col("total") >= F.lit(min_total_amount))
    held = name_entities(wh, active_only=True, funded_only=True).select("entity_id", NAME)
    found = _sharing_a_name(_entity_pairs(totals, wh.active_entities), held).select(
        NAME,
        "entity_id_a",
        "entity_id_b",
        F.col("total").cast("double").alias("total_amount"),
        "root_x",
        "root_y",
    )
    order = [F.desc("total_amount"), F.col(NAME), F.col("entity_id_a"), F.col("entity_id_b")]
    return _with_first_row(wh, top(found, limit, *order), limit).orderBy(*order)


def director_funding_pairs_fast(
    wh: Warehouse, min_amount: float = 100_000, limit: int | None = 200
) -> DataFrame:
    """(director, pair) over all entities, each pair once per name of five letters or more.

    Two entities under one number see every gift between them from both ends, so it counts twice.
    """
    times = F.when(F.col("root_x") == F.col("root_y"), 2).otherwise(1)
    totals = (
        gift_pair_totals(wh)
        .withColumns({"total": F.col("total") * times, "gift_count": F.col("gift_count") * times})
        .filter(F.col("total") >= F.lit(min_amount))
    )
    held = name_entities(wh).filter(F.length(NAME) > 4).select("entity_id", NAME)
    found = _sharing_a_name(_entity_pairs(totals, wh.entities), held).select(
        NAME,
        "entity_id_a",
        "entity_id_b",
        F.col("total").cast("double").alias("total_amount"),
        "root_x",
        "root_y",
        "gift_count",
    )
    order = [F.desc("total_amount"), F.col("entity_id_a"), F.col("entity_id_b"), F.col(NAME)]
    return _with_first_row(wh, top(found, limit, *order), limit).orderBy(*order)


def director_rings_table(wh: Warehouse, min_amount: float = 100_000, limit: int = 200) -> DataFrame:
    """The pairs with both canonical names, as stored by the precompute job."""
    pairs = director_funding_pairs_fast(wh, min_amount, limit)
    return named(named(pairs, wh, "entity_id_a", "name_a"), wh, "entity_id_b", "name_b")


def _simple_names(wh: Warehouse) -> DataFrame:
    """Distinct (number, plain lower-case name)."""
    return (
        wh.directors.select(
            ids.bn_left(F.col("bn")).alias("bn_root"),
            names.director_simple(F.col("first_name"), F.col("last_name")).alias("director_norm"),
        )
        .filter(F.col("director_norm") != "")
        .distinct()
    )


def contractor_totals(wh: Warehouse, min_contract: float = 10_000) -> DataFrame:
    def awards(table: str, label: str) -> DataFrame:
        return (
            linked(wh, "ab", table, "id", "string")
            .join(wh.table(table).filter("amount > 0"), F.col("_key") == F.col("id"))
            .select("entity_id", "amount", F.lit(label).alias("contract_source"))
        )

    return (
        awards("ab_contracts", "ab_contract")
        .unionByName(awards("ab_sole_source", "ab_sole_source"))
        .groupBy("entity_id")
        .agg(F.sum("amount").alias("total"), F.max("contract_source").alias("contract_source"))
        .filter(F.col("total") >= F.lit(min_contract))
        .select(
            F.col("entity_id").alias("contractor_entity_id"),
            F.col("total").cast("double").alias("total_contract_amount"),
            "contract_source",
        )
    )


def grant_totals(wh: Warehouse, min_grant: float = 25_000, dedupe_amendments: bool = False) -> DataFrame:
    """Federal totals per entity, over all amendments unless told to keep the latest only."""
    from fundtrace.operators.edges import current_grants

    grants = current_grants(wh) if dedupe_amendments else wh.table("grants_contributions")
    return (
        linked(wh, "fed", "grants_contributions", "_id", "bigint")
        .join(grants.filter("agreement_value > 0"), F.col("_key") == F.col("_id"))
        .groupBy("entity_id")
        .agg(F.sum("agreement_value").alias("total"))
        .filter(F.col("total") >= F.lit(min_grant))
        .select(
            F.col("entity_id").alias("charity_entity_id"),
            F.col("total").cast("double").alias("total_grant_amount"),
        )
    )


def _with_directors(wh: Warehouse, totals: DataFrame, id_column: str) -> DataFrame:
    return (
        _simple_names(wh)
        .join(id_by_root(wh.entities, id_column), "bn_root")
        .select(id_column, "director_norm")
        .distinct()
        .join(totals, id_column)
    )


def contractor_directors(wh: Warehouse, min_contract: float = 10_000) -> DataFrame:
    """Directors (names of five characters or more) of entities with contracts."""
    return _with_directors(wh, contractor_totals(wh, min_contract), "contractor_entity_id").filter(
        F.length("director_norm") >= 5
    )


def charities_for_directors(
    wh: Warehouse, wanted_names: DataFrame | None = None, min_grant: float = 25_000
) -> DataFrame:
    """Directors of entities with federal grants, kept to ``wanted_names.director_norm`` if given."""
    found = _with_directors(wh, grant_totals(wh, min_grant), "charity_entity_id")
    if wanted_names is None:
        return found
    return found.join(wanted_names.select("director_norm").distinct(), "director_norm", "left_semi")


def crossover(
    wh: Warehouse,
    min_grant: float = 25_000,
    min_contract: float = 10_000,
    limit: int | None = 200,
) -> DataFrame:
    """Charity and contractor pairs with a director in common, by contract and grant total.

    The report keeps ``limit`` pairs ordered by (contract, grant, charity, contractor). A pair among
    them has fewer than ``limit`` better pairs under any one name, so under each name only the first
    ``limit + 1`` contractors and charities can take part (one more, as an entity never pairs with
    itself). That is exact and keeps a common name from pairing all its holders. The chosen pairs
    then collect all the names they share.
    """
    contractors = contractor_directors(wh, min_contract)
    charities = charities_for_directors(wh, min_grant=min_grant)
    left, right = contractors, charities
    if limit is not None:
        left = _first_per_name(left, "total_contract_amount", "contractor_entity_id", limit + 1)
        right = _first_per_name(right, "total_grant_amount", "charity_entity_id", limit + 1)
    pairs = (
        left.join(right, "director_norm")
        .filter("contractor_entity_id <> charity_entity_id")
        .groupBy("charity_entity_id", "contractor_entity_id")
        .agg(
            F.max("total_grant_amount").alias("total_grant_amount"),
            F.max("total_contract_amount").alias("total_contract_amount"),
            F.max("contract_source").alias("contract_source"),
        )
    )
    order = [
        F.desc("total_contract_amount"),
        F.desc("total_grant_amount"),
        F.asc("charity_entity_id"),
        F.asc("contractor_entity_id"),
    ]
    pairs = top(pairs, limit, *order)
    chosen = F.broadcast(pairs) if limit is not None and limit <= 10_000 else pairs
    return (
        contractors.select("contractor_entity_id", "director_norm")
        .join(chosen, "contractor_entity_id")
        .join(
            charities.select("charity_entity_id", "director_norm"),
            ["charity_entity_id", "director_norm"],
        )
        .groupBy(
            "charity_entity_id",
            "contractor_entity_id",
            "total_grant_amount",
            "total_contract_amount",
            "contract_source",
        )
        .agg(F.sort_array(F.collect_set("director_norm")).alias("shared_directors"))
    )


def _first_per_name(rows: DataFrame, amount: str, id_column: str, count: int) -> DataFrame:
    rank = Window.partitionBy("director_norm").orderBy(F.desc(amount), F.asc(id_column))
    return (
        rows.withColumn("_rank", F.row_number().over(rank))
        .filter(F.col("_rank") <= count)
        .drop("_rank")
    )


def crossover_table(wh: Warehouse, **options) -> DataFrame:
    """The crossover with both canonical names, as stored by the precompute job."""
    pairs = crossover(wh, **options)
    return named(
        named(pairs, wh, "charity_entity_id", "charity_name"),
        wh,
        "contractor_entity_id",
        "contractor_name",
    )


def crossover_display(table: DataFrame) -> DataFrame:
    return table.select(
        F.col("charity_name").alias("charity"),
        F.col("contractor_name").alias("contractor"),
        F.array_join("shared_directors", ", ").alias("directors"),
        F.round("total_grant_amount", 0).cast("bigint").alias("federal_grants"),
        F.round("total_contract_amount", 0).cast("bigint").alias("ab_contracts"),
        F.col("contract_source").alias("contract_type"),
    )
