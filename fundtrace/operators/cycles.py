"""Funding loops: detection in the gift graph and reports over the loop tables (G16, Q4-Q6, Q13, Q24)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundtrace.functions import ids
from fundtrace.operators.entities import id_by_root, top
from fundtrace.session import checkpoint
from fundtrace.sources.warehouse import Warehouse

# Below this many loops a member list is at most loops x hops rows and may be broadcast.
BROADCAST_LOOPS = 10_000


def gift_graph(gifts: DataFrame, min_edge_amount: float | None) -> DataFrame:
    """Donor-to-donee totals of at least ``min_edge_amount`` (``None``: all), without self-gifts."""
    totals = (
        gifts.filter("total_gifts > 0 AND donee_bn IS NOT NULL")
        .select(
            ids.bn_left(F.col("bn")).alias("src"),
            ids.bn_left(F.col("donee_bn")).alias("dst"),
            "total_gifts",
            F.year("fpe").alias("year"),
        )
        .filter("src <> dst")
        .groupBy("src", "dst")
        .agg(
            F.sum("total_gifts").alias("amt"),
            F.min("year").alias("min_year"),
            F.max("year").alias("max_year"),
        )
    )
    return totals if min_edge_amount is None else totals.filter(F.col("amt") >= F.lit(min_edge_amount))


def prune(edges: DataFrame, goes_on: float = 0.02) -> DataFrame:
    """(src, dst) of ``edges`` without those that cannot lie on a loop: their end gives nothing or their start gets nothing.

    Rounds go on to the fixed point, but no longer than each still drops a share of ``goes_on`` of the edges: what a longer
    chain of few edges leaves behind costs less than its rounds.
    """
    edges = edges.select("src", "dst")
    size = edges.count()
    while size:
        givers = edges.select(F.col("src").alias("dst")).distinct()
        takers = edges.select(F.col("dst").alias("src")).distinct()
        edges = checkpoint(edges.join(givers, "dst", "left_semi").join(takers, "src", "left_semi"))
        before, size = size, edges.count()
        if before - size <= goes_on * before:
            break
    return edges


def numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with long ids (bn, id) that rise with a node's degree, so hubs have the largest."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("bn")).groupBy("bn").agg(F.count(F.lit(1)).alias("degree"))
    # Ids are dealt out in the order of the ranges and stored, so they are read the same by every step.
    ranged = ends.repartitionByRange("degree", "bn").sortWithinPartitions("degree", "bn")
    nodes = checkpoint(ranged.select("bn", F.monotonically_increasing_id().alias("id")))
    for side in ("src", "dst"):
        edges = edges.withColumnRenamed(side, "bn").join(nodes, "bn").drop("bn").withColumnRenamed("id", side)
    return nodes, checkpoint(edges.select("src", "dst"))


def _first(edges: DataFrame, start: str, other: str) -> DataFrame:
    return edges.filter(F.col(other) < F.col(start)).select(F.col(start).alias("start"), F.col(other).alias("v1"))


def _grow(paths: DataFrame, edges: DataFrame, near: str, far: str, size: int) -> DataFrame:
    """Paths of ``size`` edges made one longer, below their start and without a node twice."""
    steps = edges.select(F.col(near).alias("at"), F.col(far).alias("next"))
    seen = [f"v{i}" for i in range(1, size + 1)]
    fresh = reduce(lambda a, b: a & b, [F.col("next") != F.col(v) for v in seen], F.col("next") < F.col("start"))
    return paths.join(steps, (F.col(f"v{size}") == F.col("at")) & fresh).select(
        "start", *seen, F.col("next").alias(f"v{size + 1}")
    )


def _met(ahead: DataFrame, back: DataFrame, out: int, home: int) -> DataFrame:
    """Loops of ``out`` + ``home`` edges: paths out of a start that end where paths back to it begin."""
    first, last = [f"a.v{i}" for i in range(1, out + 1)], [f"b.v{i}" for i in range(home - 1, 0, -1)]
    apart = [F.col(x) != F.col(y) for x in first for y in last]
    here = (F.col("a.start") == F.col("b.start")) & (F.col(f"a.v{out}") == F.col(f"b.v{home}"))
    return ahead.alias("a").join(back.alias("b"), reduce(lambda x, y: x & y, apart, here)).select(
        F.array("a.start", *first, *last).alias("path")
    )


def find_loops(edges: DataFrame, max_hops: int = 6, pairs: DataFrame | None = None) -> DataFrame:
    """All simple loops of two to ``max_hops`` edges, each listed from its smallest number on.

    A loop is found from its node of the highest degree, through nodes of lower degree only, so a hub is never in the
    middle of a path and the paths of two edges are at most edges x sqrt(edges). A loop of n edges is met in the middle:
    a path of ceil(n/2) edges out of the start joins a path of floor(n/2) edges back to it. Paths are node ids alone;
    amounts and years are looked up for the loops found. ``pairs`` are the (src, dst) that may lie on a loop.
    """
    nodes, steps = numbered(edges.select("src", "dst") if pairs is None else pairs)
    ahead, back = {1: _first(steps, "src", "dst")}, {1: _first(steps, "dst", "src")}
    for n in range(1, (max_hops + 1) // 2):
        ahead[n + 1] = checkpoint(_grow(ahead[n], steps, "src", "dst", n))
    for n in range(1, max_hops // 2):
        back[n + 1] = checkpoint(_grow(back[n], steps, "dst", "src", n))
    sizes = range(2, max_hops + 1)
    found = reduce(DataFrame.unionByName, [_met(ahead[(n + 1) // 2], back[n // 2], (n + 1) // 2, n // 2) for n in sizes])
    found = checkpoint(found.withColumn("loop", F.monotonically_increasing_id()))
    placed = found.select("loop", F.posexplode("path").alias("pos", "id")).join(nodes, "id")
    named = placed.groupBy("loop").agg(F.sort_array(F.collect_list(F.struct("pos", "bn")))["bn"].alias("bns"))
    begin = F.array_position("bns", F.array_min("bns")).cast("int")
    path = F.concat(F.slice("bns", begin, F.size("bns")), F.slice("bns", F.lit(1), begin - 1))
    named = checkpoint(named.select("loop", path.alias("path_bns")))
    at = named.select("loop", "path_bns", F.posexplode("path_bns").alias("pos", "src"))
    at = at.select("loop", "src", F.coalesce(F.try_element_at("path_bns", F.col("pos") + 2), F.element_at("path_bns", 1)).alias("dst"))
    money = at.join(edges, ["src", "dst"]).groupBy("loop").agg(
        F.sum("amt").cast("decimal(28,2)").alias("total_flow"),
        F.min("amt").alias("bottleneck_amt"),
        F.min("min_year").alias("min_year"),
        F.max("max_year").alias("max_year"),
    )
    return named.join(money, "loop").select(
        "path_bns",
        F.size("path_bns").alias("hops"),
        "total_flow",
        "bottleneck_amt",
        "min_year",
        "max_year",
        F.array_join("path_bns", "-").alias("id"),
    )


def detect(gifts: DataFrame, min_edge_amount: float | None, max_hops: int = 6) -> dict[str, DataFrame]:
    """The three loop tables, detected in the gifts. ``id`` is the path itself."""
    edges = checkpoint(gift_graph(gifts, min_edge_amount))
    loops = checkpoint(find_loops(edges, max_hops, prune(edges)))
    used = path_pairs(loops).select("src_bn", "dst_bn").distinct()
    loop_edges = used.join(
        edges, (F.col("src_bn") == F.col("src")) & (F.col("dst_bn") == F.col("dst"))
    ).select("src", "dst", F.col("amt").alias("total_amt"), "min_year", "max_year")
    participants = loops.select(F.explode("path_bns").alias("bn")).distinct()
    return {"loops": loops, "loop_edges": loop_edges, "loop_participants": participants}


def path_pairs(loops: DataFrame) -> DataFrame:
    """Consecutive members of each loop, the last one followed by the first."""
    placed = loops.select("id", "path_bns", F.posexplode("path_bns").alias("pos", "bn"))
    follower = F.coalesce(
        F.try_element_at("path_bns", F.col("pos") + 2), F.element_at("path_bns", 1)
    )
    return placed.select(
        F.col("id").alias("cycle_id"),
        (F.col("pos") + 1).alias("edge_order"),
        ids.bn_left(F.col("bn")).alias("src_bn"),
        ids.bn_left(follower).alias("dst_bn"),
    )


def _headers(wh: Warehouse, min_hops: int, max_hops: int) -> DataFrame:
    return wh.loops.filter(F.col("hops").between(min_hops, max_hops)).select(
        F.col("id").alias("cycle_id"),
        F.coalesce("total_flow", "bottleneck_amt", F.lit(0)).cast("double").alias("total_amount"),
        F.col("hops").alias("hop_count"),
        "min_year",
        "max_year",
        "path_bns",
    )


def top_cycles(
    wh: Warehouse, limit: int | None = 5000, min_hops: int = 2, max_hops: int = 6
) -> DataFrame:
    """Loop headers by amount, largest first, ties by id."""
    return top(_headers(wh, min_hops, max_hops), limit, F.desc("total_amount"), "cycle_id")


def members(wh: Warehouse, headers: DataFrame, bounded: bool) -> DataFrame:
    """(cycle_id, ord, entity_id): active entities on each path, in path order.

    Numbers without an active entity vanish and a number shared by several entities adds them all.
    ``bounded`` says that ``headers`` was cut to at most BROADCAST_LOOPS rows.
    """
    placed = headers.select("cycle_id", F.posexplode("path_bns").alias("pos", "bn")).select(
        "cycle_id", (F.col("pos") + 1).alias("ord"), ids.bn_left(F.col("bn")).alias("bn_root")
    )
    if bounded:
        placed = F.broadcast(placed)
    return id_by_root(wh.active_entities).join(placed, "bn_root").select("cycle_id", "ord", "entity_id")


def precomputed_cycles(
    wh: Warehouse, min_hops: int = 2, max_hops: int = 6, limit: int | None = 5000
) -> DataFrame:
    """Cycles with their member ids in path order (at most hops x records per number ids each)."""
    headers = top_cycles(wh, limit, min_hops, max_hops)
    bounded = limit is not None and limit <= BROADCAST_LOOPS
    lists = (
        members(wh, headers, bounded)
        .groupBy("cycle_id")
        .agg(F.sort_array(F.collect_list(F.struct("ord", "entity_id"))).alias("m"))
        .select("cycle_id", F.col("m.entity_id").alias("entity_ids"))
    )
    return (
        headers.join(lists, "cycle_id", "left")
        .withColumn("entity_ids", F.coalesce("entity_ids", F.array().cast("array<bigint>")))
        .drop("path_bns")
    )


def cycle_summary(wh: Warehouse) -> DataFrame:
    return wh.loops.select(
        F.col("id").alias("cycle_id"),
        F.coalesce("total_flow", "bottleneck_amt", F.lit(0)).cast("double").alias("total_amount"),
        F.col("hops").alias("hop_count"),
        "min_year",
        "max_year",
        "path_bns",
    )


def _edge_totals(wh: Warehouse) -> DataFrame:
    return wh.loop_edges.select(
        ids.bn_left(F.col("src")).alias("src_bn"),
        ids.bn_left(F.col("dst")).alias("dst_bn"),
        "total_amt",
        "min_year",
        "max_year",
    )


def cycle_edges(wh: Warehouse, chosen: DataFrame | None = None) -> DataFrame:
    """Directed edges of every loop (or of ``chosen.cycle_id``) between active entities."""
    pairs = path_pairs(wh.loops)
    if chosen is not None:
        pairs = pairs.join(chosen.select("cycle_id"), "cycle_id", "left_semi")
    active = wh.active_entities
    return (
        pairs.join(id_by_root(active, "from_entity_id", "src_bn"), "src_bn")
        .join(id_by_root(active, "to_entity_id", "dst_bn"), "dst_bn")
        .join(_edge_totals(wh), ["src_bn", "dst_bn"], "left")
        .select(
            "from_entity_id",
            "to_entity_id",
            "cycle_id",
            "edge_order",
            "src_bn",
            "dst_bn",
            F.coalesce("total_amt", F.lit(0)).cast("double").alias("amount"),
            F.coalesce(
                F.col("max_year").cast("string"), F.col("min_year").cast("string"), F.lit("")
            ).alias("date"),
            F.lit("cra_gift").alias("source"),
            F.concat_ws("|", "cycle_id", F.col("edge_order").cast("string")).alias("source_row_id"),
            F.lit("authoritative").alias("mapping_method"),
            F.lit(1.0).alias("confidence_score"),
        )
    )


def cycle_edge_evidence(wh: Warehouse) -> DataFrame:
    """JSON provenance of each loop edge, keyed by (cycle_id, edge_order)."""
    return (
        path_pairs(wh.loops)
        .join(_edge_totals(wh), ["src_bn", "dst_bn"], "left")
        .select(
            "cycle_id",
            "edge_order",
            F.lit("cra.loop_edges").alias("table_name"),
            F.to_json(
                F.struct(
                    "cycle_id",
                    "edge_order",
                    F.col("src_bn").alias("source_bn"),
                    F.col("dst_bn").alias("destination_bn"),
                    F.coalesce("total_amt", F.lit(0).cast("decimal(28,2)")).alias("amount"),
                    "min_year",
                    "max_year",
                    F.lit("cra.loop_edges").alias("provenance"),
                ),
                {"ignoreNullFields": "false"},
            ).alias("row"),
        )
    )
