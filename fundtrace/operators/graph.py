"""The property graph and its views (G1-G5, G7, G11-G15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundtrace.functions import ids
from fundtrace.operators import cycles, directors, edges, rings as ring_ops
from fundtrace.operators.directors import NAME
from fundtrace.schemas import EDGE_COLUMNS
from fundtrace.session import checkpoint
from fundtrace.sources.warehouse import Warehouse

# Display colours by node type and by edge source.
NODE_COLORS = {
    "person": "#60a5fa",
    "charity": "#fbbf24",
    "organization": "#fbbf24",
    "business": "#4ade80",
    "company": "#4ade80",
    "gov": "#f87171",
    "unknown": "#94a3b8",
}
EDGE_COLORS = {
    "cra_gift": "#fbbf24",
    "fed_grant": "#4ade80",
    "fed_contribution": "#a3e635",
    "ab_grant": "#38bdf8",
    "ab_contract": "#c4b5fd",
    "ab_sole_source": "#f87171",
    "cra_director": "#94a3b8",
}
DEFAULT_COLOR = "#94a3b8"

# Up to this many entities are sent to the money edges; beyond, all edges are formed and joined.
FEW_ENTITIES = 10_000

GRAPH_COLUMNS = [
    "src",
    "dst",
    "source",
    "amount",
    "date",
    "mapping_method",
    "confidence_score",
    "source_row_id",
]


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(text) for item in table.items() for text in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(DEFAULT_COLOR))


def director_graph_edges(rows: DataFrame) -> DataFrame:
    """Person-to-entity edges; keeps any extra columns of ``rows`` such as a ring or seed."""
    extra = [c for c in rows.columns if c not in (NAME, "entity_id", "t3010_year", "source_row_id")]
    return rows.filter(F.col(NAME) != "").select(
        *extra,
        F.concat(F.lit("person:"), NAME).alias("src"),
        F.col("entity_id").cast("string").alias("dst"),
        F.lit("cra_director").alias("source"),
        F.lit(0.0).alias("amount"),
        F.coalesce(F.col("t3010_year").cast("string"), F.lit("")).alias("date"),
        F.lit("authoritative").alias("mapping_method"),
        F.lit(1.0).alias("confidence_score"),
        "source_row_id",
    )


def funding_graph_edges(rows: DataFrame) -> DataFrame:
    """Money edges between nodes. No target, no edge; no donor, a funder node per source row."""
    extra = [c for c in rows.columns if c not in EDGE_COLUMNS]
    funder = F.concat(F.lit("source:"), "source", F.lit(":"), "source_row_id")
    return rows.filter("to_entity_id IS NOT NULL").select(
        *extra,
        F.coalesce(F.col("from_entity_id").cast("string"), funder).alias("src"),
        F.col("to_entity_id").cast("string").alias("dst"),
        "source",
        F.coalesce(F.col("amount").cast("double"), F.lit(0.0)).alias("amount"),
        F.coalesce(F.col("date").cast("string"), F.lit("")).alias("date"),
        F.coalesce("mapping_method", F.lit("authoritative")).alias("mapping_method"),
        F.coalesce(F.nullif("confidence_score", F.lit(0.0)), F.lit(1.0)).alias("confidence_score"),
        "source_row_id",
    )


def graph_edges(wh: Warehouse) -> DataFrame:
    """Every distinct edge of the multigraph."""
    return _edge_rows(wh).distinct()


def _edge_rows(wh: Warehouse) -> DataFrame:
    """The edges as their sources give them, copies included."""
    return director_graph_edges(directors.directors_for_org(wh)).unionByName(funding_graph_edges(edges.money_edges(wh)))


def _node_id_number(node: Column) -> Column:
    return F.when(~F.contains(node, F.lit(":")), node.try_cast("bigint"))


def vertices_of(wh: Warehouse, graph: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Nodes at either end of the edges (per ``keys``), with their attributes joined last."""
    keys = keys or []
    ends = graph.select(
        *keys,
        F.explode(F.array("src", "dst")).alias("node_id"),
        F.when(F.startswith("src", F.lit("source:")), F.col("source")).alias("_funder"),
    )
    nodes = (
        ends.select(
            *keys,
            "node_id",
            F.when(F.startswith("node_id", F.lit("source:")), F.col("_funder")).alias("_funder"),
        )
        .distinct()
    )
    return describe_nodes(wh, nodes)


def describe_nodes(wh: Warehouse, nodes: DataFrame) -> DataFrame:
    """Attributes of ``node_id`` rows: entities by lookup, persons and funders from their id."""
    lookup = wh.entities.select(
        F.col("id").alias("_id"), "canonical_name", "entity_type", "dataset_sources", "aliases"
    )
    person = F.startswith("node_id", F.lit("person:"))
    gov = F.startswith("node_id", F.lit("source:"))
    title = F.initcap(F.replace("_funder", F.lit("_"), F.lit(" ")))
    return (
        nodes.withColumn("_id", _node_id_number(F.col("node_id")))
        .join(lookup, "_id", "left")
        .select(
            *[c for c in nodes.columns if c not in ("node_id", "_funder")],
            "node_id",
            F.when(person, F.substring("node_id", 8, 1_000_000))
            .when(gov, title)
            .otherwise(ids.entity_label(F.col("canonical_name"), F.col("node_id")))
            .alias("canonical_name"),
            F.when(person, "person")
            .when(gov, "gov")
            .otherwise(F.coalesce(F.nullif("entity_type", F.lit("")), F.lit("unknown")))
            .alias("entity_type"),
            F.when(person, F.array(F.lit("cra")))
            .when(gov, F.array(F.substring_index("_funder", "_", 1)))
            .otherwise(F.coalesce("dataset_sources", F.array().cast("array<string>")))
            .alias("datasets"),
            F.coalesce("aliases", F.lit("[]")).alias("aliases"),
        )
    )


def vertices(wh: Warehouse) -> DataFrame:
    """All nodes: every entity, and the persons and funders that have an edge."""
    everyone = wh.entities.select(
        F.col("id").cast("string").alias("node_id"), F.lit(None).cast("string").alias("_funder")
    )
    # Nodes are made distinct below; making the edges distinct first would shuffle every edge.
    others = _edge_rows(wh).select(
        F.col("src").alias("node_id"),
        F.when(F.startswith("src", F.lit("source:")), F.col("source")).alias("_funder"),
    ).filter(F.contains("node_id", F.lit(":")))
    return describe_nodes(wh, everyone.unionByName(others).distinct())


def _edges_at(wh: Warehouse, listed: DataFrame) -> DataFrame:
    """Money edges with an end in ``listed`` (a stored table with ``entity_id``), with its columns, one copy per end."""
    few = listed.select("entity_id").distinct()
    money = edges.money_edges(wh, few if few.count() <= FEW_ENTITIES else None)
    return edges.by_entity(money).drop("role").join(listed, "entity_id")


def ego_graph(wh: Warehouse, seeds: DataFrame, radius: int = 2) -> DataFrame:
    """Distinct edges within ``radius`` expansions of each seed, keyed by ``seed``.

    Each hop is one join of all seeds' frontiers with the per-entity edge copies, then an anti-join
    with what was visited.
    """
    frontier = checkpoint(seeds.select(F.col("entity_id").alias("seed"), "entity_id").distinct())
    visited = frontier
    touched = None
    for hop in range(max(radius, 1)):
        found = _edges_at(wh, frontier)
        if hop + 1 < max(radius, 1):
            # Read for the result and for the next frontier.
            found = checkpoint(found)
        part = found.drop("entity_id")
        touched = part if touched is None else touched.unionByName(part)
        if hop + 1 < max(radius, 1):
            nearby = (
                found.select("seed", F.explode(F.array("from_entity_id", "to_entity_id")).alias("entity_id"))
                .filter("entity_id IS NOT NULL")
                .distinct()
            )
            frontier = checkpoint(nearby.join(visited, ["seed", "entity_id"], "left_anti"))
            visited = visited.unionByName(frontier)
    held = directors.directors_for_org(wh, visited.select("entity_id").distinct()).join(
        visited, "entity_id"
    )
    return (
        funding_graph_edges(touched.select("seed", *EDGE_COLUMNS))
        .unionByName(director_graph_edges(held.select("seed", "entity_id", NAME, "t3010_year", "source_row_id")))
        .distinct()
    )


def ring_graph(wh: Warehouse, members: DataFrame) -> DataFrame:
    """Per ring: its members' directors and every edge with an end in the ring."""
    listed = checkpoint(members.select("ring_id", "entity_id").distinct())
    money = _edges_at(wh, listed).drop("entity_id")
    held = directors.directors_for_org(wh, listed).join(listed, "entity_id")
    return (
        funding_graph_edges(money.select("ring_id", *EDGE_COLUMNS))
        .unionByName(director_graph_edges(held.select("ring_id", "entity_id", NAME, "t3010_year", "source_row_id")))
        .distinct()
    )


def cycle_graph(wh: Warehouse, chosen: DataFrame | None = None) -> DataFrame:
    """The directed edges of each cycle as graph edges, keyed by ``cycle_id``."""
    rows = cycles.cycle_edges(wh, chosen)
    return funding_graph_edges(rows.select("cycle_id", *EDGE_COLUMNS)).distinct()


def ring_edges(wh: Warehouse, members: DataFrame) -> DataFrame:
    """Edges with both ends in a ring, once per (source, row, from, to)."""
    listed = members.select("ring_id", "entity_id").distinct()
    return (
        edges.money_edges(wh)
        .filter("from_entity_id IS NOT NULL AND to_entity_id IS NOT NULL")
        .join(listed.withColumnRenamed("entity_id", "from_entity_id"), "from_entity_id")
        .join(listed.withColumnRenamed("entity_id", "to_entity_id"), ["ring_id", "to_entity_id"])
        .groupBy("ring_id", "source", "source_row_id", "from_entity_id", "to_entity_id")
        .agg(
            F.max("amount").alias("amount"),
            F.max("date").alias("date"),
            F.max("mapping_method").alias("mapping_method"),
            F.max("confidence_score").alias("confidence_score"),
        )
    )


def export_nodes(nodes: DataFrame, highlight: DataFrame | None = None) -> DataFrame:
    """Display table of nodes; ``highlight.node_id`` get a thick red border."""
    if highlight is None:
        marked = nodes.withColumn("_hot", F.lit(False))
    else:
        hot = highlight.select("node_id", F.lit(True).alias("_h")).distinct()
        marked = nodes.join(hot, "node_id", "left").withColumn(
            "_hot", F.coalesce("_h", F.lit(False))
        )
    return marked.select(
        F.col("node_id").alias("id"),
        F.col("canonical_name").alias("label"),
        F.col("canonical_name").alias("title"),
        F.col("entity_type").alias("group"),
        _lookup(NODE_COLORS, F.col("entity_type")).alias("background"),
        F.when(F.col("_hot"), "#ef4444").otherwise("#e5e7eb").alias("border"),
        F.when(F.col("_hot"), 4).otherwise(1).alias("border_width"),
    )


def export_edges(graph: DataFrame) -> DataFrame:
    """Display table of edges; the id is made of the edge itself."""
    return graph.select(
        F.concat_ws(":", "src", "dst", F.concat_ws("|", "source", "source_row_id")).alias("id"),
        F.col("src").alias("from"),
        F.col("dst").alias("to"),
        F.when(F.col("amount") != 0, F.concat(F.lit("$"), F.format_number("amount", 0)))
        .otherwise(F.col("source"))
        .alias("label"),
        F.concat(
            F.lit("Source: "),
            "source",
            F.lit("<br>Amount: $"),
            F.format_number("amount", 2),
            F.lit("<br>Date: "),
            "date",
            F.lit("<br>Row: "),
            "source_row_id",
        ).alias("title"),
        _lookup(EDGE_COLORS, F.col("source")).alias("color"),
        F.lit("to").alias("arrows"),
        "source",
        "amount",
        "date",
        "mapping_method",
        "confidence_score",
        "source_row_id",
    )


def evidence_table(wh: Warehouse, graph: DataFrame) -> DataFrame:
    """In-edges and out-edges of every node with both names; a self-loop shows twice."""
    label = F.initcap(F.replace("source", F.lit("_"), F.lit(" ")))
    lookup = wh.entities.select(F.col("id").alias("_id"), "canonical_name")

    def named(df: DataFrame, end: str, out: str) -> DataFrame:
        key = f"_{end}_id"
        person = F.startswith(end, F.lit("person:"))
        gov = F.startswith(end, F.lit("source:"))
        found = lookup.select(F.col("_id").alias(key), F.col("canonical_name").alias(f"_{end}_name"))
        return (
            df.withColumn(key, _node_id_number(F.col(end)))
            .join(found, key, "left")
            .withColumn(
                out,
                F.when(person, F.substring(end, 8, 1_000_000))
                .when(gov, label)
                .otherwise(ids.entity_label(F.col(f"_{end}_name"), F.col(end))),
            )
        )

    both = named(named(graph, "src", "from"), "dst", "to")
    return both.select(
        F.explode(F.array("dst", "src")).alias("node_id"),
        "source",
        F.replace("source", F.lit("_"), F.lit(".")).alias("table"),
        "source_row_id",
        "mapping_method",
        "confidence_score",
        "from",
        "to",
    )


def _display_edge(src: Column, dst: Column, source: Column, amount: Column) -> Column:
    return F.struct(
        src.alias("src"),
        dst.alias("dst"),
        source.alias("source"),
        amount.alias("amount"),
        F.lit("").alias("date"),
        F.lit("authoritative").alias("mapping_method"),
        F.lit(1.0).alias("confidence_score"),
        F.lit("").alias("source_row_id"),
    )


def crossover_graph_edges(table: DataFrame) -> DataFrame:
    """Funder and director edges of each crossover pair."""
    charity = F.concat(F.lit("crossover-charity-"), F.col("charity_entity_id").cast("string"))
    contractor = F.concat(
        F.lit("crossover-contractor-"), F.col("contractor_entity_id").cast("string")
    )
    kind = F.coalesce("contract_source", F.lit("ab_contract"))
    director = F.lit("cra_director")
    money = F.array(
        _display_edge(
            F.lit("gov:fed_grants_contributions"),
            charity,
            F.lit("fed_grant"),
            F.coalesce("total_grant_amount", F.lit(0.0)),
        ),
        _display_edge(
            F.concat(F.lit("gov:"), kind),
            contractor,
            kind,
            F.coalesce("total_contract_amount", F.lit(0.0)),
        ),
    )
    people = F.flatten(
        F.transform(
            F.filter("shared_directors", lambda d: d != ""),
            lambda d: F.array(
                _display_edge(F.concat(F.lit("person:"), d), charity, director, F.lit(0.0)),
                _display_edge(F.concat(F.lit("person:"), d), contractor, director, F.lit(0.0)),
            ),
        )
    )
    return table.select(
        "charity_entity_id", "contractor_entity_id", F.inline(F.concat(money, people))
    )


def crossover_graph_nodes(table: DataFrame) -> DataFrame:
    """Charity, contractor, funder and director nodes of each crossover pair."""

    def node(node_id, name, kind: str, datasets: list[str], score: float, flags: list[str]):
        texts = F.array(*[F.lit(f) for f in flags]) if flags else F.array().cast("array<string>")
        return F.struct(
            node_id.alias("node_id"),
            name.alias("canonical_name"),
            F.lit(kind).alias("entity_type"),
            F.array(*[F.lit(d) for d in datasets]).alias("datasets"),
            F.lit(score).alias("total_score"),
            texts.alias("flags"),
        )

    kind = F.coalesce("contract_source", F.lit("ab_contract"))
    fixed = F.array(
        node(
            F.concat(F.lit("crossover-charity-"), F.col("charity_entity_id").cast("string")),
            F.coalesce("charity_name", F.lit("Charity")),
            "charity",
            ["cra", "fed"],
            0.7,
            ["Federal-grant recipient"],
        ),
        node(
            F.concat(F.lit("crossover-contractor-"), F.col("contractor_entity_id").cast("string")),
            F.coalesce("contractor_name", F.lit("Contractor")),
            "business",
            ["cra", "ab"],
            0.7,
            ["AB contract recipient"],
        ),
        node(F.lit("gov:fed_grants_contributions"), F.lit("Federal G&C"), "gov", ["fed"], 0.0, []),
        node(
            F.concat(F.lit("gov:"), kind),
            F.when(kind == "ab_sole_source", "Alberta sole-source").otherwise("Alberta contract"),
            "gov",
            ["ab"],
            0.0,
            [],
        ),
    )
    people = F.transform(
        F.filter("shared_directors", lambda d: d != ""),
        lambda d: node(
            F.concat(F.lit("person:"), d), d, "person", ["cra"], 0.0, ["Shared director"]
        ),
    )
    return table.select(
        "charity_entity_id", "contractor_entity_id", F.inline(F.concat(fixed, people))
    )


def light_ring_edges(rings: DataFrame) -> DataFrame:
    """Edges read from the ring payload alone: shared persons to members, and listed gifts."""
    people = rings.select(
        "ring_id", F.explode("shared_persons").alias("person"), "entity_ids"
    ).select("ring_id", "person", F.explode("entity_ids").alias("entity_id"))
    drawn = people.select(
        "ring_id",
        F.inline(
            F.array(
                _display_edge(
                    F.concat(F.lit("person:"), "person"),
                    F.col("entity_id").cast("string"),
                    F.lit("cra_director"),
                    F.lit(0.0),
                )
            )
        ),
    )
    if "funding_edges" not in rings.columns:
        return drawn
    gifts = rings.select("ring_id", F.inline("funding_edges")).select(
        "ring_id",
        F.col("from_entity_id").cast("string").alias("src"),
        F.col("to_entity_id").cast("string").alias("dst"),
        F.coalesce("source", F.lit("cra_gift")).alias("source"),
        F.coalesce("amount", F.lit(0.0)).alias("amount"),
        F.coalesce(F.col("date").cast("string"), F.lit("")).alias("date"),
        F.coalesce("mapping_method", F.lit("authoritative")).alias("mapping_method"),
        F.coalesce(F.nullif("confidence_score", F.lit(0.0)), F.lit(1.0)).alias("confidence_score"),
        F.coalesce("source_row_id", F.lit("")).alias("source_row_id"),
    )
    return drawn.unionByName(gifts.filter("src IS NOT NULL AND dst IS NOT NULL"))


def light_ring_nodes(rings: DataFrame) -> DataFrame:
    """Members (as charities, with the ring's score) and shared persons of each ring payload."""
    score = F.col("total_score") if "total_score" in rings.columns else F.lit(0.0)
    members = rings.select(
        "ring_id",
        F.inline(F.arrays_zip("entity_ids", "canonical_names")),
        score.alias("total_score"),
    ).select(
        "ring_id",
        F.col("entity_ids").cast("string").alias("node_id"),
        F.col("canonical_names").alias("canonical_name"),
        F.lit("charity").alias("entity_type"),
        "total_score",
    )
    people = rings.select("ring_id", F.explode("shared_persons").alias("canonical_name")).select(
        "ring_id",
        F.concat(F.lit("person:"), "canonical_name").alias("node_id"),
        "canonical_name",
        F.lit("person").alias("entity_type"),
        F.lit(0.0).alias("total_score"),
    )
    return members.unionByName(people).distinct()


def director_overlay(wh: Warehouse, rings: DataFrame) -> DataFrame:
    """Cycle edges of each ring plus its shared persons linked to the members in the picture.

    A ring whose cycle has no edges is drawn from its payload instead.
    """
    rings = checkpoint(rings)
    keyed = rings.withColumn("cycle_id", ids.cycle_id_of_ring(F.col("ring_id")))
    wanted = keyed.select("cycle_id").filter("cycle_id IS NOT NULL")
    money = checkpoint(
        cycle_graph(wh, wanted).select(
            ids.cycle_ring_id(F.col("cycle_id")).alias("ring_id"), *GRAPH_COLUMNS
        )
    )
    light = light_ring_edges(rings)
    drawn_rings = money.select("ring_id").distinct()
    shown = money.select("ring_id", F.explode(F.array("src", "dst")).alias("dst")).distinct()
    people = light.filter(F.col("source") == "cra_director").distinct()
    overlay = people.join(shown, ["ring_id", "dst"], "left_semi").select("ring_id", *GRAPH_COLUMNS)
    fallback = light.join(drawn_rings, "ring_id", "left_anti").select("ring_id", *GRAPH_COLUMNS)
    return money.unionByName(overlay).unionByName(fallback)


def members_of(rings: DataFrame) -> DataFrame:
    return ring_ops.ring_members(rings).select("ring_id", "entity_id")
