"""Warehouse tables derived from a TPC-H-like star schema.

Every derivation is one SQL text that Spark and DuckDB read alike, so the comparison SQL starts
from exactly the same rows. Names and addresses come from short word lists by key arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundtrace.sources.warehouse import Warehouse

BASE_TABLES = ["customer", "supplier", "part", "orders", "lineitem", "events"]

_ADJECTIVES = (
    "Northern,Boreal,Prairie,Coastal,Granite,Maple,Harbour,Summit,Riverbend,Lakeside,Aurora,"
    "Cedar,Meadow,Pioneer,Heritage,Unity,Beacon,Horizon,Keystone,Evergreen,Compass,Lantern,Willow"
)
_NOUNS = (
    "Pathways,Futures,Gatherings,Learning,Housing,Wellness,Arts,Youth,Seniors,Pantry,Shelter,"
    "Rivers,Forests,Sports,Music,Science,Family,Outreach,Legal Aid"
)
_PLACES = (
    "Calgary,Edmonton,Regina,Halifax,Toronto,Ottawa,Montreal,Winnipeg,Victoria,Moncton,Kelowna,"
    "Hamilton,Laval"
)
_PROVINCES = "AB,BC,MB,NB,NL,NS,ON,PE,QC,SK"
_SUFFIXES = " Inc., Ltd, Society, Foundation,, Corp., Co."
_FIRST = (
    "Alice,Bruno,Carla,Dmitri,Elena,Farid,Grace,Hugo,Ines,Jonas,Karin,Louis,Maya,Nadia,Oscar,"
    "Priya,Quentin"
)
_LAST = (
    "Abbott,Bouchard,Carter,Dubois,Ellis,Fortin,Gagnon,Hughes,Ito,Jansen,Kowalski,Lavoie,Morin,"
    "Nguyen,Okafor,Pelletier,Quinn,Roy,Singh,Tremblay,Underhill,Vega,Wong"
)
_LAST2 = (
    "Archer,Baker,Cooper,Dyer,Fisher,Glover,Hunter,Mason,Porter,Sawyer,Tanner,Weaver,Miller"
)


def _pick(words: str, index: str) -> str:
    size = len(words.split(","))
    return f"split_part('{words}', ',', CAST(({index}) % {size} + 1 AS INT))"


def _whole(expression: str) -> str:
    return f"CAST(floor({expression}) AS BIGINT)"


_NAME = (
    "CASE WHEN seed % 40 = 11 THEN 'Red Cross ' || {place} || ' Chapter' "
    "WHEN seed % 40 = 12 THEN 'United Way of ' || {place} "
    "ELSE {adj} || ' ' || {noun} || ' ' || {place} END "
    "|| CASE WHEN seed >= 5681 THEN ' Branch ' || CAST({branch} AS STRING) ELSE '' END"
).format(
    place=_pick(_PLACES, _whole("seed / 437")),
    adj=_pick(_ADJECTIVES, "seed"),
    noun=_pick(_NOUNS, _whole("seed / 23")),
    branch=_whole("seed / 5681"),
)

_DIRECTOR_NAME = (
    "{first} AS first_name, {last} || '-' || {last2} AS last_name"
).format(
    first=_pick(_FIRST, "k"),
    last=_pick(_LAST, _whole("k / 17")),
    last2=_pick(_LAST2, _whole("k / 391")),
)

_AWARD = (
    "SELECT {key} AS id, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount{extra} "
    "FROM lineitem WHERE l_returnflag = '{flag}'"
)
_NUM_KEY = "(l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey"
_TEXT_KEY = (
    "concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), "
    "CAST(l_partkey AS STRING))"
)

# Declared in dependency order.
DERIVED: dict[str, str] = {
    "entity_seed": (
        "SELECT c_custkey AS id, CAST(100000001 + c_custkey AS STRING) AS bn_root, "
        "'charity' AS entity_type, CASE WHEN c_custkey % 10 = 3 THEN c_custkey - 1 ELSE c_custkey END % 25 AS nation, "
        "CASE WHEN c_custkey % 10 = 3 THEN c_custkey - 1 ELSE c_custkey END AS seed FROM customer "
        "UNION ALL SELECT 1000000000 + s_suppkey, CAST(200000001 + s_suppkey AS STRING), "
        "CASE WHEN s_suppkey % 12 = 5 THEN NULL ELSE 'business' END, s_nationkey, "
        "s_suppkey * 3 + 1 FROM supplier"
    ),
    "entity_named": (
        f"SELECT id, bn_root, entity_type, nation, seed, {_NAME} AS plain_name, "
        f"{_pick(_PLACES, 'nation')} AS city, {_pick(_PROVINCES, 'nation')} AS province, "
        "'T' || CAST(nation % 10 AS STRING) || 'K ' || CAST(seed % 37 AS STRING) AS postal "
        "FROM entity_seed"
    ),
    "golden_text": (
        f"SELECT id, plain_name || {_pick(_SUFFIXES, 'id')} AS canonical_name, entity_type, "
        "CASE WHEN id % 53 = 8 OR id % 20 = 3 THEN CAST(NULL AS STRING) ELSE bn_root END AS bn_root, "
        "bn_root || 'RR0001,' || bn_root || 'RC0001' AS bn_variants_csv, "
        "CASE WHEN id % 4 = 0 THEN '[\"' || plain_name || ' Trust\", \"Friends of ' || plain_name || '\"]' "
        "WHEN id % 4 = 1 THEN '[{\"name\": \"' || plain_name || ' Partners Ltd.\"}, {\"alias\": \"The ' || plain_name || '\"}, \"' || plain_name || ' O/A Local Group\"]' "
        "END AS aliases, "
        "CASE WHEN entity_type = 'charity' AND id % 3 = 0 THEN 'cra,fed' "
        "WHEN entity_type = 'charity' THEN 'cra' ELSE 'ab' END AS dataset_sources_csv, "
        "CASE WHEN id % 5 = 0 THEN CAST(id % 7 AS BIGINT) END AS source_link_count, "
        "CASE WHEN id % 11 = 0 THEN NULL WHEN id % 13 = 0 THEN '[{\"City\": \"' || city || '\"}]' "
        "WHEN id % 6 = 0 THEN '[{\"street\": \"1 Main\"}, {\"city\": \"' || city || '\", \"province\": \"' || province || '\", \"postal_code\": \"' || postal || '\"}, "
        "{\"city\": \"' || city || '\", \"postal_code\": \"' || postal || '\"}]' "
        "ELSE '[{\"city\": \"' || city || '\", \"province\": \"' || province || '\", \"postal_code\": \"' || postal || '\"}]' END AS addresses, "
        "CASE WHEN id % 9 = 0 THEN '[{\"entity_id\": ' || CAST(id + 1 AS STRING) || ', \"relationship_type\": \"AFFILIATE\", \"confidence_score\": 0.8}, "
        "{\"id\": ' || CAST(id + 7 AS STRING) || ', \"type\": \"PARTNER\"}]' "
        "WHEN id % 17 = 0 THEN '[{\"entity_id\": ' || CAST(id AS STRING) || '}, {\"confidence\": 0.5}]' END AS related_entities, "
        "CASE WHEN id % 50 = 7 THEN 'merged' ELSE 'active' END AS status FROM entity_named"
    ),
    "cra_directors": (
        f"SELECT bn, fpe, sequence_number, {_DIRECTOR_NAME}, "
        "CASE WHEN k % 6 = 0 THEN 'J' END AS initials FROM ("
        "SELECT CAST(100000001 + o_custkey AS STRING) || 'RR0001' AS bn, "
        "CAST(o_orderdate AS DATE) AS fpe, o_orderkey % 5 AS sequence_number, o_orderkey AS k "
        "FROM orders WHERE o_orderpriority < '4' "
        "UNION ALL SELECT CAST(200000001 + l_suppkey AS STRING) || 'RR0001', "
        "CAST(l_shipdate AS DATE), CAST(l_linenumber AS BIGINT), l_orderkey FROM lineitem "
        "WHERE l_orderkey % 97 = l_suppkey % 97) filings"
    ),
    "cra_qualified_donees": (
        "SELECT CAST(100000001 + o_custkey AS STRING) || 'RR0001' AS bn, "
        "CAST(l_shipdate AS DATE) AS fpe, CAST(l_linenumber AS BIGINT) AS sequence_number, "
        "CASE WHEN l_partkey % 101 = 100 THEN NULL "
        "ELSE CAST(100000001 + l_partkey AS STRING) || 'RR0001' END AS donee_bn, "
        "CAST(l_extendedprice AS DECIMAL(18,2)) AS total_gifts "
        "FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
    ),
    "cra_non_qualified_donees": (
        "SELECT CAST(100000001 + o_custkey AS STRING) || 'RR0001' AS bn, "
        "CAST(l_shipdate AS DATE) AS fpe, CAST(l_extendedprice AS DECIMAL(18,2)) AS cash_amount, "
        "CASE WHEN l_orderkey % 3 = 0 OR o_custkey % 19 = 0 THEN NULL ELSE p_name END AS recipient_name "
        "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey "
        "WHERE l_linestatus = 'F'"
    ),
    "cra_filings": (
        "SELECT CAST(100000001 + o_custkey AS STRING) || 'RR0001' AS bn, "
        "CAST(o_orderdate AS DATE) AS fpe, max(o_orderkey) AS k, "
        "max(CAST(o_totalprice AS DECIMAL(18,2))) AS spent FROM orders GROUP BY 1, 2"
    ),
    "cra_compensation": (
        "SELECT bn, fpe, CAST(spent * CAST(k % 10 AS DECIMAL(2,0)) * CAST(0.1 AS DECIMAL(2,1)) AS DECIMAL(18,2)) AS field_390 FROM cra_filings"
    ),
    "cra_financial_details": "SELECT bn, fpe, spent AS field_5100 FROM cra_filings",
    "cra_identification": (
        "SELECT DISTINCT bn, CAST(extract(year FROM fpe) AS INT) AS fiscal_year, "
        "'Filer ' || substring(bn, 1, 9) AS legal_name FROM cra_filings"
    ),
    "grants_contributions": (
        "SELECT o_orderkey AS _id, "
        f"CASE WHEN o_orderkey % 211 = 5 THEN NULL ELSE CAST({_whole('o_orderkey / 4')} AS STRING) END AS ref_number, "
        "CASE WHEN o_orderkey % 4 = 1 AND o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 4 END AS amendment_number, "
        "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS owner_org, "
        "CAST(CASE WHEN o_orderkey % 29 = 0 THEN 0 ELSE o_totalprice END AS DECIMAL(18,2)) AS agreement_value, "
        "CAST(o_orderdate AS DATE) AS agreement_start_date, "
        "CASE WHEN o_orderstatus = 'F' THEN 'C' ELSE 'G' END AS agreement_type FROM orders"
    ),
    "ab_grants": _AWARD.format(
        key=_NUM_KEY, flag="R", extra=", CAST(l_shipdate AS DATE) AS payment_date"
    ),
    "ab_contracts": _AWARD.format(key=_TEXT_KEY, flag="A", extra=""),
    "ab_sole_source": _AWARD.format(
        key=_TEXT_KEY,
        flag="N",
        extra=", CAST(l_shipdate AS DATE) AS start_date, 'Vendor ' || CAST(l_partkey % 40 AS STRING) AS vendor",
    ),
    "raw_links": (
        "SELECT 'f' || CAST(o_orderkey AS STRING) AS id, o_custkey AS entity_id, 'fed' AS source_schema, "
        "'grants_contributions' AS source_table, '{\"_id\": ' || CAST(o_orderkey AS STRING) || '}' AS source_pk, "
        "o_orderkey AS k FROM orders WHERE o_custkey % 8 <> 6 UNION ALL "
        f"SELECT 'g' || CAST({_NUM_KEY} AS STRING), 1000000000 + l_suppkey, 'ab', 'ab_grants', "
        f"'{{\"id\": ' || CAST({_NUM_KEY} AS STRING) || '}}', l_orderkey FROM lineitem WHERE l_returnflag = 'R' UNION ALL "
        f"SELECT 'c' || {_TEXT_KEY}, 1000000000 + l_suppkey, 'ab', 'ab_contracts', "
        f"'{{\"id\": \"' || {_TEXT_KEY} || '\"}}', l_orderkey FROM lineitem WHERE l_returnflag = 'A' UNION ALL "
        f"SELECT 's' || {_TEXT_KEY}, 1000000000 + l_suppkey, 'ab', 'ab_sole_source', "
        f"'{{\"id\": \"' || {_TEXT_KEY} || '\"}}', l_orderkey FROM lineitem WHERE l_returnflag = 'N'"
    ),
    "entity_source_links": (
        "SELECT r.id, r.entity_id, r.source_schema, r.source_table, r.source_pk, "
        "CASE WHEN r.k % 5 = 0 THEN NULL WHEN r.k % 5 = 1 THEN n.plain_name || ' DBA Local Office' "
        "WHEN r.k % 5 = 2 THEN n.plain_name || ', Limited' ELSE n.plain_name END AS source_name, "
        "CASE WHEN r.k % 2 = 0 THEN 'exact' ELSE 'reviewed' END AS match_method, "
        "CASE WHEN r.k % 3 = 0 THEN CAST(NULL AS DOUBLE) WHEN r.k % 3 = 1 THEN CAST(0.0 AS DOUBLE) "
        "ELSE CAST(0.97 AS DOUBLE) END AS match_confidence "
        "FROM raw_links r JOIN entity_named n ON n.id = r.entity_id"
    ),
    # Lobbyists, office holders and directors come from the same short lists of names.
    "lobby_registrations": (
        f"SELECT 'R' || CAST(k AS STRING) AS registration_id, {_DIRECTOR_NAME}, CAST(100000001 + o_custkey AS STRING) || 'RR0001' AS client_bn, "
        "o_orderpriority AS department, CAST(o_orderdate AS DATE) AS filed_on FROM (SELECT *, o_orderkey AS k FROM orders WHERE o_orderkey % 3 = 1) r"
    ),
    "lobby_contacts": (
        f"SELECT 'C' || {_TEXT_KEY} AS contact_id, {_DIRECTOR_NAME}, CAST(200000001 + l_suppkey AS STRING) || 'RR0001' AS client_bn, "
        "o_orderpriority AS department, CAST(l_shipdate AS DATE) AS contacted_on "
        "FROM (SELECT *, l_orderkey AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey % 4 = 3) r"
    ),
    "former_offices": (
        f"SELECT {_DIRECTOR_NAME}, o_orderpriority AS department, CAST(o_orderdate AS DATE) AS ended_on "
        "FROM (SELECT *, o_orderkey AS k FROM orders WHERE o_orderkey % 5 = 2) r"
    ),
    "department_awards": (
        f"SELECT {_TEXT_KEY} AS award_id, CAST(200000001 + l_suppkey AS STRING) || 'RR0001' AS vendor_bn, o_orderpriority AS department, "
        "CAST(l_shipdate AS DATE) AS awarded_on, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, "
        "CASE WHEN l_linenumber % 3 = 0 THEN CAST(NULL AS STRING) ELSE 'exclusive rights' END AS sole_source_reason "
        "FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'N' AND l_orderkey % 4 <> 3"
    ),
    # Pairs of neighbouring records under review, and two rounds of decisions on them.
    "review_candidates": (
        "SELECT 'c' || CAST(a.id AS STRING) AS candidate_id, a.id AS entity_id_l, b.id AS entity_id_r, "
        "a.canonical_name AS legal_name_l, b.canonical_name AS legal_name_r, "
        "coalesce(a.source_link_count, 0) AS source_count_l, coalesce(b.source_link_count, 0) AS source_count_r, "
        "CAST(a.id % 97 + 4 AS DOUBLE) / 100 AS match_probability "
        "FROM golden_text a JOIN golden_text b ON b.id = a.id + 1 WHERE a.id % 10 IN (2, 4)"
    ),
    "review_decisions": (
        "SELECT candidate_id, CASE WHEN entity_id_l % 4 = 0 THEN 'different' ELSE 'same' END AS status, "
        "'first' AS reviewed_by, 'round one' AS review_note, CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS reviewed_at "
        "FROM review_candidates WHERE entity_id_l % 7 <> 3 UNION ALL "
        "SELECT candidate_id, CASE WHEN entity_id_l % 3 = 0 THEN 'needs_review' ELSE 'same' END, 'second', "
        "'round two', CAST('2024-02-01 00:00:00' AS TIMESTAMP) FROM review_candidates WHERE entity_id_l % 3 <> 1"
    ),
    # One open-data feed row per event; every 29th lacks its id and every 31st has a broken amount.
    "feed_rows": (
        "SELECT e.event_id AS seq, CASE WHEN e.event_type IN ('purchase', 'view') THEN 'fed_grants' "
        "WHEN e.event_type = 'click' THEN 'cra_t3010' ELSE 'cra_donees' END AS source, "
        "'b' || CAST(e.event_id % 4 AS STRING) AS batch_id, "
        "CASE WHEN e.event_id % 29 = 0 THEN ' ' WHEN e.event_id % 37 = 5 THEN CAST(e.event_id - 5 AS STRING) "
        "ELSE CAST(e.event_id AS STRING) END AS ext_id, "
        "CASE WHEN e.event_id % 3 = 0 THEN g.canonical_name ELSE 'Unlisted Group ' || CAST(e.event_id AS STRING) END AS legal_name, "
        "CASE WHEN e.event_id % 2 = 0 THEN substring(n.bn_root, 1, 5) || ' ' || substring(n.bn_root, 6, 4) || 'RR0001' "
        "WHEN e.event_id % 7 = 1 THEN '' END AS org_bn, "
        "CASE WHEN e.event_id % 31 = 0 THEN 'n/a' WHEN e.event_id % 41 = 0 THEN '' "
        "ELSE CAST(CAST(e.value * 10000 AS DECIMAL(18,0)) AS STRING) END AS amount_text, "
        "CASE WHEN e.event_id % 6 = 0 THEN CAST(100000001 + e.user_id AS STRING) END AS donee_bn "
        "FROM events e LEFT JOIN entity_named n ON n.id = e.user_id * 10 + 2 "
        "LEFT JOIN golden_text g ON g.id = e.user_id * 10 + 2"
    ),
}


_INNER = {
    "entity_seed",
    "entity_named",
    "golden_text",
    "cra_filings",
    "raw_links",
    "feed_rows",
    "review_candidates",
    "review_decisions",
}
_PLANS: dict[tuple[str, str], dict[str, DataFrame]] = {}
_WAREHOUSES: dict[tuple, Warehouse] = {}


def derived(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All derived tables as lazy plans over the parquet files in ``sf_dir``."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _PLANS:
        return _PLANS[key]
    for name in BASE_TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    frames: dict[str, DataFrame] = {}
    for name, text in DERIVED.items():
        frames[name] = spark.sql(text)
        frames[name].createOrReplaceTempView(name)
    frames["entity_golden_records"] = frames["golden_text"].withColumns(
        {
            "bn_variants": F.split("bn_variants_csv", ","),
            "dataset_sources": F.split("dataset_sources_csv", ","),
        }
    )
    _PLANS[key] = frames
    return frames


def derived_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: df for name, df in derived(spark, sf_dir).items() if name not in _INNER}


def warehouse(
    spark: SparkSession,
    sf_dir: str,
    min_edge_amount: float = 90_000,
    max_hops: int = 6,
) -> Warehouse:
    """Demo warehouse; the loop tables are detected in the gift graph on first use."""
    from fundtrace.operators import cycles

    key = (spark.sparkContext.applicationId, sf_dir, min_edge_amount, max_hops)
    if key in _WAREHOUSES:
        return _WAREHOUSES[key]
    base = Warehouse(spark, derived_tables(spark, sf_dir))
    found: dict[str, DataFrame] = {}

    def loop_table(name: str):
        def build() -> DataFrame:
            if not found:
                found.update(cycles.detect(base.gifts, min_edge_amount, max_hops=max_hops))
            return found[name]

        return build

    _WAREHOUSES[key] = base.with_tables(
        **{name: loop_table(name) for name in ("loops", "loop_edges", "loop_participants")}
    )
    return _WAREHOUSES[key]


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed rows in source shape, with the source and batch they arrived in."""
    rows = derived(spark, sf_dir)["feed_rows"]
    fed, t3010, donees = (F.col("source") == s for s in ("fed_grants", "cra_t3010", "cra_donees"))
    return rows.select(
        "seq",
        "source",
        "batch_id",
        F.col("ext_id").alias("_id"),
        F.when(fed, F.col("legal_name")).alias("recipient_legal_name"),
        F.when(fed, F.col("org_bn")).alias("recipient_business_number"),
        F.when(fed, F.col("amount_text")).alias("agreement_value"),
        F.when(t3010 | donees, F.col("org_bn")).alias("BN"),
        F.when(donees, F.col("donee_bn")).alias("Donee BN"),
        F.when(donees, F.col("legal_name")).alias("Donee Name"),
        F.when(donees, F.col("amount_text")).alias("Total Gifts"),
    )
