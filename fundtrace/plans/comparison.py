"""DuckDB SQL for the registered queries, written from the query definitions.

A statement names tables and the shared expressions below; ``statement`` puts the ones it needs in
front of it as common table expressions.
"""

from __future__ import annotations

import re

from fundtrace.plans import catalog
from fundtrace.sources import demo


def _norm(first: str, last: str) -> str:
    return (
        "array_to_string(list_sort(list_distinct(list_filter(string_split(regexp_replace("
        f"lower(coalesce({first}, '') || ' ' || coalesce({last}, '')), '[^a-z ]', '', 'g'), ' '), "
        "lambda t: length(t) > 1))), ' ')"
    )


def _name(value: str) -> str:
    tidy = (
        f"trim(regexp_replace(regexp_replace(lower({value}), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g'))"
    )
    return f"CASE WHEN length({tidy}) >= 3 THEN {tidy} END"


def _bn(value: str) -> str:
    digits = f"regexp_replace({value}, '[^0-9]', '', 'g')"
    return f"CASE WHEN length({digits}) >= 9 THEN left({digits}, 9) END"


def _root(value: str) -> str:
    # Written out here, so that a slip in the library's own list shows.
    bad = (
        "'000000000', '100000000', '200000000', '300000000', '400000000', '500000000', '600000000', "
        "'700000000', '800000000', '900000000', '320000000'"
    )
    return f"CASE WHEN {_bn(value)} NOT IN ({bad}) AND NOT ends_with({_bn(value)}, '00000000') THEN {_bn(value)} END"


_TRADE = (
    r"(?i)\s*\b(?:ASSUMED(?:\s+NAME(?:\s+.*)?)?|(?:AKA|O\s*/\s*A|D\s*/\s*B\s*/\s*A|DBA|DOING\s+BUSINESS\s+AS|OPERATING\s+AS|"
    r"TRADING\s+AS|TRADE\s+NAME\s+OF|FORMERLY|F\s*/\s*K\s*/\s*A)(?:\s+.*)?)$"
)
_LEGAL = r"(?i)(?:[\s,.\-]*\b(?:INCORPORATED|INC|LTD|LIMITED|CORP|CORPORATION|CO|COMPANY|SOCIETY|FOUNDATION)[\s,.\-]*)+$"


def _clean(value: str) -> str:
    first = value
    for sep in (" / ", "│", " | ", " │ "):
        first = f"CASE WHEN contains({value}, '{sep}') THEN trim(split_part({value}, '{sep}', 1)) ELSE {first} END"
    text = f"trim(regexp_replace({first}, '{_TRADE}', '', 'g'))"
    edge = r"^[ ,.\-]+|[ ,.\-]+$"
    text = f"regexp_replace({text}, '{edge}', '', 'g')"
    text = f"regexp_replace({text}, '{_LEGAL}', '', 'g')"
    text = f"regexp_replace({text}, '{edge}', '', 'g')"
    return f"coalesce(upper(trim(regexp_replace({text}, '\\s+', ' ', 'g'))), '')"


def _level(a: str, b: str) -> str:
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN -1 WHEN {a} = {b} THEN 1 ELSE 0 END"


_RID = "concat_ws('|', {a}.bn, CAST({a}.fpe AS VARCHAR), CAST({a}.sequence_number AS VARCHAR))"
_LARGE = (
    "contains(lower(n), 'salvation army') OR contains(lower(n), 'red cross') OR contains(lower(n), 'united way') OR "
    "contains(lower(n), 'toronto foundation') OR contains(lower(n), 'vancouver foundation') OR contains(lower(n), 'chimp') OR "
    "contains(lower(n), 'charitable impact foundation') OR contains(lower(n), 'community foundation') OR "
    "contains(lower(n), 'canada foundation') OR contains(lower(n), 'community chest')"
)
_PRESENT = "coalesce(trim(concat_ws(' ', first_name, initials, last_name)), '') <> ''"
_MONEY = "'authoritative' AS mapping_method, CAST(1.0 AS DOUBLE) AS confidence_score"
_EDGE = (
    "from_entity_id, to_entity_id, CAST(amount AS DOUBLE) AS amount, CAST(date AS VARCHAR) AS date, "
    "source, source_row_id, mapping_method, confidence_score"
)


def _public(table: str, cast: str, amount: str, date: str, source: str, row_id: str, key: str, schema: str) -> str:
    return (
        f"SELECT CAST(NULL AS BIGINT) AS from_entity_id, l.entity_id AS to_entity_id, {amount} AS amount, "
        f"{date} AS date, {source} AS source, CAST({row_id} AS VARCHAR) AS source_row_id, "
        "l.match_method AS mapping_method, coalesce(l.match_confidence, 1.0) AS confidence_score "
        f"FROM entity_source_links l JOIN {table} x ON x.{key} = TRY_CAST(json_extract_string(l.source_pk, '$.{key}') AS {cast}) "
        f"WHERE l.source_schema = '{schema}' AND l.source_table = '{'grants_contributions' if schema == 'fed' else table}' AND {amount} > 0"
    )


def _score(amount: str, shared: str) -> str:
    return (
        f"round(least(0.4 + CASE WHEN {amount} >= 1000000 THEN 0.3 WHEN {amount} >= 500000 THEN 0.2 "
        f"WHEN {amount} >= 100000 THEN 0.1 ELSE 0.0 END + CASE WHEN {shared} THEN 0.3 ELSE 0.0 END, 1.0)::DOUBLE, 10)"
    )


def _list(items: str, order: str) -> str:
    return f"array_to_string(list(CAST({items} AS VARCHAR) ORDER BY {order}), ',')"


_ROUND = _score("total_amount", "shared")
_FLAG1 = "Round-trip funding (CRA-confirmed)"
_FLAG2 = "Director controls multiple funded entities"

# Shared expressions, in dependency order, after the derived tables.
SHARED: dict[str, str] = {
    "entity_golden_records": (
        "SELECT *, string_split(dataset_sources_csv, ',') AS dataset_sources, "
        "string_split(bn_variants_csv, ',') AS bn_variants FROM golden_text"
    ),
    "active": "SELECT * FROM entity_golden_records WHERE status = 'active'",
    "funded": "SELECT DISTINCT entity_id FROM entity_source_links WHERE source_schema IN ('fed', 'ab')",
    "filings": (
        f"SELECT left(bn, 9) AS root, {_norm('first_name', 'last_name')} AS nm, year(fpe) AS yr, "
        f"{_RID.format(a='d')} AS rid FROM cra_directors d WHERE {_PRESENT}"
    ),
    "org_directors": (
        "SELECT DISTINCT e.id AS entity_id, f.nm AS director_name_normalized, CAST(f.yr AS BIGINT) AS t3010_year, "
        "f.rid AS source_row_id FROM filings f JOIN entity_golden_records e ON e.bn_root = f.root"
    ),
    "funded_directors": (
        "SELECT DISTINCT f.nm, e.id AS entity_id, e.bn_root FROM filings f JOIN active e ON e.bn_root = f.root "
        "WHERE e.id IN (SELECT entity_id FROM funded)"
    ),
    "shared_names": (
        "SELECT nm AS director_name_normalized, count(DISTINCT entity_id) AS org_count FROM funded_directors "
        "GROUP BY 1 HAVING count(DISTINCT entity_id) >= 3 ORDER BY org_count DESC, 1 LIMIT 5000"
    ),
    "current_grants": (
        "SELECT * FROM grants_contributions QUALIFY row_number() OVER (PARTITION BY ref_number "
        "ORDER BY amendment_number DESC NULLS LAST, _id) = 1"
    ),
    "gift_rows": (
        f"SELECT left(q.bn, 9) AS s, left(q.donee_bn, 9) AS d, q.total_gifts AS amount, q.fpe AS date, "
        f"{_RID.format(a='q')} AS source_row_id FROM cra_qualified_donees q "
        "WHERE q.total_gifts > 0 AND q.donee_bn IS NOT NULL"
    ),
    "public_edges": " UNION ALL ".join(
        [
            _public(
                "current_grants", "BIGINT", "x.agreement_value", "x.agreement_start_date",
                "CASE WHEN x.agreement_type = 'C' THEN 'fed_contribution' ELSE 'fed_grant' END",
                "x._id", "_id", "fed",
            ),
            _public("ab_grants", "BIGINT", "x.amount", "x.payment_date", "'ab_grant'", "x.id", "id", "ab"),
            _public("ab_contracts", "VARCHAR", "x.amount", "CAST(NULL AS DATE)", "'ab_contract'", "x.id", "id", "ab"),
            _public("ab_sole_source", "VARCHAR", "x.amount", "x.start_date", "'ab_sole_source'", "x.id", "id", "ab"),
        ]
    ),
    "out_edges": (
        f"SELECT a.id AS from_entity_id, b.id AS to_entity_id, g.amount, g.date, 'cra_gift' AS source, g.source_row_id, {_MONEY} "
        "FROM entity_golden_records a JOIN gift_rows g ON g.s = a.bn_root LEFT JOIN entity_golden_records b ON g.d = b.bn_root"
    ),
    "in_edges": (
        f"SELECT a.id AS from_entity_id, b.id AS to_entity_id, g.amount, g.date, 'cra_gift' AS source, g.source_row_id, {_MONEY} "
        "FROM entity_golden_records b JOIN gift_rows g ON g.d = b.bn_root LEFT JOIN entity_golden_records a ON g.s = a.bn_root"
    ),
    "copies": (
        "SELECT from_entity_id AS entity_id, 'out' AS role, * FROM out_edges UNION ALL "
        "SELECT to_entity_id, 'in', * FROM in_edges UNION ALL SELECT to_entity_id, 'in', * FROM public_edges"
    ),
    "money": (
        "SELECT * FROM out_edges UNION ALL SELECT * FROM in_edges WHERE from_entity_id IS NULL "
        "UNION ALL SELECT * FROM public_edges"
    ),
    "gift_graph": (
        "SELECT s AS src, d AS dst, CAST(sum(amount) AS DECIMAL(28,2)) AS amt, min(year(date)) AS y0, max(year(date)) AS y1 "
        "FROM gift_rows WHERE s <> d GROUP BY 1, 2 HAVING sum(amount) >= 90000"
    ),
    "walk": (
        "SELECT src AS start, dst AS here, [src, dst] AS path, amt AS flow, amt AS low, y0, y1 FROM gift_graph WHERE dst > src "
        "UNION ALL SELECT w.start, g.dst, list_append(w.path, g.dst), CAST(w.flow + g.amt AS DECIMAL(28,2)), least(w.low, g.amt), "
        "least(w.y0, g.y0), greatest(w.y1, g.y1) FROM walk w JOIN gift_graph g ON g.src = w.here "
        "WHERE g.dst > w.start AND NOT list_contains(w.path, g.dst) AND len(w.path) < 6"
    ),
    "loops": (
        "SELECT array_to_string(w.path, '-') AS id, w.path AS path_bns, len(w.path) AS hops, "
        "CAST(w.flow + g.amt AS DECIMAL(28,2)) AS total_flow, least(w.low, g.amt) AS bottleneck_amt, "
        "least(w.y0, g.y0) AS min_year, greatest(w.y1, g.y1) AS max_year "
        "FROM walk w JOIN gift_graph g ON g.src = w.here AND g.dst = w.start"
    ),
    "loop_pairs": (
        "SELECT id AS cycle_id, o AS edge_order, path_bns[o] AS src_bn, path_bns[o % len(path_bns) + 1] AS dst_bn "
        "FROM (SELECT id, path_bns, unnest(range(1, len(path_bns) + 1)) AS o FROM loops)"
    ),
    "loop_edges": (
        "SELECT DISTINCT g.src, g.dst, g.amt AS total_amt, g.y0 AS min_year, g.y1 AS max_year "
        "FROM gift_graph g JOIN loop_pairs p ON p.src_bn = g.src AND p.dst_bn = g.dst"
    ),
    "loop_participants": "SELECT DISTINCT unnest(path_bns) AS bn FROM loops",
    "headers": (
        "SELECT id AS cycle_id, CAST(total_flow AS DOUBLE) AS total_amount, hops AS hop_count, min_year, max_year, path_bns "
        "FROM loops WHERE hops BETWEEN 2 AND 6 ORDER BY total_flow DESC, id LIMIT 5000"
    ),
    "header_members": (
        "SELECT h.cycle_id, h.o, e.id AS entity_id FROM (SELECT cycle_id, unnest(range(1, len(path_bns) + 1)) AS o, "
        "unnest(path_bns) AS bn FROM headers) h JOIN active e ON e.bn_root = h.bn"
    ),
    "cycle_lists": (
        "SELECT h.cycle_id, h.total_amount, h.hop_count, h.min_year, h.max_year, "
        "coalesce(m.ids, CAST([] AS BIGINT[])) AS ids FROM headers h LEFT JOIN ("
        "SELECT cycle_id, list(entity_id ORDER BY o, entity_id) AS ids FROM header_members GROUP BY 1) m USING (cycle_id)"
    ),
    "cycle_edge_rows": (
        "SELECT a.id AS from_entity_id, b.id AS to_entity_id, p.cycle_id, p.edge_order, p.src_bn, p.dst_bn, "
        "CAST(coalesce(l.total_amt, 0) AS DOUBLE) AS amount, coalesce(CAST(l.max_year AS VARCHAR), CAST(l.min_year AS VARCHAR), '') AS date, "
        f"'cra_gift' AS source, p.cycle_id || '|' || p.edge_order AS source_row_id, {_MONEY} FROM loop_pairs p "
        "JOIN active a ON a.bn_root = p.src_bn JOIN active b ON b.bn_root = p.dst_bn "
        "LEFT JOIN loop_edges l ON l.src = p.src_bn AND l.dst = p.dst_bn"
    ),
    "pair_totals": (
        "SELECT least(a.id, b.id) AS entity_id_a, greatest(a.id, b.id) AS entity_id_b, sum(g.amount) AS total, "
        "min(g.source_row_id) AS source_row_id, count(*) AS gift_count FROM gift_rows g "
        "JOIN entity_golden_records a ON g.s = a.bn_root JOIN entity_golden_records b ON g.d = b.bn_root "
        "WHERE a.id <> b.id GROUP BY 1, 2"
    ),
    "director_pairs": (
        "SELECT DISTINCT da.director_name_normalized, p.entity_id_a, p.entity_id_b, CAST(p.total AS DOUBLE) AS total_amount, "
        "p.source_row_id, p.gift_count FROM pair_totals p JOIN org_directors da ON da.entity_id = p.entity_id_a "
        "JOIN org_directors db ON db.entity_id = p.entity_id_b AND db.director_name_normalized = da.director_name_normalized "
        "WHERE length(da.director_name_normalized) > 4"
    ),
    "pair_table": (
        "SELECT p.*, coalesce(a.canonical_name, 'Entity ' || p.entity_id_a) AS name_a, "
        "coalesce(b.canonical_name, 'Entity ' || p.entity_id_b) AS name_b FROM (SELECT * FROM director_pairs "
        "WHERE total_amount >= 100000 ORDER BY total_amount DESC, entity_id_a, entity_id_b, director_name_normalized LIMIT 200) p "
        "LEFT JOIN entity_golden_records a ON a.id = p.entity_id_a LEFT JOIN entity_golden_records b ON b.id = p.entity_id_b"
    ),
    # Rings.
    "head_rings": (
        "SELECT 'cra-cycle-' || cycle_id AS ring_id, ids, total_amount FROM (SELECT * FROM cycle_lists "
        "ORDER BY total_amount DESC, cycle_id LIMIT 200) WHERE len(ids) >= 2 AND total_amount >= 50000"
    ),
    "head_rows": "SELECT ring_id, unnest(range(1, len(ids) + 1)) AS o, unnest(ids) AS entity_id FROM head_rings",
    "head_names": (
        "SELECT r.ring_id, list(coalesce(e.canonical_name, CAST(r.entity_id AS VARCHAR)) ORDER BY r.o) AS nms "
        "FROM head_rows r LEFT JOIN entity_golden_records e ON e.id = r.entity_id GROUP BY 1"
    ),
    "head_shared": (
        "SELECT ring_id, list(nm ORDER BY nm) AS persons FROM (SELECT r.ring_id, d.director_name_normalized AS nm "
        "FROM (SELECT DISTINCT ring_id, entity_id FROM head_rows) r JOIN (SELECT DISTINCT entity_id, director_name_normalized "
        "FROM org_directors WHERE director_name_normalized <> '') d USING (entity_id) GROUP BY 1, 2 "
        "HAVING count(*) = (SELECT count(DISTINCT entity_id) FROM head_rows x WHERE x.ring_id = r.ring_id)) GROUP BY 1"
    ),
    "all_rings": (
        "SELECT h.ring_id, 'round_trip' AS ring_type, h.ids, n.nms, coalesce(s.persons, CAST([] AS VARCHAR[])) AS persons, "
        f"h.total_amount, '{_FLAG1}' AS flags, 'cra_gift' AS ev_source, substring(h.ring_id, 11) AS ev_row FROM head_rings h "
        "JOIN head_names n USING (ring_id) LEFT JOIN head_shared s USING (ring_id) UNION ALL "
        "SELECT 'director-pair-' || replace(director_name_normalized, ' ', '-') || '-' || entity_id_a || '-' || entity_id_b, "
        "'shared_director', [entity_id_a, entity_id_b], [name_a, name_b], [director_name_normalized], total_amount, "
        f"'{_FLAG2}', 'cra_director_funding', source_row_id FROM pair_table WHERE total_amount >= 50000"
    ),
    "party_rings": (
        "SELECT * FROM (SELECT * FROM all_rings QUALIFY row_number() OVER (PARTITION BY list_sort(ids) "
        "ORDER BY total_amount DESC, ring_type, ring_id) = 1) "
        f"WHERE len(list_filter(nms, lambda n: {_LARGE})) < len(nms)"
    ),
    "party_rows": "SELECT DISTINCT ring_id, unnest(ids) AS entity_id FROM party_rings",
    "party_gifts": (
        f"SELECT a.id AS from_entity_id, b.id AS to_entity_id, g.amount, g.date, 'cra_gift' AS source, g.source_row_id, {_MONEY} "
        "FROM gift_rows g JOIN entity_golden_records a ON g.s = a.bn_root JOIN entity_golden_records b ON g.d = b.bn_root "
        "WHERE a.id IN (SELECT entity_id FROM party_rows) AND b.id IN (SELECT entity_id FROM party_rows) AND a.id <> b.id "
        "ORDER BY g.amount DESC, g.source_row_id, a.id, b.id LIMIT 2000"
    ),
    "ranked_rings": (
        f"SELECT *, {_score('total_amount', 'len(persons) > 0')} AS total_score FROM party_rings "
        "ORDER BY total_score DESC, total_amount DESC, ring_id LIMIT 20"
    ),
    "warm_heads": (
        "SELECT 'cra-cycle-' || cycle_id AS ring_id, ids, total_amount FROM (SELECT * FROM cycle_lists "
        "ORDER BY total_amount DESC, cycle_id LIMIT 80) WHERE len(ids) >= 2"
    ),
    "warm_rows": "SELECT ring_id, unnest(range(1, len(ids) + 1)) AS o, unnest(ids) AS entity_id FROM warm_heads",
    "warm_names": (
        "SELECT r.ring_id, list(coalesce(e.canonical_name, 'Entity ' || r.entity_id) ORDER BY r.o) AS nms "
        "FROM warm_rows r LEFT JOIN entity_golden_records e ON e.id = r.entity_id GROUP BY 1"
    ),
    "long_names": (
        "SELECT DISTINCT entity_id, director_name_normalized FROM org_directors WHERE length(director_name_normalized) > 4"
    ),
    "warm_shared": (
        "SELECT ring_id, list(nm ORDER BY nm) AS persons FROM (SELECT r.ring_id, d.director_name_normalized AS nm FROM warm_rows r "
        "JOIN long_names d USING (entity_id) GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1"
    ),
    "warm": (
        "SELECT h.ring_id, 'round_trip' AS ring_type, h.ids, n.nms, coalesce(s.persons, CAST([] AS VARCHAR[])) AS persons, "
        f"h.total_amount, '{_FLAG1}' || CASE WHEN s.persons IS NULL THEN '' ELSE ',{_FLAG2}' END AS flags, "
        f"{_score('h.total_amount', 's.persons IS NOT NULL')} AS total_score FROM warm_heads h JOIN warm_names n USING (ring_id) "
        f"LEFT JOIN warm_shared s USING (ring_id) WHERE len(list_filter(nms, lambda n: {_LARGE})) < len(nms) "
        "ORDER BY s.persons IS NOT NULL DESC, total_amount DESC, ring_id LIMIT 30"
    ),
    # Graph.
    "director_edges": (
        "SELECT DISTINCT 'person:' || director_name_normalized AS src, CAST(entity_id AS VARCHAR) AS dst, 'cra_director' AS source, "
        "CAST(0.0 AS DOUBLE) AS amount, CAST(t3010_year AS VARCHAR) AS date, 'authoritative' AS mapping_method, "
        "CAST(1.0 AS DOUBLE) AS confidence_score, source_row_id, entity_id FROM org_directors WHERE director_name_normalized <> ''"
    ),
    "money_graph": (
        "SELECT DISTINCT coalesce(CAST(from_entity_id AS VARCHAR), 'source:' || source || ':' || source_row_id) AS src, "
        "CAST(to_entity_id AS VARCHAR) AS dst, source, CAST(amount AS DOUBLE) AS amount, coalesce(CAST(date AS VARCHAR), '') AS date, "
        "mapping_method, CASE WHEN confidence_score = 0 THEN 1.0 ELSE confidence_score END AS confidence_score, source_row_id, "
        "from_entity_id, to_entity_id FROM money WHERE to_entity_id IS NOT NULL"
    ),
    "graph": (
        "SELECT src, dst, source, amount, date, mapping_method, confidence_score, source_row_id FROM director_edges UNION "
        "SELECT src, dst, source, amount, date, mapping_method, confidence_score, source_row_id FROM money_graph"
    ),
    "nodes": (
        "SELECT CAST(id AS VARCHAR) AS node_id, canonical_name, coalesce(entity_type, 'unknown') AS entity_type, "
        "array_to_string(dataset_sources, ',') AS datasets FROM entity_golden_records UNION ALL "
        "SELECT DISTINCT src, substring(src, 8), 'person', 'cra' FROM director_edges UNION ALL "
        "SELECT DISTINCT src, array_to_string(list_transform(string_split(source, '_'), lambda w: upper(w[1]) || w[2:]), ' '), "
        "'gov', split_part(source, '_', 1) FROM money_graph WHERE from_entity_id IS NULL"
    ),
    # Crossover.
    "simple_names": (
        "SELECT DISTINCT left(bn, 9) AS root, lower(trim(concat_ws(' ', first_name, last_name))) AS director_norm FROM cra_directors"
    ),
    "contractors": (
        "SELECT entity_id AS contractor_entity_id, CAST(sum(amount) AS DOUBLE) AS total_contract_amount, max(k) AS contract_source FROM ("
        "SELECT l.entity_id, x.amount, 'ab_contract' AS k FROM entity_source_links l JOIN ab_contracts x ON x.id = json_extract_string(l.source_pk, '$.id') "
        "WHERE l.source_table = 'ab_contracts' AND x.amount > 0 UNION ALL "
        "SELECT l.entity_id, x.amount, 'ab_sole_source' FROM entity_source_links l JOIN ab_sole_source x ON x.id = json_extract_string(l.source_pk, '$.id') "
        "WHERE l.source_table = 'ab_sole_source' AND x.amount > 0) GROUP BY 1 HAVING sum(amount) >= 10000"
    ),
    "contractor_people": (
        "SELECT DISTINCT c.*, n.director_norm FROM contractors c JOIN entity_golden_records e ON e.id = c.contractor_entity_id "
        "JOIN simple_names n ON n.root = e.bn_root WHERE length(n.director_norm) >= 5"
    ),
    "charity_people": (
        "SELECT DISTINCT g.*, n.director_norm FROM (SELECT l.entity_id AS charity_entity_id, CAST(sum(x.agreement_value) AS DOUBLE) AS total_grant_amount "
        "FROM entity_source_links l JOIN grants_contributions x ON x._id = CAST(json_extract_string(l.source_pk, '$._id') AS BIGINT) "
        "WHERE l.source_schema = 'fed' AND x.agreement_value > 0 GROUP BY 1 HAVING sum(x.agreement_value) >= 25000) g "
        "JOIN entity_golden_records e ON e.id = g.charity_entity_id JOIN simple_names n ON n.root = e.bn_root "
        "WHERE n.director_norm IN (SELECT director_norm FROM contractor_people)"
    ),
    "cross_pairs": (
        "SELECT c.charity_entity_id, k.contractor_entity_id, list(DISTINCT k.director_norm ORDER BY k.director_norm) AS people, "
        "max(c.total_grant_amount) AS total_grant_amount, max(k.total_contract_amount) AS total_contract_amount, max(k.contract_source) AS contract_source "
        "FROM contractor_people k JOIN charity_people c USING (director_norm) WHERE c.charity_entity_id <> k.contractor_entity_id GROUP BY 1, 2 "
        "ORDER BY total_contract_amount DESC, total_grant_amount DESC, 1, 2 LIMIT 200"
    ),
    "crossover": (
        "SELECT p.*, coalesce(a.canonical_name, 'Entity ' || p.charity_entity_id) AS charity_name, "
        "coalesce(b.canonical_name, 'Entity ' || p.contractor_entity_id) AS contractor_name FROM cross_pairs p "
        "LEFT JOIN entity_golden_records a ON a.id = p.charity_entity_id LEFT JOIN entity_golden_records b ON b.id = p.contractor_entity_id"
    ),
    # Rules and scores.
    "dept_shares": (
        "SELECT entity_id, amount, sum(amount) OVER (PARTITION BY entity_id) AS total FROM (SELECT l.entity_id, x.owner_org, "
        "CAST(sum(x.agreement_value) AS DOUBLE) AS amount FROM entity_source_links l JOIN current_grants x "
        "ON x._id = CAST(json_extract_string(l.source_pk, '$._id') AS BIGINT) WHERE l.source_schema = 'fed' AND x.agreement_value > 0 GROUP BY 1, 2)"
    ),
    "concentration": (
        "SELECT e.id AS entity_id, coalesce(s.hhi, 0) AS hhi_score, coalesce(s.n, 0) AS dept_count, coalesce(s.t, 0) AS top_dept_share "
        "FROM entity_golden_records e LEFT JOIN (SELECT entity_id, sum(power(amount / total, 2)) AS hhi, count(*) AS n, max(amount / total) AS t "
        "FROM dept_shares GROUP BY 1) s ON s.entity_id = e.id"
    ),
    "sole_source": (
        "SELECT l.entity_id, x.vendor AS vendor_name, count(*) AS contract_count, CAST(coalesce(sum(x.amount), 0) AS DOUBLE) AS total_amount, "
        "count(*) >= 2 AS repeat_vendor_flag, count(*) FILTER (WHERE x.amount BETWEEN 9000 AND 100000) >= 2 AS splitting_flag "
        "FROM entity_source_links l JOIN ab_sole_source x ON x.id = json_extract_string(l.source_pk, '$.id') "
        "WHERE l.source_table = 'ab_sole_source' GROUP BY 1, 2"
    ),
    "related": (
        "SELECT e.id AS entity_id, CAST(coalesce(r->>'$.entity_id', r->>'$.id') AS BIGINT) AS related_entity_id, "
        "coalesce(r->>'$.relationship_type', r->>'$.type', 'RELATED') AS relationship_type, "
        "coalesce(CAST(r->>'$.confidence_score' AS DOUBLE), CAST(r->>'$.confidence' AS DOUBLE), 1.0) AS confidence_score "
        "FROM (SELECT id, unnest(from_json(related_entities, '[\"JSON\"]')) AS r FROM entity_golden_records) e"
    ),
    "ru1": "SELECT entity_id, 'fed_concentration' AS source, CAST(entity_id AS VARCHAR) AS source_row_id, CAST(NULL AS VARCHAR) AS mapping_method, CAST(NULL AS DOUBLE) AS confidence_score FROM concentration WHERE hhi_score > 0.5",
    "ru2": f"SELECT DISTINCT entity_id, 'cra_cycle' AS source, cycle_id AS source_row_id, {_MONEY} FROM header_members",
    "ru3": f"SELECT d.entity_id, 'cra_director' AS source, d.source_row_id, {_MONEY} FROM org_directors d JOIN shared_names USING (director_name_normalized)",
    "ru4": f"SELECT entity_id, 'ab_sole_source' AS source, CAST(entity_id AS VARCHAR) AS source_row_id, {_MONEY} FROM sole_source WHERE repeat_vendor_flag OR splitting_flag",
    "ru5": (
        "SELECT c.entity_id, c.source, c.source_row_id, c.mapping_method, c.confidence_score FROM copies c WHERE EXISTS ("
        "SELECT 1 FROM related r WHERE r.entity_id = c.entity_id AND (r.related_entity_id = c.from_entity_id OR r.related_entity_id = c.to_entity_id))"
    ),
    "evidence": " UNION ALL ".join(
        f"SELECT entity_id, '{rule}' AS rule, {i} AS rule_order, {w} AS weight, '{label}' AS label, source, source_row_id, mapping_method, confidence_score FROM ru{i}"
        for rule, i, w, label in (
            ("funding_concentration", 1, 0.30, "Concentrated funding sources"),
            ("cycle_member", 2, 0.40, _FLAG1),
            ("shared_director", 3, 0.30, _FLAG2),
            ("sole_source", 4, 0.35, "Sole-source pattern"),
            ("related_entity", 5, 0.25, "Funding flows to related entity"),
        )
    ),
    # Linkage.
    "address_parts": (
        "SELECT id, o, a->>'$.city' AS c1, a->>'$.City' AS c2, a->>'$.province' AS p, a->>'$.postal_code' AS z FROM ("
        "SELECT id, unnest(from_json(addresses, '[\"JSON\"]')) AS a, unnest(range(1, 1 + CAST(json_array_length(addresses) AS BIGINT))) AS o "
        "FROM entity_golden_records WHERE addresses IS NOT NULL)"
    ),
    "address_fields": (
        "SELECT e.id, upper(trim((SELECT arg_min(coalesce(c1, c2), o) FROM address_parts x WHERE x.id = e.id AND coalesce(c1, c2) IS NOT NULL))) AS city, "
        "upper(trim((SELECT arg_min(p, o) FROM address_parts x WHERE x.id = e.id AND p IS NOT NULL))) AS province, "
        "upper(trim((SELECT arg_min(z, o) FROM address_parts x WHERE x.id = e.id AND z IS NOT NULL))) AS postal FROM entity_golden_records e"
    ),
    "alias_items": (
        "SELECT id, CASE WHEN json_type(a) = 'VARCHAR' THEN a->>'$' ELSE coalesce(a->>'$.name', a->>'$.alias', a->>'$.legal_name') END AS alias, "
        "CASE WHEN json_type(a) = 'VARCHAR' THEN a->>'$' END AS string_alias FROM (SELECT id, unnest(from_json(aliases, '[\"JSON\"]')) AS a FROM entity_golden_records)"
    ),
    "record_meta": (
        f"SELECT e.id AS entity_id, {_root('e.bn_root')} AS bn_root, f.city, f.province, replace(f.postal, ' ', '') AS postal_code, e.entity_type, "
        "coalesce(e.source_link_count, 0) AS source_count, e.dataset_sources_csv AS ds, e.canonical_name FROM active e JOIN address_fields f USING (id)"
    ),
    "raw_records": (
        "SELECT entity_id, bn_root, city, province, postal_code, entity_type, source_count, ds AS source_dataset, 0 AS kind, "
        "'entity:' || entity_id || ':canonical' AS record_id, canonical_name AS legal_name FROM record_meta UNION ALL "
        "SELECT m.entity_id, bn_root, city, province, postal_code, entity_type, source_count, ds, 1, "
        "'entity:' || m.entity_id || ':alias:' || left(md5(a.alias), 16), a.alias FROM record_meta m JOIN alias_items a ON a.id = m.entity_id WHERE a.alias <> '' UNION ALL "
        "SELECT m.entity_id, bn_root, city, province, postal_code, entity_type, source_count, l.source_schema || '.' || l.source_table, 2, "
        "'source_link:' || l.id, l.source_name FROM record_meta m JOIN entity_source_links l ON l.entity_id = m.entity_id WHERE l.source_name IS NOT NULL"
    ),
    "records": (
        "SELECT * EXCLUDE (kind) FROM (SELECT r.* REPLACE (trim(legal_name) AS legal_name), n.cleaned AS cleaned_name FROM raw_records r "
        f"JOIN (SELECT legal_name AS raw, {_clean('legal_name')} AS cleaned FROM (SELECT DISTINCT legal_name FROM raw_records)) n ON n.raw = r.legal_name "
        "WHERE n.cleaned <> '') QUALIFY row_number() OVER (PARTITION BY entity_id, cleaned_name, bn_root, city, province, source_dataset ORDER BY kind, record_id) = 1"
    ),
    "profiles": (
        "SELECT bn_root, cleaned_name, city, province, entity_type, count(*) AS n, concat_ws('/', coalesce(bn_root, '-'), cleaned_name, "
        "coalesce(city, '-'), coalesce(province, '-'), coalesce(entity_type, '-')) AS txt FROM records GROUP BY 1, 2, 3, 4, 5"
    ),
    "blocked": " UNION ".join(
        f"SELECT a.txt AS a, b.txt AS b FROM profiles a JOIN profiles b ON {on} AND a.txt < b.txt"
        for on in (
            "a.bn_root = b.bn_root",
            "a.cleaned_name = b.cleaned_name",
            "a.province = b.province AND left(a.cleaned_name, 5) = left(b.cleaned_name, 5)",
            "a.city = b.city AND left(a.cleaned_name, 5) = left(b.cleaned_name, 5)",
        )
    ),
    # Linkage under a model of given numbers; equality of number or name weighs by the value's own share.
    "both_profiles": (
        "SELECT p.a, p.b, x AS l, y AS r FROM (SELECT a, b FROM blocked UNION ALL SELECT txt, txt FROM profiles WHERE n > 1) p "
        "JOIN profiles x ON x.txt = p.a JOIN profiles y ON y.txt = p.b"
    ),
    "all_leveled": (
        f"SELECT a, b, l, CAST({_level('l.bn_root', 'r.bn_root')} AS INTEGER) AS g_bn_root, CAST(CASE WHEN l.cleaned_name = r.cleaned_name THEN 3 "
        "WHEN jaro_winkler_similarity(l.cleaned_name, r.cleaned_name) >= 0.92 THEN 2 WHEN jaro_winkler_similarity(l.cleaned_name, r.cleaned_name) >= 0.82 THEN 1 ELSE 0 END AS INTEGER) AS g_cleaned_name, "
        f"CAST({_level('l.city', 'r.city')} AS INTEGER) AS g_city, CAST({_level('l.province', 'r.province')} AS INTEGER) AS g_province, "
        f"CAST({_level('l.entity_type', 'r.entity_type')} AS INTEGER) AS g_entity_type FROM both_profiles"
    ),
    "leveled": "SELECT * FROM all_leveled WHERE a <> b",
    "number_share": "SELECT bn_root, sum(n) / (SELECT sum(n) FROM profiles WHERE bn_root IS NOT NULL) AS f FROM profiles WHERE bn_root IS NOT NULL GROUP BY 1",
    "name_share": "SELECT cleaned_name, sum(n) / (SELECT sum(n) FROM profiles) AS f FROM profiles GROUP BY 1",
    "fixed_weights": (
        "SELECT v.*, log2(0.001 / 0.999) + CASE g_bn_root WHEN 1 THEN log2(0.9 / s.f) WHEN 0 THEN log2(0.1 / 0.999) ELSE 0 END "
        "+ CASE g_cleaned_name WHEN 3 THEN log2(0.8 / t.f) WHEN 2 THEN log2(0.1 / 0.01) WHEN 1 THEN log2(0.05 / 0.015) ELSE log2(0.05 / 0.97) END "
        "+ CASE g_city WHEN 1 THEN log2(0.8 / 0.1) WHEN 0 THEN log2(0.2 / 0.9) ELSE 0 END + CASE g_province WHEN 1 THEN log2(0.9 / 0.2) WHEN 0 THEN log2(0.1 / 0.8) ELSE 0 END "
        "+ CASE g_entity_type WHEN 1 THEN log2(0.9 / 0.5) WHEN 0 THEN log2(0.1 / 0.5) ELSE 0 END AS w "
        "FROM all_leveled v LEFT JOIN number_share s ON s.bn_root = v.l.bn_root LEFT JOIN name_share t ON t.cleaned_name = v.l.cleaned_name"
    ),
    "fixed_predictions": "SELECT * FROM (SELECT *, 1 / (1 + pow(2.0, -w)) AS p FROM fixed_weights) WHERE p >= 0.4",
    "fixed_links": "SELECT a AS x, b AS y FROM fixed_predictions WHERE a <> b UNION SELECT b, a FROM fixed_predictions WHERE a <> b",
    "fixed_reach": (
        "WITH RECURSIVE reached AS (SELECT txt, txt AS y FROM profiles UNION SELECT r.txt, e.y FROM reached r JOIN fixed_links e ON e.x = r.y) SELECT * FROM reached"
    ),
    # Review and resolution.
    "decided": (
        "SELECT c.*, coalesce(d.status, CASE WHEN match_probability >= 0.97 THEN 'likely_same' WHEN match_probability >= 0.7 THEN 'needs_review' ELSE 'audit' END) AS status, "
        "d.reviewed_by, d.review_note, d.reviewed_at FROM review_candidates c LEFT JOIN (SELECT * FROM review_decisions "
        "QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY reviewed_at DESC) = 1) d USING (candidate_id)"
    ),
    "survivors": (
        "SELECT CASE WHEN keep_l THEN entity_id_r ELSE entity_id_l END AS duplicate_entity_id, CASE WHEN keep_l THEN entity_id_l ELSE entity_id_r END AS survivor_entity_id, "
        "match_probability AS confidence, candidate_id, reviewed_at FROM (SELECT *, CASE WHEN source_count_l <> source_count_r THEN source_count_l > source_count_r "
        "ELSE entity_id_l < entity_id_r END AS keep_l FROM decided WHERE status = 'same') "
        "QUALIFY row_number() OVER (PARTITION BY duplicate_entity_id ORDER BY reviewed_at DESC, candidate_id DESC) = 1"
    ),
    "alias_overrides": (
        f"SELECT alias, entity_id, confidence, candidate_id, reviewed_at, {_name('alias')} AS alias_norm FROM ("
        "SELECT legal_name_l AS alias, entity_id_r AS entity_id, match_probability AS confidence, candidate_id, reviewed_at FROM decided WHERE status = 'same' UNION ALL "
        "SELECT legal_name_r, entity_id_l, match_probability, candidate_id, reviewed_at FROM decided WHERE status = 'same') "
        f"WHERE {_name('alias')} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY alias_norm, entity_id ORDER BY reviewed_at DESC, candidate_id DESC) = 1"
    ),
    "name_index": (
        "SELECT DISTINCT i.key, coalesce(s.survivor_entity_id, i.entity_id) AS entity_id FROM ("
        f"SELECT {_name('canonical_name')} AS key, id AS entity_id FROM active UNION ALL "
        f"SELECT {_name('a.string_alias')}, a.id FROM alias_items a JOIN active USING (id) UNION ALL "
        "SELECT alias_norm, entity_id FROM alias_overrides) i LEFT JOIN survivors s ON s.duplicate_entity_id = i.entity_id WHERE i.key IS NOT NULL"
    ),
    "feed": (
        "SELECT seq, source, batch_id, ext_id, CASE WHEN source = 'fed_grants' THEN legal_name END AS fed_name, "
        "CASE WHEN source = 'cra_donees' THEN legal_name END AS donee_name, org_bn, CASE WHEN source = 'cra_donees' THEN donee_bn END AS donee_bn, "
        "CASE WHEN source <> 'cra_t3010' THEN amount_text END AS amount_text FROM feed_rows"
    ),
    "checked": (
        "SELECT *, CASE WHEN trim(ext_id) = '' THEN '_id is required' END AS e1, "
        "CASE WHEN source = 'cra_t3010' AND trim(coalesce(org_bn, '')) = '' THEN 'BN is required' "
        "WHEN source <> 'cra_t3010' AND amount_text <> '' AND TRY_CAST(amount_text AS DOUBLE) IS NULL THEN "
        "CASE WHEN source = 'fed_grants' THEN 'agreement_value' ELSE 'Total Gifts' END || ' must be a number' END AS e2 FROM feed"
    ),
}

# Resolution of raw feed rows and of valid ones: {rows} is the row set.
for _tag, _rows in (("raw", "feed"), ("good", "(SELECT * FROM checked WHERE e1 IS NULL AND e2 IS NULL)")):
    SHARED[f"hits_{_tag}"] = (
        f"WITH f AS (SELECT *, {_bn('org_bn')} AS b1, {_bn('donee_bn')} AS b2, {_name('coalesce(fed_name, donee_name)')} AS nm FROM {_rows}) "
        "SELECT f.source, f.seq, f.ext_id, e.id AS entity_id, 'n' AS kind, f.nm FROM f JOIN active e ON e.bn_root IN (f.b1, f.b2) UNION "
        "SELECT f.source, f.seq, f.ext_id, i.entity_id, 'a', f.nm FROM f JOIN name_index i ON i.key = f.nm "
        "WHERE NOT EXISTS (SELECT 1 FROM active e WHERE e.bn_root IN (f.b1, f.b2))"
    )
    SHARED[f"resolved_{_tag}"] = (
        "SELECT source, seq, ext_id, CASE WHEN alias THEN 'splink_alias_override' WHEN moved THEN 'splink_survivor_override' WHEN kind = 'n' THEN 'bn_root' "
        "ELSE 'exact_name_or_alias' END AS mapping_method, CASE WHEN alias THEN coalesce(ac, 1.0) WHEN moved THEN least(CASE WHEN kind = 'n' THEN 1.0 ELSE 0.9 END, hop) "
        "WHEN kind = 'n' THEN 1.0 ELSE 0.9 END AS confidence_score FROM (SELECT h.source, h.seq, h.ext_id, h.kind, "
        "bool_or(s.duplicate_entity_id IS NOT NULL) AS moved, min(s.confidence) AS hop, "
        "h.kind = 'a' AND bool_or(h.nm IN (SELECT alias_norm FROM alias_overrides)) AS alias, "
        f"max(o.confidence) AS ac FROM hits_{_tag} h LEFT JOIN survivors s ON s.duplicate_entity_id = h.entity_id "
        "LEFT JOIN alias_overrides o ON h.kind = 'a' AND o.alias_norm = h.nm AND o.entity_id = h.entity_id GROUP BY 1, 2, 3, 4) "
        "QUALIFY row_number() OVER (PARTITION BY source, ext_id ORDER BY seq DESC) = 1"
    )
    SHARED[f"listed_{_tag}"] = (
        "SELECT DISTINCT r.source, r.ext_id, coalesce(s.survivor_entity_id, h.entity_id) AS entity_id, r.mapping_method, r.confidence_score "
        f"FROM resolved_{_tag} r JOIN hits_{_tag} h USING (source, seq, ext_id) LEFT JOIN survivors s ON s.duplicate_entity_id = h.entity_id"
    )

SHARED["trigger_rows"] = (
    "SELECT source, ext_id, batch_id, amount, coalesce(fed_name, '') AS tname FROM (SELECT *, "
    "coalesce(TRY_CAST(nullif(trim(amount_text), '') AS DOUBLE), 0.0) AS amount FROM checked WHERE e1 IS NULL AND e2 IS NULL "
    "QUALIFY row_number() OVER (PARTITION BY source, ext_id ORDER BY seq DESC) = 1) WHERE NOT (amount > 0 AND amount < 1000)"
)
SHARED["ring_rows"] = (
    "SELECT DISTINCT 'cra-cycle-' || cycle_id AS ring_id, unnest(ids) AS entity_id FROM cycle_lists WHERE len(ids) >= 2"
)
SHARED["best_triggers"] = (
    "SELECT l.source, g.ring_id, t.ext_id, t.amount, t.tname, t.batch_id, l.entity_id AS seed, l.mapping_method, l.confidence_score "
    "FROM listed_good l JOIN trigger_rows t USING (source, ext_id) JOIN ring_rows g USING (entity_id) "
    "QUALIFY row_number() OVER (PARTITION BY l.source, g.ring_id ORDER BY t.amount DESC, t.ext_id, l.entity_id) = 1"
)
SHARED["ring_names"] = (
    "SELECT 'cra-cycle-' || c.cycle_id AS ring_id, list(coalesce(e.canonical_name, CAST(c.entity_id AS VARCHAR)) ORDER BY c.o) AS nms FROM ("
    "SELECT cycle_id, unnest(range(1, len(ids) + 1)) AS o, unnest(ids) AS entity_id FROM cycle_lists) c LEFT JOIN entity_golden_records e ON e.id = c.entity_id GROUP BY 1"
)


def _dollars(amount: str) -> str:
    return f"format('{{:,}}', CAST(round_even({amount}, 0) AS BIGINT))"


def _story(source: str, amount: str, name: str, ext: str, ring_amount: str) -> str:
    return (
        f"{source} || ' disbursement of $' || {_dollars(amount)} || ' to ' || {name} || ' (external_id=' || {ext} || ') connects to ring ' || ring_id || "
        f"' ($' || {_dollars(ring_amount)} || ' flow across ' || len(nms) || ' entities: ' || array_to_string(nms[1:3], ', ') || "
        "CASE WHEN len(nms) > 3 THEN '...' ELSE '' END || ').'"
    )


SHARED["finding_rows"] = (
    "SELECT b.source, CASE WHEN b.ring_id IN (SELECT 'cra-cycle-' || cycle_id FROM (SELECT * FROM headers ORDER BY total_amount DESC, cycle_id LIMIT 50)) "
    "THEN 'expanded_ring' ELSE 'new_ring' END AS finding_type, list_concat([b.seed], list_filter(c.ids, lambda e: e <> b.seed)) AS idl, ring_id, "
    f"b.ext_id AS trigger_external_id, {_story('b.source', 'b.amount', 'b.tname', 'b.ext_id', 'c.total_amount')} AS narrative, "
    "coalesce(nullif(c.total_amount, 0), b.amount) AS total_amount, CASE WHEN greatest(c.total_amount, b.amount) >= 1000000 THEN 'urgent' ELSE 'review' END AS severity, "
    "b.batch_id, b.mapping_method, b.confidence_score, 'pending' AS review_status FROM best_triggers b "
    "JOIN (SELECT 'cra-cycle-' || cycle_id AS ring_id, ids, total_amount FROM cycle_lists) c USING (ring_id) JOIN ring_names USING (ring_id)"
)

_PERSON = _norm("first_name", "last_name")
SHARED |= {
    "received": (
        "SELECT e.bn_root AS a, CAST(year(p.date) AS INT) AS y, sum(p.amount) AS received FROM public_edges p JOIN entity_golden_records e ON e.id = p.to_entity_id "
        "WHERE e.bn_root IS NOT NULL AND p.date IS NOT NULL GROUP BY 1, 2"
    ),
    "yearly_gifts": "SELECT s, d, CAST(year(date) AS INT) AS y, sum(amount) AS amt FROM gift_rows WHERE s <> d GROUP BY 1, 2, 3",
    "onward": (
        "SELECT r.a, g.d AS b, r.y, any_value(r.received) AS received, sum(g.amt) AS amt FROM received r JOIN yearly_gifts g ON g.s = r.a AND g.y BETWEEN r.y AND r.y + 1 GROUP BY 1, 2, 3"
    ),
    "common_directors": (
        "SELECT x.root AS a, z.root AS b, count(DISTINCT x.nm) AS n FROM filings x JOIN filings z ON z.nm = x.nm WHERE x.nm <> '' "
        "AND (x.root, z.root) IN (SELECT (s, d) FROM yearly_gifts) GROUP BY 1, 2"
    ),
    "department_grants": (
        "SELECT DISTINCT l.entity_id, e.bn_root AS bn, g.owner_org AS department, CAST(year(g.agreement_start_date) AS INT) AS y, g.agreement_value AS amount, g._id "
        "FROM entity_source_links l JOIN current_grants g ON g._id = TRY_CAST(json_extract_string(l.source_pk, '$._id') AS BIGINT) JOIN entity_golden_records e ON e.id = l.entity_id "
        "WHERE l.source_schema = 'fed' AND l.source_table = 'grants_contributions' AND g.agreement_value > 0 AND g.owner_org IS NOT NULL AND e.bn_root IS NOT NULL"
    ),
    "department_paid": "SELECT bn, department, sum(amount) AS total FROM department_grants GROUP BY 1, 2",
    "registered": (
        f"SELECT registration_id, {_PERSON} AS person, left(client_bn, 9) AS client, department, filed_on FROM lobby_registrations "
        f"WHERE {_PERSON} <> '' AND department IS NOT NULL"
    ),
    "offices": f"SELECT DISTINCT {_PERSON} AS person, department, ended_on FROM former_offices WHERE {_PERSON} <> ''",
}

# Steps that several others read: evaluated once.
_MATERIALIZED = {
    "loops", "loop_edges", "headers", "cycle_lists", "filings", "org_directors", "money", "copies", "gift_graph", "records", "profiles",
    "party_rings", "warm", "graph", "address_parts", "alias_items", "name_index", "survivors", "alias_overrides", "entity_named", "golden_text",
    "checked", "fixed_predictions", "fixed_links", "all_leveled", "hits_raw", "hits_good", "resolved_raw", "resolved_good", "crossover", "raw_records", "decided", "entity_source_links",
}


def statement(body: str) -> str:
    """The body with every table expression it needs, directly or not, in front."""
    library = {**demo.DERIVED, **SHARED}
    needed: set[str] = set()
    queue = [body]
    while queue:
        words = set(re.findall(r"[A-Za-z_]\w*", re.sub(r"'(?:[^']|'')*'", "", queue.pop())))
        for name in words & library.keys() - needed:
            needed.add(name)
            queue.append(library[name])
    parts = [
        f"{name} AS {'MATERIALIZED ' if name in _MATERIALIZED else ''}({text})"
        for name, text in library.items()
        if name in needed
    ]
    return f"WITH RECURSIVE {', '.join(parts)} SELECT * FROM ({body})"


_RING = (
    "ring_id, ring_type, array_to_string(ids, ',') AS entity_ids, array_to_string(nms, ',') AS canonical_names, "
    "array_to_string(persons, ',') AS shared_persons, total_amount, flags"
)
_GRAPH = "src, dst, source, amount, date, mapping_method, confidence_score, source_row_id"
_RULE = "entity_id, rule, CAST(rule_order AS BIGINT) AS rule_order, CAST(weight AS DOUBLE) AS weight, label, source, source_row_id, mapping_method, confidence_score"
_FINDING = (
    "source, finding_type, array_to_string(idl, ',') AS entity_ids, ring_id, trigger_external_id, narrative, total_amount, severity, "
    "batch_id, mapping_method, confidence_score, review_status"
)
_DARK = "'#94a3b8'"
_NODE_COLOR = (
    "CASE entity_type WHEN 'person' THEN '#60a5fa' WHEN 'charity' THEN '#fbbf24' WHEN 'business' THEN '#4ade80' "
    f"WHEN 'gov' THEN '#f87171' ELSE {_DARK} END"
)
_EDGE_COLOR = (
    "CASE source WHEN 'cra_gift' THEN '#fbbf24' WHEN 'fed_grant' THEN '#4ade80' WHEN 'fed_contribution' THEN '#a3e635' "
    f"WHEN 'ab_grant' THEN '#38bdf8' WHEN 'ab_contract' THEN '#c4b5fd' WHEN 'ab_sole_source' THEN '#f87171' ELSE {_DARK} END"
)
_TOP_RING = "(SELECT entity_id FROM header_members WHERE cycle_id = (SELECT cycle_id FROM headers ORDER BY total_amount DESC, cycle_id LIMIT 1))"


BODIES: dict[str, str] = {
    "x1_conduits": (
        "SELECT o.a, o.b, o.y AS year, CAST(o.received AS DOUBLE) AS received, CAST(o.amt AS DOUBLE) AS onward, CAST(sum(g.amt) AS DOUBLE) AS returned, coalesce(any_value(c.n), 0) AS shared_directors "
        "FROM onward o JOIN yearly_gifts g ON g.s = o.b AND g.d = o.a AND g.y BETWEEN o.y AND o.y + 1 LEFT JOIN common_directors c ON c.a = o.a AND c.b = o.b "
        "WHERE CAST(o.amt AS DOUBLE) >= 0.01::DOUBLE * CAST(o.received AS DOUBLE) GROUP BY o.a, o.b, o.y, o.received, o.amt"
    ),
    "x2_pass_through": (
        "SELECT o.a, o.b, g.d AS c, o.y AS year, CAST(o.received AS DOUBLE) AS received, CAST(o.amt AS DOUBLE) AS passed_on, CAST(sum(g.amt) AS DOUBLE) AS reached, "
        "least(CAST(o.amt AS DOUBLE), CAST(sum(g.amt) AS DOUBLE)) / CAST(o.received AS DOUBLE) AS share, any_value(c.n) AS shared_directors "
        "FROM onward o JOIN common_directors c ON c.a = o.a AND c.b = o.b JOIN yearly_gifts g ON g.s = o.b AND g.y BETWEEN o.y AND o.y + 1 AND g.d <> o.a "
        "WHERE CAST(o.amt AS DOUBLE) >= 0.05::DOUBLE * CAST(o.received AS DOUBLE) GROUP BY o.a, o.b, g.d, o.y, o.received, o.amt "
        "HAVING CAST(sum(g.amt) AS DOUBLE) >= 0.05::DOUBLE * CAST(o.received AS DOUBLE)"
    ),
    "x3_department_concentration": (
        "SELECT bn, y AS year, count(DISTINCT department) AS departments, CAST(sum(amount) AS DOUBLE) AS total FROM department_grants WHERE y IS NOT NULL "
        "GROUP BY 1, 2 HAVING count(DISTINCT department) >= 3 AND sum(amount) > 500000"
    ),
    "x4_lobbyist_charities": (
        "SELECT l.person, l.client, l.department, f.root AS charity, l.n AS registrations, CAST(p.total AS DOUBLE) AS client_total, CAST(q.total AS DOUBLE) AS charity_total "
        "FROM (SELECT person, client, department, count(DISTINCT registration_id) AS n FROM registered GROUP BY 1, 2, 3) l "
        "JOIN department_paid p ON p.bn = l.client AND p.department = l.department JOIN (SELECT DISTINCT root, nm FROM filings) f ON f.nm = l.person "
        "JOIN department_paid q ON q.bn = f.root AND q.department = l.department"
    ),
    "x6_revolving_door": (
        "SELECT r.person, r.department, CAST(o.ended_on AS VARCHAR) AS ended_on, r.registration_id, r.client, CAST(r.filed_on AS VARCHAR) AS filed_on, CAST(p.total AS DOUBLE) AS client_total "
        "FROM registered r JOIN offices o ON o.person = r.person AND o.department = r.department AND r.filed_on > o.ended_on AND r.filed_on <= o.ended_on + INTERVAL 5 YEAR "
        "JOIN department_paid p ON p.bn = r.client AND p.department = r.department"
    ),
    "x6_contact_before_award": (
        f"WITH c AS MATERIALIZED (SELECT contact_id, {_PERSON} AS person, left(client_bn, 9) AS vendor, department, contacted_on FROM lobby_contacts) "
        "SELECT a.award_id, left(a.vendor_bn, 9) AS vendor, a.department, CAST(a.awarded_on AS VARCHAR) AS awarded_on, CAST(a.amount AS DOUBLE) AS amount, c.contact_id, c.person, "
        "CAST(c.contacted_on AS VARCHAR) AS contacted_on, date_diff('day', c.contacted_on, a.awarded_on) AS days FROM (SELECT *, row_number() OVER () AS rn FROM department_awards) a "
        "JOIN c ON c.vendor = left(a.vendor_bn, 9) AND c.department = a.department AND c.contacted_on < a.awarded_on WHERE a.sole_source_reason IS NOT NULL "
        "QUALIFY row_number() OVER (PARTITION BY a.rn ORDER BY c.contacted_on DESC, c.contact_id DESC) = 1"
    ),
    "q01_golden_records": (
        "SELECT e.id AS entity_id, any_value(e.canonical_name) AS canonical_name, coalesce(any_value(e.entity_type), 'unknown') AS entity_type, "
        "any_value(e.bn_root) AS bn_root, any_value(e.bn_variants_csv) AS bn_variants, coalesce(any_value(e.aliases), '[]') AS aliases, "
        "any_value(e.dataset_sources_csv) AS datasets, coalesce(any_value(e.source_link_count), count(l.id), 0) AS source_link_count "
        "FROM active e LEFT JOIN entity_source_links l ON l.entity_id = e.id GROUP BY e.id"
    ),
    "q01_golden_records_fed": (
        "SELECT e.id AS entity_id, any_value(e.canonical_name) AS canonical_name, coalesce(any_value(e.source_link_count), count(l.id), 0) AS source_link_count "
        "FROM active e LEFT JOIN entity_source_links l ON l.entity_id = e.id WHERE list_contains(e.dataset_sources, 'fed') GROUP BY e.id "
        "ORDER BY source_link_count DESC, e.id LIMIT 100"
    ),
    "q02_directors_for_org": "SELECT * FROM org_directors",
    "q03_funding_edges": f"SELECT entity_id, role, {_EDGE} FROM copies",
    "q03_funding_edges_out": f"SELECT from_entity_id AS entity_id, 'out' AS role, {_EDGE} FROM out_edges",
    "q04_precomputed_cycles": "SELECT cycle_id, total_amount, hop_count, min_year, max_year, array_to_string(ids, ',') AS entity_ids FROM cycle_lists",
    "q05_cycle_edges": "SELECT * FROM cycle_edge_rows",
    "q06_cycle_summary": (
        "SELECT id AS cycle_id, CAST(total_flow AS DOUBLE) AS total_amount, hops AS hop_count, min_year, max_year, array_to_string(path_bns, ',') AS path_bns FROM loops"
    ),
    "q07_source_summary": "SELECT entity_id, source_schema, source_table, count(*) AS link_count FROM entity_source_links GROUP BY 1, 2, 3",
    "q08_sole_source_flags": "SELECT * FROM sole_source ORDER BY total_amount DESC, entity_id, vendor_name LIMIT 5000",
    "q09_fed_concentration": "SELECT entity_id, round(hhi_score, 9) AS hhi_score, dept_count, round(top_dept_share, 9) AS top_dept_share FROM concentration",
    "q10_related_entities": "SELECT * FROM related",
    "q11_entities_by_ids": (
        "SELECT id AS entity_id, canonical_name, coalesce(entity_type, 'unknown') AS entity_type, bn_root, bn_variants_csv AS bn_variants, "
        "coalesce(aliases, '[]') AS aliases, dataset_sources_csv AS datasets, source_link_count FROM entity_golden_records "
        "WHERE id IN (SELECT entity_id FROM entity_source_links)"
    ),
    "q12_evidence_for_edges": (
        "SELECT source, source_row_id, table_name, min(row) AS row FROM ("
        "SELECT 'cra_gift' AS source, m.source_row_id, 'cra.cra_qualified_donees' AS table_name, '{\"bn\":\"' || q.bn || '\",\"fpe\":\"' || q.fpe || '\",\"sequence_number\":' || q.sequence_number "
        "|| ',\"donee_bn\":' || coalesce('\"' || q.donee_bn || '\"', 'null') || ',\"total_gifts\":' || q.total_gifts || '}' AS row FROM (SELECT DISTINCT source_row_id FROM money WHERE source = 'cra_gift') m "
        f"JOIN cra_qualified_donees q ON {_RID.format(a='q')} = m.source_row_id UNION ALL "
        "SELECT 'cra_director', m.source_row_id, 'cra.cra_directors', '{\"bn\":\"' || d.bn || '\",\"fpe\":\"' || d.fpe || '\",\"sequence_number\":' || d.sequence_number || ',\"first_name\":\"' || d.first_name "
        "|| '\",\"last_name\":\"' || d.last_name || '\",\"initials\":' || coalesce('\"' || d.initials || '\"', 'null') || '}' FROM (SELECT DISTINCT source_row_id FROM org_directors) m "
        f"JOIN cra_directors d ON {_RID.format(a='d')} = m.source_row_id UNION ALL "
        "SELECT 'cra_gift', c.source_row_id, 'cra.loop_edges', '{\"cycle_id\":\"' || c.cycle_id || '\",\"edge_order\":' || c.edge_order || ',\"source_bn\":\"' || c.src_bn || '\",\"destination_bn\":\"' || c.dst_bn "
        "|| '\",\"amount\":' || l.total_amt || ',\"min_year\":' || l.min_year || ',\"max_year\":' || l.max_year || ',\"provenance\":\"cra.loop_edges\"}' FROM cycle_edge_rows c "
        "JOIN loop_edges l ON l.src = c.src_bn AND l.dst = c.dst_bn UNION ALL "
        "SELECT m.source, m.source_row_id, 'fed.grants_contributions', '{\"_id\":' || g._id || ',\"ref_number\":' || coalesce('\"' || g.ref_number || '\"', 'null') || ',\"amendment_number\":' || coalesce(CAST(g.amendment_number AS VARCHAR), 'null') "
        "|| ',\"owner_org\":' || coalesce('\"' || g.owner_org || '\"', 'null') || ',\"agreement_value\":' || g.agreement_value || ',\"agreement_start_date\":\"' || g.agreement_start_date || '\",\"agreement_type\":\"' || g.agreement_type || '\"}' "
        "FROM (SELECT DISTINCT source, source_row_id FROM money WHERE source LIKE 'fed%') m JOIN grants_contributions g ON CAST(g._id AS VARCHAR) = m.source_row_id UNION ALL "
        "SELECT m.source, m.source_row_id, 'ab.ab_grants', '{\"id\":' || g.id || ',\"amount\":' || g.amount || ',\"payment_date\":\"' || g.payment_date || '\"}' FROM (SELECT DISTINCT source, source_row_id FROM money WHERE source = 'ab_grant') m "
        "JOIN ab_grants g ON CAST(g.id AS VARCHAR) = m.source_row_id UNION ALL "
        "SELECT m.source, m.source_row_id, 'ab.ab_contracts', '{\"id\":\"' || g.id || '\",\"amount\":' || g.amount || '}' FROM (SELECT DISTINCT source, source_row_id FROM money WHERE source = 'ab_contract') m "
        "JOIN ab_contracts g ON g.id = m.source_row_id UNION ALL "
        "SELECT m.source, m.source_row_id, 'ab.ab_sole_source', '{\"id\":\"' || g.id || '\",\"amount\":' || g.amount || ',\"start_date\":\"' || g.start_date || '\",\"vendor\":\"' || g.vendor || '\"}' "
        "FROM (SELECT DISTINCT source, source_row_id FROM money WHERE source = 'ab_sole_source') m JOIN ab_sole_source g ON g.id = m.source_row_id) GROUP BY 1, 2, 3"
    ),
    "q13_cycle_edge_evidence": (
        "SELECT p.cycle_id, p.edge_order, 'cra.loop_edges' AS table_name, '{\"cycle_id\":\"' || p.cycle_id || '\",\"edge_order\":' || p.edge_order || ',\"source_bn\":\"' || p.src_bn || '\",\"destination_bn\":\"' || p.dst_bn "
        "|| '\",\"amount\":' || l.total_amt || ',\"min_year\":' || l.min_year || ',\"max_year\":' || l.max_year || ',\"provenance\":\"cra.loop_edges\"}' AS row "
        "FROM loop_pairs p LEFT JOIN loop_edges l ON l.src = p.src_bn AND l.dst = p.dst_bn"
    ),
    "q14_shared_director_candidates": (
        "SELECT n.director_name_normalized, n.org_count, d.entity_id FROM shared_names n JOIN (SELECT DISTINCT nm, entity_id FROM funded_directors) d ON d.nm = n.director_name_normalized"
    ),
    "q15_high_overhead": (
        "SELECT e.id AS entity_id, i.legal_name, CAST(f.field_5100 AS DOUBLE) AS total_expenditures, CAST(c.field_390 AS DOUBLE) AS total_compensation, "
        "CAST((CAST(c.field_390 * 100 AS BIGINT) * 2000 + CAST(f.field_5100 * 100 AS BIGINT)) // (2 * CAST(f.field_5100 * 100 AS BIGINT)) AS DOUBLE) / 10 AS comp_pct "
        "FROM entity_golden_records e JOIN cra_compensation c ON e.bn_root = left(c.bn, 9) JOIN cra_financial_details f ON c.bn = f.bn AND c.fpe = f.fpe "
        "JOIN cra_identification i ON i.bn = c.bn AND i.fiscal_year = year(c.fpe) WHERE c.fpe >= DATE '1998-01-01' AND c.field_390 > 0 AND f.field_5100 > 0 "
        "AND c.field_390 * 2 > f.field_5100 AND f.field_5100 < 100000000 AND (e.id IN (SELECT entity_id FROM funded) OR e.bn_root IN (SELECT bn FROM loop_participants)) "
        "ORDER BY comp_pct DESC, entity_id, total_expenditures, total_compensation LIMIT 2000"
    ),
    "q16_address_clusters": (
        "WITH a AS (SELECT id, lower(trim(x->>'$.postal_code')) AS postal, lower(trim(x->>'$.city')) AS city FROM (SELECT id, unnest(from_json(addresses, '[\"JSON\"]')) AS x "
        "FROM entity_golden_records WHERE addresses IS NOT NULL)), c AS (SELECT postal, city, count(*) AS cnt FROM a GROUP BY 1, 2 HAVING count(*) >= 3) "
        "SELECT DISTINCT a.id AS entity_id, c.cnt AS cluster_size FROM a JOIN c ON a.postal = c.postal AND a.city = c.city WHERE a.id IN (SELECT entity_id FROM funded) "
        "ORDER BY cluster_size DESC, entity_id LIMIT 5000"
    ),
    "q17_nonqualified_donees": (
        "WITH t AS (SELECT e.id AS entity_id, count(*) AS grant_count, CAST(sum(n.cash_amount) AS DOUBLE) AS total_cash, "
        "list(DISTINCT n.recipient_name) FILTER (WHERE n.recipient_name IS NOT NULL) AS nms FROM entity_golden_records e JOIN cra_non_qualified_donees n ON e.bn_root = left(n.bn, 9) "
        "WHERE n.fpe >= DATE '1998-01-01' AND n.cash_amount > 0 GROUP BY 1 HAVING count(*) >= 2 ORDER BY total_cash DESC, entity_id LIMIT 2000) "
        "SELECT entity_id, grant_count, total_cash, unnest(coalesce(nms, [CAST(NULL AS VARCHAR)])) AS recipient_name FROM t"
    ),
    "q18_ring_funding_edges": f"SELECT {_EDGE} FROM party_gifts",
    "q19_shared_director_funding_pairs": (
        "WITH d AS (SELECT DISTINCT nm, entity_id, bn_root FROM funded_directors), p AS (SELECT a.nm, a.entity_id AS ea, a.bn_root AS ba, b.entity_id AS eb, b.bn_root AS bb "
        "FROM d a JOIN d b ON a.nm = b.nm AND a.entity_id < b.entity_id) "
        "SELECT nm AS director_name_normalized, ea AS entity_id_a, eb AS entity_id_b, CAST(sum(amount) AS DOUBLE) AS total_amount, min(source_row_id) AS source_row_id FROM ("
        "SELECT p.*, g.amount, g.source_row_id FROM p JOIN gift_rows g ON g.s = p.ba AND g.d = p.bb UNION ALL "
        "SELECT p.*, g.amount, g.source_row_id FROM p JOIN gift_rows g ON g.s = p.bb AND g.d = p.ba AND p.ba <> p.bb) GROUP BY nm, ea, eb HAVING sum(amount) >= 50000 "
        "ORDER BY total_amount DESC, 1, 2, 3 LIMIT 500"
    ),
    "q20_director_funding_pairs_fast": (
        "SELECT p.*, a.canonical_name AS name_a, b.canonical_name AS name_b FROM (SELECT * FROM director_pairs WHERE total_amount >= 60000 "
        "ORDER BY total_amount DESC, entity_id_a, entity_id_b, director_name_normalized LIMIT 200) p JOIN entity_golden_records a ON a.id = p.entity_id_a "
        "JOIN entity_golden_records b ON b.id = p.entity_id_b"
    ),
    "q21_contractor_directors": "SELECT * FROM contractor_people",
    "q22_charities_for_directors": "SELECT * FROM charity_people",
    "q23_crossover": "SELECT * EXCLUDE (people), array_to_string(people, ',') AS shared_directors FROM crossover",
    "q23_crossover_display": (
        "SELECT charity_name AS charity, contractor_name AS contractor, array_to_string(people, ', ') AS directors, CAST(round(total_grant_amount, 0) AS BIGINT) AS federal_grants, "
        "CAST(round(total_contract_amount, 0) AS BIGINT) AS ab_contracts, contract_source AS contract_type FROM crossover"
    ),
    "q24_top_cycles": (
        "SELECT cycle_id, total_amount, hop_count, array_to_string(ids, ',') AS entity_ids FROM cycle_lists ORDER BY total_amount DESC, cycle_id LIMIT 30"
    ),
    "q25_shared_directors_bulk": "SELECT * FROM long_names",
    "q26_smoke_counts": (
        "SELECT (SELECT count(*) FROM entity_golden_records) AS golden_records, (SELECT count(*) FROM (SELECT lower(trim(concat_ws(' ', d.first_name, d.initials, d.last_name))) AS nm "
        "FROM cra_directors d JOIN entity_golden_records e ON e.bn_root = left(d.bn, 9) GROUP BY 1 HAVING count(DISTINCT e.id) >= 3)) AS directors_with_3_plus_orgs, "
        "(SELECT count(*) FROM cra_qualified_donees WHERE total_gifts > 0) + (SELECT count(*) FROM grants_contributions WHERE agreement_value > 0) + "
        "(SELECT count(*) FROM ab_grants WHERE amount > 0) + (SELECT count(*) FROM ab_contracts WHERE amount > 0) + (SELECT count(*) FROM ab_sole_source WHERE amount > 0) AS funding_edges, "
        "(SELECT count(*) FROM loops) AS precomputed_cycles"
    ),
    "g01_vertices": "SELECT * FROM nodes",
    "g02_edges": "SELECT * FROM graph",
    "g03_ego_graph": (
        "SELECT DISTINCT c.entity_id AS seed, coalesce(CAST(from_entity_id AS VARCHAR), 'source:' || source || ':' || source_row_id) AS src, CAST(to_entity_id AS VARCHAR) AS dst, "
        "source, CAST(amount AS DOUBLE) AS amount, source_row_id FROM copies c WHERE to_entity_id IS NOT NULL UNION "
        "SELECT entity_id, src, dst, source, amount, source_row_id FROM director_edges"
    ),
    "g03_ego_graph_of_top_cycle": (
        f"WITH seeds AS (SELECT DISTINCT entity_id AS seed FROM {_TOP_RING}), near AS (SELECT seed, seed AS entity_id FROM seeds UNION "
        "SELECT s.seed, unnest([c.from_entity_id, c.to_entity_id]) FROM seeds s JOIN copies c ON c.entity_id = s.seed), "
        "n AS (SELECT * FROM near WHERE entity_id IS NOT NULL) "
        "SELECT DISTINCT n.seed, coalesce(CAST(from_entity_id AS VARCHAR), 'source:' || source || ':' || source_row_id) AS src, CAST(to_entity_id AS VARCHAR) AS dst, "
        "source, CAST(amount AS DOUBLE) AS amount, source_row_id FROM copies c JOIN n USING (entity_id) WHERE to_entity_id IS NOT NULL UNION "
        "SELECT n.seed, src, dst, source, amount, source_row_id FROM director_edges JOIN n USING (entity_id)"
    ),
    "g04_ring_graph": (
        f"SELECT DISTINCT r.ring_id, {_GRAPH} FROM money_graph g JOIN (SELECT DISTINCT ring_id, unnest(ids) AS entity_id FROM warm) r "
        f"ON r.entity_id = g.from_entity_id OR r.entity_id = g.to_entity_id UNION "
        f"SELECT r.ring_id, {_GRAPH} FROM director_edges g JOIN (SELECT DISTINCT ring_id, unnest(ids) AS entity_id FROM warm) r USING (entity_id)"
    ),
    "g05_cycle_graph": (
        "SELECT DISTINCT cycle_id, CAST(from_entity_id AS VARCHAR) AS src, CAST(to_entity_id AS VARCHAR) AS dst, source, amount, date, mapping_method, confidence_score, source_row_id FROM cycle_edge_rows"
    ),
    "g06_shared_directors": (
        "WITH m AS (SELECT DISTINCT 'cra-cycle-' || cycle_id AS ring_id, entity_id FROM header_members UNION SELECT ring_id, unnest([a, b]) FROM ("
        "SELECT 'director-pair-' || replace(director_name_normalized, ' ', '-') || '-' || entity_id_a || '-' || entity_id_b AS ring_id, entity_id_a AS a, entity_id_b AS b "
        "FROM director_pairs WHERE total_amount >= 60000 ORDER BY total_amount DESC, entity_id_a, entity_id_b, director_name_normalized LIMIT 200)) "
        "SELECT m.ring_id, d.director_name_normalized FROM m JOIN (SELECT DISTINCT entity_id, director_name_normalized FROM org_directors WHERE director_name_normalized <> '') d USING (entity_id) "
        "JOIN (SELECT ring_id, count(*) AS size FROM m GROUP BY 1) s ON s.ring_id = m.ring_id GROUP BY 1, 2, s.size HAVING count(*) = s.size"
    ),
    "g07_ring_edges": (
        "WITH r AS (SELECT DISTINCT ring_id, unnest(ids) AS entity_id FROM warm) SELECT a.ring_id, source, source_row_id, from_entity_id, to_entity_id, CAST(max(amount) AS DOUBLE) AS amount, "
        "CAST(max(date) AS VARCHAR) AS date, max(mapping_method) AS mapping_method, max(confidence_score) AS confidence_score FROM money m JOIN r a ON a.entity_id = m.from_entity_id "
        "JOIN r b ON b.entity_id = m.to_entity_id AND b.ring_id = a.ring_id GROUP BY 1, 2, 3, 4, 5"
    ),
    "g08_related_party_rings": f"SELECT {_RING} FROM party_rings",
    "g09_analyze_neighborhood": (
        f"WITH s AS (SELECT DISTINCT CAST(substring({_bn('org_bn')}, 4, 6) AS BIGINT) - 1 AS entity_id FROM feed WHERE {_bn('org_bn')} IS NOT NULL) "
        "SELECT ring_id, array_to_string(ids, ',') AS entity_ids, array_to_string(nms, ',') AS canonical_names, total_amount, array_to_string(list_sort(hit), ',') AS seeds_touched FROM ("
        "SELECT 'cra-cycle-' || cycle_id AS ring_id, ids, total_amount FROM cycle_lists WHERE len(ids) >= 2) JOIN ring_names USING (ring_id) JOIN ("
        "SELECT ring_id, list(DISTINCT entity_id) AS hit FROM ring_rows JOIN s USING (entity_id) GROUP BY 1) USING (ring_id)"
    ),
    "g10_prewarmed_rings": f"SELECT {_RING}, total_score FROM warm",
    "g11_export_nodes": (
        f"SELECT node_id AS id, canonical_name AS label, canonical_name AS title, entity_type AS \"group\", {_NODE_COLOR} AS background, "
        f"CASE WHEN node_id IN (SELECT CAST(entity_id AS VARCHAR) FROM {_TOP_RING}) THEN '#ef4444' ELSE '#e5e7eb' END AS border, "
        f"CAST(CASE WHEN node_id IN (SELECT CAST(entity_id AS VARCHAR) FROM {_TOP_RING}) THEN 4 ELSE 1 END AS BIGINT) AS border_width FROM nodes"
    ),
    "g11_export_edges": (
        "SELECT src || ':' || dst || ':' || source || '|' || source_row_id AS id, src AS \"from\", dst AS \"to\", "
        f"CASE WHEN amount <> 0 THEN '$' || {_dollars('amount')} ELSE source END AS label, {_EDGE_COLOR} AS color, amount FROM graph"
    ),
    "g12_evidence_table": (
        "WITH b AS (SELECT dst AS node_id, * FROM graph UNION ALL SELECT src, * FROM graph) SELECT b.node_id, b.source, replace(b.source, '_', '.') AS \"table\", b.source_row_id, "
        "b.mapping_method, b.confidence_score, f.canonical_name AS \"from\", t.canonical_name AS \"to\" FROM b JOIN nodes f ON f.node_id = b.src JOIN nodes t ON t.node_id = b.dst"
    ),
    "g13_crossover_edges": (
        "WITH c AS (SELECT *, 'crossover-charity-' || charity_entity_id AS ch, 'crossover-contractor-' || contractor_entity_id AS co FROM crossover), "
        "p AS (SELECT *, unnest(people) AS person FROM c) SELECT charity_entity_id, contractor_entity_id, 'gov:fed_grants_contributions' AS src, ch AS dst, 'fed_grant' AS source, total_grant_amount AS amount FROM c "
        "UNION ALL SELECT charity_entity_id, contractor_entity_id, 'gov:' || contract_source, co, contract_source, total_contract_amount FROM c "
        "UNION ALL SELECT charity_entity_id, contractor_entity_id, 'person:' || person, ch, 'cra_director', 0.0 FROM p "
        "UNION ALL SELECT charity_entity_id, contractor_entity_id, 'person:' || person, co, 'cra_director', 0.0 FROM p"
    ),
    "g13_crossover_nodes": (
        "WITH p AS (SELECT *, unnest(people) AS person FROM crossover) SELECT charity_entity_id, contractor_entity_id, 'crossover-charity-' || charity_entity_id AS node_id, charity_name AS canonical_name, "
        "'charity' AS entity_type, 'cra,fed' AS datasets, CAST(0.7 AS DOUBLE) AS total_score, 'Federal-grant recipient' AS flags FROM crossover UNION ALL "
        "SELECT charity_entity_id, contractor_entity_id, 'crossover-contractor-' || contractor_entity_id, contractor_name, 'business', 'cra,ab', 0.7, 'AB contract recipient' FROM crossover UNION ALL "
        "SELECT charity_entity_id, contractor_entity_id, 'gov:fed_grants_contributions', 'Federal G&C', 'gov', 'fed', 0.0, '' FROM crossover UNION ALL "
        "SELECT charity_entity_id, contractor_entity_id, 'gov:' || contract_source, CASE WHEN contract_source = 'ab_sole_source' THEN 'Alberta sole-source' ELSE 'Alberta contract' END, 'gov', 'ab', 0.0, '' FROM crossover UNION ALL "
        "SELECT charity_entity_id, contractor_entity_id, 'person:' || person, person, 'person', 'cra', 0.0, 'Shared director' FROM p"
    ),
    "g14_director_overlay": (
        "WITH m AS (SELECT DISTINCT 'cra-cycle-' || cycle_id AS ring_id, CAST(from_entity_id AS VARCHAR) AS src, CAST(to_entity_id AS VARCHAR) AS dst, source, amount, date, source_row_id FROM cycle_edge_rows "
        "WHERE 'cra-cycle-' || cycle_id IN (SELECT ring_id FROM warm)), p AS (SELECT DISTINCT ring_id, person, unnest(ids) AS entity_id FROM (SELECT ring_id, ids, unnest(persons) AS person FROM warm)) "
        "SELECT ring_id, src, dst, source, amount, date FROM m UNION ALL SELECT ring_id, 'person:' || person, CAST(entity_id AS VARCHAR), 'cra_director', 0.0, '' FROM p "
        "WHERE EXISTS (SELECT 1 FROM m WHERE m.ring_id = p.ring_id AND CAST(p.entity_id AS VARCHAR) IN (m.src, m.dst)) OR p.ring_id NOT IN (SELECT ring_id FROM m)"
    ),
    "g15_light_ring_edges": (
        "SELECT ring_id, 'person:' || person AS src, CAST(entity_id AS VARCHAR) AS dst, 'cra_director' AS source, CAST(0.0 AS DOUBLE) AS amount, '' AS date FROM ("
        "SELECT ring_id, person, unnest(ids) AS entity_id FROM (SELECT ring_id, ids, unnest(persons) AS person FROM ranked_rings)) UNION ALL "
        "SELECT a.ring_id, CAST(g.from_entity_id AS VARCHAR), CAST(g.to_entity_id AS VARCHAR), g.source, CAST(g.amount AS DOUBLE), CAST(g.date AS VARCHAR) FROM party_gifts g "
        "JOIN party_rows a ON a.entity_id = g.from_entity_id JOIN party_rows b ON b.entity_id = g.to_entity_id AND b.ring_id = a.ring_id WHERE a.ring_id IN (SELECT ring_id FROM ranked_rings)"
    ),
    "g15_light_ring_nodes": (
        "SELECT DISTINCT ring_id, CAST(unnest(ids) AS VARCHAR) AS node_id, unnest(nms) AS canonical_name, 'charity' AS entity_type, total_score FROM warm UNION ALL "
        "SELECT ring_id, 'person:' || person, person, 'person', 0.0 FROM (SELECT ring_id, unnest(persons) AS person FROM warm)"
    ),
    "g16_cycle_detection": (
        "SELECT array_to_string(path_bns, ',') AS path_bns, hops, CAST(total_flow AS DOUBLE) AS total_flow, CAST(bottleneck_amt AS DOUBLE) AS bottleneck_amt, min_year, max_year, id FROM loops"
    ),
    "g16_all_short_loops": (
        "WITH g AS MATERIALIZED (SELECT s AS src, d AS dst, CAST(sum(amount) AS DECIMAL(28,2)) AS amt, min(year(date)) AS y0, max(year(date)) AS y1 FROM gift_rows WHERE s <> d GROUP BY 1, 2), "
        "l AS (SELECT [a.src, a.dst] AS p, CAST(a.amt + b.amt AS DECIMAL(28,2)) AS flow, least(a.amt, b.amt) AS low, least(a.y0, b.y0) AS y0, greatest(a.y1, b.y1) AS y1 "
        "FROM g a JOIN g b ON b.src = a.dst AND b.dst = a.src WHERE a.src < a.dst UNION ALL "
        "SELECT [a.src, a.dst, b.dst], CAST(a.amt + b.amt + c.amt AS DECIMAL(28,2)), least(a.amt, b.amt, c.amt), least(a.y0, b.y0, c.y0), greatest(a.y1, b.y1, c.y1) "
        "FROM g a JOIN g b ON b.src = a.dst JOIN g c ON c.src = b.dst AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst) "
        "SELECT array_to_string(p, ',') AS path_bns, len(p) AS hops, CAST(flow AS DOUBLE) AS total_flow, CAST(low AS DOUBLE) AS bottleneck_amt, y0 AS min_year, y1 AS max_year, array_to_string(p, '-') AS id FROM l"
    ),
    "g16_loop_edges": "SELECT src, dst, CAST(total_amt AS DOUBLE) AS total_amt, min_year, max_year FROM loop_edges",
    "g16_loop_participants": "SELECT bn FROM loop_participants",
    **{
        f"ru{i}_{rule}": f"SELECT {_RULE} FROM evidence WHERE rule_order = {i}"
        for i, rule in enumerate(
            ("funding_concentration", "cycle_member", "shared_director", "sole_source", "related_entity_funding"), 1
        )
    },
    "sc1_score_all": (
        "WITH s AS (SELECT entity_id, least(sum(weight), 1.0) AS total_score, array_to_string(list(label ORDER BY rule_order), ', ') AS flags_csv, CAST(sum(n) AS BIGINT) AS evidence_count FROM ("
        "SELECT entity_id, rule_order, weight, label, count(*) AS n FROM evidence GROUP BY 1, 2, 3, 4) GROUP BY 1), c AS (SELECT entity_id FROM header_members UNION "
        "SELECT d.entity_id FROM funded_directors d JOIN shared_names n ON n.director_name_normalized = d.nm UNION "
        "SELECT entity_id FROM (SELECT * FROM sole_source ORDER BY total_amount DESC, entity_id, vendor_name LIMIT 5000)) "
        "SELECT s.entity_id, coalesce(e.canonical_name, CAST(s.entity_id AS VARCHAR)) AS canonical_name, CAST(s.total_score AS DOUBLE) AS total_score, s.flags_csv, s.evidence_count FROM s JOIN c USING (entity_id) "
        "LEFT JOIN entity_golden_records e ON e.id = s.entity_id ORDER BY s.total_score DESC, s.entity_id LIMIT 200"
    ),
    "sc2_ring_score": (
        "WITH h AS (SELECT cycle_id, director_name_normalized FROM header_members JOIN long_names USING (entity_id) GROUP BY 1, 2 HAVING count(*) >= 2) "
        f"SELECT 'cra-cycle-' || cycle_id AS ring_id, {_score('total_amount', 'cycle_id IN (SELECT cycle_id FROM h)')} AS total_score FROM headers"
    ),
    "sc3_top_rings": f"SELECT {_RING}, total_score FROM ranked_rings",
    "sc3_top_ring_evidence": (
        "WITH i AS (SELECT a.ring_id, g.* FROM party_gifts g JOIN party_rows a ON a.entity_id = g.from_entity_id JOIN party_rows b ON b.entity_id = g.to_entity_id AND b.ring_id = a.ring_id "
        "WHERE a.ring_id IN (SELECT ring_id FROM ranked_rings)) SELECT ring_id, source, source_row_id, mapping_method, confidence_score FROM i UNION ALL "
        f"SELECT ring_id, ev_source, ev_row, {_MONEY} FROM ranked_rings WHERE ring_id NOT IN (SELECT ring_id FROM i)"
    ),
    "sc4_node_scores": (
        "WITH m AS (SELECT DISTINCT 'cra-cycle-' || cycle_id AS ring_id, unnest([from_entity_id, to_entity_id]) AS entity_id FROM cycle_edge_rows WHERE 'cra-cycle-' || cycle_id IN (SELECT ring_id FROM warm)) "
        "SELECT m.ring_id, CAST(m.entity_id AS VARCHAR) AS node_id, e.canonical_name, coalesce(e.entity_type, 'unknown') AS entity_type, "
        "CASE WHEN list_contains(w.ids, m.entity_id) THEN w.total_score ELSE 0.0 END AS score FROM m JOIN warm w USING (ring_id) JOIN entity_golden_records e ON e.id = m.entity_id "
        "QUALIFY row_number() OVER (PARTITION BY m.ring_id ORDER BY score DESC, node_id) <= 10"
    ),
    "er1_extract_records": (
        "SELECT entity_id, bn_root, city, province, postal_code, entity_type, source_count, source_dataset, record_id, legal_name, cleaned_name FROM records"
    ),
    "er2_candidate_pairs": "SELECT * FROM blocked",
    "er3_pair_comparison": (
        f"SELECT CAST({_level('a.bn_root', 'b.bn_root')} AS BIGINT) AS g_bn_root, CAST(CASE WHEN a.cleaned_name = b.cleaned_name THEN 3 WHEN jaro_winkler_similarity(a.cleaned_name, b.cleaned_name) >= 0.92 THEN 2 "
        f"WHEN jaro_winkler_similarity(a.cleaned_name, b.cleaned_name) >= 0.82 THEN 1 ELSE 0 END AS BIGINT) AS g_cleaned_name, CAST({_level('a.city', 'b.city')} AS BIGINT) AS g_city, "
        f"CAST({_level('a.province', 'b.province')} AS BIGINT) AS g_province, CAST({_level('a.entity_type', 'b.entity_type')} AS BIGINT) AS g_entity_type, count(*) AS pair_count "
        "FROM blocked p JOIN profiles a ON a.txt = p.a JOIN profiles b ON b.txt = p.b GROUP BY 1, 2, 3, 4, 5"
    ),
    "er3_compared_pairs": "SELECT a, b, g_bn_root, g_cleaned_name, g_city, g_province, g_entity_type FROM leveled",
    "er4_fixed_predictions": (
        "SELECT a, b, g_bn_root, g_cleaned_name, g_city, g_province, g_entity_type, round(w, 6) AS match_weight, round(p, 6) AS match_probability FROM fixed_predictions"
    ),
    "er4_fixed_clusters": (
        "SELECT txt AS profile, min(y) AS first_profile FROM fixed_reach GROUP BY txt"
    ),
    "er4b_entity_profiles": (
        "SELECT entity_id, record_id, legal_name, cleaned_name, bn_root, city, province, source_dataset, source_count FROM records "
        "QUALIFY row_number() OVER (PARTITION BY entity_id, bn_root, cleaned_name, city, province, entity_type ORDER BY record_id) = 1"
    ),
    **{
        f"er5_resolve_{s}": f"SELECT ext_id AS external_id, entity_id, mapping_method, CAST(confidence_score AS DOUBLE) AS confidence_score FROM listed_raw WHERE source = '{s}'"
        for s in ("fed_grants", "cra_t3010", "cra_donees")
    },
    "er6_coverage": (
        "SELECT (SELECT count(DISTINCT ext_id) FROM resolved_raw WHERE source = 'cra_donees') AS matched, (SELECT count(*) FROM feed WHERE source = 'cra_donees') AS total"
    ),
    "er6_index_stats": (
        "SELECT (SELECT count(DISTINCT bn_root) FROM active) AS bn_keys, (SELECT count(DISTINCT key) FROM name_index) AS name_keys, "
        "(SELECT count(DISTINCT alias_norm) FROM alias_overrides) AS splink_alias_keys, (SELECT count(*) FROM survivors) AS splink_survivor_overrides"
    ),
    "er7_candidate_status": (
        "SELECT candidate_id, match_probability, CASE WHEN match_probability >= 0.97 THEN 'likely_same' WHEN match_probability >= 0.7 THEN 'needs_review' ELSE 'audit' END AS status FROM review_candidates"
    ),
    "er8_survivor_overrides": "SELECT * REPLACE (CAST(reviewed_at AS VARCHAR) AS reviewed_at) FROM survivors",
    "er8_alias_overrides": "SELECT * REPLACE (CAST(reviewed_at AS VARCHAR) AS reviewed_at) FROM alias_overrides",
    "er8b_decided_candidates": "SELECT * REPLACE (CAST(reviewed_at AS VARCHAR) AS reviewed_at) FROM decided",
    "er9_approved_overrides": (
        "SELECT 'survivor' AS kind, CAST(duplicate_entity_id AS VARCHAR) AS key, survivor_entity_id AS entity_id, confidence FROM survivors UNION ALL "
        "SELECT 'alias', alias_norm, entity_id, confidence FROM alias_overrides"
    ),
    "er10_review_queue": (
        "SELECT candidate_id, match_probability, status FROM decided WHERE status = 'needs_review' ORDER BY match_probability DESC, candidate_id DESC LIMIT 100"
    ),
    "er10_review_summary": (
        "SELECT count(*) AS candidates, count(*) FILTER (WHERE match_probability >= 0.97) AS likely_same, count(*) FILTER (WHERE status IN ('needs_review', 'likely_same')) AS needs_review, "
        "count(*) FILTER (WHERE status = 'same') AS approved FROM decided"
    ),
    "er11_run_record": (
        "SELECT 'run-1' AS run_id, CAST(0.4 AS DOUBLE) AS threshold, (SELECT count(*) FROM records) AS record_count, count(*) AS candidate_count, count(DISTINCT status) AS cluster_count, 'completed' AS status FROM decided"
    ),
    "src5_newest_rows": "SELECT ext_id AS _id, seq FROM feed WHERE source = 'fed_grants' ORDER BY TRY_CAST(trim(ext_id) AS BIGINT) DESC NULLS LAST, ext_id LIMIT 500",
    "st1_unseen_rows": (
        "SELECT source, ext_id AS _id, seq FROM feed f WHERE batch_id NOT IN ('b0', 'b1') AND NOT EXISTS (SELECT 1 FROM feed s WHERE s.batch_id IN ('b0', 'b1') AND s.source = f.source AND s.ext_id = f.ext_id)"
    ),
    "st2_source_state": (
        "SELECT source AS name, '2024-01-04 00:00:00' AS last_run_at, max(TRY_CAST(trim(ext_id) AS BIGINT)) FILTER (WHERE batch_id = 'b3') AS last_cursor, count(*) AS rows_fetched_total FROM feed GROUP BY 1"
    ),
    "st3_valid_rows": "SELECT source, ext_id AS external_id, seq, batch_id AS _batch_id FROM checked WHERE e1 IS NULL AND e2 IS NULL",
    "st4_row_hash": (
        "SELECT seq, 'b' AS _batch_id, sha256('{\"BN\":\"' || org_bn || '\",\"_id\":\"' || ext_id || '\",\"seq\":' || seq || '}') AS _row_hash FROM checked WHERE source = 'cra_t3010' AND e1 IS NULL AND e2 IS NULL"
    ),
    "st5_quarantine": (
        "SELECT batch_id, source, ext_id AS external_id, concat_ws('; ', e1, e2) AS error, CAST(seq AS VARCHAR) AS seq FROM checked WHERE e1 IS NOT NULL OR e2 IS NOT NULL"
    ),
    "st6_batch_ledger": (
        "SELECT batch_id, source, count(*) AS raw_row_count, count(*) FILTER (WHERE e1 IS NULL AND e2 IS NULL) AS valid_row_count, "
        "count(*) FILTER (WHERE e1 IS NOT NULL OR e2 IS NOT NULL) AS quarantined_row_count FROM checked GROUP BY 1, 2"
    ),
    "st7_findings_fed_grants": f"SELECT {_FINDING} FROM finding_rows WHERE source = 'fed_grants'",
    "st7_findings_cra_donees": f"SELECT {_FINDING} FROM finding_rows WHERE source = 'cra_donees'",
    "st9_list_findings": (
        "SELECT ring_id, trigger_external_id, severity FROM finding_rows WHERE source = 'fed_grants' AND CAST(trigger_external_id AS BIGINT) >= 600 "
        "ORDER BY CAST(trigger_external_id AS BIGINT) DESC, ring_id LIMIT 50"
    ),
    "st9_count_findings": "SELECT count(*) AS n FROM finding_rows WHERE source = 'cra_donees'",
    "st10_finding_labels": (
        "SELECT source, ring_id, CASE severity WHEN 'urgent' THEN '🔴' ELSE '🟡' END || ' Federal grants · $' || " + _dollars("total_amount") + " || ' · ' || array_to_string(nm[1:2], ', ') || "
        "CASE WHEN len(nm) > 2 THEN ' (+' || (len(nm) - 2) || ' more)' ELSE '' END AS label FROM (SELECT f.source, f.ring_id, f.severity, f.total_amount, "
        "coalesce(w.nms, list_transform(f.idl[1:3], lambda e: 'Entity ' || e)) AS nm FROM finding_rows f LEFT JOIN warm w USING (ring_id) WHERE f.source = 'fed_grants')"
    ),
    "st10_rings_from_findings": (
        "SELECT f.ring_id, w.ring_type, array_to_string(coalesce(w.ids, f.idl), ',') AS entity_ids, array_to_string(coalesce(w.nms, list_transform(f.idl, lambda e: 'Entity ' || e)), ',') AS canonical_names, "
        "f.total_amount, f.finding_type AS flags FROM finding_rows f LEFT JOIN warm w USING (ring_id) WHERE f.source = 'fed_grants'"
    ),
    "st11_live_summary": (
        "SELECT count(*) AS findings, count(*) FILTER (WHERE severity = 'urgent') AS urgent, (SELECT count(DISTINCT source) FROM feed) AS active_sources, "
        "(SELECT CAST(TIMESTAMP '1970-01-01' + to_seconds(max(seq)) AS VARCHAR) FROM feed) AS last_run_at FROM finding_rows WHERE source = 'fed_grants'"
    ),
    "cd1_dossier_entities": (
        "WITH s AS (SELECT entity_id, count(*) AS links, list(DISTINCT source_schema) AS sc FROM entity_source_links GROUP BY 1) SELECT r.ring_id, e.id AS entity_id, e.canonical_name, "
        "coalesce(e.entity_type, 'unknown') AS entity_type, upper(replace(e.dataset_sources_csv, ',', ', ')) AS datasets, coalesce(s.links, e.source_link_count, 0) AS source_links, "
        "concat_ws(', ', CASE WHEN list_contains(sc, 'cra') THEN 'CRA' END, CASE WHEN list_contains(sc, 'fed') THEN 'FED' END, CASE WHEN list_contains(sc, 'ab') THEN 'AB' END, "
        "CASE WHEN len(sc) > 1 THEN 'multi-source' END, CASE WHEN list_contains(sc, 'fed') THEN 'live-triggered' END, 'cycle-member') AS badges "
        "FROM party_rows r JOIN entity_golden_records e ON e.id = r.entity_id LEFT JOIN s ON s.entity_id = r.entity_id"
    ),
    "cd2_dossier_header": (
        "SELECT r.ring_id, coalesce(CAST(l.total_flow AS DOUBLE), r.total_amount) AS cycle_flow, coalesce(l.hops, 0) AS hops, l.min_year, l.max_year FROM party_rings r LEFT JOIN loops l ON 'cra-cycle-' || l.id = r.ring_id"
    ),
    "cd3_crossover_totals": (
        "SELECT count(*) AS pair_count, CAST(sum(CAST(total_grant_amount AS DECIMAL(28,2))) AS DOUBLE) AS total_grants, CAST(sum(CAST(total_contract_amount AS DECIMAL(28,2))) AS DOUBLE) AS total_contracts, "
        "(SELECT count(DISTINCT p) FROM (SELECT unnest(people) AS p FROM crossover)) AS distinct_directors FROM crossover"
    ),
    "cd3_crossover_selector": (
        f"SELECT charity_entity_id, contractor_entity_id, charity_name || ' ↔ ' || contractor_name || ' · $' || {_dollars('total_contract_amount')} || ' contract' AS label FROM crossover "
        "ORDER BY total_contract_amount DESC, total_grant_amount DESC, 1, 2 LIMIT 50"
    ),
    "cd4_ring_split": "SELECT ring_id, ring_type = 'round_trip' AS round_trip, len(persons) > 0 AS has_shared_person FROM party_rings",
    "fn01_director_norm": f"SELECT DISTINCT first_name, last_name, {_norm('first_name', 'last_name')} AS director_name_normalized FROM cra_directors",
    "fn02_director_simple": "SELECT DISTINCT director_norm FROM simple_names",
    "fn03_bn_left": "SELECT left(donee_bn, 9) AS bn_root, count(*) AS gifts FROM cra_qualified_donees GROUP BY 1",
    "fn04_normalize_bn": f"SELECT seq, {_bn('org_bn')} AS bn FROM feed",
    "fn05_bn_root": (
        f"SELECT id, {_root('v')} AS root FROM (SELECT id, CASE WHEN id % 3 = 0 THEN left(bn_root, 1) || '00000000 RR' || right(bn_root, 4) ELSE bn_variants[1] END AS v FROM entity_golden_records)"
    ),
    "fn06_normalize_name": f"SELECT {_name('source_name')} AS name, count(*) AS n FROM entity_source_links GROUP BY 1",
    "fn07_clean_name": (
        f"SELECT raw, {_clean('raw')} AS cleaned FROM (SELECT CASE WHEN id % 2 = 0 THEN canonical_name || ' / Fondation ' || canonical_name ELSE canonical_name END AS raw FROM entity_golden_records UNION "
        "SELECT source_name FROM entity_source_links WHERE source_name IS NOT NULL)"
    ),
    "fn08_row_hash": "SELECT id, sha256('{\"amount\":' || amount || ',\"id\":\"' || id || '\"}') AS row_hash FROM ab_contracts",
    "fn09_stable_id": "SELECT id, left(md5(concat_ws('::', canonical_name, bn_root, entity_type)), 16) AS stable_id FROM entity_golden_records",
    "fn10_address_field": "SELECT id, city, province, postal FROM address_fields",
    "fn11_alias_text": "SELECT id, alias, string_alias FROM alias_items",
    "fn12_filing_row_id": f"SELECT {_RID.format(a='d')} AS row_id, count(*) AS n FROM cra_directors d GROUP BY 1",
    "fn13_safe_ratio": (
        "SELECT c.bn, CAST(c.fpe AS VARCHAR) AS fpe, CASE WHEN f.field_5100 <> 0 THEN CAST((CAST(c.field_390 * 100 AS BIGINT) * 2000 + CAST(f.field_5100 * 100 AS BIGINT)) // (2 * CAST(f.field_5100 * 100 AS BIGINT)) AS DOUBLE) / 10 END AS pct "
        "FROM cra_compensation c JOIN cra_financial_details f USING (bn, fpe)"
    ),
    "fn14_year": "SELECT year(fpe) AS year, CAST(sum(total_gifts) AS DOUBLE) AS gifts FROM cra_qualified_donees GROUP BY 1",
    "fn15_row_json": "SELECT '{\"id\":\"' || id || '\",\"amount\":' || amount || '}' AS row FROM ab_contracts",
    "fn16_json_field": "SELECT relationship_type, confidence_score, count(related_entity_id) AS n FROM related GROUP BY 1, 2",
    "fn17_parse_amount": "SELECT seq, coalesce(TRY_CAST(nullif(trim(amount_text), '') AS DOUBLE), 0.0) AS amount FROM feed",
    "fn18_probability_band": (
        "SELECT candidate_id, CASE WHEN match_probability >= 0.97 THEN 'Likely same (>=0.97)' WHEN match_probability >= 0.7 THEN 'Review (0.70-0.97)' ELSE 'Audit (<0.70)' END AS band, "
        "CASE WHEN match_probability >= 0.97 THEN 'likely_same' WHEN match_probability >= 0.7 THEN 'needs_review' ELSE 'audit' END AS status FROM review_candidates"
    ),
    "fn19_severity": (
        "SELECT _id, CASE WHEN coalesce(amendment_number, 0) < 1 THEN 'info' WHEN agreement_value * 4 >= 1000000 THEN 'urgent' ELSE 'review' END AS severity FROM grants_contributions"
    ),
    "fn20_narrative": (
        f"SELECT ring_id, {_story(chr(39) + 'fed_grants' + chr(39), 'total_amount / 2', 'nms[1]', chr(39) + '42' + chr(39), 'total_amount')} AS narrative FROM ring_names "
        "JOIN (SELECT 'cra-cycle-' || cycle_id AS ring_id, total_amount, ids FROM cycle_lists) USING (ring_id) WHERE len(ids) >= 2"
    ),
    "fn21_ring_type": (
        "SELECT CASE WHEN hops % 2 = 0 THEN 'shared_director' ELSE 'round_trip' END AS ring_type, count(*) AS n FROM loops GROUP BY 1 UNION ALL SELECT 'other', count(*) FROM entity_source_links"
    ),
    "fn22_severity_rank": (
        "SELECT severity, CAST(CASE severity WHEN 'urgent' THEN 0 WHEN 'review' THEN 1 ELSE 2 END AS BIGINT) AS rank, ring_id FROM (SELECT CASE WHEN coalesce(amendment_number, 0) < 1 THEN 'info' "
        "WHEN agreement_value * 4 >= 1000000 THEN 'urgent' ELSE 'review' END AS severity, agreement_start_date AS d, owner_org, CAST(_id AS VARCHAR) AS ring_id FROM grants_contributions) "
        "ORDER BY rank, d DESC, owner_org NULLS FIRST, ring_id LIMIT 1"
    ),
    "fn23_badges": (
        "SELECT entity_id, concat_ws(', ', CASE WHEN bool_or(source_schema = 'fed') THEN 'FED' END, CASE WHEN bool_or(source_schema = 'ab') THEN 'AB' END, "
        "CASE WHEN count(DISTINCT source_schema) > 1 THEN 'multi-source' END, CASE WHEN bool_or(source_schema = 'fed') THEN 'live-triggered' END, 'cycle-member') AS badges FROM entity_source_links GROUP BY 1"
    ),
    "fn24_jaro_winkler": (
        "WITH n AS (SELECT DISTINCT cleaned_name AS c, bn_root FROM profiles WHERE bn_root IS NOT NULL) SELECT DISTINCT a.c AS a, b.c AS b, round(jaro_winkler_similarity(a.c, b.c), 9) AS score FROM n a JOIN n b ON a.bn_root = b.bn_root AND a.c < b.c"
    ),
    "fn25_ring_ids": (
        "SELECT 'cra-cycle-' || id AS ring_id, id AS cycle_id, 'director-pair-jane-doe-' || hops || '-' || min_year AS pair_id FROM loops"
    ),
    "fn26_feed_keys": (
        f"SELECT ext_id AS external_id, seq, array_to_string(list_distinct_in_order, '+') AS numbers, nm AS name FROM (SELECT ext_id, seq, {_name('donee_name')} AS nm, "
        f"list_filter([{_bn('org_bn')}, CASE WHEN {_bn('org_bn')} IS DISTINCT FROM {_bn('donee_bn')} THEN {_bn('donee_bn')} END], lambda x: x IS NOT NULL) AS list_distinct_in_order FROM feed WHERE source = 'cra_donees')"
    ),
}


def oracle_sql() -> dict[str, str]:
    """Comparison SQL of the registered queries that SQL can express."""
    return {name: statement(body) for name, body in BODIES.items() if name in catalog.REGISTRY}
