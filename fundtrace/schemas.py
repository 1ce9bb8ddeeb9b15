"""Declared schemas of the warehouse tables (DDL text, one entry per table)."""

from __future__ import annotations

TABLES: dict[str, str] = {
    "entity_golden_records": (
        "id bigint, canonical_name string, entity_type string, bn_root string, "
        "bn_variants array<string>, aliases string, dataset_sources array<string>, "
        "source_link_count bigint, addresses string, related_entities string, status string"
    ),
    "entity_source_links": (
        "id string, entity_id bigint, source_schema string, source_table string, "
        "source_pk string, source_name string, match_method string, match_confidence double"
    ),
    "cra_directors": (
        "bn string, fpe date, sequence_number bigint, first_name string, last_name string, "
        "initials string"
    ),
    "cra_qualified_donees": (
        "bn string, fpe date, sequence_number bigint, donee_bn string, total_gifts decimal(18,2)"
    ),
    "cra_non_qualified_donees": (
        "bn string, fpe date, cash_amount decimal(18,2), recipient_name string"
    ),
    "cra_compensation": "bn string, fpe date, field_390 decimal(18,2)",
    "cra_financial_details": "bn string, fpe date, field_5100 decimal(18,2)",
    "cra_identification": "bn string, fiscal_year int, legal_name string",
    "loops": (
        "id string, path_bns array<string>, hops int, total_flow decimal(28,2), "
        "bottleneck_amt decimal(28,2), min_year int, max_year int"
    ),
    "loop_edges": "src string, dst string, total_amt decimal(28,2), min_year int, max_year int",
    "loop_participants": "bn string",
    "grants_contributions": (
        "_id bigint, ref_number string, amendment_number bigint, owner_org string, "
        "agreement_value decimal(18,2), agreement_start_date date, agreement_type string"
    ),
    "agreement_current": (
        "_id bigint, ref_number string, amendment_number bigint, owner_org string, "
        "agreement_value decimal(18,2), agreement_start_date date, agreement_type string"
    ),
    "ab_grants": "id bigint, amount decimal(18,2), payment_date date",
    "ab_contracts": "id string, amount decimal(18,2)",
    "ab_sole_source": "id string, amount decimal(18,2), start_date date, vendor string",
    "lobby_registrations": (
        "registration_id string, first_name string, last_name string, client_bn string, "
        "department string, filed_on date"
    ),
    "lobby_contacts": (
        "contact_id string, first_name string, last_name string, client_bn string, "
        "department string, contacted_on date"
    ),
    "former_offices": "first_name string, last_name string, department string, ended_on date",
    "department_awards": (
        "award_id string, vendor_bn string, department string, awarded_on date, "
        "amount decimal(18,2), sole_source_reason string"
    ),
}

# Columns a deployment may lack; operators look for them before using them.
OPTIONAL_COLUMNS: dict[str, set[str]] = {"entity_golden_records": {"status"}}

EDGE_COLUMNS = [
    "from_entity_id",
    "to_entity_id",
    "amount",
    "date",
    "source",
    "source_row_id",
    "mapping_method",
    "confidence_score",
]

FEED = (
    "_id string, recipient_legal_name string, recipient_business_number string, "
    "agreement_value string, BN string, `Donee BN` string, `Donee Name` string, "
    "`Total Gifts` string"
)

# What the stream adds to the ledger and to findings: where the rows came from.
PROVENANCE = "resource_id string, source_url string, fetched_at timestamp"

FINDING = (
    "source string, finding_type string, entity_ids array<bigint>, ring_id string, "
    "trigger_external_id string, narrative string, total_amount double, severity string, "
    "batch_id string, trigger_row_hash string, mapping_method string, confidence_score double, "
    f"review_status string, created_at timestamp, {PROVENANCE}"
)

ALIAS_OVERRIDE = "alias_norm string, entity_id bigint, confidence double"
SURVIVOR_OVERRIDE = "duplicate_entity_id bigint, survivor_entity_id bigint, confidence double"
