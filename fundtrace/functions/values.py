"""Amounts, JSON fields, bands, scores and labels (FN10, FN13, FN16-FN20, FN22, FN23)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIKELY_SAME = 0.97
NEEDS_REVIEW = 0.70


def feed_number(value: Column) -> Column:
    """Number in a feed field, null where there is none. Java's forms 12d, 12f and 0x1p3 are none."""
    return F.when(~value.rlike(r"(?i)[0-9.][df]\s*$|0x"), value.try_cast("double"))


def parse_amount(value: Column) -> Column:
    """Number in a feed field; anything unreadable counts as zero."""
    return F.coalesce(feed_number(F.nullif(F.trim(value), F.lit(""))), F.lit(0.0))


def safe_ratio(part: Column, whole: Column) -> Column:
    return part / F.nullif(whole, F.lit(0).cast("decimal(18,2)"))


def json_first(document: Column, *paths: str) -> Column:
    return F.coalesce(*[F.get_json_object(document, path) for path in paths])


def json_array(document: Column, element: str) -> Column:
    """A JSON text as an array; a lone object is read as an array of one."""
    text = F.trim(document)
    listed = F.when(F.startswith(text, F.lit("{")), F.concat(F.lit("["), text, F.lit("]"))).otherwise(
        text
    )
    return F.from_json(listed, f"array<{element}>", {"mode": "PERMISSIVE"})


def address_field(addresses: Column, *keys: str) -> Column:
    """First address with a value under any of ``keys`` (letter case ignored), in upper case."""

    def value_under(address: Column, key: str) -> Column:
        named = F.filter(
            F.map_entries(address), lambda e: (F.lower(e["key"]) == F.lit(key)) & (e["value"] != "")
        )
        return F.get(named, 0)["value"]

    def value_of(address: Column) -> Column:
        return F.coalesce(*[value_under(address, key) for key in keys])

    values = F.transform(json_array(addresses, "map<string,string>"), value_of)
    return F.upper(F.trim(F.get(F.filter(values, lambda v: v.isNotNull()), 0)))


def probability_band(probability: Column) -> Column:
    return (
        F.when(probability >= LIKELY_SAME, "Likely same (>=0.97)")
        .when(probability >= NEEDS_REVIEW, "Review (0.70-0.97)")
        .otherwise("Audit (<0.70)")
    )


def candidate_status(probability: Column, explicit: Column | None = None) -> Column:
    banded = (
        F.when(probability >= LIKELY_SAME, "likely_same")
        .when(probability >= NEEDS_REVIEW, "needs_review")
        .otherwise("audit")
    )
    return banded if explicit is None else F.coalesce(F.nullif(explicit, F.lit("")), banded)


def severity(amount: Column, ring_count: Column) -> Column:
    return (
        F.when((ring_count >= 1) & (amount >= 1_000_000), "urgent")
        .when(ring_count >= 1, "review")
        .otherwise("info")
    )


def severity_rank(value: Column) -> Column:
    return (
        F.when(value == "urgent", 0).when(value == "review", 1).when(value == "info", 2).otherwise(3)
    )


def ring_score(amount: Column, has_shared_person: Column) -> Column:
    """Score of a ring from its amount and whether its members share a person (SC2)."""
    by_amount = (
        F.when(amount >= 1_000_000, 0.3)
        .when(amount >= 500_000, 0.2)
        .when(amount >= 100_000, 0.1)
        .otherwise(0.0)
    )
    total = F.lit(0.4) + by_amount + F.when(has_shared_person, 0.3).otherwise(0.0)
    return F.round(F.least(total, F.lit(1.0)), 10)


def finding_narrative(
    source: Column,
    amount: Column,
    trigger_name: Column,
    external_id: Column,
    ring_id: Column,
    ring_amount: Column,
    names: Column,
) -> Column:
    preview = F.concat(
        F.array_join(F.slice(names, 1, 3), ", "), F.when(F.size(names) > 3, "...").otherwise("")
    )
    return F.concat(
        source,
        F.lit(" disbursement of $"),
        F.format_number(amount, 0),
        F.lit(" to "),
        F.coalesce(trigger_name, F.lit("")),
        F.lit(" (external_id="),
        external_id,
        F.lit(") connects to ring "),
        ring_id,
        F.lit(" ($"),
        F.format_number(ring_amount, 0),
        F.lit(" flow across "),
        F.size(names).cast("string"),
        F.lit(" entities: "),
        preview,
        F.lit(")."),
    )


def source_badges(schemas: Column, finding_source: Column) -> Column:
    """Badges of one entity from the set of source schemas it is linked to."""

    def badge(condition: Column, text: str) -> Column:
        return F.when(condition, text)

    live = F.array_contains(schemas, F.lower(F.substring_index(finding_source, "_", 1)))
    return F.array_compact(
        F.array(
            badge(F.array_contains(schemas, "cra"), "CRA"),
            badge(F.array_contains(schemas, "fed"), "FED"),
            badge(F.array_contains(schemas, "ab"), "AB"),
            badge(F.size(schemas) > 1, "multi-source"),
            badge(live, "live-triggered"),
            F.lit("cycle-member"),
        )
    )
