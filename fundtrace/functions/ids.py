"""Business numbers and row, ring and record identifiers (FN3-FN5, FN8, FN9, FN12, FN25)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Numbers that stand for "no business number".
PLACEHOLDER_NUMBERS = [
    "000000000",
    "100000000",
    "200000000",
    "300000000",
    "400000000",
    "500000000",
    "600000000",
    "700000000",
    "800000000",
    "900000000",
    "320000000",
]

CYCLE_PREFIX = "cra-cycle-"
PAIR_PREFIX = "director-pair-"


def bn_left(bn: Column) -> Column:
    """First nine characters, uncleaned: the key the warehouse tables join on."""
    return F.left(bn, F.lit(9))


def normalize_bn(value: Column) -> Column:
    digits = F.regexp_replace(value.cast("string"), "[^0-9]", "")
    return F.when(F.length(digits) >= 9, F.left(digits, F.lit(9)))


def bn_root(value: Column) -> Column:
    root = normalize_bn(value)
    usable = ~root.isin(PLACEHOLDER_NUMBERS) & ~F.endswith(root, F.lit("00000000"))
    return F.when(usable, root)


def filing_row_id(bn: Column, fpe: Column, sequence: Column) -> Column:
    return F.concat_ws("|", bn, fpe.cast("string"), sequence.cast("string"))


def row_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    """SHA-256 of the row as JSON with its columns in name order and nulls kept."""
    names = sorted(columns or df.columns)
    return F.sha2(
        F.to_json(F.struct(*[F.col(f"`{n}`") for n in names]), {"ignoreNullFields": "false"}), 256
    )


def stable_id(*parts: Column) -> Column:
    kept = F.filter(F.array(*parts), lambda part: part.isNotNull() & (part != ""))
    return F.left(F.md5(F.array_join(kept, "::")), F.lit(16))


def cycle_ring_id(cycle_id: Column) -> Column:
    return F.concat(F.lit(CYCLE_PREFIX), cycle_id)


def pair_ring_id(name: Column, entity_a: Column, entity_b: Column) -> Column:
    return F.concat(
        F.lit(PAIR_PREFIX),
        F.replace(name, F.lit(" "), F.lit("-")),
        F.lit("-"),
        entity_a.cast("string"),
        F.lit("-"),
        entity_b.cast("string"),
    )


def cycle_id_of_ring(ring_id: Column) -> Column:
    return F.nullif(F.regexp_extract(ring_id, f"^{CYCLE_PREFIX}(.*)$", 1), F.lit(""))


def ring_type(explicit: Column, ring_id: Column) -> Column:
    known = F.lower(F.trim(explicit))
    return (
        F.when(known.isin("round_trip", "shared_director"), known)
        .when(F.startswith(ring_id, F.lit(CYCLE_PREFIX)), "round_trip")
        .when(F.startswith(ring_id, F.lit(PAIR_PREFIX)), "shared_director")
        .otherwise("other")
    )


def entity_label(name: Column, entity_id: Column) -> Column:
    """The canonical name, or ``Entity <id>`` where it is missing or blank."""
    return F.coalesce(
        F.nullif(name, F.lit("")), F.concat(F.lit("Entity "), entity_id.cast("string"))
    )
