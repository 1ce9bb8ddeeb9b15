"""Name rules: directors (FN1, FN2), feed names (FN6), legal names (FN7), alias text (FN11)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separators between bilingual names, in the order they are tried.
BILINGUAL_SEPARATORS = [" │ ", " | ", "│", " / "]

# Markers that start a trailing trade name.
TRADE_MARKERS = [
    r"AKA",
    r"O\s*/\s*A",
    r"D\s*/\s*B\s*/\s*A",
    r"DBA",
    r"DOING\s+BUSINESS\s+AS",
    r"OPERATING\s+AS",
    r"TRADING\s+AS",
    r"TRADE\s+NAME\s+OF",
    r"FORMERLY",
    r"F\s*/\s*K\s*/\s*A",
]

# Legal forms removed from the end of a name.
LEGAL_FORMS = [
    "INCORPORATED",
    "INC",
    "LTD",
    "LIMITED",
    "CORP",
    "CORPORATION",
    "CO",
    "COMPANY",
    "SOCIETY",
    "FOUNDATION",
]

# A ring whose every member name holds one of these is a large institution.
LARGE_INSTITUTIONS = [
    "salvation army",
    "red cross",
    "united way",
    "toronto foundation",
    "vancouver foundation",
    "chimp",
    "charitable impact foundation",
    "community foundation",
    "canada foundation",
    "community chest",
]

TRADE_NAME_PATTERN = (
    r"(?i)\s*\b(?:ASSUMED(?:\s+NAME(?:\s+.*)?)?|(?:" + "|".join(TRADE_MARKERS) + r")(?:\s+.*)?)$"
)
LEGAL_FORM_PATTERN = r"(?i)(?:[\s,.\-]*\b(?:" + "|".join(LEGAL_FORMS) + r")[\s,.\-]*)+$"
EDGE_PUNCTUATION = r"^[ ,.\-]+|[ ,.\-]+$"


def director_norm(first: Column, last: Column) -> Column:
    """Sorted distinct tokens of two or more letters; accents and hyphens vanish, joining letters.

    The result is ``''`` when no token survives; callers decide whether that counts as a name.
    """
    raw = F.lower(F.concat(F.coalesce(first, F.lit("")), F.lit(" "), F.coalesce(last, F.lit(""))))
    tokens = F.filter(
        F.split(F.regexp_replace(raw, "[^a-z ]", ""), " "), lambda token: F.length(token) > 1
    )
    return F.array_join(F.sort_array(F.array_distinct(tokens)), " ")


def director_simple(first: Column, last: Column) -> Column:
    return F.lower(F.trim(F.concat_ws(" ", first, last)))


def full_name_present(*parts: Column) -> Column:
    return F.trim(F.concat_ws(" ", *parts)) != ""


def normalize_name(value: Column) -> Column:
    """Lower-case words of letters and digits; null when under three characters."""
    kept = F.regexp_replace(F.lower(value), "[^a-z0-9 ]", " ")
    tidy = F.trim(F.regexp_replace(kept, r"\s+", " "))
    return F.when(F.length(tidy) >= 3, tidy)


def clean_name(value: Column) -> Column:
    """Legal name without second language, trade name and legal form, in upper case."""
    first_part = value
    for separator in reversed(BILINGUAL_SEPARATORS):
        first_part = F.when(
            F.contains(value, F.lit(separator)), F.trim(F.substring_index(value, separator, 1))
        ).otherwise(first_part)
    no_trade = F.trim(F.regexp_replace(first_part, TRADE_NAME_PATTERN, ""))
    no_form = F.regexp_replace(
        F.regexp_replace(no_trade, EDGE_PUNCTUATION, ""), LEGAL_FORM_PATTERN, ""
    )
    bare = F.regexp_replace(no_form, EDGE_PUNCTUATION, "")
    return F.coalesce(F.upper(F.trim(F.regexp_replace(bare, r"\s+", " "))), F.lit(""))


def alias_text(alias: Column) -> Column:
    """Text of one alias held as a VARIANT: a string, or an object's name, alias or legal name."""

    def part(path: str) -> Column:
        return F.nullif(F.try_variant_get(alias, path, "string"), F.lit(""))

    return F.when(F.schema_of_variant(alias) == "STRING", part("$")).otherwise(
        F.coalesce(part("$.name"), part("$.alias"), part("$.legal_name"))
    )


def alias_string(alias: Column) -> Column:
    """Text of one alias only where it is a plain string."""
    return F.when(
        F.schema_of_variant(alias) == "STRING", F.try_variant_get(alias, "$", "string")
    )


def is_large_institution(name: Column) -> Column:
    found = F.lit(False)
    for term in LARGE_INSTITUTIONS:
        found = found | F.contains(F.lower(name), F.lit(term))
    return found


def all_large_institutions(names: Column) -> Column:
    return F.forall(names, is_large_institution)
