"""Column expressions shared by the operators that use built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space that separates words, and a character class of everything else.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, also where lambdas of the body use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words of a text as an array; empty for null."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE)
    return F.filter(parts, lambda w: w != "")


# Long arrays are built in blocks of so many items, for appending copies what is there.
BLOCK = 128


def folded(items: Column, at: Column, kind: str, step, pack=None) -> Column:
    """``aggregate`` that appends to an array: ``step(acc, item)`` over ``items`` with acc = struct<at, out>.

    ``kind`` is the type of ``out``'s items. Blocks are folded one after the other, each beginning at the ``at`` the one
    before ended with, so n items cost n * (BLOCK + n / BLOCK) copies instead of n * n. The result is struct<at, out>,
    ``out`` with one entry a block: its array, or ``pack`` of it.
    """
    packed = kind if pack is joined else f"array<{kind}>"
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / BLOCK).cast("int") - 1, F.lit(0))), lambda i: F.slice(items, i * BLOCK + 1, BLOCK))
    begin = F.struct(at.alias("at"), F.array().cast(f"array<{packed}>").alias("out"))

    def block(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc["at"].alias("at"), F.array().cast(f"array<{kind}>").alias("out")), step)
        return let(inner, lambda one: F.struct(one["at"].alias("at"), F.concat(acc["out"], F.array(pack(one["out"]) if pack else one["out"])).alias("out")))

    return F.aggregate(blocks, begin, block)


def joined(out: Column) -> Column:
    return F.array_join(out, "")


def occurrences(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, value>>, offsets in code points.

    The text is split at the matches: where match i starts is the length of what stands before it, which is
    the first i + 1 pieces between matches and the first i matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)

    def placed(both: Column) -> Column:
        values, between = both["values"], both["gaps"]

        def step(acc: Column, one: Column) -> Column:
            begin = acc["at"] + one["gap"]
            end = begin + F.length(one["value"])
            span = F.struct(begin.alias("start"), end.alias("end"), one["value"].alias("value"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        pairs = F.zip_with(values, F.slice(between, 1, F.size(values)), lambda v, g: F.struct(v.alias("value"), g.alias("gap")))
        return F.flatten(folded(pairs, F.lit(0), "struct<start:int,end:int,value:string>", step)["out"])

    return let(F.struct(found.alias("values"), gaps.alias("gaps")), placed)
