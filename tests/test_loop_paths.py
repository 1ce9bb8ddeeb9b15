"""Loop search keeps node ids alone; amounts and years come from the gifts of the loops found."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from fundtrace.operators import cycles


def _gifts(spark):
    edges = [("a", "b", 10, 1999), ("b", "a", 7, 2001), ("b", "c", 5, 1998), ("c", "a", 4, 2003), ("a", "b", 2, 2000), ("d", "a", 9, 1990)]
    data = [(s, d, Decimal(n), dt.date(y, 1, 1)) for s, d, n, y in edges]
    return spark.createDataFrame(data, "bn string, donee_bn string, total_gifts decimal(18,2), fpe date")


def test_loops_have_the_amounts_and_years_of_their_gifts(spark):
    found = cycles.detect(_gifts(spark), None)
    got = {r["id"]: (r["hops"], r["total_flow"], r["bottleneck_amt"], r["min_year"], r["max_year"]) for r in found["loops"].collect()}
    assert got == {
        "a-b": (2, Decimal("19.00"), Decimal("7.00"), 1999, 2001),
        "a-b-c": (3, Decimal("21.00"), Decimal("4.00"), 1998, 2003),
    }


def test_paths_and_pruned_edges_carry_ids_only(spark):
    pruned = cycles.prune(cycles.gift_graph(_gifts(spark), None), goes_on=0)
    assert pruned.columns == ["src", "dst"]
    _, numbered = cycles.numbered(pruned)
    two = cycles._grow(cycles._first(numbered, "src", "dst"), numbered, "src", "dst", 1)
    assert two.columns == ["start", "v1", "v2"]
