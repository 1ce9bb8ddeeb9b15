"""Small hand-made warehouses."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from fundtrace import schemas
from fundtrace.sources.warehouse import Warehouse

D = dt.date(2023, 12, 31)


def frame(spark, table, data):
    return spark.createDataFrame(data, schemas.TABLES[table])


def golden(id, name, root, kind="charity", aliases=None, related=None, links=None, status="active"):
    return (id, name, kind, root, None, aliases, ["cra"], links, None, related, status)


def three_entities(spark) -> Warehouse:
    """Two charities giving to each other, a business, one director on all boards."""
    gift = Decimal
    return Warehouse(
        spark,
        {
            "entity_golden_records": frame(
                spark,
                "entity_golden_records",
                [
                    golden(1001, "Northern Pathways Community Society", "123456789"),
                    golden(1002, "Boreal Futures Network", "234567890"),
                    golden(1003, "Harwick Consulting Group", "345678901", kind="business"),
                ],
            ),
            "cra_directors": frame(
                spark,
                "cra_directors",
                [
                    (bn, D, 1, "Jennifer", "Harwick", None)
                    for bn in ("123456789", "234567890", "345678901")
                ],
            ),
            "cra_qualified_donees": frame(
                spark,
                "cra_qualified_donees",
                [
                    ("123456789", D, 4, "234567890", gift("142000")),
                    ("234567890", D, 7, "123456789", gift("37000")),
                ],
            ),
            "grants_contributions": frame(
                spark,
                "grants_contributions",
                [(88001, "r1", 0, "dept", gift("2100000"), dt.date(2023, 4, 1), "G")],
            ),
            "ab_sole_source": frame(
                spark,
                "ab_sole_source",
                [
                    ("u1", gift("300000"), dt.date(2023, 5, 15), "Harwick Consulting Group"),
                    ("u2", gift("87000"), dt.date(2023, 5, 16), "Harwick Consulting Group"),
                ],
            ),
            "entity_source_links": frame(
                spark,
                "entity_source_links",
                [
                    ("1", 1001, "fed", "grants_contributions", '{"_id": 88001}', None, "reviewed", 0.97),
                    ("2", 1002, "fed", "grants_contributions", '{"_id": 1}', None, "exact", 1.0),
                    ("3", 1003, "ab", "ab_sole_source", '{"id": "u1"}', None, "reviewed", 0.91),
                    ("4", 1003, "ab", "ab_sole_source", '{"id": "u2"}', None, "reviewed", 0.91),
                ],
            ),
            "loops": frame(
                spark,
                "loops",
                [("1", ["123456789RR0001", "234567890RR0001"], 2, gift("179000"), gift("37000"), 2023, 2023)],
            ),
            "loop_edges": frame(
                spark,
                "loop_edges",
                [
                    ("123456789RR0001", "234567890RR0001", gift("142000"), 2023, 2023),
                    ("234567890RR0001", "123456789RR0001", gift("37000"), 2023, 2023),
                ],
            ),
            "loop_participants": frame(
                spark, "loop_participants", [("123456789RR0001",), ("234567890RR0001",)]
            ),
        },
    )
