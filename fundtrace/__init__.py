"""Set-based Spark jobs that analyse public funding and governance networks."""

from fundtrace.sources.warehouse import Warehouse

__all__ = ["Warehouse"]
