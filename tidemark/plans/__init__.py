"""Every operator as a query over the driver's tables."""

from tidemark.plans import documents, state  # noqa: F401  they register their queries
from tidemark.plans.catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
