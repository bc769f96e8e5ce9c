"""All queries over the driver's tables, each beside its SQL. Modules register theirs with `query`."""

from __future__ import annotations

from tablewright.plans import extras, records, scalars, texts
from tablewright.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "extras", "records", "scalars", "texts"]
