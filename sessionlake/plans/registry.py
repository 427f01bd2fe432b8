"""All registered queries: importing the modules registers theirs."""

from sessionlake.plans import roundtrip, streams  # noqa: F401
from sessionlake.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
