"""All queries of the reference's operators and their SQL."""

from tallywright.plans import landed, refresh  # noqa: F401  (they add their queries)
from tallywright.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
