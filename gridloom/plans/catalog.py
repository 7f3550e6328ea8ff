"""The registered queries and their SQL for the check against DuckDB."""

from gridloom.plans import files, images, matching, statistics  # noqa: F401  they register their queries
from gridloom.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
