"""All registered queries and the SQL that gives the same rows."""

from lumisift.plans import articles, fixtures, prompting, retrieval, texts  # noqa: F401
from lumisift.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
