"""All registered queries."""

from surveyloom.plans import q_models, q_stats, q_tables  # noqa: F401
from surveyloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
