"""All registered queries: importing the modules registers them."""

from litquarry.plans import aggregates, classify, comparisons, composites, ingest, listings, maintenance, quotes, ranking, relational, texts, upkeep  # noqa: F401
from litquarry.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
