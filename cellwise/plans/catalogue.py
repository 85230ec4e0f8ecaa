"""All queries of the ensemble statistics, by name."""

from cellwise.plans import cases, drawn, inference, inventory, preparation, statistics, summaries
from cellwise.plans.registry import QUERIES, SQL

__all__ = ["FLAGSHIP", "QUERIES", "SQL", "cases", "drawn", "inference", "inventory", "preparation", "statistics", "summaries"]
FLAGSHIP = "point_lambda"
