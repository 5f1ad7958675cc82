"""All registered queries."""

from tabflow.plans import columns, learners, measures, pipelines, tables
from tabflow.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "columns", "learners", "measures", "pipelines", "tables"]
