"""Queries over the driver's tables and their SQL."""

from gapwise.plans import queries_faults, queries_models, queries_periodic, queries_relational, queries_reports, queries_rules, queries_scores, queries_segments  # noqa: F401
from gapwise.plans.registry import QUERIES, SQL  # noqa: F401
