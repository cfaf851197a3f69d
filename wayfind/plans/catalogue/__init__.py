"""Catalogue of runnable queries over the test tables, one family per module."""

from wayfind.plans.catalogue import (  # noqa: F401  (importing registers the queries)
    graph_queries,
    maintenance_queries,
    ranking_queries,
    repository_queries,
    text_queries,
    usage_queries,
)
from wayfind.plans.catalogue.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
