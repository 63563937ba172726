"""All registered queries; importing the modules fills the registry."""

from ledgerwatch.catalog import cleaning, drift, lookups, models, monitoring, routing, statistics, streaming  # noqa: F401
from ledgerwatch.catalog.registry import all_checks, all_queries

__all__ = ["all_checks", "all_queries"]
