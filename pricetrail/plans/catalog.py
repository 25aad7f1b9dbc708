"""All registered queries."""

from pricetrail.plans import changelog, identity, ingest, markup, observed, replica, stored, streams  # noqa: F401
from pricetrail.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
