"""All queries. Importing the modules registers them."""

from panelkit.plans import (  # noqa: F401
    baseline_queries,
    compare_queries,
    model_queries,
    panel_queries,
    quality_queries,
    relational_queries,
    store_queries,
)
from panelkit.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
