"""Importing this module registers every query."""

from opinara.plans import (  # noqa: F401
    catalog_curation,
    catalog_models,
    catalog_serving,
    catalog_sources,
    catalog_streaming,
    catalog_text,
)
from opinara.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
