"""Query plans of the manifest curation engine: all of them, by name."""

from . import catalog_queries, contract_queries, curation_queries, reel_queries, score_queries, selector_queries, stream_queries, timeline_queries  # noqa: F401  (they register themselves)
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
