"""Named queries over the given tables, with SQL checks where SQL can say the same."""

from incident_signals.catalog import (  # noqa: F401
    density_queries,
    extraction_queries,
    model_queries,
    pattern_queries,
    quality_queries,
    report_queries,
    similarity_queries,
    source_queries,
    temporal_queries,
    text_queries,
)
from incident_signals.catalog.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
