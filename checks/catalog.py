"""All registered queries."""

from checks import (  # noqa: F401
    location_queries,
    page_queries,
    review_queries,
    run_queries,
    stream_queries,
)
from checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
