"""All registered queries of this subpackage."""

from placelens.llm import document_queries, native_queries, structure_queries  # noqa: F401
from placelens.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
