"""All registered queries but those of the llm package."""

from __future__ import annotations

from .plans import answers, chunks, enrich, graphs, relations, retrieval, surveyed, tokens  # noqa: F401  registration
from .plans.base import ORACLES, QUERIES

FLAGSHIP = "m14_hybrid_retrieval"
__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
