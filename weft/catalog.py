"""The registered queries over the tables, and their DuckDB oracles."""

from __future__ import annotations

from weft.plans import q_analysis, q_build, q_diagram, q_entities, q_graph, q_identity, q_memory, q_modules, q_projections, q_search, q_sources, q_streaming
from weft.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
_MODULES = (q_projections, q_build, q_identity, q_modules, q_entities, q_graph, q_analysis, q_diagram, q_search, q_memory, q_sources, q_streaming)
