"""All queries of the library proper, by name, and their SQL twins."""

from __future__ import annotations

from quernstone.plans import aggregate_queries, graph_queries, join_queries, tables_queries, text_queries, time_queries  # noqa: F401  they register themselves
from quernstone.plans.registry import ORACLES, QUERIES  # noqa: F401
