"""All registered queries of the library's own operators."""

from __future__ import annotations

from granary.plans import edge_queries, evaluation_queries, io_queries, record_queries, routing_queries, shape_queries, stream_queries, table_queries, text_queries, verdict_queries  # noqa: F401
from granary.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
