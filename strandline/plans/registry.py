"""All queries of the library and their DuckDB SQL."""

from . import association_queries, cut_queries, footprint_queries, model_queries, motif_queries, relation_queries, set_queries, signal_queries, tool_queries, triplex_queries  # noqa: F401  (register their queries)
from .catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
