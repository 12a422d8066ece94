"""All queries of this library by name, and SQL of equal meaning where there is one."""

from fluxcell.plans import graph_queries, matrix_queries, model_queries, stats_queries

_MODULES = (matrix_queries, graph_queries, stats_queries, model_queries)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
