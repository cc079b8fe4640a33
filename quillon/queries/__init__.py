"""A query for each operator over the driver's tables, with DuckDB SQL for the same rows where SQL can express it."""

from . import agentplane, relational, retrieval, sqlplane, stateplane, textplane

PLANES = (retrieval, textplane, sqlplane, relational, agentplane, stateplane)

QUERIES = {k: v for m in PLANES for k, v in m.REGISTRY.queries.items()}
ORACLE_SQL = {k: v for m in PLANES for k, v in m.REGISTRY.sql.items()}
