"""All registered queries of the library, by name, and the same results in DuckDB's SQL."""

from tarnflow.queries import data, features, ranking, similar, trained  # noqa: F401
from tarnflow.queries.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
