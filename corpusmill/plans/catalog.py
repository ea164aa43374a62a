"""All named queries of the engine."""

from . import more_queries, upkeep_queries  # noqa: F401
from .queries import FLAGSHIP, ORACLE_SQL, QUERIES

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
