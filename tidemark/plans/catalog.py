"""Every registered query of the memory engine, by name."""

from . import asked, flows
from .memory import oracle_sql, queries

__all__ = ["asked", "flows", "oracle_sql", "queries"]
