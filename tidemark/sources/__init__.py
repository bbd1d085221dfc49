"""Reading tables, and getting this package to the executors."""

from .session import ship
from .tables import read_table

__all__ = ["read_table", "ship"]
