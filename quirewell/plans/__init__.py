"""The registered queries and their SQL."""

from . import concepts, found, kept, more, streams  # noqa: F401  register their queries
from .catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
