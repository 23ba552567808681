"""Named queries over the tables, with their SQL."""

from . import more, pgcatalog, texts, views  # noqa: F401  register their queries
from .catalogue import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
