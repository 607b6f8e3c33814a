"""Registered queries of the corpus and their SQL."""

from . import more_queries, part_queries, stored_queries  # noqa: F401  register their queries
from .more_sql import MORE_SQL
from .part_sql import PART_SQL
from .queries import QUERIES
from .sql import ORACLE_SQL as FIRST_SQL
from .stored_sql import STORED_SQL

ORACLE_SQL = {**FIRST_SQL, **MORE_SQL, **STORED_SQL, **PART_SQL}

__all__ = ["ORACLE_SQL", "QUERIES"]
