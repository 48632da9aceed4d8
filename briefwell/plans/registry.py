"""The registry of queries: a name, a Spark form, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..config import TITLE_STOPWORDS
from .adapters import ARTICLES_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, over: str = "a") -> Callable[[Query], Query]:
    """Register a query by its function's name; ``sql`` may read the CTE of articles."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            head = f"WITH RECURSIVE {ARTICLES_SQL}" if over == "a" else ""
            whole = f"{head}{', ' if head and sql.lstrip().startswith('+') else ' '}{sql.lstrip().lstrip('+')}".strip()
            ORACLE_SQL[f.__name__] = whole.replace("$STOPWORDS", str(TITLE_STOPWORDS))
        return f

    return add
