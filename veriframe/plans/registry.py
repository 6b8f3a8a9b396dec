"""Where query modules put their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def whole_numbers_wide(df: DataFrame) -> DataFrame:
    """Counts and sizes as bigint, whatever function made them."""
    return df.select(*[F.col(f"`{c}`").cast("bigint").alias(c) if kind in ("int", "smallint", "tinyint") else F.col(f"`{c}`") for c, kind in df.dtypes])


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its operator's id, and the SQL that gives its rows where SQL can."""

    def put(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: whole_numbers_wide(f(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return f

    return put
