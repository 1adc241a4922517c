"""Registered queries: a Spark callable per name and, where SQL can say it, the same query as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r(c: str | Column, digits: int = 6) -> Column:
    """Rounded double for comparison with SQL."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, integers widened to BIGINT."""
    out = []
    for c, t in df.dtypes:
        if t in ("double", "float"):
            out.append(F.round(F.col(c).cast("double"), digits).alias(c))
        elif t in ("int", "smallint", "tinyint"):
            out.append(F.col(c).cast("bigint").alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)
