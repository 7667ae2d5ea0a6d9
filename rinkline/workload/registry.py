"""Registry of the queries that run over the order tables, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DateType, DoubleType, FloatType, IntegerType, ShortType

from rinkline.workload.league import League
from rinkline.workload.oracle_tables import with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DIGITS = 6


def query(sql: str | None = None, **extra: str):
    """Register ``fn(league)`` under its name; ``sql`` is the same result in DuckDB."""

    def add(fn: Callable[[League], DataFrame]):
        name = fn.__name__

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return tidy(fn(League(spark, folder)))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = with_tables(sql, extra)
        return fn

    return add


def tidy(df: DataFrame) -> DataFrame:
    """Comparable output: whole numbers as bigint, fractions rounded, dates as text."""
    out = []
    for f in df.schema:
        c = f"`{f.name}`"
        if isinstance(f.dataType, (DoubleType, FloatType)):
            out.append(f"round(cast({c} as double), {DIGITS}) as {c}")
        elif isinstance(f.dataType, (IntegerType, ShortType)):
            out.append(f"cast({c} as bigint) as {c}")
        elif isinstance(f.dataType, DateType):
            out.append(f"cast({c} as string) as {c}")
        else:
            out.append(c)
    return df.selectExpr(*out)


def rounded(*columns: str, prefix: str = "") -> str:
    """SQL select items rounding each column like ``tidy``."""
    return ", ".join(f"round({prefix}{c}, {DIGITS}) AS {c}" for c in columns)
