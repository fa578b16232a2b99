"""Registry of runnable queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.plans.fixtures import Fixtures
from ledgerloom.plans.tables_sql import with_tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Output types that compare exactly: decimals as doubles, dates and times as text."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(field.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.BooleanType)):
            c = c.cast("bigint")
        out.append(c.alias(field.name))
    return df.select(*out)


def query(name: str, sql: str | None = None, extra: dict[str, str] | None = None):
    """Register a function of :class:`Fixtures`, with its SQL when there is one.

    ``extra`` holds named tables the SQL uses besides the business tables.
    """

    def register(build: Callable[[Fixtures], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: plain(build(Fixtures(spark, folder)))
        if sql is not None:
            ORACLES[name] = with_tables(sql, extra)
        return build

    return register


def load() -> None:
    """Import every module that registers queries."""
    from ledgerloom.plans import (  # noqa: F401
        queries_audit,
        queries_derive,
        queries_functions,
        queries_ingest,
        queries_learning,
        queries_matching,
        queries_reports,
        queries_retrieval,
        queries_streaming,
    )
