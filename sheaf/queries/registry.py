"""Where queries are entered by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Enter a function (spark, sf_dir) under its own name."""

    def enter(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return enter


def columns(name: str, source: Callable[[SparkSession, str], DataFrame] | str, sql_from: str, keys: list[str], /, **pairs: tuple[Column, str]) -> None:
    """Enter a projection: each output column as a Spark expression and as SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source) if isinstance(source, str) else source(spark, sf_dir)
        return df.select(*keys, *[c().alias(n) if callable(c) and not isinstance(c, Column) else c.alias(n) for n, (c, _) in pairs.items()])

    run.__name__ = name
    QUERIES[name] = run
    SQL[name] = f"SELECT {', '.join([*keys, *(f'{s} AS {n}' for n, (_, s) in pairs.items())])} FROM {sql_from}"


def joined(a) -> Column:
    """An array as text, so that results compare as plain values."""
    return F.array_join(F.transform(a, lambda x: x.cast("string")), ",", "null")
