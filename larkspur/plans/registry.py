"""The registered queries: each applies one operator to the synthetic tables, beside the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name; ``sql`` is the same query for the oracle, where SQL can express it."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, and -0.0 made 0.0, so that the order of a sum doesn't show.

    The scaled double is rounded, not its shortest decimal form, as the oracle's round() does.
    """
    floating, scale = {"double", "float"}, F.lit(10.0**digits)
    return df.select(*[(F.round(F.col(f"`{c}`") * scale) / scale + 0.0).alias(c) if t in floating else F.col(f"`{c}`") for c, t in df.dtypes])


def every(column: str, n: int) -> Column:
    """Every n-th key by remainder."""
    return F.pmod(F.col(column), F.lit(n)) == 0
