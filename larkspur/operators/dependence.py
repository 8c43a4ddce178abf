"""Dependence curves: what a scorer predicts for every row when one column is set to each value of a grid.

Rows and grid make one frame that is scored in a single pass; individual curves have a row for each key and
grid value, and their means by grid value are the partial dependence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.frame import quoted
from larkspur.operators.categorical import numbered
from larkspur.operators.datetimes import change_part

OTHER = "<OTHER>"
LEVELS = {"year": F.year, "month": F.month, "dayofweek": F.weekday}


def number_grid(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """place, value and n: the middles of equal-width bins over the column's values, and the rows in each; nulls and NaN are in none."""
    v = F.col(quoted(column)).cast("double")
    known = df.filter(v.isNotNull() & ~F.isnan(v)).select(v.alias("v"))
    ends = known.agg(F.min("v").alias("low"), F.max("v").alias("high")).filter("low is not null")
    width = (F.col("high") - F.col("low")) / bins
    grid = ends.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.col("low") + (k + 0.5) * width)).alias("place", "value"))
    place = F.least(F.floor(F.coalesce(F.try_divide(F.col("v") - F.col("low"), width), F.lit(0.0))), F.lit(bins - 1)).cast("int")
    counts = known.join(F.broadcast(ends)).groupBy(place.alias("at")).agg(F.count("*").alias("n"))
    return grid.join(counts, F.col("place") == F.col("at"), "left").select("place", "value", F.coalesce("n", F.lit(0)).alias("n"))


def category_grid(df: DataFrame, column: str, top: int = 10) -> DataFrame:
    """place, value and n: the commonest values, ties by value, and, if there are more, all others together as ``OTHER``."""
    counts = df.filter(F.col(quoted(column)).isNotNull()).groupBy(F.col(quoted(column)).cast("string").alias("value")).agg(F.count("*").alias("n"))
    first = counts.orderBy(F.desc("n"), "value").limit(top)
    rows = first.orderBy(F.desc("n"), "value").agg(F.collect_list(F.struct("n", "value")).alias("x")).select(F.posexplode(F.array_sort("x", lambda a, b: F.when(a["n"] != b["n"], F.when(a["n"] > b["n"], -1).otherwise(1)).when(a["value"] < b["value"], -1).otherwise(1))).alias("place", "x"))
    named = rows.select("place", "x.value", "x.n")
    rest = counts.join(F.broadcast(named.select("value")), "value", "left_anti").agg(F.sum("n").alias("n")).filter("n is not null")
    return named.unionByName(rest.select(F.lit(top).alias("place"), F.lit(OTHER).alias("value"), "n"))


def date_grid(df: DataFrame, column: str, level: str = "year") -> DataFrame:
    """place, value and n: the years that occur, or all months or days of the week, with the rows that have them."""
    counts = df.filter(F.col(quoted(column)).isNotNull()).groupBy(LEVELS[level](quoted(column)).alias("value")).agg(F.count("*").alias("n"))
    if level == "year":
        grid = counts.select("value", F.col("value").alias("place"), "n")
    else:
        first, last = (1, 12) if level == "month" else (0, 6)
        every = df.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("value"))
        grid = every.join(counts, "value", "left").select("value", F.col("value").alias("place"), F.coalesce("n", F.lit(0)).alias("n"))
    return grid.select("place", "value", "n")


def others(df: DataFrame, keys: list[str], column: str, grid: DataFrame, seed: int = 42) -> DataFrame:
    """keys and other_: for each row a value that isn't in the grid, drawn with replacement as often as it occurs."""
    value = F.col(quoted(column))
    outside = df.filter(value.isNotNull()).join(F.broadcast(grid.select(F.col("value").alias("in_"))), value.cast("string") == F.col("in_"), "left_anti")
    listed = numbered(outside.select(*map(quoted, keys), value.alias("other_")), [*keys, "other_"], "number_").select("number_", "other_")
    n = listed.count()
    if not n:
        return df.select(*map(quoted, keys), value.alias("other_")).limit(0)
    return df.select(*map(quoted, keys), (F.pmod(F.xxhash64(F.lit(seed), *map(quoted, keys)), F.lit(n)) + 1).cast("int").alias("number_")).join(listed, "number_").drop("number_")


def individual_curves(df: DataFrame, keys: list[str], column: str, grid: DataFrame, score: Callable[[DataFrame], DataFrame], level: str | None = None, seed: int = 42) -> DataFrame:
    """keys, place, value, n (of the grid) and p: every row scored at every grid value.

    ``score`` adds p to a frame with the columns of ``df``. For dates ``level`` tells what part of the date the grid changes.
    Keys name a row. Rows with a null in the column are set to the grid's values like others, but keep a null date.
    """
    kind = dict(df.dtypes)[column]
    spread = df.crossJoin(F.broadcast(grid.select("place", "value", "n").withColumnsRenamed({"place": "place_", "value": "value_", "n": "n_"})))  # at most a few dozen rows
    if level is not None:
        spread = spread.withColumn(column, change_part(F.col(quoted(column)), level, F.col("value_")).cast(kind))
    elif kind == "string":
        if grid.filter(F.col("value") == OTHER).isEmpty():
            spread = spread.withColumn(column, F.col("value_"))
        else:
            drawn = others(df, keys, column, grid.filter(F.col("value") != OTHER), seed)
            spread = spread.join(drawn, keys).withColumn(column, F.when(F.col("value_") == OTHER, F.col("other_")).otherwise(F.col("value_"))).drop("other_")
    else:
        spread = spread.withColumn(column, F.col("value_").try_cast(kind))
    return score(spread).select(*map(quoted, keys), F.col("place_").alias("place"), F.col("value_").alias("value"), F.col("n_").alias("n"), "p")


def dependence(curves: DataFrame) -> DataFrame:
    """place, value, n, mean and spread of the predictions at each grid value."""
    return curves.groupBy("place", "value").agg(F.max("n").alias("n"), F.avg("p").alias("mean"), F.stddev_pop("p").alias("spread"))
