"""Features of ordered series: lags, differences, windows, horizons, gaps, trend.

A window needs the rows of one series in order in one task. Series are told apart by a key, which
should be as fine as the data allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def ordered(by: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def lags(df: DataFrame, by: list[str], order: list[str], columns: list[str], count: int = 10, history: int | None = None) -> DataFrame:
    """``lag_<i>__<c>``, i = 0 being the row itself; lags of ``history`` and more are left out."""
    w = ordered(by, order)
    n = min(count, history) if history else count
    return df.withColumns({f"lag_{i}__{c}": F.lag(c, i).over(w) if i else F.col(c) for c in columns for i in range(n)})


def differences(df: DataFrame, by: list[str], order: list[str], columns: list[str], count: int = 10, with_zero: bool = True) -> DataFrame:
    """``diff_<i>__<c>``: the row's value less that of i rows before; i = 0 is the value itself."""
    w = ordered(by, order)
    made = {f"diff_{i}__{c}": F.col(c) - F.lag(c, i).over(w) for c in columns for i in range(1, count)}
    return df.withColumns(({f"diff_0__{c}": F.col(c) for c in columns} if with_zero else {}) | made)


def horizon(df: DataFrame, by: list[str], order: list[str], column: str, steps: int) -> DataFrame:
    """``<c>_plus_<i>``: the value i rows later, for i = 1 to ``steps``; null past the end."""
    w = ordered(by, order)
    return df.withColumns({f"{column}_plus_{i}": F.lead(column, i).over(w) for i in range(1, steps + 1)})


def windows(df: DataFrame, by: list[str], order: list[str], column: str, size: int, step: int = 1, from_last: bool = True, name: str = "window") -> DataFrame:
    """Rows that end a full window of ``size`` values, with the values; every ``step``-th, counted from the last row or the first."""
    w = ordered(by, order)
    place, whole = F.row_number().over(w), F.count("*").over(Window.partitionBy(*by))
    values = F.collect_list(F.struct(column)).over(w.rowsBetween(1 - size, 0))
    anchor = F.col("all_") - F.col("place_") if from_last else F.col("place_") - size
    out = df.withColumns({"place_": place, "all_": whole, name: values})
    return out.filter((F.col("place_") >= size) & (F.pmod(anchor, F.lit(step)) == 0)).withColumn(name, F.transform(name, lambda x: x[column])).drop("place_", "all_")


def segments(df: DataFrame, by: list[str], time: str, step_seconds: float | None = None, step_months: int | None = None, least: int = 0, name: str = "segment") -> DataFrame:
    """Number of the gap-free run that a row belongs to, from 0; runs of at most ``least`` rows are dropped."""
    w = ordered(by, [time])
    before = F.lag(time).over(w)
    if step_months:
        expected = F.add_months(before, step_months)
        gap = expected.cast("timestamp") != F.col(time).cast("timestamp")
    else:
        gap = (F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) != int(step_seconds * 1e6)
    out = df.withColumn("gap_", F.coalesce(gap.cast("int"), F.lit(0))).withColumn(name, F.sum("gap_").over(w).cast("int")).drop("gap_")
    return out.withColumn("n_", F.count("*").over(Window.partitionBy(*by, name))).filter(F.col("n_") > least).drop("n_")


def median_of(values: Column) -> Column:
    """Median of an array of numbers."""
    ordered_ = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    return F.transform(F.array(ordered_), lambda a: F.when(F.size(a) > 0, (F.element_at(a, F.floor((F.size(a) + 1) / 2).cast("int")) + F.element_at(a, F.floor(F.size(a) / 2).cast("int") + 1)) / 2))[0]


def rolling_median(df: DataFrame, by: list[str], order: list[str], column: str, size: int, name: str = "trend") -> DataFrame:
    """Median of the last ``size`` values; before there are so many, the first such median."""
    w = ordered(by, order)
    frame = w.rowsBetween(1 - size, 0)
    full = F.when(F.count("*").over(frame) == size, median_of(F.collect_list(column).over(frame)))
    out = df.withColumn("full_", full)
    later = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return out.withColumn(name, F.coalesce("full_", F.first("full_", ignorenulls=True).over(later))).drop("full_")


def level_shift(df: DataFrame, by: list[str], order: list[str], column: str, size: int, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """by and shift: the largest change of median between neighbouring windows, over the range of quantiles."""
    w = ordered(by, order)
    here, there = w.rowsBetween(1 - size, 0), w.rowsBetween(1, size)
    full = (F.count("*").over(here) == size) & (F.count("*").over(there) == size)
    out = df.withColumn("d_", F.when(full, F.abs(median_of(F.collect_list(column).over(there)) - median_of(F.collect_list(column).over(here)))))
    spread = F.percentile(column, F.array(F.lit(low), F.lit(high)))
    return out.groupBy(*by).agg(F.max("d_").alias("d_"), spread.alias("s_")).select(*by, F.try_divide("d_", F.col("s_")[1] - F.col("s_")[0]).alias("shift"))


def moving_average_trend(df: DataFrame, by: list[str], order: list[str], column: str, period: int, name: str = "trend") -> DataFrame:
    """Centred moving average over a period; an even period gives half weight to both ends. Null near the ends."""
    w = ordered(by, order)
    half = period // 2
    wide = w.rowsBetween(-half, half)
    whole = F.sum(column).over(wide)
    if period % 2 == 0:
        whole = whole - (F.lag(column, half).over(w) + F.lead(column, half).over(w)) / 2
    return df.withColumn(name, F.when(F.count("*").over(wide) == 2 * half + 1, whole / period))


def linear_trend(df: DataFrame, by: list[str], time: Column, column: str) -> DataFrame:
    """by, slope per day and intercept at the epoch."""
    days = F.unix_micros(time.cast("timestamp")) / F.lit(86_400_000_000.0)
    made = df.withColumn("days_", days)
    sums = [F.regr_slope(column, "days_").alias("slope"), F.regr_intercept(column, "days_").alias("intercept")]
    return made.groupBy(*by).agg(*sums) if by else made.agg(*sums)
