"""Seasonal and trend decomposition by local regression (STL), over series cut in overlapping parts.

The inner loop smooths each place of the season over the cycles, takes the slow part out of it, and smooths
what is left to a trend. Every step looks at most some rows to either side, so a part of a series that has
enough rows of its neighbours on both edges gives the values that the whole series would: a long series
is many tasks. The outer loop gives rows with large remainders less weight; the size of a remainder is
measured against the median of its series, which is found over all parts between two passes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.frame import quoted
from larkspur.functions.ordered import quantiles
from larkspur.operators.validation import stratified_places
from larkspur.storage import stored

#: Rows of a part, without those of its neighbours.
PART_ROWS = 20_000


def odd(n: float) -> int:
    """The least odd number that isn't below n."""
    whole = int(np.ceil(n))
    return whole + 1 - whole % 2


def loess(y: np.ndarray, span: int, weight: np.ndarray, beyond: int = 0) -> np.ndarray:
    """Local straight lines through evenly spaced points, at each point and at ``beyond`` places before and after.

    A line is fitted to the ``span`` nearest points with tricube weights times ``weight``; with fewer points
    the reach grows by half of what is missing. Missing points have weight 0. A place where no point has a weight
    is interpolated between the nearest others; nan if there are none.
    """
    n = len(y)
    q, half = min(span, n), (span - 1) // 2
    wider = max(0, (span - n) // 2)
    at = np.arange(-beyond, n + beyond)
    first = np.clip(at - half, 0, n - q) if q < n else np.zeros(len(at), int)
    reach = np.maximum(at - first, first + q - 1 - at).astype(float) + wider
    out = np.empty(len(at))
    filled = np.where(weight > 0, y, 0.0)
    inside = (at - half >= 0) & (at + half <= n - 1) & (q == span)
    if inside.any():  # the same kernel at all of them
        d = np.arange(-half, half + 1)
        kernel = (1 - (np.abs(d) / (half if half else 1)) ** 3) ** 3 if half else np.ones(1)
        sums = [np.convolve(v, k[::-1], "valid") for v in (weight, weight * filled) for k in (kernel, kernel * d, kernel * d * d)]
        s0, s1, s2, t0, t1, _ = sums
        out[inside] = line(s0, s1, s2, t0, t1)
    for i in np.flatnonzero(~inside):
        j = np.arange(first[i], first[i] + q)
        d = (j - at[i]).astype(float)
        r = np.abs(d) / reach[i] if reach[i] else np.zeros(len(d))
        k = np.where(r < 1, (1 - r**3) ** 3, 0.0) * weight[j]
        out[i] = line(*(np.atleast_1d(x) for x in (k.sum(), (k * d).sum(), (k * d * d).sum(), (k * filled[j]).sum(), (k * d * filled[j]).sum())))[0]
    lost = np.isnan(out)
    if lost.any() and not lost.all():
        out[lost] = np.interp(at[lost], at[~lost], out[~lost])
    return out


def line(s0, s1, s2, t0, t1) -> np.ndarray:
    """The value at 0 of the weighted line; the weighted mean where the points don't spread."""
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = s0 * s2 - s1 * s1
        straight = (s2 * t0 - s1 * t1) / spread
        return np.where(spread > 1e-9 * np.maximum(s0 * s0, 1e-300), straight, t0 / s0)


def moving(x: np.ndarray, size: int) -> np.ndarray:
    return np.convolve(x, np.full(size, 1 / size), "valid")


def inner(y: np.ndarray, trend: np.ndarray, weight: np.ndarray, period: int, seasonal: int, slow: int, trending: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Trend and season after ``rounds`` rounds."""
    n, ones = len(y), np.ones(len(y))
    season = np.zeros(n)
    for _ in range(rounds):
        detrended = np.where(weight > 0, y - trend, 0.0)
        cycle = np.empty(n + 2 * period)
        for k in range(min(period, n)):
            cycle[k::period][: len(range(k, n, period)) + 2] = loess(detrended[k::period], seasonal, weight[k::period], beyond=1)
        level = loess(moving(moving(moving(cycle, period), period), 3), slow, ones)
        season = cycle[period : period + n] - level
        trend = loess(np.where(weight > 0, y - season, 0.0), trending, weight)
    return trend, season


@dataclass
class Decomposition:
    """Trend, season and remainder of evenly spaced series, in the order of a time column.

    ``seasonal`` is the number of cycles that smooth a season's place; ``rounds`` and ``robust`` are the numbers of inner and
    outer rounds (robust 0: no weights by remainder). A null or NaN value takes no part and gets a trend and season from its
    neighbours, but no remainder. A series of less than two periods has none of them. Parts give what the whole
    series gives unless more rows in a row are missing than a margin has.
    """

    period: int
    seasonal: int = 7
    rounds: int = 5
    robust: int = 0
    part_rows: int = PART_ROWS

    @property
    def spans(self) -> tuple[int, int]:
        """Points of the regressions of the slow part and the trend."""
        return odd(self.period + 1), odd(1.5 * self.period / (1 - 1.5 / self.seasonal))

    @property
    def margin(self) -> int:
        """Rows to either side that a row depends on in one pass."""
        slow, trending = self.spans
        each = (self.seasonal // 2 + 2) * self.period + self.period + 2 + slow // 2 + trending // 2
        return self.rounds * each

    def fit_transform(self, df: DataFrame, by: list[str], time: str, column: str) -> DataFrame:
        """by, time, trend, season and rest. Times of a series are taken as its steps; equal times stand in the order of their values."""
        if self.period < 2 or self.seasonal < 3:
            raise ValueError("a period has two rows and a season three cycles at least")
        value = F.col(quoted(column)).cast("double")
        key = F.struct(*map(quoted, by)) if by else F.struct(F.lit(0).alias("all"))
        rows = df.select(key.alias("s_"), F.col(quoted(time)).alias("t_"), F.when(~F.isnan(value), value).alias("y_"))
        placed = stratified_places(rows, "s_", ["t_", "y_"])
        sizes = placed.groupBy(F.col("s_").alias("of_")).agg(F.count("*").alias("n_"))
        # a series that its first pass has no trend for starts at 0, with full weights
        state = placed.join(sizes, F.col("s_").eqNullSafe(F.col("of_"))).drop("of_").withColumns({"trend_": F.lit(0.0), "w_": F.col("y_").isNotNull().cast("double")})
        state = stored(state)
        for last in range(self.robust + 1):
            made = self.one_pass(state)
            if last == self.robust:
                break
            made = stored(made.withColumn("r_", F.abs(F.col("y_") - F.col("trend") - F.col("season"))))
            middle = quantiles(made, "r_", [0.5], ["s_"], ["m_"]).withColumnRenamed("s_", "of_")
            far = F.try_divide("r_", 6 * F.col("m_"))
            weight = F.when(F.col("r_").isNull(), 0.0).when(F.col("m_") == 0, (F.col("r_") == 0).cast("double")).when(far < 1, (1 - far * far) ** 2).otherwise(0.0)
            state = stored(made.join(middle, F.col("s_").eqNullSafe(F.col("of_")), "left").select("s_", "t_", "y_", "place_", "n_", F.coalesce("trend", F.lit(0.0)).alias("trend_"), weight.alias("w_")))
        some = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
        out = made.select(*[F.col("s_")[c].alias(c) for c in by], F.col("t_").alias(time), some("trend"), some("season"), F.col("y_"))
        return out.select(*map(quoted, by), quoted(time), "trend", "season", (F.col("y_") - F.col("trend") - F.col("season")).alias("rest"))

    def one_pass(self, state: DataFrame) -> DataFrame:
        """Adds trend and season after the inner rounds; each part with its neighbours' rows is a task."""
        rows, margin, (slow, trending) = self.part_rows, self.margin, self.spans
        last = F.floor((F.col("n_") - 1) / rows)
        parts = F.sequence(F.greatest(F.lit(0), F.floor((F.col("place_") - margin) / rows)), F.least(last, F.floor((F.col("place_") + margin) / rows)))
        spread = state.withColumn("part_", F.explode(parts))
        period, seasonal, rounds = self.period, self.seasonal, self.rounds
        schema = T.StructType([*state.schema.fields, T.StructField("trend", T.DoubleType()), T.StructField("season", T.DoubleType())])
        names = state.columns

        def work(part: pa.Table) -> pa.Table:
            part = part.sort_by("place_")
            place, number = part["place_"].to_numpy(), part["part_"][0].as_py()
            own = (place >= number * rows) & (place < (number + 1) * rows)
            trend = season = np.full(len(place), np.nan)
            if part["n_"][0].as_py() >= 2 * period:
                y, before, weight = (part[c].to_numpy() for c in ("y_", "trend_", "w_"))
                trend, season = inner(y, before, weight, period, seasonal, slow, trending, rounds)
            out = part.select(names).filter(pa.array(own))
            return out.append_column("trend", pa.array(trend[own])).append_column("season", pa.array(season[own]))

        return spread.groupBy("s_", "part_").applyInArrow(work, schema)
