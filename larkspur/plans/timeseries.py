"""Forecasting of many series: trend out, lag and season features, one model per step, trend back in."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur import roles as R
from larkspur.frame import Frame
from larkspur.operators.models import FEATURES, Algorithm, Task, assembled, predict
from larkspur.operators.sequence import differences, horizon, lags, linear_trend
from larkspur.operators.stl import Decomposition


@dataclass
class Forecaster:
    """``fit`` on (series, time, value), ``predict`` returns the next ``steps`` values of every series.

    Training rows are those with a full history and a full horizon. ``trend`` is "linear", "none", or "stl": the local
    trend and season of ``period`` steps, of which the line through the last ``period`` trends and the last season go on.
    """

    series: list[str]
    time: str
    value: str
    steps: int = 7
    history: int = 14
    trend: str = "linear"
    period: int = 7
    algorithm: Algorithm = field(default_factory=lambda: Algorithm("linear"))

    def days(self):
        return F.unix_micros(F.col(self.time).cast("timestamp")) / F.lit(86_400_000_000.0)

    def featured(self, df: DataFrame) -> DataFrame:
        out = df
        if self.trend == "none":
            out = out.withColumn("rest__", F.col(self.value))
        elif self.trend == "stl":
            out = out.join(self.decomposed(df), [*self.series, self.time]).withColumn("rest__", F.col(self.value) - F.col("trend") - F.col("season")).drop("trend", "season", "rest")
        else:
            out = out.join(self.lines, self.series).withColumn("rest__", F.col(self.value) - F.col("intercept") - F.col("slope") * self.days())
        out = lags(out, self.series, [self.time], ["rest__"], self.history)
        out = differences(out, self.series, [self.time], ["rest__"], self.history, False)
        return out.withColumns({"wd__": F.weekday(self.time).cast("double"), "m__": F.month(self.time).cast("double")})

    def decomposed(self, df: DataFrame) -> DataFrame:
        return Decomposition(self.period).fit_transform(df, self.series, self.time, self.value).filter("trend is not null")

    def fit(self, df: DataFrame) -> Forecaster:
        if self.trend == "linear":
            self.lines = linear_trend(df, self.series, F.col(self.time), self.value)
        made = horizon(self.featured(df), self.series, [self.time], "rest__", self.steps)
        self.names = [f"lag_{i}__rest__" for i in range(self.history)] + [f"diff_{i}__rest__" for i in range(1, self.history)] + ["wd__", "m__"]
        full = made.filter(F.col(self.names[self.history - 1]).isNotNull() & F.col(f"rest___plus_{self.steps}").isNotNull())
        frame = Frame(full, dict.fromkeys(self.names, R.numeric()), self.series)
        ready = assembled(frame, self.names).persist()
        task = Task("reg")
        self.models = [self.algorithm.fit(ready, task, f"rest___plus_{k}") for k in range(1, self.steps + 1)]
        ready.unpersist()
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """series, last time, step and forecast."""
        last = Window.partitionBy(*self.series).orderBy(F.desc(self.time))
        # a step is as long as that to the last time; one day where a series has one row
        rows = self.featured(df).withColumns({"r__": F.row_number().over(last), "step__": F.coalesce(self.days() - F.lead(self.days()).over(last), F.lit(1.0))}).filter("r__ = 1")
        out = assembled(Frame(rows, dict.fromkeys(self.names, R.numeric()), self.series), self.names)
        for k, model in enumerate(self.models, 1):
            out = predict(model, out, Task("reg"), f"s{k}__")
        steps = F.explode(F.array(*[F.struct(F.lit(k).alias("step"), F.col(f"s{k}__").alias("v")) for k in range(1, self.steps + 1)]))
        long = out.drop(FEATURES).withColumn("s__", steps)
        at = self.days() + F.col("s__.step") * F.col("step__")
        if self.trend == "stl":
            w = Window.partitionBy(*self.series).orderBy(F.desc(self.time))
            recent = self.decomposed(df).withColumn("r__", F.row_number().over(w)).filter(F.col("r__") <= self.period)
            seasons = F.transform(F.array_sort(F.collect_list(F.struct(-F.col("r__"), "season"))), lambda x: x["season"])
            line = [F.regr_slope("trend", self.days()).alias("slope"), F.regr_intercept("trend", self.days()).alias("intercept"), seasons.alias("seasons__")]
            long = long.join(recent.groupBy(*self.series).agg(*line), self.series)
            season = F.element_at("seasons__", (F.pmod(F.col("s__.step") - 1, F.lit(self.period)) + 1).cast("int"))
            back = F.col("s__.v") + F.col("intercept") + F.col("slope") * at + season
        else:
            back = F.col("s__.v") + (F.col("intercept") + F.col("slope") * at if self.trend == "linear" else 0.0)
        return long.select(*self.series, F.col(self.time).alias("last_time"), F.col("s__.step").alias("step"), back.alias("forecast"))
