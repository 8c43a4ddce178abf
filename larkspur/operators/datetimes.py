"""Operators on datetime features, as projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur import roles as R
from larkspur.frame import Frame
from larkspur.operators.base import Operator

DAY = 86_400_000_000

#: part of a date -> its expression; "ms" is the microsecond of the second and "ns" what is finer, 0 here
PARTS = {
    "y": F.year, "m": F.month, "d": F.dayofmonth, "wd": F.weekday, "doy": F.dayofyear, "hour": F.hour, "min": F.minute, "sec": F.second,
    "ms": lambda c: F.pmod(F.unix_micros(c), F.lit(1_000_000)).cast("int"), "ns": lambda c: F.when(c.isNotNull(), 0),
}


def days_between(later: Column, earlier: Column) -> Column:
    """Days, with their fraction."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(float(DAY))


class Datetime(Operator):
    def inputs(self, frame: Frame) -> list[str]:
        return [c for c in frame.features if frame.roles[c].name == "datetime"]


class TimeToNumber(Datetime):
    """Days since the earliest date of the fit."""

    def fit(self, frame: Frame) -> TimeToNumber:
        every = self.inputs(frame)
        row = frame.df.agg(*[F.min(F.unix_micros(F.col(c).cast("timestamp"))).alias(c) for c in every]).first() if every else {}
        self.start = {c: row[c] or 0 for c in every}
        return self

    def transform(self, frame: Frame) -> Frame:
        made = {f"dtdiff__{c}": (F.unix_micros(F.col(c).cast("timestamp")) - F.lit(s)) / F.lit(float(DAY)) for c, s in self.start.items()}
        return frame.with_columns(made, R.numeric()).select(list(made))


class DaysToBase(Datetime):
    """Days from each base date to each other date; bases are those whose role says so, unless named."""

    def __init__(self, bases: list[str] | None = None, others: list[str] | None = None):
        self.bases, self.others = bases, others

    def transform(self, frame: Frame) -> Frame:
        bases = self.bases or [c for c in self.inputs(frame) if frame.roles[c].base_date]
        others = self.others or [c for c in self.inputs(frame) if c not in bases]
        made = {f"basediff_{b}__{c}": days_between(F.col(c), F.col(b)) for b in bases for c in others}
        return frame.with_columns(made, R.numeric()).select(list(made))


class Seasons(Datetime):
    """Parts of dates as categories, and a holiday flag where a calendar (country, day) is given."""

    def __init__(self, parts: tuple[str, ...] | None = None, holidays: DataFrame | None = None):
        self.parts, self.holidays = parts, holidays

    def transform(self, frame: Frame) -> Frame:
        made = {f"season_{p}__{c}": PARTS[p](F.col(c).cast("timestamp")) for c in self.inputs(frame) for p in (frame.roles[c].seasonality if self.parts is None else self.parts)}
        out = frame.with_columns(made, R.category(dtype="int"))
        if self.holidays is not None:
            for c in self.inputs(frame):
                name = f"season_hol__{c}"
                days = self.holidays.filter(F.col("country") == frame.roles[c].country) if frame.roles[c].country else self.holidays
                table = days.select(F.col("day").cast("date").alias("holiday_")).distinct()
                df = out.df.join(table, F.to_date(c) == F.col("holiday_"), "left").withColumn(name, F.col("holiday_").isNotNull().cast("int")).drop("holiday_")
                out = Frame(df, out.roles | {name: R.category(dtype="int")}, out.keys)
                made[name] = None
        return out.select(list(made))


def change_part(date: Column, part: str, to: Column | int) -> Column:
    """The date with another year, month or day of the week (Monday 0); a day that a month lacks becomes its last."""
    to = to if isinstance(to, Column) else F.lit(to)
    if part == "dayofweek":
        return F.date_add(date.cast("date"), (to - F.weekday(date)).cast("int"))
    months = (to - F.year(date)) * 12 if part == "year" else to - F.month(date)
    return F.add_months(date.cast("date"), months.cast("int"))


def parse_date(c: Column, format: str | None = None, unit: str | None = None) -> Column:
    """A timestamp from text by format, or from a number of seconds, milliseconds or microseconds; null where it can't be read."""
    if unit:
        make = {"s": F.timestamp_seconds, "ms": F.timestamp_millis, "us": F.timestamp_micros}[unit]
        return make(c.cast("long"))
    return F.try_to_timestamp(c, F.lit(format)) if format else F.try_to_timestamp(c)


def usual_step(df: DataFrame, time: str) -> DataFrame:
    """seconds between the two last distinct times, and the step it stands for: exact, or 1 month or 1 year when over 27 or 360 days."""
    last = df.select(F.col(time).cast("timestamp").alias("t")).filter("t is not null").distinct().orderBy(F.desc("t")).limit(2)
    gap = last.agg(((F.unix_micros(F.max("t")) - F.unix_micros(F.min("t"))) / 1e6).alias("seconds"))
    days = F.col("seconds") / 86400
    return gap.select("seconds", F.when(days > 360, "year").when(days > 27, "month").otherwise("exact").alias("step"))
