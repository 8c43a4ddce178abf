"""Operators on numeric features: one aggregation, then a projection."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur import roles as R
from larkspur.frame import Frame
from larkspur.functions.ordered import column_quantiles
from larkspur.operators.base import Operator


def missing(frame: Frame, c: str) -> Column:
    floating = dict(frame.df.dtypes)[c] in ("double", "float")
    return F.col(c).isNull() | F.isnan(c) if floating else F.col(c).isNull()


def value(frame: Frame, c: str) -> Column:
    """The feature as a double, null where it is missing."""
    return F.when(~missing(frame, c), F.col(c).cast("double"))


def clipped(x: Column, low: float, high: float) -> Column:
    """Between low and high; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def bucketed(df: DataFrame, x: Column, cuts: list[float], name: str) -> DataFrame:
    """``name``: the number of distinct cuts not above x, by binary search; missing values get the number of all."""
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    if len(splits) < 3:
        return df.withColumn(name, F.lit(0.0))
    made = df.withColumn("x_", F.coalesce(x, F.lit(float("nan"))))
    return Bucketizer(splits=splits, inputCol="x_", outputCol=name, handleInvalid="keep").transform(made).drop("x_")


class Numeric(Operator):
    """Adds ``prefix`` + name for each numeric feature; the inputs leave the frame."""

    prefix = ""
    role = R.numeric()

    def inputs(self, frame: Frame) -> list[str]:
        return [c for c in frame.features if frame.roles[c].name == "numeric"]

    def expression(self, frame: Frame, c: str) -> Column:
        raise NotImplementedError

    def transform(self, frame: Frame) -> Frame:
        made = {f"{self.prefix}__{c}": self.expression(frame, c) for c in self.inputs(frame)}
        return frame.with_columns(made, self.role).select(list(made))


class NullFlags(Numeric):
    """1.0 where a feature is missing, for features whose share of missing values exceeds ``rate``."""

    prefix = "nanflg"

    def __init__(self, rate: float = 0.005):
        self.rate, self.chosen = rate, []

    def fit(self, frame: Frame) -> NullFlags:
        every = super().inputs(frame)
        row = frame.df.agg(*[F.avg(missing(frame, c).cast("double")).alias(c) for c in every]).first() if every else {}
        self.chosen = [c for c in every if (row[c] or 0) > self.rate]
        return self

    def inputs(self, frame: Frame) -> list[str]:
        return [c for c in self.chosen if c in frame.features]

    def expression(self, frame: Frame, c: str) -> Column:
        return missing(frame, c).cast("double")


class FillMedian(Numeric):
    """Missing values become the exact median, or 0 if there is no value."""

    prefix = "fillnamed"

    def fit(self, frame: Frame) -> FillMedian:
        self.state = {c: q[0] or 0.0 for c, q in column_quantiles(frame.df, self.inputs(frame), [0.5]).items()}
        return self

    def expression(self, frame: Frame, c: str) -> Column:
        return F.coalesce(value(frame, c), F.lit(float(self.state[c])))


class FillMean(FillMedian):
    """Missing values become the mean, or 0 if there is no value."""

    prefix = "fillnamean"

    def fit(self, frame: Frame) -> FillMean:
        row = frame.df.agg(*[F.avg(value(frame, c)).alias(c) for c in self.inputs(frame)]).first()
        self.state = {c: row[c] or 0.0 for c in self.inputs(frame)}
        return self


class FillInfinite(Numeric):
    """Infinite values become null."""

    prefix = "fillinf"

    def expression(self, frame: Frame, c: str) -> Column:
        return F.when(F.abs(value(frame, c)) < float("inf"), F.col(c).cast("double"))


class LogOdds(Numeric):
    """ln(p / (1 - p)) of a probability that is kept 1e-7 away from 0 and 1."""

    prefix = "logodds"

    def expression(self, frame: Frame, c: str) -> Column:
        p = clipped(value(frame, c), 1e-7, 1 - 1e-7)
        return F.log(p / (1 - p))


class Scale(Numeric):
    """(x - mean) / population deviation; a deviation that is 0 or unknown counts as 1."""

    prefix = "scaler"

    def fit(self, frame: Frame) -> Scale:
        every = self.inputs(frame)
        sums = [f(value(frame, c)).alias(f"{n}{k}") for k, c in enumerate(every) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
        row = frame.df.agg(*sums).first() if every else {}
        self.state = {c: (row[f"m{k}"] or 0.0, row[f"s{k}"] or 1.0) for k, c in enumerate(every)}
        return self

    def expression(self, frame: Frame, c: str) -> Column:
        mean, deviation = self.state[c]
        return (value(frame, c) - F.lit(mean)) / F.lit(deviation)


class QuantileBins(Numeric):
    """1 + number of distinct inner quantiles below the value; 0 for a missing value."""

    prefix = "qntl"
    role = R.category(dtype="int", label_encoded=True)

    def __init__(self, bins: int = 10):
        self.bins = bins

    def fit(self, frame: Frame) -> QuantileBins:
        inner = [k / self.bins for k in range(1, self.bins)]
        self.state = {c: sorted({x for x in q if x is not None}) for c, q in column_quantiles(frame.df, self.inputs(frame), inner).items()}
        return self

    def expression(self, frame: Frame, c: str) -> Column:
        cuts = self.state[c]
        below = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda b: b < value(frame, c))) if cuts else F.lit(0)
        return F.when(missing(frame, c), 0).otherwise(below + 1).cast("int")


#: coefficients of a rational approximation of the inverse normal distribution (fixed values)
TAIL_TOP = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783]
TAIL_LOW = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996, 3.754408661907416, 1.0]
MID_TOP = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239]
MID_LOW = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
NORMAL_LIMIT = 5.199337582605575


def polynomial(x: Column, coefficients: list[float]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def inverse_normal(p: Column) -> Column:
    """The standard normal quantile, to about 1e-9, within +-5.1993."""

    def at(p: Column) -> Column:
        q = p - 0.5
        r = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
        tail = polynomial(r, TAIL_TOP) / polynomial(r, TAIL_LOW)
        middle = q * polynomial(q * q, MID_TOP) / polynomial(q * q, MID_LOW)
        return F.when(F.least(p, 1 - p) >= 0.02425, middle).when(p < 0.5, tail).otherwise(-tail)

    return clipped(F.transform(F.array(clipped(p, 1e-7, 1 - 1e-7)), at)[0], -NORMAL_LIMIT, NORMAL_LIMIT)


class QuantileTransform(Numeric):
    """Place of a value among the reference quantiles, in 0 to 1 or on the normal scale; missing values stay so.

    Between two quantiles the place is interpolated; values on a run of equal quantiles get its middle.
    """

    prefix = "qntl_tr"

    def __init__(self, quantiles: int | None = None, output: str = "normal", factor: int = 30):
        self.quantiles, self.output, self.factor = quantiles, output, factor

    def fit(self, frame: Frame) -> QuantileTransform:
        n = self.quantiles or max(min(frame.df.count() // self.factor, 1000), 10)
        self.grid = [k / (n - 1) for k in range(n)]
        self.state = column_quantiles(frame.df, self.inputs(frame), self.grid)
        return self

    def expression(self, frame: Frame, c: str) -> Column:
        x, reference = value(frame, c), [q for q in self.state[c] if q is not None]
        if not reference:
            return F.lit(None).cast("double")
        values = sorted(set(reference))
        step, n = 1.0 / max(1, len(reference) - 1), len(reference)
        first = {v: i for i, v in reversed(list(enumerate(reference)))}
        last = {v: i for i, v in enumerate(reference)}
        at = F.greatest(F.col(f"bin_{c}").cast("int"), F.lit(1))  # number of distinct reference values not above x
        pick = lambda numbers, k: F.element_at(F.array(*map(F.lit, numbers)), k)
        left, right = pick(values, at), pick(values, F.least(at + 1, F.lit(len(values))))
        middle = pick([(first[v] + last[v]) / 2 * step for v in values], at)
        beyond = pick([float(last[v]) for v in values], at)
        place = F.when(x == left, middle).otherwise((beyond + F.coalesce(F.try_divide(x - left, right - left), F.lit(0.0))) * step)
        place = F.when(x <= reference[0], 0.0).when(x >= reference[n - 1], 1.0).when(x.isNotNull(), place)
        return inverse_normal(place) if self.output == "normal" else place

    def transform(self, frame: Frame) -> Frame:
        df = frame.df
        for c in self.inputs(frame):
            df = bucketed(df, value(frame, c), [q for q in self.state[c] if q is not None], f"bin_{c}")
        return super().transform(Frame(df, frame.roles, frame.keys)).select([f"{self.prefix}__{c}" for c in self.inputs(frame)]).without([f"bin_{c}" for c in self.inputs(frame)])
