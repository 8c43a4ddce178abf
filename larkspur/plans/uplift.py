"""Uplift learners: the effect of a treatment on each row, from models of outcomes, effects and propensity.

A learner is given a maker of fitted scorers: ``fit(df, target, features)`` returns a function that adds
a prediction column to any frame with those features.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur import roles as R
from larkspur.frame import Frame
from larkspur.functions import metrics
from larkspur.operators.models import FEATURES, Algorithm, Task, assembled, predict

Scorer = Callable[[DataFrame, str], DataFrame]


def fitter(task: Task, algorithm: Algorithm | None = None) -> Callable[..., Scorer]:
    """A maker of scorers by one algorithm."""
    algorithm = algorithm or Algorithm("linear")

    def fit(df: DataFrame, target: str, features: list[str], weight: str | None = None) -> Scorer:
        frame = lambda d: Frame(d, dict.fromkeys(features, R.numeric()), [])
        model = algorithm.fit(assembled(frame(df), features), task, target, weight)
        return lambda d, name: predict(model, assembled(frame(d), features), task, name).drop(FEATURES)

    return fit


class Learner:
    def __init__(self, features: list[str], target: str, treatment: str, outcome: Callable[..., Scorer], effect: Callable[..., Scorer] | None = None, propensity: Callable[..., Scorer] | None = None):
        self.features, self.target, self.treatment = features, target, treatment
        self.outcome, self.effect, self.propensity = outcome, effect or fitter(Task("reg")), propensity or fitter(Task("binary"))

    def arm(self, df: DataFrame, k: int) -> DataFrame:
        return df.filter(F.col(self.treatment) == k)

    def fit(self, df: DataFrame) -> Learner:
        raise NotImplementedError

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with uplift, and the outcomes with and without treatment where the learner has them."""
        raise NotImplementedError


class SLearner(Learner):
    """One model with the treatment as a feature."""

    def fit(self, df: DataFrame) -> SLearner:
        self.model = self.outcome(df, self.target, [*self.features, self.treatment])
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        kept = df.withColumn("t__", F.col(self.treatment)) if self.treatment in df.columns else df.withColumn("t__", F.lit(None).cast("int"))
        out = self.model(kept.withColumn(self.treatment, F.lit(1)), "treated")
        out = self.model(out.withColumn(self.treatment, F.lit(0)), "untreated")
        return out.withColumn(self.treatment, F.col("t__")).drop("t__").withColumn("uplift", F.col("treated") - F.col("untreated"))


class TLearner(Learner):
    """A model for each arm."""

    def fit(self, df: DataFrame) -> TLearner:
        self.models = [self.outcome(self.arm(df, k), self.target, self.features) for k in (0, 1)]
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        out = self.models[0](self.models[1](df, "treated"), "untreated")
        return out.withColumn("uplift", F.col("treated") - F.col("untreated"))


class T2Learner(TLearner):
    """A model for each arm that is fitted on both, the other arm with a quarter of the weight."""

    def fit(self, df: DataFrame) -> T2Learner:
        weighted = lambda k: df.withColumn("w__", F.when(F.col(self.treatment) == k, 1.0).otherwise(0.25))
        self.models = [self.outcome(weighted(k), self.target, self.features, "w__") for k in (0, 1)]
        return self


class TDLearner(Learner):
    """The model of the smaller arm is a feature of the larger arm's (``dependent``: 1 if over half are treated)."""

    def __init__(self, *args, dependent: int | None = None, **more):
        super().__init__(*args, **more)
        self.dependent = dependent

    def fit(self, df: DataFrame) -> TDLearner:
        if self.dependent is None:
            self.dependent = int((df.agg(F.avg(F.col(self.treatment).cast("double"))).first()[0] or 0) > 0.5)
        self.first = self.outcome(self.arm(df, 1 - self.dependent), self.target, self.features)
        known = self.first(self.arm(df, self.dependent), "other__")
        self.second = self.outcome(known, self.target, [*self.features, "other__"])
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        out = self.second(self.first(df, "other__"), "own__")
        names = ("own__", "other__") if self.dependent == 1 else ("other__", "own__")
        return out.withColumns({"treated": F.col(names[0]), "untreated": F.col(names[1])}).withColumn("uplift", F.col("treated") - F.col("untreated")).drop("own__", "other__")


class XLearner(Learner):
    """Effects imputed by the other arm's outcome model, mixed by propensity."""

    def fit(self, df: DataFrame) -> XLearner:
        arms = TLearner(self.features, self.target, self.treatment, self.outcome).fit(df)
        y = F.col(self.target).cast("double")
        treated = arms.models[0](self.arm(df, 1), "m__").withColumn("d__", y - F.col("m__"))
        others = arms.models[1](self.arm(df, 0), "m__").withColumn("d__", F.col("m__") - y)
        self.effects = [self.effect(others, "d__", self.features), self.effect(treated, "d__", self.features)]
        self.chance = self.propensity(df, self.treatment, self.features)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        out = self.chance(self.effects[1](self.effects[0](df, "e0__"), "e1__"), "c__")
        return out.withColumn("uplift", F.col("c__") * F.col("e1__") + (1 - F.col("c__")) * F.col("e0__")).drop("e0__", "e1__", "c__")


class RLearner(Learner):
    """Residual of the outcome over that of the treatment, weighted by the square of the latter."""

    def fit(self, df: DataFrame) -> RLearner:
        mean = self.outcome(df, self.target, self.features)
        chance = self.propensity(df, self.treatment, self.features)
        both = chance(mean(df, "m__"), "c__")
        rest = F.col(self.treatment).cast("double") - F.col("c__") + 1e-5
        both = both.withColumns({"d__": (F.col(self.target).cast("double") - F.col("m__")) / rest, "w__": rest * rest})
        self.model = self.effect(both, "d__", self.features, "w__")
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return self.model(df, "uplift")


LEARNERS: dict[str, type[Learner]] = {"s": SLearner, "t": TLearner, "t2": T2Learner, "td": TDLearner, "x": XLearner, "r": RLearner}


def rating(scores: DataFrame) -> DataFrame:
    """name, score and rank of learners: the highest score first, of equals the one at the smaller place. One row for each learner."""
    return scores.select("name", "score", F.row_number().over(Window.orderBy(F.desc_nulls_last("score"), "place")).alias("rank"))


def choose_learner(df: DataFrame, valid: DataFrame, features: list[str], target: str, treatment: str, outcome: Callable[..., Scorer], names: list[str] | None = None, mode: str = "adj_qini") -> tuple[str, Learner, list[tuple[str, float]]]:
    """The learner with the best uplift AUC on the valid rows, fitted; and all scores, best first. One that fails is left out."""
    scores, fitted = [], {}
    for name in names or list(LEARNERS):
        learner = LEARNERS[name](features, target, treatment, outcome).fit(df)
        value = metrics.uplift_auc(learner.predict(valid), target, "uplift", treatment, mode).first()["auc"]
        scores.append((name, value))
        fitted[name] = learner
    scores.sort(key=lambda x: -x[1])
    return scores[0][0], fitted[scores[0][0]], scores
