"""Presets: reader, feature plans, levels of models with out-of-fold predictions, and a blend.

Each level's frame is the table of keys, attributes and features that the one before has made, with its
predictions; it is stored, so that the plan stays short and the blend is searched over what is there.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur import roles as R
from larkspur.frame import Frame
from larkspur.operators import blending, dependence, selection
from larkspur.operators.base import Operator, Sequential, Union, lineage
from larkspur.operators.categorical import FrequencyEncode, LabelEncode, OneHot, OrdinalEncode, TargetEncode
from larkspur.operators.datetimes import DaysToBase, Seasons, TimeToNumber
from larkspur.operators.models import Algorithm, MultiOutput, OutOfFold, Task, tune
from larkspur.operators.numeric import FillInfinite, FillMedian, NullFlags, Numeric, QuantileBins, Scale
from larkspur.operators.scorecard import ScorecardBins
from larkspur.operators.text import TextScores
from larkspur.operators.validation import k_folds
from larkspur.plans import persistence
from larkspur.plans.reader import Reader
from larkspur.storage import stored

log = logging.getLogger(__name__)


class Timer:
    """A time budget that is spent from its making."""

    def __init__(self, seconds: float):
        self.seconds, self.start = seconds, time.monotonic()

    @property
    def left(self) -> float:
        return self.seconds - (time.monotonic() - self.start)

    def over(self) -> bool:
        return self.left <= 0


class Pass(Numeric):
    """Numeric features as they are."""

    prefix = "raw"

    def expression(self, frame: Frame, c: str):
        return F.col(f"`{c}`").cast("double")


def simple_features(encode: TargetEncode | None = None) -> Operator:
    """For trees: numbers, ranks of categories, days."""
    return Union([Pass(), OrdinalEncode(), TimeToNumber()])


def advanced_features(encode: TargetEncode | None = None) -> Operator:
    """For trees: numbers, counts, out-of-fold target means and ranks of categories, days to bases, parts of dates."""
    return Union([Pass(), FrequencyEncode(), encode or TargetEncode(), OrdinalEncode(), DaysToBase(), Seasons()])


def linear_features(encode: TargetEncode | None = None, rich: bool = False) -> Operator:
    """For linear models: filled and scaled numbers, flags of missing ones, one-hot codes and target means of categories; if rich, bins and seasons as well."""
    dense = Sequential([FillInfinite(), Union([Sequential([FillMedian(), Scale()]), NullFlags()])])
    codes = Sequential([LabelEncode(), OneHot()])
    more = [Sequential([QuantileBins(), OneHot()]), Sequential([Seasons(), LabelEncode(), OneHot()])] if rich else []
    return Union([dense, codes, Sequential([encode or TargetEncode(), Scale()]), *more])


def scorecard_features(encode: TargetEncode | None = None) -> Operator:
    """Weights of evidence of the best monotone bins of numbers and categories."""
    return ScorecardBins()


#: name -> (features, algorithm)
MEMBERS: dict[str, tuple[Callable[[], Operator], Algorithm]] = {
    "linear_l2": (linear_features, Algorithm("linear")),
    "gbt": (advanced_features, Algorithm("gbt")),
    "forest": (simple_features, Algorithm("forest")),
    "scorecard": (scorecard_features, Algorithm("linear", {"regParam": 1e-2})),
}


@dataclass
class Member:
    name: str
    features: Operator
    model: OutOfFold | MultiOutput
    selected: list[str] | None = None


@dataclass
class TabularAutoML:
    """``fit_predict`` returns keys, targets and the blended out-of-fold prediction; ``predict`` scores new rows.

    Text columns give every member the out-of-fold scores of linear models over their words. Of a task with
    several targets all columns with the role target are predicted, as an array in their order.
    ``levels`` names the members of each level; predictions of a level are features of the next. A
    member that fails is logged and left out. With ``tuning`` trials its parameters are searched on one fold.
    """

    task: Task
    keys: list[str]
    levels: tuple[tuple[str, ...], ...] = (("linear_l2", "gbt"),)
    folds: int = 5
    timeout: float = 3600
    tuning: int = 0
    cutoff: float | None = None
    blend: str = "weighted"
    debug: bool = False
    seed: int = 42
    members: list[list[Member]] = field(default_factory=list)

    def fit_predict(self, df: DataFrame, declared: dict) -> DataFrame:
        self.timer = Timer(self.timeout)
        self.reader = Reader(self.task.name, self.keys, folds=self.folds, seed=self.seed)
        frame = self.reader.fit_read(df, declared)
        self.fold = frame.attribute("folds")
        self.targets = [c for c, r in frame.roles.items() if r.name == "target"]
        self.target = self.targets if self.task.several else frame.attribute("target")
        for names in self.levels:
            frame, level = self.fit_level(frame, names)
            self.members.append(level)
            if self.timer.over():
                log.info("the time budget is spent")
                break
        last = [m.model.name for m in self.members[-1]]
        return self.blended(frame.df, last).select(*self.keys, *(self.targets if self.task.several else [self.target]), "prediction")

    def fit_level(self, frame: Frame, names: tuple[str, ...]) -> tuple[Frame, list[Member]]:
        level, scored = [], frame.df
        for name in names:
            try:
                member, predictions = self.fit_member(frame, name, f"p_{len(self.members)}_{name}")
            except Exception:
                if self.debug:
                    raise
                log.exception("%s failed and is left out", name)
                continue
            level.append(member)
            scored = scored.join(predictions, self.keys, "left")
            if self.timer.over():
                break
        if not level:
            raise RuntimeError("no model could be fitted")
        scored, roles = self.with_predictions(scored, frame.roles, [m.model.name for m in level])
        return Frame(stored(scored), roles, frame.keys), level

    def with_predictions(self, df: DataFrame, roles: dict, names: list[str]) -> tuple[DataFrame, dict]:
        """Predictions as features of the next level: an array's numbers each."""
        if self.task.name in ("binary", "reg"):
            return df, roles | {n: R.numeric(prob=self.task.name == "binary") for n in names}
        width = len(self.targets) if self.task.several else self.reader.state["classes"].count()
        made = {f"{n}__{k}": F.col(n)[k] for n in names for k in range(width)}
        return df.withColumns(made), roles | dict.fromkeys(names, R.make("array")) | dict.fromkeys(made, R.numeric(prob=self.task.name != "multi:reg"))

    def fit_member(self, frame: Frame, name: str, column: str) -> tuple[Member, DataFrame]:
        make, algorithm = MEMBERS[name]
        algorithm = Algorithm(algorithm.kind, algorithm.params, self.seed)
        binary = self.task.one.name == "binary"
        encode = TargetEncode(self.targets, "binary" if binary else "reg") if self.task.several else TargetEncode(kind="reg") if self.task.name == "reg" else None
        features = make(encode)
        if any(r.name == "text" for r in frame.roles.values()) and self.task.name != "multiclass":
            features = Union([features, TextScores(self.folds, binary, self.targets if self.task.several else None)])
        made = features.fit_transform(frame)
        if self.tuning or self.cutoff is not None or self.task.several:  # one fit stores what it reads itself
            made = Frame(stored(made.df), made.roles, made.keys)
        if self.tuning and not self.task.several:
            algorithm = tune(algorithm, self.task, made, next(k_folds(self.fold, self.folds)), self.tuning, deadline=self.timer.over)
        model, chosen = self.model_of(algorithm, column), None
        fit = lambda m, some=None: m.fit_predict(made, self.fold, self.folds, some) if self.task.several else m.fit_predict(made, k_folds(self.fold, self.folds), some)
        if self.cutoff is not None:
            fit(model)
            chosen = selection.by_cutoff(model.importances(), self.cutoff)
            model = self.model_of(algorithm, column)
        out = fit(model, chosen)
        return Member(name, features, model, chosen), out.select(*self.keys, column)

    def model_of(self, algorithm: Algorithm, column: str) -> OutOfFold | MultiOutput:
        return MultiOutput(algorithm, self.task, self.targets, column) if self.task.several else OutOfFold(algorithm, self.task, column)

    def blended(self, df: DataFrame, names: list[str]) -> DataFrame:
        if len(names) == 1:
            return df.withColumn("prediction", F.col(names[0]))
        if self.task.name == "multiclass" or self.task.several:
            parts = [F.transform(n, lambda x: x / len(names)) for n in names]
            total = parts[0]
            for p in parts[1:]:
                total = F.zip_with(total, p, lambda a, b: a + b)
            return df.withColumn("prediction", total)
        if not hasattr(self, "blender"):
            score = lambda d, p: self.task.scores(d, self.target, p)
            if self.blend == "best":
                best = blending.best_model(df, names, score)
                self.weights = [float(n == best) for n in names]
            elif self.blend == "mean":
                self.weights = [1 / len(names)] * len(names)
            else:
                self.weights = blending.WeightedBlender(score, 2).fit(df, names).weights
            self.blender = True
        return df.withColumn("prediction", blending.weighted_mean(names, self.weights))

    def predict(self, df: DataFrame) -> DataFrame:
        frame = self.reader.read(df)
        for level in self.members:
            scored = frame.df
            for m in level:
                scored = scored.join(m.model.predict(m.features.transform(frame)).select(*self.keys, m.model.name), self.keys, "left")
            scored, roles = self.with_predictions(scored, frame.roles, [m.model.name for m in level])
            frame = Frame(scored, roles, frame.keys)
        return self.blended(frame.df, [m.model.name for m in self.members[-1]]).select(*self.keys, "prediction")

    def feature_scores(self) -> list[tuple[str, float]]:
        """Importances of the first level summed by source column, greatest first."""
        total: dict[str, float] = {}
        for m in self.members[0]:
            for c, v in m.model.importances().items():
                total[c] = total.get(c, 0.0) + v
        names = lineage(list(self.reader.state["roles"]), list(total))
        return selection.roll_up(total, lambda c: names.get(c, c))

    def permutation_scores(self, df: DataFrame) -> list[tuple[str, float]]:
        """What the score of the whole preset on rows with a target loses when a source column is dealt anew among them, greatest first."""
        features = [c for c, r in self.reader.state["roles"].items() if r.name in ("numeric", "category", "datetime", "text")]
        frame = self.reader.read(df)
        frame = self.reader.coded(frame) if "classes" in self.reader.state else frame
        truth = stored(frame.df.select(*self.keys, *(self.targets if self.task.several else [self.target])))
        score = lambda d: self.task.score(self.predict(d).join(truth, self.keys), self.target, "prediction")
        return list(selection.permutation_importances(df, self.keys, features, score).items())

    def save(self, path: str) -> None:
        """All that ``predict`` needs; ``TabularAutoML.load`` reads it."""
        persistence.save(self, path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> TabularAutoML:
        return persistence.load(spark, path)


def partial_dependence(automl: TabularAutoML, df: DataFrame, column: str, bins: int = 30, top: int = 10, level: str = "year") -> tuple[DataFrame, DataFrame]:
    """Individual curves (keys, place, value, n and p) of a column of the fitted preset, and their means by grid value.

    A number gets the middles of ``bins`` equal bins, a category its ``top`` values and the others as one, a date its
    years, months or days of the week. All rows and grid values are scored in one pass, under keys of their own.
    """
    kind = automl.reader.state["roles"][column].name
    if kind == "datetime":
        df = df.withColumn(column, F.to_timestamp(F.col(f"`{column}`")))
    elif kind == "category":
        df = df.withColumn(column, F.col(f"`{column}`").cast("string"))
    grid = stored({"numeric": lambda: dependence.number_grid(df, column, bins), "datetime": lambda: dependence.date_grid(df, column, level)}.get(kind, lambda: dependence.category_grid(df, column, top))())
    key = automl.keys

    def score(spread: DataFrame) -> DataFrame:
        # a row and grid value is a row of its own for the preset: its keys get the place with them
        own = spread.withColumns({f"own_{k}__": F.col(f"`{k}`") for k in key})
        own = stored(own.withColumn(key[0], F.xxhash64(*map(F.col, key), "place_")))
        scored = automl.predict(own).select(*key, F.col("prediction").alias("p"))
        back = own.join(scored, key).drop(*key)
        return back.withColumnsRenamed({f"own_{k}__": k for k in key})

    curves = dependence.individual_curves(df, key, column, grid, score, level if kind == "datetime" else None)
    return curves, dependence.dependence(curves)
