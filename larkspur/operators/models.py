"""Estimators of Spark ML behind one interface, with out-of-fold predictions.

The features of all rows are assembled once and kept while the folds are fitted; each fold is a filter.
Predictions are one column of probabilities or numbers (p), or one array of class probabilities.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import Model as MLModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur import roles as R
from larkspur.frame import Frame
from larkspur.functions import metrics
from larkspur.operators.tuning import Choice, Parzen, Uniform
from larkspur.operators.validation import Split, k_folds
from larkspur.storage import stored

log = logging.getLogger(__name__)
FEATURES = "features__"


@dataclass
class Task:
    """What is predicted: binary, multiclass or reg, or several targets at once (multi:reg, multilabel), and the metric that judges it.

    Of several targets the metric is that of each, averaged, and a prediction is an array. The metric is a name, or a function of target and prediction to an aggregate; ``more`` tells of a
    function whether more of it is better. Scores have the sign that makes more better.
    """

    name: str
    metric: str | Callable = ""
    log_target: bool = False
    more: bool = True

    def __post_init__(self) -> None:
        self.metric = self.metric or {"binary": "auc", "multiclass": "crossentropy", "reg": "mse", "multi:reg": "mae", "multilabel": "logloss"}[self.name]

    @property
    def several(self) -> bool:
        return self.name in ("multi:reg", "multilabel")

    @property
    def one(self) -> Task:
        """The task of each target."""
        return Task({"multi:reg": "reg", "multilabel": "binary"}[self.name], self.metric, self.log_target, self.more) if self.several else self

    def score(self, df: DataFrame, target: str | list[str], prediction: str) -> float:
        return self.scores(df, target, [F.col(prediction)])[0]

    def scores(self, df: DataFrame, target: str | list[str], predictions: list) -> list[float | None]:
        """Of several predictions (columns), from one job for each target."""
        if self.several:
            each = [metrics.scores(df, t, [p[k] for p in predictions], self.metric, self.more) for k, t in enumerate(target)]
            return [None if None in own else sum(own) / len(own) for own in zip(*each, strict=True)]
        return metrics.scores(df, target, predictions, self.metric, self.more)


@dataclass
class Algorithm:
    """A kind of model and its parameters; ``fit`` returns a fitted Spark ML model."""

    kind: str
    params: dict[str, Any] = field(default_factory=dict)
    seed: int = 42

    def estimator(self, task: Task, target: str, weight: str | None):
        classes = task.name != "reg"
        common = {"featuresCol": FEATURES, "labelCol": target} | ({"weightCol": weight} if weight else {})
        kinds: dict[str, Callable] = {
            "gbt": lambda: self.boosted(task, common),
            "forest": lambda: (RandomForestClassifier if classes else RandomForestRegressor)(seed=self.seed, **({"numTrees": 50, "maxDepth": 8} | self.params), **common),
            "linear": lambda: (LogisticRegression if classes else LinearRegression)(**({"regParam": 1e-3, "maxIter": 50} | self.params), **common),
            "linear_l1": lambda: (LogisticRegression if classes else LinearRegression)(**({"regParam": 1e-3, "elasticNetParam": 1.0, "maxIter": 50} | self.params), **common),
            "mlp": lambda: MultilayerPerceptronClassifier(seed=self.seed, featuresCol=FEATURES, labelCol=target, **self.params),
        }
        return kinds[self.kind]()

    def boosted(self, task: Task, common: dict):
        params = {"maxIter": 20, "maxDepth": 5, "stepSize": 0.1} | self.params
        if task.name == "reg":
            return GBTRegressor(seed=self.seed, **params, **common)
        one = GBTClassifier(seed=self.seed, **params, **common)
        return one if task.name == "binary" else OneVsRest(classifier=one, featuresCol=FEATURES, labelCol=common["labelCol"])

    def fit(self, df: DataFrame, task: Task, target: str, weight: str | None = None) -> MLModel:
        return self.estimator(task, target, weight).fit(df)


def assembled(frame: Frame, features: list[str]) -> DataFrame:
    """A vector of the features; missing values count as 0."""
    df = frame.df.withColumns({f"f{k}__": F.coalesce(F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")), F.lit(0.0)) for k, c in enumerate(features)})
    inputs = [f"f{k}__" for k in range(len(features))]
    return VectorAssembler(inputCols=inputs, outputCol=FEATURES).transform(df).drop(*inputs)


def predict(model: MLModel, df: DataFrame, task: Task, name: str) -> DataFrame:
    kept = df.columns
    out = model.transform(df)
    if task.name == "reg":
        value = F.expm1("prediction") if task.log_target else F.col("prediction")
    elif "probability" in out.columns:
        value = vector_to_array("probability")
        value = value[1] if task.name == "binary" else value
    else:  # one against the rest has raw scores only
        raw = F.transform(vector_to_array("rawPrediction"), lambda x: 1 / (1 + F.exp(-x)))
        value = F.transform(raw, lambda x: x / F.aggregate(raw, F.lit(0.0), lambda a, b: a + b))
    return out.withColumn(name, value).select(*kept, name)


def feature_weights(model: MLModel):
    """Gain or size of the weights of each feature: of one model, of all classes, or of all models of one against the rest."""
    if hasattr(model, "models"):
        return sum(feature_weights(m) for m in model.models) / len(model.models)
    if hasattr(model, "featureImportances"):
        return model.featureImportances.toArray()
    if hasattr(model, "coefficientMatrix"):
        return abs(model.coefficientMatrix.toArray()).mean(axis=0)
    if hasattr(model, "coefficients"):
        return abs(model.coefficients.toArray())
    raise ValueError(f"{type(model).__name__} tells no importance of its features")


class OutOfFold:
    """An algorithm fitted on every split; a row is predicted by the models that didn't see it, a new row by the mean of all."""

    def __init__(self, algorithm: Algorithm, task: Task, name: str = "p"):
        self.algorithm, self.task, self.name, self.models = algorithm, task, name, []

    def fit_predict(self, frame: Frame, splits: Iterator[Split], features: list[str] | None = None) -> DataFrame:
        """Keys, attributes and ``name``; null where no split validates a row, the mean where several do."""
        self.features = features or frame.features
        target, weight = frame.attribute("target"), frame.attribute("weights")
        df = assembled(frame, self.features)
        if self.task.log_target:
            df = df.withColumn("target__", F.log1p(target))
        label = "target__" if self.task.log_target else target
        df = stored(df)
        kept = [*frame.keys, *[c for c in frame.df.columns if c in frame.roles and c not in frame.features and c not in frame.keys]]
        parts = []
        for split in splits:
            model = self.algorithm.fit(df.filter(split.train), self.task, label, weight)
            self.models.append(model)
            parts.append(predict(model, df.filter(split.valid), self.task, self.name).select(*frame.keys, self.name))
        scored = parts[0]
        for part in parts[1:]:
            scored = scored.unionByName(part)
        if self.task.name == "multiclass":  # the mean of each class
            each = scored.select(*frame.keys, F.posexplode(self.name).alias("k__", "v__")).groupBy(*frame.keys, "k__").agg(F.avg("v__").alias("v__"))
            scored = each.groupBy(*frame.keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("k__", "v__"))), lambda x: x["v__"]).alias(self.name))
        else:
            scored = scored.groupBy(*frame.keys).agg(F.avg(self.name).alias(self.name))
        return df.select(*kept).join(scored, frame.keys, "left")

    def predict(self, frame: Frame) -> DataFrame:
        df = assembled(frame, self.features)
        names = [f"{self.name}__{k}" for k in range(len(self.models))]
        for name, model in zip(names, self.models, strict=True):
            df = predict(model, df, self.task, name)
        if self.task.name == "multiclass":
            mean = F.transform(F.arrays_zip(*names), lambda x: sum((x[n] for n in names), F.lit(0.0)) / len(names))
        else:
            mean = sum((F.col(n) for n in names), F.lit(0.0)) / len(names)
        return df.withColumn(self.name, mean).drop(FEATURES, *names)

    def importances(self) -> dict[str, float]:
        """Mean gain (or size of weights) of each feature over the models, greatest first."""
        total = dict.fromkeys(self.features, 0.0)
        for model in self.models:
            for c, v in zip(self.features, feature_weights(model), strict=True):
                total[c] += float(v) / len(self.models)
        return dict(sorted(total.items(), key=lambda x: (-x[1], x[0])))


def regularisation_path(algorithm: Algorithm, task: Task, frame: Frame, split: Split, strengths: list[float], patience: int = 2) -> tuple[Algorithm, list[tuple[float, float]]]:
    """The algorithm with the best regParam of a path from the strongest on one split, and the scores; ends after ``patience`` steps without a better one."""
    target, path, best = frame.attribute("target"), [], None
    df = stored(assembled(frame, frame.features))
    for strength in sorted(strengths, reverse=True):
        own = Algorithm(algorithm.kind, algorithm.params | {"regParam": strength}, algorithm.seed)
        value = task.score(predict(own.fit(df.filter(split.train), task, target), df.filter(split.valid), task, "p"), target, "p")
        path.append((strength, value))
        if best is None or value > best[0]:
            best, since = (value, own), 0
        elif (since := since + 1) >= patience:
            break
    return best[1], path


class Nested(OutOfFold):
    """Out-of-fold predictions whose parameters are chosen inside each training part, by inner folds from a hash of the keys.

    ``strengths`` is the path of regParam that the inner fold judges; the outer rows never take part.
    """

    def __init__(self, algorithm: Algorithm, task: Task, strengths: list[float], name: str = "p", inner: int = 3, seed: int = 7):
        super().__init__(algorithm, task, name)
        self.strengths, self.inner, self.seed, self.chosen = strengths, inner, seed, []

    def fit_predict(self, frame: Frame, splits: Iterator[Split], features: list[str] | None = None) -> DataFrame:
        kept = frame.df.columns
        inner = F.pmod(F.xxhash64(F.lit(self.seed), *frame.keys), F.lit(self.inner))
        parts = []
        for split in splits:
            own = Frame(frame.df.filter(split.train), frame.roles, frame.keys)
            best, _ = regularisation_path(self.algorithm, self.task, own, Split(inner != 0, inner == 0), self.strengths)
            self.chosen.append(best.params["regParam"])
            one = OutOfFold(best, self.task, self.name)
            scored = one.fit_predict(frame, iter([split]), features)
            parts.append(scored.filter(F.col(self.name).isNotNull()).select(*frame.keys, self.name))
            self.models += one.models
            self.features = one.features
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return frame.df.select(*[c for c in kept if c not in frame.features or c in frame.keys]).join(out, frame.keys, "left")


class MultiOutput:
    """Several targets at once: an out-of-fold model for each, and one array of predictions (multi:reg and multilabel)."""

    def __init__(self, algorithm: Algorithm, task: Task, targets: list[str], name: str = "p"):
        self.targets, self.name, self.task = targets, name, task.one
        self.parts = [OutOfFold(algorithm, self.task, f"{name}__{k}") for k in range(len(targets))]

    def of(self, frame: Frame, k: int) -> Frame:
        roles = {c: r for c, r in frame.roles.items() if c not in self.targets}
        return Frame(frame.df, roles | {self.targets[k]: R.make("target")}, frame.keys)

    def together(self, base: DataFrame, keys: list[str], parts: list[DataFrame]) -> DataFrame:
        for k, part in enumerate(parts):
            base = base.join(part.select(*keys, f"{self.name}__{k}"), keys, "left")
        names = [f"{self.name}__{k}" for k in range(len(parts))]
        return base.withColumn(self.name, F.array(*names)).drop(*names)

    def fit_predict(self, frame: Frame, fold: str, folds: int, features: list[str] | None = None) -> DataFrame:
        made = [part.fit_predict(self.of(frame, k), k_folds(fold, folds), features) for k, part in enumerate(self.parts)]
        return self.together(frame.df.select(*frame.keys, *self.targets), frame.keys, made)

    def predict(self, frame: Frame) -> DataFrame:
        return self.together(frame.df.select(*frame.keys), frame.keys, [part.predict(frame) for part in self.parts])

    def importances(self) -> dict[str, float]:
        """The mean over the targets, greatest first."""
        each = [part.importances() for part in self.parts]
        total = {c: sum(e[c] for e in each) / len(each) for c in each[0]}
        return dict(sorted(total.items(), key=lambda x: (-x[1], x[0])))

    def score(self, df: DataFrame) -> float:
        """The mean of the metric over the targets."""
        values = [self.task.score(df.withColumn("p__", F.col(self.name)[k]), t, "p__") for k, t in enumerate(self.targets)]
        return sum(values) / len(values)


SPACES: dict[str, dict[str, Any]] = {
    "gbt": {"maxDepth": Choice((3, 4, 5, 6)), "stepSize": Uniform(0.03, 0.3, log=True)},
    "forest": {"maxDepth": Choice((5, 8, 10))},
    "linear": {"regParam": Uniform(1e-6, 1.0, log=True)},
    "linear_l1": {"regParam": Uniform(1e-6, 1.0, log=True)},
}


def tune(
    algorithm: Algorithm, task: Task, frame: Frame, split: Split, trials: int = 10, seed: int = 42, fail_share: float = 0.5, deadline: Callable[[], bool] = lambda: False, at_once: int = 4
) -> Algorithm:
    """The best parameters on one split by a Parzen search that starts from the defaults; trials of one round are scored in one job.

    It ends early at the deadline, and with an error when over ``fail_share`` of the trials fail.
    """
    space, target = SPACES.get(algorithm.kind, {}), frame.attribute("target")
    search, failed, best = Parzen(space, seed), 0, (None, algorithm)
    df = stored(assembled(frame, frame.features))
    train, valid = df.filter(split.train), df.filter(split.valid)
    done = 0
    while done < trials and space and not (done and deadline()):
        params = search.suggest(min(at_once, trials - done))
        if not done:
            params[0] = {}
        done += len(params)
        scored, kept = valid, []
        for k, own in enumerate(params):
            try:
                model = Algorithm(algorithm.kind, algorithm.params | own, algorithm.seed).fit(train, task, target)
                scored = predict(model, scored, task, f"p{k}__")
                kept.append((f"p{k}__", own))
            except Exception:
                log.exception("a trial of %s failed", algorithm.kind)
                failed += 1
                if failed > fail_share * trials:
                    raise
        for (_, own), score in zip(kept, task.scores(scored, target, [F.col(n) for n, _ in kept]) if kept else [], strict=True):
            if score is None:
                continue
            search.tell(own or {k: algorithm.params[k] for k in space if k in algorithm.params}, score)
            if best[0] is None or score > best[0]:
                best = score, Algorithm(algorithm.kind, algorithm.params | own, algorithm.seed)
    return best[1]
