"""Use of a time budget: presets in a queue of configurations, again with other seeds while time is left.

Every finished run is stored under a folder (its out-of-fold predictions, then the fitted preset, then a mark), so
that a search which was interrupted goes on where it stopped. The runs of one configuration are averaged; the
configurations are blended with searched weights.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from larkspur.operators import blending
from larkspur.operators.models import Task
from larkspur.plans.automl import TabularAutoML
from larkspur.storage import stored


@dataclass
class UtilizedAutoML:
    """``fit_predict`` runs the configurations in turn, in rounds with other seeds, until ``budget`` seconds are spent or ``rounds`` are done.

    A configuration is a dict of arguments of :class:`TabularAutoML`. The first run is always made; a later one only if the
    mean run so far fits in the time that is left. Times of stored runs count as spent. Binary and numeric tasks are blended.
    """

    task: Task
    keys: list[str]
    configurations: list[dict[str, Any]]
    folder: str
    budget: float = 3600.0
    rounds: int = 10
    clock: Callable[[], float] = time.monotonic
    fitted: int = 0
    runs: dict[int, list[TabularAutoML]] = field(default_factory=dict)

    def place(self, number: int) -> str:
        return f"{self.folder.rstrip('/')}/run-{number:04d}"

    def finished(self, spark: SparkSession, number: int) -> float | None:
        """Seconds that a stored run took; None where there is no whole one."""
        try:
            return spark.read.parquet(f"{self.place(number)}/mark").first()["seconds"]
        except AnalysisException:  # no such folder, or nothing in it
            return None

    def run(self, number: int, df: DataFrame, declared: dict) -> float:
        """Fit and store one run; what a lost one left behind is replaced."""
        start, where = self.clock(), self.place(number)
        made = TabularAutoML(self.task, self.keys, **self.configurations[number % len(self.configurations)], seed=42 + number // len(self.configurations))
        out = made.fit_predict(df, declared)
        out.write.mode("overwrite").parquet(f"{where}/predictions")
        made.save(f"{where}/preset")
        seconds = float(self.clock() - start)
        df.sparkSession.createDataFrame([(seconds,)], "seconds double").coalesce(1).write.mode("overwrite").parquet(f"{where}/mark")
        self.fitted += 1
        return seconds

    def fit_predict(self, df: DataFrame, declared: dict) -> DataFrame:
        """keys, target and the blended out-of-fold prediction."""
        spark, times, n = df.sparkSession, [], len(self.configurations)
        for number in range(self.rounds * n):
            took = self.finished(spark, number)
            if took is None:
                left = self.budget - sum(times)
                if times and sum(times) / len(times) > left:
                    break
                took = self.run(number, df, declared)
            times.append(took)
        return self.blend(spark, len(times))

    def blend(self, spark: SparkSession, n_runs: int) -> DataFrame:
        n, joined = len(self.configurations), None
        self.runs = {c: [TabularAutoML.load(spark, f"{self.place(k)}/preset") for k in range(c, n_runs, n)] for c in range(min(n, n_runs))}
        for c in self.runs:
            parts = [spark.read.parquet(f"{self.place(k)}/predictions") for k in range(c, n_runs, n)]
            target = next(x for x in parts[0].columns if x not in self.keys and x != "prediction")
            every = parts[0]
            for part in parts[1:]:
                every = every.unionByName(part)
            mean = every.groupBy(*self.keys).agg(F.first(target).alias(target), F.avg("prediction").alias(f"p{c}"))
            joined = mean if joined is None else joined.join(mean.drop(target), self.keys)
        joined, names = stored(joined), [f"p{c}" for c in self.runs]
        self.weights = [1.0] if len(names) == 1 else blending.WeightedBlender(lambda d, p: self.task.scores(d, target, p), 2).fit(joined, names).weights
        return joined.select(*self.keys, target, blending.weighted_mean(names, self.weights).alias("prediction"))

    def predict(self, df: DataFrame) -> DataFrame:
        """keys and prediction: the mean of the runs of each configuration, with the weights of the configurations."""
        out = df.select(*self.keys)
        for c, runs in self.runs.items():
            for k, made in enumerate(runs):
                out = out.join(made.predict(df).withColumnRenamed("prediction", f"p{c}_{k}"), self.keys)
            out = out.withColumn(f"p{c}", sum((F.col(f"p{c}_{k}") for k in range(len(runs))), F.lit(0.0)) / len(runs))
        return out.select(*self.keys, blending.weighted_mean([f"p{c}" for c in self.runs], self.weights).alias("prediction"))
