"""The time budget of a queue of presets, with a clock of its own, and going on after an interruption."""

import pytest
from pyspark.sql import functions as F

from larkspur.operators.models import Task
from larkspur.plans import utilized
from larkspur.plans.utilized import UtilizedAutoML


class Clock:
    """Each look at it is ten seconds later."""

    def __init__(self):
        self.now = 0.0

    def __call__(self):
        self.now += 10
        return self.now


@pytest.fixture(scope="module")
def df(spark):
    return spark.range(120).select("id", (F.pmod("id", F.lit(11)) / 2.0).alias("x"), (F.pmod("id", F.lit(11)) * 3 + F.pmod("id", F.lit(2))).cast("double").alias("y")).cache()


CONFIGURATIONS = [{"levels": (("linear_l2",),), "folds": 2, "debug": True}, {"levels": (("forest",),), "folds": 2, "debug": True}]


def test_the_budget_ends_the_queue_and_a_lost_run_is_made_again(df, tmp_path, monkeypatch):
    made = UtilizedAutoML(Task("reg"), ["id"], CONFIGURATIONS, f"{tmp_path}/runs", budget=35, clock=Clock())
    run, calls = UtilizedAutoML.run, []

    def lost(self, number, *more):
        calls.append(number)
        if number == 1:
            raise RuntimeError("interrupted")
        return run(self, number, *more)

    monkeypatch.setattr(utilized.UtilizedAutoML, "run", lost)
    with pytest.raises(RuntimeError, match="interrupted"):
        made.fit_predict(df, {"y": "target"})
    assert calls == [0, 1] and made.fitted == 1
    monkeypatch.setattr(utilized.UtilizedAutoML, "run", run)
    again = UtilizedAutoML(Task("reg"), ["id"], CONFIGURATIONS, f"{tmp_path}/runs", budget=35, clock=Clock())
    out = again.fit_predict(df, {"y": "target"})
    # three runs of ten seconds fit in 35; the first was there already
    assert again.fitted == 2 and [len(r) for r in again.runs.values()] == [2, 1]
    assert out.count() == 120 and out.agg(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0] < 2
    assert [m.seed for m in again.runs[0]] == [42, 43] and sum(again.weights) == pytest.approx(1)
    new = again.predict(df.limit(15))
    assert new.columns == ["id", "prediction"] and new.join(df, "id").agg(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0] < 6
    assert UtilizedAutoML(Task("reg"), ["id"], CONFIGURATIONS, f"{tmp_path}/runs", budget=35, clock=Clock()).fit_predict(df, {"y": "target"}).count() == 120
