"""Small parts that no query runs."""

import datetime

import pytest
from pyspark.sql import functions as F

from larkspur import roles as R
from larkspur.frame import Frame
from larkspur.functions import metrics
from larkspur.operators import base, datetimes, numeric, relational, text


def test_tokens(spark):
    df = spark.createDataFrame([(1, "The cat, THE dog and 12 birds"), (2, None)], "k int, t string")
    got = {r["k"]: r["w"] for r in df.select("k", text.tokens_en(F.col("t"), ["the", "and"]).alias("w")).collect()}
    assert got == {1: ["cat", "dog", "birds"], 2: []}
    placed = text.token_places(df.select("k", text.tokens_en(F.col("t")).alias("w")), "k", "w").filter("k = 1").orderBy("place").collect()
    assert [(r["place"], r["token"]) for r in placed] == [(0, "the"), (1, "cat"), (2, "the"), (3, "dog"), (4, "and"), (5, "birds")]
    counted = {r["token"]: (r["n"], r["df"]) for r in text.vocabulary(df.select(text.tokens_en(F.col("t")).alias("w")), "w").collect()}
    assert counted["the"] == (2, 1) and counted["cat"] == (1, 1)


def test_dates(spark):
    df = spark.createDataFrame([("2024-02-03", "03.02.2024", 1_706_918_400), ("x", None, None)], "a string, b string, c long")
    row = df.select(datetimes.parse_date(F.col("a")).alias("a"), datetimes.parse_date(F.col("b"), "dd.MM.yyyy").alias("b"), datetimes.parse_date(F.col("c"), unit="s").alias("c")).collect()
    assert [row[0][c] for c in "abc"] == [datetime.datetime(2024, 2, 3)] * 3 and [row[1][c] for c in "abc"] == [None] * 3


def test_operators_of_operators(spark):
    df = spark.createDataFrame([(i, float(i), None if i % 2 else 1.0) for i in range(10)], "k int, x double, y double")
    frame = Frame(df, {"x": R.numeric(), "y": R.numeric()}, ["k"])
    each = base.Columnwise(numeric.FillMean).fit_transform(frame)
    assert each.df.agg(F.sum(each.features[1])).first()[0] == 10
    best = base.BestOf([numeric.FillMedian(), numeric.FillInfinite()], lambda f: -f.null_count().first()["total"]).fit(frame)
    assert isinstance(best.best, numeric.FillMedian) and best.transform(frame).null_count().first()["total"] == 0


def test_values_of_a_column(spark):
    df = spark.createDataFrame([(v,) for v in "aaabbc"] + [(None,)], "v string")
    assert relational.interesting_values(df, "v") == ["a", "b", "c"] and relational.interesting_values(df, "v", 0.5, 2) == ["a", "b"]
    assert metrics.general_info(df, ["v"], []).first().asDict() == {"rows": 7, "columns": 1, "used": 1, "dropped": 0}


def test_parts_of_dates_reach_deep_features(spark):
    parents = relational.Table(spark.createDataFrame([(1,), (2,)], "p int"), "p")
    rows = [(1, 1, datetime.datetime(2024, 1, 6)), (2, 1, datetime.datetime(2024, 3, 4)), (3, 2, datetime.datetime(2024, 5, 5))]
    children = relational.Table(spark.createDataFrame(rows, "c int, p int, t timestamp"), "c", dates=["t"])
    out = relational.deep_features({"parents": parents, "children": children}, [relational.Relation("children", "p", "parents")], "parents", 1, ("mean", "max"))
    got = {r["p"]: r for r in out.collect()}
    assert got[1]["ft__children_mean_month_t"] == 2 and got[1]["ft__children_mean_is_weekend_t"] == 0.5 and got[2]["ft__children_max_day_t"] == 5


@pytest.mark.parametrize("trend", ["linear", "none", "stl"])
def test_forecasts_follow_the_step_of_the_series(spark, trend):
    from larkspur.plans.timeseries import Forecaster

    rows = [("a", datetime.datetime(2024, 1, 1) + datetime.timedelta(days=2 * i), 5.0 + 2 * i + (i % 7 == 0) * 3) for i in range(80)]
    df = spark.createDataFrame(rows, "s string, t timestamp, v double")
    made = Forecaster(["s"], "t", "v", 3, 14, trend=trend)
    got = [r["forecast"] for r in made.fit(df).predict(df).orderBy("step").collect()]
    want = [5.0 + 2 * i + (i % 7 == 0) * 3 for i in range(80, 83)]
    assert got == pytest.approx(want, abs=4)


def test_scores_by_permutation(spark):
    from larkspur.operators.models import Task
    from larkspur.plans import automl

    df = spark.range(200).select("id", F.pmod("id", F.lit(10)).cast("double").alias("x"), F.pmod("id", F.lit(3)).cast("double").alias("z"), (F.pmod("id", F.lit(10)) > 4).cast("int").alias("y"))
    made = automl.TabularAutoML(Task("binary"), ["id"], (("linear_l2",),), 2, debug=True)
    made.fit_predict(df, {"y": "target"})
    scores = made.permutation_scores(df)
    assert scores[0][0] == "x" and scores[0][1] > 0.2 and abs(dict(scores)["z"]) < 0.1
