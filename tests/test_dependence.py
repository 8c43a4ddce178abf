"""Dependence curves against plain loops, and of a fitted preset."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import dependence as D


@pytest.fixture(scope="module")
def df(spark):
    r = np.random.default_rng(1)
    rows = [(i, float(r.normal()) if i % 9 else None, str(r.choice(["a", "b", "c", "d", "e"], p=[0.4, 0.3, 0.1, 0.1, 0.1])) if i % 10 else None, datetime.datetime(2020 + i % 3, 1 + i % 12, 1 + i % 28)) for i in range(200)]
    return spark.createDataFrame(rows, "id int, x double, c string, t timestamp")


def score(d):
    p = F.coalesce("x", F.lit(0.0)) * 2 + F.when(F.col("c") == "a", 5).when(F.col("c") == "d", 1).when(F.col("c") == "e", -1).otherwise(0) + F.year("t") + F.month("t") / 100
    return d.withColumn("p", p)


def plain(row, **k):
    r = row.asDict() | k
    return 2 * (r["x"] or 0.0) + {"a": 5, "d": 1, "e": -1}.get(r["c"], 0) + r["t"].year + r["t"].month / 100


def test_numbers(df):
    rows = df.collect()
    x = np.array([r["x"] for r in rows if r["x"] is not None])
    counts, edges = np.histogram(x, bins=8)
    grid = D.number_grid(df, "x", 8)
    assert [r["n"] for r in grid.orderBy("place").collect()] == counts.tolist()
    got = {(r["id"], r["place"]): r for r in D.individual_curves(df, ["id"], "x", grid, score).collect()}
    assert len(got) == 200 * 8
    for r in rows:
        for k, v in enumerate((edges[1:] + edges[:-1]) / 2):
            assert got[r["id"], k]["p"] == pytest.approx(plain(r, x=v))
    mean = {r["place"]: r for r in D.dependence(D.individual_curves(df, ["id"], "x", grid, score)).collect()}
    assert mean[3]["mean"] == pytest.approx(np.mean([got[r["id"], 3]["p"] for r in rows])) and mean[3]["spread"] == pytest.approx(np.std([got[r["id"], 3]["p"] for r in rows]))


def test_categories_and_the_others(df):
    grid = D.category_grid(df, "c", 2)
    shown = grid.orderBy("place").collect()
    assert [r["value"] for r in shown] == ["a", "b", D.OTHER] and sum(r["n"] for r in shown) == 180
    curves = D.individual_curves(df, ["id"], "c", grid, lambda d: score(d).withColumn("p", F.when(F.col("c").isin("c", "d", "e", "a", "b"), F.col("p")))).collect()
    rows = {r["id"]: r for r in df.collect()}
    assert len(curves) == 600
    for r in curves:
        want = [plain(rows[r["id"]], c=v) for v in ("c", "d", "e")] if r["value"] == D.OTHER else [plain(rows[r["id"]], c=r["value"])]
        assert any(r["p"] == pytest.approx(w) for w in want)
    drawn = [r["other_"] for r in D.others(df, ["id"], "c", grid.filter(F.col("value") != D.OTHER)).collect()]
    assert len(drawn) == 200 and set(drawn) == {"c", "d", "e"} and all(30 < drawn.count(v) < 110 for v in "cde")
    assert D.category_grid(df, "c", 10).count() == 5
    assert D.individual_curves(df, ["id"], "c", D.category_grid(df, "c", 10), score).count() == 1000


@pytest.mark.parametrize(("level", "values"), [("year", [2020, 2021, 2022]), ("month", list(range(1, 13))), ("dayofweek", list(range(7)))])
def test_dates(df, level, values):
    grid = D.date_grid(df, "t", level)
    assert [r["value"] for r in grid.orderBy("place").collect()] == values and grid.agg(F.sum("n")).first()[0] == 200
    got = D.individual_curves(df, ["id"], "t", grid, lambda d: d.withColumn("p", D.LEVELS[level]("t").cast("double")), level)
    assert got.count() == 200 * len(values) and got.filter("p <> value").count() == 0


def test_of_nothing(df):
    none = df.filter("id < 0")
    assert D.number_grid(none, "x").count() == D.category_grid(none, "c").count() == 0
    assert D.individual_curves(none, ["id"], "x", D.number_grid(df, "x", 3), score).count() == 0
    same = df.select("id", F.lit(4.0).alias("x"), "c", "t")
    assert D.number_grid(same, "x", 3).agg(F.sum("n")).first()[0] == 200


def test_of_a_preset(df, spark):
    from larkspur.operators.models import Task
    from larkspur.plans import automl

    made = automl.TabularAutoML(Task("reg"), ["id"], (("linear_l2",),), 2, debug=True)
    made.fit_predict(score(df).withColumn("y", F.col("p")).drop("p"), {"y": "target", "t": "drop"})
    curves, means = automl.partial_dependence(made, df, "x", bins=4)
    assert curves.count() == 800
    mean = [r["mean"] for r in means.orderBy("place").collect()]
    assert all(b > a + 0.5 for a, b in zip(mean, mean[1:], strict=False))
    one = df.withColumn("x", F.lit(means.orderBy("place").first()["value"]))
    assert made.predict(one).agg(F.avg("prediction")).first()[0] == pytest.approx(mean[0])
    _, kinds = automl.partial_dependence(made, df, "c", top=2)
    by = {r["value"]: r["mean"] for r in kinds.collect()}
    assert by["a"] > by["b"] + 2 and D.OTHER in by
    assert dict(made.feature_scores())["x"] > 0
