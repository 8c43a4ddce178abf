"""Blending, components, constant columns and out-of-fold predictions against plain computations."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from larkspur import roles as R
from larkspur.frame import Frame
from larkspur.functions import metrics, ordered
from larkspur.operators import blending, models, validation, vectors


@pytest.fixture(scope="module")
def scored(spark):
    r = np.random.default_rng(4)
    y = r.integers(0, 2, 400)
    a, b = y + r.normal(0, 0.8, 400), y + r.normal(0, 1.2, 400)
    rows = [(k, int(y[k]), float(a[k]), float(b[k]) if k % 9 else None) for k in range(400)]
    return spark.createDataFrame(rows, "id int, y int, a double, b double").persist()


def test_blend_search_finds_the_best_of_a_fine_grid(scored):
    task = models.Task("binary", (lambda y, p: F.avg((y - p) ** 2)), more=False)
    made = blending.WeightedBlender(lambda d, p: task.scores(d, "y", p), 3, steps=3, least=0.0).fit(scored, ["a", "b"])
    table = scored.toPandas()
    a, b, y = table.a.to_numpy(), table.b.to_numpy(), table.y.to_numpy()
    grid = np.linspace(0, 1, 2001)
    error = [np.mean((y - np.where(np.isnan(b), a, (1 - w) * a + w * np.nan_to_num(b))) ** 2) for w in grid]
    assert made.weights[1] == pytest.approx(grid[int(np.argmin(error))], abs=0.01)


def test_scores_of_several_predictions_equal_single_ones(scored):
    both = metrics.scores(scored, "y", [F.col("a"), F.col("b")], "auc")
    assert both == [metrics.score(scored, "y", c, "auc") for c in ("a", "b")]
    table = scored.filter("b is not null").toPandas()
    pos, neg = table[table.y == 1].b.to_numpy(), table[table.y == 0].b.to_numpy()
    assert both[1] == pytest.approx((pos[:, None] > neg[None]).mean())
    assert metrics.scores(scored, "y", [F.col("b")], "mse")[0] == pytest.approx(-((table.y - table.b) ** 2).mean())


def test_parts_give_what_one_window_gives(scored, monkeypatch):
    whole = ordered.quantiles(scored, "a", [0.1, 0.5, 0.77]).first(), metrics.gini(scored, ["a", "b"], "y").orderBy("feature").collect()
    curve = metrics.uplift_auc(scored.withColumn("t", F.col("id") % 2), "y", "a", "t").first()[0]
    monkeypatch.setattr(ordered, "ROWS_PER_PART", 30)
    parts = ordered.quantiles(scored, "a", [0.1, 0.5, 0.77]).first(), metrics.gini(scored, ["a", "b"], "y").orderBy("feature").collect()
    assert list(parts[0]) == pytest.approx(list(whole[0]))
    assert [r["gini"] for r in parts[1]] == pytest.approx([r["gini"] for r in whole[1]])
    assert metrics.uplift_auc(scored.withColumn("t", F.col("id") % 2), "y", "a", "t").first()[0] == pytest.approx(curve)
    assert ordered.running(scored, "a", {"n": F.lit(1)}, keep_part=True).select("part_").distinct().count() > 8
    # groups of different size and scale, with a null among the groups
    wide = scored.select(F.explode(F.array(F.struct(F.lit(None).cast("string").alias("c"), (F.col("a") / 1e6).alias("v")), F.struct(F.lit("w").alias("c"), (F.col("a") * 1e6).alias("v")))).alias("x")).select("x.*")
    both = {r["c"]: r for r in ordered.quantiles(wide, "v", [0.1, 0.5], ["c"]).collect()}
    assert [both[None]["q0"] * 1e6, both["w"]["q1"] / 1e6] == pytest.approx(list(whole[0])[:2])


def test_constant_rates_without_counting_all_values(spark):
    df = spark.createDataFrame([(k, "same" if k else "x", None if k % 2 else 7, float(k % 3)) for k in range(2000)], "a int, b string, c int, d double")
    got = {r["feature"]: r for r in metrics.constant_rates(df, ["a", "b", "c", "d"], 0.999).collect()}
    full = {r["feature"]: r for r in metrics.constant_rates(df, ["a", "b", "c", "d"]).collect()}
    assert got["b"]["constant_rate"] == full["b"]["constant_rate"] == 1999 / 2000
    assert got["c"]["constant_rate"] == full["c"]["constant_rate"] == 0.5 and got["c"]["null_rate"] == 0.5
    assert got["a"]["constant_rate"] is None and got["d"]["constant_rate"] is None


def test_components_equal_those_of_numpy(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(200, 6)) * np.arange(1, 7) + 3
    df = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "k int, v array<double>")
    for kind, matrix in ((vectors.PrincipalComponents, x - x.mean(0)), (vectors.SingularVectors, x)):
        want = vectors.oriented(np.linalg.svd(matrix, full_matrices=False)[2][:3].T)
        fitted = kind("v", 3).fit(df)
        assert np.allclose(fitted.matrix, want)
        names = [f"{fitted.prefix}_{i}" for i in range(3)]
        assert np.allclose(fitted.transform(df).orderBy("k").select(*names).toPandas().to_numpy(), matrix @ want)


def test_out_of_fold_predictions_come_from_the_other_folds(scored):
    frame = Frame(scored.na.fill(0.0).withColumn("fold", F.col("id") % 4), {"y": R.make("target"), "fold": R.make("folds"), "a": R.numeric(), "b": R.numeric()}, ["id"])
    for kind, params in (("linear", {}), ("gbt", {"maxIter": 2}), ("forest", {"numTrees": 5, "maxDepth": 3})):
        got = models.OutOfFold(models.Algorithm(kind, params), models.Task("binary")).fit_predict(frame, validation.k_folds("fold", 4))
        assert got.count() == 400 and got.filter("p is null").count() == 0
        assert metrics.score(got, "y", "p", "auc") > 0.7
        if kind == "linear":
            data = models.assembled(frame, ["a", "b"])
            model = LogisticRegression(featuresCol=models.FEATURES, labelCol="y", regParam=1e-3, maxIter=50).fit(data.filter("fold <> 2"))
            want = models.predict(model, data.filter("fold = 2"), models.Task("binary"), "p").select("id", "p").toPandas().set_index("id").p
            mine = got.filter("fold = 2").select("id", "p").toPandas().set_index("id").p
            assert np.allclose(mine.sort_index(), want.sort_index())


def test_a_saved_preset_predicts_the_same(spark, data, tmp_path):
    from larkspur.plans import automl
    from larkspur.plans.flagship import ROLES, credit_frame

    df = credit_frame(spark, data).df.drop("fold")
    made = automl.TabularAutoML(models.Task("binary"), ["o_orderkey"], (("scorecard", "forest"),), 2, blend="mean")
    made.fit_predict(df, {c: r for c, r in ROLES.items() if c != "fold"})
    made.save(f"file://{tmp_path}/automl")
    back = automl.TabularAutoML.load(spark, f"file://{tmp_path}/automl")
    pairs = made.predict(df).join(back.predict(df).withColumnRenamed("prediction", "again"), "o_orderkey")
    assert pairs.count() == df.count() and pairs.filter("abs(prediction - again) > 1e-9 or prediction is null").count() == 0


def test_paths_nested_folds_and_several_targets(scored):
    wide = scored.na.fill(0.0).withColumns({"fold": F.col("id") % 3, "z": F.col("a") * 2 + 1})
    frame = Frame(wide, {"y": R.make("target"), "fold": R.make("folds"), "a": R.numeric(), "b": R.numeric()}, ["id"])
    nested = models.Nested(models.Algorithm("linear"), models.Task("binary"), [10.0, 0.1, 1e-3])
    got = nested.fit_predict(frame, validation.k_folds("fold", 3))
    assert got.count() == 400 and got.filter("p is null").count() == 0 and len(nested.chosen) == 3
    assert metrics.score(got, "y", "p", "auc") > 0.7
    both = models.MultiOutput(models.Algorithm("linear", {"regParam": 0.0}), models.Task("reg"), ["y", "z"])
    out = both.fit_predict(frame, "fold", 3)
    assert out.filter("size(p) = 2 and abs(p[1] - z) < 1e-6").count() == 400
    assert both.score(out) == pytest.approx(metrics.score(out.withColumn("q", F.col("p")[0]), "y", "q", "mse") / 2, abs=1e-6)


def test_a_text_becomes_one_score(spark):
    from larkspur.operators.text import TextScore

    words = ["red", "blue", "green", "sun", "moon", "star"]
    rows = [(k, [words[(k * 7 + j * j + k // 6) % 6] for j in range(3)] + (["good"] if k % 2 else ["bad"]), k % 2, k // 2 % 3) for k in range(60)]
    df = spark.createDataFrame(rows, "id int, tokens array<string>, y int, fold int")
    model = TextScore("tokens", "y", "score", least_df=2)
    got = model.fit_predict(df, "fold", 3)
    assert got.count() == 60 and got.filter("(score > 0.5) <> (y = 1)").count() == 0
    assert model.predict(df).filter("(score > 0.5) <> (y = 1)").count() == 0
