"""Presets over texts, and over several targets at once."""

import pytest
from pyspark.sql import functions as F

from larkspur.functions import metrics
from larkspur.operators import models
from larkspur.plans import automl


@pytest.fixture(scope="module")
def labelled(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    df = docs.join(labels, "doc_id").select("doc_id", "text", "lang", F.col("n_chars").cast("double").alias("n_chars"), "quality", "toxic")
    return df.unionByName(df.withColumn("doc_id", F.col("doc_id") + 1_000_000)).cache()


def test_texts_tell_the_label(labelled):
    made = automl.TabularAutoML(models.Task("binary"), ["doc_id"], (("linear_l2",),), 3, debug=True)
    out = made.fit_predict(labelled.drop("toxic", "n_chars"), {"quality": "target", "text": "text", "lang": "category"})
    assert out.count() == labelled.count() and out.filter("prediction is null").count() == 0
    assert metrics.score(out, "quality", "prediction", "auc") > 0.8
    assert {"text__text", "words__text"} <= set(made.members[0][0].model.features)
    new = labelled.limit(20).withColumn("text", F.when(F.col("doc_id") % 3 > 0, F.col("text")))
    scored = made.predict(new)
    assert scored.count() == 20 and scored.filter("prediction is null").count() == 0


def test_two_labels_at_once(labelled):
    made = automl.TabularAutoML(models.Task("multilabel"), ["doc_id"], (("linear_l2", "forest"),), 2, debug=True)
    out = made.fit_predict(labelled.drop("n_chars"), {"quality": "target", "toxic": "target", "text": "text", "lang": "category"})
    assert out.columns == ["doc_id", "quality", "toxic", "prediction"] and out.filter("size(prediction) <> 2").count() == 0
    assert metrics.score(out.withColumn("p", F.col("prediction")[0]), "quality", "p", "auc") > 0.75
    assert made.task.score(out, ["quality", "toxic"], "prediction") > -0.69
    assert made.predict(labelled.limit(5)).filter("size(prediction) = 2").count() == 5


def test_two_numbers_in_two_levels(spark):
    df = spark.range(300).select("id", (F.pmod("id", F.lit(17)) / 3.0).alias("x"), F.when(F.pmod("id", F.lit(3)) == 0, "a").otherwise("b").alias("c"))
    df = df.withColumns({"y": F.col("x") * 2 + 1, "z": F.when(F.col("c") == "a", 5.0).otherwise(-1.0) - F.col("x")})
    made = automl.TabularAutoML(models.Task("multi:reg"), ["id"], (("linear_l2",), ("linear_l2",)), 3, debug=True, cutoff=0.0)
    out = made.fit_predict(df, {"y": "target", "z": "target"})
    assert made.task.score(out, ["y", "z"], "prediction") > -0.2
    both = made.predict(df.limit(40)).join(df, "id").agg(F.avg(F.abs(F.col("prediction")[0] - F.col("y"))), F.avg(F.abs(F.col("prediction")[1] - F.col("z")))).first()
    assert max(both) < 0.3
    assert set(dict(made.feature_scores())) == {"x", "c"}


def test_three_classes_in_two_levels(spark):
    df = spark.range(240).select("id", F.pmod("id", F.lit(3)).cast("int").alias("y"), (F.pmod("id", F.lit(3)) + F.pmod("id", F.lit(5)) / 10.0).alias("x"), F.pmod("id", F.lit(7)).cast("double").alias("w"))
    made = automl.TabularAutoML(models.Task("multiclass"), ["id"], (("linear_l2",), ("forest",)), 2, debug=True, cutoff=0.0)
    out = made.fit_predict(df, {"y": "target"})
    right = out.withColumn("best", F.array_position("prediction", F.array_max("prediction")) - 1).filter("best = y").count()
    assert right > 220 and made.predict(df.limit(10)).filter("size(prediction) = 3").count() == 10
