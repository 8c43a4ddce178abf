"""Small fixtures with nulls, ties, new values and empty tables."""

import pytest
from pyspark.sql import functions as F

from larkspur import roles as R
from larkspur.frame import Frame
from larkspur.functions import metrics as M
from larkspur.functions.ordered import column_quantiles, quantiles
from larkspur.operators import blending, categorical, numeric, selection, sequence, validation
from larkspur.operators.datetimes import Seasons
from larkspur.operators.groupby import GroupStatistics


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(1, 1.0, "a"), (2, None, "b"), (3, float("nan"), "a"), (4, 5.0, None), (5, 9.0, "a"), (6, float("inf"), "b")]
    df = spark.createDataFrame(rows, "id long, x double, c string")
    return Frame(df, {"x": R.numeric(), "c": R.category(unknown=0)}, ["id"])


def test_nulls_and_nan_are_missing(frame):
    assert frame.null_count().first()["total"] == 3
    flags = numeric.NullFlags().fit_transform(frame).df.orderBy("id").collect()
    assert [r["nanflg__x"] for r in flags] == [0, 1, 1, 0, 0, 0]


def test_fill_and_scale(frame):
    finite = numeric.FillInfinite().fit_transform(frame)
    filled = numeric.FillMedian().fit_transform(finite).df.orderBy("id").collect()
    assert [r[-1] for r in filled] == [1, 5, 5, 5, 9, 5]
    assert numeric.FillMean().fit(finite).state["fillinf__x"] == 5


def test_empty_frame(spark, frame):
    empty = frame.filter("id < 0")
    assert numeric.FillMedian().fit_transform(empty).df.count() == 0
    assert numeric.QuantileBins().fit(empty).transform(frame).df.count() == 6
    assert categorical.LabelEncode().fit(empty).transform(frame).df.agg(F.sum("le__c")).first()[0] == 0


def test_label_codes_by_count_then_value(frame):
    got = categorical.LabelEncode().fit_transform(frame).df.orderBy("id").collect()
    assert [r["le__c"] for r in got] == [1, 2, 1, 3, 1, 2]


def test_new_values_get_the_default(spark, frame):
    op = categorical.FrequencyEncode().fit(frame)
    new = Frame(spark.createDataFrame([(9, 0.0, "z")], frame.df.schema), frame.roles, frame.keys)
    assert op.transform(new).df.first()["freq__c"] == 1


def test_quantiles_are_exact(spark):
    df = spark.range(1000).select((F.col("id") % 97).cast("double").alias("v"), (F.col("id") % 3).alias("g"))
    pdf = df.toPandas()
    got = column_quantiles(df, ["v"], [0.1, 0.5, 0.9])["v"]
    assert got == pytest.approx(pdf.v.quantile([0.1, 0.5, 0.9]).tolist())
    by = {r["g"]: r["q0"] for r in quantiles(df, "v", [0.25], ["g"]).collect()}
    assert by == pytest.approx(pdf.groupby("g").v.quantile(0.25).to_dict())


def test_auc_of_ties_and_extremes(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.1), (0, 0.5), (1, 0.9)], "y int, p double")
    assert M.auc(df, "y", "p").first()["auc"] == pytest.approx(0.625)
    assert M.auc(df.filter("y = 1"), "y", "p").first()["auc"] is None


def test_group_statistics_of_unseen_groups(spark):
    f = Frame(spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0)], "id long, g string, x double"), {"x": R.numeric()}, ["id"])
    op = GroupStatistics("g", ["x"]).fit(f)
    other = Frame(spark.createDataFrame([(3, "b", 1.0), (4, "a", 5.0)], "id long, g string, x double"), f.roles, ["id"])
    got = {r["id"]: r["grb__g__delta_mean__x"] for r in op.transform(other).df.collect()}
    assert got == {3: None, 4: 3.0}


def test_blend_renormalises_and_prunes(spark):
    df = spark.createDataFrame([(None, 1.0), (0.0, 1.0), (None, None)], "a double, b double")
    assert [r[0] for r in df.select(blending.weighted_mean(["a", "b"], [0.75, 0.25])).collect()] == [1.0, 0.25, None]
    assert blending.pruned([0.5, 0.46, 0.04], 0.05) == pytest.approx([0.5 / 0.96, 0.46 / 0.96, 0.0])


def test_selection():
    assert selection.by_cutoff({"a": 0.0, "b": 0.0}) in (["a"], ["b"])
    assert selection.greedy([["a"], ["b"], ["c"]], lambda f: len(set(f) - {"b"})) == ["a", "c"]


def test_folds_keep_class_shares(spark):
    df = spark.range(100).withColumn("y", F.col("id") % 4)
    sizes = validation.stratified_folds(df, "y", ["id"]).groupBy("y", "fold").count().collect()
    assert {r["count"] for r in sizes} == {5}


def test_windows_are_anchored_at_the_end(spark):
    df = spark.range(5).select(F.lit("s").alias("s"), F.col("id").alias("t"), F.col("id").cast("double").alias("v"))
    got = sequence.windows(df, ["s"], ["t"], "v", 3, 2).orderBy("t").collect()
    assert [(r["t"], r["window"]) for r in got] == [(2, [0.0, 1.0, 2.0]), (4, [2.0, 3.0, 4.0])]


def test_transform_works_on_a_stream(spark, tmp_path):
    from larkspur.streaming.scoring import transform_stream, write_batches

    path = str(tmp_path / "in")
    spark.sql("select 1L as id, timestamp'2024-02-29 10:00:00' as d").write.parquet(path)
    frame = Frame(spark.read.parquet(path), {"d": R.datetime()}, ["id"])
    stream = spark.readStream.schema(frame.df.schema).parquet(path)
    write_batches(transform_stream(stream, frame, Seasons(("y", "wd"))), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    row = spark.read.parquet(str(tmp_path / "out")).first()
    assert (row["season_y__d"], row["season_wd__d"]) == (2024, 3)


def test_sources(spark, tmp_path):
    import pandas as pd

    from larkspur.sources.readers import read_data, text_rows

    pdf = pd.DataFrame({"a": [1, 2], "b": ["x", None]})
    pdf.to_feather(tmp_path / "t.feather")
    pdf.to_csv(tmp_path / "t.csv", index=False)
    assert read_data(spark, str(tmp_path / "t.feather"), ["b"]).collect() == read_data(spark, pdf, ["b"]).collect()
    assert read_data(spark, str(tmp_path / "t.csv")).count() == text_rows(spark, str(tmp_path / "t.csv")).first()["n"] == 2
    assert read_data(spark, {"data": pdf, "target": [0, 1]}).columns == ["a", "b", "__TARGET__"]
