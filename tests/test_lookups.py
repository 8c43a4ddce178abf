"""Lookups of few values leave the rows where they are."""

import pytest
from pyspark.sql import functions as F

from larkspur import roles as R
from larkspur.frame import Frame
from larkspur.operators import categorical as C


@pytest.fixture
def no_guess(spark):
    """Spark itself broadcasts nothing."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


ROLES = {"y": R.make("target"), "fold": R.make("folds"), "c": R.category()}


def rows(spark):
    return spark.range(0, 700, 1, 7).select("id", F.pmod("id", F.lit(2)).cast("int").alias("y"), F.pmod("id", F.lit(5)).cast("int").alias("fold"), F.when(F.col("id") % 10 != 0, F.concat(F.lit("v"), (F.col("id") % 3).cast("string"))).alias("c"))


@pytest.mark.parametrize("made", [C.LabelEncode, C.FrequencyEncode, C.OrdinalEncode, C.TargetEncode, C.WeightOfEvidence])
def test_rows_do_not_meet_by_their_values(spark, no_guess, made):
    out = made().fit_transform(Frame(rows(spark), ROLES, ["id"]))
    sizes = [r["count"] for r in out.df.groupBy(F.spark_partition_id()).count().collect()]
    assert sizes == [100] * 7
    assert out.df.filter(F.col(out.features[0]).isNull()).count() == 0


def test_many_values_are_joined_without_a_broadcast(spark, no_guess, monkeypatch):
    frame = Frame(rows(spark), ROLES, ["id"])
    few = {r["id"]: r["freq__c"] for r in C.FrequencyEncode().fit_transform(frame).df.collect()}
    monkeypatch.setattr(C, "FEW", 2)
    out = C.FrequencyEncode().fit_transform(frame).df
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r["id"]: r["freq__c"] for r in out.collect()} == few
