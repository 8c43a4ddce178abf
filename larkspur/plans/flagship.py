"""The flagship query: a table with roles becomes out-of-fold features, in one plan over fitted state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur import roles as R
from larkspur.frame import Frame
from larkspur.operators.base import Union
from larkspur.operators.categorical import LabelEncode, TargetEncode
from larkspur.operators.datetimes import Seasons
from larkspur.operators.numeric import Scale
from larkspur.plans.registry import table

ROLES = {
    "y": R.make("target"), "fold": R.make("folds"), "c_mktsegment": R.category(), "o_orderpriority": R.category(),
    "o_totalprice": R.numeric(), "c_acctbal": R.numeric(), "o_orderdate": R.datetime(),
}
#: Folds that ``credit_frame`` deals; whoever validates takes them all.
FOLDS = 5


def credit_frame(spark: SparkSession, sf: str) -> Frame:
    """orders with their customers: is an order finished?"""
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_acctbal")
    df = table(spark, sf, "orders").join(customers, "o_custkey").select(
        "o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"), (F.col("o_orderkey") % FOLDS).cast("int").alias("fold"),
        "c_mktsegment", "o_orderpriority", "o_totalprice", "c_acctbal", F.col("o_orderdate").cast("timestamp").alias("o_orderdate"),
    )
    return Frame(df, ROLES, ["o_orderkey"])


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Keys, target, fold and features of every order."""
    return Union([LabelEncode(), TargetEncode(), Seasons(), Scale()]).fit_transform(credit_frame(spark, sf)).df
