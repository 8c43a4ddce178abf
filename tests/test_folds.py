"""Out-of-fold predictions of the registered queries: every order gets one."""

import pytest
from pyspark.sql import functions as F

from larkspur.plans import models_catalogue  # noqa: F401
from larkspur.plans.flagship import credit_frame
from larkspur.plans.registry import QUERIES


@pytest.mark.parametrize("name", ["lr_oof", "gbt_oof", "rf_oof"])
def test_every_fold_is_predicted(spark, data, name):
    got = QUERIES[name](spark, data).groupBy("fold").agg(F.count("*").alias("n"), F.count("p").alias("predicted")).collect()
    assert sorted(r["fold"] for r in got) == [0, 1, 2, 3, 4]
    assert all(r["predicted"] == r["n"] for r in got)
    assert sum(r["n"] for r in got) == credit_frame(spark, data).df.count()
