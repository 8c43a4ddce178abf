"""The shared search of uplift learners against fitting every candidate on its own."""

import pytest
from pyspark.sql import functions as F

from larkspur.functions import metrics
from larkspur.operators.models import Algorithm, Task
from larkspur.plans import uplift
from larkspur.plans.uplift_search import UpliftSearch


@pytest.fixture(scope="module")
def parts(spark):
    h = lambda k: F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(1000)) / 1000.0
    df = spark.range(900).select("id", h(1).alias("a"), h(2).alias("b"), (h(3) < 0.4).cast("int").alias("t"))
    df = df.withColumn("y", (h(4) < 0.2 + 0.5 * F.col("t") * F.col("a") + 0.1 * F.col("b")).cast("int")).cache()
    return df.filter("id % 3 > 0"), df.filter("id % 3 = 0")


def counted(made, calls, name):
    def fit(*args, **more):
        calls.append(name)
        return made(*args, **more)

    return fit


def test_stages_are_fitted_once_and_the_choice_is_that_of_a_full_search(parts):
    train, valid = parts
    calls = []
    line, few = uplift.fitter(Task("binary")), uplift.fitter(Task("binary"), Algorithm("linear", {"regParam": 1.0}))
    reg = uplift.fitter(Task("reg"))
    made = UpliftSearch(["a", "b"], "y", "t", {"line": counted(line, calls, "o"), "few": counted(few, calls, "o")}, {"reg": counted(reg, calls, "e")}, {"line": counted(line, calls, "p")})
    made.fit(train, valid)
    # 2 algorithms x 2 arms, effects of both arms after each of 2 outcome models, one propensity
    assert made.fits == len(calls) == 4 + 4 + 1 and calls.count("o") == 4 and calls.count("e") == 4
    assert len(made.scores) == 4 + 4 == len(made.candidates())
    for name, one, other in (("T(line, line)", line, line), ("T(few, few)", few, few)):
        alone = uplift.TLearner(["a", "b"], "y", "t", one).fit(train).predict(valid)
        assert dict(made.scores)[name] == pytest.approx(metrics.uplift_auc(alone, "y", "uplift", "t").first()["auc"])
    alone = uplift.XLearner(["a", "b"], "y", "t", line, reg, line).fit(train).predict(valid)
    assert dict(made.scores)["X(line, line; reg, reg; line)"] == pytest.approx(metrics.uplift_auc(alone, "y", "uplift", "t").first()["auc"], abs=1e-6)
    assert made.scores[0][1] == max(v for _, v in made.scores)
    out = made.predict(valid)
    assert out.columns == [*valid.columns, "uplift"]
    assert metrics.uplift_auc(out, "y", "uplift", "t").first()["auc"] == pytest.approx(made.scores[0][1])
