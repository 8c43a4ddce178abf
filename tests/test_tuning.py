"""The Parzen search against random search, and in a preset."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from larkspur.operators import models
from larkspur.operators.tuning import Choice, Kernels, Normal, Parzen, Uniform
from larkspur.operators.validation import Split

SPACE = {"a": Uniform(0.0, 10.0), "b": Uniform(1e-4, 1.0, log=True)}


def surface(p):
    return -((p["a"] - 7.3) ** 2) / 4 - (math.log10(p["b"]) + 2.6) ** 2 * 2


def searched(seed, trials=48, at_once=4):
    s = Parzen(SPACE, seed)
    for _ in range(trials // at_once):
        for p in s.suggest(at_once):
            s.tell(p, surface(p))
    return max(v for _, v in s.told)


def drawn(seed, trials=48):
    r = random.Random(seed)
    return max(surface({k: d.draw(r) for k, d in SPACE.items()}) for _ in range(trials))


def test_it_beats_random_search():
    """Over 50 seeds: a better mean and median, and better in most seeds."""
    own, other = [searched(s) for s in range(50)], [drawn(s) for s in range(50)]
    assert statistics.mean(own) > statistics.mean(other) / 2 and statistics.median(own) > statistics.median(other) / 2  # both are negative
    assert sum(a > b for a, b in zip(own, other, strict=True)) >= 35


def test_choices_are_learned():
    s = Parzen({"c": Choice(("x", "y", "z")), "n": Normal(3.0, 2.0)}, 1)
    for _ in range(15):
        for p in s.suggest(4):
            s.tell(p, (p["c"] == "y") - abs(p["n"] - 5))
    late = [p for p, _ in s.told[-20:]]
    assert sum(p["c"] == "y" for p in late) >= 12 and abs(statistics.mean(p["n"] for p in late) - 5) < 1


def test_distributions():
    r = random.Random(3)
    for d in (Uniform(2, 8), Uniform(0.01, 100, log=True), Normal(5, 2)):
        assert all(d.at(d.unit(x)) == pytest.approx(x, rel=1e-6) for x in (d.draw(r) for _ in range(50)))
    assert {Uniform(0, 10, step=2.5).draw(r) for _ in range(200)} == {0, 2.5, 5, 7.5, 10}
    k = Kernels([0.1, 0.12, 0.9])
    assert sum(k.density(i / 1000 + 0.0005) for i in range(1000)) / 1000 == pytest.approx(1, abs=1e-3)


def test_tune_finds_the_penalty(spark):
    df = spark.range(400).select("id", (F.pmod("id", F.lit(7)) - 3.0).alias("x"), F.pmod("id", F.lit(2)).alias("f"))
    df = df.withColumn("y", F.col("x") * 3 + F.pmod("id", F.lit(5)))
    from larkspur import roles as R
    from larkspur.frame import Frame

    frame = Frame(df, {"x": R.numeric(), "y": R.make("target")}, ["id"])
    split, task = Split(F.col("f") == 0, F.col("f") == 1), models.Task("reg")
    start = models.Algorithm("linear", {"regParam": 50.0})
    best = models.tune(start, task, frame, split, 6)
    assert best.params["regParam"] < 1.0
    assert models.tune(start, task, frame, split, 6, deadline=lambda: True).params["regParam"] < 50  # the first round is finished
    with pytest.raises(Exception):  # noqa: B017
        models.tune(models.Algorithm("linear", {"maxIter": -1}), task, frame, split, 4)
