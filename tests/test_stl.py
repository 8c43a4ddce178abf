"""STL against a plain version point by point, in one part and in many."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import stl as S


def plain_loess(y, span, weight, at):
    """The fitted value at each place by a weighted least-squares line."""
    n, out = len(y), []
    for x in at:
        near = sorted(range(n), key=lambda j: (abs(j - x), j))[: min(span, n)]
        # of points equally far the window that lies inside is taken, as it is whole runs of neighbours
        first = min(max(int(np.ceil(x - (span - 1) / 2)), 0), n - min(span, n))
        near = range(first, first + min(span, n))
        h = max(abs(j - x) for j in near) + max(0, (span - n) // 2)
        k = np.array([(1 - min(1, abs(j - x) / h) ** 3) ** 3 if h else 1.0 for j in near]) * weight[list(near)]
        keep = k > 0
        a = np.column_stack([np.ones(keep.sum()), np.array(list(near))[keep] - x])
        w = np.sqrt(k[keep])
        out.append(np.linalg.lstsq(a * w[:, None], np.array([y[j] for j in near])[keep] * w, rcond=None)[0][0] if keep.sum() > 1 else np.array([y[j] for j in near])[keep].sum() if keep.any() else np.nan)
    out, at = np.array(out), np.array(list(at))
    lost = np.isnan(out)
    return np.where(lost, np.interp(at, at[~lost], out[~lost]), out) if lost.any() else out


def plain_stl(y, period, seasonal, rounds, robust):
    n, known = len(y), ~np.isnan(y)
    slow, trending = S.odd(period + 1), S.odd(1.5 * period / (1 - 1.5 / seasonal))
    trend, weight = np.zeros(n), known.astype(float)
    for outer in range(robust + 1):
        for _ in range(rounds):
            cycle = np.zeros(n + 2 * period)
            for k in range(period):
                own = np.arange(k, n, period)
                cycle[k::period][: len(own) + 2] = plain_loess((y - trend)[own], seasonal, weight[own], range(-1, len(own) + 1))
            low = cycle
            for m in (period, period, 3):
                low = np.array([low[i : i + m].mean() for i in range(len(low) - m + 1)])
            season = cycle[period : period + n] - plain_loess(low, slow, np.ones(n), range(n))
            trend = plain_loess(y - season, trending, weight, range(n))
        if outer < robust:
            r = np.abs(y - trend - season)
            far = r / (6 * np.nanmedian(r))
            weight = np.where(known & (far < 1), (1 - far**2) ** 2, 0.0)
    return trend, season


def series(seed, n, period, gaps=0):
    r = np.random.default_rng(seed)
    t = np.arange(n)
    y = 0.05 * t + 3 * np.sin(2 * np.pi * t / period) + 2 * np.sin(t / 40) + r.normal(0, 0.4, n)
    y[r.choice(n, 3, replace=False)] += 15
    if gaps:
        y[r.choice(n, gaps, replace=False)] = np.nan
    return y


@pytest.mark.parametrize(("part_rows", "robust", "rounds"), [(20_000, 0, 5), (50, 0, 2), (50, 2, 1), (20_000, 1, 2)])
def test_against_a_plain_version(spark, part_rows, robust, rounds):
    held = {"a": series(1, 300, 7, gaps=9), "b": series(2, 180, 7), "short": series(3, 9, 7)}
    rows = [(k, i, None if np.isnan(v) else float(v)) for k, y in held.items() for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "k string, day int, y double")
    made = S.Decomposition(7, rounds=rounds, robust=robust, part_rows=part_rows)
    assert part_rows > 300 or made.margin < 250
    got = made.fit_transform(df, ["k"], "day", "y").orderBy("k", "day").toPandas()
    assert len(got) == len(rows) and got.columns.tolist() == ["k", "day", "trend", "season", "rest"]
    for k in ("a", "b"):
        trend, season = plain_stl(held[k], 7, 7, rounds, robust)
        own = got[got.k == k]
        assert np.allclose(own.trend, trend, atol=1e-8) and np.allclose(own.season, season, atol=1e-8)
        assert np.array_equal(own.rest.isna(), np.isnan(held[k]))
    assert got[got.k == "short"].trend.isna().all()


def test_parts_give_what_the_whole_series_gives(spark):
    y = series(4, 3000, 12, gaps=40)
    df = spark.createDataFrame([(i, None if np.isnan(v) else float(v)) for i, v in enumerate(y)], "t int, y double")
    one, many = (S.Decomposition(12, robust=1, rounds=2, part_rows=n) for n in (20_000, 400))
    assert many.margin < 400 * 2 and many.one_pass  # several parts, each with its neighbours' rows
    a, b = (d.fit_transform(df, [], "t", "y").orderBy("t").toPandas() for d in (one, many))
    assert np.allclose(a.trend, b.trend, atol=1e-9) and np.allclose(a.season, b.season, atol=1e-9)
    assert np.abs(a.rest).median() < 0.5 and a.rest.isna().sum() == 40


def test_empty_and_wrong(spark):
    df = spark.createDataFrame([], "k string, day int, y double")
    assert S.Decomposition(7).fit_transform(df, ["k"], "day", "y").count() == 0
    with pytest.raises(ValueError, match="period"):
        S.Decomposition(1).fit_transform(df, ["k"], "day", "y")
    none = spark.createDataFrame([("a", i, None) for i in range(30)], "k string, day int, y double")
    assert S.Decomposition(7).fit_transform(none, ["k"], "day", "y").filter(F.col("trend").isNotNull()).count() == 0
