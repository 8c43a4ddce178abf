"""Scorecard bins against all ways to cut the pre-bins."""

from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur import roles as R
from larkspur.frame import Frame
from larkspur.operators import scorecard as S


def brute(n, g, all_g, all_b, least, most):
    k, best = len(n), (-np.inf, 0, [k_ := len(n)])
    for bins in range(1, min(most, k) + 1):
        for cut in combinations(range(1, k), bins - 1):
            ends = [*cut, k]
            runs = list(zip([0, *cut], ends, strict=True))
            rows, hits = (np.array([sum(x[a:b]) for a, b in runs], float) for x in (n, g))
            step = np.diff(hits / np.maximum(rows, 1e-300))
            if rows.min() < least or rows.min() == 0 or not ((step > 0).all() or (step < 0).all()):
                continue
            value = S.evidence(hits, rows - hits, all_g, all_b)[1].sum()
            if value > best[0] + 1e-9:
                best = (value, bins, ends)
    return best


@settings(deadline=None, max_examples=60)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(0, 40)), min_size=1, max_size=9), st.sampled_from([0.0, 0.05, 0.2, 0.6]), st.integers(1, 6))
def test_best_bins(pre, share, most):
    n = np.array([max(a, b) for a, b in pre], float)
    g = np.array([b for _, b in pre], float)
    all_g, all_b = g.sum(), n.sum() - g.sum()
    value, _, _ = brute(n, g, all_g, all_b, share * n.sum(), most)
    ends = S.best_bins(n, g, all_g, all_b, share * n.sum(), most)
    starts = [0, *ends[:-1]]
    rows, hits = (np.array([x[a:b].sum() for a, b in zip(starts, ends, strict=True)]) for x in (n, g))
    assert ends[-1] == len(n) and rows.min() >= share * n.sum() and len(ends) <= most
    assert S.evidence(hits, rows - hits, all_g, all_b)[1].sum() == pytest.approx(value, abs=1e-9)


def test_twelve_pre_bins():
    r = np.random.default_rng(3)
    for _ in range(5):
        n = r.integers(20, 60, 12).astype(float)
        g = r.binomial(n.astype(int), np.sort(r.uniform(0.1, 0.9, 12))).astype(float)
        value, bins, ends = brute(n, g, g.sum(), n.sum() - g.sum(), 0.05 * n.sum(), 8)
        assert S.best_bins(n, g, g.sum(), n.sum() - g.sum(), 0.05 * n.sum(), 8) == ends


@pytest.fixture(scope="module")
def frame(spark):
    r = np.random.default_rng(5)
    rows = []
    for i in range(800):
        x, c = float(r.normal()), str(r.choice(["a", "b", "c", "d"]))
        y = int(r.random() < 1 / (1 + np.exp(-x - (c == "b") + (c == "d"))))
        rows.append((i, None if i % 20 == 0 else float("nan") if i % 21 == 0 else x, None if i % 17 == 0 else "rare%d" % i if i % 50 == 3 else c, 1.0, y))
    df = spark.createDataFrame(rows, "id int, x double, c string, same double, y int")
    return Frame(df, {"x": R.numeric(), "c": R.category(), "same": R.numeric(), "y": R.make("target")}, ["id"])


def test_transform(frame, spark):
    op = S.ScorecardBins(fine=10).fit(frame)
    out = op.transform(frame).df.toPandas()
    table = frame.df.toPandas().merge(out.drop(columns="y"), on="id")
    assert table["woe__x"].notna().all() and table["woe__c"].notna().all() and table["woe__same"].nunique() == 1
    known = table[table.x.notna()].sort_values("x")
    assert (known["woe__x"].diff().dropna() >= 0).all() and 2 <= known["woe__x"].nunique() <= 8
    all_g = table.y.sum()
    for name in ("woe__x", "woe__c"):  # every weight is that of the rows that have it
        for woe, part in table.groupby(name):
            assert woe == pytest.approx(S.evidence(part.y.sum(), (1 - part.y).sum(), all_g, len(table) - all_g)[0], abs=0.05 if part.x.isna().any() or part.c.isna().any() else 1e-9)
    new = Frame(spark.createDataFrame([(1, None, "never", 5.0, 0)], frame.df.schema), frame.roles, frame.keys)
    row = op.transform(new).df.first()
    rare = table[table.c.fillna("").str.startswith("rare")]["woe__c"].unique()
    assert [row["woe__c"]] == list(rare)
    assert S.ScorecardBins(least_value=0.05).fit(frame).transform(frame).features == ["woe__x", "woe__c"]


def test_empty(frame):
    empty = Frame(frame.df.filter("id < 0"), frame.roles, frame.keys)
    out = S.ScorecardBins().fit(empty).transform(frame)
    assert out.df.agg({"woe__x": "max", "woe__c": "min"}).first() == (0.0, 0.0)
