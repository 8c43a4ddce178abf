"""Role rules against plain encodings, and what the reader makes of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur import roles as R
from larkspur.frame import Frame
from larkspur.plans import role_rules as A
from larkspur.plans.reader import Reader

ALPHAS = (0.5, 1, 2, 5, 10, 50, 250, 1000)


def gini(y, p):
    """Ties share their mean: the mean over all orders of tied rows."""

    def own(y, p):
        total, seen, area = y.sum(), 0.0, 0.0
        for v in np.unique(p):
            at = y[p == v]
            area += len(at) * seen + at.sum() * (len(at) + 1) / 2
            seen += at.sum()
        return (area / total - (len(y) + 1) / 2) / len(y) if total else 0.0

    best = own(y, y)
    return abs(own(y, p) / best) if best else 0.0


def fold_out(keys, y, fold, classes):
    best = None
    for a in ALPHAS:
        p = np.empty(len(y))
        for f in np.unique(fold):
            out = fold != f
            for k in set(keys[~out]):
                same = out & (keys == k)
                p[~out & (keys == k)] = (y[same].sum() + a * y[out].mean()) / (same.sum() + a)
        q = np.clip(p, 1e-7, 1 - 1e-7)
        loss = -(y * np.log(q) + (1 - y) * np.log(1 - q)).sum() if classes else ((y - p) ** 2).sum()
        if best is None or loss < best[0] - 1e-9:
            best = loss, p
    return best[1]


@pytest.fixture(scope="module")
def made(spark):
    r = np.random.default_rng(2)
    n = 600
    x = {"line": r.normal(size=n), "few": r.integers(0, 6, n).astype(float), "wave": r.uniform(0, 9, n), "noise": r.normal(size=n)}
    x["line"][::11] = np.nan
    word = np.array(["ant", "bee", "cat", "dog", "elk"])[r.integers(0, 5, n)]
    rare = np.where(r.random(n) < 0.1, np.char.add("w", r.integers(0, 60, n).astype(str)), word)
    logit = np.nan_to_num(x["line"]) + np.array([2, -1, 1.5, -2, 0, 1])[x["few"].astype(int)] + 2 * np.sin(2 * x["wave"]) + (word == "cat") - (word == "ant")
    y, z = (r.random(n) < 1 / (1 + np.exp(-logit))).astype(float), logit + 10
    fold = np.arange(n) % 5
    rows = [(i, *(None if np.isnan(v) else float(v) for v in (c[i] for c in x.values())), None if i % 13 == 0 else str(rare[i]), float(y[i]), float(z[i]), int(fold[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, line double, few double, wave double, noise double, word string, y double, z double, fold int")
    return df, x, [r[5] for r in rows], y, z, fold


@pytest.mark.parametrize("task", ["binary", "reg"])
def test_stats_equal_plain_encodings(made, task):
    df, x, words, y, z, fold = made
    t = y if task == "binary" else z
    frame = Frame(df, dict.fromkeys(x, R.numeric()) | {"word": R.category()}, ["id"])
    got = {r["feature"]: r.asDict() for r in A.role_stats(frame, list(x), ["word"], "y" if task == "binary" else "z", "fold", task).collect()}
    for c, v in x.items():
        have = ~np.isnan(v)
        values, counts = np.unique(v[have], return_counts=True)
        cuts = np.unique(np.quantile(v[have], np.arange(1, 10) / 10))
        bins = np.where(have, (cuts[None] < np.nan_to_num(v)[:, None]).sum(1) + 1, 0)
        often = dict(zip(values, counts, strict=True))
        keys = np.array(["null" if np.isnan(a) and (~have).sum() > 5 else "rare" if often.get(a, 0) <= 5 else str(a) for a in v])
        want = {
            "n_unique": len(values), "top_freq": counts.max(), "null_rate": 1 - have.mean(), "raw": gini(t[have], v[have]), "binned": gini(t[have], fold_out(bins, t, fold, task == "binary")[have]),
            "encoded": gini(t[have], fold_out(keys, t, fold, task == "binary")[have]), "freq": gini(t[have], np.array([often[a] for a in v[have]])), "nulls": gini(t, ~have * 1.0), "ord": None,
        }
        for k, w in want.items():
            assert got[c][k] == (None if w is None else pytest.approx(w, abs=1e-9)), (c, k)
    have = np.array([w is not None for w in words])
    counts = {w: words.count(w) for w in set(words)}
    keys = np.array(["rare" if counts[w] <= 5 else str(w) for w in words])
    kept = sorted(w for w in counts if w is not None and counts[w] > 5)
    ranks = np.array([kept.index(w) if w in kept else 1e9 for w in words])
    assert got["word"]["encoded"] == pytest.approx(gini(t[have], fold_out(keys, t, fold, task == "binary")[have]))
    assert got["word"]["ord"] == pytest.approx(gini(t[have], ranks[have])) and got["word"]["raw"] is None
    assert got["word"]["freq"] == pytest.approx(gini(t[have], np.array([counts[w] for w in words])[have]))


def test_reader_follows_the_rules(made, spark):
    df, *_ = made
    frame = Reader("binary", ["id"], advanced=True, least_gini=0.1).fit_read(df.drop("z", "fold"), {"y": "target"})
    assert frame.roles["line"].name == "numeric" and "noise" not in frame.features
    assert frame.roles["few"] == R.category(dtype="double", encoding="int", ordinal=False) or frame.roles["few"].name == "numeric"
    assert frame.roles["wave"].name == "numeric" and frame.roles["wave"].discretization
    assert frame.roles["word"].encoding == "auto"
    kept = Reader("binary", ["id"], advanced=True, least_gini=0.1).fit_read(df.drop("z", "fold"), {"y": "target", "noise": R.numeric(force_input=True)})
    assert "noise" in kept.features


def test_classes_and_nothing_to_tell(made, spark):
    df, x, *_ = made
    three = df.withColumn("y", F.pmod("id", F.lit(3)))
    frame = Frame(three, dict.fromkeys(x, R.numeric()), ["id"])
    got = A.role_stats(frame, ["few"], [], "y", "fold", "multiclass").first()
    assert 0 <= got["raw"] < 0.3 and got["nulls"] == 0
    empty = A.role_stats(frame.filter("id < 0"), ["few"], [], "y", "fold")
    assert A.role_rules(empty).count() == 0
    none = Frame(spark.createDataFrame([(i, None, 0.0, i % 5) for i in range(20)], "id int, v double, y double, fold int"), {"v": R.numeric()}, ["id"])
    assert A.role_rules(A.role_stats(none, ["v"], [], "y", "fold"), least_score=0.01).first()["role"] == "drop"


def rule(**changes):
    base = {"feature": "a", "is_number": True, "n_unique": 50, "unique_rate": 0.001, "top_freq": 9, "null_rate": 0.0, "raw": 0.3, "binned": 0.3, "encoded": 0.3, "freq": 0.3, "ord": None, "nulls": 0.0}
    return base | changes


@pytest.mark.parametrize(
    ("changes", "want"),
    [
        ({"raw": 0.4}, ("numeric", False, None, False)),
        ({"binned": 0.4, "raw": 0.1}, ("numeric", True, None, False)),
        ({"encoded": 0.5, "raw": 0.1, "binned": 0.2, "freq": 0.2}, ("category", False, "auto", False)),
        ({"encoded": 0.5, "raw": 0.1, "binned": 0.2, "freq": 0.2, "n_unique": 9, "unique_rate": 0.1}, ("category", False, "int", True)),
        ({"freq": 0.6, "encoded": 0.4, "raw": 0.1, "binned": 0.2, "n_unique": 9}, ("category", False, "freq", False)),
        ({"encoded": 0.5, "raw": 0.1, "binned": 0.2, "freq": 0.2, "n_unique": 2}, ("numeric", False, None, False)),
        ({"encoded": 0.5, "raw": 0.1, "binned": 0.2, "freq": 0.2, "unique_rate": 1.0}, ("numeric", False, None, False)),
        ({"encoded": 0.3, "raw": 0.29, "binned": 0.0, "freq": 0.0}, ("numeric", False, None, False)),
        ({"encoded": 0.03, "raw": 0.0, "binned": 0.0, "freq": 0.0}, ("numeric", False, None, False)),
        ({"is_number": False, "encoded": 0.1, "freq": 0.2, "ord": 0.15}, ("category", False, "freq", False)),
        ({"is_number": False, "encoded": 0.1, "freq": 0.1, "ord": 0.15}, ("category", False, "auto", True)),
    ],
)
def test_decisions(spark, changes, want):
    schema = "feature string, is_number boolean, n_unique long, unique_rate double, top_freq long, null_rate double, raw double, binned double, encoded double, freq double, ord double, nulls double"
    got = A.role_rules(spark.createDataFrame([rule(**changes)], schema)).first()
    assert (got["role"], got["discretization"], got["encoding"], got["ordinal"]) == want
