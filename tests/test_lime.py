"""Local explanations of texts against direct solutions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import lime as L

ROWS = [(1, "a b c a d e f".split()), (2, "x".split()), (3, []), (4, None), (5, [f"w{i}" for i in range(60)]), (6, "a b".split() * 4)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "id int, tokens array<string>")


def score(df):
    """Three words matter, two of them together."""
    has = lambda w: F.array_contains(F.split("text", " "), w).cast("double")
    return df.withColumn("p", 2 * has("a") - has("d") + has("b") * has("c") + 0.1 * F.size(F.split("text", " ")))


def test_samples(docs):
    rows = L.perturbed(docs, "id", "tokens", 40).collect()
    assert {r["id"]: sum(x["id"] == r["id"] for x in rows) for r in rows} == {1: 41, 2: 41, 3: 1, 4: 1, 5: 41, 6: 41}
    tokens = {k: t or [] for k, t in ROWS}
    for r in rows:
        kept = dict(zip(r["words"], r["kept"], strict=True))
        assert r["words"] == list(dict.fromkeys(tokens[r["id"]])) and r["text"] == " ".join(t for t in tokens[r["id"]] if kept[t])
        assert r["sample"] > 0 or all(r["kept"])
        assert r["sample"] == 0 or not all(r["kept"])
    assert len({tuple(r["kept"]) for r in rows if r["id"] == 5}) > 30


@pytest.mark.parametrize("samples", [30, 200])
def test_weights_equal_a_direct_solution(docs, samples):
    rows = score(L.perturbed(docs, "id", "tokens", samples)).collect()
    got = L.explain_texts(docs, "id", "tokens", score, samples).collect()
    assert {r["id"] for r in got} == {1, 2, 5, 6}
    for key in (1, 2, 5, 6):
        own = [r for r in rows if r["id"] == key]
        x, y = np.array([r["kept"] for r in own], float), np.array([r["p"] for r in own])
        d = 100 * (1 - np.sqrt(x.mean(1)))
        w = np.sqrt(np.exp(-(d**2) / 25**2))
        a = np.column_stack([x, np.ones(len(x))])
        penalty = np.diag([1.0] * x.shape[1] + [0.0])
        beta = np.linalg.solve(a.T @ (a * w[:, None]) + penalty, a.T @ (w * y))
        mine = {r["word"]: r for r in got if r["id"] == key}
        assert [mine[c]["weight"] for c in own[0]["words"]] == pytest.approx(beta[:-1].tolist(), abs=1e-8)
        assert next(iter(mine.values()))["bias"] == pytest.approx(beta[-1], abs=1e-8)
        fit = 1 - (w * (y - a @ beta) ** 2).sum() / (w * (y - (w @ y) / w.sum()) ** 2).sum() if np.ptp(y) else 0.0
        assert next(iter(mine.values()))["fit"] == pytest.approx(fit, abs=1e-8)


def test_few_words_are_chosen(docs):
    got = L.explain_texts(docs, "id", "tokens", score, 300, n_features=2)
    best = {r["id"]: [w["word"] for w in r["words"]] for r in L.strongest(got, "id").collect()}
    assert set(best[1]) == {"a", "d"} and all(len(w) <= 2 for w in best.values())
    placed = L.weighted_tokens(docs, "id", "tokens", got).filter("id = 1").orderBy("place").collect()
    assert [r["token"] for r in placed] == ROWS[0][1] and placed[0]["weight"] == placed[3]["weight"] > 1 and placed[1]["weight"] == 0


def test_lasso_is_exact_for_separate_columns():
    """Columns that don't overlap: the lasso keeps those of the greatest products."""
    x = np.kron(np.eye(6), np.ones((4, 1)))
    y = x @ np.array([5.0, -4, 3, 0.5, 0.1, 0]) + np.tile([0.01, -0.01], 12)
    assert set(L.lasso_choice(x, y, np.ones(24), 3)) == {0, 1, 2}
