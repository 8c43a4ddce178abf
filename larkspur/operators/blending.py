"""Blending of the predictions of several models: best one, mean, and weights found by coordinate search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def best_model(df: DataFrame, predictions: list[str], score: Callable[[DataFrame, list[Column]], list[float | None]]) -> str:
    """The prediction with the highest score, the first of equals."""
    scores = [v if v is not None else float("-inf") for v in score(df, [F.col(p) for p in predictions])]
    return predictions[scores.index(max(scores))]


def weighted_mean(predictions: list[str], weights: list[float]) -> Column:
    """Mean over the models that have a prediction, with weights that are scaled up to 1 among them; null for none."""
    use = [(p, w) for p, w in zip(predictions, weights, strict=True) if w > 0]
    total = sum((F.coalesce(F.col(p) * w, F.lit(0.0)) for p, w in use), F.lit(0.0))
    share = sum((F.when(F.col(p).isNotNull(), F.lit(float(w))).otherwise(0.0) for p, w in use), F.lit(0.0))
    return F.try_divide(total, share)


def mean(predictions: list[str]) -> Column:
    return weighted_mean(predictions, [1.0] * len(predictions))


def pruned(weights: list[float], least: float) -> list[float]:
    """Weights below ``least`` become 0, the smallest first, the others are scaled to 1 after each."""
    out = list(weights)
    while True:
        small = [(w, i) for i, w in enumerate(out) if 0 < w < least]
        if not small or sum(w > 0 for w in out) == 1:
            return out
        out[min(small)[1]] = 0.0
        total = sum(out)
        out = [w / total for w in out]


class WeightedBlender:
    """Weights by turns: each model's weight is searched between 0 and 1, the others keep their proportions.

    A step of the search scores evenly spread candidates in one job (``score`` takes the frame and a list
    of predictions), the next step those around the best of them.
    """

    def __init__(self, score: Callable[[DataFrame, list[Column]], list[float | None]], rounds: int = 5, steps: int = 2, spread: int = 8, least: float = 0.05):
        self.score, self.rounds, self.steps, self.spread, self.least, self.weights = score, rounds, steps, spread, least, []

    def best(self, df: DataFrame, predictions: list[str], candidates: list[list[float]]) -> tuple[float, list[float]]:
        """The score and weights of the best candidate, the first of equals."""
        values = self.score(df, [weighted_mean(predictions, w) for w in candidates])
        known = [v if v is not None else float("-inf") for v in values]
        return max(known), candidates[known.index(max(known))]

    def fit(self, df: DataFrame, predictions: list[str]) -> WeightedBlender:
        n = len(predictions)
        self.predictions, weights = predictions, [1 / n] * n
        best, weights = self.best(df, predictions, [weights])
        for _ in range(self.rounds if n > 1 else 0):
            before = best
            for i in range(n):
                rest = sum(w for j, w in enumerate(weights) if j != i)
                share = [w / rest if rest else 1 / (n - 1) for w in weights]
                low, high = 0.0, 1.0
                for _ in range(self.steps):
                    step = (high - low) / self.spread
                    points = [low + k * step for k in range(self.spread + 1)]
                    at = [pruned([x if j == i else (1 - x) * share[j] for j in range(n)], self.least) for x in points]
                    value, found = self.best(df, predictions, at)
                    if value > best:
                        best, weights = value, found
                    place = points[at.index(found)]
                    low, high = max(0.0, place - step), min(1.0, place + step)
            if best <= before:
                break
        self.weights = weights
        return self

    def column(self) -> Column:
        return weighted_mean(self.predictions, self.weights)
