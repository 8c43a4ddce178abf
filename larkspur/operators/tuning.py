"""Search of parameters by tree-structured Parzen estimators.

The trials so far are split into the good ones and the others. For each parameter a density over either is
made of kernels around the trials and of the prior; the next trials are those candidates, drawn from the
good density, for which it is highest against the other one. Trials are asked for in rounds: what was asked for and
isn't told yet counts among the others, so that a round is spread.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass
from typing import Any

SQRT_2 = math.sqrt(2)


def normal_cdf(x: float) -> float:
    return 0.5 * (1 + math.erf(x / SQRT_2))


@dataclass(frozen=True)
class Uniform:
    """Numbers from low to high, evenly or (log) by their logarithms; in steps from low if ``step`` is given."""

    low: float
    high: float
    log: bool = False
    step: float | None = None

    def unit(self, x: float) -> float:
        """0 to 1."""
        a, b, v = (math.log(v) for v in (self.low, self.high, x)) if self.log else (self.low, self.high, x)
        return min(1.0, max(0.0, (v - a) / (b - a))) if b > a else 0.0

    def at(self, u: float) -> float:
        x = math.exp(math.log(self.low) + u * (math.log(self.high) - math.log(self.low))) if self.log else self.low + u * (self.high - self.low)
        x = self.low + round((x - self.low) / self.step) * self.step if self.step else x
        return min(self.high, max(self.low, x))

    def draw(self, r: random.Random) -> float:
        return self.at(r.random())


@dataclass(frozen=True)
class Normal:
    """Numbers around a mean."""

    mean: float
    deviation: float

    def unit(self, x: float) -> float:
        """The share of the distribution below it."""
        return normal_cdf((x - self.mean) / self.deviation)

    def at(self, u: float) -> float:
        low, high = -8.0, 8.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if normal_cdf(middle) < u else (low, middle)
        return self.mean + self.deviation * low

    def draw(self, r: random.Random) -> float:
        return r.gauss(self.mean, self.deviation)


@dataclass(frozen=True)
class Choice:
    options: tuple

    def draw(self, r: random.Random) -> Any:
        return r.choice(self.options)


class Kernels:
    """A density on 0 to 1: the even prior and a cut normal kernel around each point, as wide as its farther neighbour is away."""

    def __init__(self, points: list[float]):
        self.points = sorted(points)
        held = [0.0, *self.points, 1.0]
        least = 1 / min(100, len(points) + 2)
        self.widths = [min(1.0, max(least, held[i] - held[i - 1], held[i + 1] - held[i])) for i in range(1, len(held) - 1)]

    def draw(self, r: random.Random) -> float:
        k = r.randrange(len(self.points) + 1)
        if k == len(self.points):
            return r.random()
        while True:
            x = r.gauss(self.points[k], self.widths[k])
            if 0 <= x <= 1:
                return x

    def density(self, x: float) -> float:
        total = 1.0
        for p, w in zip(self.points, self.widths, strict=True):
            total += math.exp(-((x - p) ** 2) / (2 * w * w)) / (w * math.sqrt(2 * math.pi)) / (normal_cdf((1 - p) / w) - normal_cdf(-p / w))
        return total / (len(self.points) + 1)


class Parzen:
    """``suggest`` parameters of a space (name to Uniform, Normal or Choice), ``tell`` their scores; more is better."""

    def __init__(self, space: dict[str, Any], seed: int = 42, startup: int = 8, share: float = 0.2, candidates: int = 24):
        self.space, self.random, self.startup, self.share, self.candidates = space, random.Random(seed), startup, share, candidates
        self.told: list[tuple[dict, float]] = []
        self.pending: list[dict] = []

    def tell(self, params: dict, score: float) -> None:
        """A score; parameters that are left out (defaults) don't inform their dimension."""
        if params in self.pending:
            self.pending.remove(params)
        if score == score:
            self.told.append((params, score))

    def suggest(self, n: int = 1) -> list[dict]:
        out = [self.one() for _ in range(n)]
        return out

    def one(self) -> dict:
        if len(self.told) + len(self.pending) < self.startup:
            made = {k: d.draw(self.random) for k, d in self.space.items()}
        else:
            ranked = [p for p, _ in sorted(self.told, key=lambda x: -x[1])]
            n_good = max(1, math.ceil(self.share * len(ranked)))
            good, others = ranked[:n_good], ranked[n_good:] + self.pending
            made = {k: self.best(d, [p[k] for p in good if k in p], [p[k] for p in others if k in p]) for k, d in self.space.items()}
        self.pending.append(made)
        return made

    def best(self, d: Any, good: list, others: list) -> Any:
        r = self.random
        if isinstance(d, Choice):
            chance = lambda seen: [(seen.count(o) + 1 / len(d.options)) / (len(seen) + 1) for o in d.options]
            a, b = chance(good), chance(others)
            drawn = r.choices(range(len(d.options)), a, k=self.candidates)
            return d.options[max(drawn, key=lambda i: a[i] / b[i])]
        a, b = Kernels([d.unit(x) for x in good]), Kernels([d.unit(x) for x in others])
        drawn = [a.draw(r) for _ in range(self.candidates)]
        return d.at(max(drawn, key=lambda x: a.density(x) / b.density(x)))
