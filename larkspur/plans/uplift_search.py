"""Search over uplift learners of two models and of cross effects, by stages that candidates share.

A candidate is made of stages: outcome models of both arms; for cross effects also an effect model of each
arm, which learns what the other arm's outcome model leaves, and a propensity model. A stage is known by
its kind, its algorithm and the stages that it takes as input, and is fitted once however many candidates
need it. The predictions of all stages are columns of one stored frame, so that candidates are expressions over
them, and all of them are rated in one job.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import metrics
from larkspur.plans.uplift import Scorer
from larkspur.storage import stored

Maker = Callable[..., Scorer]


@dataclass(frozen=True)
class Stage:
    """``kind`` is outcome_0, outcome_1, effect_0, effect_1 or propensity; ``inputs`` are stages whose predictions it learns from."""

    kind: str
    algorithm: str
    inputs: tuple[Stage, ...] = ()

    @property
    def column(self) -> str:
        return "__".join([self.kind, self.algorithm, *(i.column for i in self.inputs)])


@dataclass(frozen=True)
class Candidate:
    name: str
    stages: tuple[Stage, ...]

    @property
    def uplift(self) -> Column:
        """Of two models the difference; of cross effects the effects of both arms, weighed by the propensity."""
        own = [F.col(f"`{s.column}`") for s in self.stages]
        if len(own) == 2:
            return own[1] - own[0]
        effect_0, effect_1, chance = own
        return chance * effect_1 + (1 - chance) * effect_0


@dataclass
class UpliftSearch:
    """``fit`` rates all candidates on the valid rows, ``predict`` adds uplift by the best.

    ``outcomes``, ``effects`` and ``propensities`` map names to makers of scorers (``fit(df, target, features)``, as
    :func:`larkspur.plans.uplift.fitter` gives). ``fits`` counts the models that were fitted.
    """

    features: list[str]
    target: str
    treatment: str
    outcomes: dict[str, Maker]
    effects: dict[str, Maker]
    propensities: dict[str, Maker]
    mode: str = "adj_qini"
    fits: int = 0
    scorers: dict[Stage, Scorer] = field(default_factory=dict)
    scores: list[tuple[str, float]] = field(default_factory=list)

    def candidates(self) -> list[Candidate]:
        first = {k: [Stage(f"outcome_{k}", a) for a in self.outcomes] for k in (0, 1)}
        out = [Candidate(f"T({a.algorithm}, {b.algorithm})", (a, b)) for a, b in product(first[0], first[1])]
        # an arm's effects are what its rows differ from the other arm's outcome model
        effects = {k: [Stage(f"effect_{k}", e, (o,)) for o, e in product(first[1 - k], self.effects)] for k in (0, 1)}
        for zero, one, p in product(effects[0], effects[1], self.propensities):
            name = f"X({one.inputs[0].algorithm}, {zero.inputs[0].algorithm}; {zero.algorithm}, {one.algorithm}; {p})"
            out.append(Candidate(name, (zero, one, Stage("propensity", p))))
        return out

    def fit_stage(self, stage: Stage, train: DataFrame) -> Scorer:
        """The stage's scorer; ``train`` has the predictions of its inputs."""
        if stage not in self.scorers:
            t, y = F.col(self.treatment), F.col(self.target)
            kind, _, arm = stage.kind.partition("_")
            if kind == "outcome":
                made = self.outcomes[stage.algorithm](train.filter(t == int(arm)), self.target, self.features)
            elif kind == "effect":
                other = F.col(f"`{stage.inputs[0].column}`")
                rest = train.filter(t == int(arm)).withColumn("effect__", y - other if arm == "1" else other - y)
                made = self.effects[stage.algorithm](rest, "effect__", self.features)
            else:
                made = self.propensities[stage.algorithm](train, self.treatment, self.features)
            self.scorers[stage] = made
            self.fits += 1
        return self.scorers[stage]

    def fit(self, train: DataFrame, valid: DataFrame) -> UpliftSearch:
        """Levels of stages one after another: what a level predicts is stored before the next is fitted."""
        every = self.candidates()
        stages = list(dict.fromkeys(s for c in every for s in (*(i for own in c.stages for i in own.inputs), *c.stages)))
        for level in ([s for s in stages if not s.inputs], [s for s in stages if s.inputs]):
            for stage in level:
                scorer = self.fit_stage(stage, train)
                valid = scorer(valid, stage.column)
            used = [s for s in level if any(s in later.inputs for later in stages)]
            for stage in used:
                train = self.scorers[stage](train, stage.column)
            train, valid = stored(train), stored(valid)
        found = metrics.uplift_aucs(valid, self.target, {c.name: c.uplift for c in every}, self.treatment, self.mode)
        rated = [(c, found[c.name]) for c in every if found[c.name] is not None]
        rated.sort(key=lambda x: -x[1])
        self.best, self.scores = rated[0][0], [(c.name, v) for c, v in rated]
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        kept = df.columns
        for stage in self.best.stages:
            df = self.scorers[stage](df, stage.column)
        return df.withColumn("uplift", self.best.uplift).select(*[c for c in kept if c != "uplift"], "uplift")
