"""The protocol of feature operators, and how they are put together.

``fit`` computes a small state from a Frame and returns the operator; ``transform`` applies it as
projections or lookup joins, with no state of its own, so that it works on streams as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from larkspur.frame import Frame, quoted


class Operator:
    def fit(self, frame: Frame) -> Operator:
        return self

    def transform(self, frame: Frame) -> Frame:
        raise NotImplementedError

    def fit_transform(self, frame: Frame) -> Frame:
        return self.fit(frame).transform(frame)


class Sequential(Operator):
    """Each operator is fitted on what the ones before return for the rows of the fit."""

    def __init__(self, operators: list[Operator]):
        self.operators = operators

    def fit(self, frame: Frame) -> Sequential:
        for k, operator in enumerate(self.operators):
            operator.fit(frame)
            if k + 1 < len(self.operators):
                frame = operator.transform(frame)
        return self

    def fit_transform(self, frame: Frame) -> Frame:
        for operator in self.operators:
            frame = operator.fit_transform(frame)
        return frame

    def transform(self, frame: Frame) -> Frame:
        for operator in self.operators:
            frame = operator.transform(frame)
        return frame


class Union(Operator):
    """Branches over the same input; their columns are added to one frame, one after another, never joined."""

    def __init__(self, operators: list[Operator]):
        self.operators = operators

    def fit(self, frame: Frame) -> Union:
        for operator in self.operators:
            operator.fit(frame)
        return self

    def fit_transform(self, frame: Frame) -> Frame:
        return self.together(frame, "fit_transform")

    def transform(self, frame: Frame) -> Frame:
        return self.together(frame, "transform")

    def together(self, frame: Frame, method: str) -> Frame:
        # an operator takes its inputs out of the frame; each branch gets them anew from copies
        inputs, prefix = frame.features, "input__"
        while any(c.startswith(prefix) for c in frame.df.columns):  # those of a union that this one is a branch of
            prefix += "_"
        out = Frame(frame.df.withColumns({f"{prefix}{c}": F.col(quoted(c)) for c in inputs}), dict(frame.roles), frame.keys)
        made: list[str] = []
        for operator in self.operators:
            fresh = out.df.withColumns({c: F.col(quoted(f"{prefix}{c}")) for c in inputs})
            after = getattr(operator, method)(Frame(fresh, frame.roles, frame.keys))
            new = [c for c in after.features if c not in inputs and c not in made]
            made += new
            out = Frame(after.df, out.roles | {c: after.roles[c] for c in new}, frame.keys)
        return out.without([f"{prefix}{c}" for c in inputs]).select(made) if made else frame


class Select(Operator):
    """The named features only."""

    def __init__(self, keys: list[str]):
        self.keys = keys

    def transform(self, frame: Frame) -> Frame:
        return frame.select([c for c in self.keys if c in frame.features])


class Columnwise(Union):
    """An operator of its own for every feature, made by ``make``."""

    def __init__(self, make: Callable[[], Operator]):
        super().__init__([])
        self.make = make

    def fit(self, frame: Frame) -> Columnwise:
        self.operators = [Sequential([Select([c]), self.make()]) for c in frame.features]
        super().fit(frame)
        return self

    def fit_transform(self, frame: Frame) -> Frame:
        self.operators = [Sequential([Select([c]), self.make()]) for c in frame.features]
        return super().fit_transform(frame)


class BestOf(Operator):
    """Of several operators, the one whose result the criterion scores highest; the first of equals."""

    def __init__(self, operators: list[Operator], criterion: Callable[[Frame], float]):
        self.operators, self.criterion, self.best = operators, criterion, None

    def fit(self, frame: Frame) -> BestOf:
        scores = [self.criterion(operator.fit_transform(frame)) for operator in self.operators]
        self.best = self.operators[scores.index(max(scores))]
        return self

    def transform(self, frame: Frame) -> Frame:
        return self.best.transform(frame)


class ChangeRoles(Operator):
    def __init__(self, roles: dict):
        self.roles = roles

    def transform(self, frame: Frame) -> Frame:
        return frame.with_roles(self.roles)


class SetAttribute(Operator):
    """Turn a feature into an attribute of rows, such as weights or group."""

    def __init__(self, attribute: str, column: str):
        self.attribute, self.column = attribute, column

    def transform(self, frame: Frame) -> Frame:
        return frame.with_roles({self.column: self.attribute})


class Identity(Operator):
    def transform(self, frame: Frame) -> Frame:
        return frame


def lineage(sources: list[str], made: list[str]) -> dict[str, str]:
    """made feature -> the longest source name that it ends with, contains, or else itself."""
    out = {}
    for name in made:
        ends = [s for s in sources if name == s or name.endswith("__" + s)]
        inside = ends or [s for s in sources if s in name]
        out[name] = max(inside, key=len) if inside else name
    return out
