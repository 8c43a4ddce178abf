"""A DataFrame with roles and keys: what feature operators take and return."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur import roles as R


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass
class Frame:
    """``df`` holds the key, attribute and feature columns; ``roles`` names the features and what they are.

    Attributes (target, folds, weights, group, treatment) are columns with a role of that name.
    """

    df: DataFrame
    roles: dict[str, R.Role]
    keys: list[str] = field(default_factory=list)

    @property
    def features(self) -> list[str]:
        return [c for c, r in self.roles.items() if r.name in ("numeric", "category", "datetime", "text", "path", "array")]

    def attribute(self, name: str) -> str | None:
        return next((c for c, r in self.roles.items() if r.name == name), None)

    def select(self, features: list[str]) -> Frame:
        others = [c for c in self.df.columns if c not in self.features]
        roles = {c: r for c, r in self.roles.items() if c in features or c in others}
        return Frame(self.df.select(*map(quoted, others), *map(quoted, features)), roles, self.keys)

    def drop(self, features: list[str]) -> Frame:
        return self.select([c for c in self.features if c not in features])

    def without(self, columns: list[str]) -> Frame:
        """Without columns that have no role."""
        return Frame(self.df.drop(*columns), self.roles, self.keys)

    def filter(self, condition: Column | str) -> Frame:
        return Frame(self.df.filter(condition), self.roles, self.keys)

    def with_columns(self, made: dict[str, Column], role: R.Role | Callable[[str], R.Role]) -> Frame:
        """Add features in one projection."""
        roles = self.roles | {c: role if isinstance(role, R.Role) else role(c) for c in made}
        return Frame(self.df.withColumns(made), roles, self.keys)

    def with_roles(self, changes: dict[str, R.Role | str]) -> Frame:
        """Change what columns mean; no data is touched."""
        return Frame(self.df, self.roles | {c: R.make(r) for c, r in changes.items()}, self.keys)

    def concat(self, *others: Frame) -> Frame:
        """Join the features of frames that come from the same rows, by their keys."""
        out = self
        for other in others:
            new = [c for c in other.features if c not in out.df.columns]
            out = Frame(out.df.join(other.df.select(*self.keys, *new), self.keys), out.roles | {c: other.roles[c] for c in new}, self.keys)
        return out

    def null_count(self) -> DataFrame:
        """total: nulls and NaN of all features together."""
        kinds = dict(self.df.dtypes)
        empty = lambda c: F.col(c).isNull() | F.isnan(c) if kinds[c] in ("double", "float") else F.col(c).isNull()
        return self.df.agg(sum((F.sum(empty(c).cast("long")) for c in self.features), F.lit(0)).alias("total"))
