"""Statistics of a feature within the groups of a key, joined back to the rows.

Sums and counts are combined before the shuffle, so that a hot group costs no more than others; the
median comes from running counts of distinct values; no group is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur import roles as R
from larkspur.frame import Frame
from larkspur.functions.ordered import quantiles
from larkspur.operators.base import Operator
from larkspur.operators.categorical import lookup, top_features, unique_counts

#: statistics of numeric and of categorical features (fixed values)
NUMERIC = ("delta_mean", "delta_median", "min", "max", "std")
CATEGORY = ("mode", "is_mode")


def group_modes(df: DataFrame, group: str, column: str) -> DataFrame:
    """group and mode: its commonest value, the least of equals."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(group, column).agg(F.count("*").alias("n_"))
    best = F.min_by(F.col(column), F.struct(-F.col("n_"), F.col(column)))
    return counts.groupBy(group).agg(best.alias("mode_"))


class GroupStatistics(Operator):
    """``grb__<group>__<statistic>__<feature>`` for every feature; groups that the fit hasn't seen give null."""

    def __init__(self, group: str, numeric: list[str] = (), category: list[str] = (), statistics: tuple[str, ...] = NUMERIC + CATEGORY):
        self.group, self.numeric, self.category, self.statistics = group, list(numeric), list(category), statistics

    def fit(self, frame: Frame) -> GroupStatistics:
        df, g = frame.df, self.group
        kinds = {"delta_mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_pop}
        sums = [f(F.col(c).cast("double")).alias(f"{s}_{k}") for k, c in enumerate(self.numeric) for s, f in kinds.items() if s in self.statistics]
        modes = [group_modes(df, g, c).withColumnRenamed("mode_", f"mode_{k}") for k, c in enumerate(self.category)] if set(CATEGORY) & set(self.statistics) else []
        medians = "delta_median" in self.statistics and self.numeric
        # a table of modes has all groups, as one of sums has; one of medians lacks those without values
        groups = df.groupBy(g).agg(F.count("*").alias("n_"), *sums) if sums or medians or not modes else modes.pop(0)
        if medians:
            for k, c in enumerate(self.numeric):
                groups = lookup(groups, quantiles(df, c, [0.5], [g], [f"delta_median_{k}"]), [g])
        for more in modes:
            groups = lookup(groups, more, [g])
        # one row for each group, so that the rows are joined once
        self.fields = groups.columns[1:]
        self.table = groups.select(g, F.struct(*self.fields).alias("stats_"))
        return self

    def transform(self, frame: Frame) -> Frame:
        df = frame.df
        df = lookup(df, self.table, [self.group]).withColumns({f"st_{n}": F.col(f"stats_.{n}") for n in self.fields}).drop("stats_")
        made, roles = {}, {}
        for k, c in enumerate(self.numeric):
            for s in self.statistics:
                if s in NUMERIC:
                    own = F.col(f"st_{s}_{k}")
                    made[f"grb__{self.group}__{s}__{c}"] = F.col(c).cast("double") - own if s.startswith("delta") else own
        for k, c in enumerate(self.category):
            for s in self.statistics:
                if s in CATEGORY:
                    own = F.col(f"st_mode_{k}")
                    made[f"grb__{self.group}__{s}__{c}"] = own if s == "mode" else (F.col(c) == own).cast("double")
                    roles[f"grb__{self.group}__{s}__{c}"] = R.category() if s == "mode" else R.numeric()
        out = Frame(df.withColumns(made), frame.roles | {c: roles.get(c, R.numeric()) for c in made}, frame.keys)
        return out.select(list(made))


class AllGroups(Operator):
    """The statistics of every numeric and other categorical feature within each of the categorical features with the most values.

    ``groups`` names the group features instead. One table of statistics is made for each group feature;
    groups that the fit hasn't seen give 0 for numbers.
    """

    def __init__(self, groups: list[str] | None = None, most: int = 3, statistics: tuple[str, ...] = NUMERIC + CATEGORY):
        self.groups, self.most, self.statistics = groups, most, statistics

    def fit(self, frame: Frame) -> AllGroups:
        numbers = [c for c in frame.features if frame.roles[c].name == "numeric"]
        categories = [c for c in frame.features if frame.roles[c].name == "category"]
        groups = self.groups
        if groups is None:
            counts = unique_counts(frame.df, categories, approximate=True) if categories else None
            groups = [r["feature"] for r in top_features(counts, self.most).collect()] if categories else []  # one row for each feature
        self.operators = [GroupStatistics(g, numbers, [c for c in categories if c != g], self.statistics).fit(frame) for g in groups]
        return self

    def transform(self, frame: Frame) -> Frame:
        out, made = frame, {}
        for operator in self.operators:
            wide = operator.transform(Frame(out.df.withColumns({f"kept__{c}": F.col(c) for c in frame.features}), frame.roles, frame.keys))
            new = {c: wide.roles[c] for c in wide.features}
            filled = {c: F.coalesce(F.col(c), F.lit(0.0)) for c, r in new.items() if r.name == "numeric"}
            df = wide.df.withColumns(filled).withColumns({c: F.col(f"kept__{c}") for c in frame.features}).drop(*[f"kept__{c}" for c in frame.features])
            made |= new
            out = Frame(df, frame.roles | made, frame.keys)
        return out.select(list(made))
