"""Binning for scorecards: the monotone bins of most information value, and their weights of evidence.

One aggregation counts rows and events in fine pre-bins of all columns: quantile bins of numbers, and the
values of categories in the order of their event rates. A column has few pre-bins, whatever its rows; for
each a dynamic program over runs of pre-bins, a task of its own, finds the bins that together hold
most information value, under a least share of the rows and event rates that only rise or only fall.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur import roles as R
from larkspur.frame import Frame, quoted
from larkspur.functions.ordered import column_quantiles
from larkspur.operators.base import Operator
from larkspur.operators.categorical import lookup
from larkspur.storage import stored

SMOOTH = 0.5
#: A value of a category with a smaller share of the rows counts as rare, so that a column has at most 200 others.
RARE = 0.005


def evidence(g, b, all_g: float, all_b: float):
    """Weight of evidence and information value of g events and b others."""
    pg, pb = (g + SMOOTH) / (all_g + SMOOTH), (b + SMOOTH) / (all_b + SMOOTH)
    woe = np.log(pg) - np.log(pb)
    return woe, (pg - pb) * woe


def best_bins(n: np.ndarray, g: np.ndarray, all_g: float, all_b: float, least: float, most: int) -> list[int]:
    """Ends of the bins (numbers of pre-bins) with the greatest sum of information value.

    Bins are runs of the pre-bins (n rows, g events each) with at least ``least`` rows, at most ``most`` of them, and
    their event rates rise or fall all along. Of equal sums the one with fewer bins is taken; one bin where no cut is allowed.
    """
    k = len(n)
    rows, events = (np.concatenate([[0], np.cumsum(x)]).astype(float) for x in (n, g))
    size, hits = rows[None] - rows[:, None], events[None] - events[:, None]  # of the run from i to j
    runs = np.triu(np.ones((k + 1, k + 1), bool), 1) & (size >= least)
    with np.errstate(divide="ignore", invalid="ignore"):
        rate = np.where(runs, hits / size, np.nan)
        value = np.where(runs, evidence(hits, size - hits, all_g, all_b)[1], -np.inf)
    best = (-np.inf, [k])
    for sign in (1, -1):
        now = np.full((k + 1, k + 1), -np.inf)  # the last run is from i to j
        now[0] = value[0]
        before: list[np.ndarray] = []
        for bins in range(1, most + 1):
            at = int(np.argmax(now[:, k]))
            if now[at, k] > best[0] + 1e-12:
                ends, i = [k], at
                for step in reversed(before):
                    if i == 0:
                        break
                    ends.append(i)
                    i = int(step[i, ends[-2]])
                best = (float(now[at, k]), ends[::-1])
            if bins == most:
                break
            new, chosen = np.full((k + 1, k + 1), -np.inf), np.zeros((k + 1, k + 1), int)
            for i in range(1, k):
                first = now[:i, i]
                if not np.isfinite(first).any():
                    continue
                fits = sign * rate[:i, i][:, None] < sign * rate[i, i + 1 :][None]
                sums = np.where(fits, first[:, None], -np.inf)
                chosen[i, i + 1 :] = sums.argmax(0)
                new[i, i + 1 :] = value[i, i + 1 :] + sums.max(0)
            before.append(chosen)
            now = new
    return best[1]


def below(value: Column, cuts: list[float]) -> Column:
    """Number of cuts below a value."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda b: b < value)) if cuts else F.lit(0)


class ScorecardBins(Operator):
    """Weights of evidence of the best monotone bins of numbers and categories, named ``woe__<column>``.

    ``fine`` quantile bins of a number, or the values of a category, are merged to at most ``most`` bins with a share of
    ``least`` of the rows with a value. Missing values are a bin of their own; new and rare values of a category
    share one, and one that the fit has no rows for weighs 0. Columns with less information value than ``least_value`` are left out.
    """

    def __init__(self, fine: int = 32, most: int = 8, least: float = 0.05, least_value: float = 0.0):
        self.fine, self.most, self.least, self.least_value = fine, most, least, least_value

    def counted(self, frame: Frame) -> DataFrame:
        """feature, pre (number of the pre-bin), level (value of a category; rare ones are null with pre -1), missing, n and g."""
        y = F.col(quoted(frame.attribute("target"))).cast("double")
        entries = []
        for c in self.numbers:
            v = F.col(quoted(c)).cast("double")
            empty = v.isNull() | F.isnan(v)
            entries.append(F.struct(F.lit(c).alias("feature"), F.when(~empty, below(v, self.cuts[c])).alias("pre"), F.lit(None).cast("string").alias("level")))
        entries += [F.struct(F.lit(c).alias("feature"), F.lit(None).cast("int").alias("pre"), F.col(quoted(c)).cast("string").alias("level")) for c in self.texts]
        each = frame.df.select(F.explode(F.array(*entries)).alias("x"), y.alias("y")).groupBy("x.feature", "x.pre", "x.level").agg(F.count("*").alias("n"), F.sum("y").alias("g"))
        whole = each.groupBy("feature").agg(F.sum("n").alias("all_n"))
        rare = F.col("level").isNotNull() & (F.col("n") < RARE * F.col("all_n"))
        each = each.join(F.broadcast(whole), "feature")  # a row for each column
        each = each.select("feature", F.when(rare, -1).otherwise(F.col("pre")).alias("pre"), F.when(~rare, F.col("level")).alias("level"), "n", "g")
        return each.groupBy("feature", "pre", "level").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))

    def fit(self, frame: Frame) -> ScorecardBins:
        self.numbers = [c for c in frame.features if frame.roles[c].name == "numeric"]
        self.texts = [c for c in frame.features if frame.roles[c].name == "category"]
        quantiles = column_quantiles(frame.df, self.numbers, [k / self.fine for k in range(1, self.fine)]) if self.numbers else {}
        self.cuts = {c: sorted({x for x in q if x is not None}) for c, q in quantiles.items()}
        self.state, self.tables = {}, {}
        if not self.numbers and not self.texts:
            return self
        least, most = self.least, self.most

        def work(part: pa.Table) -> pa.Table:
            rows = part.to_pylist()
            all_g = sum(r["g"] for r in rows)
            all_b = sum(r["n"] for r in rows) - all_g
            known = [r for r in rows if r["pre"] is not None or r["level"] is not None]
            rate = lambda r: r["g"] / r["n"]
            number = all(r["level"] is None for r in known) and not any(r["pre"] == -1 for r in known)
            known.sort(key=(lambda r: r["pre"]) if number else (lambda r: (rate(r), r["level"] or "")))
            n, g = (np.array([r[c] for r in known], float) for c in ("n", "g"))
            ends = best_bins(n, g, all_g, all_b, least * n.sum(), most) if known else []
            out, first = [], 0
            for number_, end in enumerate(ends):
                hits = g[first:end].sum()
                woe, value = evidence(hits, n[first:end].sum() - hits, all_g, all_b)
                out += [r | {"bin": number_, "woe": float(woe), "value": float(value)} for r in known[first:end]]
                first = end
            for r in rows:
                if r["pre"] is None and r["level"] is None:
                    woe, value = evidence(r["g"], r["n"] - r["g"], all_g, all_b)
                    out.append(r | {"bin": -1, "woe": float(woe), "value": float(value)})
            return pa.Table.from_pylist(out, schema=part.schema.append(pa.field("bin", pa.int32())).append(pa.field("woe", pa.float64())).append(pa.field("value", pa.float64())))

        made = self.counted(frame).groupBy("feature").applyInArrow(work, "feature string, pre int, level string, n long, g double, bin int, woe double, value double")
        self.bins = stored(made)
        values = self.bins.select("feature", "bin", "value").distinct().groupBy("feature").agg(F.sum("value").alias("v")).collect()  # a number for each column
        self.values = {r["feature"]: r["v"] for r in values}
        kept = [c for c in [*self.numbers, *self.texts] if self.values.get(c, 0.0) >= self.least_value]
        self.state = {c: {} for c in kept}
        for r in self.bins.filter("level is null").toLocalIterator():  # at most ``fine`` numbers of a column
            if r["feature"] in kept:
                self.state[r["feature"]][r["pre"]] = r["woe"]
        for c in kept:
            if c in self.texts:
                self.tables[c] = self.bins.filter((F.col("feature") == c) & F.col("level").isNotNull()).select("level", F.col("woe").alias(f"woe__{c}"))
        return self

    def transform(self, frame: Frame) -> Frame:
        df, made = frame.df, {}
        for c, woe in self.state.items():
            name = f"woe__{c}"
            made[name] = R.numeric()
            value = F.col(quoted(c))
            if c in self.tables:
                # rare and new values share a weight
                df = lookup(df.withColumn("level_", value.cast("string")), self.tables[c], ["level_"]).drop("level_")
                df = df.withColumn(name, F.when(value.isNull(), F.lit(woe.get(None, 0.0))).otherwise(F.coalesce(F.col(quoted(name)), F.lit(woe.get(-1, 0.0)))))
                continue
            v = value.cast("double")
            weights = F.array(*[F.lit(woe.get(k, 0.0)) for k in range(len(self.cuts[c]) + 1)])
            df = df.withColumn(name, F.when(v.isNull() | F.isnan(v), F.lit(woe.get(None, 0.0))).otherwise(F.element_at(weights, below(v, self.cuts[c]) + 1)))
        return Frame(df, frame.roles | made, frame.keys).select(list(made))
