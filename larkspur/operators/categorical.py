"""Operators on categorical features: group by value, then a lookup join.

Lookup tables have one row per kept value, and a column of keys may have many. They are made once and counted:
small ones are sent to all tasks, so that rows stay where they are and don't meet by their few values; the
others are joined without a hint.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur import roles as R
from larkspur.frame import Frame, quoted
from larkspur.operators.base import Operator
from larkspur.storage import stored

#: smoothings of target means (fixed values)
ALPHAS = (0.5, 1.0, 2.0, 5.0, 10.0, 50.0, 250.0, 1000.0)


#: lookup tables of up to so many rows are sent to all tasks
FEW = 10_000


def kept_lookup(table: DataFrame) -> DataFrame:
    """``table`` stored, and marked for a broadcast if it has few rows."""
    table = stored(table)
    return F.broadcast(table) if table.limit(FEW + 1).count() <= FEW else table


def lookup(df: DataFrame, table: DataFrame, columns: list[str], default: Column | None = None) -> DataFrame:
    """``df`` with the last column of ``table`` by null-safe equality of ``columns`` with the columns before it."""
    *keys, made = table.columns
    right = table.select(*[F.col(quoted(c)).alias(f"key_{k}_") for k, c in enumerate(keys)], quoted(made))
    same = F.lit(True)
    for k, c in enumerate(columns):
        same = same & df[quoted(c)].eqNullSafe(F.col(f"key_{k}_"))
    out = df.join(right, same, "left").drop(*[f"key_{k}_" for k in range(len(columns))])
    return out if default is None else out.withColumn(made, F.coalesce(quoted(made), default))


def numbered(table: DataFrame, order: list, name: str) -> DataFrame:
    """Rows numbered from 1 by ``order``. The table of distinct values is numbered in range partitions."""
    ranged = table.repartitionByRange(*order).sortWithinPartitions(*order)
    indexed = stored(ranged.withColumn("part_", F.spark_partition_id()).withColumn("place_", F.monotonically_increasing_id()))
    sizes = indexed.groupBy("part_").agg(F.count("*").alias("n_"), F.min("place_").alias("first_"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = sizes.select("part_", (before + 1 - F.col("first_")).alias("shift_"))  # one row for each partition: a few thousand at most
    return indexed.join(F.broadcast(shift), "part_").withColumn(name, (F.col("place_") + F.col("shift_")).cast("int")).drop("part_", "place_", "shift_")


def kept_values(df: DataFrame, column: str, unknown: int) -> DataFrame:
    """value and count of the values that occur more than ``unknown`` times; null is a value."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).filter(F.col("n") > unknown)


class Categorical(Operator):
    prefix = ""
    role = R.category(dtype="int", label_encoded=True)

    def inputs(self, frame: Frame) -> list[str]:
        return [c for c in frame.features if frame.roles[c].name == "category"]

    def table(self, frame: Frame, c: str) -> DataFrame:
        """value and made of one feature."""
        raise NotImplementedError

    default: float | None = None  # of values that the fit hasn't seen

    def fit(self, frame: Frame) -> Categorical:
        self.tables = {c: kept_lookup(self.table(frame, c)) for c in self.inputs(frame)}
        return self

    def transform(self, frame: Frame) -> Frame:
        df, made = frame.df, {}
        for c in self.inputs(frame):
            made[f"{self.prefix}__{c}"] = self.role
            df = lookup(df, self.tables[c].withColumnRenamed("made", f"{self.prefix}__{c}"), [c], None if self.default is None else F.lit(self.default))
        return Frame(df, frame.roles | made, frame.keys).select(list(made))


class LabelEncode(Categorical):
    """1 for the commonest value, 2 for the next, ties by value; 0 for rare and new values."""

    prefix = "le"

    def __init__(self, unknown: int | None = None):
        self.unknown = unknown
        self.default = 0

    def table(self, frame: Frame, c: str) -> DataFrame:
        unknown = frame.roles[c].unknown if self.unknown is None else self.unknown
        kept = stored(kept_values(frame.df, c, unknown))  # its order is sampled first
        return numbered(kept, [F.desc("n"), F.asc_nulls_last("value")], "made").select("value", "made")


class FrequencyEncode(Categorical):
    """How often the value occurred at the fit; 1 for single and new values."""

    prefix = "freq"
    role = R.numeric()

    def __init__(self) -> None:
        self.default = 1

    def table(self, frame: Frame, c: str) -> DataFrame:
        return kept_values(frame.df, c, 1).select("value", F.col("n").alias("made"))


class OrdinalEncode(Categorical):
    """Rank of the value as text among the kept ones; null is one above the last, new values are null. Numbers pass."""

    prefix = "ord"
    role = R.numeric()

    def table(self, frame: Frame, c: str) -> DataFrame:
        if dict(frame.df.dtypes)[c] != "string":
            return frame.df.select(F.col(c).alias("value"), F.col(c).cast("double").alias("made")).distinct()
        kept = stored(kept_values(frame.df, c, frame.roles[c].unknown).filter("value is not null"))
        ranks = numbered(kept, [F.asc("value")], "rank").select("value", F.col("rank").cast("double").alias("made"))
        last = ranks.agg((F.coalesce(F.max("made"), F.lit(0.0)) + 1).alias("made"))
        return ranks.unionByName(last.select(F.lit(None).cast("string").alias("value"), "made"))


class OneHot(Operator):
    """A 0/1 column for each code from the least to the greatest at the fit."""

    def __init__(self, most: int = 1000):
        self.most = most

    def inputs(self, frame: Frame) -> list[str]:
        return [c for c in frame.features if frame.roles[c].name == "category" and frame.roles[c].label_encoded]

    def fit(self, frame: Frame) -> OneHot:
        every = self.inputs(frame)
        row = frame.df.agg(*[f(c).alias(f"{n}{k}") for k, c in enumerate(every) for n, f in (("a", F.min), ("b", F.max))]).first() if every else {}
        self.state = {c: range(row[f"a{k}"], row[f"b{k}"] + 1) if row[f"a{k}"] is not None else range(0) for k, c in enumerate(every)}
        wide = [c for c, codes in self.state.items() if len(codes) > self.most]
        if wide:
            raise ValueError(f"more than {self.most} codes: {wide}")
        return self

    def transform(self, frame: Frame) -> Frame:
        made = {f"ohe_{k}__{c}": F.coalesce((F.col(c) == k).cast("double"), F.lit(0.0)) for c, codes in self.state.items() for k in codes}
        return frame.with_columns(made, R.numeric()).select(list(made))


def joined_value(columns: list[str]) -> Column:
    return F.concat_ws("_", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns])


class Intersections(Operator):
    """Label codes of the joined values of 2 to ``depth`` categorical features, or of the sets named."""

    def __init__(self, sets: list[list[str]] | None = None, depth: int = 2, unknown: int | None = None):
        self.sets, self.depth, self.encoder = sets, depth, LabelEncode(unknown)

    def joined(self, frame: Frame) -> Frame:
        every = sorted(c for c in frame.features if frame.roles[c].name == "category")
        sets = self.sets or [list(s) for n in range(2, self.depth + 1) for s in combinations(every, n)]
        made = {f"({'__'.join(s)})": joined_value(s) for s in sets}
        return frame.with_columns(made, R.category()).select(list(made))

    def fit(self, frame: Frame) -> Intersections:
        self.encoder.prefix = "inter"
        self.encoder.fit(self.joined(frame))
        return self

    def transform(self, frame: Frame) -> Frame:
        return self.encoder.transform(self.joined(frame))


class TargetEncode(Operator):
    """Out-of-fold target means of each category, shrunk to the prior of the other folds.

    Rows are summed to cells of (value, fold) first; every smoothing is judged on the cells alone, by
    log-loss for classes and squared error for numbers, and the first of equal ones is taken. Rows of
    the fit get the mean of the other folds, other rows that of all. ``outputs`` are the target columns:
    one for a binary or numeric target, one 0/1 column per class, or several numbers.
    """

    def __init__(self, outputs: list[str] | None = None, kind: str = "binary", folds: str | None = None, alphas: tuple[float, ...] = ALPHAS):
        self.outputs, self.kind, self.folds, self.alphas = outputs, kind, folds, alphas

    def fit(self, frame: Frame) -> TargetEncode:
        self.targets = self.outputs or [frame.attribute("target")]
        self.fold = self.folds or frame.attribute("folds")
        self.inputs = [c for c in frame.features if frame.roles[c].name == "category"]
        self.state = {}
        for c in self.inputs:
            cells = self.cells(frame, c)
            self.state[c] = (cells, *self.choose(cells))
        return self

    def cells(self, frame: Frame, c: str) -> DataFrame:
        """value, fold, n and per output s (sum), q (sum of squares), with the sums of the other folds and of all, by value and over everything."""
        sums = [F.sum(F.col(t).cast("double")).alias(f"s{k}") for k, t in enumerate(self.targets)] + [F.sum(F.col(t).cast("double") ** 2).alias(f"q{k}") for k, t in enumerate(self.targets)]
        cells = stored(frame.df.groupBy(F.col(c).alias("value"), F.col(self.fold).alias("fold")).agg(F.count("*").alias("n"), *sums))
        names = ["n", *[f"s{k}" for k in range(len(self.targets))]]
        values = cells.groupBy(F.col("value").alias("v_")).agg(*[F.sum(x).alias(f"all_{x}") for x in names])
        folds = cells.groupBy(F.col("fold").alias("f_")).agg(*[F.sum(x).alias(f"fold_{x}") for x in names])
        whole = cells.agg(*[F.sum(x).alias(f"whole_{x}") for x in names])
        out = cells.join(values, F.col("value").eqNullSafe(F.col("v_"))).join(F.broadcast(folds), F.col("fold").eqNullSafe(F.col("f_"))).crossJoin(F.broadcast(whole))
        return out.drop("v_", "f_")

    def score(self, k: int, alpha: Column) -> Column:
        """The encoded value of output k for the rows of a cell."""
        prior = F.try_divide(F.col(f"whole_s{k}") - F.col(f"fold_s{k}"), F.col("whole_n") - F.col("fold_n"))
        return (F.col(f"all_s{k}") - F.col(f"s{k}") + alpha * prior) / (F.col("all_n") - F.col("n") + alpha)

    def loss(self, k: int, alpha: Column) -> Column:
        p = self.score(k, alpha)
        if self.kind in ("binary", "multiclass"):
            p = F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7))
            plain = F.col(f"s{k}") * F.log(p)
            return -(plain if self.kind == "multiclass" else plain + (F.col("n") - F.col(f"s{k}")) * F.log(1 - p))
        return F.col(f"q{k}") - 2 * p * F.col(f"s{k}") + F.col("n") * p * p

    def choose(self, cells: DataFrame) -> tuple[list[float], list[float | None]]:
        """The smoothing and the mean of each output; classes share one smoothing."""
        sums = {(k, a): F.sum(self.loss(k, F.lit(a))) for k in range(len(self.targets)) for a in self.alphas}
        means = [F.max(F.col(f"whole_s{k}") / F.col("whole_n")).alias(f"p{k}") for k in range(len(self.targets))]
        row = cells.agg(*[x.alias(f"l{k}_{i}") for i, ((k, _), x) in enumerate(sums.items())], *means).first()
        priors = [row[f"p{k}"] for k in range(len(self.targets))]
        loss = {key: row[f"l{key[0]}_{i}"] for i, key in enumerate(sums)}
        outputs = range(len(self.targets))
        if self.kind == "multiclass":
            total = [sum(loss[k, a] or 0 for k in outputs) for a in self.alphas]
            return [self.alphas[total.index(min(total))]] * len(self.targets), priors
        own = [[loss[k, a] or 0 for a in self.alphas] for k in outputs]
        return [self.alphas[x.index(min(x))] for x in own], priors

    def names(self, c: str) -> list[str]:
        return [f"oof__{c}"] if len(self.targets) == 1 else [f"multioof_{k}__{c}" for k in range(len(self.targets))]

    def encode(self, frame: Frame, out_of_fold: bool) -> Frame:
        df, made = frame.df, {}
        for c in self.inputs:
            cells, alphas, priors = self.state[c]
            names = self.names(c)
            if out_of_fold:
                scores = [self.score(k, F.lit(a)) for k, a in enumerate(alphas)]
                keys, on = [c, self.fold], ["value", "fold"]
            else:
                prior = [F.col(f"whole_s{k}") / F.col("whole_n") for k in range(len(names))]
                scores = [(F.col(f"all_s{k}") + F.lit(a) * prior[k]) / (F.col("all_n") + F.lit(a)) for k, a in enumerate(alphas)]
                keys, on = [c], ["value"]
            if self.kind == "multiclass":
                total = sum(scores, F.lit(0.0))
                scores = [s / total for s in scores]
            table = cells.select(*on, F.struct(*[s.alias(f"x{k}") for k, s in enumerate(scores)]).alias("made_")).dropDuplicates(on)
            df = lookup(df, kept_lookup(table), keys)
            df = df.withColumns({n: F.coalesce(F.col("made_")[f"x{k}"], F.lit(priors[k])) for k, n in enumerate(names)}).drop("made_")
            made |= dict.fromkeys(names, R.numeric(prob=self.kind != "reg"))
        return Frame(df, frame.roles | made, frame.keys).select(list(made))

    def fit_transform(self, frame: Frame) -> Frame:
        return self.fit(frame).encode(frame, True)

    def transform(self, frame: Frame) -> Frame:
        return self.encode(frame, False)


def unique_counts(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """feature and n_unique, null counted as a value, from one pass over all columns."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    if approximate:
        return long.groupBy("feature").agg((F.approx_count_distinct("value") + F.max(F.col("value").isNull().cast("int"))).cast("long").alias("n_unique"))
    return long.distinct().groupBy("feature").agg(F.count("*").alias("n_unique"))


def top_features(counts: DataFrame, n: int = 5) -> DataFrame:
    """The n features with the most values, ties by name."""
    return counts.orderBy(F.desc("n_unique"), "feature").limit(n)


class WeightOfEvidence(Operator):
    """ln((g + 0.5) / (G + 0.5)) - ln((b + 0.5) / (B + 0.5)) of each value's targets 1 and 0; 0 for new values."""

    def __init__(self, smooth: float = 0.5):
        self.smooth = smooth

    def fit(self, frame: Frame) -> WeightOfEvidence:
        y = F.col(frame.attribute("target")).cast("double")
        self.tables = {}
        for c in (c for c in frame.features if frame.roles[c].name == "category"):
            each = frame.df.groupBy(F.col(c).alias("value")).agg(F.sum(y).alias("g"), F.sum(1 - y).alias("b"))
            whole = each.agg(F.sum("g").alias("all_g"), F.sum("b").alias("all_b"))
            woe = F.log((F.col("g") + self.smooth) / (F.col("all_g") + self.smooth)) - F.log((F.col("b") + self.smooth) / (F.col("all_b") + self.smooth))
            self.tables[c] = kept_lookup(each.crossJoin(F.broadcast(whole)).select("value", woe.alias("made")))
        return self

    def transform(self, frame: Frame) -> Frame:
        df, made = frame.df, {}
        for c, table in self.tables.items():
            made[f"woe__{c}"] = R.numeric()
            df = lookup(df, table.withColumnRenamed("made", f"woe__{c}"), [c], F.lit(0.0))
        return Frame(df, frame.roles | made, frame.keys).select(list(made))
