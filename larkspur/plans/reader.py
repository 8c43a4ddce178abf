"""The reader: from a table and a few declared roles to a frame with all roles, folds and class codes."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur import roles as R
from larkspur.frame import Frame, quoted
from larkspur.functions import metrics
from larkspur.operators.categorical import lookup
from larkspur.operators.validation import hash_fold, stratified_folds
from larkspur.plans import role_rules

NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


@dataclass
class Reader:
    """``fit_read`` profiles all columns in a pass or two, drops what tells nothing, guesses roles and makes folds; ``read`` applies that."""

    task: str = "binary"
    keys: list[str] = field(default_factory=list)
    most_null: float = 0.999
    most_constant: float = 0.999
    folds: int = 5
    advanced: bool = False
    least_gini: float = 0.0
    seed: int = 42
    state: dict[str, Any] = field(default_factory=dict)

    def fit_read(self, df: DataFrame, declared: dict) -> Frame:
        declared = R.parse(declared)
        special = {c: r for c, r in declared.items() if r.name in ("target", "folds", "weights", "group", "treatment", "id")}
        dropped = [c for c, r in declared.items() if r.name == "drop"]
        columns = [c for c in df.columns if c not in special and c not in dropped and c not in self.keys]
        rates = {r["feature"]: r for r in metrics.constant_rates(df, columns, self.most_constant).collect()} if columns else {}  # one row per column
        useful = [c for c in columns if rates[c]["null_rate"] < self.most_null and (rates[c]["constant_rate"] or 0.0) < self.most_constant or c in declared and declared[c].force_input]
        guessed = self.guess(df, [c for c in useful if c not in declared])
        roles = special | {c: declared.get(c) or guessed[c] for c in useful}
        self.state = {"roles": roles, "target": next((c for c, r in special.items() if r.name == "target"), None)}
        out = self.read(df)
        if self.state["target"] and self.task in ("binary", "multiclass"):
            self.state["classes"] = class_codes(df, self.state["target"])
            out = self.coded(out)
        if self.folds > 1 and not any(r.name == "folds" for r in roles.values()):
            out = self.with_folds(out)
        if self.advanced and self.state["target"]:
            out = self.refined(out, set(declared))
        return out

    def read(self, df: DataFrame) -> Frame:
        """The columns of the fit, numbers and dates parsed where the role asks for them; columns that are missing are null."""
        made = []
        for c, r in self.state["roles"].items():
            if c not in df.columns:
                made.append(F.lit(None).cast(r.dtype).alias(c))
            elif r.name == "numeric":
                made.append(F.col(quoted(c)).try_cast("double").alias(c))
            elif r.name == "datetime":
                kind = dict(df.dtypes)[c]
                made.append((F.try_to_timestamp(F.col(quoted(c))) if kind == "string" else F.col(quoted(c)).cast("timestamp")).alias(c))
            else:
                made.append(F.col(quoted(c)))
        keys = [k for k in self.keys if k not in self.state["roles"]]
        return Frame(df.select(*map(quoted, keys), *made), dict(self.state["roles"]), self.keys)

    def guess(self, df: DataFrame, columns: list[str]) -> dict[str, R.Role]:
        """Numbers by type; text that reads as numbers is numeric, as dates datetime, else a category."""
        kinds = dict(df.dtypes)
        texts = [c for c in columns if kinds[c] == "string"]
        fails = {}
        if texts:
            bad = lambda c, x: F.count_if(F.col(quoted(c)).isNotNull() & x.isNull())
            row = df.agg(*[e for k, c in enumerate(texts) for e in (bad(c, F.col(quoted(c)).try_cast("double")).alias(f"n{k}"), bad(c, F.try_to_timestamp(F.col(quoted(c)))).alias(f"d{k}"))]).first()
            fails = {c: (row[f"n{k}"], row[f"d{k}"]) for k, c in enumerate(texts)}
        out = {}
        for c in columns:
            if kinds[c] in NUMBERS or kinds[c].startswith("decimal"):
                out[c] = R.numeric()
            elif kinds[c] in ("date", "timestamp", "timestamp_ntz"):
                out[c] = R.datetime()
            elif c in fails and fails[c][0] == 0:
                out[c] = R.numeric()
            elif c in fails and fails[c][1] == 0:
                out[c] = R.datetime()
            else:
                out[c] = R.category()
        return out

    def coded(self, frame: Frame) -> Frame:
        target = self.state["target"]
        df = lookup(frame.df, self.state["classes"].select("value", F.col("code").alias("code__")), [target])
        return Frame(df.withColumn(target, F.col("code__")).drop("code__"), frame.roles, frame.keys)

    def with_folds(self, frame: Frame) -> Frame:
        group = frame.attribute("group")
        if group:
            df = frame.df.withColumn("fold__", hash_fold([group], self.folds, self.seed))
        elif self.task in ("binary", "multiclass") and self.state["target"]:
            df = stratified_folds(frame.df.withColumn("h__", F.xxhash64(F.lit(self.seed), *self.keys)), self.state["target"], ["h__", *self.keys], self.folds, "fold__").drop("h__")
        else:
            df = frame.df.withColumn("fold__", hash_fold(self.keys, self.folds, self.seed))
        return Frame(df, frame.roles | {"fold__": R.make("folds")}, frame.keys)

    def refined(self, frame: Frame, declared: set[str]) -> Frame:
        """Roles by the role rules: numbers that tell more as categories, how categories are encoded; columns below ``least_gini`` go."""
        numbers = [c for c in frame.features if frame.roles[c].name == "numeric"]
        texts = [c for c in frame.features if frame.roles[c].name == "category" and frame.roles[c].encoding == "auto"]
        if not numbers and not texts:
            return frame
        kind = self.task if self.task in ("binary", "multiclass") else "reg"
        stats = role_rules.role_stats(frame, numbers, texts, self.state["target"], frame.attribute("folds"), kind)
        roles = role_rules.advised_roles(role_rules.role_rules(stats, sorted(declared & set(numbers)), least_score=self.least_gini), frame.roles)
        forced = {c for c in frame.features if frame.roles[c].force_input}
        weak = [c for c in frame.features if roles[c].name == "drop" and c not in forced]
        roles |= {c: frame.roles[c] for c in forced if roles[c].name == "drop"}
        self.state["roles"] = {c: r for c, r in roles.items() if c not in weak and c != "fold__"}
        return frame.with_roles({c: roles[c] for c in frame.features}).drop(weak)


def class_codes(df: DataFrame, target: str, most: int = 10_000) -> DataFrame:
    """value and code from 0, the commonest class first, ties by value. A null or single class, or too many, is an error."""
    rows = df.groupBy(target).agg(F.count("*").alias("n")).orderBy(F.desc("n"), target).limit(most + 1).collect()
    if any(r[0] is None for r in rows) or not 2 <= len(rows) <= most:
        raise ValueError(f"a class target needs 2 to {most} classes and no nulls")
    kind = df.select(target).dtypes[0][1]
    return df.sparkSession.createDataFrame([(r[0], k) for k, r in enumerate(rows)], f"value {kind}, code int")
