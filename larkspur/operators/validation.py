"""Folds and train/valid splits, as columns and filters: nothing is copied, and a row's fold follows from its key."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.ordered import quantiles
from larkspur.storage import stored


def hash_fold(keys: list[str], k: int = 5, seed: int = 42) -> Column:
    """Fold of a row, or of a group if the keys are those of a group."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(k)).cast("int")


def key_fold(key: str, k: int = 5) -> Column:
    """Fold by the remainder of an integer key."""
    return F.pmod(F.col(key), F.lit(k)).cast("int")


def stratified_folds(df: DataFrame, target: str, order: list[str], k: int = 5, name: str = "fold") -> DataFrame:
    """Folds dealt in turn within each class, in the order given, so that each has its share of the class.

    A class is numbered in range partitions, from the counts before each, not in one task.
    """
    placed = stratified_places(df, target, order)
    return placed.withColumn(name, F.pmod(F.col("place_"), F.lit(k)).cast("int")).select(*df.columns, name)


def stratified_places(df: DataFrame, target: str, order: list[str]) -> DataFrame:
    """Adds place_: the number of rows of the same class before a row, in the order given."""
    ranged = df.repartitionByRange(target, *order).sortWithinPartitions(target, *order)
    ranged = stored(ranged.withColumns({"part_": F.spark_partition_id(), "place_": F.monotonically_increasing_id()}))
    sizes = ranged.groupBy(target, "part_").agg(F.count("*").alias("n_"), F.min("place_").alias("first_"))
    before = F.coalesce(F.sum("n_").over(Window.partitionBy(target).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = sizes.select(F.col(target).alias("class_"), F.col("part_").alias("at_"), (before - F.col("first_")).alias("shift_"))
    joined = ranged.join(F.broadcast(shift), F.col(target).eqNullSafe(F.col("class_")) & (F.col("part_") == F.col("at_")))
    return joined.withColumn("place_", F.col("place_") + F.col("shift_")).drop("part_", "shift_", "class_", "at_")


def stratified_split(df: DataFrame, by: list[str], keys: list[str], test: float = 0.2, seed: int = 42, name: str = "is_test") -> DataFrame:
    """Adds ``name``: whether a row is among the last share ``test`` of its stratum, in the order of the MD5 of a seed and its keys.

    A stratum is numbered in range partitions, from the counts before each, so that a large one is no single task.
    """
    hashed = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    placed = stratified_places(df.withColumns({"h_": hashed, "g_": F.struct(*by)}), "g_", ["h_", *keys])
    sizes = df.groupBy(F.struct(*by).alias("of_")).agg(F.count("*").alias("n_"))
    joined = placed.join(sizes, F.col("g_").eqNullSafe(F.col("of_")))
    return joined.withColumn(name, F.col("place_") >= F.round(F.col("n_") * (1 - test))).select(*df.columns, name)


def time_folds(df: DataFrame, time: str, k: int = 5, name: str = "fold") -> DataFrame:
    """Fold 0 for the earliest part of about equal size, k - 1 for the latest; equal times share a fold."""
    micros = F.unix_micros(F.col(time).cast("timestamp")).cast("double")
    cuts = quantiles(df.select(micros.alias("t_")), "t_", [i / k for i in range(1, k)]).first()
    return df.withColumn(name, sum(((micros > F.lit(c)).cast("int") for c in cuts if c is not None), F.lit(0)).cast("int"))


def date_folds(time: str, dates: list[str]) -> Column:
    """Number of the split dates before a time."""
    return sum(((F.col(time).cast("timestamp") > F.lit(d).cast("timestamp")).cast("int") for d in dates), F.lit(0)).cast("int")


@dataclass
class Split:
    """One train and valid pair, as conditions on the same frame."""

    train: Column
    valid: Column


def dummy() -> Iterator[Split]:
    yield Split(F.lit(True), F.lit(True))


def holdout(condition: Column) -> Iterator[Split]:
    """Valid where the condition holds."""
    yield Split(~condition, condition)


def custom(pairs: list[tuple[Column, Column]]) -> Iterator[Split]:
    for train, valid in pairs:
        yield Split(train, valid)


def k_folds(fold: str, k: int) -> Iterator[Split]:
    for i in range(k):
        yield Split(F.col(fold) != i, F.col(fold) == i)


def expanding(fold: str, k: int, newest_first: bool = False) -> Iterator[Split]:
    """Train on the parts before, validate on the next; the other way round with ``newest_first``."""
    for i in range(1, k):
        part = k - 1 - F.col(fold) if newest_first else F.col(fold)
        yield Split(part < i, part == i)


def uplift_folds(treatment: str, arm: int, fold: str, k: int) -> Iterator[Split]:
    """The other arm is always in the training rows; of ``arm``, all folds but one, which validates."""
    mine = F.col(treatment) == arm
    for i in range(k):
        yield Split(~mine | (F.col(fold) != i), mine & (F.col(fold) == i))


def splits(valid: Column | None = None, pairs: list[tuple[Column, Column]] | None = None, fold: str | None = None, k: int = 5) -> Iterator[Split]:
    """The first that is given of: a hold-out condition, pairs of conditions, a fold column; else all rows for both."""
    if valid is not None:
        return holdout(valid)
    if pairs:
        return custom(pairs)
    return k_folds(fold, k) if fold else dummy()
