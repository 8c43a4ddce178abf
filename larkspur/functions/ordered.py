"""Running sums and exact quantiles over a global order, without a single-task window.

Equal keys are first summed by a hash aggregation. Up to ``ROWS_PER_PART`` rows are scanned by one window
for each group. More are dealt to range partitions of the whole order (groups, then the key); each
partition is scanned by a window of its own and starts from the sums of those before it. Where the ranges
are cut only balances the work: any cut gives the same result. There are as many parts as the rows need;
the table of part sums has a row for each group and part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.storage import stored

ROWS_PER_PART = 1_000_000


def running(df: DataFrame, key: str, sums: dict[str, Column], by: Sequence[str] = (), descending: bool = False, keep_part: bool = False) -> DataFrame:
    """One row per group and distinct key: its sums, their running sums up to and with the key as cum_<name>, and the group's as all_<name>.

    Rows with a null key are left out; groups with a null value are groups like others. ``keep_part`` adds
    part_, a number that follows the order.
    """
    by = list(by)
    known = df.filter(F.col(key).isNotNull())
    parts = -(-known.count() // ROWS_PER_PART)
    each = known.groupBy(*by, key).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    order = F.desc(key) if descending else F.asc(key)
    whole = Window.partitionBy(*by)
    if parts <= 1:
        upto = whole.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        made = [x for n in sums for x in (F.sum(n).over(upto).alias(f"cum_{n}"), F.sum(n).over(whole).alias(f"all_{n}"))]
        return each.select(*by, key, *sums, *made, *([F.lit(0).alias("part_")] if keep_part else []))
    # stored, so that a key's part is the same in the sums and in the scan
    ranged = stored(each.repartitionByRange(parts, *by, order).withColumn("part_", F.spark_partition_id()))
    total = ranged.groupBy(*by, "part_").agg(*[F.sum(n).alias(f"part_{n}") for n in sums])
    earlier = whole.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    before = total.select(
        *[F.col(c).alias(f"by_{c}") for c in by],
        F.col("part_").alias("at_part_"),
        *[x for n in sums for x in (F.coalesce(F.sum(f"part_{n}").over(earlier), F.lit(0)).alias(f"before_{n}"), F.sum(f"part_{n}").over(whole).alias(f"all_{n}"))],
    )
    same = F.col("part_") == F.col("at_part_")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"by_{c}"))
    within = Window.partitionBy(*by, "part_").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    made = [x for n in sums for x in ((F.sum(n).over(within) + F.col(f"before_{n}")).alias(f"cum_{n}"), F.col(f"all_{n}"))]
    return ranged.join(before, same).select(*by, key, *sums, *made, *(["part_"] if keep_part else []))


def quantiles(df: DataFrame, key: str, probabilities: list[float], by: Sequence[str] = (), names: list[str] | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles of a numeric column, as columns q0, q1, ... (or ``names``), one row per group.

    Nulls and NaN aren't values; groups without values give no row, and without groups an empty input gives a row of nulls.
    """
    by, names = list(by), names or [f"q{k}" for k in range(len(probabilities))]
    values = df.select(*by, F.col(key).cast("double").alias("v_")).filter(F.col("v_").isNotNull() & ~F.isnan("v_"))
    counted = running(values, "v_", {"n_": F.lit(1)}, by)
    # a key covers the places from cum - n to cum - 1; each quantile lies between two places
    first, end, last = F.col("cum_n_") - F.col("n_"), F.col("cum_n_"), F.col("all_n_") - 1
    made = []
    for p, name in zip(probabilities, names, strict=True):
        place = F.lit(float(p)) * last
        low, high = (F.max(F.when((at >= first) & (at < end), F.col("v_"))) for at in (F.floor(place), F.ceil(place)))
        made.append((low + (high - low) * F.max(place - F.floor(place))).alias(name))
    return counted.groupBy(*by).agg(*made) if by else counted.agg(*made)


def column_quantiles(df: DataFrame, columns: list[str], probabilities: list[float]) -> dict[str, list[float | None]]:
    """Quantiles of several columns of one frame, on the driver: a few numbers per column."""
    if not columns:
        return {}
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select("x.*")
    rows = {r["name"]: [r[f"q{k}"] for k in range(len(probabilities))] for r in quantiles(long, "value", probabilities, ["name"]).collect()}
    return {c: rows.get(c, [None] * len(probabilities)) for c in columns}
