"""Sharding by weighted rendezvous hashing, with built-in functions only.

Every shard draws a number from the record's key and its own name; the shard with the best draw gets
the record. A new shard can only win records for itself, so a change of the shard count moves few.
Slots number a shard's records without a gap: records are range-partitioned by shard and key, counted
per partition, and each partition's start is a running sum of those counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.shared import quoted, settle


def draw(key: Column, shard: int, weight: float) -> Column:
    """The shard's draw for the key, higher is better: -weight / ln(u), u evenly in (0, 1) from 52 bits of MD5."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{shard}:"), key)), 1, 13), 16, 10).cast("long")
    return F.lit(-float(weight)) / F.log((bits + F.lit(0.5)) / F.lit(float(1 << 52)))


def best_draw(key: Column, weights: list[float]) -> Column:
    """draw and shard of the best draw; of equal draws the first shard's. Null keys count as one key."""
    draws = [F.struct(draw(key_name(key), k, w).alias("draw"), F.lit(-k).alias("last")) for k, w in enumerate(weights)]
    best = F.greatest(*draws) if len(draws) > 1 else draws[0]
    return F.struct(best["draw"].alias("draw"), (-best["last"]).cast("int").alias("shard"))


def key_name(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit("\x00null"))


def shard_rows(
    df: DataFrame, shards: int = 16, weights: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text", grown_weight: float = 1.0
) -> DataFrame:
    """Shard, slot and the shard after growth by one, for every row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes plus 1 (a null text: 1); a null text's crc32 is that of no
    bytes. Equal keys share a shard, null keys too. Slots follow (key, size, crc32) within a shard, so
    they don't depend on how the input is split; equal rows get one each. Other columns aren't read.
    """
    weights = weights or [1.0] * shards
    raw = F.encode(F.coalesce(F.col(quoted(text_col)), F.lit("")), "UTF-8")
    key = F.col(quoted(id_col))
    rows = df.select(
        key.alias("doc_id"),
        (F.octet_length(raw).cast("long") + 1).alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("key").alias("law"),
        best_draw(key, weights).alias("best"),
        draw(key_name(key), len(weights), grown_weight).alias("new"),  # one more shard wins what it draws better for
    )
    rows = rows.withColumns({"shard": F.col("best.shard"), "grown_shard": F.when(F.col("new") > F.col("best.draw"), len(weights)).otherwise(F.col("best.shard"))})
    rows = rows.drop("best", "new").withColumn("tie", F.monotonically_increasing_id())
    order = ["shard", "doc_id", "size", "text_crc32", "tie"]  # the tie lets a hot key spread over partitions
    ordered = settle(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
        .withColumn("place", F.monotonically_increasing_id())
        .drop("tie")
    )
    # a row per partition and shard in it: at most the number of partitions plus that of shards, whatever the rows
    parts = ordered.groupBy("shard", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("shard", "part", (before - F.col("first")).alias("shift"))
    return ordered.join(F.broadcast(starts), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", (F.col("place") + F.col("shift")).alias("slot"), "grown_shard"
    )
