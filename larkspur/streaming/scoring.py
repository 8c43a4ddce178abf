"""Fitted operators and models on streams, and windowed counts with late data.

``transform`` of an operator is projections and joins with static tables, so it works on a stream as on
a batch; here are the sink, and the event-time aggregates that stand for child counts of a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larkspur.frame import Frame
from larkspur.operators.base import Operator


def transform_stream(stream: DataFrame, like: Frame, operator: Operator) -> DataFrame:
    """Features of a stream whose rows look like the frame of the fit."""
    return operator.transform(Frame(stream, dict(like.roles), like.keys)).df


def write_batches(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append to Parquet; a restart goes on from the checkpoint, with no row twice."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(stream: DataFrame, time: str, by: list[str], size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, by and n; rows later than ``late`` behind the latest time are left out of a stream."""
    counted = stream.withWatermark(time, late).groupBy(F.window(time, size), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), *by, "n")


def sessions(stream: DataFrame, time: str, by: list[str], gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """session_start, session_end, by and n of runs of rows with no gap of the given length."""
    counted = stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *by, "n")
