"""Results that are kept between jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """``df`` as it is now, for several jobs: row numbers and folds in it cannot change when an executor is lost.

    It is written to the folder that ``spark.checkpoint.dir`` or the Spark context names. Without one, on
    a single machine, it is kept in memory and on disk; on a cluster that is an error, since executors
    share no folder of their own.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    named = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named is not None:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return df.checkpoint(eager=True)
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return df.persist()
