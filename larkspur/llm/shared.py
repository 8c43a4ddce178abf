"""What the corpus operators share: stable storage between jobs, Arrow batch mapping, word caches."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Python works on so much of an Arrow batch at once.
SLICE_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and runs on one machine (tests) a temporary folder is made and
    set; on a cluster it would not be shared, so there its absence is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="larkspur-checkpoint-")
        sc.setCheckpointDir(named)
        named = sc.getCheckpointDir()
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there.

    Later jobs read the files, so that lost executors cost no recomputation and values that depend
    on the order of rows (partition numbers, row numbers) cannot change between two uses.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def rows_like(df: DataFrame, columns: list[str]) -> list[T.StructField]:
    return [df.schema[c] for c in columns]


def add_columns(
    df: DataFrame,
    read: list[str],
    make: Callable[[], Callable[..., list]],
    fields: list[T.StructField],
    keep: list[str] | None = None,
) -> DataFrame:
    """Append ``fields`` that a vectorised function computes from the columns ``read``.

    ``make`` runs once per task and returns a function from Arrow arrays (one per column of
    ``read``) to lists or Arrow arrays (one per field). ``keep`` names the columns that stay (all by
    default); a kept column with the name of a new one, in any case, is replaced by the new one. Rows keep
    their order and number; the exchange with Python is in Arrow batches, with no shuffle.
    """
    keep = others(df.columns if keep is None else keep, [f.name for f in fields])
    sent = keep + [c for c in read if c not in keep]
    names = [f.name for f in fields]
    types = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in (part for whole in batches for part in slices(whole)):
            made = work(*(batch.column(batch.schema.get_field_index(c)) for c in read))
            made = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(made, types, strict=True)]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays(kept + made, names=keep + names)

    return df.select(*(F.col(quoted(c)) for c in sent)).mapInArrow(run, T.StructType(rows_like(df, keep) + fields))


def slices(batch: pa.RecordBatch, most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``most_bytes``, one row at least."""
    step = max(1, int(batch.num_rows * most_bytes / max(1, batch.nbytes)))
    return (batch.slice(a, step) for a in range(0, batch.num_rows, step))


def others(columns: list[str], made: list[str]) -> list[str]:
    """The columns that have none of the names ``made``; as in Spark, case makes no difference."""
    taken = {c.lower() for c in made}
    return [c for c in columns if c.lower() not in taken]


def fresh(columns: list[str], name: str) -> str:
    """A column name that isn't taken, in any case."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def split_remainder(key: str = "doc_id") -> str:
    """SQL for crc32(key as text) mod 4; a null key counts as the empty text."""
    return f"pmod(crc32(encode(coalesce(cast({quoted(key)} as string), ''), 'UTF-8')), 4)"

