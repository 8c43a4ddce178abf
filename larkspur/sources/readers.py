"""Sources: one reader for paths, queries and local data, all ending in a DataFrame."""

from __future__ import annotations

from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: names of side arrays given with an in-memory table, and their columns (fixed values)
SIDE = {"target": "__TARGET__", "folds": "__FOLDS__", "weights": "__WEIGHTS__", "group": "__GROUP__"}


def read_data(spark: SparkSession, data: Any, columns: list[str] | None = None, schema: str | None = None, **options: Any) -> DataFrame:
    """A DataFrame as it is; a path by its ending (csv, parquet, feather, json, orc); a pandas frame, an
    Arrow table, a 2-D array with ``columns``, or a dict with ``data`` and side arrays; a JDBC query as dict.

    Only the named columns are read where the format allows that; NaN of local data becomes null.
    """
    if isinstance(data, DataFrame):
        return data.select(*columns) if columns else data
    if isinstance(data, str):
        return read_path(spark, data, columns, schema, **options)
    if isinstance(data, dict) and "query" in data:
        return read_jdbc(spark, **data)
    if isinstance(data, dict) and "data" in data:
        table = local_table(data["data"], columns)
        for name, column in SIDE.items():
            if name in data:
                table = table.append_column(column, pa.array(data[name]))
        return spark.createDataFrame(table)
    df = spark.createDataFrame(local_table(data, columns))
    return df.select(*columns) if columns else df


def local_table(data: Any, columns: list[str] | None) -> pa.Table:
    if isinstance(data, pa.Table):
        return data
    if not isinstance(data, pd.DataFrame):
        data = pd.DataFrame(data, columns=columns)
    return pa.Table.from_pandas(data, preserve_index=False)


def read_path(spark: SparkSession, path: str, columns: list[str] | None = None, schema: str | None = None, **options: Any) -> DataFrame:
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind in ("feather", "arrow"):
        spark.dataSource.register(FeatherSource)
        reader = spark.read.format("feather_files")
        return reader.option("path", path).option("columns", ",".join(columns or [])).load()
    reader = spark.read.options(**options)
    if schema:
        reader = reader.schema(schema)
    if kind in ("csv", "tsv", "txt"):
        reader = reader.option("header", options.get("header", True)).option("sep", options.get("sep", "\t" if kind == "tsv" else ","))
        df = (reader if schema else reader.option("inferSchema", True)).csv(path)
    else:
        df = getattr(reader, {"json": "json", "jsonl": "json", "orc": "orc"}.get(kind, "parquet"))(path)
    return df.select(*columns) if columns else df


def read_jdbc(spark: SparkSession, url: str, query: str, index: str | None = None, low: int | None = None, high: int | None = None, partitions: int = 1, **options: Any) -> DataFrame:
    """A query over JDBC; with an index column and its limits, in that many ranges."""
    reader = spark.read.format("jdbc").options(url=url, **options)
    if index and partitions > 1:
        ranges = {"partitionColumn": index, "lowerBound": low, "upperBound": high, "numPartitions": partitions}
        return reader.options(dbtable=f"({query}) q", **ranges).load()
    return reader.option("query", query).load()


def read_sql(spark: SparkSession, query: str, views: dict[str, DataFrame] | None = None) -> DataFrame:
    """A Spark SQL query over registered views."""
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(query)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, length and content of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def text_rows(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """n: lines of a text file that aren't blank, without the header."""
    n = spark.read.text(path).filter(F.trim("value") != "").agg(F.count("*").alias("n"))
    return n.select((F.col("n") - int(header)).alias("n"))


def without_nan(df: DataFrame) -> DataFrame:
    """NaN of all floating columns as null."""
    kinds = dict(df.dtypes)
    return df.select(*[F.nanvl(F.col(f"`{c}`"), F.lit(None).cast(t)).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in kinds.items()])


class Batches(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class FeatherReader(DataSourceReader):
    """Record batches of one file, a few to a task; only the named columns are read."""

    def __init__(self, options: dict):
        self.path, self.columns = options["path"], [c for c in options.get("columns", "").split(",") if c]

    def open(self) -> pa.RecordBatchFileReader:
        import pyarrow.fs as pafs

        fs, path = pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)
        file = fs.open_input_file(path)
        whole = pa.ipc.open_file(file).schema
        use = [whole.get_field_index(c) for c in self.columns or whole.names]
        return pa.ipc.open_file(file, options=pa.ipc.IpcReadOptions(included_fields=use))

    def partitions(self) -> list[InputPartition]:
        n = self.open().num_record_batches
        step = max(1, n // 1000)
        return [Batches(a, min(a + step, n)) for a in range(0, n, step)] or [Batches(0, 0)]

    def read(self, partition: Batches):
        reader = self.open()
        names = self.columns or reader.schema.names
        for k in range(partition.first, partition.last):
            yield reader.get_batch(k).select(names)


class FeatherSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feather_files"

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema

        reader = FeatherReader(self.options).open()
        names = [c for c in self.options.get("columns", "").split(",") if c] or reader.schema.names
        return from_arrow_schema(pa.schema([reader.schema.field(n) for n in names]))

    def reader(self, schema) -> DataSourceReader:
        return FeatherReader(self.options)
