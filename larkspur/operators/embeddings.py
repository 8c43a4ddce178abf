"""Vectors of texts: a store by content, pooled random projections, and removal of a common direction.

The store is a folder of Parquet rows (key, vector). A key is the hash of a model's name and a text, so an
entry never changes: equal texts share one, and a job that is lost leaves whole entries or none of a
file. Only texts without an entry are computed, once each, and appended.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.frame import quoted
from larkspur.operators.vectors import SingularVectors
from larkspur.storage import stored


class EmbeddingStore:
    """``vectors`` looks texts up and computes what is missing; ``computed`` counts what the last call had to compute.

    ``compute`` takes a frame of key and text and returns key and vector (array<double>) for its rows. ``model`` names
    what it computes; a store may hold several.
    """

    def __init__(self, path: str, model: str, compute: Callable[[DataFrame], DataFrame]):
        self.path, self.model, self.compute, self.computed = path, model, compute, 0

    def key(self, text: Column) -> Column:
        return F.sha2(F.concat(F.lit(self.model + "\0"), F.coalesce(text, F.lit(""))), 256)

    def entries(self, df: DataFrame) -> DataFrame:
        """All entries; one for each key, should two jobs have computed it at the same time."""
        spark = df.sparkSession
        schema = "key string, vector array<double>"
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            return df.limit(0).select(F.lit("").alias("key"), F.array().cast("array<double>").alias("vector"))
        return spark.read.schema(schema).parquet(self.path).groupBy("key").agg(F.first("vector").alias("vector"))

    def vectors(self, df: DataFrame, text: str, name: str = "vector") -> DataFrame:
        """``df`` with the vectors of its texts as ``name``; a null is an empty text."""
        keyed = df.withColumn("key__", self.key(F.col(quoted(text))))
        wanted = keyed.select(F.col("key__").alias("key"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("text")).groupBy("key").agg(F.first("text").alias("text"))
        missing = stored(wanted.join(self.entries(df).select("key"), "key", "left_anti"))
        self.computed = missing.count()
        if self.computed:
            self.compute(missing).select("key", F.col("vector").cast("array<double>")).write.mode("append").parquet(self.path)
        found = self.entries(df).withColumnsRenamed({"key": "key__", "vector": name})
        return keyed.join(found, "key__", "left").drop("key__")


def orthogonal(size: int, width: int, seed: int = 42) -> np.ndarray:
    """``width`` random directions of ``size`` dimensions, orthogonal as far as there are dimensions."""
    r, made = np.random.default_rng(seed), []
    while sum(m.shape[1] for m in made) < width:
        q, upper = np.linalg.qr(r.normal(size=(size, size)))
        made.append(q * np.sign(np.diag(upper)))
    return np.concatenate(made, axis=1)[:, :width]


def pooled_projections(df: DataFrame, key: str, tokens: str, vectors: DataFrame, size: int, width: int = 64, seed: int = 42) -> DataFrame:
    """key and vector: the greatest and the mean of each random projection over a document's tokens that have a vector; zeros for none.

    ``vectors`` holds token and vector (``size`` numbers). The words are projected once each, and a document's words are
    pooled by an aggregation that is combined before its shuffle.
    """
    directions = orthogonal(size, width, seed)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([v.values.to_numpy() for v in batch.column(1)]).reshape(-1, size) @ directions
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["token", "p"])

    words = vectors.select("token", F.col("vector").cast("array<double>")).mapInArrow(project, "token string, p array<double>")
    found = df.select(quoted(key), F.explode(quoted(tokens)).alias("token")).join(words, "token")
    pools = [f(F.col("p")[k]).alias(f"{n}{k}") for n, f in (("m", F.max), ("a", F.avg)) for k in range(width)]
    each = found.groupBy(F.col(quoted(key)).alias("k_")).agg(*pools)
    names = [f"{n}{k}" for n in "ma" for k in range(width)]
    out = df.select(quoted(key)).join(each, F.col(quoted(key)) == F.col("k_"), "left")
    return out.select(quoted(key), F.array(*[F.coalesce(n, F.lit(0.0)) for n in names]).alias("vector"))


def without_first_direction(df: DataFrame, vector: str) -> DataFrame:
    """The vectors less their part along the first singular direction of all of them."""
    first = SingularVectors(vector, 1).fit(df).matrix[:, 0]
    unit = F.array(*[F.lit(float(x)) for x in first])
    along = F.aggregate(F.zip_with(quoted(vector), unit, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    # in an array of one, so that the sum is made once for a row
    less = F.transform(F.array(along), lambda s: F.zip_with(quoted(vector), unit, lambda a, b: a - s * b))[0]
    return df.withColumn(vector, less)
