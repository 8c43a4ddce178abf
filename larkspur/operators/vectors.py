"""Principal components and truncated singular vectors of dense features."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def oriented(matrix: np.ndarray) -> np.ndarray:
    """Columns with the sign that makes their largest entry positive."""
    top = matrix[np.abs(matrix).argmax(0), np.arange(matrix.shape[1])]
    return matrix * np.where(top < 0, -1.0, 1.0)


def projected(df: DataFrame, vector: str, matrix: np.ndarray, center: np.ndarray, prefix: str) -> DataFrame:
    """``prefix_<i>`` for each column of the matrix: sum of (x - center) * column."""
    columns = {}
    for i in range(matrix.shape[1]):
        weights, shift = F.array(*[F.lit(float(x)) for x in matrix[:, i]]), float(center @ matrix[:, i])
        columns[f"{prefix}_{i}"] = F.aggregate(F.zip_with(vector, weights, lambda a, b: a * b), F.lit(-shift), lambda a, x: a + x)
    return df.withColumns(columns)


class PrincipalComponents:
    """At most ``n`` components of an array column, of its centred values."""

    def __init__(self, vector: str, n: int = 500, prefix: str = "pca"):
        self.vector, self.n, self.prefix = vector, n, prefix

    def fit(self, df: DataFrame) -> PrincipalComponents:
        dense = df.select(array_to_vector(F.transform(self.vector, lambda x: x.cast("double"))).alias("v"))
        row = dense.agg(Summarizer.mean(F.col("v")).alias("m")).first()
        self.center = row["m"].toArray()
        n = max(1, min(self.n, len(self.center) - 1))
        self.matrix = oriented(np.array(PCA(k=n, inputCol="v", outputCol="p").fit(dense).pc.toArray()))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return projected(df, self.vector, self.matrix, self.center, self.prefix)


class SingularVectors(PrincipalComponents):
    """At most ``n`` right singular vectors of the values as they are."""

    def __init__(self, vector: str, n: int = 100, prefix: str = "svd"):
        super().__init__(vector, n, prefix)

    def fit(self, df: DataFrame) -> SingularVectors:
        rows = df.select(array_to_vector(F.transform(self.vector, lambda x: x.cast("double"))).alias("v"))
        size = rows.first()["v"].size
        matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "v"))  # the rows stay in the JVM
        self.matrix = oriented(np.array(matrix.computeSVD(max(1, min(self.n, size - 1))).V.toArray()))
        self.center = np.zeros(size)
        return self


def as_array(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    out = VectorAssembler(inputCols=columns, outputCol="v__").transform(df)
    return out.withColumn(name, vector_to_array("v__")).drop("v__")
