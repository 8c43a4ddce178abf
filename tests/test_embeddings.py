"""The store of vectors, pooled projections and the removal of a direction."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import embeddings as E
from larkspur.operators import text


def lengths(df):
    return df.select("key", F.array(F.length("text").cast("double"), F.ascii("text").cast("double")).alias("vector"))


def test_a_second_run_computes_nothing(spark, tmp_path):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(["a", "bb", "a", None, "", "ccc"])], "id int, text string")
    store = E.EmbeddingStore(f"{tmp_path}/store", "lengths", lengths)
    first = sorted((r["id"], r["vector"][0]) for r in store.vectors(df, "text").collect())
    assert store.computed == 4 and first == [(0, 1.0), (1, 2.0), (2, 1.0), (3, 0.0), (4, 0.0), (5, 3.0)]
    assert sorted((r["id"], r["vector"][0]) for r in store.vectors(df, "text").collect()) == first and store.computed == 0
    more = df.unionByName(spark.createDataFrame([(9, "new")], df.schema))
    assert store.vectors(more, "text").count() == 7 and store.computed == 1
    other = E.EmbeddingStore(f"{tmp_path}/store", "another model", lambda d: lengths(d).withColumn("vector", F.array(F.lit(7.0))))
    assert {tuple(r["vector"]) for r in other.vectors(df, "text").collect()} == {(7.0,)} and other.computed == 4
    assert store.vectors(df, "text").filter("vector[0] = 7").count() == 0 and store.computed == 0


def test_a_lost_job_leaves_no_half_entry(spark, tmp_path):
    df = spark.range(60).select("id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("text")).repartition(4)

    def broken(d):
        return lengths(d).withColumn("vector", F.when(F.col("vector")[0] > 2, F.array(F.raise_error(F.lit("lost")).cast("double"))).otherwise(F.col("vector")))

    with pytest.raises(Exception, match="lost"):
        E.EmbeddingStore(f"{tmp_path}/s", "m", broken).vectors(df, "text")
    store = E.EmbeddingStore(f"{tmp_path}/s", "m", lengths)
    assert store.vectors(df, "text").filter("size(vector) = 2").count() == 60
    store.vectors(df, "text")
    assert store.computed == 0


def test_pooled_projections_equal_numpy(spark):
    r = np.random.default_rng(1)
    words = {w: r.normal(size=3) for w in "abcd"}
    vectors = spark.createDataFrame([(w, [float(x) for x in v]) for w, v in words.items()], "token string, vector array<double>")
    rows = [(1, list("abca")), (2, ["z"]), (3, None), (4, ["d"])]
    got = {x["id"]: x["vector"] for x in E.pooled_projections(spark.createDataFrame(rows, "id int, tokens array<string>"), "id", "tokens", vectors, 3, 5).collect()}
    p = E.orthogonal(3, 5)
    assert np.allclose(p[:, :3].T @ p[:, :3], np.eye(3))
    for k, t in rows:
        x = np.array([words[w] for w in t or [] if w in words]).reshape(-1, 3) @ p
        assert got[k] == pytest.approx(np.concatenate([x.max(0), x.mean(0)]).tolist() if len(x) else [0.0] * 10)


def test_the_first_direction_goes(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(80, 5)) + np.array([3.0, 1, 0, 0, -2])
    df = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "k int, v array<double>")
    got = np.array([row["v"] for row in E.without_first_direction(df, "v").orderBy("k").collect()])
    u = np.linalg.svd(x, full_matrices=False)[2][0]
    assert np.allclose(got, x - np.outer(x @ u, u))


def test_tokens_and_marks(spark):
    row = spark.range(1).select(text.content_hash(F.lit("a")).alias("h"), text.inverse_sigmoid(F.lit(0.5)).alias("p"), text.scaled(F.array(F.lit(3.0), F.lit(4.0))).alias("v")).first()
    assert row["p"] == 0 and row["v"] == [0.6, 0.8] and row["h"] is not None
