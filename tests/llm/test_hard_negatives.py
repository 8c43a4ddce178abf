"""Hard negatives by a pivot table, against plain sorting of all scores."""

import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from larkspur.llm import hard_negatives as H


def ask():
    return F.col("vec_id") % 100 == 0


def plain(rows, asked, positives=5, negatives=10, low=30, high=90):
    """rows: id, label, vector; what each anchor's windows hold."""
    held = {}
    for key, label, v in rows:
        if key is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        new = (label, [math.floor(256 * float(np.float32(x))) for x in v])
        held[key] = min(held.get(key, new), new)
    out = []
    for a in sorted(k for k in held if asked(k)):
        score = {k: sum(x * y for x, y in zip(held[a][1], v, strict=False)) for k, (_, v) in held.items()}
        order = sorted((k for k in held if k != a), key=lambda k: (-score[k], k))
        for p in [k for k in order if held[k][0] == held[a][0]][:positives]:
            hard = [k for k in order if held[k][0] != held[a][0] and low * score[p] <= 100 * score[k] <= high * score[p]]
            out += [(a, p, i + 1, k, score[p], score[k]) for i, k in enumerate(hard[:negatives])]
    return sorted(out)


@pytest.mark.parametrize(("range_rows", "batch_rows"), [(8192, 2048), (32, 2)])
def test_against_plain_sorting(spark, range_rows, batch_rows):
    r = np.random.default_rng(3)
    rows = [(int(k), int(r.integers(0, 4)), [float(x) for x in r.normal(size=6).round(1)]) for k in range(300)]
    rows += [(301, 1, None), (302, 1, [1.0, None]), (303, 2, [float("nan"), 1.0]), (304, None, [1.0]), (None, 1, [1.0]), (305, 1, []), (306, 2, [9.0]), rows[100], (7, 3, rows[7][2])]
    rows += [(400 + k, 9, [0.0] * 6) for k in range(3)] + [(500, 8, [1.0] * 6), (600, 3, [float("inf")])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = H.hard_negatives(df, ask(), F.col("label"), range_rows=range_rows, batch_rows=batch_rows)
    assert sorted(map(tuple, got.collect())) == plain(rows, lambda k: k % 100 == 0)
    assert H.hard_negatives(df.filter("vec_id < 0"), ask(), F.col("label")).count() == 0
    assert H.hard_negatives(df.filter("vec_id < 99 and vec_id > 0"), ask(), F.col("label")).count() == 0


def test_any_columns(spark):
    rows = [(k, "ab"[k % 2], [1.0 + k / 50, 0.5]) for k in range(40)]
    names = ["id", "Label", "v", "asks", "d", "near", "batch", "rank", "anchor_id"]
    df = spark.createDataFrame([(k, g, v, *names) for k, g, v in rows], ["vec_id", "kind", "embedding", *names])
    got = H.hard_negatives(df, F.col("vec_id") % 10 == 0, F.col("kind"))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == plain(rows, lambda k: k % 10 == 0)


def test_brackets_hold():
    """Every score lies between the bounds that the pivots give, for vectors of all lengths."""
    r = np.random.default_rng(6)
    x = r.integers(-300, 300, (400, 8)) * r.integers(0, 4, (400, 1))
    most = float((x**2).sum(1).max())
    pivots = H.farthest_first(H.augmented(x, most), 6)
    d, q = H.distances(H.augmented(x, most), pivots), x[::7]
    dq = H.distances(np.column_stack([q, np.zeros(len(q))]), pivots)
    length, score = (q**2).sum(1)[:, None], q @ x.T
    gap, reach = np.abs(dq[:, None] - d[None]).max(2), (dq[:, None] + d[None]).min(2)
    assert np.all(score <= (length + most - gap**2) / 2 + 1) and np.all(score >= (length + most - reach**2) / 2 - 1)


def test_tight_groups_are_left_out(spark):
    """Vectors in tight groups: most cells aren't sent."""
    r = np.random.default_rng(8)
    centres = r.normal(size=(30, 16))
    centres *= 4 / np.linalg.norm(centres, axis=1)[:, None]
    rows = [(int(i * 100 + j), int(i % 5), [float(x) for x in c + r.normal(size=16) * 0.01]) for i, c in enumerate(centres) for j in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    options = {"range_rows": 50, "batch_rows": 1}
    got = H.hard_negatives(df, ask(), F.col("label"), **options)
    assert sorted(map(tuple, got.collect())) == plain(rows, lambda k: k % 100 == 0)
    first, second = H.bracket_counts(df, ask(), F.col("label"), **options)
    assert first["cells_sent"] < 0.25 * first["cells"] and second["cells_sent"] < 0.4 * second["cells"]
    assert first["pairs_sent"] + second["pairs_sent"] < 0.15 * 3000 * 30 * 2


def test_registered_query(spark, data):
    from larkspur.llm.queries import op11_hard_negatives

    t = pq.read_table(f"{data}/embeddings.parquet").to_pydict()
    rows = [(k, None if g is None else (g + 1) % 10 if k % 7 == 0 else g, v) for k, g, v in zip(t["vec_id"], t["label"], t["embedding"], strict=True)]
    got = op11_hard_negatives(spark, data)
    assert [t for _, t in got.dtypes] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
    assert sorted(map(tuple, got.collect())) == plain(rows, lambda k: k % 100 == 0)
