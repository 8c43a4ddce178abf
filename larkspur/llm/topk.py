"""Exact top-k inner products by block-at-a-time pruning.

A vector's components are its terms. Vectors are sorted by a similarity code (the signs of fixed random
projections), dealt into ranges in that order, and ranges into blocks; a block keeps the greatest and
least weight of every term and a forward index of its vectors. A query first meets the range that holds
itself, which gives a score that its k-th best cannot be below. Then batches of queries meet ranges, in
cells of bounded size; cells whose terms' greatest contributions sum to less than the least of those scores
are left out before anything is sent. In a cell each query orders the blocks by the sum of its terms' greatest
contributions, scores whole blocks through the forward index, and leaves those whose sum is below its
k-th score so far. The best of every range are merged.

How many blocks are left out depends on the vectors alone: where a query has no neighbours that are much
nearer than the rest, as with vectors spread evenly over a sphere of many dimensions, no bound from
maxima lies below its k-th score, and all blocks are scored (:func:`block_counts` tells).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.shared import add_columns, quoted, settle

RANGE_ROWS, BLOCK_ROWS, BATCH_ROWS = 8192, 128, 4096
#: Blocks that a query scores in its own order before the rest are taken block by block.
FIRST = 3
#: Signs in a similarity code.
CODE_BITS = 16
#: Summaries of batches are dealt to so many groups, each of which meets the summaries of all ranges.
SPREAD = 64
NONE = np.iinfo(np.int64).min


def similarity_code(vectors: list[np.ndarray]) -> np.ndarray:
    """The signs of CODE_BITS fixed random projections as one number; vectors with a small angle share most of them."""
    dims = max([1, *map(len, vectors)])
    planes = np.random.default_rng(11).normal(size=(dims, CODE_BITS))  # a longer vector adds rows, and changes none
    out = np.zeros(len(vectors), np.int64)
    lengths = np.array(list(map(len, vectors)))
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        if n:
            signs = np.array([vectors[i] for i in at], np.float64) @ planes[:n] > 0
            out[at] = signs @ (1 << np.arange(CODE_BITS))
    return out


def inner_products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer inner products; beyond 64 bits they stop at the ends of that range."""
    most = [int(np.abs(x.astype(float)).max()) if x.size else 0 for x in (queries, vectors)]
    if most[0] * most[1] * queries.shape[1] < 1 << 53:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    exact = queries.astype(object) @ vectors.astype(object).T
    return np.clip(exact, NONE + 1, -(NONE + 1)).astype(np.int64)


class Best:
    """Each query's best candidates so far, and its k-th score."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray | None = None):
        self.query_ids, self.queries, self.k = query_ids, queries, k
        self.kth = np.full(len(query_ids), NONE, np.int64) if least is None else least.copy()
        self.held = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def score(self, mine: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Score a block for the queries numbered ``mine``; the k best are kept, ties to the smaller id."""
        s = inner_products(self.queries[mine], vectors)
        s[ids[None] == self.query_ids[mine][:, None]] = NONE
        n = min(self.k, s.shape[1])
        least = np.maximum(np.partition(s, -n, axis=1)[:, -n], self.kth[mine])
        row, column = np.nonzero((s >= least[:, None]) & (s > NONE))
        if not len(row):
            return
        new = mine[row], ids[column], s[row, column]
        number, at, score = (np.concatenate(c) for c in zip(self.held, new, strict=True))
        order = np.lexsort((at, -score, number))
        number, at, score = number[order], at[order], score[order]
        place = np.arange(len(number)) - np.searchsorted(number, number)
        full = place == self.k - 1
        self.kth[number[full]] = np.maximum(self.kth[number[full]], score[full])
        keep = place < self.k
        self.held = number[keep], at[keep], score[keep]


def best_of_range(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, block_rows: int = BLOCK_ROWS, least: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Each query's k best vectors of a range, ties to the smaller id: query number, id, score; and the number of blocks scored.

    Blocks are runs of ``block_rows`` in the order given. Candidates below ``least``, by query, don't count.
    """
    cuts = list(range(0, len(ids), block_rows))
    blocks = [(ids[a : a + block_rows], vectors[a : a + block_rows]) for a in cuts]
    top = np.array([v.max(0) for _, v in blocks], np.float64)
    low = np.array([v.min(0) for _, v in blocks], np.float64)
    q = queries.astype(np.float64)
    bounds = np.maximum(q, 0) @ top.T + np.minimum(q, 0) @ low.T
    bounds += np.abs(bounds) * 1e-9  # what rounding can take
    sequence = np.argsort(-bounds, axis=1, kind="stable")
    best, everyone, scored = Best(query_ids, queries, k, least), np.arange(len(query_ids)), 0
    for step in range(min(FIRST, len(blocks))):
        block_of = sequence[:, step]
        active = np.flatnonzero(bounds[everyone, block_of] >= best.kth)
        for b in np.unique(block_of[active]).tolist():
            mine = active[block_of[active] == b]
            best.score(mine, *blocks[b])
            scored += len(mine)
    done = np.zeros(bounds.shape, bool)
    np.put_along_axis(done, sequence[:, :FIRST], True, axis=1)
    for b in np.argsort(-bounds.sum(0), kind="stable").tolist():
        mine = np.flatnonzero(~done[:, b] & (bounds[:, b] >= best.kth))
        if len(mine):
            best.score(mine, *blocks[b])
            scored += len(mine)
    return *best.held, scored


def packed_rows(df: DataFrame, rows: int, name: str, extra: str) -> DataFrame:
    """One row per run of ``rows`` rows of a partition of id, v and ``extra`` (a long): a number of its own, ids, extras and vectors packed.

    Vectors are packed with ``dims`` components (the longest vector's) of ``width`` bytes (what the greatest needs). With
    them go the least and greatest weight of every term (``span``) and the least extra.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, ids, more, vectors, n = TaskContext.get().partitionId() << 32, [], [], [], 0

        def done() -> pa.RecordBatch:
            dims = max(1, *map(len, vectors)) if vectors else 1
            matrix = np.zeros((len(vectors), dims), np.int64)
            for i, v in enumerate(vectors):
                matrix[i, : len(v)] = v
            most = max(abs(int(matrix.min())), abs(int(matrix.max())))
            width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
            made = [pa.array([x], pa.int64()) for x in (part + n, dims, width, min(more))]
            made += [pa.array([x.tobytes()], pa.binary()) for x in (np.array(ids, np.int64), np.array(more, np.int64), matrix.astype(f"i{width}"))]
            span = [{"low": float(a), "high": float(b)} for a, b in zip(matrix.min(0), matrix.max(0), strict=True)]
            made.append(pa.array([span], pa.list_(pa.struct([("low", pa.float64()), ("high", pa.float64())]))))
            return pa.RecordBatch.from_arrays(made, names=[name, "dims", "width", "least", "ids", "extras", "vectors", "span"])

        for batch in batches:
            for key, vector, x in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                ids.append(key)
                more.append(x)
                vectors.append(vector.values.to_numpy(zero_copy_only=False) if len(vector) else np.empty(0, np.int64))
                if len(ids) >= rows:
                    yield done()
                    ids, more, vectors, n = [], [], [], n + 1
        if ids:
            yield done()

    schema = f"{name} long, dims long, width long, least long, ids binary, extras binary, vectors binary, span array<struct<low: double, high: double>>"
    return settle(df.select("id", "v", extra).mapInArrow(run, schema))


def cells_of(batches: DataFrame, ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """batch and range of the cells that may hold a score that some query of the batch asks for; and their number with the others."""
    mine = batches.select("batch", "least", F.col("span").alias("own"), F.pmod(F.xxhash64("batch"), F.lit(SPREAD)).cast("int").alias("deal"))
    other = ranges.select("range", "span").withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    # a term that one side lacks counts as 0, as does a vector's missing component
    of = lambda x, end: F.coalesce(x[end], F.lit(0.0))
    most = F.zip_with("own", "span", lambda a, b: F.greatest(*[of(a, x) * of(b, y) for x in ("low", "high") for y in ("low", "high")]))
    bound = F.aggregate(most, F.lit(0.0), lambda a, x: a + x)
    cells = settle(mine.join(other, "deal").select("batch", "range", (bound + F.abs(bound) * 1e-9 >= F.col("least")).alias("met")))
    return cells.filter("met").drop("met"), cells.agg(F.count("*").alias("cells"), F.count_if("met").alias("cells_sent"))


def unpacked(row: dict, dims: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, extras and vectors of a pack, with zeros up to ``dims`` components."""
    matrix = np.frombuffer(row["vectors"], f"i{row['width']}").reshape(-1, row["dims"])
    matrix = np.pad(matrix, ((0, 0), (0, (dims or row["dims"]) - row["dims"])))
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["extras"], np.int64), matrix


def own_range_scores(documents: DataFrame, k: int) -> DataFrame:
    """id and least: what each query's k-th best score cannot be below, from the range that holds it; only where that range has k candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, asks, vectors = unpacked(row)
                at = np.flatnonzero(asks)
                if len(at) and len(ids) > k:
                    number, _, score, _ = best_of_range(ids[at], vectors[at], ids, vectors, k)
                    place = np.arange(len(number)) - np.searchsorted(number, number)
                    full = place == k - 1
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at][number[full]]), pa.array(score[full])], names=["id", "least"])

    return documents.select("dims", "width", "ids", "extras", "vectors").mapInArrow(run, "id long, least long")


def in_cells(
    df: DataFrame, is_query: Column, k: int, scale: int, id_col: str, vector_col: str, range_rows: int, batch_rows: int, work: Callable[..., list], schema: str
) -> DataFrame:
    """``work`` (query ids, queries, least scores, ids, vectors) for every batch of queries and every range of rows."""
    key, vector = F.col(quoted(id_col)), F.col(quoted(vector_col))
    fit = key.isNotNull() & vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    rows = df.filter(fit).select(key.cast("long").alias("id"), whole.alias("v"), F.coalesce(is_query, F.lit(False)).cast("long").alias("asks"))
    rows = rows.groupBy("id").agg(F.min("v").alias("v"), F.max("asks").alias("asks"))
    coded = lambda: lambda vectors: [similarity_code([x.values.to_numpy(zero_copy_only=False) for x in vectors])]
    rows = settle(add_columns(rows, ["v"], coded, [T.StructField("code", T.LongType())]))
    ranges = max(1, math.ceil(rows.count() / range_rows))
    by_code = rows.repartitionByRange(ranges, "code", "id").sortWithinPartitions("code", "id")
    documents = packed_rows(by_code, 2 * range_rows, "range", "asks")
    asked = rows.filter("asks = 1").select("id", "v", "code").join(own_range_scores(documents, k), "id", "left").withColumn("least", F.coalesce("least", F.lit(NONE)))
    n = rows.filter("asks = 1").count()
    batches = packed_rows(asked.repartitionByRange(max(1, math.ceil(n / batch_rows)), "code", "id"), 2 * batch_rows, "batch", "least")
    if batches.isEmpty():
        return df.sparkSession.createDataFrame([], schema)
    cells, _ = cells_of(batches, documents)
    of = lambda by, to: cells.groupBy(by).agg(F.collect_list(to).alias("to"))
    left = batches.drop("span").join(of("batch", "range"), "batch").withColumn("range", F.explode("to")).drop("to")
    right = documents.drop("span").join(of("range", "batch"), "range").withColumn("batch", F.explode("to")).drop("to")
    names = [c.split()[0] for c in schema.split(", ")]

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        out = [()] * len(names)
        if a.num_rows and b.num_rows:
            a, b = a.to_pylist()[0], b.to_pylist()[0]
            dims = max(a["dims"], b["dims"])
            query_ids, least, queries = unpacked(a, dims)
            ids, _, vectors = unpacked(b, dims)
            out = work(query_ids, queries, least, ids, vectors)
        return pa.table([pa.array(x, pa.int64()) for x in out], names=names)

    return left.groupBy("batch", "range").cogroup(right.groupBy("batch", "range")).applyInArrow(cell, schema)


def top_k(df: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", range_rows: int = RANGE_ROWS, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score: the k best rows of every row that ``is_query`` marks, by the integer inner product of floor(scale * x).

    A row is no candidate for its own id. Vectors that are null or hold a null or non-finite component,
    and rows without an id, take no part; missing components of a shorter vector count as 0. Repeated
    rows count once; of several vectors with one id, the least one counts. Fewer candidates than k give
    fewer rows; other columns aren't read.
    """

    def work(query_ids, queries, least, ids, vectors) -> list:
        number, at, score, _ = best_of_range(query_ids, queries, ids, vectors, k, least=least)
        return [query_ids[number], at, score]

    best = in_cells(df, is_query, k, scale, id_col, vector_col, range_rows, batch_rows, work, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def block_counts(df: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", range_rows: int = RANGE_ROWS, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """One row per cell: the pairs of a query and a block in it, and how many of them :func:`top_k` scores; the others are pruned."""

    def work(query_ids, queries, least, ids, vectors) -> list:
        *_, scored = best_of_range(query_ids, queries, ids, vectors, k, least=least)
        return [[len(query_ids) * math.ceil(len(ids) / BLOCK_ROWS)], [scored]]

    return in_cells(df, is_query, k, scale, id_col, vector_col, range_rows, batch_rows, work, "blocks long, scored long")
