"""Hard-negative mining with a pivot table.

Every row x gets one more component, sqrt(M - |x|^2), where M is the greatest squared length; an anchor q
gets a zero. Then |q - x|^2 = |q|^2 + M - 2 q.x, so that high inner products are small distances. The
table stores the distances of each row to a few pivots. By the triangle inequality the anchor's
distance to a row lies between the greatest difference and the least sum of their distances to a pivot,
which brackets the score: for a batch of anchors and a range of rows before anything is sent, for an
anchor and a block, and for an anchor and a row. Exact inner products decide what the brackets leave.

Two searches are made: an anchor's positives among the rows of its label, and, for each positive, the
negatives among the others whose scores lie in a window that follows from the positive's score. In each, batches first
meet the range that promises most, so that k-th scores are known when the other cells are dealt.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.shared import quoted, settle
from larkspur.llm.topk import NONE, inner_products

PIVOTS = 16
#: Rows, by the hash of their id, of which the pivots are chosen.
SAMPLE = 512
RANGE_ROWS, BLOCK_ROWS, BATCH_ROWS = 8192, 128, 2048
#: Summaries of batches are dealt to so many groups, each of which meets all summaries of ranges.
SPREAD = 64
MOST = np.iinfo(np.int64).max


def padded(vectors: list[np.ndarray], dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def augmented(vectors: np.ndarray, most: float) -> np.ndarray:
    """Rows with their last component: all are as long as the longest."""
    x = vectors.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(0, most - (x * x).sum(1)))])


def farthest_first(points: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` different points, each the farthest from those before it."""
    chosen, away = [0], np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < n and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, np.linalg.norm(points - points[chosen[-1]], axis=1))
    return points[chosen]


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """From differences, so that small distances lose no digits."""
    return np.column_stack([np.sqrt(((points - p) ** 2).sum(1)) for p in pivots])


class Windows:
    """For each anchor and slot the k best rows so far among those with scores from low to high, ties to the smaller id."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low.copy(), high, k
        self.held = tuple(np.empty(0, np.int64) for _ in range(3))

    @property
    def least(self) -> np.ndarray:
        """No score below counts for the anchor any more; MOST where it has no window."""
        return np.where(self.low <= self.high, self.low, MOST).min(1)

    @property
    def greatest(self) -> np.ndarray:
        return np.where(self.low <= self.high, self.high, NONE).max(1)

    def add(self, anchor: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        slots = self.low.shape[1]
        pair, slot = np.nonzero((score[:, None] >= self.low[anchor]) & (score[:, None] <= self.high[anchor]))
        if not len(pair):
            return
        new = anchor[pair] * slots + slot, ids[pair], score[pair]
        place, at, score = (np.concatenate(c) for c in zip(self.held, new, strict=True))
        order = np.lexsort((at, -score, place))
        place, at, score = place[order], at[order], score[order]
        nth = np.arange(len(place)) - np.searchsorted(place, place)
        full = nth == self.k - 1
        np.maximum.at(self.low.reshape(-1), place[full], score[full])  # ties with the k-th can still win by id
        keep = nth < self.k
        self.held = place[keep], at[keep], score[keep]


def bracketed(anchors: dict, rows: dict, windows: Windows, most: float, block_rows: int = BLOCK_ROWS) -> tuple[int, int]:
    """Fill the windows from a range of rows; the number of pairs of an anchor and a row, and how many the brackets left to be checked.

    ``anchors`` and ``rows`` hold ids, vectors and dists (to the pivots). A row is no candidate for its own id.
    """
    q, dq, v, d, ids = anchors["vectors"], anchors["dists"], rows["vectors"], rows["dists"], rows["ids"]
    length = (q.astype(np.float64) ** 2).sum(1)
    slack = (length.max(initial=0) + most) * 1e-9
    starts = np.arange(0, len(ids), block_rows)
    low, high = np.minimum.reduceat(d, starts), np.maximum.reduceat(d, starts)
    gap, reach = np.zeros((len(q), len(starts))), np.full((len(q), len(starts)), np.inf)
    for j in range(d.shape[1]):
        mine = dq[:, j, None]
        np.maximum(gap, np.maximum(low[None, :, j] - mine, mine - high[None, :, j]), out=gap)
        np.minimum(reach, mine + high[None, :, j], out=reach)
    above = (length[:, None] + most - gap**2) / 2 + slack
    below = (length[:, None] + most - reach**2) / 2 - slack
    checked = 0
    for b in np.argsort(-above.sum(0), kind="stable").tolist():
        least, greatest = windows.least, windows.greatest
        mine = np.flatnonzero((above[:, b] >= least) & (below[:, b] <= greatest))
        if not len(mine):
            continue
        part = slice(starts[b], min(starts[b] + block_rows, len(ids)))
        near, far = np.zeros((len(mine), part.stop - part.start)), np.full((len(mine), part.stop - part.start), np.inf)
        for j in range(d.shape[1]):
            own = dq[mine, j, None]
            np.maximum(near, np.abs(own - d[part, j][None]), out=near)
            np.minimum(far, own + d[part, j][None], out=far)
        size = length[mine, None] + most
        open_pair = ((size - near**2) / 2 + slack >= least[mine, None]) & ((size - far**2) / 2 - slack <= greatest[mine, None])
        open_pair &= ids[None, part] != anchors["ids"][mine, None]
        row, column = np.nonzero(open_pair)
        checked += len(row)
        if not len(row):
            continue
        own, other = np.unique(row), np.unique(column)
        score = inner_products(q[mine[own]], v[part][other])[np.searchsorted(own, row), np.searchsorted(other, column)]
        windows.add(mine[row], ids[part][column], score)
    return len(q) * len(ids), checked


def packs(df: DataFrame, rows: int, vectors: str, dists: str) -> DataFrame:
    """Runs of at most ``rows`` rows of one label and partition, packed: number, label, dims, ids, vectors, dists, and the span of the distances to each pivot.

    ``df`` holds id, label and the two columns named; it is sorted within its partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, n, held, of = TaskContext.get().partitionId() << 32, 0, [], None

        def done() -> pa.RecordBatch:
            d = np.array([x[2] for x in held], np.float64)
            dims = max(1, *(len(x[1]) for x in held))
            span = [{"low": a, "high": b} for a, b in zip(d.min(0).tolist(), d.max(0).tolist(), strict=True)]
            length = [float((x[1].astype(np.float64) ** 2).sum()) for x in held]
            values = [first + n, of, dims, np.array([x[0] for x in held], np.int64).tobytes(), padded([x[1] for x in held], dims).tobytes(), d.tobytes(), span, min(length), max(length)]
            types = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.struct([("low", pa.float64()), ("high", pa.float64())])), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, types, strict=True)], names=names)

        for batch in batches:
            for key, label, v, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if held and (label != of or len(held) >= rows):
                    yield done()
                    held, n = [], n + 1
                of = label
                held.append((key, v.values.to_numpy(zero_copy_only=False) if len(v) else np.empty(0, np.int64), d.values.to_numpy()))
        if held:
            yield done()

    schema = "number long, label string, dims long, ids binary, vectors binary, dists binary, span array<struct<low: double, high: double>>, shortest double, longest double"
    names = [c.split()[0] for c in schema.split(", ") if not c.startswith("high")]
    return settle(df.select("id", "label", vectors, dists).mapInArrow(run, schema))


def unpacked(row: dict, dims: int) -> dict:
    ids = np.frombuffer(row["ids"], np.int64)
    vectors = np.frombuffer(row["vectors"], np.int64).reshape(len(ids), row["dims"])
    return {"ids": ids, "vectors": np.pad(vectors, ((0, 0), (0, dims - row["dims"]))), "dists": np.frombuffer(row["dists"], np.float64).reshape(len(ids), -1)}


def run_cells(batches: DataFrame, ranges: DataFrame, cells: DataFrame, windows: DataFrame, k: int, slots: int, most: float) -> DataFrame:
    """anchor, slot, vec_id and score: each window's k best of every cell (batch, range); in each cell one row without an anchor
    has the number of pairs as vec_id and the number of those checked as score.

    ``windows`` holds batch, anchor, slot (from 0), low and high.
    """
    asked = windows.groupBy("batch").agg(F.collect_list(F.struct("anchor", "slot", "low", "high")).alias("windows"))
    of = lambda by, to: cells.groupBy(by).agg(F.collect_list(to).alias("to"))
    left = batches.withColumnRenamed("number", "batch").join(asked, "batch").join(of("batch", "range"), "batch").withColumn("range", F.explode("to")).drop("to", "span")
    right = ranges.withColumnRenamed("number", "range").join(of("range", "batch"), "range").withColumn("batch", F.explode("to")).drop("to", "span")

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        out = [()] * 4
        if a.num_rows and b.num_rows:
            asked, a, b = a["windows"].combine_chunks().values, a.drop_columns("windows").to_pylist()[0], b.to_pylist()[0]
            dims = max(a["dims"], b["dims"])
            anchors, rows = unpacked(a, dims), unpacked(b, dims)
            low, high = np.full((len(anchors["ids"]), slots), MOST), np.full((len(anchors["ids"]), slots), NONE)
            order = np.argsort(anchors["ids"])
            at = order[np.searchsorted(anchors["ids"], asked.field("anchor").to_numpy(), sorter=order)], asked.field("slot").to_numpy()
            low[at], high[at] = asked.field("low").to_numpy(), asked.field("high").to_numpy()
            found = Windows(low, high, k)
            pairs, checked = bracketed(anchors, rows, found, most)
            place, ids, score = found.held
            out = [*(pa.array(x) for x in (anchors["ids"][place // slots], place % slots, ids, score))]
            out = [pa.concat_arrays([x, pa.array([y], pa.int64())]) for x, y in zip(out, (None, None, pairs, checked), strict=True)]
        return pa.table([pa.array(x, pa.int64()) for x in out], names=["anchor", "slot", "vec_id", "score"])

    return left.groupBy("batch", "range").cogroup(right.groupBy("batch", "range")).applyInArrow(cell, "anchor long, slot long, vec_id long, score long")


def best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id"))
    return found.filter("anchor is not null").withColumn("rank", rank).filter(F.col("rank") <= k)


def search(batches: DataFrame, ranges: DataFrame, windows: DataFrame, same: bool, k: int, slots: int, most: float) -> tuple[DataFrame, Callable[[], dict]]:
    """anchor, slot, rank, vec_id and score: the k best rows of every window, of the anchor's label or of the others; and the counts of the work done.

    Before anything is sent, the spans of distances bracket the scores of a whole cell. Each batch meets the
    range with the highest bound first; then cells that cannot hold a score of any of its windows, or none above the k-th, are left out.
    """
    dealt = F.pmod(F.xxhash64("number"), F.lit(SPREAD)).cast("int")
    mine = batches.select(F.col("number").alias("batch"), F.col("label").alias("of"), F.col("span").alias("own"), "shortest", "longest", dealt.alias("deal"))
    other = ranges.select(F.col("number").alias("range"), "label", "span").withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    gap = F.greatest(F.lit(0.0), F.array_max(F.zip_with("own", "span", lambda a, b: F.greatest(b["low"] - a["high"], a["low"] - b["high"]))))
    reach = F.array_min(F.zip_with("own", "span", lambda a, b: a["high"] + b["high"]))
    slack = (F.col("longest") + most) * 1e-9
    above, below = (F.col("longest") + most - gap * gap) / 2 + slack, (F.col("shortest") + most - reach * reach) / 2 - slack
    fit = F.col("label") == F.col("of") if same else F.col("label") != F.col("of")

    def limits(w: DataFrame) -> DataFrame:
        return w.filter("low <= high").groupBy("batch").agg(F.min("low").alias("least"), F.max("high").alias("greatest"))

    cells = mine.join(limits(windows), "batch").join(other, "deal").filter(fit).select("batch", "range", above.alias("above"), below.alias("below"), "least", "greatest")
    cells = settle(cells.withColumn("met", (F.col("above") >= F.col("least")) & (F.col("below") <= F.col("greatest"))))
    nth = F.row_number().over(Window.partitionBy("batch").orderBy(F.desc("above"), "range"))
    first = settle(cells.filter("met").withColumn("nth", nth).filter("nth = 1").select("batch", "range"))
    found = settle(run_cells(batches, ranges, first, windows, k, slots, most))
    kth = best(found, k).filter(F.col("rank") == k).select("anchor", "slot", F.col("score").alias("kth"))
    raised = settle(windows.join(kth, ["anchor", "slot"], "left").withColumn("low", F.greatest("low", F.coalesce("kth", F.lit(NONE)))).drop("kth"))
    rest = cells.drop("least", "greatest").join(limits(raised), "batch").filter((F.col("above") >= F.col("least")) & (F.col("below") <= F.col("greatest")))
    rest = settle(rest.join(first, ["batch", "range"], "left_anti").select("batch", "range"))
    found = settle(found.unionByName(run_cells(batches, ranges, rest, raised, k, slots, most)))

    def counts() -> dict:
        """What the brackets did, in cells and in pairs of an anchor and a row."""
        pairs = found.filter("anchor is null").agg(F.sum("vec_id").alias("pairs_sent"), F.sum("score").alias("pairs_checked")).first().asDict()
        return {"cells": cells.count(), "cells_sent": first.count() + rest.count(), **pairs}

    return best(found, k), counts


def mined(
    df: DataFrame,
    is_anchor: Column,
    label: Column,
    positives: int,
    negatives: int,
    low_percent: int,
    high_percent: int,
    scale: int,
    id_col: str,
    vector_col: str,
    range_rows: int,
    batch_rows: int,
) -> tuple[DataFrame, list[Callable[[], dict]]]:
    key, vector = F.col(quoted(id_col)), F.col(quoted(vector_col))
    fit = key.isNotNull() & label.isNotNull() & vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    rows = df.filter(fit).select(key.cast("long").alias("id"), label.cast("string").alias("label"), whole.alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("x"), F.max("asks").alias("asks")).select("id", "x.label", "x.v", "asks")
    rows = settle(rows.withColumn("length", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))
    size = rows.agg(F.max("length").alias("most"), F.max(F.size("v")).alias("dims"), F.count("*").alias("n"), F.count_if("asks").alias("asks")).first()
    if not size["n"] or not size["asks"]:
        return df.sparkSession.createDataFrame([], "anchor long, positive_id long, rank int, vec_id long, positive_score long, score long"), []
    most, dims = size["most"], max(1, size["dims"])
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()["v"]
    pivots = farthest_first(augmented(padded([x.values.to_numpy(zero_copy_only=False) if len(x) else np.empty(0, np.int64) for x in sample], dims), most), PIVOTS)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = padded([v.values.to_numpy(zero_copy_only=False) if len(v) else np.empty(0, np.int64) for v in batch.column(2)], dims)
            asks = batch.column(3).to_numpy(zero_copy_only=False)
            d = distances(augmented(x, most), pivots)
            own = iter(distances(np.column_stack([x[asks], np.zeros(int(asks.sum()))]), pivots))  # an anchor's last component is 0
            columns = [*batch.columns[:4], pa.array(list(d)), pa.array([next(own) if a else None for a in asks], pa.list_(pa.float64())), pa.array(d.argmin(1), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "v", "asks", "d", "dq", "near"])

    table = settle(rows.select("id", "label", "v", "asks").mapInArrow(measure, "id long, label string, v array<long>, asks boolean, d array<double>, dq array<double>, near long"))
    # rows that are near the same pivot, at about the same distance, stand together
    order = ["label", "near", F.element_at("d", (F.col("near") + 1).cast("int")), "id"]
    parts = lambda n, each: max(1, math.ceil(n / each))
    ranges = packs(table.repartitionByRange(parts(size["n"], range_rows), *order).sortWithinPartitions(*order), 2 * range_rows, "v", "d")
    anchors = table.filter("asks")
    batches = packs(anchors.repartitionByRange(parts(size["asks"], batch_rows), *order).sortWithinPartitions(*order), 2 * batch_rows, "v", "dq")
    dealt = settle(batches.select(F.col("number").alias("batch"), "ids").mapInArrow(ids_of, "batch long, anchor long"))
    all_scores = dealt.withColumns({"slot": F.lit(0).cast("long"), "low": F.lit(NONE + 1), "high": F.lit(int(MOST - 1))})
    near, first_counts = search(batches, ranges, all_scores, True, positives, 1, most)
    near = settle(near.select("anchor", (F.col("rank") - 1).cast("long").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    score = F.col("positive_score").cast("decimal(20,0)")
    bound = lambda c, p: c(score * F.lit(p) / F.lit(100)).cast("long")
    windows = settle(dealt.join(near, "anchor").select("batch", "anchor", "slot", bound(F.ceil, low_percent).alias("low"), bound(F.floor, high_percent).alias("high")).filter("low <= high"))
    hard, second_counts = search(batches, ranges, windows, False, negatives, positives, most)
    return hard.join(near, ["anchor", "slot"]).select("anchor", "positive_id", "rank", "vec_id", "positive_score", "score"), [first_counts, second_counts]


def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.frombuffer(ids, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), number)), pa.array(own)], names=["batch", "anchor"])


def hard_negatives(
    df: DataFrame,
    is_anchor: Column,
    label: Column,
    positives: int = 5,
    negatives: int = 10,
    low_percent: int = 30,
    high_percent: int = 90,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    range_rows: int = RANGE_ROWS,
    batch_rows: int = BATCH_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for every row that ``is_anchor`` marks.

    A score is the integer inner product of floor(scale * x). Positives are the best other rows of the
    anchor's label; for each, the best rows of other labels follow whose score is from ``low_percent`` to
    ``high_percent`` hundredths of the positive's; all in order of score, ties to the smaller id. No
    negative score qualifies for a negative positive score. Rows with a null id, label or vector, or a null or
    non-finite component, take no part; missing components of a shorter vector count as 0. Of several rows with
    one id the least (label as text, then vector) counts. Empty tables and anchors without positives or negatives give no rows; other columns aren't read.
    """
    found, _ = mined(df, is_anchor, label, positives, negatives, low_percent, high_percent, scale, id_col, vector_col, range_rows, batch_rows)
    names = {"anchor": "anchor_id", "vec_id": "negative_id", "score": "negative_score"}
    return found.withColumnsRenamed(names).withColumn("rank", F.col("rank").cast("int")).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def bracket_counts(df: DataFrame, is_anchor: Column, label: Column, range_rows: int = RANGE_ROWS, batch_rows: int = BATCH_ROWS, **options) -> list[dict]:
    """For the search of positives and that of negatives: cells, cells_sent, pairs_sent and pairs_checked."""
    usual = {"positives": 5, "negatives": 10, "low_percent": 30, "high_percent": 90, "scale": 256, "id_col": "vec_id", "vector_col": "embedding"} | options
    _, counts = mined(df, is_anchor, label, **usual, range_rows=range_rows, batch_rows=batch_rows)
    return [c() for c in counts]
