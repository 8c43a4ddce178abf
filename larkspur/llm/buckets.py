"""Buckets of sets that share a band of hashes, and their exact comparison in tasks of bounded size.

A node is a distinct text with the set of its n-grams. Nodes that share a band meet in a bucket. Of
buckets with the same members one stays, so that a set is sent once to each different company it is in,
not once for each shared band. A large bucket is cut by the sizes of its sets: sizes that cannot reach
the similarity never meet, and what remains is cut into blocks, each pair of blocks a task of its own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.shared import settle, slices

#: A block holds about so many sets and n-grams.
BLOCK_ROWS, BLOCK_GRAMS = 2048, 4_000_000
SIDE = 1 << 32


def members_of(nodes: DataFrame) -> DataFrame:
    """key, mark (a hash of the key), size, band and bucket: one row for each band of a node (key, size, bands; null bands: no n-grams)."""
    return nodes.filter("bands is not null").select("key", F.xxhash64("key").alias("mark"), "size", F.posexplode("bands").alias("band", "bucket"))


def shared_buckets(members: DataFrame) -> DataFrame:
    """band, bucket, n and pivot (the least mark) of the buckets with two members at least; of those with the same members, the first.

    Buckets are told apart by their number of members and 128 bits made of all of them. A pair whose first
    shared bucket were left out would have met in an earlier one, so "first shared band" keeps its meaning.
    """
    mixed = [F.bit_xor(F.col("mark")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "key")).alias("y")]
    met = members.groupBy("band", "bucket").agg(F.count("*").alias("n"), F.min("mark").alias("pivot"), *mixed).filter("n > 1")
    return settle(met.groupBy("n", "pivot", "x", "y").agg(F.min(F.struct("band", "bucket")).alias("b")).select("b.band", "b.bucket", "n", "pivot"))


def blocks(n: Column, grams: Column) -> Column:
    return F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(grams / BLOCK_GRAMS)).cast("int")


def tasks_of(met: DataFrame, threshold: float) -> DataFrame:
    """key and tasks (band, bucket, low, high, side) of the members (key, size, band, bucket) of shared buckets.

    Sizes are told apart in levels, each 1 / threshold times the one before: sets of enough similarity lie
    in the same level or in two that follow each other. ``low`` and ``high`` are the sides that a task
    compares; a bucket that fits one block is one task.
    """
    level = F.floor(F.log("size") / (math.log(1 / threshold) + 1e-6)).cast("int")
    placed = met.withColumn("level", level)
    by_level = placed.groupBy("band", "bucket", "level").agg(F.count("*").alias("n"), F.sum("size").alias("grams"))
    cut = by_level.groupBy("band", "bucket").agg(
        blocks(F.sum("n"), F.sum("grams")).alias("all"), F.map_from_entries(F.collect_list(F.struct("level", blocks(F.col("n"), F.col("grams"))))).alias("blocks")
    )
    of = lambda k: F.try_element_at("blocks", F.col("level") + k)
    side = lambda k, block: (F.col("level") + k).cast("long") * SIDE + block
    own = side(0, F.pmod(F.xxhash64("key", "bucket"), of(0)))
    every = lambda k, f: F.transform(F.sequence(F.lit(0), of(k) - 1), lambda j: f(side(k, j)))
    task = lambda low, high: F.struct("band", "bucket", low.alias("low"), high.alias("high"), own.alias("side"))
    none = F.array().cast("array<struct<band:int,bucket:bigint,low:bigint,high:bigint,side:bigint>>")
    same = every(0, lambda x: task(F.least(own, x), F.greatest(own, x)))
    above = F.when(of(1).isNotNull(), every(1, lambda x: task(own, x))).otherwise(none)
    below = F.when(of(-1).isNotNull(), every(-1, lambda x: task(x, own))).otherwise(none)
    one = F.array(F.struct("band", "bucket", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"), F.lit(0).cast("long").alias("side")))
    dealt = placed.join(cut, ["band", "bucket"]).select("key", F.when(F.col("all") == 1, one).otherwise(F.concat(same, above, below)).alias("tasks"))
    return dealt.groupBy("key").agg(F.flatten(F.collect_list("tasks")).alias("tasks"))


def gram_sets(texts: DataFrame, keys: DataFrame, ngrams: Callable[[], Callable[[str], np.ndarray]]) -> DataFrame:
    """key and grams (sorted distinct 64-bit hashes) of the texts (key, text; copies count once) whose key is among ``keys``, settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = ngrams()
        for batch in (part for whole in batches for part in slices(whole)):
            packed = pa.array([of(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed], names=["key", "grams"])

    once = texts.groupBy("key").agg(F.first("text").alias("text"))  # texts of one key are equal
    return settle(once.join(keys, "key", "left_semi").select("key", "text").mapInArrow(run, "key binary, grams binary"))


def near_pairs(sets: list[np.ndarray], open_pair: np.ndarray, threshold: float, frequent: int = 32) -> np.ndarray:
    """Pairs (i, j) that ``open_pair`` marks and whose sets have at least the threshold's Jaccard similarity, as an array of two columns.

    N-grams in at least ``frequent`` of the sets are counted by matrix products, the others pair by pair.
    """
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int32, n)
    low, high = np.minimum(sizes[:, None], sizes[None]), np.maximum(sizes[:, None], sizes[None])
    open_pair = open_pair & (low >= (threshold - 1e-12) * high)
    del low, high
    left, right = np.nonzero(open_pair)
    if len(left) <= max(64, n):  # few pairs: one by one
        keep = []
        for i, j in zip(left.tolist(), right.tolist(), strict=True):
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            keep.append(reaches(common, int(sizes[i]) + int(sizes[j]) - common, threshold))
        keep = np.array(keep, bool)
        return np.column_stack([left[keep], right[keep]])
    owner = np.repeat(np.arange(n), sizes)
    _, gram, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.zeros((n, n), np.float32)
    often = np.flatnonzero(count >= frequent)
    column = np.full(len(count), -1)
    column[often] = np.arange(len(often))
    for start in range(0, len(often), 4096):
        inside = (column[gram] >= start) & (column[gram] < start + 4096)
        part = np.zeros((n, min(4096, len(often) - start)), np.float32)
        part[owner[inside], column[gram[inside]] - start] = 1
        common += part @ part.T
    order = np.argsort(gram, kind="stable")
    by_gram, first = owner[order], np.concatenate([[0], np.cumsum(count)[:-1]])
    flat = common.reshape(-1)
    for d in range(2, frequent):
        if len(at := first[count == d]):
            held = by_gram[at[:, None] + np.arange(d)]
            for x in range(d):
                for y in range(d):
                    if x != y:
                        np.add.at(flat, held[:, x] * n + held[:, y], 1)
    both = common[left, right].astype(np.float64)
    keep = reaches(both, sizes[left].astype(np.int64) + sizes[right] - both, threshold)
    return np.column_stack([left[keep], right[keep]])


def reaches(common, union, threshold: float):
    """common / union >= threshold; a threshold of whole hundredths is compared in whole numbers."""
    hundredths = round(threshold * 100)
    if abs(threshold * 100 - hundredths) < 1e-9:
        return (union > 0) & (100 * common >= hundredths * union)
    return (union > 0) & (common >= threshold * union)


def linked_members(keys: list[bytes], pairs: np.ndarray) -> list[tuple[bytes, int, bytes]]:
    """(key, links, key of the least linked member) of the members on a pair."""
    n = len(keys)
    links, root = np.bincount(pairs.ravel(), minlength=n), list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in pairs.tolist():
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [(keys[i], int(links[i]), keys[find(i)]) for i in np.flatnonzero(links)]


def compare(sets: list[np.ndarray], bands: np.ndarray, band: int, side: np.ndarray, threshold: float, apart: np.ndarray | None = None) -> np.ndarray:
    """Pairs of enough similarity that share no earlier band: between the two sides, or within the only one; with ``apart``, of different values of it."""
    n = len(sets)
    open_pair = np.triu(np.ones((n, n), bool), 1)
    if (side != side[0]).any():
        open_pair &= side[:, None] != side[None]
    if apart is not None:
        open_pair &= apart[:, None] != apart[None]
    for earlier in range(band):
        open_pair &= bands[:, None, earlier] != bands[None, :, earlier]
    return near_pairs(sets, open_pair, threshold)


def compared(sets: DataFrame, tasks: DataFrame, threshold: float) -> DataFrame:
    """a, links and b of all tasks: how many pairs a member has that are first met in a task, and the least member of its group there.

    ``sets`` holds key, grams and bands, and may hold ``part``: members of one part aren't compared.
    """
    if "part" not in sets.columns:
        sets = sets.withColumn("part", F.lit(None).cast("long"))

    def verify(group: pa.Table) -> pa.Table:
        found: list[tuple[bytes, int, bytes]] = []
        side, low, high = group["side"].to_numpy(), group["low"][0].as_py(), group["high"][0].as_py()
        if group.num_rows > 1 and (low == high or len(np.unique(side)) == 2):
            group = group.sort_by("key")
            part = group["part"]
            apart = None if part.null_count else part.to_numpy()
            signs = np.stack([x.values.to_numpy() for x in group["bands"]])
            grams = [np.frombuffer(x.as_buffer(), np.uint64) for x in group["grams"]]
            found = linked_members(group["key"].to_pylist(), compare(grams, signs, group["band"][0].as_py(), group["side"].to_numpy(), threshold, apart))
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.binary()), strict=True)], names=["a", "links", "b"])

    dealt = sets.join(tasks, "key").select("key", "grams", "bands", "part", F.explode("tasks").alias("t")).select("key", "grams", "bands", "part", "t.*")
    return settle(dealt.groupBy("band", "bucket", "low", "high").applyInArrow(verify, "a binary, links long, b binary"))
