"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets decide.

A node is a distinct text; copies are counted, not compared. Its n-gram set is hashed to bands of
MinHash rows, whose number follows from the threshold and the recall wanted at it. Nodes that share a
band meet in a bucket (:mod:`larkspur.llm.buckets`), to which their n-gram sets are sent. A bucket is
compared as a whole by counting common n-grams, a large one in blocks, each pair of blocks a task of
its own; pairs are counted where they meet first and never written out. What leaves a bucket is, for
each of its nodes, a number of links and one edge of a spanning star, so the output is linear in the
members. Classes are the connected components.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm import buckets as B
from larkspur.llm.components import components
from larkspur.llm.shared import add_columns, fresh, quoted, settle

CACHED_WORDS = 200_000
PRIME = np.uint64(0x9E3779B97F4A7C15)


def choose_bands(threshold: float, recall: float, most: int = 48) -> tuple[int, int]:
    """Bands and rows: the most rows for which ``bands * rows`` MinHashes, at most ``most``, give the recall at the threshold; an error if none do."""
    best = None
    for rows in range(1, most + 1):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log1p(-recall) / math.log1p(-p)) if p > 0 else math.inf
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError(f"{most} MinHashes don't give a recall of {recall} at a similarity of {threshold}; allow more")
    return best


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Shingler:
    """n-gram sets of texts: words between white space, as they stand; fewer than n words are one n-gram."""

    def __init__(self, n: int):
        self.n, self.words = n, {}

    def ngrams(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes; none for a text without words."""
        words = text.split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        known = self.words
        if new := set(words).difference(known):
            if len(known) > CACHED_WORDS:
                known.clear()
                new = set(words)
            known.update((w, xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))) for w in new)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.n, len(h))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = out * PRIME + h[i : len(h) - k + 1 + i]
        return np.unique(mixed(out))


@functools.cache
def shingler(n: int) -> Shingler:
    return Shingler(n)


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """One row per set, one column per band. Every set has an n-gram."""
    seeds = mixed(np.arange(1, bands * rows + 1, dtype=np.uint64) * PRIME)
    out = np.zeros((len(sets), bands), np.uint64)
    at = 0
    while at < len(sets):
        end, held = at, 0
        while end < len(sets) and (end == at or held + len(sets[end]) <= 65_536):  # what fits the processor's cache
            held += len(sets[end])
            end += 1
        flat = np.concatenate(sets[at:end])
        starts = np.cumsum([0, *map(len, sets[at : end - 1])])
        for k in range(bands * rows):
            least = np.minimum.reduceat((flat ^ seeds[k]) * (seeds[-k - 1] | np.uint64(1)), starts)
            band = k // rows
            out[at:end, band] = mixed((out[at:end, band] + least + np.uint64(band)) * PRIME)
        at = end
    return out


def ngram_join(
    df: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.995, id_col: str = "doc_id", text_col: str = "text", most_hashes: int = 48
) -> DataFrame:
    """Links and classes of near-equal texts; one row per row of ``df``.

    Columns: doc_id, text_key (MD5 of the text), class_id (the least doc_id of its class), n_copies
    (rows with the same text), n_links (other texts of at least the similarity), keep (one row of each
    class: its least doc_id, nulls last, then the least text_key). Rows with equal doc_id and text are
    alike in all columns. A null text is an empty one; texts without words are linked with nothing
    and form classes of equal texts. Classes are connected components, so members may be less
    similar than the threshold. Other columns aren't read. Pairs just at the threshold are found with
    the probability ``recall``, more similar ones with a higher one.
    """
    bands, rows = choose_bands(threshold, recall, most_hashes)
    names = [f"band_{k}" for k in range(bands)]
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    keyed = df.select(F.col(quoted(id_col)).alias("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("text_key"))

    def make():
        grams = shingler(n).ngrams

        def work(texts: pa.Array) -> list:
            sets = [grams(x.as_py()) for x in texts]
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            some = np.flatnonzero(sizes)
            out = np.zeros((len(sets), bands), np.int64)
            out[some] = band_hashes([sets[i] for i in some], bands, rows).view(np.int64)
            return [pa.array(sizes), *(pa.array(out[:, k], mask=sizes == 0) for k in range(bands))]

        return work

    fields = [T.StructField(c, T.LongType()) for c in ("size", *names)]
    signed = settle(add_columns(keyed, ["text"], make, fields, keep=["doc_id", "text_key"]))
    nodes = signed.groupBy("text_key").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n_copies"), F.max("size").alias("size"), *[F.max(c).alias(c) for c in names])
    nodes = settle(nodes.select("text_key", "least_id", "n_copies", "size", F.when(F.col(names[0]).isNotNull(), F.array(*names)).alias("bands")))
    members = B.members_of(nodes.withColumnRenamed("text_key", "key"))
    met = settle(members.join(B.shared_buckets(members), ["band", "bucket"]).select("key", "size", "band", "bucket"))
    # texts travel once, by their key; what is compared are the sets
    sets = B.gram_sets(keyed.select(F.col("text_key").alias("key"), "text"), met.select("key").distinct(), lambda: shingler(n).ngrams)
    linked = B.compared(sets.join(nodes.select(F.col("text_key").alias("key"), "bands"), "key"), B.tasks_of(met, threshold), threshold)
    counted = linked.groupBy(F.col("a").alias("text_key")).agg(F.sum("links").alias("n_links"))
    roots = components(linked.select("a", "b"))
    order = F.struct(F.col("least_id").isNull().alias("none"), "least_id", "text_key")
    grouped = nodes.select("text_key", "least_id", "n_copies").join(roots.withColumnRenamed("node", "text_key"), "text_key", "left")
    grouped = settle(grouped.join(counted, "text_key", "left").withColumn("root", F.coalesce("root", "text_key")))
    best = settle(grouped.groupBy("root").agg(F.min(order).alias("best")))
    classes = settle(
        grouped.join(best, "root").select(
            "text_key", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("best.least_id").alias("class_id"), F.col("best.text_key").alias("best_key")
        )
    )
    return signed.select("doc_id", "text_key").join(classes, "text_key").select(
        "doc_id",
        "text_key",
        "class_id",
        "n_copies",
        "n_links",
        ((F.col("text_key") == F.col("best_key")) & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("keep"),
    )


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of every class of :func:`ngram_join`, with the columns of ``df`` as they are; of repeated rows, one stays."""
    joined = ngram_join(df, id_col=id_col, text_col=text_col, **options).filter("keep").groupBy("doc_id", "text_key").agg(F.count("*").alias("rows"))
    # names that no column of df has, so that any table can be joined
    key, kept_id, kept_key = (fresh(df.columns, f"kept_{x}") for x in ("key", "doc", "text"))
    joined = settle(joined.select(F.col("doc_id").alias(kept_id), F.col("text_key").alias(kept_key), "rows"))
    keyed = df.withColumn(key, F.unhex(F.md5(F.coalesce(F.col(quoted(text_col)), F.lit("")))))
    rows = keyed.join(joined.select(kept_id, kept_key), (F.col(key) == F.col(kept_key)) & F.col(quoted(id_col)).eqNullSafe(F.col(kept_id)), "left_semi")
    if joined.filter("rows > 1").isEmpty():
        return rows.drop(key)
    firsts = rows.groupBy(F.col(quoted(id_col)).alias(kept_id), F.col(key).alias(kept_key)).agg(F.first(F.struct(*map(quoted, df.columns))).alias(key))
    return firsts.select(*[F.col(key).getField(c).alias(c) for c in df.columns])
