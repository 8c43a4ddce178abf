"""Near-duplicate documents by circulant MinHash, with exact verification.

Two permutations of the 64-bit positions make all coordinates of a signature: the first scatters the
shingles of a document, the second orders the positions, and its k-th circular shift gives coordinate k:
the least second permutation of (position - k). Bands of coordinates give buckets of candidates.

Candidates are verified on their full shingle sets, in two steps. First every member of a bucket meets
the bucket's pivot only, which is linear in the members and connects a group of copies that hang
together. Then buckets whose members are still in several components are compared pair by pair, but for
pairs within a component, which add nothing. Components over all links are the result.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm import buckets as B
from larkspur.llm.components import components
from larkspur.llm.ngram_join import choose_bands
from larkspur.llm.shared import add_columns, quoted, settle

CACHED_WORDS = 200_000
PRIME = np.uint64(0x9E3779B97F4A7C15)


def scattered(x: np.ndarray, first: int, second: int) -> np.ndarray:
    """A permutation of all 64-bit numbers: shifts and multiplications by odd numbers, each of which can be undone."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(first | 1)
    x ^= x >> np.uint64(29)
    x *= np.uint64(second | 1)
    x ^= x >> np.uint64(32)
    return x


def positions(grams: np.ndarray) -> np.ndarray:
    """The first permutation: where a shingle lies on the circle."""
    return scattered(grams, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def ranks(places: np.ndarray) -> np.ndarray:
    """The second permutation: the order of the positions."""
    return scattered(places, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """One row per set, ``n`` coordinates; every set has a shingle. Coordinate k takes the second permutation shifted by k places."""
    out = np.zeros((len(sets), n), np.uint64)
    at = 0
    while at < len(sets):
        end, held = at, 0
        while end < len(sets) and (end == at or held + len(sets[end]) <= 32_768):  # what fits the processor's cache
            held += len(sets[end])
            end += 1
        places = positions(np.concatenate(sets[at:end]))
        starts = np.cumsum([0, *map(len, sets[at : end - 1])])
        for k in range(n):
            out[at:end, k] = np.minimum.reduceat(ranks(places - np.uint64(k)), starts)
        at = end
    return out


def band_hashes(signature: np.ndarray, rows: int) -> np.ndarray:
    """One column for each run of ``rows`` coordinates."""
    out = np.zeros((len(signature), signature.shape[1] // rows), np.uint64)
    for band in range(out.shape[1]):
        h = np.full(len(signature), band + 1, np.uint64)
        for k in range(rows):
            h = ranks((h ^ signature[:, band * rows + k]) * PRIME)
        out[:, band] = h
    return out


class Shingler:
    """Sets of runs of ``n`` words; words lie between ASCII white space, A-Z in lower case. Fewer words are one run, no words none."""

    def __init__(self, n: int):
        self.n, self.words = n, {}

    def ngrams(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes."""
        # of bytes, lower() and split() take ASCII letters and the white space 09 to 0D and 20 only
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        known = self.words
        if new := set(words).difference(known):
            if len(known) > CACHED_WORDS:
                known.clear()
                new = set(words)
            known.update((w, xxhash.xxh64_intdigest(w)) for w in new)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.n, len(h))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = (out ^ (out >> np.uint64(32))) * PRIME + h[i : len(h) - k + 1 + i]
        return np.unique(out)


@functools.cache
def shingler(n: int) -> Shingler:
    return Shingler(n)


def pivot_links(sets: DataFrame, met: DataFrame, threshold: float) -> DataFrame:
    """a and b: the members of a bucket (key, mark, size, pivot) that reach the similarity to the bucket's pivot.

    A pivot with many members meets them in several tasks, each with a copy of the pivot's set.
    """
    asked = met.select("key", "size", "pivot", (F.col("mark") == F.col("pivot")).alias("is_pivot")).distinct()
    parts = asked.groupBy("pivot").agg(B.blocks(F.count("*"), F.sum("size")).alias("parts"))
    lists = asked.join(parts, "pivot").groupBy("key").agg(F.collect_list(F.struct("pivot", "parts", "is_pivot")).alias("tasks"))
    own = F.pmod(F.xxhash64("key", "t.pivot"), F.col("t.parts")).cast("int")
    dealt = (
        sets.join(lists, "key")
        .select("key", "grams", F.explode("tasks").alias("t"))
        .select("key", "grams", "t.pivot", "t.is_pivot", F.explode(F.when(F.col("t.is_pivot"), F.sequence(F.lit(0), F.col("t.parts") - 1)).otherwise(F.array(own))).alias("part"))
    )

    def verify(group: pa.Table) -> pa.Table:
        first, links = group["is_pivot"].to_numpy(zero_copy_only=False), []
        grams, keys = [np.frombuffer(x.as_buffer(), np.uint64) for x in group["grams"]], group["key"].to_pylist()
        for p in np.flatnonzero(first):
            for i in np.flatnonzero(~first):
                small, large = sorted((len(grams[p]), len(grams[i])))
                if small >= (threshold - 1e-12) * large:
                    common = len(np.intersect1d(grams[p], grams[i], assume_unique=True))
                    if B.reaches(common, small + large - common, threshold):
                        links.append((keys[i], keys[p]))
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return settle(dealt.groupBy("pivot", "part").applyInArrow(verify, "a binary, b binary"))


def near_duplicates(
    df: DataFrame, n: int = 4, threshold: float = 0.8, recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text", most_hashes: int = 48
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``df``.

    n_shingles is the size of the text's shingle set, component_id the least id of the rows that links of
    at least the similarity connect (links are confirmed on the full sets; equal texts with words are
    linked), kept whether that is the row's own. A null or empty text, or one without words, has no
    shingles, is linked with nothing and is kept. Repeated rows are judged each, so they are kept alike; rows without an
    id are rows of their own: one has a null component_id where none of its component has an id, and is
    never kept but then. A pair just at the similarity is found with the probability ``recall``, more
    similar ones with a higher one. Other columns aren't read.
    """
    bands, rows = choose_bands(threshold, recall, most_hashes)
    names = [f"band_{k}" for k in range(bands)]
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    keyed = df.select(F.col(quoted(id_col)).alias("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("key"))

    def make():
        grams = shingler(n).ngrams

        def work(texts: pa.Array) -> list:
            sets = [grams(x.as_py()) for x in texts]
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            some = np.flatnonzero(sizes)
            out = np.zeros((len(sets), bands), np.int64)
            out[some] = band_hashes(signatures([sets[i] for i in some], bands * rows), rows).view(np.int64)
            return [pa.array(sizes), *(pa.array(out[:, k], mask=sizes == 0) for k in range(bands))]

        return work

    fields = [T.StructField(c, T.LongType()) for c in ("size", *names)]
    signed = settle(add_columns(keyed, ["text"], make, fields, keep=["doc_id", "key"]))
    nodes = signed.groupBy("key").agg(F.min("doc_id").alias("least_id"), F.max("size").alias("size"), *[F.max(c).alias(c) for c in names])
    nodes = settle(nodes.select("key", "least_id", "size", F.when(F.col(names[0]).isNotNull(), F.array(*names)).alias("bands")))
    members = B.members_of(nodes)
    met = settle(members.join(B.shared_buckets(members), ["band", "bucket"]))
    sets = B.gram_sets(keyed.select("key", "text"), met.select("key").distinct(), lambda: shingler(n).ngrams)
    links = pivot_links(sets, met, threshold)
    roots = settle(components(links))
    # what is left: buckets of more than two members that lie in several components
    part = F.xxhash64(F.coalesce("root", "key")).alias("part")
    placed = met.filter("n > 2").join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", "size", "band", "bucket", part)
    mixed = placed.groupBy("band", "bucket").agg((F.min("part") != F.max("part")).alias("open")).filter("open").select("band", "bucket")
    rest = settle(placed.join(mixed, ["band", "bucket"]))
    if not rest.isEmpty():
        parts = rest.select("key", "part").distinct()
        parted = sets.join(parts, "key").join(nodes.select("key", "bands"), "key")
        more = B.compared(parted, B.tasks_of(rest, threshold), threshold).select("a", "b")
        roots = settle(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)))
    grouped = nodes.select("key", "least_id", "size").join(roots.withColumnRenamed("node", "key"), "key", "left")
    grouped = grouped.select("key", "least_id", "root", (F.col("size") == 0).alias("alone"))
    least = grouped.filter("root is not null").groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = grouped.join(least, "root", "left").select("key", F.when(F.col("root").isNull(), F.col("least_id")).otherwise(F.col("component_id")).alias("component_id"), "alone")
    own = F.when(F.col("alone"), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    joined = signed.select("doc_id", "key", F.col("size").alias("n_shingles")).join(classes, "key").select("doc_id", "n_shingles", own)
    return joined.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
