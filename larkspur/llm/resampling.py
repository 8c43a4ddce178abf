"""Importance resampling of documents towards a target distribution of hashed word features.

Words and feature hashes come straight from the UTF-8 bytes of an Arrow column, all texts of a batch at
once: a lookup table classifies every byte, differences of the classes are the word boundaries, and a
table-driven CRC-32 advances over all features by one byte at a time. The counts of both sides are sums
of a fixed number of buckets; a document's weight is the sum of its features' log ratios, and
Gumbel noise from a hash of its id makes the highest scores a draw without replacement.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.shared import add_columns, quoted, settle, slices

BUCKETS = 10_000
#: Features of more bytes are hashed one by one.
LONG = 96
#: Bytes of a batch that are taken at once; each takes a few numbers meanwhile.
AT_ONCE = 1 << 20


def word_bytes() -> np.ndarray:
    """Whether a byte belongs to a word: digits, letters, and all bytes of characters beyond ASCII."""
    out = np.zeros(256, bool)
    for first, last in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
        out[first : last + 1] = True
    return out


def lower_bytes() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[0x41:0x5B] += 0x20
    return out


def crc_steps(polynomial: int = 0xEDB88320) -> np.ndarray:
    """What a byte does to the CRC-32: its remainder by the (reflected) polynomial."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(polynomial), out >> 1)
    return out


WORD, LOWER, STEP = word_bytes(), lower_bytes(), crc_steps()


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins and the last ends. A null is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    return held, at - at[0]


def word_ranges(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of its text."""
    inside = WORD[data]
    first = np.zeros(len(data) + 1, bool)
    first[at[:-1]] = True  # a text's first byte follows no byte
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (first[:-1] | ~before))
    ends = np.flatnonzero(inside & (first[1:] | ~after)) + 1
    return starts, ends, np.searchsorted(at, starts, side="right") - 1


def crc32_of(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of all ranges at once: step k takes byte k of every range that has one."""
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    long = int(np.searchsorted(-lengths, -LONG))  # these come first
    n_with = np.searchsorted(-lengths[long:], -np.arange(int(lengths[long]) if long < len(lengths) else 0))  # ranges longer than k
    own, at = crc[long:], starts[long:]
    for k, n in enumerate(n_with.tolist()):
        now = own[:n]
        own[:n] = STEP[(now ^ data[at[:n] + k]) & np.uint32(0xFF)] ^ (now >> np.uint32(8))
    crc = ~crc
    for i in range(long):
        crc[i] = zlib.crc32(data[starts[i] : starts[i] + lengths[i]])
    out = np.empty_like(crc)
    out[order] = crc
    return out


def features(texts: pa.Array, low: int = 1, high: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and CRC-32 of every run of ``low`` to ``high`` words, joined by one space, and the number of words of each text."""
    data, at = flat_bytes(texts)
    starts, ends, row = word_ranges(data, at)
    n_words = np.bincount(row, minlength=len(texts))
    lengths = ends - starts
    data = LOWER[data]
    if high > 1:  # the words one after another, a space behind each
        inside = np.zeros(len(data) + 1, np.int64)
        np.add.at(inside, starts, 1)
        np.add.at(inside, ends, -1)
        words = data[np.cumsum(inside)[:-1] > 0]
        begins = np.cumsum(np.append(0, lengths + 1))[:-1]
        data = np.full(int(lengths.sum()) + len(lengths), 0x20, np.uint8)
        data[np.arange(len(words)) + np.repeat(np.arange(len(lengths)), lengths)] = words
        starts, ends = begins, begins + lengths
    rows, hashes = [], []
    for n in range(low, high + 1):
        last = np.arange(n - 1, len(starts))
        last = last[row[last] == row[last - n + 1]]
        first = last - n + 1
        rows.append(row[first])
        hashes.append(crc32_of(data, starts[first], ends[last] - starts[first]))
    return np.concatenate(rows), np.concatenate(hashes), n_words


def bucket_counts(df: DataFrame, text_col: str = "text", buckets: int = BUCKETS, low: int = 1, high: int = 1) -> DataFrame:
    """bucket and n: features of all texts by bucket; a task sends one row for each of its buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in (part for whole in batches for part in slices(whole, AT_ONCE)):
            _, hashes, _ = features(batch.column(0), low, high)
            total += np.bincount(hashes % np.uint32(buckets), minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

    return df.select(F.col(quoted(text_col)).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, low: int = 1, high: int = 1) -> np.ndarray:
    """floor(1000 * ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of every bucket: ``buckets`` numbers, whatever the size of the tables."""
    s = bucket_counts(source, text_col, buckets, low, high).withColumnRenamed("n", "s")
    t = bucket_counts(target, target_col, buckets, low, high).withColumnRenamed("n", "t")
    both = settle(s.join(t, "bucket", "full").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")))
    sums = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    ratio = (F.col("t").cast("double") + 1) * float(sums["s"] + buckets) / ((F.col("s").cast("double") + 1) * float(sums["t"] + buckets))
    out = np.full(buckets, np.floor(1000 * np.log(float(sums["s"] + buckets) / float(sums["t"] + buckets))), np.int64)  # in neither
    for r in both.select("bucket", F.floor(F.log(ratio) * 1000).alias("gain")).toLocalIterator():
        out[r["bucket"]] = r["gain"]
    return out


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    least_words: int = 20,
    buckets: int = BUCKETS,
    low: int = 1,
    high: int = 1,
    seed: str = "2024",
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs``; rank is null for those not drawn.

    Features are runs of ``low`` to ``high`` words (digits, letters and characters beyond ASCII; A-Z in
    lower case). A null or empty text, or one without words, has no features and weight 0. Of the N rows
    with ``least_words`` words, floor(percent * N / 100) are drawn: the highest scores, ties to the smaller
    id, a null id last and hashed as an empty one. Repeated rows are rows of their own, with ranks that
    follow each other. Empty tables give no rows, or gains from one side only. Other columns aren't read.
    """
    gains = bucket_gains(docs, target, text_col, target_col, buckets, low, high)

    def make():
        def work(texts: pa.Array) -> list:
            parts, step = [], max(1, int(len(texts) * AT_ONCE / max(1, texts.nbytes)))
            for a in range(0, len(texts), step):
                part = texts.slice(a, step)
                row, hashes, n_words = features(part, low, high)
                weight = np.bincount(row, gains[hashes % np.uint32(buckets)], minlength=len(part))
                parts.append((np.bincount(row, minlength=len(part)), n_words, weight.astype(np.int64)))
            return [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*parts, strict=True)]

        return work

    fields = [T.StructField(c, T.LongType()) for c in ("n_features", "n_words", "weight")]
    read = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000)
    scored = settle(add_columns(read, ["text"], make, fields, keep=["doc_id"]).withColumn("score", F.col("weight") + noise))
    fit = scored.filter(F.col("n_words") >= least_words)
    drawn = fit.count() * percent // 100
    # numbered in range partitions, from the counts before each
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    ranged = settle(fit.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = sizes.select("part", (before - F.col("first") + 1).alias("shift"))
    place = F.col("place") + F.col("shift")
    # the table of shifts has a row for each partition
    ranked = ranged.join(F.broadcast(shift), "part").select("doc_id", "n_features", "weight", "score", F.when(place <= drawn, place).alias("rank"))
    rest = scored.filter(F.col("n_words") < least_words).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(rest)
