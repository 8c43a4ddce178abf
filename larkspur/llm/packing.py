"""Packing of tokenised documents into sequences of a fixed length.

Documents are cut into full pieces and one rest each. Rests are packed first-fit decreasing with a
tournament tree of bin capacities, which finds the leftmost bin with room in logarithmic time. Groups
of pieces are packed independently; a group is chosen by hash from the piece and its row number, so
that groups are alike and of bounded size whatever the keys. Only lengths travel, not tokens, unless
asked for.
"""

from __future__ import annotations

import functools
import math
import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from larkspur.llm.byte_level import ByteLevelEncoder
from larkspur.llm.shared import quoted, rows_like, settle, slices

#: Documents' pieces in a group, on average.
GROUP_PIECES = 8192
#: Bytes of an Arrow batch that are encoded at once.
ENCODED_BYTES = 4 << 20


@functools.cache
def encoder(path: str) -> ByteLevelEncoder:
    """One per Python worker, so that what it remembers lasts from task to task."""
    return ByteLevelEncoder(path)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item (of 1 to ``capacity``), longest first, ties in the order given."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    full = int(np.count_nonzero(lengths == capacity))  # each fills a bin of its own
    bins[order[:full]] = np.arange(full)
    leaves = 1 << max(1, (n - full - 1).bit_length())
    room = [capacity] * (2 * leaves)  # node k: the most room of a bin below; its children are 2k and 2k + 1
    for item in order[full:].tolist():
        need, node = int(lengths[item]), 1
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        bins[item] = full + node - leaves
        offsets[item] = capacity - room[node]
        room[node] -= need
        node >>= 1
        while node:
            left, right = room[2 * node], room[2 * node + 1]
            most = left if left >= right else right
            if room[node] == most:
                break
            room[node] = most
            node >>= 1
    return bins, offsets


def cut_documents(
    df: DataFrame, tokenizer: str, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, with_ids: bool = False
) -> DataFrame:
    """One row per piece: the id column, start, length, ids_crc32, doc_tokens, place and, if asked for, ids.

    A null or empty text is the end token alone. ``place`` numbers the pieces of a partition; with the
    partition's number it tells equal rows apart. Other columns of ``df`` are not read.
    """
    fields = [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "place")]
    schema = T.StructType(rows_like(df, [id_col]) + fields + [T.StructField("ids", T.BinaryType())] * with_ids)
    arrow = to_arrow_schema(schema)

    def run(batches):
        encode, place = encoder(tokenizer).encode_column, TaskContext.get().partitionId() << 33
        for batch in (part for whole in batches for part in slices(whole, ENCODED_BYTES)):
            ids, stops = encode(batch.column(1))
            data, totals = np.insert(ids, stops, end_id).tobytes(), np.diff(stops, prepend=0) + 1
            counts = -(-totals // capacity)
            rows = np.repeat(np.arange(len(totals)), counts)
            starts = capacity * (np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts))
            lengths = np.minimum(totals[rows] - starts, capacity)
            parts = [data[a:b] for a, b in pairwise([0, *(4 * np.cumsum(lengths)).tolist()])]
            made = [pa.array(x, pa.int64()) for x in (starts, lengths, map(zlib.crc32, parts), totals[rows], range(place, place + len(rows)))]
            place += len(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *made] + [pa.array(parts, pa.binary())] * with_ids, schema=arrow)

    return df.select(F.col(quoted(id_col)), F.col(quoted(text_col))).mapInArrow(run, schema)


def pack_documents(
    df: DataFrame,
    tokenizer: str,
    capacity: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    with_ids: bool = False,
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """Put all documents into sequences of at most ``capacity`` tokens; one row per piece.

    Columns: the id column, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids). Every
    token, the end token included, lies in exactly one piece; a sequence's pieces follow each other
    without a gap from offset 0. Null and empty texts give a piece of one token, repeated rows are
    packed each, an empty table gives no rows. The pieces are settled before they are dealt out, so a
    lost executor cannot deal one twice.
    """
    pieces = settle(cut_documents(df, tokenizer, capacity, id_col, text_col, end_id, with_ids))
    groups = max(1, math.ceil(pieces.count() / group_pieces))
    dealt = pieces.withColumn("packing_group", F.pmod(F.xxhash64("place", "ids_crc32", "start"), F.lit(groups)))
    schema = T.StructType([f for f in pieces.schema.fields if f.name != "place"] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), capacity)
        sequence = (group["packing_group"].to_numpy().astype(np.int64) << 32) + bins
        return group.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offsets)).select(schema.names)

    return dealt.groupBy("packing_group").applyInArrow(pack, schema)
