"""Byte-level BPE encoding and decoding over a vocabulary of merge ranks.

A pre-token is merged with a rank queue: one bucket per merge rank holds the linked-list positions
whose pair has that rank, and a bitmap of three levels (64 children to a word) marks the buckets in
use. Find-first-set on the three levels gives the lowest rank; entries whose pair has changed since
are stale and skipped. A step costs a constant number of word operations and one short heap step
within a bucket, so a pre-token of n bytes takes about n steps however long it is. Short pre-tokens
share one queue: whatever stands in the bucket of the lowest rank is merged in all of them at once.
"""

from __future__ import annotations

import base64
import functools
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from larkspur.llm.chunks import LONG, ByteCache, ChunkEncoder, cuts_at_spaces
from larkspur.llm.shared import add_columns

#: Bytes of pre-tokens that are merged side by side; they take about 50 times as much meanwhile.
MERGED_BYTES = 2 << 20
#: Bytes of the pre-tokens that are remembered.
PIECE_BYTES = 8 << 20


class Bitmap:
    """The set of ranks in use, on three levels of 64 children; the lowest is found in constant time."""

    def __init__(self, ranks: int):
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0

    def mark(self, rank: int) -> None:
        word = rank >> 6
        if not self.low[word]:
            self.mid[word >> 6] |= 1 << (word & 63)
            self.top |= 1 << (word >> 6)
        self.low[word] |= 1 << (rank & 63)

    def lowest(self) -> int:
        block = (self.top & -self.top).bit_length() - 1
        bits = self.mid[block]
        word = (block << 6) + (bits & -bits).bit_length() - 1
        bits = self.low[word]
        return (word << 6) + (bits & -bits).bit_length() - 1

    def clear(self, rank: int) -> None:
        word = rank >> 6
        self.low[word] &= ~(1 << (rank & 63))
        if not self.low[word]:
            self.mid[word >> 6] &= ~(1 << (word & 63))
            if not self.mid[word >> 6]:
                self.top &= ~(1 << (word >> 6))


class RankQueue(Bitmap):
    """Positions of one pre-token by rank: lowest rank first, leftmost position first within a rank."""

    def __init__(self, ranks: int):
        super().__init__(ranks)
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, position)
        else:
            self.buckets[rank] = [position]
            self.mark(rank)

    def pop(self) -> tuple[int, int]:
        rank = self.lowest()
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.clear(rank)
        return rank, position


class GroupQueue(Bitmap):
    """Positions of many pre-tokens by rank; a bucket is taken as a whole."""

    def __init__(self, ranks: int):
        super().__init__(ranks)
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, rank: int, positions: np.ndarray) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(positions)
        else:
            self.buckets[rank] = [positions]
            self.mark(rank)

    def push_groups(self, positions: np.ndarray, ranks: np.ndarray) -> None:
        """Each position under its rank; those with rank -1 make no token and are left out."""
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(np.diff(ranks, prepend=-1)).tolist()
        for a, b, rank in zip(cuts, [*cuts[1:], len(ranks)][: len(cuts)], ranks[cuts].tolist(), strict=True):
            self.push(rank, positions[a:b])

    def pop_all(self) -> tuple[int, np.ndarray]:
        rank = self.lowest()
        self.clear(rank)
        bucket = self.buckets.pop(rank)
        return rank, bucket[0] if len(bucket) == 1 else np.concatenate(bucket)


class Codec(ChunkEncoder):
    """Encoder and decoder for one vocabulary file (lines of base64 token and rank) and split pattern."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        self.ranks = read_ranks(path)
        self.find = regex.compile(pattern).findall
        self.cut = cuts_at_spaces(self.find)
        self.queue, self.many = RankQueue(max(self.ranks.values()) + 1), GroupQueue(max(self.ranks.values()) + 1)
        self.pieces = ByteCache(PIECE_BYTES)  # pre-token -> packed ids
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        rank_of = self.ranks.get
        pairs = {
            (rank_of(token[:k]) << 32 | rank_of(token[k:])): rank
            for token, rank in self.ranks.items()
            for k in range(1, len(token))
            if token[:k] in self.ranks and token[k:] in self.ranks
        }
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int32)

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token: always merge the pair of lowest rank, the leftmost of equals."""
        rank_of, queue, n = self.ranks.get, self.queue, len(data)
        push, pop = queue.push, queue.pop
        if (whole := rank_of(data)) is not None:
            return [whole]
        after = list(range(1, n + 1))  # where the part that starts here ends, and the next one starts
        before = list(range(-1, n - 1))
        current = [-1] * n  # rank of the pair that starts here; -1: none, or merged into another part
        for i in range(n - 1):
            rank = rank_of(data[i : i + 2])
            if rank is not None:
                current[i] = rank
                push(rank, i)
        while queue.top:
            rank, i = pop()
            if current[i] != rank:
                continue
            gone = after[i]
            end = after[gone]
            after[i] = end
            current[gone] = current[i] = -1
            if end < n:
                before[end] = i
                rank = rank_of(data[i : after[end]])
                if rank is not None:
                    current[i] = rank
                    push(rank, i)
            left = before[i]
            if left >= 0:
                rank = rank_of(data[left:end])
                if rank is None:
                    current[left] = -1
                else:
                    current[left] = rank
                    push(rank, left)
        ids, i, ranks = [], 0, self.ranks
        while i < n:
            ids.append(ranks[data[i : after[i]]])
            i = after[i]
        return ids

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of many short pre-tokens, merged side by side through one queue.

        The queue gives the lowest rank of all pre-tokens; of its bucket, the leftmost live position
        of every pre-token is merged at once and the others go back. Each pre-token so sees the same
        order of merges as alone.
        """
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        owner = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
        ends = np.cumsum(lengths)
        n = len(data)
        symbol = self.byte_ids[data]
        after = np.arange(1, n + 1, dtype=np.int32)
        after[ends - 1] = -1
        before = np.arange(-1, n - 1, dtype=np.int32)
        before[ends - lengths] = -1
        alive = np.ones(n, bool)
        current = np.full(n, -1, np.int32)
        starts = np.flatnonzero(after >= 0).astype(np.int32)
        current[starts] = self.pair_ranks(symbol[starts], symbol[starts + 1])
        queue = self.many
        queue.push_groups(starts, current[starts])
        while queue.top:
            rank, at = queue.pop_all()
            at = at[current[at] == rank]
            if len(at) > 1:
                at = np.unique(at)
                own = owner[at]
                first = np.empty(len(at), bool)
                first[0] = True
                np.not_equal(own[1:], own[:-1], out=first[1:])
                if not first.all():
                    queue.push(rank, at[~first])
                    at = at[first]
            elif not len(at):
                continue
            gone = after[at]
            end = after[gone]
            alive[gone] = False
            current[gone] = -1
            symbol[at] = rank
            after[at] = end
            right = end >= 0
            before[end[right]] = at[right]
            left = before[at]
            left = left[left >= 0]
            current[at] = -1
            changed = np.concatenate((at[right], left))
            if len(changed):
                ranks = self.pair_ranks(symbol[changed], symbol[after[changed]])
                current[changed] = ranks
                queue.push_groups(changed, ranks)
        ids = symbol[alive].astype("<u4").tobytes()
        stops = (np.cumsum(np.bincount(owner[alive], minlength=len(pieces))) * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that two neighbouring tokens make; -1 where they make none."""
        keys = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == keys, self.pair_rank[at], -1).astype(np.int32)

    def encode_each(self, strings: list[str]) -> list[bytes]:
        find, rank_of = self.find, self.ranks.get
        split = [find(s) for s in strings]
        different: set[str] = set()
        again: set[str] = set()
        for pieces in split:
            for piece in pieces:
                (again if piece in different else different).add(piece)
        made = self.pieces.known(different)
        again.difference_update(made)
        short: list[str] = []
        for piece in different.difference(made):
            data = piece.encode("utf-8", "surrogatepass")
            if (whole := rank_of(data)) is not None:
                made[piece] = whole.to_bytes(4, "little")
            elif len(data) > LONG:
                made[piece] = packed(self.merge(data))
            else:
                short.append(piece)
        for part in runs(short, MERGED_BYTES):
            made.update(zip(part, self.merge_many([p.encode("utf-8", "surrogatepass") for p in part]), strict=True))
        for piece in again:
            if len(piece) <= LONG:
                self.pieces.remember(piece, made[piece])
        return [made[p[0]] if len(p) == 1 else b"".join(map(made.__getitem__, p)) for p in split]

    @functools.cached_property
    def tokens(self) -> list[bytes]:
        """Tokens by id, for decoding; the same objects as the keys of ``ranks``."""
        return by_id(self.ranks)


def runs(strings: list[str], most_chars: int) -> Iterator[list[str]]:
    """The strings in runs of about ``most_chars``."""
    run, held = [], 0
    for s in strings:
        run.append(s)
        held += len(s)
        if held >= most_chars:
            yield run
            run, held = [], 0
    if run:
        yield run


def read_ranks(path: str) -> dict[bytes, int]:
    """Token -> rank of a vocabulary file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def by_id(ranks: dict[bytes, int]) -> list[bytes]:
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


@functools.cache
def token_bytes(path: str) -> list[bytes]:
    """Tokens by id, for decoding."""
    return by_id(read_ranks(path))


def packed(ids: list[int]) -> bytes:
    return b"".join([i.to_bytes(4, "little") for i in ids])


@functools.cache
def codec(path: str, pattern: str) -> Codec:
    """One per Python worker, so that its cache lasts from task to task."""
    return Codec(path, pattern)


def decoded(ids: bytes | None, tokens: list[bytes]) -> bytes:
    """The bytes that packed ids stand for."""
    return b"".join(map(tokens.__getitem__, array("I", ids or b"")))


def encode_bpe(
    df: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", keep: list[str] | None = None, bytes_col: str | None = None
) -> DataFrame:
    """Add ``ids_col``: the whole text's token ids, packed as little-endian unsigned 32-bit integers.

    Every match of ``pattern`` is merged separately, without special tokens; the matches must cover the
    whole text. A null or empty text has no ids (an empty binary). Repeated rows are encoded each;
    columns that have the new names already are replaced. ``path`` must be readable on the executors.
    With ``bytes_col`` the ids just made are decoded into that column in the same pass, as
    :func:`decode_bpe` does, so that one Python worker and one vocabulary serve both.
    """
    names = [ids_col] + [bytes_col] * (bytes_col is not None)

    def make():
        own = codec(path, pattern)

        def work(texts: pa.Array) -> list:
            ids = own.encode_all(texts.to_pylist())
            made = [pa.array(ids, pa.binary())]
            if bytes_col is not None:
                made.append(pa.array((decoded(x, own.tokens) for x in ids), pa.binary()))
            return made

        return work

    return add_columns(df, [text_col], make, [T.StructField(n, T.BinaryType()) for n in names], keep)


def decode_bpe(
    df: DataFrame, path: str, ids_col: str = "ids", bytes_col: str = "decoded", keep: list[str] | None = None
) -> DataFrame:
    """Add ``bytes_col``: the bytes that the packed ids stand for. Null ids give an empty binary."""

    def make():
        tokens = token_bytes(path)
        return lambda ids: [pa.array((decoded(x.as_py(), tokens) for x in ids), pa.binary())]

    return add_columns(df, [ids_col], make, [T.StructField(bytes_col, T.BinaryType())], keep)
