"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum (v_if x_i)^2)): the pairwise part
is linear in the number of features by the sum-of-squares identity. Fitted with AdaGrad on a bounded
sample; text and its statistics are the only inputs of a score.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.learning import fit_by_mixing, labelled_sample
from larkspur.llm.shared import add_columns, split_remainder

BITS, RANK = 18, 4
CACHED_WORDS = 200_000
#: Character classes by byte: lower, upper, digit, white space, line end, other ASCII, part of a longer character.
KINDS = np.full(256, 5, np.uint8)
KINDS[ord("a") : ord("z") + 1] = 0
KINDS[ord("A") : ord("Z") + 1] = 1
KINDS[ord("0") : ord("9") + 1] = 2
KINDS[[9, 11, 12, 13, 32]] = 3
KINDS[10] = 4
KINDS[128:] = 6


def statistics(text: str, words: list[str]) -> list[float]:
    """Structure of a text as shares between 0 and 1, and its length on a logarithmic scale."""
    kinds = np.bincount(KINDS[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)], minlength=7)
    n, chars = max(1, len(words)), max(1, int(kinds.sum()))
    letters = max(1, int(kinds[0] + kinds[1]))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x]
    bare = sum(c for w, c in counts.items() if not w[0].isalnum())
    marked = sum(c for w, c in counts.items() if not w[-1].isalnum())
    twice = sum(c for w, c in counts.items() if len(w) > 2 and not (w[-1].isalnum() or w[-2].isalnum()))
    repeated = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        kinds[1] / letters,
        kinds[2] / chars,
        kinds[5] / chars,
        kinds[6] / chars,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        bare / n,
        marked / n,
        twice / n,
        repeated / n,
        1 - len(set(lines)) / max(1, len(lines)),
        min(1.0, len(lines) / n),
        min(1.0, chars / n / 20),
        min(1.0, np.log2(chars) / 24),
    ]


class Features:
    """Packed pairs of a feature's number and value."""

    def __init__(self, bits: int):
        self.mask, self.words = (1 << bits) - 1, {}

    def numbers(self, words: set[str]) -> np.ndarray:
        known = self.words
        if len(known) > CACHED_WORDS:
            known.clear()
        known.update((w, zlib.crc32(w.encode("utf-8", "surrogatepass")) & self.mask) for w in words.difference(known))
        return np.unique(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = (text or "").split()
        own = self.numbers(set(words))
        shape = statistics(text or "", words)
        # each statistic falls into a coarse and a fine bin, finer near 0 and 1
        bins = [(k, step, int(step * (np.arcsin(2 * min(1.0, max(0.0, float(x))) - 1) / np.pi + 0.5))) for k, x in enumerate(shape) for step in (6, 24)]
        extra = [zlib.crc32(b"stat %d %d %d" % b) & self.mask for b in bins] + [zlib.crc32(b"empty") & self.mask] * (not words)
        values = np.concatenate([np.full(len(own), 1 / np.sqrt(max(1, len(own)))), np.full(len(extra), 0.5)])
        return np.concatenate([own, np.array(extra, np.int64)]), values.astype(np.float32)

    def packed(self, text: str | None) -> bytes:
        numbers, values = self.of(text)
        return numbers.astype("<i4").tobytes() + values.astype("<f4").tobytes()


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    half = len(data) // 2
    return np.frombuffer(data[:half], "<i4"), np.frombuffer(data[half:], "<f4")


def train(state: dict, features: list[bytes], labels: np.ndarray, epoch: int, rate: float = 0.15, decay: float = 1e-4) -> dict:
    """One AdaGrad pass over a shard, in a shuffled order."""
    w0, w, v, gw, gv = (state[k] for k in ("w0", "w", "v", "gw", "gv"))
    for k in np.random.default_rng(epoch).permutation(len(features)).tolist():
        i, x = unpacked(features[k])
        vx = v[i] * x[:, None]
        total = vx.sum(0)
        z = w0[0] + w[i] @ x + 0.5 * float((total * total - (vx * vx).sum(0)).sum())
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[k]
        w0[0] -= 0.02 * error
        g = error * x + decay * w[i]
        gw[i] += g * g
        w[i] -= rate * g / np.sqrt(gw[i] + 1e-6)
        g = error * x[:, None] * (total - vx) + decay * v[i]
        gv[i] += g * g
        v[i] -= 0.3 * rate * g / np.sqrt(gv[i] + 1e-6)
    return state


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most_rows: int = 20_000, epochs: int = 6, bits: int = BITS, rank: int = RANK) -> dict[str, np.ndarray]:
    """Weights from about ``most_rows`` labelled rows (the bound) outside the held-out quarter."""
    size = 1 << bits
    v = np.random.default_rng(7).normal(0, 0.02, (size, rank)).astype(np.float32)
    zero = np.zeros(size, np.float32)
    state = {"w0": np.zeros(1, np.float32), "w": zero, "v": v, "gw": zero.copy(), "gv": np.zeros((size, rank), np.float32)}

    def featurise(texts: list[str]) -> list[bytes]:
        own = Features(bits)
        return [own.packed(t) for t in texts]

    state = fit_by_mixing(labelled_sample(docs, labels, label_col, most_rows), featurise, state, train, epochs)
    return {k: state[k] for k in ("w0", "w", "v")}


def score_batch(model: dict, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    if not rows:
        return np.empty(0)
    i, x = (np.concatenate(c) for c in zip(*rows, strict=True))
    starts = np.cumsum([0, *(len(r[0]) for r in rows[:-1])])
    linear = np.add.reduceat(model["w"][i] * x, starts)
    vx = model["v"][i] * x[:, None]
    total = np.add.reduceat(vx, starts, axis=0)
    pairs = 0.5 * (total * total - np.add.reduceat(vx * vx, starts, axis=0)).sum(1)
    return 1 / (1 + np.exp(-np.clip(model["w0"][0] + linear + pairs, -30, 30).astype(np.float64)))


def score(df: DataFrame, model: dict[str, np.ndarray], text_col: str = "text", score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Add ``score_col``, 0 to 1, for every row; null and empty texts get the score of a text without words.

    The weights are broadcast: their size is fixed by the number of bits and the rank. Equal texts get
    equal scores; a column that is called ``score_col`` already is replaced.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    bits = int(np.log2(len(model["w"])))

    def make():
        own = Features(bits)

        def work(texts: pa.Array) -> list:
            out = []
            for a in range(0, len(texts), 512):
                out.append(score_batch(sent.value, [own.of(t.as_py()) for t in texts[a : a + 512]]))
            return [np.concatenate(out) if out else []]

        return work

    return add_columns(df, [text_col], make, [T.StructField(score_col, T.DoubleType())], keep)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``; fitted on labels outside the held-out quarter."""
    scored = score(docs, fit(docs, labels, **options), keep=["doc_id"])
    return scored.select("doc_id", F.expr(f"{split_remainder()} = 2").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
