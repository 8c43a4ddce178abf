"""Toxicity classifier: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words, pairs of neighbours and pairs with one word between are hashed to coordinates; each present
coordinate counts once in a text. Every coordinate has a learning rate of its own, and the L1 term
keeps all but the telling ones at zero, so that the weights are a short sorted list.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.learning import fit_by_mixing, labelled_sample
from larkspur.llm.shared import add_columns, split_remainder

BITS = 19
CACHED_WORDS = 200_000
NEXT, SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def bare(word: str) -> str:
    """Lower case without what stands before and after the letters and digits; all of it if there are none."""
    low, n = word.lower(), len(word)
    a, b = 0, len(low)
    while a < b and not low[a].isalnum():
        a += 1
    while b > a and not low[b - 1].isalnum():
        b -= 1
    return low[a:b] if n and a < b else low


class Features:
    def __init__(self, bits: int):
        self.shift, self.words = np.uint64(64 - bits), {}

    def of(self, text: str | None) -> np.ndarray:
        """Sorted distinct coordinates of a text; none without words."""
        words = (text or "").split()
        known = self.words
        new = set(words).difference(known)
        if new:
            if len(known) > CACHED_WORDS:
                known.clear()
                new = set(words)
            known.update((w, xxhash.xxh64_intdigest(bare(w).encode("utf-8", "surrogatepass"))) for w in new)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        pairs = ((h[:-1] * NEXT) ^ (h[1:] >> np.uint64(3))) * SKIP
        skips = ((h[:-2] * SKIP) ^ (h[2:] >> np.uint64(5))) * NEXT
        return np.unique(np.concatenate([h * NEXT >> self.shift, pairs >> self.shift, skips >> self.shift]).astype(np.int32))


def weights(z: np.ndarray, n: np.ndarray, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    return np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))


def fit(
    docs: DataFrame, labels: DataFrame, label_col: str = "toxic", most_rows: int = 20_000, epochs: int = 5, bits: int = BITS,
    alpha: float = 0.3, beta: float = 1.0, l1: float = 3.0, l2: float = 0.5,
) -> dict[str, np.ndarray]:
    """Non-zero weights from about ``most_rows`` labelled rows (the bound) outside the held-out quarter: at, weight and bias."""
    rates = alpha, beta, l1, l2
    size = 1 << bits

    def featurise(texts: list[str]) -> list[bytes]:
        own = Features(bits)
        return [own.of(t).astype("<i4").tobytes() for t in texts]

    def train(state: dict, features: list[bytes], marks: np.ndarray, epoch: int) -> dict:
        z, n = state["z"], state["n"]
        for k in np.random.default_rng(epoch).permutation(len(features)).tolist():
            at = np.append(np.frombuffer(features[k], "<i4"), size)  # the last coordinate is the bias
            zi, ni = z[at], n[at]
            w = weights(zi, ni, *rates)
            w[-1] = -zi[-1] / ((beta + np.sqrt(ni[-1])) / alpha + l2)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - marks[k]
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[at] = ni + g * g
        return state

    state = {"z": np.zeros(size + 1, np.float32), "n": np.zeros(size + 1, np.float32)}
    state = fit_by_mixing(labelled_sample(docs, labels, label_col, most_rows), featurise, state, train, epochs)
    w = weights(state["z"][:-1], state["n"][:-1], *rates)
    at = np.flatnonzero(w).astype(np.int32)
    bias = -state["z"][-1] / ((beta + np.sqrt(state["n"][-1])) / alpha + l2)
    return {"at": at, "weight": w[at].astype(np.float32), "bias": np.array([bias], np.float32), "bits": np.array([bits])}


def score(df: DataFrame, model: dict[str, np.ndarray], text_col: str = "text", score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Add ``score_col``, 0 to 1, for every row; null and empty texts get the score of the bias alone.

    The broadcast weights have at most one entry for each of 2^bits coordinates. Equal texts get equal
    scores; a column that is called ``score_col`` already is replaced.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        m = sent.value
        own = Features(int(m["bits"][0]))
        dense = np.zeros(1 << int(m["bits"][0]), np.float32)
        dense[m["at"]] = m["weight"]

        def work(texts: pa.Array) -> list:
            z = np.array([float(dense[own.of(t.as_py())].sum(dtype=np.float64)) for t in texts]) + float(m["bias"][0])
            return [1 / (1 + np.exp(-np.clip(z, -30, 30)))]

        return work

    return add_columns(df, [text_col], make, [T.StructField(score_col, T.DoubleType())], keep)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``; fitted on labels outside the held-out quarter."""
    scored = score(docs, fit(docs, labels, **options), keep=["doc_id"])
    return scored.select("doc_id", F.expr(f"{split_remainder()} = 2").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
