"""Local explanations of texts: which words move a scorer's prediction of one document (LIME).

Each document is scored again with words left out: a sample removes every occurrence of some of its words.
Samples near the whole document weigh more, and a ridge regression of the scores on the words' presence
gives each word its weight. All samples of all documents are rows that are scored in one pass; the
regression of a document is solved by its own task, from the smaller of its two normal equations (words by words,
or samples by samples).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.frame import quoted


#: Tokens in the samples that are made at once.
AT_ONCE = 1 << 20


def drawn(seed: int, key: str, sample: int, n: int) -> set[int]:
    """Places of the words that a sample leaves out: a number of draws from 1 to n, each by the first 32 bits of the MD5 of seed, key, sample and draw."""
    at = lambda draw: int(hashlib.md5(f"{seed}|{key}|{sample}|{draw}".encode()).hexdigest()[:8], 16) % n
    return {at(draw) for draw in range(1, at(0) + 2)}


def perturbed(df: DataFrame, key: str, tokens: str, samples: int, seed: int = 42) -> DataFrame:
    """key, sample, words (the document's different tokens), kept (0/1 by word) and text.

    Sample 0 is whole. In each other a number of words from 1 to all is drawn, and as many words with
    replacement; all their occurrences go. A document without tokens has sample 0 only; null tokens are none. The
    work for a sample grows with the document's tokens alone.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, (name, own) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                own = own or []
                words = list(dict.fromkeys(own))
                place = dict(zip(words, range(len(words)), strict=True))
                at = [place[t] for t in own]
                step = max(1, AT_ONCE // max(1, len(own)))
                numbers = range(samples + 1 if words else 1)
                for first in numbers[::step]:
                    some = numbers[first : first + step]
                    off = [drawn(seed, name, s, len(words)) if s else set() for s in some]
                    columns = [
                        batch.column(0).slice(row, 1).take(pa.array([0] * len(some))),
                        pa.array(list(some), pa.int32()),
                        pa.array([words] * len(some), pa.list_(pa.string())),
                        pa.array([[int(i not in gone) for i in range(len(words))] for gone in off], pa.list_(pa.int32())),
                        pa.array([" ".join([t for t, i in zip(own, at, strict=True) if i not in gone]) for gone in off], pa.string()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=[key, "sample", "words", "kept", "text"])

    asked = df.select(quoted(key), F.col(quoted(key)).cast("string").alias("key_text_"), F.col(quoted(tokens)).alias("tokens_"))
    return asked.mapInArrow(run, f"{quoted(key)} {kind}, sample int, words array<string>, kept array<int>, text string")


def kernel_weight(kept: Column, width: float = 25.0) -> Column:
    """sqrt(exp(-d^2 / width^2)) with d = 100 times the cosine distance of the kept words from all; 1 without words."""
    share = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept)
    d = 100 * (1 - F.sqrt(share))
    return F.when(F.size(kept) == 0, 1.0).otherwise(F.sqrt(F.exp(-d * d / (width * width))))


def ridge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Weights and intercept of the weighted ridge regression; the intercept isn't penalised."""
    share = weight / weight.sum()
    mean_x, mean_y = share @ x, share @ y
    root = np.sqrt(weight)
    a, b = (x - mean_x) * root[:, None], (y - mean_y) * root
    if x.shape[1] <= x.shape[0]:
        beta = np.linalg.solve(a.T @ a + penalty * np.eye(x.shape[1]), a.T @ b)
    else:
        beta = a.T @ np.linalg.solve(a @ a.T + penalty * np.eye(x.shape[0]), b)
    return beta, float(mean_y - mean_x @ beta)


def lasso_choice(x: np.ndarray, y: np.ndarray, weight: np.ndarray, most: int, steps: int = 60, sweeps: int = 200) -> np.ndarray:
    """Columns of the last lasso model, as its penalty falls, that has at most ``most`` of them."""
    share = weight / weight.sum()
    root = np.sqrt(weight)
    a, r = (x - share @ x) * root[:, None], (y - share @ y) * root
    size = (a * a).sum(0)
    beta, chosen = np.zeros(x.shape[1]), np.empty(0, int)
    top = np.abs(a.T @ r).max(initial=0.0)
    for penalty in top * np.logspace(0, -4, steps):
        for _ in range(sweeps):
            moved = 0.0
            for j in np.flatnonzero(size):
                z = a[:, j] @ r + size[j] * beta[j]
                new = np.sign(z) * max(abs(z) - penalty, 0) / size[j]
                if new != beta[j]:
                    r -= a[:, j] * (new - beta[j])
                    moved = max(moved, abs(new - beta[j]) * np.sqrt(size[j]))
                    beta[j] = new
            if moved < 1e-9 * max(top, 1e-300):
                break
        if np.count_nonzero(beta) > most:
            break
        chosen = np.flatnonzero(beta)
    return chosen


def explain_texts(
    df: DataFrame, key: str, tokens: str, score: Callable[[DataFrame], DataFrame], samples: int = 1000, width: float = 25.0, penalty: float = 1.0, n_features: int | None = None, seed: int = 42
) -> DataFrame:
    """key, word, weight, bias, fit and prediction: one row for each word of each document that has a weight.

    ``score`` adds a number p to a frame with a column text. ``fit`` is the weighted R² of the regression,
    ``prediction`` the scorer's for the whole document. With ``n_features`` the lasso first chooses so many words.
    A key stands for one document; of several rows with one key the samples count together if their words are the same.
    """
    rows = score(perturbed(df, key, tokens, samples, seed).withColumn("weight_", kernel_weight(F.col("kept"), width)))
    kind = dict(df.dtypes)[key]

    def solve(part: pa.Table) -> pa.Table:
        words = part["words"][0].as_py()
        x = np.stack([k.values.to_numpy() for k in part["kept"]]).astype(float) if words else np.zeros((part.num_rows, 0))
        y, weight = part["p"].to_numpy().astype(float), part["weight_"].to_numpy()
        at = np.arange(len(words)) if n_features is None else lasso_choice(x, y, weight, n_features)
        beta, bias = ridge(x[:, at], y, weight, penalty)
        mean = weight @ y / weight.sum()
        rest, spread = weight @ (y - x[:, at] @ beta - bias) ** 2, weight @ (y - mean) ** 2
        whole = y[np.flatnonzero(part["sample"].to_numpy() == 0)[0]]
        same = lambda v: pa.array([float(v)] * len(at), pa.float64())
        columns = [part[key].combine_chunks().take(pa.array([0] * len(at), pa.int64())), pa.array([words[i] for i in at], pa.string()), pa.array(beta), same(bias), same(1 - rest / spread if np.ptp(y) > 0 else 0.0), same(whole)]
        return pa.table(columns, names=[key, "word", "weight", "bias", "fit", "prediction"])

    return rows.select(quoted(key), "sample", "words", "kept", "weight_", F.col("p").cast("double").alias("p")).groupBy(quoted(key)).applyInArrow(solve, f"{quoted(key)} {kind}, word string, weight double, bias double, fit double, prediction double")


def strongest(explained: DataFrame, key: str, n: int = 10) -> DataFrame:
    """key and words: the n strongest words of each document with their weights, strongest first, ties by word."""
    top = F.array_sort(F.collect_list(F.struct((-F.abs("weight")).alias("order"), "word", "weight")))
    return explained.groupBy(quoted(key)).agg(F.transform(F.slice(top, 1, n), lambda x: F.struct(x["word"].alias("word"), x["weight"].alias("weight"))).alias("words"))


def weighted_tokens(df: DataFrame, key: str, tokens: str, explained: DataFrame) -> DataFrame:
    """key, place, token and weight: the document's tokens in their order, 0 for words without a weight."""
    placed = df.select(quoted(key), F.posexplode(quoted(tokens)).alias("place", "token"))
    return placed.join(explained.select(quoted(key), F.col("word").alias("token"), "weight"), [key, "token"], "left").select(quoted(key), "place", "token", F.coalesce("weight", F.lit(0.0)).alias("weight"))
