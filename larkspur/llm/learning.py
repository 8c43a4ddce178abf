"""Fitting of linear-time classifiers by iterative parameter mixing.

A bounded, labelled sample is hashed to features once. In every epoch each of a fixed number of shards
is trained by its own task from the same parameters; the results are averaged block by block in tasks, and
the driver gets the means: arrays whose size is a parameter of the model, never rows of the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.shared import quoted, settle, split_remainder

SHARDS = 4
#: Parameters in a block, of which the mean over the shards is made at once.
BLOCK = 1 << 16


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, most_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text and label of about ``most_rows`` labelled documents outside the held-out quarter, or of all if fewer.

    A document is taken by the hash of its id, so the sample doesn't depend on the input's order. Rows
    with a null id, label or text teach nothing; of repeated ids one text and one label count.
    """
    train = F.expr(f"{split_remainder(id_col)} <> 2")
    known = labels.filter(F.col(quoted(label_col)).isNotNull() & F.col(quoted(id_col)).isNotNull()).filter(train)
    share = min(1.0, most_rows / max(1, known.count()))
    taken = F.pmod(F.xxhash64(F.lit("sample"), quoted(id_col)), F.lit(1 << 20)) < int(share * (1 << 20) + 0.5)
    marks = known.filter(taken).groupBy(F.col(quoted(id_col)).alias("id")).agg(F.max(quoted(label_col)).cast("int").alias("label"))
    texts = docs.filter(train & taken & F.col(quoted(text_col)).isNotNull()).select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    # the marks are the bounded sample itself, so that only its texts are shuffled
    return texts.join(F.broadcast(marks), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label"))


def fit_by_mixing(
    sample: DataFrame, featurise: Callable[[list[str]], list[bytes]], state: dict[str, np.ndarray], train: Callable[[dict, list[bytes], np.ndarray, int], dict], epochs: int
) -> dict[str, np.ndarray]:
    """Parameters after ``epochs`` rounds over ``sample`` (id, text, label).

    ``featurise`` turns texts into packed features and ``train`` goes once over a shard's features and
    labels, in an order that follows from its seed. Shards are told apart by the id's hash; an empty
    sample leaves the parameters as they are.
    """
    spark = sample.sparkSession

    def pack(batches):
        for batch in batches:
            packed = featurise(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), batch.column(0), batch.column(2)], names=["features", "label", "shard"])

    shard = F.pmod(F.xxhash64(F.lit("shard"), "id"), F.lit(SHARDS)).cast("int").alias("shard")
    examples = sample.select("label", "text", shard).mapInArrow(pack, "features binary, label int, shard int")
    # dealt once, so that the epochs need no shuffle; a task trains each shard that its partition has on its own
    examples = settle(examples.repartitionByRange(SHARDS, "shard").sortWithinPartitions("shard", "features", "label"))

    def pass_over(now: Broadcast, epoch: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shards: dict[int, tuple[list[bytes], list[int]]] = {}
            for batch in batches:
                for feature, label, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    features, labels = shards.setdefault(number, ([], []))
                    features.append(feature)
                    labels.append(label)
            for number in sorted(shards):
                features, labels = shards.pop(number)
                mine = train({k: v.copy() for k, v in now.value.items()}, features, np.array(labels), epoch)
                for name, values in mine.items():
                    flat = values.reshape(-1)
                    parts = [flat[k : k + BLOCK] for k in range(0, len(flat), BLOCK)]
                    made = [pa.array([name] * len(parts)), pa.array(range(len(parts)), pa.int32()), pa.array([number] * len(parts), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())]
                    yield pa.RecordBatch.from_arrays(made, names=["name", "block", "shard", "values"])

        return one

    kinds = {k: v.dtype for k, v in state.items()}

    def mean(group: pa.Table) -> pa.Table:
        group = group.sort_by("shard")
        kind = kinds[group["name"][0].as_py()]
        total = sum(np.frombuffer(x.as_py(), kind).astype(np.float64) for x in group["values"])
        return pa.table([group["name"][:1], group["block"][:1], pa.array([(total / group.num_rows).astype(kind).tobytes()], pa.binary())], names=["name", "block", "values"])

    for epoch in range(epochs):
        now = spark.sparkContext.broadcast(state)
        trained = examples.mapInArrow(pass_over(now, epoch), "name string, block int, shard int, values binary")
        # a block has one row from each shard; the driver gets the means, which are as large as the state
        blocks = {(r["name"], r["block"]): r["values"] for r in trained.groupBy("name", "block").applyInArrow(mean, "name string, block int, values binary").collect()}
        if blocks:
            state = {k: np.frombuffer(b"".join(blocks[k, n] for n in range(-(-v.size // BLOCK))), v.dtype).reshape(v.shape) for k, v in state.items()}
        now.destroy()
    return state
