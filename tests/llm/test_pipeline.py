"""The whole pipeline over awkward rows, against plain versions of its stages."""

from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larkspur.llm import quality, toxicity


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    docs.withColumn("k", F.lit("x")).withColumn("Quality_Score", F.lit(1)).withColumn("TOXICITY_score", F.lit(1)).withColumn("score", F.lit(None).cast("double")).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 5 > 0), int(k % 7 == 0)) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_learned_stages_keep_what_plain_scores_say(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.collect()
    own, model = quality.Features(quality.BITS), quality.fit(docs, labels)
    good = [r for r in rows if quality.score_batch(model, [own.of(r["text"])])[0] >= corpus_pipeline.QUALITY_LEAST]
    kept = corpus_pipeline.keep_good(spark, docs, folder)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, good))
    own, model = toxicity.Features(toxicity.BITS), toxicity.fit(docs, labels)
    weight = dict(zip(model["at"].tolist(), model["weight"].tolist(), strict=True))
    chance = lambda t: 1 / (1 + np.exp(-(sum(weight.get(i, 0.0) for i in own.of(t).tolist()) + float(model["bias"][0]))))
    clean = [r for r in rows if chance(r["text"]) < corpus_pipeline.TOXIC_LEAST]
    assert sorted(map(str, corpus_pipeline.drop_toxic(spark, docs, folder).collect())) == sorted(map(str, clean))


def test_run_packs_all_that_the_stages_keep(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    want = sorted((str(r["doc_id"]), len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1) for r in docs.collect())
    got = defaultdict(int)
    for r in corpus_pipeline.run(spark, folder).collect():
        got[str(r["doc_id"]), r["doc_tokens"]] += r["length"]
    assert sorted(k for k in got) == sorted(set(want)) and sum(got.values()) == sum(n for _, n in want)


def test_an_empty_table(spark, no_docs, tmp_path):
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
