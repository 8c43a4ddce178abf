"""Held-out quality of the learned models, their identities, and the pipeline's stages."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larkspur.llm import langid, learning, quality, toxicity

BIG = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")


def test_sum_of_squares_identity():
    r = np.random.default_rng(2)
    model = {"w0": np.array([0.1]), "w": r.normal(size=16), "v": r.normal(size=(16, 3))}
    i, x = np.array([1, 5, 7, 9]), r.normal(size=4)
    pairs = sum(model["v"][i[a]] @ model["v"][i[b]] * x[a] * x[b] for a in range(4) for b in range(a + 1, 4))
    z = 0.1 + model["w"][i] @ x + pairs
    assert quality.score_batch(model, [(i, x)])[0] == pytest.approx(1 / (1 + np.exp(-z)))


def test_quality_on_held_out_rows(tables):
    docs, labels = tables
    scored = quality.quality_scores(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert (scored.predicted == scored.quality).mean() > 0.9


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.toxicity_scores(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert (scored.predicted == (scored.score >= 0.3)).all()
    assert (scored.predicted == scored.toxic).mean() > 0.95
    assert scored[scored.toxic == 1].predicted.mean() > 0.65 and scored[scored.toxic == 0].predicted.mean() < 0.01


def test_toxicity_weights_are_sparse(tables):
    assert 0 < len(toxicity.fit(*tables)["at"]) < 5_000


def test_an_adagrad_step_equals_the_plain_loop():
    r = np.random.default_rng(9)
    state = {"w0": np.array([0.2], np.float32), "w": r.normal(0, 0.1, 32).astype(np.float32), "v": r.normal(0, 0.1, (32, 4)).astype(np.float32), "gw": np.zeros(32, np.float32), "gv": np.zeros((32, 4), np.float32)}
    before = {k: v.astype(float) for k, v in state.items()}
    at, x = np.array([3, 8, 30]), np.array([0.5, 0.25, 1.0], np.float32)
    after = quality.train(state, [at.astype("<i4").tobytes() + x.astype("<f4").tobytes()], np.array([1]), 0)
    pairs = sum(before["v"][at[a]] @ before["v"][at[b]] * x[a] * x[b] for a in range(3) for b in range(a + 1, 3))
    error = 1 / (1 + np.exp(-(0.2 + before["w"][at] @ x + pairs))) - 1
    for n, i in enumerate(at):
        g = error * x[n] + 1e-4 * before["w"][i]
        assert after["w"][i] == pytest.approx(before["w"][i] - 0.15 * g / np.sqrt(g * g + 1e-6), rel=1e-4)
        for f in range(4):
            others = sum(before["v"][j][f] * x[m] for m, j in enumerate(at) if j != i)
            g = error * x[n] * others + 1e-4 * before["v"][i][f]
            assert after["v"][i][f] == pytest.approx(before["v"][i][f] - 0.045 * g / np.sqrt(g * g + 1e-6), rel=1e-3)
    assert after["w0"][0] == pytest.approx(0.2 - 0.02 * error, rel=1e-5)


def test_ftrl_weights_equal_the_plain_loop(spark, monkeypatch):
    """One epoch over a few texts, coordinate by coordinate."""
    monkeypatch.setattr(learning, "SHARDS", 1)
    texts = [("bad words here", 1), ("good words there", 0), ("bad bad", 1), ("fine", 0)] * 3
    ids = [k for k in range(100) if zlib.crc32(str(k).encode()) % 4 != 2][: len(texts)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in zip(ids, texts, strict=True)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in zip(ids, texts, strict=True)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, epochs=1, l1=0.1)
    own = toxicity.Features(toxicity.BITS)
    examples = sorted((own.of(t).astype("<i4").tobytes(), y) for t, y in texts)
    z, n = {}, {}

    def weight(i, l1):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - np.sign(zi) * l1) / ((1.0 + np.sqrt(n.get(i, 0.0))) / 0.3 + 0.5)

    for k in np.random.default_rng(0).permutation(len(examples)):
        at = [*np.frombuffer(examples[k][0], "<i4").tolist(), "bias"]
        w = {i: weight(i, 0.0 if i == "bias" else 0.1) for i in at}
        g = 1 / (1 + np.exp(-sum(w.values()))) - examples[k][1]
        for i in at:
            before = n.get(i, 0.0)
            z[i] = z.get(i, 0.0) + g - (np.sqrt(before + g * g) - np.sqrt(before)) / 0.3 * w[i]
            n[i] = before + g * g
    want = {i: weight(i, 0.1) for i in z if i != "bias"}
    got = dict(zip(model["at"].tolist(), model["weight"].tolist(), strict=True))
    assert got == pytest.approx({i: w for i, w in want.items() if w}, rel=1e-3)
    assert model["bias"][0] == pytest.approx(weight("bias", 0.0), rel=1e-3)


def test_language_of_held_out_rows(tables):
    docs, _ = tables
    got = langid.language_of_documents(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


@pytest.mark.parametrize("context", ["", "t", "th", "the", "xq", "zzz"])
def test_language_probabilities_sum_to_one(small_model, context):
    """Over all symbols known to any language, the end of a word and one unknown symbol, after contexts of every length."""
    model, alphabet = small_model
    before = model.word_scores([context])  # with the end mark
    for i in range(len(model.langs)):
        # a word's symbols follow one another: p(context c end) / p(end | context c) is what is asked
        total = 0.0
        for c in [*alphabet, "\uffff"]:
            codes, _, start = langid.symbols([context + c])
            total += np.exp(symbol_scores(model, codes, start)[len(context) + 1, i])
        codes, _, start = langid.symbols([context])
        total += np.exp(symbol_scores(model, codes, start)[len(context) + 1, i])
        assert total == pytest.approx(1, abs=1e-9)
        assert before[0, i] == pytest.approx(symbol_scores(model, codes, start)[1:, i].sum())


@pytest.fixture(scope="module")
def small_model(tables):
    docs, _ = tables
    model = langid.fit(docs, 50)
    alphabet = [chr(c) for c in sorted(set(known_symbols(model)))]
    return model, alphabet


def known_symbols(model):
    """Code points whose unigram any language knows."""
    codes = np.array([c for c in range(0x20, 0x3000) if chr(c).isalpha()], np.uint64)
    hashes = langid.gram_hashes(codes, np.zeros(len(codes), bool), 1)[0]
    table, seen, _ = model.tables[0]
    at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
    known = (table[at] == hashes) & ~np.isnan(seen[at]).all(1)
    assert known.sum() + 1 == (~np.isnan(seen).all(1)).sum()  # the other one is the end of a word
    return codes[known].tolist()


def symbol_scores(model, codes, start):
    """The plain recursion: the longest known n-gram, with the backoff weights of the longer contexts."""
    grams = langid.gram_hashes(codes, start, len(model.tables))
    out = np.zeros((len(codes), len(model.langs)))
    for t in range(len(codes)):
        for i in range(len(model.langs)):
            p = model.floor[i]
            for k, (hashes, seen, weight) in enumerate(model.tables):
                if not grams[k][t]:
                    break
                if k:
                    at = np.flatnonzero(hashes_of(model, k - 1) == grams[k - 1][t - 1])
                    p += model.tables[k - 1][2][at[0], i] if len(at) else 0.0
                at = np.flatnonzero(hashes == grams[k][t])
                if len(at) and not np.isnan(seen[at[0], i]):
                    p = seen[at[0], i]
            out[t, i] = p
    return out


def hashes_of(model, k):
    return model.tables[k][0]


def test_awkward_rows(docs, no_docs, tables):
    _, labels = tables
    model = langid.fit(tables[0], 50)
    got = {r["doc_id"]: r for r in langid.languages(docs.withColumn("score", F.lit("x")), model, reject=False).filter("doc_id is not null").collect()}
    assert got[18]["lang_pred"] == got[19]["lang_pred"] == "und" and got[18]["score"] == 0
    assert got[0]["lang_pred"] in model.langs
    assert langid.language_of_documents(no_docs).count() == 0
    for fit, score in ((quality.fit, quality.score), (toxicity.fit, toxicity.score)):
        m = fit(docs, labels, most_rows=50)
        rows = score(docs.withColumn("score", F.lit("x")), m).collect()
        assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert score(no_docs, m).count() == 0
        assert score(docs, fit(no_docs, labels)).count() == docs.count()


def test_pipeline_stages(spark, tables):
    docs, labels = tables
    kept = corpus_pipeline.keep_good(spark, docs, BIG)
    assert kept.columns == docs.columns
    marks = kept.join(labels, "doc_id").groupBy("quality").count().collect()
    n = {r["quality"]: r["count"] for r in marks}
    whole = {r["quality"]: r["count"] for r in labels.groupBy("quality").count().collect()}
    assert n[1] > 0.97 * whole[1] and n.get(0, 0) < 0.2 * whole[0]
    clean = corpus_pipeline.drop_toxic(spark, docs, BIG)
    assert clean.columns == docs.columns and docs.count() * 0.8 < clean.count() < docs.count()
    single = corpus_pipeline.drop_copies(spark, docs, BIG)
    assert single.columns == docs.columns and single.count() == single.select("text").distinct().count()
    assert single.select("text").distinct().count() >= docs.select("text").distinct().count() - 20
