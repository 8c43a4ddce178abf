"""Importance resampling: words and hashes against regular expressions and zlib, the draw against a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import resampling as R

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def runs(text, low, high):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(low, high + 1) for i in range(len(w) - n + 1)]


@pytest.mark.parametrize(("low", "high"), [(1, 1), (1, 3), (2, 2)])
@settings(deadline=None)
@given(texts=st.lists(st.none() | st.text(st.sampled_from("aZ9 -é漢\x00 '\n") | st.characters(exclude_categories=["Cs"]), max_size=40), max_size=8), start=st.integers(0, 2))
def test_features(low, high, texts, start):
    column = pa.array(["Left out", None, *texts], pa.string()).slice(start)
    kept = ["Left out", None, *texts][start:]
    row, hashes, n_words = R.features(column, low, high)
    assert n_words.tolist() == [len(words(t)) for t in kept]
    got = Counter(zip(row.tolist(), hashes.tolist(), strict=True))
    assert got == Counter((i, zlib.crc32(x.encode())) for i, t in enumerate(kept) for x in runs(t, low, high))


def test_long_words():
    text = "a" * 5000 + " " + "b" * R.LONG + " " + "c" * (R.LONG + 1) + " d"
    _, hashes, _ = R.features(pa.array([text]))
    assert sorted(hashes.tolist()) == sorted(zlib.crc32(w.encode()) for w in text.split())


def drawn(docs, target, percent=10, least=20, buckets=10_000, low=1, high=1):
    count = lambda texts: Counter(zlib.crc32(x.encode()) % buckets for t in texts for x in runs(t, low, high))
    s, t = count(x for _, x in docs), count(target)
    big_s, big_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    out = []
    for key, text in docs:
        own = [zlib.crc32(x.encode()) % buckets for x in runs(text, low, high)]
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t))) for b in own)
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text))])
    fit = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): i + 1 for i, r in enumerate(fit[: len(fit) * percent // 100])}
    return [(*r[:4], rank.get(id(r))) for r in out]


def test_draw(docs, texts, spark):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    target = [texts[2], None, "", "stone river quiet"]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    for options in ({}, {"percent": 60, "least_words": 1, "buckets": 64, "low": 1, "high": 2}, {"percent": 100, "least_words": 0}):
        plain = {"least" if k == "least_words" else k: v for k, v in options.items()}
        got = sorted((tuple(r) for r in R.resample(docs, bench, **options).collect()), key=str)
        assert got == sorted(drawn(rows, target, **plain), key=str)
        assert sum(r[4] is not None for r in got) == sum(len(words(t)) >= plain.get("least", 20) for _, t in rows) * plain.get("percent", 10) // 100


def test_draw_of_empty_tables_and_any_columns(docs, no_docs, spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert R.resample(no_docs, bench).count() == 0
    names = ["n_features", "Weight", "score", "rank", "bucket", "part", "place", "h"]
    odd = docs.selectExpr("doc_id as key", "text as Body", *[f"'x' as {c}" for c in names])
    got = sorted((tuple(r) for r in R.resample(odd, bench, percent=50, id_col="key", text_col="body").collect()), key=str)
    assert got == sorted(drawn([(r["doc_id"], r["text"]) for r in docs.collect()], [], percent=50), key=str)


def test_registered_query_on_whole_tables(spark, data):
    import pyarrow.parquet as pq

    from larkspur.llm.queries import op12_resampling

    docs, bench = (pq.read_table(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    want = drawn(list(zip(docs["doc_id"].to_pylist(), docs["text"].to_pylist(), strict=True)), bench["text"].to_pylist())
    got = op12_resampling(spark, data)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    assert sum(r[4] is not None for r in want) > 5
    assert np.all(np.diff(sorted(r[4] for r in want if r[4])) == 1)
