"""Near duplicates by circulant MinHash: signatures, components and decisions against plain versions."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import buckets as B
from larkspur.llm import circulant as C

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, n=4):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def judged(rows, threshold=80):
    """(doc_id, n_shingles, component_id, kept) of every row, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            if a and 100 * len(a & sets[j]) >= threshold * len(a | sets[j]):
                root[find(j)] = find(i)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return [(key, len(sets[i]), least.get(find(i)), key == least.get(find(i))) for i, (key, _) in enumerate(rows)]


@settings(deadline=None)
@given(st.lists(st.text(st.sampled_from("aBc \t\n\x0b\x1c\x85 É") | st.characters(exclude_categories=["Cs"]), max_size=30), max_size=3))
def test_shingles(parts):
    text = " ".join(parts)
    got = C.Shingler(2).ngrams(text)
    assert len(got) == len(shingles(text, 2)) and np.all(got[1:] > got[:-1])


def test_coordinates_are_shifts_of_one_permutation():
    """Coordinate k is the least rank of the positions moved back by k; positions and ranks are permutations."""
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 7, 50_000)]
    got = C.signatures(sets, 5)
    for s, row in zip(sets, got, strict=True):
        for k in range(5):
            at = np.array([(int(x) - k) % (1 << 64) for x in C.positions(s).tolist()], np.uint64)
            assert row[k] == C.ranks(at).min()
    assert len(np.unique(C.positions(np.arange(100_000, dtype=np.uint64)))) == len(np.unique(C.ranks(np.arange(100_000, dtype=np.uint64)))) == 100_000


@pytest.mark.parametrize("similarity", [0.3, 0.8])
def test_coordinates_estimate_the_similarity(similarity):
    """The share of equal coordinates is the Jaccard similarity, with no more spread than independent ones have."""
    r = np.random.default_rng(5)
    common, own = int(200 * similarity), int(200 * (1 - similarity) / 2)
    means = []
    for _ in range(150):
        x = r.integers(0, 1 << 63, common + 2 * own, dtype=np.uint64)
        a, b = C.signatures([np.unique(x[: common + own]), np.unique(np.concatenate([x[:common], x[common + own :]]))], 48)
        means.append(np.mean(a == b))
    j = common / (common + 2 * own)
    assert abs(np.mean(means) - j) < 0.02 and np.std(means) < 1.25 * np.sqrt(j * (1 - j) / 48)


@pytest.mark.parametrize(("rows", "grams"), [(2048, 4_000_000), (2, 100)])
def test_documents(docs, rows, grams, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_ROWS", rows)
    monkeypatch.setattr(B, "BLOCK_GRAMS", grams)
    table = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = C.near_duplicates(docs)
    assert [c for c, _ in got.dtypes] == ["doc_id", "n_shingles", "component_id", "kept"]
    # a null doc_id with a null component is kept, as equal
    want = [(a, b, c, k or (a is None and c is None)) for a, b, c, k in judged(table)]
    assert Counter(map(tuple, got.collect())) == Counter(want)


def changed(words, at, mark):
    out = list(words)
    for i in at:
        out[i] = f"{mark}x{i}"
    return " ".join(out)


@pytest.mark.parametrize("rows", [2048, 7])
def test_groups_whose_pivot_links_only_some(spark, rows, monkeypatch):
    """Chains, stars around one text and pairs just at the threshold: what the pivots leave is found by the second step."""
    monkeypatch.setattr(B, "BLOCK_ROWS", rows)
    r = np.random.default_rng(7)
    texts = []
    for g in range(12):
        base = [f"g{g}w{k}" for k in range(100)]
        texts += [" ".join(base)]
        for k in range(12):  # at most 4 of 97 shingles change for each word: one or two words, far from each other
            texts.append(changed(base, r.choice(np.arange(5, 95, 9), 1 + k % 3, replace=False), f"m{k}"))
        chain = base
        for k in range(6):
            chain = changed(chain, [8 + 14 * k], f"c{k}").split()
            texts.append(" ".join(chain))
    texts += [f"single text number {k} of its own kind and {k * k} more" for k in range(30)] + ["", None, "one two", "ONE  two", "one two three"]
    table = [(int(i), t) for i, t in enumerate(r.permutation(np.array(texts, object)))]
    got = {x["doc_id"]: tuple(x) for x in C.near_duplicates(spark.createDataFrame(table, "doc_id long, text string"), recall=0.99999).collect()}
    assert got == {x[0]: x for x in judged(table)}


def test_pairs_at_the_threshold_are_found(spark):
    """32 of 40 shingles in common is 0.8 exactly; the registered recall finds nearly all such pairs, and nothing below."""
    rows = []
    for k in range(300):
        a = [f"p{k}w{i}" for i in range(39)]  # 36 shingles
        at = a + [f"p{k}n{i}" for i in range(9)]  # 45 shingles, 36 in common: 0.8
        below = a + [f"p{k}n{i}" for i in range(10)]
        rows += [(4 * k, " ".join(a)), (4 * k + 1, " ".join(at))] if k % 2 else [(4 * k, " ".join(a)), (4 * k + 2, " ".join(below))]
    got = {r["doc_id"]: r["component_id"] for r in C.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[4 * k + 2] == 4 * k + 2 for k in range(0, 300, 2))
    assert sum(got[4 * k + 1] == 4 * k for k in range(1, 300, 2)) >= 149


def test_nothing_and_clashing_columns(spark, no_docs):
    assert C.near_duplicates(no_docs).count() == 0
    text = " ".join(f"w{k}" for k in range(30))
    names = ["Key", "size", "text", "doc_id", "band", "component_id", "kept", "grams"]
    df = spark.createDataFrame([(k, t, *names) for k, t in enumerate([text, text.upper(), text + " more", "other"])], ["id", "body", *names])
    assert sorted(map(tuple, C.near_duplicates(df, id_col="id", text_col="body").collect())) == [(0, 27, 0, True), (1, 27, 0, False), (2, 28, 0, False), (3, 1, 3, True)]


def test_registered_query_against_all_pairs(spark, data):
    import pyarrow.parquet as pq

    from larkspur.llm.queries import op13_near_duplicates

    t = pq.read_table(f"{data}/documents.parquet")
    want = judged(list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True)))
    got = op13_near_duplicates(spark, data)
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"}
    assert sorted(map(tuple, got.collect())) == sorted(want)
