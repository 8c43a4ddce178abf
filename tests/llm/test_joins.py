"""Sharding, near duplicates, top-k and URL filters against brute force."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from larkspur.llm import buckets as B
from larkspur.llm import ngram_join as N
from larkspur.llm import topk as T
from larkspur.llm.components import components
from larkspur.llm.sharding import shard_rows
from larkspur.llm.topk import best_of_range, block_counts, top_k
from larkspur.llm.url_filter import filter_urls


def test_shards(docs, no_docs):
    rows = shard_rows(docs).collect()
    assert len(rows) == docs.count()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r["shard"] for r in rows if r["doc_id"] == 3}) == 1
    crcs = Counter((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows)
    assert crcs == Counter((str(r["doc_id"]), len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert shard_rows(no_docs).count() == 0


@pytest.mark.parametrize("weights", [[1.0] * 16, [1.0, 2.0, 0.5]])
def test_shards_follow_the_plain_draw(docs, weights):
    def drawn(key, k, w):
        bits = int(hashlib.md5(f"{k}:{key}".encode()).hexdigest()[:13], 16)
        return -w / math.log((bits + 0.5) / 2**52)

    for r in shard_rows(docs, len(weights), weights).collect():
        key = "\x00null" if r["doc_id"] is None else str(r["doc_id"])
        draws = [drawn(key, k, w) for k, w in enumerate([*weights, 1.0])]
        assert r["shard"] == draws.index(max(draws[:-1])) and r["grown_shard"] == draws.index(max(draws))


def test_weights_are_followed(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    n = {r["shard"]: r["count"] for r in shard_rows(df, 2, [1.0, 2.0]).groupBy("shard").count().collect()}
    assert n[1] / 6000 == pytest.approx(2 / 3, abs=0.03)


def grams(text):
    w = (text or "").split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(texts, threshold=0.8):
    """links and class of every distinct text."""
    distinct = sorted(set(texts))
    sets = {t: grams(t) for t in distinct}
    links, root = Counter(), {t: t for t in distinct}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    return links, {t: find(t) for t in distinct}


@pytest.mark.parametrize("block", [2048, 2])
def test_ngram_join(docs, block, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_ROWS", block)
    rows = docs.collect()
    links, root = brute([r["text"] or "" for r in rows])
    got = N.ngram_join(docs, recall=0.9999).select("doc_id", F.hex("text_key").alias("k"), "class_id", "n_copies", "n_links", "keep").collect()
    assert len(got) == len(rows)
    text_of = {hashlib.md5((r["text"] or "").encode()).hexdigest().upper(): r["text"] or "" for r in rows}
    least = defaultdict(lambda: math.inf)
    for r in rows:
        if r["doc_id"] is not None:
            least[root[r["text"] or ""]] = min(least[root[r["text"] or ""]], r["doc_id"])
    copies = Counter(r["text"] or "" for r in rows)
    for r in got:
        t = text_of[r["k"]]
        assert (r["n_links"], r["n_copies"], r["class_id"]) == (links[t], copies[t], least[root[t]])
    kept = N.drop_near_duplicates(docs, recall=0.9999).collect()
    assert len(kept) == len(set(root.values()))


def test_recall_of_the_registered_parameters(spark):
    """Pairs from just above the threshold: nearly all of those that brute force finds are found, and no other."""
    r = np.random.default_rng(12)
    rows, want = [], 0
    for k in range(400):
        words = [f"v{x}" for x in r.integers(0, 100_000, 100)]
        near = list(words)
        for at in r.choice(np.arange(5, 95, 12), int(r.integers(1, 3)), replace=False):
            near[at] = f"n{k}"
        a, b = grams(" ".join(words)), grams(" ".join(near))
        want += len(a & b) / len(a | b) >= 0.8
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(near))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    linked = {x["doc_id"] // 2 for x in N.ngram_join(df).filter("n_links > 0").collect()}
    close = {k for k in range(400) if len(grams(rows[2 * k][1]) & grams(rows[2 * k + 1][1])) >= 0.8 * len(grams(rows[2 * k][1]) | grams(rows[2 * k + 1][1]))}
    assert len(close) == want > 100 and linked <= close and len(linked) >= 0.98 * want


def test_copies_are_dropped_from_tables_with_any_columns(spark):
    text = " ".join(f"w{k}" for k in range(30))
    names = ["k", "i", "text_key", "doc_id", "rows", "kept_key", "kept_doc", "class_id", "keep"]
    rows = [(1, text, *names)] * 3 + [(2, text + " more", *names), (3, "other words than those", *names)]
    df = spark.createDataFrame(rows, ["id", "body", *names])
    got = N.drop_near_duplicates(df, id_col="id", text_col="body")
    assert got.columns == df.columns and sorted(tuple(r) for r in got.collect()) == sorted({rows[0], rows[4]})


def test_ngram_join_of_nothing(no_docs):
    assert N.ngram_join(no_docs).count() == 0 and N.drop_near_duplicates(no_docs).count() == 0


def test_near_pairs_counts_exactly():
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 62, 60, dtype=np.int64).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[r.permutation(60)[: r.integers(50, 60)]], r.integers(0, 1 << 62, 3).astype(np.uint64)])) for _ in range(150)]
    open_pair = np.triu(np.ones((150, 150), bool), 1)
    got = {tuple(p) for p in B.near_pairs(sets, open_pair, 0.8).tolist()}
    plain = [set(s.tolist()) for s in sets]
    assert got == {(i, j) for i in range(150) for j in range(i + 1, 150) if len(plain[i] & plain[j]) / len(plain[i] | plain[j]) >= 0.8}


def test_bands_reach_the_recall():
    for t in (0.5, 0.8, 0.95):
        b, r = N.choose_bands(t, 0.99)
        assert 1 - (1 - t**r) ** b >= 0.99 and b * r <= 48
    assert N.choose_bands(0.3, 0.995)[1] == 1
    with pytest.raises(ValueError, match="allow more"):
        N.choose_bands(0.01, 0.995)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(30, 31), (31, 30), (40, 40)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {k: 0 for k in range(21)} | {30: 30, 31: 30}


def test_top_k(spark):
    r = np.random.default_rng(5)
    rows = [(int(k), [float(x) for x in r.normal(size=6).round(1)]) for k in range(120)]
    rows += [(200, None), (201, [1.0, None]), (202, [float("nan"), 1.0]), (None, [1.0]), (203, []), (50, rows[50][1]), (204, [9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = top_k(df, F.col("vec_id") % 50 == 0, 5, range_rows=32, batch_rows=2).collect()
    whole = {k: [math.floor(256 * float(np.float32(x))) for x in v] for k, v in rows if k is not None and v is not None and not any(x is None or x != x for x in v)}
    for q in (0, 50, 100):
        dot = lambda v, q=q: sum(a * b for a, b in zip(whole[q], v, strict=False))
        want = sorted(((-dot(v), k) for k, v in whole.items() if k != q))[:5]
        assert [(x["rank"], x["vec_id"], x["score"]) for x in sorted((x for x in got if x["query_id"] == q), key=lambda x: x["rank"])] == [(i + 1, k, -s) for i, (s, k) in enumerate(want)]
    assert top_k(df.filter("vec_id < 0"), F.col("vec_id") % 50 == 0).count() == 0


def test_blocks_are_pruned():
    r = np.random.default_rng(6)
    vectors = np.concatenate([r.integers(-5, 5, (400, 8)), r.integers(200, 300, (20, 8))])
    *_, scored = best_of_range(np.array([-1]), np.full((1, 8), 3), np.arange(420), vectors, 5, 20)
    assert scored < 5


def test_near_copies_let_blocks_be_pruned(spark):
    """Tight groups of vectors: a query's group gives its k-th score, and the other groups' blocks are left out."""
    r = np.random.default_rng(8)
    centres = r.normal(size=(40, 16))
    rows = [(int(i * 130 + j), [float(x) for x in c + r.normal(size=16) * 0.01]) for i, c in enumerate(centres) for j in range(130)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ask = F.col("vec_id") % 50 == 0
    counts = block_counts(df, ask, range_rows=1500, batch_rows=40).groupBy().sum().first()
    assert counts["sum(scored)"] < 0.3 * counts["sum(blocks)"]
    ids = np.array([k for k, _ in rows])
    v = np.floor(256 * np.array([x for _, x in rows])).astype(np.int64)
    got = {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in top_k(df, ask, range_rows=1500, batch_rows=40).collect()}
    for at in np.flatnonzero(ids % 50 == 0):
        s = v @ v[at]
        want = sorted((-int(s[i]), int(ids[i])) for i in range(len(ids)) if i != at)[:5]
        assert [got[int(ids[at]), n + 1] for n in range(5)] == [(i, -x) for x, i in want]


def test_cells_are_left_out_before_they_are_sent(spark):
    """Batches and ranges of tight groups: the summed maxima of most cells lie below what the queries have already."""
    r = np.random.default_rng(9)
    centres = np.eye(32) * 4
    rows = [(int(i * 60 + j), [float(x) for x in np.append(c, [0.0] * (j % 3)) + r.normal(size=32 + j % 3) * 0.01]) for i, c in enumerate(centres) for j in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    seen = []
    whole = T.cells_of

    def counted(batches, ranges):
        cells, counts = whole(batches, ranges)
        seen.append(counts.first())
        return cells, counts

    T.cells_of = counted
    try:
        got = {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in top_k(df, F.col("vec_id") % 20 == 0, range_rows=60, batch_rows=1).collect()}
    finally:
        T.cells_of = whole
    assert seen[0]["cells_sent"] < 0.3 * seen[0]["cells"]
    v = np.zeros((len(rows), 34), np.int64)
    for i, (_, x) in enumerate(rows):
        v[i, : len(x)] = np.floor(256 * np.array(x))
    for q in range(0, len(rows), 20):
        s = v @ v[q]
        want = sorted((-int(s[i]), i) for i in range(len(rows)) if i != q)[:5]
        assert [got[q, n + 1] for n in range(5)] == [(i, -x) for x, i in want]


def test_names_that_differ_by_case_only(spark, data, docs):
    """Columns of a user that clash with made ones but for their case are replaced or kept, and never an error."""
    from larkspur.llm.bpe import encode_bpe  # noqa: F401
    from larkspur.llm.shared import add_columns, others

    df = docs.selectExpr("*", "1 as Host", "2 as Made", "3 as Blocked", "4 as N_Links")
    got = add_columns(df, ["text"], lambda: lambda x: [[1] * len(x)], [StructField("made", LongType())])
    assert got.columns == others(df.columns, ["made"]) + ["made"] and got.agg(F.sum("made")).first()[0] == df.count()
    urls = spark.createDataFrame([(1, "http://a.com/", 5, "x", "y")], ["id", "url", "fetched_at", "Host", "ENTRY"])
    entries = spark.createDataFrame([("domain", "a.com", "add", 1)], "kind string, value string, action string, at int")
    out = filter_urls(urls, entries)
    assert out.columns == ["id", "url", "fetched_at", "host", "blocked", "n_entries", "entry", "listed_since"] and out.select("host", "entry").first() == ("a.com", "a.com")
    assert N.ngram_join(df).count() == N.drop_near_duplicates(df.withColumn("Kept_Key", F.lit(0))).count() + N.ngram_join(df).filter("not keep").count() + 1


def test_url_filter_follows_the_dates(spark):
    entries = [("domain", "Bad.com", "add", "2024-01-10"), ("domain", "bad.com", "remove", "2024-02-01"), ("domain", "bad.com", "add", "2024-03-01"), ("domain", "bad.com", "add", "2024-03-05"), ("prefix", "ok.org/x/", "add", "2024-01-01"), ("domain", None, "add", "2024-01-01"), ("domain", "never.com", "remove", "2024-01-01")]
    e = spark.createDataFrame(entries, "kind string, value string, action string, at string").withColumn("at", F.to_date("at"))
    urls = [("http://a.bad.com/p", "2024-01-09"), ("http://a.bad.com/p", "2024-01-10"), ("https://u@BAD.com:80/", "2024-02-01"), ("http://bad.com", "2024-04-01"), ("http://notbad.com/", "2024-01-15"), ("http://ok.org/x/y?z", "2024-05-05"), ("http://ok.org/xy", "2024-05-05"), (None, "2024-01-15"), ("not a url", "2024-01-15"), ("http://bad.com/", None), ("http://bad.com/", "2024-01-15"), ("http://bad.com/", "2024-01-15")]
    c = spark.createDataFrame([(k, u, t, True) for k, (u, t) in enumerate(urls)], "n long, url string, fetched_at string, blocked boolean").withColumn("fetched_at", F.to_date("fetched_at"))
    got = {r["n"]: (r["blocked"], r["entry"]) for r in filter_urls(c, e).collect()}
    assert [got[k][0] for k in range(len(urls))] == [False, True, False, True, False, True, False, False, False, False, True, True]
    assert got[5][1] == "ok.org/x/" and got[3][1] == "bad.com"
    assert filter_urls(c.filter("n < 0"), e).count() == 0 and filter_urls(c, e.filter("kind = 'x'")).filter("blocked").count() == 0


def test_hosts():
    import re

    from larkspur.llm import url_filter as U

    def host(url):
        found = re.search(U.HOST, url.strip())
        return found.group(1).lower().rstrip(".") if found else ""

    cases = {
        "http://[2001:DB8::1]:80/x": "[2001:db8::1]",
        "http://a@x@bad.com/": "bad.com",
        "http://bad.com./p": "bad.com",
        "  https://Bad.com:8080?q": "bad.com",
        "http://u:p@bad.com#f": "bad.com",
        "bad.com/x": "",
        "http:///x": "",
    }
    assert {u: host(u) for u in cases} == cases


@pytest.mark.parametrize("most_broadcast", [250_000, 0])
def test_url_filter_reads_hard_urls_and_any_column_names(spark, most_broadcast):
    entries = [("domain", "bad.com", "add", 1), ("domain", "[2001:db8::1]", "add", 1), ("domain", "2.3.4", "add", 1), ("prefix", "ok.org/a/b", "add", 1), ("prefix", "ok.org/c/", "add", 1)]
    e = spark.createDataFrame(entries, "kind string, value string, action string, at int")
    urls = [" http://[2001:DB8::1]/", "http://a@x@bad.com/", "http://bad.com./", "http://1.2.3.4/", "http://ok.org/a/b?x", "http://ok.org/a/b/c", "http://ok.org/c/d/e/f", "http://ok.org/c", "http://ok.org" + "/long" * 5000, None]
    names = ["least", "row_number_of_capture", "capture_url", "capture_n", "n", "value", "kind", "at", "h", "salt", "blocked"]
    c = spark.createDataFrame([(u, 5, *[f"{n}{k}" for n in names]) for k, u in enumerate(urls)], ["url", "fetched_at", *names])
    c = c.unionByName(c.filter("url like '%x@bad%'"))
    got = filter_urls(c, e, most_broadcast=most_broadcast).collect()
    assert sorted((r["least"], r["blocked"]) for r in got) == sorted([*((f"least{k}", k in (0, 1, 2, 4, 6)) for k in range(len(urls))), ("least1", True)])
    assert all(r[n] == n + r["least"][5:] for r in got for n in names[:-1])
