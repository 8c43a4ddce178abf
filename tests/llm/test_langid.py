"""What the language models count: all different texts outside the held-out quarter, however many and however often copied."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import langid
from larkspur.llm.shared import split_remainder


def word(n: int) -> str:
    return "".join(chr(97 + n // 26**k % 26) for k in range(3))


@pytest.fixture(scope="module")
def many(spark):
    texts = [f"{word(k)} {word(k * 7)} {word(k)}" for k in range(5_000)]
    rows = [(k, t, "en") for k, t in enumerate(texts)]
    rows += [(10_000 + k, "same text again" if k % 100 else f"rare{word(k)}", "fr") for k in range(6_000)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_all_texts_are_counted(many):
    model = langid.fit(many)
    used = many.filter(F.expr(f"{split_remainder()} <> 2") & (F.pmod(F.xxhash64(F.lit("fold"), "text"), F.lit(8)) > 0)).select("lang", "text").distinct().collect()
    for i, lang in enumerate(model.langs):
        texts = [r["text"] for r in used if r["lang"] == lang]
        assert lang != "en" or len(texts) > 2_500  # more than the former limit
        codes, _, start = langid.symbols([w for t in texts for w in t.split()])
        for grams, (hashes, seen, _) in zip(langid.gram_hashes(codes, start, langid.ORDER), model.tables, strict=True):
            assert set(hashes[~np.isnan(seen[:, i])].tolist()) == set(grams[(grams != 0) & ~start].tolist())


def test_repeated_words_count_as_often_as_they_occur(many):
    got = {(r["k"], r["gram"]): r["n"] for r in langid.count_grams(many.filter("lang = 'en'")).collect()}
    codes, _, start = langid.symbols([w for r in many.filter("lang = 'en'").collect() for w in r["text"].split()])
    plain = Counter()
    for k, grams in enumerate(langid.gram_hashes(codes, start, langid.ORDER)):
        plain.update((k + 1, g) for g in grams[(grams != 0) & ~start].view(np.int64).tolist())
    assert got == plain


def test_more_ngrams_than_workers_hold_give_the_same(many, docs):
    """Tables that stay stored and are looked up by joins give the scores that arrays in the workers give."""
    small, large = langid.fit(many), langid.fit(many, most_cells=1_000)
    assert small.stored is None and large.stored is not None and not large.tables
    assert np.allclose(small.bound, large.bound)
    odd = docs.unionByName(many.limit(50).selectExpr("doc_id", "text", "lang", "'s' as source", "0L as n_chars")).withColumn("Entropies", F.lit(1))
    shown = lambda m: sorted((tuple(r) for r in langid.languages(odd, m).drop("n_chars", "source").collect()), key=str)
    for a, b in zip(shown(small), shown(large), strict=True):
        assert [x if not isinstance(x, float) else pytest.approx(x) for x in a] == list(b)


def test_probabilities_are_those_of_plain_kneser_ney(spark):
    """Interpolated Kneser-Ney by its definition, over strings instead of hashes, for every symbol of known and new words."""
    words = ["banana", "band", "ban", "nab", "cab", "abba"] * 3 + ["dan"]
    texts = [(k, " ".join(words[k % 5 :]), "en") for k in range(40)]
    own = langid.kneser_ney(langid.count_grams(spark.createDataFrame(texts, "doc_id long, text string, lang string"), 3), 3)
    n_symbols = own.filter("k = 1").count()
    table = langid.interpolated(own, n_symbols, 3).select(F.lit(0).alias("lang"), "k", "gram", "p", "weight")
    model = langid.Model(["en"], langid.arrays(table, 1, 3), langid.floors(own, ["en"], n_symbols), np.array([np.inf]), order=3)
    n = Counter()
    for _, t, _ in texts:
        for w in t.split():
            m = f"<{w}>"
            n.update(m[i - k + 1 : i + 1] for i in range(1, len(m)) for k in range(1, 4) if i - k + 1 >= 0)
    before = Counter(g[1:] for g in n if len(g) > 1)
    count = {g: c if len(g) == 3 or g not in before else before[g] for g, c in n.items()}
    d = langid.DISCOUNT

    def p(g):
        same = [c for h, c in count.items() if len(h) == len(g) and h[:-1] == g[:-1]]
        if not same:  # the context was never seen
            return p(g[1:]) if len(g) > 1 else 1 / (n_symbols + 1)
        lower = p(g[1:]) if len(g) > 1 else 1 / (n_symbols + 1)
        return max(count.get(g, 0) - d, 0) / sum(same) + d * len(same) / sum(same) * lower

    for word in ["banana", "dab", "c", "zab", "nabz"]:
        m = f"<{word}>"
        want = sum(np.log(p(m[max(0, i - 2) : i + 1])) for i in range(1, len(m)))
        assert model.word_scores([word])[0].tolist() == pytest.approx([want, len(m) - 1])
