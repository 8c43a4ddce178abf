"""Language identification with interpolated Kneser-Ney character models.

One model per language gives the probability of each character of a word (letters only, lower case,
with marks at both ends) from up to three characters before it. N-gram probabilities and backoff
weights of all languages lie in one array per order, sorted by the n-gram's hash. A text's language is
the one with the lowest cross-entropy per symbol; a text whose lowest cross-entropy is above a bound
that was calibrated on texts the counts didn't see is marked as rejected.

Tables of more than ``MOST_CELLS`` numbers aren't brought to the workers: they stay a stored table, and
texts are scored by joins, each different run of symbols once. The predictions are the same.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.shared import add_columns, fresh, others, quoted, settle, slices, split_remainder

ORDER = 4
CACHED_WORDS = 300_000
#: Words scored at once: each symbol takes a few numbers for each language meanwhile.
AT_ONCE = 16_384
DISCOUNT = 0.75
PRIME = np.uint64(0x100000001B3)
#: Letters of a word at most, in counting as in scoring; a longer word is several words.
LONGEST = 64
#: Different words of a task whose n-grams are counted at once.
COUNTED_WORDS = 200_000
#: Numbers in a model's tables (n-grams of all orders by languages) that the driver and each worker hold; larger ones are looked up by joins.
MOST_CELLS = 1 << 23


def letters(word: str) -> str:
    """The letters of a word, in lower case."""
    bare = word if word.isalpha() else word.strip(punctuation)
    return bare.lower() if bare.isalpha() else "".join(filter(str.isalpha, bare)).lower()


def cut(word: str) -> list[str]:
    """The letters of a word in parts of at most LONGEST; none without letters."""
    own = letters(word)
    return [own] if 0 < len(own) <= LONGEST else [own[a : a + LONGEST] for a in range(0, len(own), LONGEST)]


def symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words with the marks 2 (start) and 3 (end), each symbol's word, and whether it is a start."""
    marked = "".join(["\x02" + w + "\x03" for w in words])
    codes = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    start = codes == 2
    return codes, np.cumsum(start) - 1, start


def gram_hashes(codes: np.ndarray, start: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 1 to ``order``: the hash of the k symbols that end at each place; 0 where a word begins later than that."""
    place = np.arange(len(codes)) - np.maximum.accumulate(np.where(start, np.arange(len(codes)), 0))
    out, h = [], np.zeros(len(codes), np.uint64)
    for k in range(order):
        before = np.zeros(len(codes), np.uint64)
        before[k:] = codes[: len(codes) - k]
        # symbols are added from the last to the first, so a context's hash can't be had by cutting; it is looked up by its own place
        h = (h ^ ((before + np.uint64(k * 0x110000)) * np.uint64(0x9E3779B97F4A7C15))) * PRIME
        h = h ^ (h >> np.uint64(29))
        out.append(np.where(place >= k, h | np.uint64(1), 0).astype(np.uint64))
    return out


class Model:
    """Sorted hashes and, by language, log probabilities (nan: not seen) and log backoff weights (0: context not seen) of each order.

    ``stored`` holds them instead where they are too many: lang (from 0), k, gram, p and weight, for ``order`` orders.
    """

    def __init__(self, langs: list[str], tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]], floor: np.ndarray, bound: np.ndarray, stored: DataFrame | None = None, order: int = ORDER):
        self.langs, self.tables, self.floor, self.bound, self.stored, self.order = langs, tables, floor, bound, stored, order
        # one more row at the end stands for what isn't found; its hash 0 is no n-gram's
        self.padded = [(np.append(h, np.uint64(0)), np.vstack([s, np.full(len(langs), np.nan)]), np.vstack([w, np.zeros(len(langs))])) for h, s, w in tables]

    def __getstate__(self):
        return self.langs, self.tables, self.floor, self.bound

    def __setstate__(self, state):
        self.__init__(*state)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """One row per word: log probability by language, then the number of symbols."""
        codes, word, start = symbols(words)
        grams = gram_hashes(codes, start, len(self.tables))
        size = len(self.langs)
        p = np.tile(self.floor, (len(codes), 1))
        weights = None  # of the n-gram that ends at each place: the context of the next place
        for gram, (hashes, seen, weight) in zip(grams, self.padded, strict=True):
            at = np.searchsorted(hashes[:-1], gram)
            at[hashes[at] != gram] = len(hashes) - 1  # also where the n-gram would begin before its word
            if weights is not None:
                p[1:] += weights[:-1]
            found = seen[at]
            np.copyto(p, found, where=~np.isnan(found))
            weights = weight[at]
        scored = ~start
        out = np.zeros((len(words), size + 1))
        for c in range(size):
            out[:, c] = np.bincount(word[scored], p[scored, c], len(words))
        out[:, size] = np.bincount(word[scored], minlength=len(words))
        return out


def count_grams(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, k, gram, context, rest and n of all n-grams; context: without the last symbol, rest: without the first."""

    def counted(seen: dict[str, Counter[str]]) -> Iterator[pa.RecordBatch]:
        for lang, raw in sorted(seen.items()):
            own: Counter[str] = Counter()
            for w, n in raw.items():
                for part in cut(w):
                    own[part] += n
            if not own:
                continue
            codes, word, start = symbols(list(own))
            times, grams = np.fromiter(own.values(), np.int64, len(own)), gram_hashes(codes, start, order)
            for k in range(order):
                use = (grams[k] != 0) & ~start
                coded = pa.array(grams[k][use]).dictionary_encode()
                gram, which = coded.dictionary.to_numpy(), coded.indices.to_numpy()
                n = np.bincount(which, times[word[use]], len(gram)).astype(np.int64)
                first = np.empty(len(gram), np.int64)
                first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
                at = np.flatnonzero(use)[first]
                context = grams[k - 1][at - 1] if k else np.zeros(len(at), np.uint64)
                rest = grams[k - 1][at] if k else np.zeros(len(at), np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at)), pa.array(np.full(len(at), k + 1, np.int32)), *(pa.array(x.view(np.int64)) for x in (gram, context, rest)), pa.array(n)],
                    names=["lang", "k", "gram", "context", "rest", "n"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter[str]] = {}
        for batch in (part for whole in batches for part in slices(whole, 2 << 20)):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(text.split())
            if sum(map(len, seen.values())) > COUNTED_WORDS:
                yield from counted(seen)
                seen = {}
        yield from counted(seen)

    made = texts.select("lang", "text").mapInArrow(run, "lang string, k int, gram long, context long, rest long, n long")
    return made.groupBy("lang", "k", "gram", "context", "rest").agg(F.sum("n").alias("n"))


def kneser_ney(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, k, gram, p (what the order gives by itself), context and its backoff weight.

    The highest order counts occurrences; the lower ones count the symbols seen before the n-gram. An
    n-gram that begins a word has nothing before it and keeps its occurrences.
    """
    before = grams.filter("k > 1").groupBy("lang", (F.col("k") - 1).alias("k"), F.col("rest").alias("gram")).agg(F.count("*").alias("before"))
    counted = grams.join(before, ["lang", "k", "gram"], "left").withColumn("c", F.when((F.col("k") == order) | F.col("before").isNull(), F.col("n")).otherwise(F.col("before")))
    total = counted.groupBy("lang", "k", "context").agg(F.sum("c").alias("total"), F.count("*").alias("types"))
    d = F.lit(DISCOUNT)
    return counted.join(total, ["lang", "k", "context"]).select(
        "lang", "k", "gram", "context", "rest", ((F.col("c") - d) / F.col("total")).alias("p"), (d * F.col("types") / F.col("total")).alias("gamma")
    )


def interpolated(own: DataFrame, n_symbols: int, order: int) -> DataFrame:
    """lang, k, gram, its log probability with those of the shorter n-grams, and its log backoff weight as a context (0: none).

    The mark of a word's start is a context that is never counted as a symbol: its probability is null.
    """
    level = own.filter("k = 1").withColumn("p", F.col("p") + F.col("gamma") / (n_symbols + 1)).select("lang", "k", "gram", "p")
    levels = [level]
    for k in range(2, order + 1):
        lower = level.select("lang", F.col("gram").alias("rest"), F.col("p").alias("lower"))
        level = own.filter(F.col("k") == k).join(lower, ["lang", "rest"]).select("lang", "k", "gram", (F.col("p") + F.col("gamma") * F.col("lower")).alias("p"))
        levels.append(level)
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    weights = own.filter("k > 1").groupBy("lang", (F.col("k") - 1).alias("k"), F.col("context").alias("gram")).agg(F.max("gamma").alias("gamma"))
    return out.join(weights, ["lang", "k", "gram"], "full").select("lang", "k", "gram", F.log("p").alias("p"), F.coalesce(F.log("gamma"), F.lit(0.0)).alias("weight"))


def floors(own: DataFrame, langs: list[str], n_symbols: int) -> np.ndarray:
    """By language, the log probability of a symbol that was never seen."""
    floor = np.full(len(langs), -np.log(n_symbols + 1))
    for r in own.filter("k = 1").groupBy("lang").agg(F.max("gamma").alias("gamma")).toLocalIterator():
        floor[langs.index(r["lang"])] += np.log(r["gamma"])
    return floor


def arrays(table: DataFrame, n_langs: int, order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The table of lang, k, gram, p and weight as sorted arrays."""
    held, tables = table.toArrow(), []
    orders = held["k"].to_numpy()
    for k in range(1, order + 1):
        lang, gram, p, weight = (held[c].to_numpy()[orders == k] for c in ("lang", "gram", "p", "weight"))
        hashes, at = np.unique(gram.view(np.uint64), return_inverse=True)
        seen, weights = np.full((len(hashes), n_langs), np.nan), np.zeros((len(hashes), n_langs))
        seen[at, lang], weights[at, lang] = p, weight  # a null p is nan here
        tables.append((hashes, seen, weights))
    return tables


def fit(
    docs: DataFrame, most_rows: int | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, most_cells: int = MOST_CELLS
) -> Model:
    """Models from all different texts of each language outside the held-out quarter, or about ``most_rows`` of each if that is given.

    What is held in memory are the n-grams, at most ``most_cells`` numbers; more stay a stored table. Every
    eighth text, by hash, isn't counted but used to calibrate the bound of rejection: mean and four
    deviations of the cross-entropy in its own language.
    """
    lang, text = F.col(quoted(lang_col)), F.col(quoted(text_col))
    known = docs.filter(F.expr(f"{split_remainder(id_col)} <> 2") & lang.isNotNull() & text.isNotNull()).select(lang.alias("lang"), text.alias("text"))
    if most_rows is None:
        langs = sorted(r["lang"] for r in known.select("lang").distinct().toLocalIterator())
    else:
        different = known.select("lang", F.xxhash64("text").alias("h")).distinct().groupBy("lang").agg(F.count("*").alias("n"))
        share = {r["lang"]: min(1.0, most_rows / r["n"]) for r in different.toLocalIterator()}
        langs = sorted(share)
    if not langs:
        return Model([], [], np.zeros(0), np.zeros(0))
    if most_rows is not None:
        draw = F.pmod(F.xxhash64(F.lit("lang"), "text"), F.lit(1 << 20)) / float(1 << 20)
        known = known.filter(draw < F.coalesce(*[F.when(F.col("lang") == x, F.lit(s)) for x, s in share.items()]))
    fold = F.pmod(F.xxhash64(F.lit("fold"), "text"), F.lit(8))
    # each text is dealt by its whole content once: the counted ones here, the others below
    own = settle(kneser_ney(settle(count_grams(known.filter(fold > 0).distinct(), order)), order))
    sizes = {r["k"]: r["n"] for r in own.groupBy("k").agg(F.count_distinct("gram").alias("n")).toLocalIterator()}
    number = (F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang")) - 1).cast("int").alias("lang")
    table = interpolated(own, sizes.get(1, 0), order).select(number, "k", "gram", "p", "weight")
    small = sum(sizes.values()) * len(langs) <= most_cells
    tables = arrays(table, len(langs), order) if small else []
    model = Model(langs, tables, floors(own, langs, sizes.get(1, 0)), np.full(len(langs), np.inf), None if small else settle(table), order)
    of_lang = F.element_at("entropies", F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang")).cast("int"))
    judged = entropies(known.filter(fold == 0).distinct(), model).withColumn("own", of_lang).filter("own is not null")
    for r in judged.groupBy("lang").agg(F.avg("own").alias("m"), F.stddev_pop("own").alias("s")).toLocalIterator():
        model.bound[langs.index(r["lang"])] = r["m"] + 4 * max(r["s"], 0.02)
    return model


def runs_of(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Of all symbols of all texts: the number of the text, the hash of the run (the longest n-gram that ends there), the n-grams by order, and whether it is scored."""
    parts, owner = [], []
    for i, t in enumerate(texts):
        own = [p for w in (t.as_py() or "").split() for p in cut(w)]
        parts += own
        owner += [i] * len(own)
    codes, word, start = symbols(parts)
    grams, run = gram_hashes(codes, start, order), np.zeros(len(codes), np.uint64)
    for gram in grams:
        run = np.where(gram != 0, gram, run)
    return np.array(owner, np.int64)[word], run, grams, ~start


def joined_entropies(df: DataFrame, model: Model, text_col: str, keep: list[str]) -> DataFrame:
    """The columns that :func:`entropies` gives, by joins with the stored n-grams. Equal texts, and equal runs of symbols, are scored once."""
    order, langs = model.order, len(model.langs)
    taken = [*df.columns, "entropies", "n_symbols"]
    key, own = fresh(taken, "text_key"), fresh(taken, "own_key")
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    texts = settle(df.select(F.unhex(F.md5(text)).alias("key"), text.alias("text")).groupBy("key").agg(F.first("text").alias("text")))

    def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2 << 20)):
            row, run, _, scored = runs_of(batch.column(1), order)
            at, counts = np.unique(np.stack([row.astype(np.uint64), run])[:, scored], axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[0].astype(np.int64))), pa.array(at[1].view(np.int64)), pa.array(counts)], names=["key", "run", "n"])

    def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2 << 20)):
            _, run, grams, scored = runs_of(batch.column(0), order)
            places = np.flatnonzero(scored)
            places = places[np.unique(run[places], return_index=True)[1]]
            for k in range(order):
                use = places[grams[k][places] != 0]
                context = grams[k - 1][use - 1] if k else np.zeros(len(use), np.uint64)  # it ends one place before
                columns = [*(pa.array(x.view(np.int64)) for x in (run[use], grams[k][use], context)), pa.array(np.full(len(use), k + 1, np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["run", "gram", "context", "k"])

    uses = settle(texts.mapInArrow(used, "key binary, run long, n long"))
    spelling = settle(texts.select("text").mapInArrow(spelt, "run long, gram long, context long, k int").distinct())
    table = model.stored
    found = spelling.join(table.filter("p is not null").select("k", "gram", "lang", "p"), ["k", "gram"])
    best = found.groupBy("run", "lang").agg(F.max(F.struct("k", "p")).alias("best"))
    context = table.filter("weight <> 0").select((F.col("k") + 1).alias("k"), F.col("gram").alias("context"), "lang", "weight")
    back = spelling.join(context, ["k", "context"]).select("run", "lang", "k", "weight")
    each = spelling.select("run").distinct().withColumn("lang", F.explode(F.sequence(F.lit(0), F.lit(langs - 1))))
    floor = F.element_at(F.array(*[F.lit(float(x)) for x in model.floor]), F.col("lang") + 1)
    scored = each.join(best, ["run", "lang"], "left").select("run", "lang", F.coalesce("best.k", F.lit(0)).alias("found"), F.coalesce("best.p", floor).alias("p"))
    # the backoff weights of the orders above the one that was found
    above = scored.join(back, ["run", "lang"]).filter("k > found").groupBy("run", "lang").agg(F.sum("weight").alias("weight"))
    scores = settle(scored.join(above, ["run", "lang"], "left").select("run", "lang", (F.col("p") + F.coalesce("weight", F.lit(0.0))).alias("score")))
    sums = uses.join(scores, "run").groupBy("key", "lang").agg(F.sum(F.col("score") * F.col("n")).alias("score"), F.sum("n").alias("n"))
    whole = sums.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("lang", (-F.col("score") / F.col("n")).alias("e")))).alias("by_lang"), F.max("n").alias("n_symbols"))
    whole = whole.select(F.col("key").alias(own), F.transform("by_lang", lambda x: x["e"]).alias("entropies"), "n_symbols")
    rows = df.select(*[F.col(quoted(c)) for c in keep], F.unhex(F.md5(text)).alias(key))
    out = rows.join(whole, F.col(key) == F.col(own), "left")
    return out.select(*[F.col(quoted(c)) for c in keep], "entropies", F.coalesce("n_symbols", F.lit(0)).alias("n_symbols"))


def entropies(df: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add entropies (array by language, nats per symbol; null without letters) and n_symbols to every row."""
    if model.stored is not None:
        return joined_entropies(df, model, text_col, others(df.columns if keep is None else keep, ["entropies", "n_symbols"]))
    sent = df.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("entropies", T.ArrayType(T.DoubleType())), T.StructField("n_symbols", T.LongType())]

    def make():
        m, size = sent.value, len(sent.value.langs)
        known: dict[str, int] = {}
        store = {"rows": np.zeros((1, size + 1))}

        def learn(new: list[str]) -> None:
            parts = [cut(w) for w in new]
            words = [p for own in parts for p in own]
            rows = np.zeros((len(new), size + 1))
            if words:
                owner = np.repeat(np.arange(len(new)), np.fromiter(map(len, parts), np.int64, len(parts)))
                scores = np.concatenate([m.word_scores(words[a : a + AT_ONCE]) for a in range(0, len(words), AT_ONCE)])
                for c in range(size + 1):
                    rows[:, c] = np.bincount(owner, scores[:, c], len(new))
            known.update(zip(new, range(len(store["rows"]), len(store["rows"]) + len(new)), strict=True))
            store["rows"] = np.concatenate([store["rows"], rows])

        def work(texts: pa.Array) -> list:
            if len(known) > CACHED_WORDS:
                known.clear()
                store["rows"] = np.zeros((1, size + 1))
            split = [(t.as_py() or "").split() for t in texts]
            learn(list({w for words in split for w in words if w not in known}))
            totals = np.array([store["rows"][np.fromiter(map(known.__getitem__, w), np.int64, len(w))].sum(0) for w in split]).reshape(-1, size + 1)
            n = totals[:, size]
            values = [(-t[:size] / t[size]).tolist() if t[size] and size else None for t in totals]
            return [values, n.astype(np.int64)]

        return work

    return add_columns(df, [text_col], make, fields, keep)


def languages(df: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, reject: bool = True) -> DataFrame:
    """Add lang_pred, score, cross_entropy and rejected to every row.

    ``und`` with score 0 for a null text or one without letters, and, with ``reject``, for one that
    fits no language; ties go to the first language by name. The score is the posterior of equal
    priors, with the evidence of at most 20 symbols. Existing columns of these names are replaced.
    """
    made = {"lang_pred", "score", "cross_entropy", "rejected", "entropies", "n_symbols"}
    kept = others(df.columns if keep is None else keep, list(made))
    if not model.langs:
        none = [F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(False).alias("rejected")]
        return df.select(*[F.col(quoted(c)) for c in kept], *none)
    scored = entropies(df, model, text_col, keep=kept)
    names, bounds = F.array(*[F.lit(x) for x in model.langs]), F.array(*[F.lit(float(x)) for x in model.bound])
    least = F.array_min("entropies")
    place = F.array_position("entropies", least).cast("int")
    weight = F.least(F.col("n_symbols"), F.lit(20)).cast("double")
    posterior = 1 / F.aggregate(F.transform("entropies", lambda e: F.exp((least - e) * weight)), F.lit(0.0), lambda a, x: a + x)
    rejected = F.coalesce(least > F.element_at(bounds, place), F.lit(False))
    none = F.col("entropies").isNull()
    lost = none | rejected if reject else none
    return scored.select(
        *[F.col(quoted(c)) for c in kept],
        F.when(lost, "und").otherwise(F.element_at(names, place)).alias("lang_pred"),
        F.when(none, 0.0).otherwise(posterior).alias("score"),
        least.alias("cross_entropy"),
        rejected.alias("rejected"),
    )


def language_of_documents(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy and rejected for every row; rejection is told but changes no prediction."""
    found = languages(docs, fit(docs, **options), keep=["doc_id"], reject=False)
    return found.select("doc_id", F.expr(f"{split_remainder()} = 2").alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
