"""Role rules: how well a column tells the target in several encodings, and what follows for its role.

One stored table of cells (feature, value, fold; rows and target sums) answers for all columns. From it come
the values' own order, ten quantile bins, frequencies, out-of-fold target means, the order of texts and the
null indicator; each is a set of scores with rows and target sums, and one job over all of them
gives their normalised ginis. A column with few different values has few cells, whatever its rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur import roles as R
from larkspur.frame import Frame, quoted
from larkspur.functions.metrics import gini_of_sums, perfect_gini
from larkspur.functions.ordered import running
from larkspur.operators.categorical import ALPHAS, numbered
from larkspur.storage import stored

KINDS = ("raw", "binned", "encoded", "freq", "ord", "nulls")


@dataclass
class Limits:
    """Thresholds of the rules (fixed values)."""

    numeric_unique_rate: float = 0.999
    max_to_3rd_rate: float = 1.1
    binning_enc_rate: float = 2.0
    raw_decr_rate: float = 1.1
    max_score_rate: float = 0.2
    abs_score_val: float = 0.04


def role_cells(frame: Frame, numbers: list[str], categories: list[str], targets: list[str], fold: str) -> DataFrame:
    """feature, number or text, fold, n, and s and q (sum and sum of squares) of each target: one row for each value and fold; null values have cells."""
    kinds = dict(frame.df.dtypes)
    number = {c: F.col(quoted(c)).cast("double") for c in numbers}
    entries = [F.struct(F.lit(c).alias("feature"), F.when(~F.isnan(x), x).alias("number"), F.lit(None).cast("string").alias("text")) for c, x in number.items()]
    text = {c: F.col(quoted(c)) if kinds[c] == "string" else F.col(quoted(c)).cast("string") for c in categories}
    entries += [F.struct(F.lit(c).alias("feature"), F.lit(None).cast("double").alias("number"), x.alias("text")) for c, x in text.items()]
    outputs = [F.col(quoted(t)).cast("double").alias(f"y{k}") for k, t in enumerate(targets)]
    cells = frame.df.select(F.explode(F.array(*entries)).alias("x"), F.col(quoted(fold)).cast("int").alias("fold"), *outputs)
    sums = [x for k in range(len(targets)) for x in (F.sum(f"y{k}").alias(f"s{k}"), F.sum(F.col(f"y{k}") ** 2).alias(f"q{k}"))]
    return stored(cells.groupBy("x.feature", "x.number", "x.text", "fold").agg(F.count("*").alias("n"), *sums))


def bin_cuts(values: DataFrame, bins: int = 10) -> DataFrame:
    """feature and cuts: the different inner quantiles, interpolated, of the numbers (feature, number, n)."""
    counted = running(values.filter("number is not null"), "number", {"n_": F.col("n")}, ["feature"])
    first, end, last = F.col("cum_n_") - F.col("n_"), F.col("cum_n_"), F.col("all_n_") - 1
    made = []
    for k in range(1, bins):
        place = F.lit(k / bins) * last
        low, high = (F.max(F.when((at >= first) & (at < end), F.col("number"))) for at in (F.floor(place), F.ceil(place)))
        made.append(low + (high - low) * F.max(place - F.floor(place)))
    return counted.groupBy("feature").agg(F.array_sort(F.array_distinct(F.array(*made))).alias("cuts"))


def fold_out(keyed: DataFrame, targets: int, classes: bool) -> DataFrame:
    """feature, kind, output, p, n and s of keyed cells (feature, kind, key, fold, n, kn, and s, q and ks by output).

    p is the key's target mean in the other folds, shrunk to their mean by the smoothing with the least
    loss (log-loss for classes, squared error else; the first of equal ones); n and s count the rows that have a value.
    """
    names = ["n", *[f"s{k}" for k in range(targets)]]
    keys = keyed.groupBy("feature", "kind", "key").agg(*[F.sum(c).alias(f"all_{c}") for c in names])
    folds = stored(keyed.groupBy("feature", "kind", "fold").agg(*[F.sum(c).alias(f"fold_{c}") for c in names]))
    whole = folds.groupBy("feature", "kind").agg(*[F.sum(f"fold_{c}").alias(f"whole_{c}") for c in names])
    priors = folds.join(whole, ["feature", "kind"]).select("feature", "kind", "fold", *[(F.col(f"whole_{c}") - F.col(f"fold_{c}")).alias(f"other_{c}") for c in names])
    # a row for each column, encoding and fold
    cells = keyed.join(keys, ["feature", "kind", "key"]).join(F.broadcast(priors), ["feature", "kind", "fold"])
    each = F.array(*[F.struct(F.lit(k).alias("output"), *[F.col(f"{c}{k}").alias(c) for c in ("s", "q", "ks", "all_s", "other_s")]) for k in range(targets)])
    cells = stored(cells.select("feature", "kind", "n", "kn", "all_n", "other_n", F.explode(each).alias("o")).select("feature", "kind", "n", "kn", "all_n", "other_n", "o.*"))
    mean = lambda a: (F.col("all_s") - F.col("s") + F.try_divide(a * F.col("other_s"), F.col("other_n"))) / (F.col("all_n") - F.col("n") + a)

    def loss(a: float) -> Column:
        p = mean(F.lit(a))
        if classes:
            p = F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7))
            return -(F.col("s") * F.log(p) + (F.col("n") - F.col("s")) * F.log(1 - p))
        return F.col("q") - 2 * p * F.col("s") + F.col("n") * p * p

    losses = F.array_min(F.array(*[F.struct(F.sum(loss(a)).alias("loss"), F.lit(a).alias("alpha")) for a in ALPHAS]))
    best = cells.groupBy("feature", "kind", "output").agg(losses["alpha"].alias("alpha"))
    scored = cells.join(F.broadcast(best), ["feature", "kind", "output"])
    return scored.filter("kn > 0").select("feature", "kind", "output", mean(F.col("alpha")).alias("p"), F.col("kn").alias("n"), F.col("ks").alias("s"))


def role_stats(frame: Frame, numbers: list[str], categories: list[str], target: str, fold: str, task: str = "binary", unknown: int = 5) -> DataFrame:
    """One row per column: feature, is_number, n_unique, unique_rate, top_freq, null_rate, and the size of the gini of each encoding.

    Encodings: raw and binned (numbers only), encoded (out-of-fold target means; values of at most
    ``unknown`` rows count as one), freq, ord (categories only: the order of the texts, rare ones last) and nulls (the null
    indicator). Ginis but the last are over the rows that have a value; one that a column doesn't have is null,
    one that can't be told is 0. The target of a class task ("multiclass") is told by each of its codes, and the ginis' mean counts.
    """
    df, targets = frame.df, [target]
    if task == "multiclass":
        codes = [r[0] for r in df.select(target).distinct().orderBy(target).limit(1001).collect()]
        if len(codes) > 1000:
            raise ValueError("a class target has at most 1000 classes")
        targets = [f"class_{k}__" for k in range(len(codes))]
        df = df.withColumns({t: (F.col(quoted(target)) == F.lit(c)).cast("double") for t, c in zip(targets, codes, strict=True)})
        frame = Frame(df, frame.roles, frame.keys)
    outputs = range(len(targets))
    cells = role_cells(frame, numbers, categories, targets, fold)
    have = F.coalesce(F.col("number").isNotNull() | F.col("text").isNotNull(), F.lit(False))
    sums = [F.sum(f"s{k}").alias(f"s{k}") for k in outputs]
    values = stored(cells.groupBy("feature", "number", "text").agg(F.sum("n").alias("n"), *sums))
    facts = values.groupBy("feature").agg(F.count_if(have).alias("n_unique"), F.sum("n").alias("rows_"), F.coalesce(F.max(F.when(have, F.col("n"))), F.lit(0)).alias("top_freq"), F.coalesce(F.sum(F.when(~have, F.col("n"))), F.lit(0)).alias("null_"))
    # keys of the two encodings that are fitted out of fold: bins, and values with the rare ones as one
    cuts = bin_cuts(values)
    kinds = F.array(F.lit("encoded"), F.lit("binned"))
    written = F.coalesce(F.col("number").cast("string"), F.col("text"))
    place = cells.join(F.broadcast(cuts), "feature", "left")  # a row for each column
    known = values.select(F.col("feature").alias("f_"), F.col("number").alias("number_"), F.col("text").alias("text_"), F.col("n").alias("n_value"))
    place = place.join(known, (F.col("feature") == F.col("f_")) & F.col("number").eqNullSafe(F.col("number_")) & F.col("text").eqNullSafe(F.col("text_")))
    code = F.when(F.col("number").isNull(), "0").otherwise((F.size(F.filter("cuts", lambda c: c < F.col("number"))) + 1).cast("string"))
    key = F.when(F.col("kind") == "binned", code).when(F.col("n_value") <= unknown, "rare").when(have, F.concat(F.lit("v"), written)).otherwise("null")
    keyed = place.withColumn("kind", F.explode(F.when(F.col("cuts").isNotNull(), kinds).otherwise(F.slice(kinds, 1, 1)))).withColumn("key", key)
    both = [x for k in outputs for x in (F.sum(f"s{k}").alias(f"s{k}"), F.sum(f"q{k}").alias(f"q{k}"), F.sum(F.when(have, F.col(f"s{k}")).otherwise(0.0)).alias(f"ks{k}"))]
    keyed = stored(keyed.groupBy("feature", "kind", "key", "fold").agg(F.sum("n").alias("n"), F.sum(F.when(have, F.col("n")).otherwise(0)).alias("kn"), *both))
    encoded = fold_out(keyed, len(targets), task != "reg")
    # what needs no fit but counts and order
    spread = F.explode(F.array(*[F.struct(F.lit(k).alias("output"), F.col(f"s{k}").alias("s")) for k in outputs])).alias("o")
    row = lambda df, kind, p: df.select("feature", F.lit(kind).alias("kind"), p.cast("double").alias("p"), "n", spread).select("feature", "kind", "o.output", "p", "n", "o.s")
    plain = row(values.filter("number is not null"), "raw", F.col("number")).unionByName(row(values.filter(have), "freq", F.col("n")))
    if categories:
        texts = values.filter("text is not null")
        ranks = numbered(texts.filter(F.col("n") > unknown), ["feature", "text"], "rank_")
        ordinal = row(ranks, "ord", F.col("rank_")).unionByName(row(texts.filter(F.col("n") <= unknown), "ord", F.lit(2.0**40)))
        plain = plain.unionByName(ordinal)
    indicator = values.groupBy("feature", (~have).alias("none_")).agg(F.sum("n").alias("n"), *sums)
    told = plain.unionByName(row(indicator, "nulls", F.col("none_").cast("int"))).unionByName(encoded)
    own = gini_of_sums(told, ["feature", "kind", "output"])
    every = [*numbers, *categories]
    isnan = {c: F.isnan(F.col(quoted(c)).cast("double")) for c in numbers}
    conditions = {c: F.col(quoted(c)).isNotNull() & ~F.coalesce(isnan.get(c, F.lit(False)), F.lit(False)) for c in every}
    best = None
    for k in outputs:
        one = perfect_gini(frame.df, conditions | {"*": F.lit(True)}, targets[k]).withColumn("output", F.lit(k))
        best = one if best is None else best.unionByName(one)
    of = F.when(F.col("kind") == "nulls", "*").otherwise(F.col("feature"))
    best = best.select(F.col("feature").alias("of_"), F.col("output").alias("output_"), "g_y")
    ratio = own.join(F.broadcast(best), (of == F.col("of_")) & (F.col("output") == F.col("output_"))).select("feature", "kind", F.abs(F.coalesce(F.try_divide("g", "g_y"), F.lit(0.0))).alias("gini"))
    wide = ratio.groupBy("feature").pivot("kind", list(KINDS)).agg(F.avg("gini"))
    number = F.col("feature").isin(numbers) if numbers else F.lit(False)
    value = lambda kind, when: F.when(when, F.coalesce(kind, F.lit(0.0))).alias(kind)
    shown = [value("raw", number), value("binned", number), value("encoded", F.lit(True)), value("freq", F.lit(True)), value("ord", ~number), value("nulls", F.lit(True))]
    return facts.join(F.broadcast(wide), "feature", "left").select("feature", number.alias("is_number"), "n_unique", F.try_divide("n_unique", "rows_").alias("unique_rate"), "top_freq", F.try_divide("null_", "rows_").alias("null_rate"), *shown)


def ratio(a: Column, b: Column) -> Column:
    """a / b; infinite for a positive number by 0, null for 0 by 0."""
    return F.when(b != 0, a / b).when(a > 0, float("inf"))


def role_rules(stats: DataFrame, manual: list[str] | None = None, limits: Limits | None = None, least_score: float = 0.0) -> DataFrame:
    """feature, rule_0 to rule_8, max_score, role, discretization, encoding and ordinal: the decision for each row of :func:`role_stats`.

    A number that no rule keeps a number becomes a category. Rules: raw is best (0), bins are best (1), two
    values at most (2), nearly all values different (3), the encodings differ little (4), bins are far better than the third best
    (5), raw is second and close (6), the column is weak (7), the role was declared (8). Of equal ginis the later
    encoding counts as better. A column whose best gini, the null indicator's included, is below ``least_score`` is dropped.
    """
    at = limits or Limits()
    number = F.col("is_number")
    scores = lambda names: F.array_sort(F.array(*[F.struct(F.coalesce(c, F.lit(0.0)).alias("v"), F.lit(k).alias("k")) for k, c in enumerate(names)]))
    four, three = scores(["raw", "binned", "encoded", "freq"]), scores(["encoded", "freq", "ord"])
    nth = lambda a, k, f: F.element_at(a, -k)[f]
    df = stats.withColumn("max_score", F.when(number, nth(four, 1, "v")).otherwise(nth(three, 1, "v")))
    df = df.withColumn("top_", F.max(F.when(number, F.col("max_score"))).over(Window.partitionBy(F.lit(1))))  # one row for each column
    third, second = ratio(F.col("max_score"), nth(four, 3, "v")), ratio(F.col("max_score"), nth(four, 2, "v"))
    rules = [
        nth(four, 1, "k") == 0,
        nth(four, 1, "k") == 1,
        F.col("n_unique") <= 2,
        F.col("unique_rate") > at.numeric_unique_rate,
        third < at.max_to_3rd_rate,
        (nth(four, 1, "k") == 1) & (third > at.binning_enc_rate),
        (nth(four, 2, "k") == 0) & (second < at.raw_decr_rate),
        (ratio(F.col("max_score"), F.col("top_")) < at.max_score_rate) | (F.col("max_score") < at.abs_score_val),
        F.col("feature").isin(manual) if manual else F.lit(False),
    ]
    df = df.withColumns({f"rule_{k}": number & F.coalesce(r, F.lit(False)) for k, r in enumerate(rules)})
    stays = number & F.greatest(*[F.col(f"rule_{k}") for k in range(len(rules))])
    turned = number & ~stays
    frequent, few = F.coalesce(ratio(F.col("freq"), F.col("encoded")) > 1.3, F.lit(False)), F.col("n_unique") < 10
    best = nth(three, 1, "k")
    encoding = F.when(turned, F.when(frequent, "freq").when(few, "int").otherwise("auto")).when(~number, F.when(best == 1, "freq").otherwise("auto"))
    ordinal = F.when(turned, F.col("unique_rate") > 0.01).when(~number, best == 2).otherwise(False)
    discrete = stays & ~F.col("rule_7") & F.coalesce(ratio(F.col("binned"), F.col("raw")) > 2, F.lit(False))
    weak = F.greatest("max_score", "nulls") < least_score
    role = F.when(weak, "drop").when(stays, "numeric").otherwise("category")
    return df.select("feature", *[f"rule_{k}" for k in range(len(rules))], "max_score", role.alias("role"), discrete.alias("discretization"), encoding.alias("encoding"), ordinal.alias("ordinal"))


def advised_roles(decisions: DataFrame, roles: dict[str, R.Role]) -> dict[str, R.Role]:
    """Roles after the decisions, one row for each column; declared attributes beside the decided ones stay."""
    out = dict(roles)
    for r in decisions.toLocalIterator():
        old = roles[r["feature"]]
        if r["role"] == "drop":
            out[r["feature"]] = R.make("drop")
        elif r["role"] == "numeric":
            out[r["feature"]] = R.numeric(discretization=r["discretization"], prob=old.prob)
        else:
            kind = {"dtype": "double"} if old.name == "numeric" else {"dtype": old.dtype}
            out[r["feature"]] = R.category(encoding=r["encoding"], ordinal=bool(r["ordinal"]), unknown=old.unknown, **kind)
    return out
