"""Metrics as aggregates over a target y, a prediction p and an optional weight w.

Metrics of an order (AUC, gini, curves) rest on running sums over distinct scores, which are cut into
parts, so that none of them sorts a table in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.ordered import quantiles, running


def weighted(e: Column, w: Column | None = None) -> Column:
    return F.avg(e) if w is None else F.sum(e * w) / F.sum(w)


def mse(y: Column, p: Column, w: Column | None = None) -> Column:
    return weighted((y - p) ** 2, w)


def mae(y: Column, p: Column, w: Column | None = None) -> Column:
    return weighted(F.abs(y - p), w)


def r2(y: Column, p: Column) -> Column:
    n = F.count(F.when(y.isNotNull() & p.isNotNull(), 1))
    return 1 - F.sum((y - p) ** 2) / (F.var_pop(y) * n)


def explained_variance(y: Column, p: Column) -> Column:
    return 1 - F.var_pop(y - p) / F.var_pop(y)


def quantile_error(y: Column, p: Column, q: float = 0.9, w: Column | None = None) -> Column:
    """Over-prediction is weighted by q, under-prediction by 1 - q."""
    return weighted(F.when(p > y, q).otherwise(1 - q) * F.abs(y - p), w)


def huber_error(y: Column, p: Column, a: float = 0.9, w: Column | None = None) -> Column:
    e = F.abs(y - p)
    return weighted(F.when(e < a, e * e / 2).otherwise(a * e - a * a / 2), w)


def fair_error(y: Column, p: Column, c: float = 0.9, w: Column | None = None) -> Column:
    x = F.abs(y - p) / c
    return weighted(c * c * (x - F.log1p(x)), w)


def mape(y: Column, p: Column, w: Column | None = None) -> Column:
    return weighted(F.abs(F.try_divide(y - p, y)), w)


def rmsle(y: Column, p: Column, w: Column | None = None) -> Column:
    return F.sqrt(weighted((F.log1p(y) - F.log1p(p)) ** 2, w))


def log_loss(y: Column, p: Column, w: Column | None = None) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    return weighted(-(y * F.log(p) + (1 - y) * F.log(1 - p)), w)


def cross_entropy(y: Column, p: Column, w: Column | None = None) -> Column:
    """p: array of class probabilities, y: the class from 0."""
    own = F.element_at(p, (y + 1).cast("int"))
    return weighted(-F.log(F.least(F.greatest(own, F.lit(1e-15)), F.lit(1 - 1e-15))), w)


def accuracy(y: Column, p: Column, threshold: float = 0.5, w: Column | None = None) -> Column:
    return weighted(((p > threshold).cast("int") == y).cast("double"), w)


def best_class(p: Column) -> Column:
    """The class of the highest probability, the first of equals."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


#: name -> (function of y and p, whether more is better)
REGISTRY = {
    "mse": (mse, False), "mae": (mae, False), "r2": (r2, True), "mape": (mape, False), "rmsle": (rmsle, False), "quantile": (quantile_error, False),
    "huber": (huber_error, False), "fair": (fair_error, False), "logloss": (log_loss, False), "accuracy": (accuracy, True), "crossentropy": (cross_entropy, False),
}


def scores(df: DataFrame, y: str, predictions: list[Column], metric: str | Callable[[Column, Column], Column], more: bool = True) -> list[float | None]:
    """The metric of each prediction with the sign that makes more better, over the rows that have it; all from one job.

    ``metric`` is a name, or a function of target and prediction to an aggregate (``more``: whether more of it is better).
    """
    if metric == "auc":
        long = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(y).cast("double").alias("y"), p.cast("double").alias("p")) for k, p in enumerate(predictions)])).alias("x")).select("x.*")
        found = {r["k"]: r["auc"] for r in auc(long.filter("p is not null"), "y", "p", ["k"]).collect()}  # a row for each prediction
        return [found.get(k) for k in range(len(predictions))]
    f, more = REGISTRY[metric] if isinstance(metric, str) else (metric, more)
    named = df.select(F.col(y).alias("y"), *[p.alias(f"p{k}") for k, p in enumerate(predictions)])
    has = [F.col(f"p{k}").isNotNull() for k in range(len(predictions))]
    # a row without the prediction has no target either, so that it counts for nothing
    row = named.agg(*[f(F.when(h, F.col("y")), F.col(f"p{k}")).alias(f"v{k}") for k, h in enumerate(has)]).first()
    return [v if more or v is None else -v for v in row]


def score(df: DataFrame, y: str, p: str, metric: str | Callable[[Column, Column], Column], more: bool = True) -> float | None:
    """The metric of one prediction, as in :func:`scores`."""
    return scores(df, y, [F.col(p)], metric, more)[0]


def confusion(df: DataFrame, y: Column, p: Column) -> DataFrame:
    return df.groupBy(y.alias("actual"), p.alias("predicted")).agg(F.count("*").alias("n"))


def f1_by_class(df: DataFrame, y: Column, p: Column) -> DataFrame:
    """label, precision, recall, f1 and support; divisions by nothing give 0."""
    cells = confusion(df, y, p)
    zero_ = F.lit(0).cast("long")
    entry = lambda label, tp, fn, fp: F.struct(label.alias("label"), tp.alias("tp"), fn.alias("fn"), fp.alias("fp"))
    right = F.when(F.col("actual").eqNullSafe(F.col("predicted")), F.col("n")).otherwise(zero_)
    both = F.array(entry(F.col("actual"), right, F.col("n"), zero_), entry(F.col("predicted"), zero_, zero_, F.col("n")))
    each = cells.select(F.explode(both).alias("x")).groupBy("x.label").agg(F.sum("x.tp").alias("tp"), F.sum("x.fn").alias("actual"), F.sum("x.fp").alias("said"))
    zero = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return each.select("label", zero(F.col("tp"), F.col("said")).alias("precision"), zero(F.col("tp"), F.col("actual")).alias("recall"), zero(2 * F.col("tp"), F.col("said") + F.col("actual")).alias("f1"), F.col("actual").alias("support"), "tp")


def f1_averages(df: DataFrame, y: Column, p: Column) -> DataFrame:
    """f1_micro, f1_macro and f1_weighted."""
    return f1_by_class(df, y, p).agg((F.sum("tp") / F.sum("support")).alias("f1_micro"), F.avg("f1").alias("f1_macro"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"))


def auc(df: DataFrame, y: str, p: str, by: list[str] = (), name: str = "auc") -> DataFrame:
    """Area under the ROC curve with mid-ranks for ties: pairs below plus half of the pairs level, over all pairs; ``by`` names few groups."""
    ranked = running(df, p, {"pos": F.col(y).cast("double"), "neg": 1 - F.col(y).cast("double")}, by)
    area = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2))
    value = F.try_divide(area, F.sum("pos") * F.sum("neg")).alias(name)
    return ranked.groupBy(*by).agg(value) if by else ranked.agg(value)


def auc_one_vs_rest(df: DataFrame, y: str, scores: list[str]) -> DataFrame:
    """Mean of the AUC of each class against the others; scores[k] is that of class k."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col(y) == k).cast("double").alias("y"), F.col(s).cast("double").alias("p")) for k, s in enumerate(scores)])).alias("x")).select("x.*")
    return auc(long, "y", "p", ["k"]).agg(F.avg("auc").alias("auc_ovr"))


def auc_mu(df: DataFrame, y: str, scores: list[str]) -> DataFrame:
    """Mean over pairs of classes of the AUC along the normal of the boundary between them (equal costs)."""
    pairs = [(i, j) for i in range(len(scores)) for j in range(i)]
    entries = F.array(*[F.struct(F.lit(k).alias("k"), F.when(F.col(y).isin(i, j), (F.col(y) == i).cast("double")).alias("y"), (F.col(scores[i]) - F.col(scores[j])).cast("double").alias("p")) for k, (i, j) in enumerate(pairs)])
    long = df.select(F.explode(entries).alias("x")).select("x.*").filter("y is not null")
    return auc(long, "y", "p", ["k"]).agg(F.avg("auc").alias("auc_mu"))


#: Columns whose perfect orders are summed in one pass.
COLUMNS_AT_ONCE = 50


def gini_of_sums(df: DataFrame, by: list[str]) -> DataFrame:
    """by and g: the gini of the order of p, from rows of n tied values with the target sum s; ties share their mean.

    The gini of an order is sum(running share of the target) / n - (n + 1) / 2n.
    """
    ranked = running(df.filter(F.col("p").isNotNull() & ~F.isnan("p")), "p", {"n": F.col("n"), "s": F.col("s")}, by)
    return ranked.groupBy(*by).agg(area_of_ties("n", "s").alias("g"))


def area_of_ties(n: str, s: str) -> Column:
    """n tied rows add the running sum before them n times and s * (n + 1) / 2; null where the target sums to 0."""
    ties = F.sum(F.col(n) * (F.col(f"cum_{s}") - F.col(s)) + F.col(s) * (F.col(n) + 1) / 2)
    return F.try_divide(F.try_divide(ties, F.sum(s)) - (F.sum(n) + 1) / 2, F.sum(n))


def perfect_gini(df: DataFrame, known: dict[str, Column], y: str) -> DataFrame:
    """feature and g_y: the gini of the target's own order over the rows where the condition of each name holds, of many at once."""
    out, target = None, F.col(y).cast("double")
    names = list(known)
    for at in range(0, len(names), COLUMNS_AT_ONCE):
        some = names[at : at + COLUMNS_AT_ONCE]
        sums = {f"n{k}": F.when(known[c], 1).otherwise(0) for k, c in enumerate(some)} | {f"s{k}": F.when(known[c], target).otherwise(0.0) for k, c in enumerate(some)}
        row = running(df.withColumn("y_", target), "y_", sums).agg(*[area_of_ties(f"n{k}", f"s{k}").alias(f"g{k}") for k in range(len(some))])
        part = row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"g{k}").alias("g_y")) for k, c in enumerate(some)])).alias("x")).select("x.*")
        out = part if out is None else out.unionByName(part)
    return out


def gini(df: DataFrame, columns: list[str], y: str) -> DataFrame:
    """feature and gini: each column's normalised gini of the target by its order, over the rows that have a value; that of the perfect order is 1."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("p")) for c in columns])).alias("x"), F.lit(1).alias("n"), F.col(y).cast("double").alias("s")).select("x.*", "n", "s")
    own = gini_of_sums(long, ["feature"]).withColumnRenamed("g", "g_p")
    value = {c: F.col(c).cast("double") for c in columns}
    best = perfect_gini(df, {c: v.isNotNull() & ~F.isnan(v) for c, v in value.items()}, y)
    return own.join(F.broadcast(best), "feature").select("feature", F.try_divide("g_p", "g_y").alias("gini"))  # one row for each column


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b and r of every pair of columns in their order, from one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def roc_points(df: DataFrame, y: str, p: str) -> DataFrame:
    """threshold, tpr and fpr at every distinct score, from the highest."""
    each = running(df, p, {"pos": F.col(y).cast("double"), "neg": 1 - F.col(y).cast("double")}, descending=True)
    return each.select(F.col(p).alias("threshold"), F.try_divide("cum_pos", "all_pos").alias("tpr"), F.try_divide("cum_neg", "all_neg").alias("fpr"))


def precision_recall_points(df: DataFrame, y: str, p: str) -> DataFrame:
    each = running(df, p, {"pos": F.col(y).cast("double"), "n": F.lit(1)}, descending=True)
    return each.select(F.col(p).alias("threshold"), (F.col("cum_pos") / F.col("cum_n")).alias("precision"), F.try_divide("cum_pos", "all_pos").alias("recall"), F.try_divide("pos", "all_pos").alias("step"))


def average_precision(df: DataFrame, y: str, p: str) -> DataFrame:
    return precision_recall_points(df, y, p).agg(F.sum(F.col("step") * F.col("precision")).alias("average_precision"))


def threshold_counts(df: DataFrame, y: Column, p: Column, threshold: float) -> DataFrame:
    """tp, fp, fn, tn, precision, recall and f1 of p > threshold."""
    said, true = p > threshold, y == 1
    counts = df.agg(F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & true).alias("fn"), F.count_if(~said & ~true).alias("tn"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    return counts.select("tp", "fp", "fn", "tn", zero(tp, tp + fp).alias("precision"), zero(tp, tp + fn).alias("recall"), zero(2 * tp, 2 * tp + fp + fn).alias("f1"))


def best_f1(df: DataFrame, y: Column, p: Column, low: float = 0.01, high: float = 0.99, step: float = 0.01) -> DataFrame:
    """cut and f1: of the cuts in steps, the one with the best F1 of p at or above it; the least of equals. At most (high - low) / step rows are ordered."""
    binned = F.least(F.greatest(F.ceil(p / step).cast("int"), F.lit(round(low / step))), F.lit(round(high / step)))
    each = df.groupBy(binned.alias("bin")).agg(F.sum(y.cast("double")).alias("pos"), F.count("*").cast("double").alias("n"))
    table = each.agg(F.collect_list(F.struct("bin", "pos", "n")).alias("rows"))
    total = F.aggregate("rows", F.lit(0.0), lambda a, x: a + x["pos"])
    cuts = F.transform("rows", lambda r: F.struct(r["bin"].alias("bin"), F.aggregate(F.filter("rows", lambda x: x["bin"] >= r["bin"]), F.struct(F.lit(0.0).alias("tp"), F.lit(0.0).alias("said")), lambda a, x: F.struct((a["tp"] + x["pos"]).alias("tp"), (a["said"] + x["n"]).alias("said"))).alias("c")))
    scored = table.select(total.alias("all_pos"), F.explode(cuts).alias("x")).select((F.col("x.bin") * step).alias("cut"), F.coalesce(F.try_divide(2 * F.col("x.c.tp"), F.col("x.c.said") + F.col("all_pos")), F.lit(0.0)).alias("f1"))
    return scored.orderBy(F.desc("f1"), "cut").limit(1)


def ranked(df: DataFrame, order: str, tie: list[str], name: str = "place", descending: bool = True) -> DataFrame:
    """Rows numbered from 0 in a global order, by range partitions and the counts before each."""
    from larkspur.operators.categorical import numbered

    keys = [F.desc(order) if descending else F.asc(order), *tie]
    return numbered(df, keys, name).withColumn(name, F.col(name) - 1)


def prediction_bins(df: DataFrame, y: Column, p: str, tie: list[str], bins: int = 20) -> DataFrame:
    """bin, n, mean target, and the least, mean and greatest prediction of equal slices of the rows from the highest prediction."""
    n = df.count()
    placed = ranked(df, p, tie)
    return placed.groupBy(F.floor(F.col("place") * bins / n).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg(y.cast("double")).alias("mean_target"), F.min(p).alias("min_pred"), F.avg(p).alias("mean_pred"), F.max(p).alias("max_pred"))


def histogram(df: DataFrame, x: str, bins: int = 10, by: list[str] = ()) -> DataFrame:
    """bin from 1, and n, of equal widths between the least and the greatest value; the greatest counts in the last."""
    limits = df.agg(F.min(x).cast("double").alias("lo_"), F.max(x).cast("double").alias("hi_"))
    share = F.try_divide(F.col(x) - F.col("lo_"), F.col("hi_") - F.col("lo_"))
    place = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins) + 1, F.lit(bins)).cast("int")
    return df.filter(F.col(x).isNotNull()).crossJoin(F.broadcast(limits)).groupBy(*by, place.alias("bin")).agg(F.count("*").alias("n"))


def spread_by_bin(df: DataFrame, x: str, bin_: str) -> DataFrame:
    """bin, least, q25, median, q75 and greatest value of a number in each of a few bins."""
    ends = df.filter(F.col(x).isNotNull()).groupBy(F.col(bin_).alias("bin")).agg(F.min(x).alias("least"), F.max(x).alias("greatest"))
    inside = quantiles(df, x, [0.25, 0.5, 0.75], [bin_], ["q25", "median", "q75"]).withColumnRenamed(bin_, "bin")
    return ends.join(inside, "bin").select("bin", "least", "q25", "median", "q75", "greatest")


def error_histogram(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """bin and n of the errors p - y, in equal widths."""
    return histogram(df.withColumn("error_", F.col(p) - F.col(y)), "error_", bins)


def general_info(df: DataFrame, used: list[str], dropped: list[str]) -> DataFrame:
    """rows, columns, and how many of them are used and dropped."""
    return df.agg(F.count("*").alias("rows")).select("rows", F.lit(len(df.columns)).alias("columns"), F.lit(len(used)).alias("used"), F.lit(len(dropped)).alias("dropped"))


def log_odds_by_class(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    q = F.least(F.greatest(F.col(p), F.lit(1e-7)), F.lit(1 - 1e-7))
    return histogram(df.withColumn("logit_", F.log(q / (1 - q))), "logit_", bins, [y])


# profiles


def profile_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, null_rate, min, q25, mean, median, q75 and max of numeric columns."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    long = long.withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    plain = long.groupBy("feature").agg(F.avg(F.col("v").isNull().cast("double")).alias("null_rate"), F.min("v").alias("min"), F.avg("v").alias("mean"), F.max("v").alias("max"))
    return plain.join(quantiles(long, "v", [0.25, 0.5, 0.75], ["feature"], ["q25", "median", "q75"]), "feature", "left").select("feature", "null_rate", "min", "q25", "mean", "median", "q75", "max")


def profile_category(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, null_rate, n_unique, and the most and least frequent values with their shares of the rows that have one; ties by value."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")).select("x.*")
    counts = long.groupBy("feature", "v").agg(F.count("*").alias("n"))
    have = F.col("v").isNotNull()
    known, some = F.sum(F.when(have, F.col("n"))), F.struct(-F.col("n"), F.col("v"))
    made = counts.groupBy("feature").agg(
        (F.coalesce(F.sum(F.when(~have, F.col("n"))), F.lit(0)) / F.sum("n")).alias("null_rate"), F.count_if(have).alias("n_unique"),
        F.min(F.when(have, some)).alias("top"), F.min(F.when(have, F.struct(F.col("n").alias("n"), F.col("v").alias("v")))).alias("low"), known.alias("known"),
    )
    return made.select("feature", "null_rate", "n_unique", F.col("top.v").alias("top_value"), (-F.col("top").getField("col1") / F.col("known")).alias("top_share"), F.col("low.v").alias("rare_value"), (F.col("low.n") / F.col("known")).alias("rare_share"))


def profile_dates(df: DataFrame, columns: list[str]) -> DataFrame:
    row = df.agg(*[x for c in columns for x in (F.avg(F.col(c).isNull().cast("double")).alias(f"{c}_null_rate"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"))])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}_null_rate").alias("null_rate"), F.col(f"{c}_min").alias("min"), F.col(f"{c}_max").alias("max")) for c in columns])).alias("x")).select("x.*")


def profile_text(df: DataFrame, columns: list[str]) -> DataFrame:
    row = df.agg(*[x for c in columns for x in (F.count_if(F.coalesce(F.length(c), F.lit(0)) == 0).alias(f"{c}_n"), F.min(F.length(c)).alias(f"{c}_a"), F.max(F.length(c)).alias(f"{c}_b"))])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}_n").alias("n_empty"), F.col(f"{c}_a").alias("shortest"), F.col(f"{c}_b").alias("longest")) for c in columns])).alias("x")).select("x.*")


def constant_rates(df: DataFrame, columns: list[str], least: float = 0.0) -> DataFrame:
    """feature, null_rate, and the commonest value's share of all rows and of the rows that have one.

    Shares are counted for the columns in which some value may have a share of ``least`` or
    more of the rows that have one: one pass without a shuffle of cells counts the nulls and finds the
    candidates, and a second counts how often those occur, by 52 bits of their hashes. Other columns have null shares. With
    ``least`` 0 the values of all columns are counted.
    """
    text = lambda c: F.col(f"`{c}`").cast("string")
    entry = lambda c, *more: F.struct(F.lit(c).alias("feature"), *more)
    if least <= 0:
        long = df.select(F.explode(F.array(*[entry(c, text(c).alias("v")) for c in columns])).alias("x")).select("x.*")
        counts = long.groupBy("feature", "v").agg(F.count("*").alias("n"))
        have = F.col("v").isNotNull()
        whole, known, most = F.sum("n"), F.sum(F.when(have, F.col("n"))), F.max(F.when(have, F.col("n")))
        return counts.groupBy("feature").agg((1 - F.coalesce(known, F.lit(0)) / whole).alias("null_rate"), F.coalesce(most / whole, F.lit(0.0)).alias("constant_rate"), (most / known).alias("constant_rate_known"))
    # a value with over half of the rows is the median of any order: one candidate for each column
    if least <= 0.5:
        raise ValueError("least is 0 or above one half")
    # the middle of the hashes is the hash of a value with over half of the rows
    hashed = {k: F.when(text(c).isNotNull(), F.shiftrightunsigned(F.xxhash64(text(c)), 12)) for k, c in enumerate(columns)}
    row = df.agg(F.count("*").alias("n"), *[F.count(text(c)).alias(f"k{k}") for k, c in enumerate(columns)], *[F.percentile_approx(h, 0.5, 1000).alias(f"m{k}") for k, h in hashed.items()]).first()
    hits = df.agg(*[F.count_if(h == F.lit(row[f"m{k}"])).alias(f"h{k}") for k, h in hashed.items()]).first()
    found = []
    for k, c in enumerate(columns):
        n, known, most = row["n"], row[f"k{k}"], hits[f"h{k}"]
        exact = known and most >= least * known
        found.append((c, 1 - known / n if n else None, (most / n if exact else None) if known else 0.0, most / known if exact else None))
    return df.sparkSession.createDataFrame(found, "feature string, null_rate double, constant_rate double, constant_rate_known double")


# uplift


def uplift_curve(df: DataFrame, y: str, u: str, t: str, mode: str = "qini", keep_part: bool = False, by: list[str] = ()) -> DataFrame:
    """n (rows so far) and value at every distinct uplift score from the highest; modes qini, cum_gain and adj_qini. One curve for each group of ``by``."""
    treated, outcome = F.col(t).cast("double"), F.col(y).cast("double")
    each = running(df, u, {"n": F.lit(1), "nt": treated, "yt": outcome * treated, "yc": outcome * (1 - treated)}, by, descending=True, keep_part=keep_part)
    n, nt, yt, yc, all_rows, all_treated = (F.col(c).cast("double") for c in ("cum_n", "cum_nt", "cum_yt", "cum_yc", "all_n", "all_nt"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    value = {
        "qini": F.try_divide(yt, all_treated) - F.try_divide(yc, all_rows - all_treated),
        "cum_gain": (zero(yt, nt) - zero(yc, n - nt)) * n / all_rows,
        "adj_qini": F.try_divide(yt - yc * zero(nt, n - nt), all_treated),
    }[mode]
    return each.select(*by, F.col("cum_n").alias("n"), value.alias("value"), *(["part_"] if keep_part else []))


def area(points: DataFrame, by: list[str] = ()) -> DataFrame:
    """auc: trapezoids under (n / N, value) from the origin, over points in parts (part_, in the order of n) whose ends are carried on; of each group of ``by``."""
    ends = points.groupBy(*by, "part_").agg(F.max(F.struct("n", "value")).alias("end_"))
    carried = ends.select(*by, "part_", F.lag("end_").over(Window.partitionBy(*by).orderBy("part_")).alias("before_"))  # one row for each part
    w = Window.partitionBy(*by, "part_").orderBy("n")
    joined = points.join(carried, [*by, "part_"])
    x0 = F.coalesce(F.lag("n").over(w), F.col("before_.n"), F.lit(0)).cast("double")
    y0 = F.coalesce(F.lag("value").over(w), F.col("before_.value"), F.lit(0.0))
    steps = joined.select(*by, "n", ((F.col("n") - x0) * (F.col("value") + y0) / 2).alias("a_"))
    return steps.groupBy(*by).agg((F.sum("a_") / F.max("n")).alias("auc"))


def perfect_uplift(y: Column, t: Column) -> Column:
    """The best score of a binary target: treated responders 2, untreated others 1, treated others 0, untreated responders -1."""
    return F.when(t == 1, F.when(y == 1, 2.0).otherwise(0.0)).otherwise(F.when(y == 1, -1.0).otherwise(1.0))


def uplift_aucs(df: DataFrame, y: str, scores: dict[str, Column], t: str, mode: str = "adj_qini") -> dict[str, float | None]:
    """The area of each of several uplift scores, from one job."""
    entries = F.array(*[F.struct(F.lit(n).alias("name"), c.cast("double").alias("u")) for n, c in scores.items()])
    long = df.select(F.col(y).alias("y"), F.col(t).alias("t"), F.explode(entries).alias("x")).select("y", "t", "x.name", "x.u")
    found = {r["name"]: r["auc"] for r in area(uplift_curve(long, "y", "u", "t", mode, True, ["name"]), ["name"]).collect()}  # a row for each score
    return {n: found.get(n) for n in scores}


def uplift_auc(df: DataFrame, y: str, u: str, t: str, mode: str = "adj_qini", normed: bool = False) -> DataFrame:
    """auc; with ``normed``, 0 for a random order and 1 for the perfect one."""
    own = area(uplift_curve(df, y, u, t, mode, keep_part=True))
    if not normed:
        return own
    best = area(uplift_curve(df.withColumn("u_", perfect_uplift(F.col(y), F.col(t))), y, "u_", t, mode, keep_part=True)).select(F.col("auc").alias("best"))
    rate = lambda k: F.avg(F.when(F.col(t) == k, F.col(y).cast("double")))
    base = df.agg(((rate(1) - rate(0)) / 2).alias("base"))
    return own.crossJoin(best).crossJoin(base).select(((F.col("auc") - F.col("base")) / (F.col("best") - F.col("base"))).alias("auc"))


def above_percentile(df: DataFrame, u: str, top: float) -> DataFrame:
    cut = quantiles(df, u, [1 - top / 100], names=["cut_"])
    return df.crossJoin(F.broadcast(cut)).withColumn("up_", F.col(u) > F.col("cut_"))


def uplift_at_top(df: DataFrame, y: str, u: str, t: str, top: float = 30) -> DataFrame:
    """uplift of the rows strictly above the percentile 100 - top: mean target of the treated less that of the others, 0 for none."""
    rate = lambda k: F.coalesce(F.avg(F.when(F.col("up_") & (F.col(t) == k), F.col(y).cast("double"))), F.lit(0.0))
    return above_percentile(df, u, top).agg((rate(1) - rate(0)).alias("uplift"))


def total_score(df: DataFrame, y: str, u: str, t: str, top: float = 30) -> DataFrame:
    """Mean target of the untreated not above the percentile and of the treated above it, weighted by the share of treated rows."""
    v, treated = F.col(y).cast("double"), F.col(t) == 1
    row = above_percentile(df, u, top).agg(F.avg(F.when(~treated & ~F.col("up_"), v)).alias("c"), F.avg(F.when(treated & F.col("up_"), v)).alias("t"), F.avg(treated.cast("double")).alias("r"))
    return row.select((F.col("c") * (1 - F.col("r")) + F.col("t") * F.col("r")).alias("total_score"))


def uplift_bins(df: DataFrame, y: str, u: str, t: str, tie: list[str], bins: int = 10) -> DataFrame:
    n = df.count()
    placed = ranked(df, u, tie, descending=False)
    fact = F.avg(F.when(F.col(t) == 1, F.col(y).cast("double"))) - F.avg(F.when(F.col(t) == 0, F.col(y).cast("double")))
    return placed.groupBy(F.floor(F.col("place") * bins / n).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.min(u).alias("min_uplift"), F.avg(u).alias("mean_uplift"), F.max(u).alias("max_uplift"), fact.alias("fact_uplift"))
