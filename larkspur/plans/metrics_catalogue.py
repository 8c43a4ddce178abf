"""Queries over metrics, profiles and curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import metrics as M
from larkspur.functions.ordered import quantiles
from larkspur.plans.registry import query, rounded, table


def priced(spark: SparkSession, sf: str) -> DataFrame:
    """y: price of a line, p: its quantity at a price of 1500, w: 1 + its tax."""
    return table(spark, sf, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"), (1 + F.col("l_tax")).alias("w"))


PRICED = "(select l_returnflag, l_extendedprice as y, l_quantity * 1500 as p, 1 + l_tax as w from lineitem)"


@query(f"""select round(avg((y - p) * (y - p)) / 1e6, 4) as mse, round(avg(abs(y - p)), 4) as mae, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) as r2, round(avg(abs((y - p) / y)), 6) as mape,
    round(sqrt(avg(pow(ln(1 + y) - ln(1 + p), 2))), 6) as rmsle, round(sum(w * abs(y - p)) / sum(w), 4) as weighted_mae, round(1 - var_pop(y - p) / var_pop(y), 6) as explained from {PRICED}""")
def metric_regression(spark: SparkSession, sf: str) -> DataFrame:
    y, p, w = (F.col(c) for c in "ypw")
    a = priced(spark, sf).agg((M.mse(y, p) / 1e6).alias("mse"), M.mae(y, p).alias("mae"), M.r2(y, p).alias("r2"), M.mape(y, p).alias("mape"), M.rmsle(y, p).alias("rmsle"), M.mae(y, p, w).alias("weighted_mae"), M.explained_variance(y, p).alias("explained"))
    return a.select(*[F.round(c, 4 if c in ("mse", "mae", "weighted_mae") else 6).alias(c) for c in a.columns])


@query(f"""select round(avg(case when p > y then 0.9 else 0.1 end * abs(y - p))::double, 4) as quantile, round(avg(case when abs(y - p) < 0.9 then (y - p) * (y - p) / 2 else 0.9 * abs(y - p) - 0.405 end)::double, 4) as huber,
    round(avg(0.81 * (abs(y - p) / 0.9 - ln(1 + abs(y - p) / 0.9)))::double, 4) as fair from {PRICED}""")
def metric_robust(spark: SparkSession, sf: str) -> DataFrame:
    y, p = F.col("y"), F.col("p")
    return rounded(priced(spark, sf).agg(M.quantile_error(y, p).alias("quantile"), M.huber_error(y, p).alias("huber"), M.fair_error(y, p).alias("fair")), 4)


@query(f"select round(median(abs(y - p)), 4) as median_ae from {PRICED}")
def metric_median_error(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(quantiles(priced(spark, sf).withColumn("e", F.abs(F.col("y") - F.col("p"))), "e", [0.5], names=["median_ae"]), 4)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """events: y whether a purchase, p: the value over 500 at most 1, cut so that scores tie, t: the id's remainder by 2."""
    p = F.floor(F.least(F.col("value") / 500, F.lit(1.0)) * 100) / 100
    return table(spark, sf, "events").select("event_id", (F.col("event_type") == "purchase").cast("int").alias("y"), p.alias("p"), (F.col("event_id") % 2).cast("int").alias("t"))


SCORED = "(select event_id, (event_type = 'purchase')::integer as y, floor(least(value / 500, 1.0::double) * 100) / 100 as p, (event_id % 2)::integer as t from events)"
AUC = "((sum(r) filter (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)))"


@query(f"select round({AUC}, 6)::double as auc from (select y, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2 as r from {SCORED})")
def metric_auc(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.auc(scored(spark, sf), "y", "p"))


@query(f"""select round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) as logloss, round(avg(((p > 0.5)::integer = y)::integer), 6) as accuracy
    from (select *, least(greatest(p, 1e-15::double), 1 - 1e-15::double) as q from {SCORED})""")
def metric_logloss_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    y, p = F.col("y"), F.col("p")
    return rounded(scored(spark, sf).agg(M.log_loss(y, p).alias("logloss"), M.accuracy(y, p).alias("accuracy")))


@query("""with x as (select o_orderstatus as y, case when o_totalprice > 250000 then 'F' when o_totalprice > 120000 then 'O' else 'P' end as p from orders),
    c as (select k as label, count(*) filter (y = k and p = k) as tp, count(*) filter (y = k) as a, count(*) filter (p = k) as s from x, (select distinct o_orderstatus as k from orders) group by k)
    select label, round(coalesce(tp / nullif(s, 0), 0), 6)::double as precision, round(tp / a, 6)::double as recall, round(2 * tp / (s + a), 6)::double as f1, a as support, tp from c""")
def metric_f1_classes(spark: SparkSession, sf: str) -> DataFrame:
    p = F.when(F.col("o_totalprice") > 250000, "F").when(F.col("o_totalprice") > 120000, "O").otherwise("P")
    return rounded(M.f1_by_class(table(spark, sf, "orders"), F.col("o_orderstatus"), p))


@query("""with x as (select o_orderstatus as y, case when o_totalprice > 250000 then 'F' when o_totalprice > 120000 then 'O' else 'P' end as p from orders),
    c as (select k, count(*) filter (y = k and p = k) as tp, count(*) filter (y = k) as a, count(*) filter (p = k) as s from x, (select distinct o_orderstatus as k from orders) group by k)
    select round(sum(tp) / sum(a), 6)::double as f1_micro, round(avg(2 * tp / (s + a)), 6)::double as f1_macro, round(sum(a * 2 * tp / (s + a)) / sum(a), 6)::double as f1_weighted from c""")
def metric_f1_averages(spark: SparkSession, sf: str) -> DataFrame:
    p = F.when(F.col("o_totalprice") > 250000, "F").when(F.col("o_totalprice") > 120000, "O").otherwise("P")
    return rounded(M.f1_averages(table(spark, sf, "orders"), F.col("o_orderstatus"), p))


@query("select o_orderstatus as actual, case when o_totalprice > 150000 then 'F' else 'O' end as predicted, count(*) as n from orders group by 1, 2")
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return M.confusion(table(spark, sf, "orders"), F.col("o_orderstatus"), F.when(F.col("o_totalprice") > 150000, "F").otherwise("O"))


VECTORS = "(select label, " + ", ".join(f"round(embedding[{k + 1}], 2)::double as s{k}" for k in range(10)) + " from embeddings where label is not null)"
CLASS_PAIRS = [(i, j) for i in range(10) for j in range(i)]


def ten_classes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").filter("label is not null").select("label", *[F.round(F.col("embedding")[k], 2).cast("double").alias(f"s{k}") for k in range(10)])


@query(f"""with x as (select k, (label = k)::integer as y, [{", ".join(f"s{k}" for k in range(10))}][k + 1] as p from {VECTORS}, (select unnest(range(10)) as k)),
    r as (select k, y, rank() over (partition by k order by p) + (count(*) over (partition by k, p) - 1) / 2 as r from x)
    select round(avg(a), 6)::double as auc_ovr from (select k, {AUC} as a from r group by k)""")
def metric_auc_ovr(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.auc_one_vs_rest(ten_classes(spark, sf), "label", [f"s{k}" for k in range(10)]))


@query(f"""with x as ({" union all ".join(f"select {k} as k, (label = {i})::integer as y, s{i} - s{j} as p from {VECTORS} where label in ({i}, {j})" for k, (i, j) in enumerate(CLASS_PAIRS))}),
    r as (select k, y, rank() over (partition by k order by p) + (count(*) over (partition by k, p) - 1) / 2 as r from x)
    select round(avg(a), 6)::double as auc_mu from (select k, {AUC} as a from r group by k)""")
def metric_auc_mu(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.auc_mu(ten_classes(spark, sf), "label", [f"s{k}" for k in range(10)]))


def gini_sql(c: str) -> str:
    raw = "(select sum(c) / sum(s) as a, sum(n) as n from (select n * (cum - s) + s * (n + 1) / 2 as c, s, n from (select {k} as k, count(*) as n, sum(l_extendedprice) as s, sum(sum(l_extendedprice)) over (order by {k}) as cum from lineitem group by 1)))"
    own, best = raw.format(k=c), raw.format(k="l_extendedprice")
    return f"select '{c}' as feature, round(((p.a - (p.n + 1) / 2) / p.n) / ((y.a - (y.n + 1) / 2) / y.n), 6)::double as gini from {own} p, {best} y"


@query(" union all ".join(gini_sql(c) for c in ("l_quantity", "l_discount", "l_tax")))
def gini_columns(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.gini(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"))


@query(" union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) + 0.0 as r from lineitem" for a, b in [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount")]))
def corr_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.correlations(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


@query(f"select p as threshold, round(sum(sum(y)) over w / sum(sum(y)) over (), 6)::double as tpr, round(sum(sum(1 - y)) over w / sum(sum(1 - y)) over (), 6)::double as fpr from {SCORED} group by p window w as (order by p desc)")
def roc_curve(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.roc_points(scored(spark, sf), "y", "p"))


@query(f"select round(sum(s / t * cy / cn), 6)::double as average_precision from (select sum(y) as s, sum(sum(y)) over (order by p desc) as cy, sum(count(*)) over (order by p desc) as cn, sum(sum(y)) over () as t from {SCORED} group by p)")
def pr_curve_ap(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.average_precision(scored(spark, sf), "y", "p"))


@query(f"""select tp, fp, fn, tn, round(tp / (tp + fp), 6)::double as precision, round(tp / (tp + fn), 6)::double as recall, round(2 * tp / (2 * tp + fp + fn), 6)::double as f1
    from (select count(*) filter (p > 0.1 and y = 1) as tp, count(*) filter (p > 0.1 and y = 0) as fp, count(*) filter (p <= 0.1 and y = 1) as fn, count(*) filter (p <= 0.1 and y = 0) as tn from {SCORED})""")
def threshold_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.threshold_counts(scored(spark, sf), F.col("y"), F.col("p"), 0.1))


@query(f"""with b as (select least(greatest(ceil(p / 0.01)::integer, 1), 99) as b, sum(y)::double as s, count(*)::double as n from {SCORED} group by 1)
    select round(b * 0.01, 6)::double as cut, round(2 * (sum(s) over w) / ((sum(n) over w) + (sum(s) over ())), 6) as f1 from b window w as (order by b desc) order by 2 desc, 1 limit 1""")
def f1_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.best_f1(scored(spark, sf), F.col("y"), F.col("p")))


@query(f"""select floor((r - 1) * 20 / n)::integer as bin, count(*) as n, round(avg(y), 7) as mean_target, min(p) as min_pred, round(avg(p), 7) as mean_pred, max(p) as max_pred
    from (select *, row_number() over (order by p desc, event_id) as r, count(*) over () as n from {SCORED}) group by 1""")
def prediction_bins(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.prediction_bins(scored(spark, sf), F.col("y"), "p", ["event_id"]), 7)


@query("with l as (select min(l_extendedprice) as a, max(l_extendedprice) as b from lineitem) select least(floor((l_extendedprice - a) / (b - a) * 10) + 1, 10)::integer as bin, count(*) as n from lineitem, l group by 1")
def pdp_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return M.histogram(table(spark, sf, "lineitem"), "l_extendedprice")


@query(" union all ".join(f"select '{c}' as feature, 0.0::double as null_rate, min({c}) as min, round(quantile_cont({c}, 0.25), 4) as q25, round(avg({c}), 4) as mean, round(median({c}), 4) as median, round(quantile_cont({c}, 0.75), 4) as q75, max({c}) as max from lineitem" for c in ("l_quantity", "l_extendedprice")))
def profile_numeric(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.profile_numeric(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"]), 4)


def category_sql(c: str) -> str:
    return f"""select '{c}' as feature, 0.0::double as null_rate, count(*) as n_unique, arg_min(v, (-n, v)) as top_value, round(max(n) / sum(n), 6)::double as top_share,
        arg_min(v, (n, v)) as rare_value, round(min(n) / sum(n), 6)::double as rare_share from (select {c} as v, count(*) as n from part group by 1)"""


@query(" union all ".join(category_sql(c) for c in ("p_type", "p_brand")))
def profile_category(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.profile_category(table(spark, sf, "part"), ["p_type", "p_brand"]))


@query("select 'o_orderdate' as feature, 0.0::double as null_rate, min(o_orderdate) as min, max(o_orderdate) as max from orders")
def profile_datetime(spark: SparkSession, sf: str) -> DataFrame:
    return M.profile_dates(table(spark, sf, "orders"), ["o_orderdate"])


@query("select 'text' as feature, count(*) filter (length(coalesce(text, '')) = 0) as n_empty, min(length(text))::integer as shortest, max(length(text))::integer as longest from documents")
def profile_text(spark: SparkSession, sf: str) -> DataFrame:
    return M.profile_text(table(spark, sf, "documents"), ["text"])


@query(" union all ".join(f"select '{c}' as feature, 0.0::double as null_rate, round(max(n) / sum(n), 6)::double as constant_rate, round(max(n) / sum(n), 6)::double as constant_rate_known from (select count(*) as n from orders group by {c})" for c in ("o_orderstatus", "o_orderpriority")))
def constant_rate(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.constant_rates(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"]))


CURVE = f"""(select n, yt, yc, nt, n - nt as nc, max(n) over () as nn, max(nt) over () as tt from (select sum(count(*)) over w as n, sum(sum(t)) over w as nt, sum(sum(y * t)) over w as yt, sum(sum(y * (1 - t))) over w as yc
    from {SCORED} group by p window w as (order by p desc)))"""
VALUES = {"qini": "yt / tt - yc / (nn - tt)", "cum_gain": "(coalesce(yt / nullif(nt, 0), 0) - coalesce(yc / nullif(nc, 0), 0)) * n / nn", "adj_qini": "(yt - yc * coalesce(nt / nullif(nc, 0), 0)) / tt"}


def curve_sql(mode: str) -> str:
    return f"select n::bigint as n, round({VALUES[mode]}, 6)::double + 0.0 as value from {CURVE}"


@query(curve_sql("qini"))
def uplift_curve_qini(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.uplift_curve(scored(spark, sf), "y", "p", "t", "qini"))


@query(curve_sql("cum_gain"))
def uplift_curve_cumgain(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.uplift_curve(scored(spark, sf), "y", "p", "t", "cum_gain"))


@query(curve_sql("adj_qini"))
def uplift_curve_adjqini(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.uplift_curve(scored(spark, sf), "y", "p", "t", "adj_qini"))


@query(f"select round(sum((n - coalesce(lag_n, 0)) * (v + coalesce(lag_v, 0)) / 2) / max(n), 6)::double as auc from (select n, v, lag(n) over (order by n) as lag_n, lag(v) over (order by n) as lag_v from (select n::double as n, {VALUES['adj_qini']} as v from {CURVE}))")
def uplift_auc(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.uplift_auc(scored(spark, sf), "y", "p", "t"))


PERFECT = f"(select y, t, case when t = 1 then 2.0 * y else 1.0 - 2 * y end as p from {SCORED})"


def curve_area(of: str) -> str:
    return f"(select sum((n - coalesce(lag_n, 0)) * (v + coalesce(lag_v, 0)) / 2) / max(n) as a from (select n, v, lag(n) over (order by n) as lag_n, lag(v) over (order by n) as lag_v from (select n::double as n, {VALUES['adj_qini']} as v from {CURVE.replace(SCORED, of)})))"


@query(f"""select round((own.a - base.a) / (best.a - base.a), 6)::double as auc from {curve_area(SCORED)} own, {curve_area(PERFECT)} best,
    (select (avg(y) filter (t = 1) - avg(y) filter (t = 0)) / 2 as a from {SCORED}) base""")
def uplift_auc_normed(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.uplift_auc(scored(spark, sf), "y", "p", "t", normed=True))


@query(f"select round(coalesce(avg(y) filter (t = 1), 0) - coalesce(avg(y) filter (t = 0), 0), 6) as uplift from {SCORED} where p > (select quantile_cont(p, 0.7) from {SCORED})")
def uplift_at_k(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.uplift_at_top(scored(spark, sf), "y", "p", "t"))


@query(f"select round(avg(y) filter (t = 0 and p <= c) * (1 - avg(t)) + avg(y) filter (t = 1 and p > c) * avg(t), 6) as total_score from {SCORED}, (select quantile_cont(p, 0.7) as c from {SCORED})")
def uplift_total_score(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.total_score(scored(spark, sf), "y", "p", "t"))


@query(f"""select floor((r - 1) * 10 / n)::integer as bin, count(*) as n, min(p) as min_uplift, round(avg(p), 6) as mean_uplift, max(p) as max_uplift, round(avg(y) filter (t = 1) - avg(y) filter (t = 0), 6) as fact_uplift
    from (select *, row_number() over (order by p, event_id) as r, count(*) over () as n from {SCORED}) group by 1""")
def uplift_bins(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.uplift_bins(scored(spark, sf), "y", "p", "t", ["event_id"]))


@query("select l_linenumber as bin, min(l_extendedprice) as least, round(quantile_cont(l_extendedprice, 0.25), 4) as q25, round(quantile_cont(l_extendedprice, 0.5), 4) as median, round(quantile_cont(l_extendedprice, 0.75), 4) as q75, max(l_extendedprice) as greatest from lineitem group by 1")
def prediction_spread(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.spread_by_bin(table(spark, sf, "lineitem"), "l_extendedprice", "l_linenumber"), 4)


@query("""with e as (select l_quantity * 1500 - l_extendedprice as e from lineitem), r as (select min(e) as lo, max(e) as hi from e)
    select least(floor((e - lo) / (hi - lo) * 10) + 1, 10)::integer as bin, count(*) as n from e, r group by 1""")
def error_histogram(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem").withColumn("p", F.col("l_quantity") * 1500)
    return M.error_histogram(df, "l_extendedprice", "p")
