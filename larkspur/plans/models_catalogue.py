"""Queries over folds, selection, blending, text, vectors, models, presets and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.frame import Frame
from larkspur.functions import metrics
from larkspur.operators import blending, explain, models, selection, text, validation, vectors
from larkspur.operators.base import lineage
from larkspur.plans import automl, timeseries, uplift
from larkspur.plans.flagship import FOLDS, ROLES, credit_frame
from larkspur.plans.reader import Reader, class_codes
from larkspur.plans.registry import query, rounded, table
from larkspur.sources.readers import read_data, read_sql
from larkspur.streaming.scoring import sessions, windowed_counts


@query("select o_orderkey, (o_orderkey % 5)::integer as fold from orders")
def kfold(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", validation.key_fold("o_orderkey").alias("fold"))


@query("select o_orderkey, ((row_number() over (partition by o_orderstatus order by o_orderkey) - 1) % 5)::integer as fold from orders")
def stratified_kfold(spark: SparkSession, sf: str) -> DataFrame:
    return validation.stratified_folds(table(spark, sf, "orders"), "o_orderstatus", ["o_orderkey"]).select("o_orderkey", "fold")


@query("select o_orderkey, (o_custkey % 5)::integer as fold from orders")
def group_kfold(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", validation.key_fold("o_custkey").alias("fold"))


@query("""with t as (select event_id, epoch_us(ts)::double as t from events), q as (select quantile_cont(t, [0.2, 0.4, 0.6, 0.8]) as q from t)
    select event_id, len(list_filter(q, lambda x: x < t))::integer as fold from t, q""")
def time_folds(spark: SparkSession, sf: str) -> DataFrame:
    return validation.time_folds(table(spark, sf, "events"), "ts").select("event_id", "fold")


@query("select event_id, ((ts > timestamp '2024-01-10')::integer + (ts > timestamp '2024-01-20')::integer)::integer as fold from events")
def date_folds(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", validation.date_folds("ts", ["2024-01-10", "2024-01-20"]).alias("fold"))


@query("""select k::integer as split, count(*) filter (t = 0 or f <> k) as n_train, count(*) filter (t = 1 and f = k) as n_valid
    from (select c_custkey % 2 as t, c_custkey % 5 as f from customer), (select unnest([0, 1, 2, 3, 4]) as k) group by k""")
def uplift_folds(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "customer").select((F.col("c_custkey") % 2).alias("t"), (F.col("c_custkey") % 5).alias("f"))
    counts = [F.struct(F.lit(k).alias("split"), F.count_if(s.train).alias("n_train"), F.count_if(s.valid).alias("n_valid")) for k, s in enumerate(validation.uplift_folds("t", 1, "f", 5))]
    return df.agg(F.array(*counts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


SCORES = "(select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_orderkey % 7 = 0 then null else l_discount end as a, l_tax as b, l_quantity / 50 as c from lineitem)"


def three_scores(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return table(spark, sf, "lineitem").select(*keys, F.when(F.col("l_orderkey") % 7 != 0, F.col("l_discount")).alias("a"), F.col("l_tax").alias("b"), (F.col("l_quantity") / 50).alias("c"))


@query(f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, round((coalesce(a, 0) + b + c) / (3 - (a is null)::integer), 6) + 0.0 as blend from {SCORES}")
def mean_blend(spark: SparkSession, sf: str) -> DataFrame:
    df = three_scores(spark, sf)
    return rounded(df.select(*df.columns[:4], blending.mean(["a", "b", "c"]).alias("blend")))


@query(f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, round((coalesce(a * 0.5, 0) + b * 0.3 + c * 0.2) / (0.5 + (a is not null)::integer * 0.5), 6)::double + 0.0 as blend from {SCORES}")
def weighted_blend(spark: SparkSession, sf: str) -> DataFrame:
    df = three_scores(spark, sf)
    return rounded(df.select(*df.columns[:4], blending.weighted_mean(["a", "b", "c"], [0.5, 0.3, 0.2]).alias("blend")))


@query()
def blend_search(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("a"), F.lit(38000.0).alias("b"))
    task = models.Task("reg")
    made = blending.WeightedBlender(lambda d, p: task.scores(d, "y", p), 2).fit(df, ["a", "b"])
    return spark.createDataFrame([(p, round(w, 4)) for p, w in zip("ab", made.weights, strict=True)], "prediction string, weight double")


WIDE = "(select 2 * l_extendedprice + 1 as twice, l_extendedprice, l_discount, l_tax, 1.0 as same from lineitem)"
WIDE_COLUMNS = ["twice", "l_extendedprice", "l_discount", "l_tax", "same"]
PAIRS = [(a, b) for i, a in enumerate(WIDE_COLUMNS[:4]) for b in WIDE_COLUMNS[i + 1 : 4]]


@query(f"""with s as (select unnest({WIDE_COLUMNS}) as feature, unnest([{', '.join(f'stddev_pop({c})' for c in WIDE_COLUMNS)}]) as sd from {WIDE}),
    r as (select unnest({[a for a, _ in PAIRS]}) as a, unnest([{', '.join(f'corr({a}, {b})' for a, b in PAIRS)}]) as r from {WIDE})
    select feature from s where sd > 0 and feature not in (select a from r where abs(r) > 0.98)""")
def high_correlation_removal(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem").withColumn("twice", F.col("l_extendedprice") * 2 + 1).withColumn("same", F.lit(1.0))
    left = selection.without_correlated(df, WIDE_COLUMNS)
    return spark.createDataFrame([(c,) for c in left], "feature string")


#: made feature -> its expression and its source
MADE = {"raw__l_quantity": ("l_quantity", "l_quantity"), "log__l_quantity": ("ln(l_quantity)", "l_quantity"), "raw__l_discount": ("l_discount", "l_discount"), "sqrt__l_discount": ("sqrt(l_discount)", "l_discount"), "raw__l_tax": ("l_tax", "l_tax")}


@query(f"""select source as feature, round(sum(i), 6)::double as importance from (select unnest({[s for _, s in MADE.values()]}) as source, unnest([{', '.join(f'abs(corr({e}, l_extendedprice))' for e, _ in MADE.values())}]) as i from lineitem) group by 1""")
def importance_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """The size of each made feature's correlation with the price as its importance, summed by source column."""
    row = table(spark, sf, "lineitem").agg(*[F.abs(F.corr(F.expr(e), F.col("l_extendedprice"))).alias(c) for c, (e, _) in MADE.items()]).first()
    names = lineage(["l_quantity", "l_discount", "l_tax"], list(MADE))
    found = selection.roll_up(row.asDict(), names.get)
    return rounded(spark.createDataFrame(found, "feature string, importance double"))


LIST = "list_filter(string_split(lower(trim(regexp_replace(regexp_replace(trim(coalesce(text, '')), '[^A-Za-z0-9]+', ' ', 'g'), '\\b[0-9]+\\b', ' ', 'g'))), ' '), lambda w: w <> '')"


@query(f"select doc_id, len({LIST})::integer as n_tokens, md5(coalesce(array_to_string({LIST}, ' '), '')) as tokens_md5 from documents")
def tokenize_en(spark: SparkSession, sf: str) -> DataFrame:
    tokens = text.tokens_en(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(tokens).alias("n_tokens"), F.md5(F.array_join(tokens, " ")).alias("tokens_md5"))


@query("select doc_id, coalesce(lang, '') || ' [SEP] ' || coalesce(source, '') as concated__lang__source from documents")
def concat_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.concatenated(["lang", "source"]).alias("concated__lang__source"))


WORDS = "(select doc_id, unnest(list_filter(string_split(lower(trim(regexp_replace(regexp_replace(trim(text), '[^A-Za-z0-9]+', ' ', 'g'), '\\b[0-9]+\\b', ' ', 'g'))), ' '), lambda w: w <> '')) as token from documents)"


def tokenised(spark: SparkSession, sf: str) -> DataFrame:
    # dealt by key before the tokens are made, so that counts within a document need no shuffle of tokens
    return table(spark, sf, "documents").select("doc_id", "text").repartition("doc_id").select("doc_id", text.tokens_en(F.col("text")).alias("tokens"))


@query(f"""with tf as (select doc_id, token, count(*) as tf from {WORDS} group by 1, 2), w as (select token, ln((1 + (select count(*) from documents)) / (1 + count(*))) + 1 as idf from tf group by 1 having count(*) >= 20),
    x as (select doc_id, token, tf * idf as w from tf join w using (token)) select doc_id, token, round(w / sqrt(sum(w * w) over (partition by doc_id)), 6) as weight from x""")
def tfidf(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(text.tf_idf(tokenised(spark, sf), "doc_id", "tokens", 20, None))


@query(f"select token, round(ln(1 + ((select count(*) from documents) + 1) / (count(distinct doc_id) + 1)), 6) as weight from {WORDS} group by 1")
def wat_idf(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(text.word_weights(tokenised(spark, sf), "tokens"))


@query(f"select token, round(0.001 / (0.001 + (count(distinct doc_id) + 1) / ((select count(*) from documents) + 1)), 6)::double as weight from {WORDS} group by 1")
def sif_weights(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(text.word_weights(tokenised(spark, sf), "tokens", "sif"))


@query(f"select token, count(*) as n, count(distinct doc_id) as df from {WORDS} group by 1 order by n desc, token limit 50")
def vocab_topk(spark: SparkSession, sf: str) -> DataFrame:
    return text.vocabulary(tokenised(spark, sf), "tokens", 1, 50)


@query()
def pca(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(vectors.PrincipalComponents("embedding", 4).fit(table(spark, sf, "embeddings")).transform(table(spark, sf, "embeddings")).drop("embedding"), 5)


@query()
def svd(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(vectors.SingularVectors("embedding", 4).fit(table(spark, sf, "embeddings")).transform(table(spark, sf, "embeddings")).drop("embedding"), 5)


@query("select o_orderstatus as value, (row_number() over (order by count(*) desc, o_orderstatus) - 1)::integer as code from orders group by 1")
def class_mapping(spark: SparkSession, sf: str) -> DataFrame:
    return class_codes(table(spark, sf, "orders"), "o_orderstatus")


TEXTS = "(select o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, o_totalprice::varchar as price_text, strftime(o_orderdate, '%Y-%m-%d') as date_text, 1 as same from orders)"


def role_sql(c: str) -> str:
    """The role of a column by its type, or by what its texts can be cast to; none for a constant."""
    fails = lambda t: f"count(*) filter ({c} is not null and try_cast({c}::varchar as {t}) is null) = 0"
    kind = f"any_value(typeof({c}))"
    numeric = f"{kind} in ('DOUBLE', 'FLOAT', 'INTEGER', 'BIGINT', 'SMALLINT') or {kind} like 'DECIMAL%' or ({kind} = 'VARCHAR' and {fails('double')})"
    date = f"{kind} = 'DATE' or {kind} like 'TIMESTAMP%' or ({kind} = 'VARCHAR' and {fails('timestamp')})"
    return f"select '{c}' as feature, case when {numeric} then 'numeric' when {date} then 'datetime' else 'category' end as role from {TEXTS} having count(distinct {c}) > 1"


@query(" union all ".join(role_sql(c) for c in ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "price_text", "date_text", "same")))
def role_guess(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "orders").withColumns({"price_text": F.col("o_totalprice").cast("string"), "date_text": F.date_format("o_orderdate", "yyyy-MM-dd"), "same": F.lit(1)})
    frame = Reader("reg", ["o_orderkey"], folds=1).fit_read(df, {})
    return spark.createDataFrame([(c, r.name) for c, r in frame.roles.items()], "feature string, role string")


@query("select o_orderpriority, count(*) as n from orders group by 1")
def read_by_sql(spark: SparkSession, sf: str) -> DataFrame:
    return read_sql(spark, "select o_orderpriority, count(*) as n from orders_view group by 1", {"orders_view": read_data(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_orderpriority"])})


@query("select date_trunc('hour', ts) as window_start, event_type, count(*) as n from events group by 1, 2")
def windowed_event_counts(spark: SparkSession, sf: str) -> DataFrame:
    return windowed_counts(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"])


@query("""with g as (select *, coalesce((ts - lag(ts) over (partition by user_id order by ts) >= interval 6 hour)::integer, 0) as gap from events),
    s as (select *, sum(gap) over (partition by user_id order by ts) as s from g) select user_id, min(ts) as session_start, max(ts) + interval 6 hour as session_end, count(*) as n from s group by user_id, s""")
def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return sessions(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["user_id"], "6 hours")


def ready(spark: SparkSession, sf: str) -> Frame:
    return automl.linear_features().fit_transform(credit_frame(spark, sf))


@query()
def lr_oof(spark: SparkSession, sf: str) -> DataFrame:
    f = ready(spark, sf)
    return models.OutOfFold(models.Algorithm("linear"), models.Task("binary")).fit_predict(f, validation.k_folds("fold", FOLDS)).select("o_orderkey", "y", "fold", "p")


@query()
def gbt_oof(spark: SparkSession, sf: str) -> DataFrame:
    f = automl.simple_features().fit_transform(credit_frame(spark, sf))
    return models.OutOfFold(models.Algorithm("gbt", {"maxIter": 5}), models.Task("binary")).fit_predict(f, validation.k_folds("fold", FOLDS)).select("o_orderkey", "y", "fold", "p")


@query()
def rf_oof(spark: SparkSession, sf: str) -> DataFrame:
    f = automl.simple_features().fit_transform(credit_frame(spark, sf))
    return models.OutOfFold(models.Algorithm("forest", {"numTrees": 10, "maxDepth": 5}), models.Task("binary")).fit_predict(f, validation.k_folds("fold", FOLDS)).select("o_orderkey", "y", "fold", "p")


@query()
def automl_binary(spark: SparkSession, sf: str) -> DataFrame:
    declared = {c: r for c, r in ROLES.items() if c != "fold"}
    df = credit_frame(spark, sf).df.drop("fold")
    return automl.TabularAutoML(models.Task("binary"), ["o_orderkey"], (("linear_l2", "forest"),), 2).fit_predict(df, declared)


@query()
def automl_reg(spark: SparkSession, sf: str) -> DataFrame:
    df = credit_frame(spark, sf).df.drop("fold", "y")
    return automl.TabularAutoML(models.Task("reg"), ["o_orderkey"], (("forest",),), 2).fit_predict(df, {"target": "o_totalprice"})


@query()
def scorecard(spark: SparkSession, sf: str) -> DataFrame:
    declared = {c: r for c, r in ROLES.items() if c != "fold"}
    return automl.TabularAutoML(models.Task("binary"), ["o_orderkey"], (("scorecard",),), 2).fit_predict(credit_frame(spark, sf).df.drop("fold"), declared)


@query()
def autots(spark: SparkSession, sf: str) -> DataFrame:
    daily = table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    return timeseries.Forecaster(["event_type"], "day", "v", 3, 5).fit(daily).predict(daily)


def treated(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select("c_custkey", "c_acctbal", (F.col("c_nationkey") % 3).cast("double").alias("n"), (F.col("c_custkey") % 2).cast("int").alias("t"), (F.col("c_acctbal") + 900 * (F.col("c_custkey") % 2) > 4500).cast("int").alias("y"))


@query()
def uplift_tlearner(spark: SparkSession, sf: str) -> DataFrame:
    df = treated(spark, sf)
    made = uplift.TLearner(["c_acctbal", "n"], "y", "t", uplift.fitter(models.Task("binary"))).fit(df).predict(df)
    return made.select("c_custkey", "treated", "untreated", "uplift")


@query()
def uplift_xlearner(spark: SparkSession, sf: str) -> DataFrame:
    df = treated(spark, sf)
    made = uplift.XLearner(["c_acctbal", "n"], "y", "t", uplift.fitter(models.Task("binary"))).fit(df).predict(df)
    return made.select("c_custkey", "uplift")


KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cents"]
JOINED = " || '|' || ".join(KEYS)


def shuffled_sql(column: str) -> str:
    other = "l_tax" if column == "l_quantity" else "l_quantity"
    return f"""select '{column}' as feature, avg(pow(y - (l_quantity * 1.5 + l_tax), 2)) as mse from (
        select y, {other}, {column} from (select *, row_number() over (order by md5('42|' || {JOINED}), {', '.join(KEYS)}) as n from lines_) a
        join (select {column}, row_number() over (order by md5('43|{column}|' || {JOINED}), {', '.join(KEYS)}) as n from lines_) b using (n))""".replace("select *, row_number", f"select y, {other}, row_number")


@query(f"""with lines_ as (select {', '.join(KEYS[:4])}, round(l_extendedprice * 100)::bigint as cents, l_quantity, l_tax, l_extendedprice / 1000 as y from lineitem), base as (select avg(pow(y - (l_quantity * 1.5 + l_tax), 2)) as mse from lines_)
    select feature, round(s.mse - base.mse, 4)::double + 0.0 as importance from ({shuffled_sql('l_quantity')} union all {shuffled_sql('l_tax')}) s, base""")
def permutation_importance(spark: SparkSession, sf: str) -> DataFrame:
    """Importances of a given formula's inputs: the score lost when a column is dealt anew among the rows."""
    df = table(spark, sf, "lineitem").select(*KEYS[:4], F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), "l_quantity", "l_tax", (F.col("l_extendedprice") / 1000).alias("y"))
    task = models.Task("reg")
    score = lambda d: task.score(d.withColumn("p", F.col("l_quantity") * 1.5 + F.col("l_tax")), "y", "p")
    found = selection.permutation_importances(df, KEYS, ["l_quantity", "l_tax"], score)
    return rounded(spark.createDataFrame([(c, float(v)) for c, v in found.items()], "feature string, importance double"), 4)


def group_means(df: DataFrame, target: str, features: list[str], weight: str | None = None) -> uplift.Scorer:
    """The plainest model: the (weighted) mean of the target for each combination of the features."""
    w = F.col(weight) if weight else F.lit(1.0)
    table_ = df.groupBy(*features).agg(F.round(F.sum(F.col(target) * w) / F.sum(w), 9).alias("m_"))
    return lambda d, name: d.join(table_.withColumnRenamed("m_", name), features, "left")


ARMS = "(select c_custkey, (c_nationkey % 3)::double as n, (c_custkey % 2)::integer as t, (c_acctbal + 900 * (c_custkey % 2) > 4500)::integer as y from customer)"

def by_learner(learner: str, spark: SparkSession, sf: str) -> DataFrame:
    df = treated(spark, sf).select("c_custkey", "n", "t", "y")
    made = uplift.LEARNERS[learner](["n"], "y", "t", group_means, group_means, group_means).fit(df).predict(df)
    return rounded(made.select("c_custkey", "uplift"))


def two_means(first: str, second: str) -> str:
    return f"select c_custkey, round(a - b, 6)::double + 0.0 as uplift from {ARMS} join (select n, round({first}, 9) as a, round({second}, 9) as b from {ARMS} group by 1) using (n)"


@query(two_means("avg(y) filter (t = 1)", "avg(y) filter (t = 0)"))
def uplift_means_s(spark: SparkSession, sf: str) -> DataFrame:
    return by_learner("s", spark, sf)


@query(two_means("avg(y) filter (t = 1)", "avg(y) filter (t = 0)"))
def uplift_means_t(spark: SparkSession, sf: str) -> DataFrame:
    return by_learner("t", spark, sf)


WEIGHTED = "sum(y * case when t = {} then 1 else 0.25 end) / sum(case when t = {} then 1 else 0.25 end)"


@query(two_means(WEIGHTED.format(1, 1), WEIGHTED.format(0, 0)))
def uplift_means_t2(spark: SparkSession, sf: str) -> DataFrame:
    return by_learner("t2", spark, sf)


def squares(df: DataFrame, target: str, features: list[str], weight: str | None = None) -> uplift.Scorer:
    """A line through the target over the square of the last feature: what a learner feeds in as last bends the curve."""
    x = F.round(F.col(features[-1]) * F.col(features[-1]), 9)
    row = df.agg(F.regr_slope(F.col(target).cast("double"), x).alias("b"), F.regr_intercept(F.col(target).cast("double"), x).alias("a")).first()
    return lambda d, name: d.withColumn(name, F.round(F.lit(row["a"]) + F.lit(row["b"]) * x, 9))


@query(f"""with a as (select *, n + c_custkey % 4 as z from {ARMS}),
    f as (select regr_slope(y, round(z * z, 9)) as b, regr_intercept(y, round(z * z, 9)) as a from a where t = 1),
    k as (select c_custkey, y, t, round(f.a + f.b * round(z * z, 9), 9) as other from a, f),
    g as (select regr_slope(y, round(other * other, 9)) as b, regr_intercept(y, round(other * other, 9)) as a from k where t = 0)
    select c_custkey, round(other - round(g.a + g.b * round(other * other, 9), 9), 6)::double + 0.0 as uplift from k, g""")
def uplift_means_td(spark: SparkSession, sf: str) -> DataFrame:
    """The treated arm's prediction is the last feature of the other arm's model, which is a curve in it: not the difference of two models of the arms."""
    df = treated(spark, sf).select("c_custkey", (F.col("n") + F.pmod("c_custkey", F.lit(4))).alias("z"), "t", "y")
    made = uplift.TDLearner(["z"], "y", "t", squares, dependent=0).fit(df).predict(df)
    return rounded(made.select("c_custkey", "uplift"))


@query(f"""with m as (select n, round(avg(y) filter (t = 1), 9) as m1, round(avg(y) filter (t = 0), 9) as m0, round(avg(t), 9) as c from {ARMS} group by 1),
    e as (select n, round(avg(y - m0) filter (t = 1), 9) as e1, round(avg(m1 - y) filter (t = 0), 9) as e0 from {ARMS} join m using (n) group by 1)
    select c_custkey, round(c * e1 + (1 - c) * e0, 6)::double + 0.0 as uplift from {ARMS} join m using (n) join e using (n)""")
def uplift_means_x(spark: SparkSession, sf: str) -> DataFrame:
    return by_learner("x", spark, sf)


@query(f"""with m as (select n, round(avg(y), 9) as m, round(avg(t), 9) as c from {ARMS} group by 1), r as (select n, (y - m) / (t - c + 1e-5) as d, pow(t - c + 1e-5, 2) as w from {ARMS} join m using (n)),
    e as (select n, round(sum(d * w) / sum(w), 9) as e from r group by 1) select c_custkey, round(e, 6)::double + 0.0 as uplift from {ARMS} join e using (n)""")
def uplift_means_r(spark: SparkSession, sf: str) -> DataFrame:
    return by_learner("r", spark, sf)


@query("""with f as (select l_quantity, l_discount, l_tax from lineitem), m as (select avg(l_quantity) as q, avg(l_discount) as d, avg(l_tax) as t from f)
    select 'l_quantity' as feature, round(avg(abs(2 * (l_quantity - q) + (l_quantity * l_discount - q * d + l_quantity * d - q * l_discount) / 2)), 6)::double as importance from f, m
    union all select 'l_discount', round(avg(abs((l_quantity * l_discount - q * d + q * l_discount - l_quantity * d) / 2)), 6)::double from f, m
    union all select 'l_tax', round(avg(abs(30 * (l_tax - t))), 6)::double from f, m""")
def shap_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Shapley values of a formula with an interaction, whose exact values are known: an order and its reverse give them."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    df = table(spark, sf, "lineitem").select(*keys, "l_quantity", "l_discount", "l_tax")
    formula = 2 * F.col("l_quantity") + F.col("l_quantity") * F.col("l_discount") + 30 * F.col("l_tax")
    values = explain.shapley_values(df, keys, ["l_quantity", "l_discount", "l_tax"], lambda d: d.withColumn("p", formula), samples=2)
    return rounded(explain.shapley_rank(values))


@query("""with f as (select l_quantity as q, l_discount as d, l_tax as t, l_extendedprice / 1000 as p from lineitem), m as (select avg(q) as q0, avg(d) as d0, avg(t) as t0, avg(p) as p0 from f),
    v as (select 2 * (q - q0) + (q * d - q0 * d0 + q * d0 - q0 * d) / 2 as q, (q * d - q0 * d0 + q0 * d - q * d0) / 2 as d,
        30 * (t - t0) + (t * p - t0 * p0 + t * p0 - t0 * p) / 2 as t, (t * p - t0 * p0 + t0 * p - t * p0) / 2 as p from f, m)
    select unnest(['l_quantity', 'l_discount', 'l_tax', 'thousands']) as feature, unnest([round(avg(abs(q)), 6), round(avg(abs(d)), 6), round(avg(abs(t)), 6), round(avg(abs(p)), 6)]) as importance from v""")
def shap_stratified(spark: SparkSession, sf: str) -> DataFrame:
    """Stratified Shapley values of a formula with two interactions; four features have sixteen coalitions, so all are met and the values are exact."""
    keys, features = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "n"], ["l_quantity", "l_discount", "l_tax", "thousands"]
    df = table(spark, sf, "lineitem").withColumns({"thousands": F.col("l_extendedprice") / 1000, "n": F.xxhash64("l_shipdate", "l_extendedprice", "l_quantity")})
    formula = 2 * F.col("l_quantity") + F.col("l_quantity") * F.col("l_discount") + 30 * F.col("l_tax") + F.col("l_tax") * F.col("thousands")
    values = explain.stratified_shapley(df.select(*keys, *features), keys, features, lambda d: d.withColumn("p", formula), samples=16)
    return rounded(explain.shapley_rank(values))


@query("""with r as (select *, row_number() over (partition by c_mktsegment, t order by md5('42|' || c_custkey), c_custkey) - 1 as p, count(*) over (partition by c_mktsegment, t) as n from (select c_custkey, c_mktsegment, c_custkey % 2 as t from customer))
    select c_custkey, p >= round(n * 0.8) as is_test from r""")
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", (F.col("c_custkey") % 2).alias("t"))
    return validation.stratified_split(df, ["c_mktsegment", "t"], ["c_custkey"]).select("c_custkey", "is_test")


MEANS = {
    "s": ("avg(y) filter (t = 1)", "avg(y) filter (t = 0)"),
    "t": ("avg(y) filter (t = 1)", "avg(y) filter (t = 0)"),
    "t2": (WEIGHTED.format(1, 1), WEIGHTED.format(0, 0)),
    "td": ("avg(y) filter (t = 1)", "avg(y) filter (t = 0)"),
}
FIVES = ARMS.replace("(c_nationkey % 3)::double as n", "(c_nationkey % 5 + 5 * floor(c_acctbal / 2500))::double as n")
EFFECTS = {
    **{k: f"select n, round({a}, 9) - round({b}, 9) as u from fives group by n" for k, (a, b) in MEANS.items()},
    "x": "select n, c * e1 + (1 - c) * e0 as u from (select n, round(avg(y - m0) filter (t = 1), 9) as e1, round(avg(m1 - y) filter (t = 0), 9) as e0 from fives join means using (n) group by n) join means using (n)",
    "r": "select n, round(sum(d * w) / sum(w), 9) as u from (select n, (y - m) / (t - c + 1e-5) as d, pow(t - c + 1e-5, 2) as w from fives join means using (n)) group by n",
}


@query(f"""with fives as {FIVES}, means as (select n, round(avg(y) filter (t = 1), 9) as m1, round(avg(y) filter (t = 0), 9) as m0, round(avg(y), 9) as m, round(avg(t), 9) as c from fives group by n),
    effects as ({" union all ".join(f"select '{k}' as name, {i} as place, e.* from ({sql}) e" for i, (k, sql) in enumerate(EFFECTS.items()))}),
    tied as (select name, place, round(u, 9) as u, count(*) as n, sum(t) as nt, sum(y * t) as yt, sum(y * (1 - t)) as yc from fives join effects using (n) where u is not null group by 1, 2, 3),
    cum as (select name, place, sum(n) over w as n, sum(nt) over w as nt, sum(yt) over w as yt, sum(yc) over w as yc, sum(nt) over (partition by name) as all_t from tied window w as (partition by name order by u desc)),
    points as (select name, place, n, (yt - yc * coalesce(nt / nullif(n - nt, 0), 0)) / all_t as v from cum),
    steps as (select name, place, n, v, lag(n, 1, 0) over (partition by name order by n) as n0, lag(v, 1, 0) over (partition by name order by n) as v0 from points),
    scores as (select name, place, round(sum((n - n0) * (v + v0) / 2) / max(n), 9) as score from steps group by 1, 2)
    select name, round(score, 6)::double as score, row_number() over (order by score desc, place)::integer as rank from scores""")
def learner_rating(spark: SparkSession, sf: str) -> DataFrame:
    """The six uplift learners, fitted on groups of nation and balance, rated by the area under their uplift curves."""
    df = table(spark, sf, "customer")
    group = (F.col("c_nationkey") % 5 + 5 * F.floor(F.col("c_acctbal") / 2500)).cast("double").alias("n")
    df = df.select("c_custkey", group, (F.col("c_custkey") % 2).cast("int").alias("t"), (F.col("c_acctbal") + 900 * (F.col("c_custkey") % 2) > 4500).cast("int").alias("y"))
    scores = None
    for place, (name, learner) in enumerate(uplift.LEARNERS.items()):
        made = learner(["n"], "y", "t", group_means, group_means, group_means).fit(df).predict(df).withColumn("u", F.round("uplift", 9))
        one = metrics.uplift_auc(made, "y", "u", "t").select(F.lit(name).alias("name"), F.round("auc", 9).alias("score"), F.lit(place).alias("place"))
        scores = one if scores is None else scores.unionByName(one)
    return rounded(uplift.rating(scores))
