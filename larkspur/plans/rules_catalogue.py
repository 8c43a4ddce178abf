"""Queries over role rules, with the SQL of every gini."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur import roles as R
from larkspur.frame import Frame
from larkspur.functions import metrics
from larkspur.operators import datetimes, dependence, lime, text, validation
from larkspur.operators.scorecard import ScorecardBins
from larkspur.operators.stl import Decomposition
from larkspur.plans import role_rules as A
from larkspur.plans.registry import query, rounded, table
from larkspur.storage import stored

NUMBERS, TEXTS = ["price", "nation", "acct"], ["priority", "segment"]
UNPIVOTED = " union all ".join(
    [f"select '{c}' as feature, {c} as number, null::varchar as text, f, y from customers" for c in NUMBERS] + [f"select '{c}', null, {c}, f, y from customers" for c in TEXTS]
)
LOSS = "least(greatest((vs - s + a * (ws - fs) / (wn - fn)) / (vn - n + a), 1e-7::double), 1 - 1e-7::double)"
STATS = f"""
    customers as (select (o_orderstatus = 'F')::integer::double as y, o_orderkey % 5 as f, o_totalprice as price, c_nationkey::double as nation,
        case when c_acctbal >= 0 then c_acctbal end as acct, o_orderpriority as priority, c_mktsegment as segment from orders join customer on o_custkey = c_custkey),
    long as ({UNPIVOTED}),
    cells as (select feature, number, text, f, count(*) as n, sum(y) as s from long group by all),
    vals as (select feature, number, text, sum(n) as n, sum(s) as s, number is not null or text is not null as have from cells group by all),
    cuts as (select feature, list_distinct(quantile_cont(number, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) as cuts from long where number is not null group by 1),
    keys as (
        select c.feature, 'encoded' as kind, case when v.n <= 5 then 'rare' when v.have then 'v' || coalesce(c.number::varchar, c.text) else 'null' end as key, f, c.n, c.s, v.have
        from cells c join vals v on c.feature = v.feature and c.number is not distinct from v.number and c.text is not distinct from v.text
        union all
        select c.feature, 'binned', case when number is null then 0 else len(list_filter(cuts, lambda q: q < number)) + 1 end::varchar, f, n, s, number is not null from cells c join cuts using (feature)
    ),
    keyed as (select feature, kind, key, f, sum(n) as n, sum(s) as s, coalesce(sum(n) filter (have), 0) as kn, coalesce(sum(s) filter (have), 0) as ks from keys group by 1, 2, 3, 4),
    sums as (select *, sum(n) over k as vn, sum(s) over k as vs, sum(n) over g as fn, sum(s) over g as fs, sum(n) over w as wn, sum(s) over w as ws from keyed
        window k as (partition by feature, kind, key), g as (partition by feature, kind, f), w as (partition by feature, kind)),
    losses as (select feature, kind, a, -sum(s * ln({LOSS}) + (n - s) * ln(1 - {LOSS})) as loss from sums, (select unnest([0.5, 1, 2, 5, 10, 50, 250, 1000]::double[]) as a) group by 1, 2, 3),
    alphas as (select feature, kind, arg_min(a, {{'l': loss, 'a': a}}) as a from losses group by 1, 2),
    told as (
        select feature, kind, (vs - s + a * (ws - fs) / (wn - fn)) / (vn - n + a) as p, kn as n, ks as s from sums join alphas using (feature, kind) where kn > 0
        union all select feature, 'raw', number, n, s from vals where number is not null
        union all select feature, 'freq', n, n, s from vals where have
        union all select feature, 'ord', case when n > 5 then dense_rank() over (partition by feature order by n <= 5, text) else 1e12 end, n, s from vals where text is not null
        union all select feature, 'nulls', (not have)::integer, n, s from vals
    ),
    tied as (select feature, kind, p, sum(n) as n, sum(s) as s from told group by 1, 2, 3),
    ordered as (select *, sum(s) over (partition by feature, kind order by p) as cum from tied),
    ginis as (select feature, kind, abs(coalesce(((sum(n * (cum - s) + s * (n + 1) / 2) / nullif(sum(s), 0) - (sum(n) + 1) / 2) / sum(n)) / nullif((sum(s) - sum(n)) / (2 * sum(n)), 0), 0)) as gini from ordered group by 1, 2),
    facts as (select feature, count(*) filter (have) as n_unique, sum(n) as n_rows, max(n) filter (have) as top_freq, coalesce(sum(n) filter (not have), 0) as n_null from vals group by 1),
    stats as (select f.feature, f.feature in {tuple(NUMBERS)} as is_number, n_unique, n_unique / n_rows as unique_rate, top_freq::bigint as top_freq, n_null / n_rows as null_rate,
        {", ".join(f"max(gini) filter (kind = '{k}') as {k}" for k in A.KINDS)} from facts f join ginis g using (feature) group by all)
"""


def credit_columns(spark: SparkSession, sf: str) -> Frame:
    """Orders with numbers and texts of their customers; balances below zero count as unknown."""
    customer = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("acct"), F.col("c_mktsegment").alias("segment"))
    df = table(spark, sf, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    y, fold = (F.col("o_orderstatus") == "F").cast("int").alias("y"), F.pmod("o_orderkey", F.lit(5)).alias("f")
    df = df.select("o_orderkey", y, fold, F.col("o_totalprice").alias("price"), "nation", "acct", F.col("o_orderpriority").alias("priority"), "segment")
    return Frame(df, {"y": R.make("target"), "f": R.make("folds")} | dict.fromkeys(NUMBERS, R.numeric()) | dict.fromkeys(TEXTS, R.category()), ["o_orderkey"])


SHOWN = ", ".join(f"round({c}, 6) as {c}" for c in ("unique_rate", "null_rate", *A.KINDS))


@query(f"with {STATS} select feature, is_number, n_unique, top_freq, {SHOWN} from stats")
def role_stats(spark: SparkSession, sf: str) -> DataFrame:
    """How well five columns of orders and customers tell the status F, in six encodings."""
    return rounded(A.role_stats(credit_columns(spark, sf), NUMBERS, TEXTS, "y", "f"))


def best_sql(names: list[str]) -> str:
    return "list_sort([" + ", ".join(f"{{'v': coalesce({c}, 0), 'k': {k}}}" for k, c in enumerate(names)) + "])"


@query(f"""with {STATS},
    sorted as (select *, {best_sql(["raw", "binned", "encoded", "freq"])} as l, {best_sql(["encoded", "freq", "ord"])} as c from stats),
    tops as (select *, case when is_number then l[4]['v'] else c[3]['v'] end as best, max(l[4]['v']) filter (is_number) over () as most from sorted),
    rules as (select *, l[4]['k'] = 0 as rule_0, l[4]['k'] = 1 as rule_1, n_unique <= 2 as rule_2, unique_rate > 0.999 as rule_3, best < 1.1 * l[2]['v'] as rule_4,
        l[4]['k'] = 1 and best > 2 * l[2]['v'] as rule_5, l[3]['k'] = 0 and best < 1.1 * l[3]['v'] as rule_6, best < 0.2 * most or best < 0.04 as rule_7, feature = 'acct' as rule_8 from tops),
    stay as (select *, is_number and (rule_0 or rule_1 or rule_2 or rule_3 or rule_4 or rule_5 or rule_6 or rule_7 or rule_8) as stays from rules)
    select feature, {", ".join(f"is_number and rule_{k} as rule_{k}" for k in range(9))}, round(best, 6) as max_score,
        case when greatest(best, nulls) < 0.002 then 'drop' when stays then 'numeric' else 'category' end as role,
        stays and not rule_7 and coalesce(binned > 2 * raw, false) as discretization,
        case when stays then null when is_number then (case when freq > 1.3 * encoded then 'freq' when n_unique < 10 then 'int' else 'auto' end) when c[3]['k'] = 1 then 'freq' else 'auto' end as encoding,
        case when stays then false when is_number then unique_rate > 0.01 else c[3]['k'] = 2 end as ordinal
    from stay""")
def role_rules(spark: SparkSession, sf: str) -> DataFrame:
    """What the rules decide from those figures, one column being declared a number."""
    return rounded(A.role_rules(A.role_stats(credit_columns(spark, sf), NUMBERS, TEXTS, "y", "f"), ["acct"], least_score=0.002))


def scorecard_sql(c: str, q: str) -> str:
    """Every way to cut eight pre-bins into runs, and the weights of the best: events are orders with status F."""
    iv = "((g + 0.5) / (gg + 0.5) - (b + 0.5) / (bb + 0.5)) * (ln((g + 0.5) / (gg + 0.5)) - ln((b + 0.5) / (bb + 0.5)))"
    return f"""(with r as (select {c} as x, (o_orderstatus = 'F')::integer::double as y from orders join customer on o_custkey = c_custkey),
        q as (select list_distinct(quantile_cont(x, {q})) as cuts from r), p as (select len(list_filter(cuts, lambda k: k < x)) as pre, count(*) as n, sum(y) as g from r, q group by 1),
        t as (select sum(n) as nn, sum(g) as gg, sum(n) - sum(g) as bb from p),
        cut as (select m, pre, n, g, coalesce(bit_count(m & ((1::bigint << pre::integer) - 1)), 0) as bin from p, (select unnest(range(128)) as m)),
        bins as (select m, bin, sum(n) as n, sum(g) as g, sum(n) - sum(g) as b from cut group by 1, 2),
        judged as (select m, bin, n, g, b, g / n as rate, lag(g / n) over (partition by m order by bin) as before, {iv} as iv from bins, t),
        sums as (select m, sum(iv) as iv, count(*) as bins from judged, t group by m having min(n) >= 0.05 * max(nn) and (bool_and(before is null or rate > before) or bool_and(before is null or rate < before))),
        best as (select arg_min(m, {{'v': -round(iv, 12), 'b': bins, 'm': m}}) as m from sums)
        select '{c}' as feature, pre::integer as pre, cut.bin::integer as bin, cut.n, cut.g, round(ln((j.g + 0.5) / (gg + 0.5)) - ln((j.b + 0.5) / (bb + 0.5)), 6) as woe, round(j.iv, 6) as value
        from cut join best using (m) join judged j using (m, bin), t)"""


EIGHTHS = [k / 8 for k in range(1, 8)]


@query(" union all ".join(f"select * from {scorecard_sql(c, str(EIGHTHS))}" for c in ("o_totalprice", "c_acctbal", "o_custkey")))
def scorecard_bins(spark: SparkSession, sf: str) -> DataFrame:
    """The best monotone bins of three numbers, with their weights of evidence, over eight pre-bins."""
    columns = ["o_totalprice", "c_acctbal", "o_custkey"]
    df = table(spark, sf, "orders").join(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), F.col("o_custkey") == F.col("c_custkey"))
    df = df.select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"), *columns)
    bins = ScorecardBins(fine=8).fit(Frame(df, {"y": R.make("target")} | dict.fromkeys(columns, R.numeric()), ["o_orderkey"])).bins
    return rounded(bins.select("feature", "pre", "bin", "n", "g", "woe", "value"))


@query("""with d as (select doc_id, list_filter(string_split(coalesce(text, ''), ' '), lambda w: w <> '') as tokens from documents),
    u as (select doc_id, tokens, list_distinct(tokens) as words, len(list_distinct(tokens)) as n from d),
    w as (select doc_id, n, word, i - 1 as i, len(tokens) as n_tokens from (select doc_id, n, tokens, unnest(list_sort(words)) as word, generate_subscripts(list_sort(words), 1) as i from u)),
    s as (select doc_id, n, len(tokens) as n_tokens, sample, case when sample = 0 or n = 0 then 0 else ('0x' || substr(md5('42|' || doc_id || '|' || sample || '|0'), 1, 8))::bigint % n + 1 end as size
        from u, (select unnest([0, 1, 2, 3]) as sample) where sample = 0 or n > 0),
    off as (select distinct doc_id, sample, ('0x' || substr(md5('42|' || doc_id || '|' || sample || '|' || draw), 1, 8))::bigint % n as i from (select *, unnest(generate_series(1, size)) as draw from s)),
    gone as (select doc_id, sample, count(*) as k from off group by 1, 2),
    x as (select doc_id, n, sample, n - coalesce(k, 0) as kept from s left join gone using (doc_id, sample)),
    y as (select *, case when n = 0 then 1 else sqrt(exp(-pow(100 * (1 - sqrt(kept / n)), 2) / 625)) end as weight from x)
    select doc_id, max(n)::bigint as n_words, count(*) as n_samples, round(sum(weight), 6) as w, round(sum(weight * kept), 4) as wx, round(sum(weight * kept * kept), 2) as wxx from y group by 1""")
def lime_moments(spark: SparkSession, sf: str) -> DataFrame:
    """Samples of every document with words left out: kernel weights, and moments of the number of words that stay."""
    tokens = F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda w: w != "")
    rows = lime.perturbed(table(spark, sf, "documents").select("doc_id", tokens.alias("tokens")), "doc_id", "tokens", 3)
    kept, weight = F.aggregate("kept", F.lit(0.0), lambda a, x: a + x), lime.kernel_weight(F.col("kept"))
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n"), kept.alias("k"), weight.alias("w"))
    sums = rows.groupBy("doc_id").agg(F.max("n").alias("n_words"), F.count("*").alias("n_samples"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("k")).alias("wx"), F.sum(F.col("w") * F.col("k") ** 2).alias("wxx"))
    return sums.select("doc_id", "n_words", "n_samples", *[c.alias(n) for c, n in ((F.round("w", 6), "w"), (F.round("wx", 4), "wx"), (F.round("wxx", 2), "wxx"))])


@query("""with e as (select min(l_quantity) as low, (max(l_quantity) - min(l_quantity)) / 12 as width from lineitem), g as (select unnest(range(12)) as place),
    c as (select least(floor((l_quantity - low) / width), 11)::integer as place, count(*) as n from lineitem, e group by 1)
    select g.place::integer as place, round(low + (g.place + 0.5) * width, 6) as value, coalesce(n, 0) as n, round(avg(l_extendedprice / 1000 + (low + (g.place + 0.5) * width) * l_discount * 9), 6) as mean,
        round(stddev_pop(l_extendedprice / 1000 + (low + (g.place + 0.5) * width) * l_discount * 9), 6) as spread
    from lineitem, e, g left join c using (place) group by g.place, low, width, n""")
def dependence_curve(spark: SparkSession, sf: str) -> DataFrame:
    """A given formula with the quantity of every line set to the middles of twelve bins: the mean and spread of the individual curves."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    df = table(spark, sf, "lineitem").select(*keys, "l_quantity", "l_discount", "l_extendedprice")
    formula = F.col("l_extendedprice") / 1000 + F.col("l_quantity") * F.col("l_discount") * 9
    curves = dependence.individual_curves(df, keys, "l_quantity", dependence.number_grid(df, "l_quantity", 12), lambda d: d.withColumn("p", formula))
    return rounded(dependence.dependence(curves))


@query()
def stl_trend(spark: SparkSession, sf: str) -> DataFrame:
    """Trend, weekly season and remainder of the daily sums of each kind of event."""
    daily = table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    return Decomposition(7, robust=1, rounds=2).fit_transform(daily, ["event_type"], "day", "v")


HASHED = ", ".join(f"(('0x' || substr(md5(token), {4 * k + 1}, 4))::integer % 1000) / 1000.0 - 0.5" for k in range(4))
TOKENS = "list_filter(string_split(lower(trim(regexp_replace(regexp_replace(trim(coalesce(text, '')), '[^A-Za-z0-9]+', ' ', 'g'), '\\b[0-9]+\\b', ' ', 'g'))), ' '), lambda w: w <> '')"


@query(f"""with words as (select doc_id, unnest({TOKENS}) as token from documents),
    weights as (select token, ln(1 + ((select count(*) from documents) + 1) / (count(distinct doc_id) + 1)) as weight from words group by 1),
    vectors as (select token, [{HASHED}]::double[] as v from weights),
    sums as (select doc_id, {", ".join(f"sum(v[{k}] * weight) / count(*) as v{k}" for k in range(1, 5))} from words join weights using (token) join vectors using (token) group by 1)
    select doc_id, {", ".join(f"round(coalesce(v{k}, 0), 6)::double + 0.0 as v{k}" for k in range(1, 5))} from documents left join sums using (doc_id)""")
def document_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted means of word vectors; a word's vector is made of its MD5, so that SQL has the same."""
    df = table(spark, sf, "documents").select("doc_id", text.tokens_en(F.col("text")).alias("tokens"))
    weights = stored(text.word_weights(df, "tokens", key="doc_id"))
    part = lambda k: F.pmod(F.conv(F.substring(F.md5("token"), 4 * k + 1, 4), 16, 10).cast("int"), F.lit(1000)) / 1000.0 - 0.5
    vectors = weights.select("token", F.array(*[part(k) for k in range(4)]).alias("vector"))
    made = text.document_vectors(df, "doc_id", "tokens", vectors, weights, 4)
    return rounded(made.select("doc_id", *[F.col("vector")[k].alias(f"v{k + 1}") for k in range(4)]))


@query("""with x as (select o_orderkey % 5 as f from orders), k as (select unnest([1, 2, 3, 4]) as k)
    select 'oldest' as first, k::integer as split, count(*) filter (f < k) as n_train, count(*) filter (f = k) as n_valid from x, k group by k
    union all select 'newest', k::integer, count(*) filter (4 - f < k), count(*) filter (4 - f = k) from x, k group by k""")
def expanding_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Rows to train on and to judge by of each split of growing parts, from the oldest part and from the newest."""
    df = table(spark, sf, "orders").select(F.pmod("o_orderkey", F.lit(5)).alias("f"))
    counts = [
        F.struct(F.lit(name).alias("first"), F.lit(k).alias("split"), F.count_if(s.train).alias("n_train"), F.count_if(s.valid).alias("n_valid"))
        for name, newest in (("oldest", False), ("newest", True))
        for k, s in enumerate(validation.expanding("f", 5, newest), 1)
    ]
    return df.agg(F.array(*counts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


@query("""with x as (select (o_orderstatus = 'F')::integer as y, least(greatest(o_totalprice / 600000, 1e-7), 1 - 1e-7) as q from orders), l as (select y, ln(q / (1 - q)) as logit from x),
    e as (select min(logit) as lo, max(logit) as hi from l)
    select y, least(floor((logit - lo) / (hi - lo) * 8) + 1, 8)::integer as bin, count(*) as n from l, e group by 1, 2""")
def log_odds_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Histograms of the log odds of a prediction, by class."""
    df = table(spark, sf, "orders").select((F.col("o_orderstatus") == "F").cast("int").alias("y"), (F.col("o_totalprice") / 600000).alias("p"))
    return metrics.log_odds_by_class(df, "y", "p", 8)


@query("""select date_diff('second', min(t), max(t))::double as seconds, case when date_diff('second', min(t), max(t)) > 360 * 86400 then 'year' when date_diff('second', min(t), max(t)) > 27 * 86400 then 'month' else 'exact' end as step
    from (select distinct date_trunc('day', ts)::timestamp as t from events order by t desc limit 2)""")
def usual_step(spark: SparkSession, sf: str) -> DataFrame:
    """The step of the days of the events."""
    return datetimes.usual_step(table(spark, sf, "events").select(F.date_trunc("day", "ts").alias("t")), "t")
