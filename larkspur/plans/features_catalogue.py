"""Queries over the feature operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur import roles as R
from larkspur.frame import Frame
from larkspur.operators import categorical as C
from larkspur.operators import datetimes as D
from larkspur.operators import groupby as G
from larkspur.operators import numeric as N
from larkspur.operators import relational as J
from larkspur.operators import sequence as S
from larkspur.plans.flagship import flagship
from larkspur.plans.registry import query, rounded, table


def holed(spark: SparkSession, sf: str) -> Frame:
    """events with ``v``: value, or null below 5."""
    df = table(spark, sf, "events").select("event_id", F.when(F.col("value") >= 5, F.col("value")).alias("v"))
    return Frame(df, {"v": R.numeric()}, ["event_id"])


HOLED = "(select event_id, case when value >= 5 then value end as v from events)"


def lines(spark: SparkSession, sf: str, *columns: str, role: R.Role | None = None) -> Frame:
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    df = table(spark, sf, "lineitem").select(*keys, *[c for c in columns if c not in keys])
    return Frame(df, {c: role or R.numeric() for c in columns}, keys)


KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query("select l_orderkey, l_quantity, l_shipdate from lineitem where l_quantity > 45 and l_shipdate >= timestamp '1998-01-01'")
def scan_prune_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").filter("l_quantity > 45 and l_shipdate >= timestamp'1998-01-01'").select("l_orderkey", "l_quantity", "l_shipdate")


@query(f"select sum((v is null)::bigint)::bigint as total from {HOLED}")
def null_count(spark: SparkSession, sf: str) -> DataFrame:
    return holed(spark, sf).null_count()


@query(f"select event_id, (v is null)::double as nanflg__v from {HOLED}")
def nan_flags(spark: SparkSession, sf: str) -> DataFrame:
    return N.NullFlags().fit_transform(holed(spark, sf)).df


@query(f"select event_id, round(coalesce(v, (select median(v) from {HOLED})), 6) as fillnamed__v from {HOLED}")
def fill_median(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(N.FillMedian().fit_transform(holed(spark, sf)).df)


@query(f"select event_id, round(coalesce(v, (select avg(v) from {HOLED})), 6) as fillnamean__v from {HOLED}")
def fill_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(N.FillMean().fit_transform(holed(spark, sf)).df)


@query("select event_id, case when event_id % 7 <> 0 then value end as fillinf__v from events")
def fill_inf(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, float("inf")).otherwise(F.col("value")).alias("v"))
    return N.FillInfinite().fit_transform(Frame(df, {"v": R.numeric()}, ["event_id"])).df


@query(f"select {KEYS}, round(ln(p / (1 - p)), 6) as logodds__l_discount from (select *, least(greatest(l_discount, 1e-7::double), 1 - 1e-7::double) as p from lineitem)")
def log_odds(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(N.LogOdds().fit_transform(lines(spark, sf, "l_discount")).df)


@query(f"""select {KEYS}, round((l_quantity - avg(l_quantity) over ()) / stddev_pop(l_quantity) over (), 6) as scaler__l_quantity,
    round((l_extendedprice - avg(l_extendedprice) over ()) / stddev_pop(l_extendedprice) over (), 6) as scaler__l_extendedprice from lineitem""")
def standard_scaler(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(N.Scale().fit_transform(lines(spark, sf, "l_quantity", "l_extendedprice")).df)


@query(f"""with q as (select list_distinct(quantile_cont(l_quantity, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) as b from lineitem)
    select {KEYS}, (1 + len(list_filter(b, lambda x: x < l_quantity)))::integer as qntl__l_quantity from lineitem, q""")
def quantile_binning(spark: SparkSession, sf: str) -> DataFrame:
    return N.QuantileBins().fit_transform(lines(spark, sf, "l_quantity")).df


GRID = ", ".join(str(k / 100) for k in range(101))


@query(f"""with q as (select quantile_cont(l_extendedprice, [{GRID}]) as q from lineitem),
    x as (select {KEYS}, l_extendedprice as v, q, len(list_filter(q, lambda b: b < l_extendedprice)) as lo, len(list_filter(q, lambda b: b <= l_extendedprice)) as hi from lineitem, q)
    select {KEYS}, round(case when v <= q[1] then 0.0 when v >= q[101] then 1.0 when hi > lo then ((lo + hi - 1) / 2.0) / 100.0
        else (lo - 1 + (v - q[lo]) / (q[lo + 1] - q[lo])) / 100.0 end::double, 6) as qntl_tr__l_extendedprice from x""")
def quantile_transform_uniform(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(N.QuantileTransform(101, "uniform").fit_transform(lines(spark, sf, "l_extendedprice")).df)


@query()
def quantile_transform_normal(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(N.QuantileTransform(101).fit_transform(lines(spark, sf, "l_extendedprice")).df)


def parts(spark: SparkSession, sf: str) -> Frame:
    df = table(spark, sf, "part").select("p_partkey", "p_type", "p_brand")
    return Frame(df, {"p_type": R.category(), "p_brand": R.category()}, ["p_partkey"])


def code_sql(source: str, column: str, unknown: int = 5) -> str:
    return f"(select {column} as v, row_number() over (order by count(*) desc, {column} nulls last)::integer as code from {source} group by 1 having count(*) > {unknown})"


@query(f"""select p_partkey, coalesce(a.code, 0)::integer as le__p_type, coalesce(b.code, 0)::integer as le__p_brand from part
    left join {code_sql('part', 'p_type')} a on a.v = p_type left join {code_sql('part', 'p_brand')} b on b.v = p_brand""")
def label_encode(spark: SparkSession, sf: str) -> DataFrame:
    return C.LabelEncode().fit_transform(parts(spark, sf)).df


@query(f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(a.code, 0)::integer as le__l_partkey from lineitem left join {code_sql('lineitem', 'l_partkey', 30)} a on a.v = l_partkey")
def label_encode_rare(spark: SparkSession, sf: str) -> DataFrame:
    f = lines(spark, sf, "l_partkey", role=R.category())
    f.df = f.df.withColumn("key", F.col("l_partkey"))  # the feature leaves the frame, the key stays
    return C.LabelEncode(30).fit_transform(f).df.withColumnRenamed("key", "l_partkey")


@query("select p_partkey, count(*) over (partition by p_type) as freq__p_type, count(*) over (partition by p_brand) as freq__p_brand from part")
def freq_encode(spark: SparkSession, sf: str) -> DataFrame:
    return C.FrequencyEncode().fit_transform(parts(spark, sf)).df


@query("""select c_custkey, r::double as ord__c_mktsegment from customer join
    (select c_mktsegment as v, row_number() over (order by c_mktsegment) as r from customer group by 1 having count(*) > 5) on v = c_mktsegment""")
def ordinal_encode(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return C.OrdinalEncode().fit_transform(Frame(df, {"c_mktsegment": R.category()}, ["c_custkey"])).df


@query(f"""select {KEYS}, (code = 0)::double as ohe_0__le__l_returnflag_, (code = 1)::double as ohe_1, (code = 2)::double as ohe_2, (code = 3)::double as ohe_3
    from lineitem join {code_sql('lineitem', 'l_returnflag')} on v = l_returnflag""".replace("(code = 0)::double as ohe_0__le__l_returnflag_, ", ""))
def one_hot(spark: SparkSession, sf: str) -> DataFrame:
    coded = C.LabelEncode().fit_transform(lines(spark, sf, "l_returnflag", role=R.category()))
    made = C.OneHot().fit_transform(coded).df
    return made.select(*KEYS.split(", "), *[F.col(f"ohe_{k}__le__l_returnflag").alias(f"ohe_{k}") for k in (1, 2, 3)])


@query(f"""with x as (select {KEYS}, l_linestatus || '_' || l_returnflag as k from lineitem),
    c as (select k as v, row_number() over (order by count(*) desc, k)::integer as code from x group by 1 having count(*) > 5)
    select {KEYS}, coalesce(code, 0)::integer as inter from x left join c on v = k""")
def cat_intersections(spark: SparkSession, sf: str) -> DataFrame:
    made = C.Intersections().fit_transform(lines(spark, sf, "l_returnflag", "l_linestatus", role=R.category())).df
    return made.withColumnRenamed("inter__(l_linestatus__l_returnflag)", "inter")


def orders(spark: SparkSession, sf: str) -> Frame:
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderstatus", (F.col("o_orderkey") % 5).cast("int").alias("fold"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return Frame(df, {"o_orderpriority": R.category(), "fold": R.make("folds"), "y": R.make("target")}, ["o_orderkey"])


def oof_sql(outputs: list[str], kind: str) -> str:
    """Out-of-fold encoding of o_orderpriority in SQL: candidates for all smoothings, their losses, the best, and the scores."""
    n = len(outputs)
    ks = range(n)
    sums = ", ".join(f"sum(({y})::double) as s{k}, sum(({y})::double * ({y})::double) as q{k}" for k, y in enumerate(outputs))
    p = {k: f"((vs{k} - s{k} + a * (ws{k} - fs{k}) / (wn - fn)) / (vn - n + a))" for k in ks}
    clip = {k: f"least(greatest({p[k]}, 1e-7::double), 1 - 1e-7::double)" for k in ks}
    loss = {
        "binary": {k: f"-(s{k} * ln({clip[k]}) + (n - s{k}) * ln(1 - {clip[k]}))" for k in ks},
        "multiclass": {k: f"-(s{k} * ln({clip[k]}))" for k in ks},
        "reg": {k: f"q{k} - 2 * {p[k]} * s{k} + n * {p[k]} * {p[k]}" for k in ks},
    }[kind]
    if kind == "multiclass":
        loss = dict.fromkeys(ks, " + ".join(f"({loss[k]})" for k in ks))
    best = ", ".join(f"arg_min(a, l{k}) as a{k}" for k in ks)
    score = {k: p[k].replace("a *", f"a{k} *").replace("+ a)", f"+ a{k})") for k in ks}
    norm = f" / ({' + '.join(score[k] for k in ks)})" if kind == "multiclass" else ""
    names = ["oof"] if n == 1 else [f"oof_{k}" for k in ks]
    return f"""with cells as (select o_orderpriority as v, o_orderkey % 5 as f, count(*) as n, {sums} from orders group by 1, 2),
        c as (select *, {", ".join(f"sum(s{k}) over (partition by v) as vs{k}, sum(s{k}) over (partition by f) as fs{k}, sum(s{k}) over () as ws{k}" for k in ks)},
            sum(n) over (partition by v) as vn, sum(n) over (partition by f) as fn, sum(n) over () as wn from cells),
        l as (select a, {", ".join(f"sum({loss[k]}) as l{k}" for k in ks)} from c, (select unnest([0.5, 1, 2, 5, 10, 50, 250, 1000]::double[]) as a) group by a),
        b as (select {best} from l),
        e as (select v, f, {", ".join(f"{score[k]}{norm} as e{k}" for k in ks)} from c, b)
        select o_orderkey, {", ".join(f"round(e{k}, 6) as {names[k]}" for k in ks)} from orders join e on v = o_orderpriority and f = o_orderkey % 5"""


@query(oof_sql(["(o_orderstatus = 'F')::integer"], "binary"))
def oof_target_encode_binary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.TargetEncode().fit_transform(orders(spark, sf)).df.select("o_orderkey", F.col("oof__o_orderpriority").alias("oof")))


@query(oof_sql(["o_totalprice"], "reg"))
def oof_target_encode_reg(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.TargetEncode(["o_totalprice"], "reg").fit_transform(orders(spark, sf)).df.select("o_orderkey", F.col("oof__o_orderpriority").alias("oof")))


@query(oof_sql([f"(o_orderstatus = '{s}')::integer" for s in "FOP"], "multiclass"))
def oof_target_encode_multiclass(spark: SparkSession, sf: str) -> DataFrame:
    frame = orders(spark, sf)
    frame.df = frame.df.withColumns({f"is_{s}": (F.col("o_orderstatus") == s).cast("int") for s in "FOP"})
    made = C.TargetEncode(["is_F", "is_O", "is_P"], "multiclass").fit_transform(frame).df
    return rounded(made.select("o_orderkey", *[F.col(f"multioof_{k}__o_orderpriority").alias(f"oof_{k}") for k in range(3)]))


@query(oof_sql(["o_totalprice", "o_custkey"], "reg"))
def oof_target_encode_multi(spark: SparkSession, sf: str) -> DataFrame:
    frame = orders(spark, sf)
    frame.df = frame.df.join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    made = C.TargetEncode(["o_totalprice", "o_custkey"], "reg").fit_transform(frame).df
    return rounded(made.select("o_orderkey", *[F.col(f"multioof_{k}__o_orderpriority").alias(f"oof_{k}") for k in range(2)]))


@query("select 'p_brand' as feature, count(distinct p_brand) as n_unique from part union all select 'p_type', count(distinct p_type) from part union all select 'p_size', count(distinct p_size) from part")
def unique_counts(spark: SparkSession, sf: str) -> DataFrame:
    return C.unique_counts(table(spark, sf, "part"), ["p_brand", "p_type", "p_size"])


@query("select feature, n_unique from (select 'p_brand' as feature, count(distinct p_brand) as n_unique from part union all select 'p_type', count(distinct p_type) from part union all select 'p_size', count(distinct p_size) from part) order by n_unique desc, feature limit 2")
def unique_counts_topk(spark: SparkSession, sf: str) -> DataFrame:
    return C.top_features(C.unique_counts(table(spark, sf, "part"), ["p_brand", "p_type", "p_size"]), 2)


@query("""with y as (select o_orderkey, o_orderpriority as v, (o_orderstatus = 'F')::double as y from orders),
    e as (select v, sum(y) as g, sum(1 - y) as b from y group by v), w as (select sum(g) as gg, sum(b) as bb from e)
    select o_orderkey, round(ln((g + 0.5) / (gg + 0.5)) - ln((b + 0.5) / (bb + 0.5)), 6) as woe from y join e using (v), w""")
def woe_bins(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.WeightOfEvidence().fit_transform(orders(spark, sf)).df.select("o_orderkey", F.col("woe__o_orderpriority").alias("woe")))


def dates(spark: SparkSession, sf: str, **role) -> Frame:
    return Frame(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), {"o_orderdate": R.datetime(**role)}, ["o_orderkey"])


@query("""select o_orderkey, year(d)::integer as season_y__o_orderdate, month(d)::integer as season_m__o_orderdate, day(d)::integer as season_d__o_orderdate,
    (isodow(d) - 1)::integer as season_wd__o_orderdate, dayofyear(d)::integer as season_doy__o_orderdate, hour(d)::integer as season_hour__o_orderdate
    from (select o_orderkey, o_orderdate::timestamp as d from orders)""")
def date_seasons(spark: SparkSession, sf: str) -> DataFrame:
    return D.Seasons(("y", "m", "d", "wd", "doy", "hour")).fit_transform(dates(spark, sf)).df


@query("select o_orderkey, round((epoch_us(o_orderdate::timestamp) - (select min(epoch_us(o_orderdate::timestamp)) from orders)) / 86400000000.0, 6)::double as dtdiff__o_orderdate from orders")
def time_to_num(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.TimeToNumber().fit_transform(dates(spark, sf)).df)


@query(f"select {KEYS}, round((epoch_us(l_shipdate::timestamp) - epoch_us(o_orderdate::timestamp)) / 86400000000.0, 6)::double as basediff_o_orderdate__l_shipdate from lineitem join orders on l_orderkey = o_orderkey")
def base_diff(spark: SparkSession, sf: str) -> DataFrame:
    f = lines(spark, sf, "l_shipdate", role=R.datetime())
    df = f.df.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    return rounded(D.DaysToBase().fit_transform(Frame(df, f.roles | {"o_orderdate": R.datetime(base_date=True)}, f.keys)).df.select(*f.keys, "basediff_o_orderdate__l_shipdate"))


@query("select o_orderkey, (month(o_orderdate) = 1 and day(o_orderdate) = 1 or month(o_orderdate) = 12 and day(o_orderdate) = 25)::integer as season_hol__o_orderdate from orders")
def holiday_flag(spark: SparkSession, sf: str) -> DataFrame:
    days = spark.range(1990, 2010).selectExpr("'x' as country", "explode(array(make_date(cast(id as int), 1, 1), make_date(cast(id as int), 12, 25))) as day")
    return D.Seasons((), days).fit_transform(dates(spark, sf, country="x")).df


@query("""select o_orderkey, (d + to_months(((2000 - year(d)) * 12)::integer))::date as y2000, (d + to_months((2 - month(d))::integer))::date as feb, (d + to_days((0 - (isodow(d) - 1))::integer))::date as monday
    from (select o_orderkey, o_orderdate::date as d from orders)""")
def change_date(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", D.change_part(d, "year", 2000).alias("y2000"), D.change_part(d, "month", 2).alias("feb"), D.change_part(d, "dayofweek", 0).alias("monday"))


GROUPED = "l_suppkey"


def grouped(spark: SparkSession, sf: str, statistics: tuple[str, ...], category: bool = False, digits: int = 6) -> DataFrame:
    f = lines(spark, sf, *(["l_returnflag"] if category else ["l_quantity"]))
    op = G.GroupStatistics(GROUPED, [] if category else ["l_quantity"], ["l_returnflag"] if category else [], statistics)
    made = op.fit_transform(f).df
    return rounded(made.select(*f.keys, *[F.col(f"grb__l_suppkey__{s}__{'l_returnflag' if category else 'l_quantity'}").alias(s) for s in statistics]), digits)


@query(f"select {KEYS}, min(l_quantity) over w as min, max(l_quantity) over w as max, round(stddev_pop(l_quantity) over w, 6) as std from lineitem window w as (partition by l_suppkey)")
def groupby_min_max_std(spark: SparkSession, sf: str) -> DataFrame:
    return grouped(spark, sf, ("min", "max", "std"))


@query(f"select {KEYS}, round(l_quantity - avg(l_quantity) over (partition by l_suppkey), 5) + 0.0 as delta_mean from lineitem")
def groupby_delta_mean(spark: SparkSession, sf: str) -> DataFrame:
    return grouped(spark, sf, ("delta_mean",), digits=5)


@query(f"select {KEYS}, round(l_quantity - median(l_quantity) over (partition by l_suppkey), 6) as delta_median from lineitem")
def groupby_delta_median(spark: SparkSession, sf: str) -> DataFrame:
    return grouped(spark, sf, ("delta_median",))


MODE = "(select l_suppkey as g, l_returnflag as m from (select l_suppkey, l_returnflag, row_number() over (partition by l_suppkey order by count(*) desc, l_returnflag) as r from lineitem group by 1, 2) where r = 1)"


@query(f"select {KEYS}, m as mode, (l_returnflag = m)::double as is_mode from lineitem join {MODE} on g = l_suppkey")
def groupby_mode(spark: SparkSession, sf: str) -> DataFrame:
    return grouped(spark, sf, ("mode", "is_mode"), True)


@query("""with fit as (select o_custkey as g, avg(o_totalprice) as m from orders where o_orderkey % 2 = 0 group by 1)
    select o_orderkey, round(o_totalprice - m, 7) as delta_mean from orders left join fit on g = o_custkey where o_orderkey % 2 = 1""")
def groupby_apply_unseen(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    f = Frame(df, {"o_totalprice": R.numeric()}, ["o_orderkey"])
    op = G.GroupStatistics("o_custkey", ["o_totalprice"], statistics=("delta_mean",)).fit(f.filter("o_orderkey % 2 = 0"))
    made = op.transform(f.filter("o_orderkey % 2 = 1")).df
    return rounded(made.select("o_orderkey", F.col("grb__o_custkey__delta_mean__o_totalprice").alias("delta_mean")), 7)


@query("select c_custkey, coalesce(n, 0) as numcount__orders from customer left join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey")
def fk_child_count(spark: SparkSession, sf: str) -> DataFrame:
    child = table(spark, sf, "orders")
    return J.child_count(table(spark, sf, "customer").select("c_custkey"), "c_custkey", child, "o_custkey", "numcount__orders")


@query("select c_custkey, o_totalprice as stat__orders__o_totalprice from customer left join (select * from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders) where r = 1) on o_custkey = c_custkey")
def fk_lookup_last(spark: SparkSession, sf: str) -> DataFrame:
    child = table(spark, sf, "orders")
    return J.last_child(table(spark, sf, "customer").select("c_custkey"), "c_custkey", child, "o_custkey", ["o_orderdate", "o_orderkey"], {"o_totalprice": "stat__orders__o_totalprice"})


@query("select o_orderkey, count(l_quantity)::integer as steps, round(coalesce(sum(l_quantity), 0), 4)::double as total from orders left join lineitem on l_orderkey = o_orderkey group by 1")
def fk_collect(spark: SparkSession, sf: str) -> DataFrame:
    parent = table(spark, sf, "orders").select("o_orderkey")
    child = table(spark, sf, "lineitem")
    made = J.children_in_chunks(parent, "o_orderkey", child, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], ["l_quantity"], "lines")
    made = J.apply_to_children(made, "lines", "total", F.lit(0.0), lambda a, x: a + x["l_quantity"])
    made = made.groupBy("o_orderkey").agg(F.sum(F.size("lines")).cast("int").alias("steps"), F.sum("total").alias("total"))
    return rounded(made.select("o_orderkey", "steps", "total"), 4)


def star(spark: SparkSession, sf: str) -> dict[str, J.Table]:
    return {
        "customer": J.Table(table(spark, sf, "customer"), "c_custkey", ["c_acctbal"]),
        "orders": J.Table(table(spark, sf, "orders"), "o_orderkey", ["o_totalprice"], ["o_orderstatus"], interesting={"o_orderstatus": ["F"]}),
        "lineitem": J.Table(table(spark, sf, "lineitem"), "l_orderkey", ["l_quantity"]),
    }


RELATIONS = [J.Relation("orders", "o_custkey", "customer"), J.Relation("lineitem", "l_orderkey", "orders")]


@query("""select c_custkey, coalesce(n, 0) as ft__orders_count, round(m, 4) as ft__orders_mean_o_totalprice, round(s, 4) as ft__orders_std_o_totalprice, round(md, 4) as ft__orders_median_o_totalprice, u as ft__orders_num_unique_o_orderstatus
    from customer left join (select o_custkey, count(*) as n, avg(o_totalprice) as m, stddev_samp(o_totalprice) as s, median(o_totalprice) as md, count(distinct o_orderstatus) as u from orders group by 1) on o_custkey = c_custkey""")
def dfs_depth1(spark: SparkSession, sf: str) -> DataFrame:
    tables = star(spark, sf)
    tables["orders"].interesting = {}
    return rounded(J.deep_features(tables, RELATIONS, "customer", 1, ("count", "mean", "std", "median", "num_unique")), 4)


@query("""with l as (select l_orderkey, count(*) as n, sum(l_quantity) as s from lineitem group by 1),
    o as (select o_custkey, o_totalprice, coalesce(n, 0) as n, s from orders left join l on l_orderkey = o_orderkey)
    select c_custkey, coalesce(k, 0) as ft__orders_count, round(a, 4) as ft__orders_sum_o_totalprice, round(b, 4) as ft__orders_sum_lineitem_count, round(c, 4) as ft__orders_sum_lineitem_sum_l_quantity
    from customer left join (select o_custkey, count(*) as k, sum(o_totalprice) as a, sum(n)::double as b, sum(s) as c from o group by 1) on o_custkey = c_custkey""")
def dfs_depth2(spark: SparkSession, sf: str) -> DataFrame:
    tables = star(spark, sf)
    tables["orders"].interesting = {}
    return rounded(J.deep_features(tables, RELATIONS, "customer", 2, ("count", "sum")), 4)


@query("""select c_custkey, n as ft__orders_count_where_o_orderstatus_F, round(m, 4) as ft__orders_mean_o_totalprice_where_o_orderstatus_F
    from customer left join (select o_custkey, count(*) filter (o_orderstatus = 'F') as n, avg(o_totalprice) filter (o_orderstatus = 'F') as m from orders group by 1) on o_custkey = c_custkey""")
def dfs_where(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(J.deep_features(star(spark, sf), RELATIONS, "customer", 1, ("where",)), 4).withColumn("ft__orders_count_where_o_orderstatus_F", F.expr("ft__orders_count_where_o_orderstatus_F"))


@query("""with n as (select o_custkey, o_orderpriority, count(*) as n from orders group by 1, 2), p as (select *, n / sum(n) over (partition by o_custkey) as p from n)
    select o_custkey, round(-sum(p * ln(p)), 6) + 0.0 as entropy from p group by 1""")
def dfs_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(J.entropy(table(spark, sf, "orders"), ["o_custkey"], "o_orderpriority", "entropy"))


DAILY = "(select user_id, ts::date as day, round(sum(value), 4) as v from events group by 1, 2)"


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v")), 4)


@query("select event_id, (epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id)) / 1000000.0::double as seconds_since from events")
def dfs_time_since_previous(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events").select("event_id", "user_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return S.differences(df, ["user_id"], ["ts", "event_id"], ["t"], 2, False).select("event_id", (F.col("diff_1__t") / 1e6).alias("seconds_since"))


@query(f"select user_id, day, v as lag_0__v, lag(v, 1) over w as lag_1__v, lag(v, 2) over w as lag_2__v from {DAILY} window w as (partition by user_id order by day)")
def lag_features(spark: SparkSession, sf: str) -> DataFrame:
    return S.lags(daily(spark, sf), ["user_id"], ["day"], ["v"], 10, 3).drop("v")


@query(f"select user_id, day, round(v - lag(v, 1) over w, 4) as diff_1__v, round(v - lag(v, 2) over w, 4) as diff_2__v from {DAILY} window w as (partition by user_id order by day)")
def diff_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.differences(daily(spark, sf), ["user_id"], ["day"], ["v"], 3, False).drop("v"), 4)


@query(f"select user_id, day, lead(v, 1) over w as v_plus_1, lead(v, 2) over w as v_plus_2 from {DAILY} window w as (partition by user_id order by day)")
def horizon_targets(spark: SparkSession, sf: str) -> DataFrame:
    return S.horizon(daily(spark, sf), ["user_id"], ["day"], "v", 2).drop("v")


@query(f"""select user_id, day, n as steps, total from (select user_id, day, row_number() over w as r, count(*) over (partition by user_id) as c, len(list(v) over f)::integer as n, round(sum(v) over f, 3) as total
    from {DAILY} window w as (partition by user_id order by day), f as (partition by user_id order by day rows between 6 preceding and current row)) where r >= 7 and (c - r) % 3 = 0""")
def sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    made = S.windows(daily(spark, sf), ["user_id"], ["day"], "v", 7, 3)
    return rounded(made.select("user_id", "day", F.size("window").alias("steps"), F.aggregate("window", F.lit(0.0), lambda a, x: a + x).alias("total")), 3)


@query(f"""select user_id, day, segment from (select *, count(*) over (partition by user_id, segment) as n from (select user_id, day, sum(gap) over (partition by user_id order by day)::integer as segment
    from (select user_id, day, coalesce((day - lag(day) over (partition by user_id order by day) <> 1)::integer, 0) as gap from {DAILY}))) where n > 2""")
def gap_segments(spark: SparkSession, sf: str) -> DataFrame:
    return S.segments(daily(spark, sf), ["user_id"], "day", 86400, least=2).select("user_id", "day", "segment")


@query(f"""with m as (select user_id, day, case when count(*) over f = 5 then median(v) over f end as full from {DAILY} window f as (partition by user_id order by day rows between 4 preceding and current row))
    select user_id, day, round(coalesce(m.full, first_value(m.full ignore nulls) over (partition by user_id order by day rows between unbounded preceding and unbounded following)), 4) as trend from m""".replace(" as full", " as fu").replace("m.full", "m.fu"))
def rolling_median_trend(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.rolling_median(daily(spark, sf), ["user_id"], ["day"], "v", 5).drop("v"), 4)


@query(f"""with d as (select user_id, v, case when count(*) over a = 4 and count(*) over b = 4 then abs(median(v) over b - median(v) over a) end as d from {DAILY}
    window a as (partition by user_id order by day rows between 3 preceding and current row), b as (partition by user_id order by day rows between 1 following and 4 following))
    select user_id, round(max(d) / (quantile_cont(v, 0.9) - quantile_cont(v, 0.1)), 6) as shift from d group by 1""")
def level_shift(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.level_shift(daily(spark, sf), ["user_id"], ["day"], "v", 4))


@query(f"select user_id, round(regr_slope(v, epoch_us(day::timestamp) / 86400000000.0), 4) as slope from {DAILY} group by 1")
def linear_trend(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.linear_trend(daily(spark, sf), ["user_id"], F.col("day"), "v").drop("intercept"), 4)


@query(f"""select user_id, day, round(case when count(*) over f = 5 then (sum(v) over f - (lag(v, 2) over w + lead(v, 2) over w) / 2) / 4 end, 7) as trend from {DAILY}
    window w as (partition by user_id order by day), f as (partition by user_id order by day rows between 2 preceding and 2 following)""")
def seasonal_trend(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.moving_average_trend(daily(spark, sf), ["user_id"], ["day"], "v", 4).drop("v"), 7)


@query("""with c as (select o_orderkey, (o_orderstatus = 'F')::integer as y, (o_orderkey % 5)::integer as fold, o_totalprice, c_mktsegment, o_orderdate from orders join customer on c_custkey = o_custkey)
    select o_orderkey, y, fold, round((o_totalprice - avg(o_totalprice) over ()) / stddev_pop(o_totalprice) over (), 6) as scaler__o_totalprice, code as le__c_mktsegment, year(o_orderdate)::integer as season_y__o_orderdate from c
    join (select c_mktsegment as v, row_number() over (order by count(*) desc, c_mktsegment)::integer as code from c group by 1) on v = c_mktsegment""")
def flagship_features(spark: SparkSession, sf: str) -> DataFrame:
    made = flagship(spark, sf)
    return rounded(made.select("o_orderkey", "y", "fold", "scaler__o_totalprice", "le__c_mktsegment", "season_y__o_orderdate"))


@query("""with p as (select o_orderpriority, avg(o_totalprice) as m, min(o_totalprice) as lo from orders group by 1), s as (select o_orderstatus, avg(o_totalprice) as m, min(o_totalprice) as lo from orders group by 1)
    select o_orderkey, round(o_totalprice - p.m, 4) + 0.0 as delta_by_priority, p.lo as min_by_priority, round(o_totalprice - s.m, 4) + 0.0 as delta_by_status, s.lo as min_by_status
    from orders join p using (o_orderpriority) join s using (o_orderstatus)""")
def groupby_all(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    frame = Frame(df, {"o_orderpriority": R.category(), "o_orderstatus": R.category(), "o_totalprice": R.numeric()}, ["o_orderkey"])
    made = G.AllGroups(most=2, statistics=("delta_mean", "min")).fit_transform(frame).df
    name = lambda g, s: F.col(f"grb__o_order{g}__{s}__o_totalprice")
    return rounded(made.select("o_orderkey", *[name(g, s).alias(f"{a}_by_{g}") for g in ("priority", "status") for s, a in (("delta_mean", "delta"), ("min", "min"))]), 4)
