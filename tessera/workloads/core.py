"""The operator queries: one per feature of the supported SQL, as DataFrame code or as SQL through the contract gate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.operators import joins, stats
from tessera.session import Engine

Tables = dict[str, DataFrame]
NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def load(spark: SparkSession, sf_dir: str) -> Tables:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in NAMES}


_frames: dict[str, tuple[Callable[[Tables], DataFrame], str]] = {}
_texts: dict[str, str] = {}


def frame(name: str, sql: str):
    """Registers a DataFrame query with the SQL it must agree with."""

    def add(f):
        _frames[name] = (f, sql)
        return f

    return add


def cents(c: str):
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


frame("scalar_sum_filter", "select cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as total from lineitem where l_quantity < 10 and l_discount > 0.05")(
    lambda t: t["lineitem"].filter("l_quantity < 10 and l_discount > 0.05").agg(cents("l_extendedprice").alias("total"))
)
frame("scalar_count", "select count(*) as all_rows, count(l_returnflag) as flagged from lineitem where l_tax = 0")(
    lambda t: t["lineitem"].filter("l_tax = 0").agg(F.count("*").alias("all_rows"), F.count("l_returnflag").alias("flagged"))
)
frame("scalar_avg", "select round(avg(l_quantity), 6) as mean, sum(cast(l_quantity as bigint))::bigint // count(l_quantity) as floored from lineitem")(
    lambda t: t["lineitem"].agg(F.round(F.avg("l_quantity"), 6).alias("mean"), S.avg_floor(F.col("l_quantity").cast("long")).alias("floored"))
)
frame("scalar_min_max", "select min(c_acctbal) as low, max(c_acctbal) as high, min(c_name) as first_name from customer")(
    lambda t: t["customer"].agg(F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"), F.min("c_name").alias("first_name"))
)
frame("empty_aggregates", "select count(*) as n, cast(sum(p_size) as bigint) as total, min(p_size) as low, avg(p_size) as mean from part where p_size > 1000")(
    lambda t: t["part"].filter("p_size > 1000").agg(F.count("*").alias("n"), F.sum("p_size").alias("total"), F.min("p_size").alias("low"), F.avg("p_size").alias("mean"))
)
frame("arith_sum", "select cast(sum(p_size * 3 - p_partkey + (-p_size)) as bigint) as total, cast(sum(p_partkey // 7) as bigint) as sevenths from part")(
    lambda t: t["part"].agg(F.sum(F.col("p_size") * 3 - F.col("p_partkey") + (-F.col("p_size"))).alias("total"), F.sum(S.int_div(F.col("p_partkey"), F.lit(7))).alias("sevenths"))
)
frame("fractional_division", "select p_partkey, round(p_size / 4, 6) as quarter from part where p_size <= 5")(
    lambda t: t["part"].filter("p_size <= 5").select("p_partkey", F.round(F.col("p_size") / 4, 6).alias("quarter"))
)
frame("case_sum", "select cast(sum(case when l_quantity > 40 then 2 when l_quantity > 20 then 1 else 0 end) as bigint) as points, count(case when l_tax > 0.05 then 1 end) as taxed from lineitem")(
    lambda t: t["lineitem"].agg(F.sum(F.when(F.col("l_quantity") > 40, 2).when(F.col("l_quantity") > 20, 1).otherwise(0)).alias("points"), F.count(F.when(F.col("l_tax") > 0.05, 1)).alias("taxed"))
)
frame("abs_sum", "select cast(sum(abs(cast(round(c_acctbal) as bigint))) as bigint) as total from customer")(lambda t: t["customer"].agg(F.sum(F.abs(F.round("c_acctbal").cast("long"))).alias("total")))
frame("lower_upper", "select distinct lower(c_mktsegment) as low, upper(c_mktsegment) as high from customer")(lambda t: t["customer"].select(F.lower("c_mktsegment").alias("low"), F.upper("c_mktsegment").alias("high")).distinct())
frame("in_list", "select count(*) as n from part where p_size in (1, 7, 23) and p_type not in ('PROMO', 'SMALL')")(lambda t: t["part"].filter(F.col("p_size").isin(1, 7, 23) & ~F.col("p_type").isin("PROMO", "SMALL")).agg(F.count("*").alias("n")))
frame("between", "select count(*) as n from part where p_size between 10 and 20")(lambda t: t["part"].filter(F.col("p_size").between(10, 20)).agg(F.count("*").alias("n")))
frame("column_comparison", "select count(*) as n from lineitem where l_tax > l_discount and not (l_suppkey = l_linenumber)")(lambda t: t["lineitem"].filter((F.col("l_tax") > F.col("l_discount")) & ~(F.col("l_suppkey") == F.col("l_linenumber"))).agg(F.count("*").alias("n")))
for _name, _pattern in (("like_prefix", "small%"), ("like_suffix", "%ring"), ("like_contains", "%l w%"), ("like_exact", "red widget"), ("like_underscore", "r_d w_dget")):
    frame(_name, f"select p_partkey, p_name from part where p_name like '{_pattern}'")(lambda t, p=_pattern: t["part"].filter(S.like(F.col("p_name"), p)).select("p_partkey", "p_name"))
frame("ilike", "select count(*) as n from part where p_name ilike '%RiNg'")(lambda t: t["part"].filter(F.col("p_name").ilike("%RiNg")).agg(F.count("*").alias("n")))
frame("null_filter", "select count(*) as n, count(case when props is null then 1 end) as missing from events where value is not null")(lambda t: t["events"].filter(F.col("value").isNotNull()).agg(F.count("*").alias("n"), F.count(F.when(F.col("props").isNull(), 1)).alias("missing")))
frame("bool_filter", "select count(*) as n from (select p_size > 25 as large from part) as f where large")(lambda t: t["part"].select((F.col("p_size") > 25).alias("large")).filter("large").agg(F.count("*").alias("n")))
frame("projection", "select o_orderkey as id, o_custkey, o_orderpriority as priority from orders where o_orderstatus = 'P'")(lambda t: t["orders"].filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"), "o_custkey", F.col("o_orderpriority").alias("priority")))
frame("distinct_proj", "select distinct o_orderstatus, o_orderpriority from orders")(lambda t: t["orders"].select("o_orderstatus", "o_orderpriority").distinct())
frame("order_limit", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")(lambda t: t["orders"].select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25))
frame("offset_page", "select n_nationkey, n_name from nation order by n_name limit 5 offset 10")(lambda t: t["nation"].select("n_nationkey", "n_name").orderBy("n_name").offset(10).limit(5))
frame("group_two_key", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by all")(lambda t: t["lineitem"].groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")))
frame("group_having", "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 15")(lambda t: t["orders"].groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n > 15"))
frame("group_multi_agg", "select l_suppkey, count(*) as n, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as total, min(l_quantity) as low, max(l_quantity) as high, round(avg(l_quantity), 6) as mean from lineitem group by l_suppkey")(
    lambda t: t["lineitem"].groupBy("l_suppkey").agg(F.count("*").alias("n"), cents("l_extendedprice").alias("total"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"), F.round(F.avg("l_quantity"), 6).alias("mean"))
)
frame("group_count_distinct", "select o_orderpriority, count(distinct o_custkey) as customers from orders group by o_orderpriority")(lambda t: t["orders"].groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("customers")))
frame("group_mod_bucket", "select o_orderkey % 100 as bucket, count(*) as n from orders group by bucket")(lambda t: t["orders"].groupBy((F.col("o_orderkey") % 100).alias("bucket")).agg(F.count("*").alias("n")))
frame("group_min_max", "select c_nationkey, min(c_acctbal) as low, max(c_acctbal) as high from customer group by c_nationkey")(lambda t: t["customer"].groupBy("c_nationkey").agg(F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high")))
frame("distinct_group", "select distinct n from (select c_nationkey, count(*) as n from customer group by c_nationkey) as g")(lambda t: t["customer"].groupBy("c_nationkey").agg(F.count("*").alias("n")).select("n").distinct())
frame("join_inner", "select n_name, r_name from nation join region on n_regionkey = r_regionkey")(lambda t: t["nation"].join(t["region"], F.expr("n_regionkey = r_regionkey")).select("n_name", "r_name"))
frame("join_left", "select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey and o_orderstatus = 'P'")(lambda t: t["customer"].join(t["orders"].filter("o_orderstatus = 'P'"), F.expr("c_custkey = o_custkey"), "left").select("c_custkey", "o_orderkey"))
frame("join_right", "select s_suppkey, n_name from supplier right join nation on s_nationkey = n_nationkey")(lambda t: t["supplier"].join(t["nation"], F.expr("s_nationkey = n_nationkey"), "right").select("s_suppkey", "n_name"))
frame("join_full", "select c_custkey, s_suppkey from (select * from customer where c_custkey < 200) as c full join (select * from supplier where s_suppkey > 20) as s on c_custkey = s_suppkey")(
    lambda t: t["customer"].filter("c_custkey < 200").join(t["supplier"].filter("s_suppkey > 20"), F.expr("c_custkey = s_suppkey"), "full").select("c_custkey", "s_suppkey")
)
frame("join_cross", "select n_nationkey, r_regionkey from nation cross join region")(lambda t: t["nation"].crossJoin(t["region"]).select("n_nationkey", "r_regionkey"))
frame("join_semi", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)")(lambda t: t["customer"].join(t["orders"].filter("o_totalprice > 400000"), F.expr("c_custkey = o_custkey"), "left_semi").select("c_custkey"))
frame("join_anti", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)")(lambda t: t["customer"].join(t["orders"].filter("o_totalprice > 400000"), F.expr("c_custkey = o_custkey"), "left_anti").select("c_custkey"))
frame("join_nway3", "select r_name, count(*) as n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name")(
    lambda t: t["customer"].join(t["nation"], F.expr("c_nationkey = n_nationkey")).join(t["region"], F.expr("n_regionkey = r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n"))
)
frame("join_left_isnull", "select c_custkey from customer left join (select * from orders where o_totalprice > 300000) as o on c_custkey = o_custkey where o_orderkey is null")(lambda t: t["customer"].join(t["orders"].filter("o_totalprice > 300000"), F.expr("c_custkey = o_custkey"), "left").filter("o_orderkey is null").select("c_custkey"))
frame("join_group", "select c_mktsegment, round(avg(o_totalprice), 2) as mean, max(o_totalprice) as high from customer join orders on c_custkey = o_custkey group by c_mktsegment")(
    lambda t: t["customer"].join(t["orders"], F.expr("c_custkey = o_custkey")).groupBy("c_mktsegment").agg(F.round(F.avg("o_totalprice"), 2).alias("mean"), F.max("o_totalprice").alias("high"))
)
frame("join_multi_key", "select count(*) as n from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_suppkey = b.l_suppkey and a.l_linenumber = b.l_linenumber")(
    lambda t: t["lineitem"].alias("a").join(t["lineitem"].alias("b"), F.expr("a.l_orderkey = b.l_orderkey and a.l_suppkey = b.l_suppkey and a.l_linenumber = b.l_linenumber")).agg(F.count("*").alias("n"))
)
frame("join_derived", "select o_orderkey, o_totalprice from orders join (select o_custkey as k, max(o_totalprice) as top from orders group by o_custkey) as m on o_custkey = k and o_totalprice = top")(
    lambda t: t["orders"].join(t["orders"].groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("top")), F.expr("o_custkey = k and o_totalprice = top")).select("o_orderkey", "o_totalprice")
)
frame("zipf_multiplicity", "select cast(sum(l_orderkey) as bigint) as total from lineitem join events on l_suppkey = user_id")(
    lambda t: joins.sum_over_join(t["lineitem"], t["events"], {"l_suppkey": "user_id"}, "l_orderkey").select(F.col("total").cast("long").alias("total"))
)
frame("skewed_join", "select event_type, count(*) as n from events join customer on user_id = c_custkey group by event_type")(
    lambda t: joins.count_over_join(t["events"], t["customer"], {"user_id": "c_custkey"}, ("event_type",))
)
frame("derived_scalar", "select max(n) as most, cast(sum(n) as bigint) as total from (select o_custkey, count(*) as n from orders group by o_custkey) as g")(lambda t: t["orders"].groupBy("o_custkey").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("total")))
frame("window_sum", "select o_orderkey, cast(sum(cast(o_totalprice as decimal(18,2))) over (partition by o_custkey) as double) as of_customer, cast(sum(cast(o_totalprice as decimal(18,2))) over (partition by o_custkey order by o_orderdate, o_orderkey) as double) as so_far from orders where o_custkey < 100")(
    lambda t: t["orders"].filter("o_custkey < 100").select("o_orderkey", cents_over(Window.partitionBy("o_custkey")).alias("of_customer"), cents_over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("so_far"))
)
frame("row_number", "select event_id, row_number() over (partition by user_id order by ts, event_id) as place from events")(lambda t: t["events"].select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("place")))
frame("derived_window", "select o_orderkey from (select o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as place from orders) as w where place <= 2")(
    lambda t: t["orders"].select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("place")).filter("place <= 2").select("o_orderkey")
)
frame("topk", "select l_orderkey, l_linenumber, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey limit 40")(
    lambda t: t["lineitem"].orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey").limit(40).select("l_orderkey", "l_linenumber", "l_extendedprice")
)
for _name, _op in (("union_all", "unionAll"), ("intersect", "intersect"), ("intersect_all", "intersectAll"), ("except_all", "exceptAll")):
    frame(_name, f"select c_nationkey as k from customer {_name.replace('_', ' ')} select s_nationkey from supplier")(lambda t, o=_op: getattr(t["customer"].select(F.col("c_nationkey").alias("k")), o)(t["supplier"].select("s_nationkey")))
frame("except", "select p_size as k from part except select s_nationkey from supplier")(lambda t: t["part"].select(F.col("p_size").alias("k")).subtract(t["supplier"].select("s_nationkey")))
frame("int_div_large", "select p_partkey, (9007199254740993 + p_partkey) // 1 as whole, (9223372036854775807 - p_partkey) // 3 as third, (p_partkey - 9223372036854775807) // 1 as low, p_partkey // nullif(p_size % 3, 0) as by_size from part")(
    lambda t: t["part"].select("p_partkey", S.int_div(F.col("p_partkey") + 9007199254740993, F.lit(1)).alias("whole"), S.int_div(9223372036854775807 - F.col("p_partkey"), F.lit(3)).alias("third"), S.int_div(F.col("p_partkey") - 9223372036854775807, F.lit(1)).alias("low"), S.int_div(F.col("p_partkey"), F.col("p_size") % 3).alias("by_size"))
)
frame("join_partitioned_hash", "select o_orderpriority, count(*) as n, cast(sum(l_linenumber) as bigint) as total from lineitem join orders on l_orderkey = o_orderkey group by o_orderpriority")(
    lambda t: t["lineitem"].join(t["orders"].hint("shuffle_hash"), F.expr("l_orderkey = o_orderkey")).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("total"))
)
frame("join_sort_merge", "select o_orderstatus, count(*) as n from lineitem join orders on l_orderkey = o_orderkey group by o_orderstatus")(
    lambda t: t["lineitem"].join(t["orders"].hint("merge"), F.expr("l_orderkey = o_orderkey")).groupBy("o_orderstatus").agg(F.count("*").alias("n"))
)
frame("distinct_counts", " union all ".join(f"select '{c}' as column_name, count(distinct {c}) as distinct_count from lineitem" for c in ("l_returnflag", "l_linenumber", "l_suppkey")))(
    lambda t: stats.distinct_counts(t["lineitem"], ("l_returnflag", "l_linenumber", "l_suppkey"))
)
frame("group_cube", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by cube (o_orderstatus, o_orderpriority)")(lambda t: t["orders"].cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")))
frame("union", "select c_nationkey as k from customer union select s_nationkey from supplier")(lambda t: t["customer"].select(F.col("c_nationkey").alias("k")).union(t["supplier"].select("s_nationkey")).distinct())
frame("stats_bundle", stats.bundle_sql("lineitem", ("l_quantity", "l_extendedprice", "l_returnflag")))(lambda t: stats.bundle(t["lineitem"], ("l_quantity", "l_extendedprice", "l_returnflag")))
frame("histogram", "with b as (select min(p_size) as lo, max(p_size) as hi from part) select cast((p_size - lo) * 8 // (hi - lo + 1) as bigint) as bin, count(*) as n from part, b group by bin")(lambda t: stats.histogram(t["part"], "p_size", 8))
frame("zone_map", "select cast(o_orderkey // 4096 as bigint) as zone, min(o_orderkey) as low, max(o_orderkey) as high, count(*) as n from orders group by zone")(lambda t: stats.zones(t["orders"], "o_orderkey", S.int_div(F.col("o_orderkey"), F.lit(4096))))
_frames["approx_distinct"] = (lambda t: t["lineitem"].agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts")), "")

_texts |= {
    "scalar_subq_where": "select o_orderkey, o_totalprice from orders where o_totalprice > (select avg(o_totalprice) * 1.9 from orders)",
    "scalar_subq_select": "select n_name, (select count(*) from region) as regions from nation",
    "exists_unc": "select r_name from region where exists (select 1 from nation where n_nationkey > 20)",
    "exists_corr": "select n_name from nation where exists (select 1 from supplier where s_nationkey = n_nationkey and s_acctbal > 9000)",
    "not_exists": "select n_name from nation where not exists (select 1 from supplier where s_nationkey = n_nationkey and s_acctbal > 5000)",
    "in_subq": "select c_custkey from customer where c_nationkey in (select n_nationkey from nation where n_regionkey = 2)",
    "in_corr": "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_custkey = o_custkey and c_acctbal > o_totalprice)",
    "not_in": "select s_suppkey from supplier where s_nationkey not in (select c_nationkey from customer where c_acctbal > 9900)",
    "not_in_null": "select s_suppkey from supplier where s_nationkey not in (select case when c_custkey = 3 then null else c_nationkey end from customer where c_custkey < 5)",
    "corr_scalar": "select o_orderkey from orders o where o_totalprice = (select max(i.o_totalprice) from orders i where i.o_custkey = o.o_custkey)",
    "having_subq": "select c_nationkey, count(*) as n from customer group by c_nationkey having count(*) > (select avg(m) from (select count(*) as m from customer group by c_nationkey) as g)",
    "in_group_having": "select c_name from customer where c_custkey in (select o_custkey from orders group by o_custkey having count(*) > 18)",
    "derived_group": "select cast(sum(top) as double) as total from (select c_nationkey, max(c_acctbal) as top from customer group by c_nationkey) as g where c_nationkey = 7",
    "derived_filter": "select count(*) as n from (select p_partkey, p_size from part where p_size > 10) as d where p_size < 30",
    "cte": "with big as (select o_custkey, count(*) as n from orders group by o_custkey), top as (select max(n) as most from big) select o_custkey, n from big join top on n = most",
    "cte_recursive": "with recursive walk(n, total) as (select 1, 1 union all select n + 1, total + n + 1 from walk where n < 50) select n, total from walk",
    "right_join_sql": "select s_name, n_name from nation right join supplier on n_nationkey = s_nationkey",
    "join_semi_sql": "select s_suppkey from supplier semi join nation on s_nationkey = n_nationkey",
    "join_anti_sql": "select p_partkey from part anti join (select l_partkey from lineitem where l_quantity > 45) as x on p_partkey = l_partkey",
    "rank_sql": "select o_orderkey, rank() over (partition by o_custkey order by o_orderpriority) as place, dense_rank() over (partition by o_custkey order by o_orderpriority) as tier from orders",
    "rollup_sql": "select o_orderstatus, o_orderpriority, count(*) as n from orders group by rollup (o_orderstatus, o_orderpriority)",
    "grouping_sets_sql": "select o_orderstatus, o_orderpriority, max(o_orderkey) as top from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())",
    "join_using_sql": "select k, a, b from (select o_custkey as k, count(*) as a from orders group by o_custkey) as x join (select c_custkey as k, c_nationkey as b from customer) as y using (k)",
    "join_natural_sql": "select k, a, b from (select o_custkey as k, count(*) as a from orders group by o_custkey) as x natural join (select c_custkey as k, c_nationkey as b from customer) as y",
    "join_comma_sql": "select n_name, r_name from nation, region where n_regionkey = r_regionkey and r_name <> 'ASIA'",
    "set_ops_nested": "(select c_nationkey as k from customer except select s_nationkey from supplier) union all select n_regionkey from nation",
    "window_sql": "select p_partkey, cast(sum(p_size) over (partition by p_brand order by p_partkey) as bigint) as running from part",
}


def cents_over(window):
    return F.sum(F.col("o_totalprice").cast("decimal(18,2)")).over(window).cast("double")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = {name: (lambda spark, d, f=f: f(load(spark, d))) for name, (f, _) in _frames.items()}
    return made | {name: (lambda spark, d, text=text: Engine(spark, load(spark, d)).sql(text)) for name, text in _texts.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _frames.items() if sql} | _texts
