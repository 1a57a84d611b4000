"""Integer-normalised and flattened forms of the order tables: money in cents, dates as YYYYMMDD."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import joins
from tessera.sources import store


def _day(column: str) -> str:
    return f"cast(year({column}) * 10000 + month({column}) * 100 + day({column}) as int)"


FLAT = {
    "lo_orderkey": "l_orderkey", "lo_orderdate": _day("o_orderdate"), "lo_orderpriority": "o_orderpriority", "lo_quantity": "cast(l_quantity as int)", "lo_discount": "cast(round(l_discount * 100) as int)",
    "lo_extendedprice": "cast(round(l_extendedprice * 100) as bigint)", "lo_revenue": "cast(round(l_extendedprice * 100) as bigint) * (100 - cast(round(l_discount * 100) as int))",
    "lo_supplycost": "cast(round(l_extendedprice * 100) as bigint) * 60", "d_year": "cast(year(o_orderdate) as int)", "d_weeknuminyear": "cast(1 + {week} as int)",
    "c_city": "concat(cn.n_name, '-', cast(c_custkey % 3 as varchar(4)))", "c_nation": "cn.n_name", "c_region": "cr.r_name", "s_city": "concat(sn.n_name, '-', cast(s_suppkey % 3 as varchar(4)))", "s_nation": "sn.n_name",
    "s_region": "sr.r_name", "p_mfgr": "concat('MFGR#', cast(p_size % 5 as varchar(4)))", "p_category": "p_type", "p_brand": "p_brand", "p_size": "p_size",
}


#: Columns that the stored star leaves to its readers, who compute them from stored ones.
DERIVED = {"lo_revenue": "lo_extendedprice * (100 - lo_discount)", "lo_supplycost": "lo_extendedprice * 60"}


def flat(t: dict[str, DataFrame], most_mb: int = 64) -> DataFrame:
    """The star joined once: lines are shuffled only to meet their orders.

    Suppliers, parts and customers are met by ``joins.coded``, so a number of each travels and its columns come last. One that
    would need over ``most_mb`` is shuffled to the join instead. No join changes its kind because a table is estimated to be small.
    The rows of a partition come by date, sorted while they are narrow.
    """
    nation, region = t["nation"], t["region"]
    place = lambda df, key, n, r: df.join(nation.alias(n), F.expr(f"{key} = {n}.n_nationkey")).join(region.alias(r), F.expr(f"{n}.n_regionkey = {r}.r_regionkey"))
    last = []

    def meet(df: DataFrame, key: str, dimension: DataFrame, finish: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
        other = dimension.columns[0]
        found = joins.coded(df, dimension, {key: other}, f"__of{other}", most_mb)
        if found is None:
            return df.join(finish(dimension).hint("merge"), F.col(key) == F.col(other))
        last.append((f"__of{other}", finish(found[1])))
        return found[0]

    # of a key that only its remainder is asked for, only that travels
    lines = meet(t["lineitem"], "l_suppkey", t["supplier"].selectExpr("s_suppkey as __supplier", "s_suppkey % 3 as s_suppkey", "s_nationkey"), lambda d: place(d, "s_nationkey", "sn", "sr"))
    lines = meet(lines, "l_partkey", t["part"].selectExpr("p_partkey as __part", "p_brand", "p_type", "p_size"))
    orders = meet(t["orders"], "o_custkey", t["customer"].selectExpr("c_custkey as __customer", "c_custkey % 3 as c_custkey", "c_nationkey"), lambda d: place(d, "c_nationkey", "cn", "cr"))
    df = lines.join(orders.hint("merge"), F.expr("l_orderkey = o_orderkey")).sortWithinPartitions("o_orderdate")
    df = df.filter(F.monotonically_increasing_id() >= 0)  # true of every row; Spark would drop a sort that it sees below a join
    for number, kinds in last:
        df = df.join(F.broadcast(kinds), number)
    return df.selectExpr(*(f"{e.format(week='(dayofyear(o_orderdate) - 1) div 7')} as {c}" for c, e in FLAT.items()))


def stored(spark: SparkSession, sf_dir: str, t: dict[str, DataFrame]) -> DataFrame:
    """The flattened star, written once and scanned; each of its files is sorted by date, so pages have narrow statistics."""
    df = store.kept(spark, f"{sf_dir}/lineorder_flat", lambda: flat(t).drop(*DERIVED))
    return df.selectExpr(*(f"{DERIVED[c]} as {c}" if c in DERIVED else c for c in FLAT))


FLAT_SQL = "select " + ", ".join(f"{e.format(week='(dayofyear(o_orderdate) - 1) // 7')} as {c}" for c, e in FLAT.items()) + (
    " from lineitem, orders, customer, supplier, part, nation cn, region cr, nation sn, region sr where l_orderkey = o_orderkey and o_custkey = c_custkey and l_suppkey = s_suppkey and l_partkey = p_partkey"
    " and c_nationkey = cn.n_nationkey and cn.n_regionkey = cr.r_regionkey and s_nationkey = sn.n_nationkey and sn.n_regionkey = sr.r_regionkey"
)


def normalised(df: DataFrame) -> DataFrame:
    """Any table with doubles as cents (long) and timestamps as YYYYMMDD (int)."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        out.append((F.round(c * 100).cast("long") if kind == "double" else F.date_format(c, "yyyyMMdd").cast("int") if kind.startswith("timestamp") or kind == "date" else c).alias(name))
    return df.select(*out)
