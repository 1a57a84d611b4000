"""The benchmark workloads as query shapes: star schema, order tables, skewed scans and joins, filings."""

from __future__ import annotations

from tessera.plans.shape import Shape

CENTS = "cast(sum(cast({0} as decimal(18,2))) as double)"
WHOLE = "cast(sum({0}) as bigint)"
COUNT = "cast(count(*) as bigint)"


def _sum(table: str, what: str, *where: str, name: str = "total", agg: str = WHOLE) -> Shape:
    return Shape({"t": table}, {name: agg.format(what)}, where=where)


def _by(table: str, keys: tuple[str, ...], what: str, *where: str, name: str = "total") -> Shape:
    return Shape({"t": table}, {k: k for k in keys} | {name: WHOLE.format(what)}, where=where, keys=keys)


def star() -> dict[str, Shape]:
    """Fifteen star-schema queries on the flattened star."""
    flat, revenue, price = "lineorder_flat", "lo_revenue", "lo_extendedprice * lo_discount"
    profit = "lo_revenue - lo_supplycost"
    days = lambda a, b: f"lo_orderdate between {a} and {b}"
    off = lambda a, b: f"lo_discount between {a} and {b}"
    cities = ("c_city", "s_city", "d_year")
    return {
        "ssb_1": _sum(flat, price, days(19960101, 19961231), off(1, 3), "lo_quantity < 25", name="revenue"),
        "ssb_2": _sum(flat, price, days(19970101, 19970131), off(4, 6), "lo_quantity between 26 and 35", name="revenue"),
        "ssb_3": _sum(flat, price, "d_weeknuminyear = 6", "d_year = 1997", off(5, 7), "lo_quantity between 26 and 35", name="revenue"),
        "ssb_4": _by(flat, ("d_year", "p_brand"), revenue, "p_category = 'PROMO'", "s_region = 'AMERICA'", name="brand_revenue"),
        "ssb_5": _by(flat, ("d_year", "p_brand"), revenue, "p_brand = 'Brand#12'", "p_size >= 10", "s_region = 'ASIA'", name="brand_revenue"),
        "ssb_6": _by(flat, ("d_year", "p_brand"), revenue, "p_brand = 'Brand#12'", "s_region = 'EUROPE'", name="brand_revenue"),
        "ssb_7": _by(flat, ("c_nation", "s_nation", "d_year"), revenue, "c_region = 'ASIA' and s_region = 'ASIA'", days(19950101, 20001231), name="revenue"),
        "ssb_8": _by(flat, cities, revenue, "c_nation = 'NATION_1'", "s_nation = 'NATION_1'", days(19950101, 20001231), name="revenue"),
        "ssb_9": _by(flat, cities, revenue, "c_city = 'NATION_2-1'", "s_city = 'NATION_2-0'", days(19950101, 20001231), name="revenue"),
        "ssb_10": _by(flat, ("c_region", "s_region", "d_year"), revenue, "c_nation = 'NATION_2'", days(19971201, 19980331), name="revenue"),
        "ssb_11": _by(flat, ("d_year", "c_nation"), profit, "c_region = 'AMERICA'", "s_region = 'AMERICA'", "p_mfgr = 'MFGR#1'", name="profit"),
        "ssb_12": _by(flat, ("d_year", "c_nation"), profit, "c_region = 'AMERICA'", "s_region = 'AMERICA'", days(19970101, 19981231), "p_mfgr = 'MFGR#1'", name="profit"),
        "ssb_13": _by(flat, ("d_year", "s_nation", "p_category"), profit, "c_region = 'AMERICA'", "s_nation = 'NATION_1'", days(19970101, 19971231), "p_category = 'LARGE'", name="profit"),
        "ssb_14": _sum(flat, price, days(19970101, 19971231), off(5, 7), "lo_quantity < 24", name="revenue"),
        "ssb_15": _by(flat, ("lo_orderpriority",), "lo_quantity", days(19980901, 19981231), name="sum_qty"),
    }


def orders() -> dict[str, Shape]:
    """Scans, joins and groupings of the order tables with predicates that reach the scan."""
    li, price = "lineitem", "cast(l_extendedprice as decimal(18,2)) * cast(l_discount as decimal(18,2))"
    ship = lambda a, b: f"l_shipdate between date '{a}' and date '{b}'"
    q6 = lambda q, d, s: _sum(li, price, f"l_quantity between {q[0]} and {q[1]}", f"l_discount between {d[0]} and {d[1]}", ship(*s), name="revenue", agg="cast(sum({0}) as double)")
    q1 = lambda until: Shape({"t": li}, {"l_returnflag": "l_returnflag", "l_linestatus": "l_linestatus", "sum_qty": WHOLE.format("cast(l_quantity as bigint)")}, where=(f"l_shipdate <= date '{until}'",), keys=("l_returnflag", "l_linestatus"))
    pair = {"l": li, "o": "orders"}
    key = {"o": "l.l_orderkey = o.o_orderkey"}
    q3 = lambda order, after: Shape(pair, {"revenue": CENTS.format("l.l_extendedprice")}, on=key, where=(f"o.o_orderdate < date '{order}'", f"l.l_shipdate > date '{after}'"))
    return {
        "tpch_q1": Shape(
            {"t": li},
            {
                "l_returnflag": "l_returnflag", "l_linestatus": "l_linestatus", "sum_qty": WHOLE.format("cast(l_quantity as bigint)"), "sum_base_price": CENTS.format("l_extendedprice"),
                "sum_disc_price": "cast(sum(cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2)))) as double)", "avg_qty": "round(avg(l_quantity), 4)", "count_order": COUNT,
            },
            where=("l_shipdate <= date '2001-08-02'",), keys=("l_returnflag", "l_linestatus"),
        ),
        "tpch_q3": Shape(
            {"c": "customer", "o": "orders", "l": li},
            {"l_orderkey": "l.l_orderkey", "revenue": "cast(sum(cast(l.l_extendedprice as decimal(12,2)) * (1 - cast(l.l_discount as decimal(4,2)))) as double)"},
            on={"o": "c.c_custkey = o.o_custkey", "l": "l.l_orderkey = o.o_orderkey"},
            where=("c.c_mktsegment = 'BUILDING'", "o.o_orderdate < date '1998-03-15'", "l.l_shipdate > date '1998-03-15'"), keys=("l_orderkey",), order=("-revenue", "l_orderkey"), limit=10,
        ),
        "tpch_q3_scalar": Shape(
            {"l": li, "o": "orders", "c": "customer"}, {"revenue": CENTS.format("l.l_extendedprice")}, on={"o": "l.l_orderkey = o.o_orderkey", "c": "o.o_custkey = c.c_custkey"},
            where=("c.c_mktsegment = 'BUILDING'", "o.o_orderdate < date '1998-03-15'", "l.l_shipdate > date '1998-03-15'"),
        ),
        "tpch_q6": q6((1, 50), (0.01, 0.05), ("1997-01-01", "1997-12-31")),
        "h5": q6((5, 30), (0.02, 0.04), ("1997-03-01", "1997-06-30")), "h6": q3("1997-03-15", "1997-03-15"), "h7": q1("2000-06-01"), "h15": q6((8, 25), (0.03, 0.05), ("1997-04-01", "1997-04-30")), "h16": q1("2000-08-01"),
        "h17": q3("1997-02-01", "1997-02-01"), "h18": _sum(li, "l_extendedprice", "l_returnflag = 'R'", agg=CENTS), "h19": _sum("orders", "o_totalprice", "o_orderdate between date '1998-01-01' and date '1998-12-31'", agg=CENTS),
        "h20": _sum("orders", "o_totalprice", "o_orderpriority = '3-MEDIUM'", agg=CENTS),
        "h24": Shape({"t": "orders"}, {"bucket": "o_orderkey % 1000", "total": CENTS.format("o_totalprice")}, keys=("bucket",)),
        "h25": _sum(li, "l_extendedprice", "l_quantity between 10 and 40", "l_discount between 0.03 and 0.06", ship("1998-06-01", "1998-08-31"), "l_returnflag = 'N'", agg=CENTS),
    }


def skewed() -> dict[str, Shape]:
    """Selective scans of a clustered table, joins on skewed keys, string filters."""
    scan, days = "scan_skew", lambda a, b: f"event_date between {a} and {b}"
    zipf = {"l": "zipf_left", "r": "zipf_right"}
    on = {"r": "l.k = r.k and l.region = r.region"}
    total = {"total": WHOLE.format("l.amount")}
    flat = "lineorder_flat"
    return {
        "h1": _sum(scan, "amount", days(19960101, 19961231)), "h2": _by(scan, ("region",), "amount", days(19950101, 19991231)), "h3": Shape(zipf, total, on=on, where=("l.region = 2",)),
        "h4": _sum("str_filter", "amount", "form_type = '10-K'", "cik like '00%'", "active = 1"), "h8": Shape({"t": scan}, {"cnt": COUNT}, where=(days(19920101, 19920630),)), "h9": _sum(scan, "amount", days(19950201, 19950207)),
        "h10": _sum(scan, "amount", days(19970101, 19971231)), "h11": Shape(zipf, total, on=on, where=("l.region = 0",)), "h12": Shape(zipf, {"region": "l.region"} | total, on=on, keys=("region",)),
        "h13": _sum("str_filter", "amount", "form_type = '8-K'", "cik like '10%'", "active = 1"), "h14": Shape({"t": "str_filter"}, {"cnt": COUNT}, where=("active = 1",)),
        "h21": _sum(flat, "lo_revenue", "lo_discount between 2 and 4", "lo_quantity between 20 and 35", "lo_orderdate between 19960801 and 19961231"), "h22": _by(flat, ("lo_orderpriority",), "lo_revenue"),
        "h23": _sum(flat, "lo_revenue", "lo_orderdate between 19970101 and 19971231", "lo_discount >= 8"),
    }


SUM = "cast(sum(n.value) as double)"
AVG = "round(avg(n.value), 4)"
_JOIN = {"s": "n.adsh = s.adsh", "t": "n.tag = t.tag and n.version = t.version", "p": "n.adsh = p.adsh and n.tag = p.tag and n.version = p.version"}
_NAME = {"n": "num", "s": "sub", "t": "tag", "p": "pre"}


def _facts(with_: str, select: dict[str, str], keys: tuple[str, ...], *where: str, having: str = "", order: tuple[str, ...] = (), limit: int = 0, on: dict[str, str] | None = None) -> Shape:
    first, *rest = with_
    joins = {a: (on or {}).get(a, _JOIN[a]) for a in rest}
    return Shape({a: _NAME[a] for a in with_}, select, on=joins, where=where, keys=keys, having=having, order=order or tuple(keys), limit=limit)


def _distinct(column: str) -> str:
    return f"cast(count(distinct {column}) as bigint)"


def _statement(stmt: str, fy: int, limit: int) -> Shape:
    return _facts("nsp", {"name": "s.name", "stmt": "p.stmt", "tag": "n.tag", "plabel": "p.plabel", "total_value": SUM, "cnt": COUNT}, ("name", "stmt", "tag", "plabel"),
                  "n.uom = 'USD'", f"p.stmt = '{stmt}'", f"s.fy = {fy}", "n.value is not null", order=("-total_value", "name", "tag", "plabel"), limit=limit)


def _labelled(uom: str, form: str, stmt: str, limit: int) -> Shape:
    select = {"name": "s.name", "sic": "s.sic", "tlabel": "t.tlabel", "stmt": "p.stmt", "plabel": "p.plabel", "total_value": SUM, "cnt": COUNT}
    return _facts("nstp", select, ("name", "sic", "tlabel", "stmt", "plabel"), f"n.uom = '{uom}'", f"s.form = '{form}'", f"p.stmt = '{stmt}'", "n.value is not null", "t.abstract = 0",
                  having="cnt > 1", order=("-total_value", "name", "sic", "tlabel", "plabel"), limit=limit)


def _presented(stmt: str, limit: int) -> Shape:
    """Tags with facts that some statement presents: a semi join, then a grouping."""
    return Shape({"n": "num", "p": "pre"}, {"tag": "n.tag", "version": "n.version", "cnt": COUNT}, on={"p": f"p.tag = n.tag and p.version = n.version and p.stmt = '{stmt}'"}, how={"p": "left semi"},
                 where=("n.uom = 'USD'", "n.value is not null"), keys=("tag", "version"), order=("-cnt", "tag", "version"), limit=limit)


def filings() -> dict[str, Shape]:
    """The filing queries and templates that are single aggregations over joins."""
    by_line = Shape({"p": "pre"}, {"stmt": "p.stmt", "rfile": "p.rfile", "cnt": COUNT, "num_filings": _distinct("p.adsh"), "avg_line_num": "round(avg(p.line), 4)"}, where=("p.stmt is not null",), keys=("stmt", "rfile"), order=("-cnt", "stmt", "rfile"))
    industry = lambda stmt, limit: _facts("nstp", {"sic": "s.sic", "tlabel": "t.tlabel", "stmt": "p.stmt", "num_companies": _distinct("s.cik"), "total_value": SUM, "avg_value": AVG}, ("sic", "tlabel", "stmt"),
                                          "n.uom = 'USD'", f"p.stmt = '{stmt}'", "s.sic between 4000 and 4999", "n.value is not null", "t.abstract = 0", having="num_companies >= 2", order=("-total_value", "sic", "tlabel"), limit=limit)
    orphans = Shape({"n": "num", "p": "pre"}, {"tag": "n.tag", "version": "n.version", "cnt": COUNT, "total": SUM}, on={"p": _JOIN["p"]}, how={"p": "left anti"},
                    where=("n.uom = 'USD'", "n.ddate between 20230101 and 20231231", "n.value is not null"), keys=("tag", "version"), having="cnt > 10", order=("-cnt", "tag", "version"), limit=100)
    pool = {
        "edgar_q1": by_line, "edgar_q4": industry("EQ", 500), "edgar_q5": _presented("CI", 500), "edgar_q6": _statement("IS", 2023, 200), "edgar_q7": _statement("CF", 2023, 50), "edgar_q8": _statement("CF", 2023, 500),
        "edgar_q9": _labelled("shares", "10-Q", "BS", 50), "edgar_q10": _presented("CI", 100), "edgar_q11": _labelled("shares", "10-Q", "BS", 500), "edgar_q12": _statement("IS", 2022, 1000), "edgar_q13": _statement("IS", 2022, 100),
        "edgar_q14": _presented("IS", 100), "edgar_q15": _statement("BS", 2023, 500), "edgar_q16": _presented("BS", 100), "edgar_q17": _presented("BS", 1000), "edgar_q18": _statement("BS", 2023, 200), "edgar_q19": _presented("EQ", 200),
        "edgar_q20": _presented("BS", 200), "edgar_q21": _presented("CF", 100), "edgar_q22": _presented("CF", 200), "edgar_q23": _presented("EQ", 1000), "edgar_q24": orphans, "edgar_q25": _labelled("USD", "10-K", "BS", 200),
    }
    fact = ("n.value is not null",)
    usd = ("n.uom = 'USD'", *fact)
    low_high = {"min_value": "min(n.value)", "max_value": "max(n.value)"}
    templates = {
        "edgar_t1": _facts("n", {"tag": "n.tag", "cnt": COUNT, "total_value": SUM, "avg_value": AVG} | low_high, ("tag",), *usd, "n.ddate between 20210101 and 20221231", having="cnt > 10", order=("-total_value", "tag"), limit=50),
        "edgar_t2": Shape({"s": "sub"}, {"countryba": "s.countryba", "stprba": "s.stprba", "num_filings": COUNT}, where=("s.form = '10-K'", "s.countryba is not null", "s.stprba is not null"), keys=("countryba", "stprba"), order=("-num_filings", "countryba", "stprba"), limit=50),
        "edgar_t3": Shape({"t": "tag"}, {"datatype": "t.datatype", "iord": "t.iord", "crdr": "t.crdr", "tag_count": COUNT, "custom_count": WHOLE.format("t.custom"), "abstract_count": WHOLE.format("t.abstract")}, where=("t.datatype is not null",), keys=("datatype", "iord", "crdr"), order=("-tag_count", "datatype", "iord", "crdr"), limit=100),
        "edgar_t5": _facts("ns", {"form": "s.form", "num_values": COUNT, "total_value": SUM, "avg_value": AVG}, ("form",), *usd, "s.fy = 2022", order=("-total_value", "form")),
        "edgar_t6": _facts("ns", {"name": "s.name", "cik": "s.cik", "sic": "s.sic", "num_entries": COUNT, "total_value": SUM}, ("name", "cik", "sic"), "n.uom = 'USD'", "n.ddate between 20210101 and 20221231", "n.value > 0", having="total_value > 100000", order=("-total_value", "name", "sic"), limit=100),
        "edgar_t7": _facts("ps", {"form": "s.form", "fy": "s.fy", "num_lines": COUNT, "distinct_tags": _distinct("p.tag"), "avg_line": "round(avg(p.line), 4)"}, ("form", "fy"), "p.stmt = 'IS'", order=("-num_lines", "form", "fy"), limit=50, on={"s": "p.adsh = s.adsh"}),
        "edgar_t8": _facts("nt", {"crdr": "t.crdr", "iord": "t.iord", "datatype": "t.datatype", "cnt": COUNT, "total": SUM, "avg_val": AVG}, ("crdr", "iord", "datatype"), *usd, "t.crdr = 'D'", order=("-total", "iord", "datatype"), limit=50),
        "edgar_t9": _facts("pt", {"tlabel": "t.tlabel", "datatype": "t.datatype", "usage_count": COUNT, "filing_count": _distinct("p.adsh")}, ("tlabel", "datatype"), "p.stmt = 'BS'", "t.tlabel is not null", having="usage_count > 5", order=("-usage_count", "tlabel", "datatype"), limit=50, on={"t": "p.tag = t.tag and p.version = t.version"}),
        "edgar_t10": _facts("nst", {"name": "s.name", "tlabel": "t.tlabel", "total_value": SUM, "cnt": COUNT}, ("name", "tlabel"), *usd, "s.fy = 2022", "s.sic between 2000 and 5999", "t.abstract = 0", having="total_value > 10000", order=("-total_value", "name", "tlabel"), limit=100),
        "edgar_t11": _facts("pst", {"name": "s.name", "stmt": "p.stmt", "tlabel": "t.tlabel", "line": "p.line", "plabel": "p.plabel"}, (), "s.form = '10-K'", "p.stmt = 'BS'", "t.custom = 0", order=("name", "line", "tlabel", "plabel"), limit=100, on={"s": "p.adsh = s.adsh", "t": "p.tag = t.tag and p.version = t.version"}),
        "edgar_t19": _facts("ns", {"cik": "s.cik", "name": "s.name", "fy": "s.fy", "total_value": SUM}, ("cik", "name", "fy"), "n.tag = 'Revenues'", *usd, "n.qtrs = 0", "s.fp = 'FY'", limit=100),
        "edgar_t20": _facts("ns", {"sic": "s.sic", "num_companies": _distinct("s.cik"), "num_values": COUNT, "total_value": SUM, "avg_value": AVG} | low_high, ("sic",), *usd, "s.fy = 2023", "s.sic is not null", "n.value > 0", having="num_companies >= 3", order=("-total_value", "sic"), limit=50),
        "edgar_t21": Shape({"s": "sub"}, {"countryba": "s.countryba", "form": "s.form", "fy": "s.fy", "filing_count": COUNT, "company_count": _distinct("s.cik")}, where=("s.fy = 2022", "s.countryba is not null"), keys=("countryba", "form", "fy"), order=("-filing_count", "countryba", "form"), limit=50),
        "edgar_t23": _facts("ns", {"fy": "s.fy", "fp": "s.fp", "num_companies": _distinct("s.cik"), "total_value": SUM, "avg_value": AVG}, ("fy", "fp"), "n.tag = 'Assets'", *usd, "s.fp in ('Q1', 'Q2', 'Q3', 'Q4', 'FY')"),
        "edgar_t24": _facts("nt", {"tag": "n.tag", "tlabel": "t.tlabel", "datatype": "t.datatype", "num_filings": _distinct("n.adsh"), "total_entries": COUNT, "positive_count": WHOLE.format("case when n.value > 0 then 1 else 0 end"), "negative_count": WHOLE.format("case when n.value < 0 then 1 else 0 end")}, ("tag", "tlabel", "datatype"), *fact, "n.ddate between 20210101 and 20221231", "t.custom = 0", having="num_filings > 100", order=("-num_filings", "tag", "tlabel", "datatype"), limit=50),
        "edgar_t26": _facts("ns", {"form": "s.form", "tag": "n.tag", "cnt": COUNT, "min_val": "min(n.value)", "max_val": "max(n.value)", "avg_val": AVG}, ("form", "tag"), *usd, "n.qtrs = 1", "n.value <> 0", having="cnt > 50", order=("-cnt", "form", "tag"), limit=50),
        "edgar_t27": _facts("ns", {"countryba": "s.countryba", "stprba": "s.stprba", "num_filings": _distinct("s.adsh"), "num_companies": _distinct("s.cik"), "total_value": SUM}, ("countryba", "stprba"), "n.uom = 'USD'", "s.form = '10-K'", "s.countryba is not null", "n.value > 0", order=("-total_value", "countryba", "stprba"), limit=50),
    }
    return pool | templates


def all_shapes() -> dict[str, Shape]:
    return star() | orders() | skewed() | filings()
