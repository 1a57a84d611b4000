"""Synthetic tables by arithmetic on a row number, so every engine makes the same rows.

Each table is (rows, {column: expression of ``id``}); it scales by the row count and is produced in parallel by ``spark.range``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.sources import store

_A = "((id * 7919 + 104729) % 1000003)"
_B = "((id * 15485863 + 32452843) % 999983)"
_C = "((id * 49979687 + 67867967) % 1299709)"
_FORM = "case {x} % 8 when 0 then '10-K' when 1 then '10-Q' when 2 then '8-K' when 3 then 'DEF 14A' when 4 then 'S-1' when 5 then '424B2' when 6 then '13F-HR' else 'NPORT-P' end"
_DIGITS = "lpad(cast({x} as varchar(20)), {n}, '0')"
_ADSH = "concat('0001', " + _DIGITS.format(x="{x}", n=8) + ")"
_TAG = "case {x} % 12 when 0 then 'Revenues' when 1 then 'NetIncomeLoss' when 2 then 'Assets' when 3 then 'Liabilities' when 4 then 'OperatingIncomeLoss' when 5 then 'CostOfRevenue' when 6 then 'StockholdersEquity' else concat('Tag', cast({x} % 40 as varchar(8))) end"
_VERSION = "case when {x} % 5 = 0 then 'custom' else concat('us-gaap/', cast(2021 + {x} % 3 as varchar(8))) end"
_STMT = "case {x} % 6 when 0 then 'BS' when 1 then 'IS' when 2 then 'CF' when 3 then 'EQ' when 4 then 'CI' else null end"

TABLES: dict[str, tuple[int, dict[str, str]]] = {
    "scan_skew": (500_000, {
        "event_date": "(1990 + (id * 20) div 500000) * 10000 + (1 + id % 12) * 100 + 1 + id % 28", "region": "cast(id % 12 as int)", "amount": f"({_A} % 999 + 1) * 100 + id % 97",
    }),
    "zipf_left": (60_000, {"k": f"({_A} % 80) * ({_B} % 90)", "region": f"cast({_C} % 5 as int)", "amount": f"10 + {_B} % 49991"}),
    "zipf_right": (15_000, {"k": f"({_B} % 80) * ({_C} % 90)", "region": f"cast({_A} % 5 as int)"}),
    "str_filter": (100_000, {"form_type": _FORM.format(x=_A), "cik": _DIGITS.format(x=_B, n=6), "amount": f"100 + {_C} % 9999900", "active": f"cast({_A} % 2 as int)"}),
    "sub": (2_000, {
        "adsh": _ADSH.format(x="id"), "cik": "id % 600", "name": "concat('COMPANY ', cast(id % 600 as varchar(8)))", "sic": f"case when id % 17 = 0 then null else cast(100 + ({_A} % 89) * 100 as int) end",
        "countryba": "case id % 7 when 0 then null when 1 then 'CA' when 2 then 'GB' else 'US' end", "stprba": "case when id % 5 = 0 then null else concat('S', cast(id % 9 as varchar(4))) end",
        "form": _FORM.format(x=f"({_B} % 3)"), "fy": "cast(2021 + (id div 600) % 3 as int)", "fp": "case id % 5 when 0 then 'FY' when 1 then 'Q1' when 2 then 'Q2' when 3 then 'Q3' else 'Q4' end",
    }),
    "num": (60_000, {
        "adsh": _ADSH.format(x="id % 2000"), "tag": _TAG.format(x=f"({_A})"), "version": _VERSION.format(x=f"({_A} div 40)"), "ddate": f"20210000 + ({_B} % 3) * 10000 + (1 + {_B} % 12) * 100 + 28",
        "qtrs": f"cast({_C} % 5 as int)", "uom": f"case {_B} % 5 when 0 then 'shares' when 1 then 'pure' else 'USD' end", "value": f"case when {_C} % 23 = 0 then null else cast(({_C} % 400000) - 50000 as double) end",
    }),
    "tag": (480, {
        "tag": _TAG.format(x="(id)"), "version": _VERSION.format(x="(id div 40)"), "custom": "cast(case when (id div 40) % 5 = 0 then 1 else 0 end as int)", "abstract": "cast(case when id % 11 = 0 then 1 else 0 end as int)",
        "datatype": "case id % 4 when 0 then 'monetary' when 1 then 'shares' when 2 then null else 'pure' end", "iord": "case when id % 2 = 0 then 'I' else 'D' end", "crdr": "case id % 3 when 0 then 'C' when 1 then 'D' else null end",
        "tlabel": "case when id % 19 = 0 then null else concat('Label ', cast(id % 40 as varchar(8))) end",
    }),
    "pre": (24_000, {
        "adsh": _ADSH.format(x="id % 2000"), "report": "cast(1 + id % 6 as int)", "line": f"cast(1 + {_A} % 60 as int)", "stmt": _STMT.format(x=f"({_C})"), "rfile": f"case when {_B} % 4 = 0 then 'X' else 'H' end",
        "tag": _TAG.format(x=f"({_B})"), "version": _VERSION.format(x=f"({_B} div 40)"), "plabel": f"concat('Plabel ', cast({_B} % 25 as varchar(8)))",
    }),
}


def table(spark: SparkSession, name: str, rows: int | None = None) -> DataFrame:
    """The table as a DataFrame."""
    count, columns = TABLES[name]
    return spark.range(rows or count).selectExpr(*(f"{e} as {c}" for c, e in columns.items()))


def stored(spark: SparkSession, name: str) -> DataFrame:
    """The table written once and scanned, sorted by its first column."""
    return store.kept(spark, f"generated/{name}", lambda: table(spark, name), by=(next(iter(TABLES[name][1])),))


def sql(name: str) -> str:
    """The same rows as a DuckDB query."""
    count, columns = TABLES[name]
    body = ", ".join(f"{e} as {c}" for c, e in columns.items())
    return f"select {body} from range({count}) r(id)".replace(" div ", " // ")
