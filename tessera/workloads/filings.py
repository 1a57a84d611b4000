"""Filing queries with nested subqueries: the text runs in the engine over generated tables, and in the oracle over the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.session import Engine
from tessera.sources import generated

_TEXTS = {
    "edgar_q2": (
        "select c.name, f.tag, f.value from num f join sub c on c.adsh = f.adsh where f.uom = 'pure' and c.fy = 2022"
        " and f.value = (select max(g.value) from num g where g.adsh = f.adsh and g.tag = f.tag and g.uom = 'pure') order by f.value desc, c.name, f.tag limit 100"
    ),
    "edgar_q2_derived": (
        "select c.name, f.tag, f.value from num f join sub c on c.adsh = f.adsh join (select adsh, tag, max(value) as top from num where uom = 'pure' group by adsh, tag) as m"
        " on m.adsh = f.adsh and m.tag = f.tag and m.top = f.value where f.uom = 'pure' and c.fy = 2022 order by f.value desc, c.name, f.tag limit 100"
    ),
    "edgar_q3": (
        "with usd as (select c.name, c.cik, f.value from num f join sub c on c.adsh = f.adsh where f.uom = 'USD' and c.fy = 2022 and f.value is not null)"
        " select name, cik, cast(sum(value) as double) as total_value from usd group by name, cik"
        " having sum(value) > (select avg(per_company) from (select sum(value) as per_company from usd group by cik) as each) order by total_value desc, name limit 100"
    ),
    "edgar_t15": (
        "select f.tag, count(*) as usage_count, cast(sum(f.value) as double) as total from num f where f.uom = 'USD' and f.value is not null group by f.tag"
        " having count(*) > (select avg(often) from (select count(*) as often from num where uom = 'USD' group by tag) as counts) order by usage_count desc, f.tag limit 50"
    ),
    "edgar_t16": (
        "select c.adsh, c.name, c.cik, c.countryba, c.sic from sub c where c.form = '10-K' and c.cik in (select d.cik from sub d where d.form = '10-K' group by d.cik having count(*) > 1) order by c.name, c.adsh limit 100"
    ),
    "edgar_t17": (
        "select distinct f.tag, f.version, count(*) as cnt from num f where f.uom = 'shares' and f.value is not null"
        " and exists (select 1 from pre q where q.version = f.version and q.tag = f.tag and q.stmt = 'CF') group by f.tag, f.version order by cnt desc, f.tag, f.version limit 100"
    ),
    "edgar_t25": (
        "select c.cik, c.name, c.countryba, count(distinct c.form) as form_types, count(*) as total_filings from sub c where c.countryba = 'US'"
        " and c.cik in (select d.cik from sub d group by d.cik having count(distinct d.form) > 1) group by c.cik, c.name, c.countryba order by total_filings desc, c.cik, c.countryba limit 50"
    ),
    "edgar_t28": (
        "select f.tag, f.version, count(*) as cnt, cast(sum(f.value) as double) as total from num f where f.uom = 'shares' and f.ddate between 20220101 and 20231231 and f.value is not null"
        " and not exists (select 1 from pre q where q.adsh = f.adsh and q.tag = f.tag and q.version = f.version) group by f.tag, f.version having count(*) > 10 order by cnt desc, f.tag, f.version limit 100"
    ),
    "edgar_t29": (
        "select c.cik, c.name, count(distinct c.fy) as years_filed, min(c.fy) as first_year, max(c.fy) as last_year, count(*) as total_filings from sub c where c.form = '10-Q'"
        " group by c.cik, c.name having count(distinct c.fy) >= 2 order by total_filings desc, c.cik limit 100"
    ),
    "edgar_t30": (
        "select c.sic, count(*) as total_entries, cast(sum(case when f.value > 0 then f.value else 0 end) as double) as positive_total, cast(sum(case when f.value < 0 then f.value else 0 end) as double) as negative_total,"
        " cast(sum(case when f.value = 0 then 1 else 0 end) as bigint) as zero_count, count(distinct c.cik) as num_companies from num f join sub c on c.adsh = f.adsh where f.uom = 'USD' and c.fy = 2022"
        " and c.sic is not null and f.value is not null group by c.sic having count(*) > 100 order by positive_total desc, c.sic limit 50"
    ),
}
_TABLES = ("num", "sub", "tag", "pre")


def _run(spark: SparkSession, text: str) -> DataFrame:
    return Engine(spark, {n: generated.stored(spark, n) for n in _TABLES}).sql(text)


def queries():
    return {name: (lambda spark, _, text=text: _run(spark, text)) for name, text in _TEXTS.items()}


def oracle_sql() -> dict[str, str]:
    sources = ", ".join(f"{n} as ({generated.sql(n)})" for n in _TABLES)
    out = {}
    for name, text in _TEXTS.items():
        body = text.removeprefix("with ")
        out[name] = f"with {sources}" + (", " if text.startswith("with ") else " ") + body
    return out
