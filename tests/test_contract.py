import pytest

from tessera.plans import policy
from tessera.plans.contract import Contract, ContractError
from tessera.plans.policy import PolicyError, admit
from tessera.plans.registry import Registry, key
from tessera.session import Engine


@pytest.mark.parametrize(
    "text",
    [
        "select a, sum(b) from t where c between 1 and 3 group by a having sum(b) > 4 order by a limit 3",
        "select x from t left join u on t.k = u.k and t.j = u.j",
        "with c as (select 1 as x) select * from c union all select 2",
        "select row_number() over (partition by a order by b) from t",
        "select a from t where b in (select b from u) and exists (select 1 from v where v.a = t.a)",
    ],
)
def test_admits(spark, text):
    Contract().check(spark, text)


@pytest.mark.parametrize(
    "text",
    [
        "", "drop table t", "insert into t values (1)", "create table t (a int)", "select a from t where b rlike 'x'", "select regexp_extract(a, 'x') from t", "select * from t join u on t.a < u.a", "selec a",
        "select * from text.`/etc/hostname`", "select * from parquet.`/tmp/x`", "select * from other.t", "select * from explode(array(1, 2))", "select regexp_count(a, 'x') from t", "select split(a, 'x') from t", "select input_file_name() from t",
        "select java_method('java.lang.System', 'exit') from t", "select assert_true(false)", "select a from t where b in (select c from `a.b`.d)",
        "select a from t where b in (select c from u where d rlike 'x')", "with c as (select a from t where b rlike 'y') select * from c", "update t set a = 1", "select explode(a) from t",
    ],
)
def test_rejects(spark, text):
    with pytest.raises(ContractError):
        Contract().check(spark, text)


@pytest.mark.parametrize(
    ("flag", "text"),
    [
        ("windows", "select sum(a) over (order by b) from t"), ("ctes", "with c as (select 1) select * from c"), ("set_operations", "select 1 union select 2"), ("outer_joins", "select 1 from t full join u on t.a = u.a"),
        ("subqueries", "select a from t where a = (select max(a) from t)"), ("recursive_ctes", "with recursive r(n) as (select 1 union all select n + 1 from r where n < 3) select n from r"),
        ("pattern_match", "select a from t where b like 'x%'"), ("distinct", "select distinct a from t"), ("cross_joins", "select 1 from t cross join u"), ("joins", "select 1 from t join u on t.a = u.a"), ("having", "select a from t group by a having count(*) > 1"), ("order_limit", "select a from t order by a"),
        ("grouping", "select a, count(*) from t group by a"), ("semi_joins", "select 1 from t semi join u on t.a = u.a"),
    ],
)
def test_flags(spark, flag, text):
    Contract().check(spark, text)
    with pytest.raises(ContractError):
        Contract(**{flag: False}).check(spark, text)


def test_unknown_flag():
    with pytest.raises(ContractError):
        Contract(null_logic=True)


def test_registry_key():
    assert key("SELECT  a\nFROM t -- note\n where b = 'A'") == key("select a from t where b = 'A';")
    assert key("select a as A from t") != key("select a as a from t")
    assert key("select 'A'") != key("select 'a'")
    assert key("select 'a  b'") != key("select 'a b'")
    seen = Registry()
    assert seen.get("select 1", lambda: 7) == seen.get("SELECT 1", lambda: 8) == 7
    assert (seen.hits, seen.misses) == (1, 1)


def test_policy(spark):
    for level, text, good in (
        ("none", "select 1", False), ("stats", "select count(*) from t", True), ("stats", "select a, count(*) from t group by a", True), ("stats", "select a from t", False), ("full", "select a from t", True), ("full", "drop table t", False),
        ("other", "select 1", False), ("stats", "select a, b from t group by a, b", False), ("stats", "select * from t", False), ("stats", "select sum(a) over (order by b) from t", False), ("stats", "select max(a), b from t", False),
        ("stats", "select min(a), count(distinct b) from t where c > 3", True), ("stats", "DESCRIBE t", True), ("stats", "summarize t;", True), ("none", "describe t", False), ("stats", "describe t; drop table t", False),
    ):
        if good:
            assert admit(spark, text, level) == text
        else:
            with pytest.raises(PolicyError):
                admit(spark, text, level)


def test_only_the_engines_tables_are_read(spark):
    a = spark.createDataFrame([(1,), (2,)], "x int")
    spark.range(9).createOrReplaceTempView("outside")
    engine = Engine(spark, {"t": a})
    with pytest.raises(ContractError):
        engine.sql("select * from outside")
    assert engine.sql("with c as (select x from T) select count(*) as n from c").first().n == 2
    with pytest.raises(ContractError):
        engine.sql("select * from (with c as (select 1 as y) select * from c) as d, c")


def test_plans_follow_the_tables_and_views_stay(spark):
    spark.range(5).createOrReplaceTempView("t")
    engine = Engine(spark, {"t": spark.range(3), "u": spark.range(1)})
    assert engine.sql("select * from t").count() == 3
    engine.tables = {"t": spark.range(9), "u": spark.range(1)}
    assert engine.sql("select * from t").count() == 9
    assert engine.sql("select id as A from t").columns == ["A"] and engine.sql("select id as a from t").columns == ["a"]
    assert spark.table("t").count() == 5 and not spark.catalog.tableExists("u")
    spark.catalog.dropTempView("t")


def test_describe_and_summarize(spark):
    engine = Engine(spark, {"t": spark.createDataFrame([(1, None), (3, "ab")], "x int, s string")})
    assert [tuple(r) for r in policy.run(engine, "describe T", "stats").collect()] == [("x", "int"), ("s", "string")]
    assert {r.column_name: (r.low, r.null_count) for r in policy.run(engine, "SUMMARIZE t", "stats").collect()} == {"x": ("1", 0), "s": ("ab", 1)}
    assert policy.run(engine, "select max(x) as m from t", "stats").first().m == 3
    for text in ("select x from t", "describe outside"):
        with pytest.raises(policy.PolicyError):
            policy.run(engine, text, "stats")
