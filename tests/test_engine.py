import os
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.operators import joins, stats
from tessera.plans import inspect
from tessera.session import Engine
from tessera.sources import files, generated, star
from tessera.streaming import chunks

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fixtures(spark):
    table = lambda ddl, *rows: spark.createDataFrame(list(rows), ddl)
    return {
        "a": table("id int, v bigint", (1, 10), (2, 20), (3, 30)),
        "b": table("id int, k int", (2, 1), (4, 2)),
        "g": table("a bigint, b int", (1, 2), (3, 4), (5, 6)),
        "w": table("value bigint, cat int", (10, 1), (20, 1), (30, 2)),
        "s": table("name string, value bigint, active boolean", ("foo_bar", 10, True), ("FOOxBAR", 5, False), (None, None, None)),
    }


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("select sum(v) as x from a full join b on a.id = b.id", [(60,)]),
        ("select sum(k) as x from a left join b on a.id = b.id", [(1,)]),
        ("select count(*) as x from a cross join b", [(6,)]),
        ("select a.id as x from a semi join b on a.id = b.id", [(2,)]),
        ("select a.id as x from a anti join b on a.id = b.id", [(1,), (3,)]),
        ("select sum(t) as x from (select a, sum(a) as t from g group by a) as d", [(9,)]),
        ("select sum(value) over (partition by cat) as x from w", [(30,), (30,), (30,)]),
        ("select a as x from g where a > 1 except select a from g where a > 4", [(3,)]),
        ("select a as x from g intersect select b from g", []),
        ("select sum(v) as x from a where id > 9", [(None,)]),
        ("select avg(v) as x from a where id > 9", [(None,)]),
        ("select max(case when id = 9 then v end) as x from a", [(None,)]),
        ("select count(name) as x from s", [(2,)]),
        ("select value as x from s where name ilike 'foo_bar'", [(5,), (10,)]),
        ("select value as x from s where name like 'foo%'", [(10,)]),
        ("select value as x from s where active", [(10,)]),
        ("select id as x from a where id not in (select case when id = 4 then null else id end from b)", []),
        ("select (select max(v) from a) as x from b", [(30,), (30,)]),
        ("select sum(abs(v - 25)) as x from a", [(25,)]),
        ("select 7 / 2 as x", [(3.5,)]),
    ],
)
def test_sql_semantics(spark, fixtures, text, want):
    got = [tuple(r) for r in Engine(spark, fixtures).sql(text).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_recursion_stops_with_an_error(spark, fixtures):
    engine = Engine(spark, fixtures)
    with pytest.raises(Exception, match="RECURSION_LEVEL_LIMIT_EXCEEDED"):
        engine.sql("with recursive r(n) as (select 1 union all select n from r where n < 3) select n from r").collect()


def test_overflow_is_an_error(spark, fixtures):
    with pytest.raises(PySparkException):
        Engine(spark, fixtures).sql("select sum(v * 922337203685477580) as x from a").collect()


def test_registry_keeps_plans(spark, fixtures):
    engine = Engine(spark, fixtures)
    assert engine.sql("select id from a") is engine.sql("SELECT id\nFROM a")


def test_scalar_functions(spark):
    df = spark.sql("select * from values (7, 2, 'ab'), (-7, 2, 'a_'), (7, 0, 'b') as t(x, y, s)")
    got = df.select(scalar.int_div(F.col("x"), F.col("y")).alias("q"), scalar.case_or_zero((F.col("x") > 0, F.lit(1))).alias("c")).collect()
    assert [tuple(r) for r in got] == [(3, 1), (-3, 0), (None, 1)]
    for pattern, want in (("a%", 2), ("%b", 2), ("%a%", 2), ("ab", 1), ("a_", 2), ("%", 3), ("b%b", 0)):
        assert df.filter(scalar.like(F.col("s"), pattern)).count() == want, pattern
    assert df.filter("x > 99").agg(scalar.zero_if_empty(F.sum("x")).alias("t")).first().t == 0


def test_whole_quotients_are_exact(spark):
    df = spark.sql("select * from values (9007199254740995L, 1L), (-9223372036854775807L, 1L), (9223372036854775807L, -2L), (null, 3L) as t(a, b)")
    assert [r.q for r in df.select(scalar.int_div(F.col("a"), F.col("b")).alias("q")).collect()] == [9007199254740995, -9223372036854775807, -4611686018427387903, None]


def test_equal_rows_of_a_hot_key_are_spread(spark):
    left = spark.range(1000).selectExpr("1 as k", "map('a', 1) as m")
    assert joins.salted(left, spark.createDataFrame([(1,)], "j int"), {"k": "j"}, 4).count() == 1000


def test_star_queries_prune_their_scan(spark):
    from tessera import catalog

    for name in ("ssb_1", "h21", "h23"):
        pushed = inspect.pushed_filters(catalog.queries()[name](spark, DATA))
        assert any("lo_orderdate" in f and "lo_discount" in f for f in pushed)
        assert "BroadcastHashJoin" not in inspect.operators(catalog.queries()[name](spark, DATA))
    assert any("event_date" in f for f in inspect.pushed_filters(catalog.queries()["h1"](spark, DATA)))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    left = spark.range(500).selectExpr("id", "if(id % 3 = 0, 7, id % 40) as k")
    right = spark.range(30).selectExpr("id as k2", "id * 2 as w")
    plain = left.join(right, F.expr("k = k2"), how)
    salted = joins.salted(left, right, {"k": "k2"}, 5, how)
    assert sorted(map(tuple, plain.collect()), key=repr) == sorted(map(tuple, salted.collect()), key=repr)


def test_count_over_join_equals_the_join(spark):
    rng = random.Random(6)
    left = spark.createDataFrame([(rng.choice([1, 1, 1, 2, 3, None]), rng.choice(["a", "b", None])) for _ in range(300)], "k int, kind string")
    right = spark.createDataFrame([(rng.choice([1, 1, 2, 4, None]),) for _ in range(200)], "j int")
    want = left.join(right, F.expr("k = j")).groupBy("kind").agg(F.count("*").alias("n"))
    got = joins.count_over_join(left, right, {"k": "j"}, ("kind",))
    assert got.dtypes == want.dtypes
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_skewed_join_repeats_and_broadcasts_nothing(spark):
    from tessera import catalog

    plan = inspect.physical(catalog.queries()["skewed_join"](spark, DATA))
    assert "Generate" not in plan and "Broadcast" not in plan


def test_coded_join_equals_plain_join(spark):
    left = spark.sql("select id as v, case when id % 7 = 0 then null else id % 50 - 10 end as k from range(600) union all select -1, 9223372036854775807")
    right = spark.sql("select id % 45 - 12 as j, case when id % 3 > 0 then concat('w', id % 3) end as word, cast(id % 2 as int) as two from range(60) union all select null, 'n', 1 union all select 9223372036854775807, 'far', 0")
    plain = left.join(right, F.expr("k = j")).select("v", "k", "word", "two")
    met, kinds = joins.coded(left, right, {"k": "j"}, "__number")
    assert kinds.count() == 7
    assert sorted(map(tuple, met.join(kinds, "__number").select("v", "k", "word", "two").collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
    assert "hashpartitioning(k" not in inspect.physical(met)
    met, kinds = joins.coded(left, right.filter("two > 5"), {"k": "j"}, "__number")
    assert met.join(kinds, "__number").count() == 0
    assert joins.coded(left, right, {"k": "j"}, "__number", most_mb=0) is None
    assert joins.coded(left, right, {"k": "j"}, "__number", most_kinds=6) is None
    assert joins.coded(left.withColumn("k", F.col("k").cast("string")), right, {"k": "j"}, "__number") is None


def _star_tables(spark):
    t = {n: spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    t["supplier"] = t["supplier"].filter("s_suppkey <> 3").union(t["supplier"].filter("s_suppkey = 4"))
    t["part"] = t["part"].filter("p_partkey % 10 > 0").union(t["part"].filter("p_partkey = 7"))
    return t


def test_star_is_the_same_by_codes_and_by_shuffles(spark):
    import duckdb

    t = _star_tables(spark)
    con = duckdb.connect()
    for name, df in t.items():
        con.register(name, df.toArrow())
    want = con.sql(f"select count(*), sum(lo_revenue), min(c_city), count(distinct s_city), sum(p_size), sum(d_weeknuminyear), max(p_mfgr) from ({star.FLAT_SQL})").fetchall()[0]
    for most_mb in (64, 0):
        got = star.flat(t, most_mb).selectExpr("count(*)", "sum(lo_revenue)", "min(c_city)", "count(distinct s_city)", "sum(p_size)", "sum(d_weeknuminyear)", "max(p_mfgr)").first()
        assert tuple(got) == want


def test_star_shuffles_lines_once(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4k")
    try:
        plan = inspect.physical(star.flat(_star_tables(spark)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("hashpartitioning(l_") == plan.count("hashpartitioning(l_orderkey") == 1
    assert plan.count("hashpartitioning(o_") == plan.count("hashpartitioning(o_orderkey") == 1


@pytest.mark.parametrize("name", ["h23", "ssb_4", "ssb_10"])
def test_star_queries_read_no_derived_column(spark, name):
    from tessera import catalog

    (read,) = inspect.read_columns(catalog.queries()[name](spark, DATA))
    assert {"lo_extendedprice", "lo_discount"} <= set(read) and "lo_revenue" not in read


def test_stored_star_is_narrow_and_by_date(spark):
    t = _star_tables(spark)
    df = star.stored(spark, "a name of its own", t)
    assert df.columns == list(star.FLAT)
    assert files.checksum(df).first() == files.checksum(star.flat(t)).first()
    assert not {"lo_revenue", "lo_supplycost"} & {c for cols in inspect.read_columns(df) for c in cols}
    for path in df.inputFiles():
        days = [r.lo_orderdate for r in spark.read.parquet(path).select("lo_orderdate").coalesce(1).collect()]
        assert days == sorted(days)


def test_sum_over_join_equals_the_join(spark):
    rng = random.Random(5)
    left = spark.createDataFrame([(rng.choice([1, 1, 1, 2, 3, None]), rng.randrange(9)) for _ in range(300)], "k int, v int")
    right = spark.createDataFrame([(rng.choice([1, 1, 2, 4, None]),) for _ in range(200)], "j int")
    want = left.join(right, F.expr("k = j")).agg(F.sum("v").alias("t")).first().t
    assert joins.sum_over_join(left, right, {"k": "j"}, "v").first().total == want


def test_statistics(spark):
    df = spark.createDataFrame([(i % 10, None if i % 4 == 0 else f"v{i}") for i in range(100)], "n int, s string")
    by = {r.column_name: r for r in stats.bundle(df, ("n", "s")).collect()}
    assert (by["n"].row_count, by["n"].low, by["n"].high, by["s"].null_count, by["s"].max_length) == (100, "0", "9", 25, 3)
    assert {r.column_name: r.distinct_count for r in stats.distinct_counts(df, ("n", "s")).collect()} == {"n": 10, "s": 75}
    assert sorted(map(tuple, stats.histogram(df, "n", 5).collect())) == [(i, 20) for i in range(5)]
    assert stats.histogram(df.filter("n = 3"), "n", 5).collect()[0].bin == 0
    assert stats.histogram(df.filter("n > 50"), "n", 5).count() == 0


def test_distinct_counts_are_exact_at_any_size(spark):
    df = spark.range(30_000).selectExpr("id as many", "id % 3 as few")
    assert {tuple(r) for r in stats.distinct_counts(df, ("many", "few")).collect()} == {("many", 30_000), ("few", 3)}


@pytest.mark.parametrize("values", [0, 1, 4095, 4097, 9000])
def test_distinct_counts_know_no_switch(spark, values):
    df = spark.range(2 * values).selectExpr(f"if(id < {values}, id, null) as some", f"cast(id % {max(values, 1)} as string) as word")
    got = stats.distinct_counts(df, ("some", "word"))
    assert {tuple(r) for r in got.collect()} == {("some", values), ("word", values)}
    assert "approx" not in inspect.physical(got)


def test_filters_and_columns_reach_the_scan(spark):
    from tessera import catalog

    df = catalog.queries()["tpch_q6"](spark, DATA)
    assert any("l_shipdate" in f and "l_quantity" in f for f in inspect.pushed_filters(df))
    assert {c for cols in inspect.read_columns(df) for c in cols} == {"l_quantity", "l_extendedprice", "l_discount", "l_shipdate"}
    assert "SortMergeJoin" not in inspect.operators(catalog.queries()["join_nway3"](spark, DATA))


def test_delimited_files(spark, tmp_path):
    path = str(tmp_path / "t.tbl")
    with open(path, "w") as f:
        f.write('VALUE|NAME|EXTRA\n10|"a b"|1\n|c|2\n-3||3\n')
    schema = files.schema_of("name string, value bigint")
    got = files.read_delimited(spark, path, schema).collect()
    assert {tuple(r) for r in got} == {("a b", 10), ("c", None), (None, -3)}
    assert files.read_delimited(spark, path, schema, ("value",), 2).columns == ["value"]
    with pytest.raises(ValueError):
        files.read_delimited(spark, path, files.schema_of("absent int"))
    files.write_delimited(spark.createDataFrame([(1, "x"), (2, None)], "a int, b string"), str(tmp_path / "out"))
    back = files.load(spark, str(tmp_path / "out"), "delimited", files.schema_of("a int, b string"))
    assert {tuple(r) for r in back.collect()} == {(1, "x"), (2, None)}


def test_clustered_parquet_and_checksum(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "id % 7 as k")
    files.write_clustered(df, str(tmp_path / "c"), by=("id",), files=4)
    back = files.load(spark, str(tmp_path / "c"), "columnar")
    assert files.checksum(back).first() == files.checksum(df).first()
    assert files.checksum(df.filter("id > 5")).first() != files.checksum(df).first()
    pinned = files.pin(back)
    assert pinned.storageLevel.useMemory
    files.unpin(pinned)
    assert files.catalog({"c": back}, {"c": ("id",)}).filter("is_key").count() == 1


def test_filings_loader(spark, tmp_path):
    for q, label in (("q1", "old"), ("q2", "new")):
        os.makedirs(tmp_path / q)
        (tmp_path / q / "sub.txt").write_text(f"adsh\tcik\tname\tfy\n{q}\t1\tN\t2022\n")
        (tmp_path / q / "num.txt").write_text(f"adsh\ttag\tversion\tvalue\n{q}\tA\tv\t1.5\n{q}\tA\tv\t\n")
        (tmp_path / q / "tag.txt").write_text(f"tag\tversion\tcustom\ttlabel\nA\tv\t0\t{label}\n")
        (tmp_path / q / "pre.txt").write_text(f"adsh\ttag\tversion\tstmt\tline\n{q}\tA\tv\tBS\t3\n")
    t = files.read_filings(spark, [str(tmp_path / "q1"), str(tmp_path / "q2")])
    assert (t["num"].count(), t["sub"].count(), t["pre"].count()) == (2, 2, 2)
    assert [r.tlabel for r in t["tag"].collect()] == ["new"]
    files.write_ground_truth(t["num"].select("adsh", "value", "uom").orderBy("adsh"), str(tmp_path / "out"))
    lines = next((tmp_path / "out").glob("part-*.csv")).read_text().splitlines()
    assert lines == ["adsh,value,uom", "q1,1.50,", "q2,1.50,"]


def test_normalised_star(spark):
    df = star.normalised(spark.read.parquet(f"{DATA}/orders.parquet").limit(3))
    assert dict(df.dtypes)["o_totalprice"] == "bigint" and dict(df.dtypes)["o_orderdate"] == "int"


def test_chunk_scans(spark):
    df = generated.table(spark, "scan_skew", 10_000)
    want = df.filter("event_date between 19900101 and 19901231").agg(F.sum("amount")).first()[0]
    assert chunks.range_sum(df, "event_date", 19900101, 19901231, "amount").first().total == want

    def fold(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pc.sum(b.column(0)).as_py() or 0])], ["part"])

    got = chunks.scan(df, fold, "part long", ("amount",), F.col("event_date").between(19900101, 19901231)).agg(F.sum("part")).first()[0]
    assert got == want
    assert [len(c) for c in chunks.chunks(df.select("amount").limit(20), 8)] == [8, 8, 4]


def test_incremental_counts(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:0{m}:00", "a" if m % 2 else "b") for h in range(3) for m in range(4)]
    spark.createDataFrame(rows, "ts string, kind string").selectExpr("cast(ts as timestamp) ts", "kind").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, kind string").parquet(str(tmp_path / "in"))
    query = chunks.incremental(stream, "ts", ("kind",)).writeStream.outputMode("append").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.sql("select window_start, kind, n from counts").collect()
    assert sorted((r.kind, r.n) for r in got) == [("a", 2), ("b", 2)]
