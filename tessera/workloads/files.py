"""Sources and sinks as queries: a table is written in a format, read back and used, and must be what it was."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import files, generated, star, store
from tessera.streaming import chunks

PART = "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _delimited(spark: SparkSession, sf_dir: str) -> str:
    path = store.fresh(spark, "delimited")
    files.write_delimited(_read(spark, sf_dir, "part"), path)
    return path


def _columnar(spark: SparkSession, df: DataFrame, *by: str) -> str:
    path = store.fresh(spark, "columnar")
    files.write_clustered(df, path, by)
    return path


def delimited_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_delimited(spark, _delimited(spark, sf_dir), files.schema_of(PART))


def delimited_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.load(spark, _delimited(spark, sf_dir), "delimited", files.schema_of("P_SIZE int, p_name string")).groupBy(F.col("P_SIZE").alias("p_size")).agg(F.min("p_name").alias("first_name"))


def delimited_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_delimited(spark, _delimited(spark, sf_dir), files.schema_of(PART), ("p_partkey",), 7).agg(F.count("*").alias("n"), F.count_distinct("p_partkey").alias("parts"))


def columnar_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.load(spark, _columnar(spark, _read(spark, sf_dir, "supplier"), "s_nationkey"), "columnar")


def columnar_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _read(spark, sf_dir, "orders")
    a, b = files.checksum(df), files.checksum(files.load(spark, _columnar(spark, df, "o_custkey"), "columnar"))
    return a.crossJoin(b.toDF("rows_back", "checksum_back")).select("rows", (F.col("checksum") == F.col("checksum_back")).alias("same"))


def clustered_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(_columnar(spark, _read(spark, sf_dir, "orders"), "o_orderkey"))
    return df.filter(F.col("o_orderkey").between(1000, 4000)).select("o_orderkey", "o_custkey")


def chunk_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    def fold(batches):
        for batch in batches:
            counted = pc.value_counts(batch.column(0))
            yield pa.RecordBatch.from_arrays([counted.field(0), counted.field(1)], ["l_returnflag", "part"])

    return chunks.scan(_read(spark, sf_dir, "lineitem"), fold, "l_returnflag string, part long", ("l_returnflag",), F.col("l_quantity") < 20).groupBy("l_returnflag").agg(F.sum("part").alias("n"))


def chunk_range_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.range_sum(_read(spark, sf_dir, "lineitem"), "l_suppkey", 3, 9, "l_linenumber")


def pinned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = files.pin(_read(spark, sf_dir, "customer"))
    out = kept.groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    rows = out.collect()
    files.unpin(kept)
    return spark.createDataFrame(rows, out.schema)


def normalised_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(_columnar(spark, star.normalised(_read(spark, sf_dir, "orders"))))


def filings_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    folders = [store.fresh(spark, "quarter") for _ in range(2)]
    for order, folder in enumerate(folders):
        for name in files.FILINGS:
            df = generated.table(spark, name, 400 if name == "tag" else 3000)
            df = df.withColumn("tlabel", F.concat(F.lit(f"q{order} "), F.coalesce("tlabel", F.lit("")))) if name == "tag" else df
            df.write.option("sep", "\t").option("header", True).option("quote", "").csv(f"{folder}/{name}.txt")
    t = files.read_filings(spark, folders)
    labels = t["tag"].groupBy("tag").agg(F.max(F.substring("tlabel", 1, 2)).alias("quarter"), F.count("*").alias("versions"))
    return t["num"].groupBy("tag").agg(F.count("*").alias("facts"), F.sum("value").alias("total")).join(labels, "tag")


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.fresh(spark, "truth")
    files.write_ground_truth(_read(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.max("o_totalprice").alias("top"), F.max(F.when(F.col("o_orderstatus") == "F", 1)).alias("flag")), path)
    return spark.read.option("header", True).csv(path)


_FILINGS_SQL = "select {columns} from range({rows}) r(id)"


def _generated(name: str, rows: int) -> str:
    return _FILINGS_SQL.format(columns=", ".join(f"{e} as {c}" for c, e in generated.TABLES[name][1].items()), rows=rows).replace(" div ", " // ")


ORACLE = {
    "delimited_scan": "select * from part", "delimited_columns": "select p_size, min(p_name) as first_name from part group by p_size", "delimited_limit": "select least(count(*), 7) as n, least(count(*), 7) as parts from part",
    "columnar_round_trip": "select * from supplier", "columnar_checksum": "select count(*) as rows, true as same from orders", "clustered_band": "select o_orderkey, o_custkey from orders where o_orderkey between 1000 and 4000",
    "chunk_scan": "select l_returnflag, count(*) as n from lineitem where l_quantity < 20 group by l_returnflag", "chunk_range_sum": "select cast(sum(l_linenumber) as bigint) as total from lineitem where l_suppkey between 3 and 9",
    "pinned_scan": "select c_mktsegment, count(*) as n from customer group by c_mktsegment",
    "normalised_export": "select o_orderkey, o_custkey, o_orderstatus, cast(round(o_totalprice * 100) as bigint) as o_totalprice, cast(strftime(o_orderdate, '%Y%m%d') as int) as o_orderdate, o_orderpriority from orders",
    "filings_load": f"with n as ({_generated('num', 3000)}), t as (select distinct tag, version from ({_generated('tag', 400)}) as g) select tag, 2 * count(value) as facts, 2 * sum(value) as total, 'q1' as quarter,"
    " (select count(*) from t where t.tag = n.tag) as versions from n where value is not null and tag in (select tag from t) group by tag",
    "ground_truth": "select o_orderstatus, printf('%.2f', max(o_totalprice)) as top, case when o_orderstatus = 'F' then '1' end as flag from orders group by o_orderstatus",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in ORACLE}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
