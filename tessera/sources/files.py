"""File sources and sinks: headed pipe-delimited tables, tab-separated filings, clustered Parquet with statistics."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOAD_FORMATS = ("delimited", "columnar")


def schema_of(ddl: str) -> T.StructType:
    """A schema from DDL text; column names are matched without regard to case."""
    return T.StructType.fromDDL(ddl)


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, columns: tuple[str, ...] = (), limit: int = 0) -> DataFrame:
    """A headed ``|`` file: the columns named in ``schema``, in any order of the file, typed; optionally some of them and so many rows.

    Missing cells are null. A cell that doesn't fit its type is an error.
    """
    header = spark.read.option("sep", "|").option("header", True).option("quote", '"').csv(path, enforceSchema=False)
    by_name = {c.strip().lower(): c for c in header.columns}
    wanted = [f for f in schema.fields if not columns or f.name.lower() in {c.lower() for c in columns}]
    missing = [f.name for f in wanted if f.name.lower() not in by_name]
    if missing:
        raise ValueError(f"{path} has no columns {missing}")
    cell = lambda f: F.trim(F.col(f"`{by_name[f.name.lower()]}`"))
    df = header.select(*(cell(f).cast(f.dataType).alias(f.name) for f in wanted))
    return df.limit(limit) if limit else df


def write_delimited(df: DataFrame, path: str) -> None:
    """``df`` as headed ``|`` files, column names in upper case; null is an empty cell."""
    df.toDF(*(c.upper() for c in df.columns)).write.mode("overwrite").option("sep", "|").option("header", True).option("nullValue", "").csv(path)


def write_clustered(df: DataFrame, path: str, by: tuple[str, ...] = (), partition_by: tuple[str, ...] = (), files: int = 0) -> None:
    """Parquet laid out for pruning: range-partitioned and sorted by ``by``, so row groups have narrow min-max statistics."""
    if by:
        df = (df.repartitionByRange(files, *by) if files else df.repartitionByRange(*by)).sortWithinPartitions(*by)
    elif files:
        df = df.repartition(files)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def load(spark: SparkSession, path: str, kind: str, schema: T.StructType | None = None) -> DataFrame:
    """A table in one of ``LOAD_FORMATS``."""
    if kind not in LOAD_FORMATS:
        raise ValueError(f"unknown load format {kind!r}")
    if kind == "columnar":
        return spark.read.parquet(path)
    if schema is None:
        raise ValueError("a delimited table needs a schema")
    return read_delimited(spark, path, schema)


def checksum(df: DataFrame) -> DataFrame:
    """(rows, checksum): independent of row order and partitioning, over all columns in their order."""
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("checksum"))


def pin(df: DataFrame) -> DataFrame:
    """``df`` kept in executors' memory, spilling to their disks, until ``unpin``."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def unpin(df: DataFrame) -> DataFrame:
    return df.unpersist()


def catalog(tables: dict[str, DataFrame], primary_keys: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(table_name, column_name, data_type, is_key) of the tables."""
    keys = primary_keys or {}
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, c, kind, c in keys.get(t, ())) for t, df in tables.items() for c, kind in df.dtypes]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, is_key boolean")


FILINGS = {
    "sub": "adsh string, cik bigint, name string, sic int, countryba string, stprba string, form string, period int, fy int, fp string, filed int",
    "num": "adsh string, tag string, version string, ddate int, qtrs int, uom string, coreg string, value double, footnote string",
    "tag": "tag string, version string, custom int, abstract int, datatype string, iord string, crdr string, tlabel string, doc string",
    "pre": "adsh string, report int, line int, stmt string, inpth int, rfile string, tag string, version string, plabel string, negating int",
}


def read_filings(spark: SparkSession, quarters: list[str]) -> dict[str, DataFrame]:
    """The four filing tables of several quarterly folders of tab-separated files.

    A tag defined in several quarters keeps its definition from the latest folder; facts without a value are dropped.
    """
    out = {}
    for name, ddl in FILINGS.items():
        parts = None
        for order, folder in enumerate(quarters):
            raw = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(f"{folder}/{name}.txt")
            have = {c.lower(): c for c in raw.columns}
            typed = [(F.col(have[f.name]) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema_of(ddl).fields]
            part = raw.select(*typed, F.lit(order).alias("__quarter"))
            parts = part if parts is None else parts.unionByName(part)
        if name == "tag":
            latest = Window.partitionBy("tag", "version").orderBy(F.desc("__quarter"), "tlabel", "doc")
            parts = parts.withColumn("__place", F.row_number().over(latest)).filter("__place = 1").drop("__place")
        if name == "num":
            parts = parts.filter("value is not null")
        out[name] = parts.drop("__quarter")
    return out


def write_ground_truth(df: DataFrame, path: str, digits: int = 2) -> None:
    """``df`` as one headed CSV file: doubles with fixed digits, null as an empty cell. For results, which are small."""
    shown = [F.format_string(f"%.{digits}f", c).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes]
    nulls = [F.when(F.col(c).isNull(), None).otherwise(x).alias(c) for x, c in zip(shown, df.columns)]
    df.select(*nulls).coalesce(1).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)
