"""Every query of the engine by name, with the DuckDB SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.sources import generated, star
from tessera.workloads import core, filings, shapes
from tessera.workloads import files as files_


def _tables(spark: SparkSession, sf_dir: str, names: set[str]) -> dict[str, DataFrame]:
    """The tables of a shape: stored ones, generated ones, and the flattened star."""
    if "lineorder_flat" in names:
        return {"lineorder_flat": star.stored(spark, sf_dir, core.load(spark, sf_dir))}
    return {n: generated.stored(spark, n) if n in generated.TABLES else spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = {name: (lambda spark, d, s=shape: s.dataframe(_tables(spark, d, set(s.tables.values())))) for name, shape in shapes.all_shapes().items()}
    return core.queries() | made | filings.queries() | files_.queries()


def oracle_sql() -> dict[str, str]:
    sources = {n: generated.sql(n) for n in generated.TABLES} | {"lineorder_flat": star.FLAT_SQL}
    return core.oracle_sql() | {name: shape.sql(sources) for name, shape in shapes.all_shapes().items()} | filings.oracle_sql() | files_.oracle_sql()
