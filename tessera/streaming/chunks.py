"""Bounded chunk scans and incremental aggregation.

A chunk scan hands a table's rows to a function in Arrow batches, next to the data, without keeping them; filters and columns
given here reach the file scan. ``incremental`` runs the same aggregation as a stream over files as they arrive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scan(df: DataFrame, fold: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, columns: tuple[str, ...] = (), where: Column | None = None) -> DataFrame:
    """``fold`` applied to the batches of each partition; its output has ``schema``."""
    if where is not None:
        df = df.filter(where)
    return (df.select(*columns) if columns else df).mapInArrow(fold, schema)


def range_sum(df: DataFrame, key: str, low, high, value: str) -> DataFrame:
    """Sum of ``value`` where ``key`` lies in [low, high]: the filter is in the scan, partial sums are per partition."""
    return df.filter(F.col(key).between(low, high)).agg(F.sum(value).alias("total"))


def chunks(df: DataFrame, rows: int = 8192) -> Iterator[list]:
    """The rows of ``df`` in lists of ``rows`` on the driver, one partition at a time; for results that are to be streamed out."""
    held = []
    for row in df.toLocalIterator(prefetchPartitions=False):
        held.append(row)
        if len(held) == rows:
            yield held
            held = []
    if held:
        yield held


def incremental(stream: DataFrame, time: str, keys: tuple[str, ...], late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Counts per key and tumbling window of a stream, emitted once a window can no longer change."""
    by = [F.window(time, window).alias("window"), *keys]
    return stream.withWatermark(time, late).groupBy(*by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *keys, "n")
