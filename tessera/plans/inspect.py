"""What a physical plan does: filters and columns that reach the scan, joins and exchanges."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame


def physical(df: DataFrame) -> str:
    """The physical plan as text, with its scans' details whole."""
    conf, name = df.sparkSession.conf, "spark.sql.maxMetadataStringLength"
    before = conf.get(name)
    conf.set(name, "10000")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        conf.set(name, before)


def pushed_filters(df: DataFrame) -> list[str]:
    """The filters each file scan applies, as text."""
    return re.findall(r"PushedFilters: \[(.*?)\], ", physical(df))


def read_columns(df: DataFrame) -> list[list[str]]:
    """The columns each file scan reads."""
    return [re.findall(r"(\w+):", s) for s in re.findall(r"ReadSchema: struct<(.*?)>", physical(df))]


def operators(df: DataFrame) -> Counter:
    """Physical operators by name."""
    return Counter(re.findall(r"(\w*(?:Join|Exchange|Aggregate|Window|Sort|TakeOrderedAndProject|Expand))\b", physical(df)))
