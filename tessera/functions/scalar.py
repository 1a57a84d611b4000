"""Scalar and aggregate expressions with a meaning of their own beside Spark's built-in functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(a: Column, b: Column) -> Column:
    """Integer quotient, cut towards zero; NULL when the divisor is 0."""
    return F.call_function("div", a, F.nullif(b.cast("long"), F.lit(0).cast("long")))


def avg_floor(c: Column) -> Column:
    """Whole part of the mean of integers; NULL for no rows."""
    return int_div(F.sum(c), F.count(c))


def like(c: Column, pattern: str) -> Column:
    """LIKE by the cheapest predicate: comparisons and prefixes reach the scan, an underscore needs the full matcher."""
    if re.search(r"[\\_]", pattern) or "%" in pattern.strip("%"):
        return c.like(pattern)
    body = pattern.strip("%")
    if "%" not in pattern:
        return c == body
    if pattern.startswith("%") and pattern.endswith("%"):
        return c.contains(body)
    return c.endswith(body) if pattern.startswith("%") else c.startswith(body)


def case_or_zero(*branches: tuple[Column, Column]) -> Column:
    """CASE whose missing ELSE is 0."""
    out = F
    for when, then in branches:
        out = out.when(when, then)
    return out.otherwise(0)


def zero_if_empty(aggregate: Column) -> Column:
    """An aggregate that is 0 where SQL gives NULL for no rows."""
    return F.coalesce(aggregate, F.lit(0))
