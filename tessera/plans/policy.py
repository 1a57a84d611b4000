"""Read-only access levels for SQL that comes from outside."""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import stats
from tessera.plans.contract import Contract, ContractError

if TYPE_CHECKING:
    from tessera.session import Engine

LEVELS = ("none", "stats", "full")
_ABOUT = re.compile(r"\s*(describe|desc|summarize)\s+(?:table\s+)?(\w+)\s*;?\s*", re.IGNORECASE)
_AGGREGATE = re.compile(r"(?:^|[^\w])'?(?:count|sum|avg|mean|min|max|approx_count_distinct|count_if|stddev|variance)\(", re.IGNORECASE)


class PolicyError(PermissionError):
    """SQL beyond the level granted."""


def _listed(plan) -> list[str]:
    """Text of each output of the topmost select list; a star counts as an output."""
    name = plan.getClass().getSimpleName()
    found = plan.aggregateExpressions() if name == "Aggregate" else plan.projectList() if name == "Project" else None
    return [] if found is None else [str(found.apply(i).toString()) for i in range(found.size())]


def admit(spark: SparkSession, text: str, level: str, tables: Iterable[str] | None = None) -> str:
    """The text, if the level allows it.

    ``none`` admits nothing; ``stats`` DESCRIBE and SUMMARIZE of a table, and queries that aggregate: each output is an aggregate, or a grouping
    key beside at least one of them, so the values of keys leave, and no rows as they are; ``full`` any single read-only query.
    """
    if level not in LEVELS:
        raise PolicyError(f"unknown level {level!r}")
    if level == "none":
        raise PolicyError("SQL is not admitted")
    if about := _ABOUT.fullmatch(text or ""):
        if tables is not None and about[2].lower() not in {t.lower() for t in tables}:
            raise PolicyError(f"{about[2]} is not a table of the engine")
        return text
    try:
        Contract(theta_joins=True, regex=True).check(spark, text, tables)
    except ContractError as e:
        raise PolicyError(str(e)) from e
    if level == "stats":
        top = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
        while top.getClass().getSimpleName() in ("Sort", "GlobalLimit", "LocalLimit", "Offset", "UnresolvedHaving", "UnresolvedWith"):
            top = top.children().apply(0) if top.children().size() else top.child()
        outputs = [_AGGREGATE.search(x) is not None and "windowspec" not in x.lower() for x in _listed(top)]
        grouped = top.getClass().getSimpleName() == "Aggregate"
        if not outputs or not (any(outputs) if grouped else all(outputs)):
            raise PolicyError("only aggregated results are admitted at level 'stats'")
    return text


def run(engine: Engine, text: str, level: str) -> DataFrame:
    """The result of an admitted text: of DESCRIBE the columns and types, of SUMMARIZE the statistics bundle, else of the query."""
    admit(engine.spark, text, level, engine.tables)
    if about := _ABOUT.fullmatch(text):
        df = next(df for name, df in engine.tables.items() if name.lower() == about[2].lower())
        if about[1].lower() == "summarize":
            return stats.bundle(df, tuple(df.columns))
        return engine.spark.createDataFrame(df.dtypes, "column_name string, data_type string")
    return engine.sql(text)
