"""Declarative query shapes: one description, rendered as a DataFrame or as SQL text.

Predicates, keys and aggregates are SQL expressions that mean the same in Spark and in ANSI SQL engines.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_AGGREGATE = re.compile(r"\b(sum|count|avg|min|max)\s*\(", re.IGNORECASE)


@dataclass(frozen=True)
class Shape:
    """Scan, joins, filter, grouping, having, order, limit; ``tables`` is {alias: name} in join order."""

    tables: dict[str, str]
    select: dict[str, str]
    on: dict[str, str] = field(default_factory=dict)
    how: dict[str, str] = field(default_factory=dict)
    where: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()
    having: str = ""
    order: tuple[str, ...] = ()
    limit: int = 0

    def dataframe(self, tables: dict[str, DataFrame]) -> DataFrame:
        names = iter(self.tables.items())
        alias, name = next(names)
        df = tables[name].alias(alias)
        for alias, name in names:
            df = df.join(tables[name].alias(alias), F.expr(self.on[alias]), self.how.get(alias, "inner").replace(" ", "_"))
        for predicate in self.where:
            df = df.filter(F.expr(predicate))
        columns = [F.expr(e).alias(a) for a, e in self.select.items()]
        if self.keys or all(_AGGREGATE.search(e) for e in self.select.values()):
            grouped = [F.expr(self.select[k]).alias(k) for k in self.keys]
            df = df.groupBy(*grouped).agg(*[c for a, c in zip(self.select, columns) if a not in self.keys])
            if self.having:
                df = df.filter(F.expr(self.having))
            df = df.select(*self.select)
        else:
            df = df.select(*columns)
        if self.order:
            df = df.orderBy(*(F.desc_nulls_last(o[1:]) if o[0] == "-" else F.asc_nulls_last(o) for o in self.order))
        return df.limit(self.limit) if self.limit else df

    def sql(self, sources: dict[str, str]) -> str:
        """The query as text; ``sources`` are definitions put in front as common table expressions."""
        (alias, name), *rest = self.tables.items()
        joins = "".join(f" {self.how.get(a, 'inner').removeprefix('left ') if ' ' in self.how.get(a, '') else self.how.get(a, 'inner')} join {t} {a} on {self.on[a]}" for a, t in rest)
        body = ", ".join(f"{e} as {a}" for a, e in self.select.items())
        text = f"select {body} from {name} {alias}{joins}"
        if self.where:
            text += " where " + " and ".join(f"({p})" for p in self.where)
        if self.keys:
            text += " group by " + ", ".join(self.select[k] for k in self.keys)
        if self.having:
            text = f"select * from ({text}) as grouped where {self.having}"
        if self.order:
            text += " order by " + ", ".join(f"{o[1:]} desc nulls last" if o[0] == "-" else f"{o} asc nulls last" for o in self.order)
        if self.limit:
            text += f" limit {self.limit}"
        needed = [n for n in dict.fromkeys(self.tables.values()) if n in sources]
        return ("with " + ", ".join(f"{n} as ({sources[n]})" for n in needed) + " " if needed else "") + text
