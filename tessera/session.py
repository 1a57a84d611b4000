"""Session settings and the engine's front door."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.contract import Contract
from tessera.plans.registry import Registry

SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "tessera", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the engine's settings; ``settings`` use underscores for dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("_", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


class Engine:
    """SQL over a set of tables, under a contract, with a registry of the plans seen."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], contract: Contract | None = None):
        self.spark, self.tables = spark, tables
        self.contract, self.registry = contract or Contract(), Registry()

    def sql(self, text: str) -> DataFrame:
        """The result of a query the contract admits; the same text gives the same planned DataFrame."""
        return self.registry.get(text, lambda: self._run(text), self.tables)

    def _run(self, text: str) -> DataFrame:
        self.contract.check(self.spark, text, self.tables)
        before = {name: self.spark.table(name) for name in self.tables if self._is_view(name)}
        try:
            for name, df in self.tables.items():
                df.createOrReplaceTempView(name)
            return self.spark.sql(text)
        finally:  # the plan holds its tables; the caller's views of these names come back
            for name in self.tables:
                if name in before:
                    before[name].createOrReplaceTempView(name)
                else:
                    self.spark.catalog.dropTempView(name)

    def _is_view(self, name: str) -> bool:
        return self.spark._jsparkSession.sessionState().catalog().getTempView(name).isDefined()
