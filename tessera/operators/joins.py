"""Join helpers for skew."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WHOLE = ("byte", "short", "integer", "long")


def salted(left: DataFrame, right: DataFrame, on: dict[str, str], salts: int = 16, how: str = "inner") -> DataFrame:
    """Equi-join that spreads every key of ``left``, equal rows too, over ``salts`` partitions and repeats ``right`` as often.

    For inner, left, left_semi and left_anti joins with hot keys on the left and a right side worth repeating; where AQE's
    skew join applies it is the better first choice.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a {how} join can't be salted on the left")
    a = left.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    b = right.withColumn("__other_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    condition = F.col("__salt") == F.col("__other_salt")
    for x, y in on.items():
        condition &= a[x] == b[y]
    return a.join(b, condition, how).drop("__salt", "__other_salt")


def sum_over_join(left: DataFrame, right: DataFrame, on: dict[str, str], value: str) -> DataFrame:
    """``sum(value)`` over an inner join without building it: each side is counted or summed per key first.

    Output of a join grows with the product of a key's multiplicities; here both sides shrink to one row per key before they meet.
    """
    keys = {f"__k{i}": pair for i, pair in enumerate(on.items())}
    sums = left.groupBy(*(F.col(a).alias(k) for k, (a, _) in keys.items())).agg(F.sum(value).alias("__sum"))
    counts = right.groupBy(*(F.col(b).alias(k) for k, (_, b) in keys.items())).agg(F.count("*").alias("__count"))
    return sums.join(counts, list(keys)).agg(F.sum(F.col("__sum") * F.col("__count")).alias("total"))


def count_over_join(left: DataFrame, right: DataFrame, on: dict[str, str], by: tuple[str, ...]) -> DataFrame:
    """(by, n): rows of an inner join per ``by``, columns of ``left``, without building it: a hot key shrinks to a row per ``by`` before it travels.

    Nothing is repeated, and nothing is broadcast because it is estimated to be small.
    """
    keys = {f"__k{i}": pair for i, pair in enumerate(on.items())}
    here = left.groupBy(*(F.col(a).alias(k) for k, (a, _) in keys.items()), *by).agg(F.count("*").alias("__here"))
    there = right.groupBy(*(F.col(b).alias(k) for k, (_, b) in keys.items())).agg(F.count("*").alias("__there"))
    return here.join(there.hint("merge"), list(keys)).groupBy(*by).agg(F.sum(F.col("__here") * F.col("__there")).alias("n"))


def coded(left: DataFrame, right: DataFrame, on: dict[str, str], name: str, most_mb: int = 64, most_kinds: int = 65_536) -> tuple[DataFrame, DataFrame] | None:
    """First half of an inner join with a table whose other columns have few combinations: ``left`` isn't shuffled and gains a number.

    Returns ``left`` with a column ``name``, and the combinations of ``right``'s other columns by that number: joining them, at the latest possible point, ends the
    join. What is broadcast is an array of numbers per 64 consecutive keys, about 5 bytes a key where keys are dense; a key that is there twice has a
    second array. None if the key isn't one whole number, if there are over ``most_kinds`` combinations, or if the arrays would exceed ``most_mb``.
    """
    (key, other), *more = on.items()
    if more or left.schema[key].dataType.typeName() not in _WHOLE or right.schema[other].dataType.typeName() not in _WHOLE:
        return None
    columns = [c for c in right.columns if c != other]
    chunk, place = lambda c: F.shiftright(F.col(c).cast("long"), 6), lambda c: F.col(c).cast("long").bitwiseAND(63).cast("int")
    right = right.filter(F.col(other).isNotNull())
    copies = right.groupBy(other).count().groupBy(chunk(other)).agg(F.max("count").alias("most"))
    if (copies.agg(F.sum("most")).first()[0] or 0) * 320 > most_mb << 20:
        return None
    rows = right.select(*columns).distinct().limit(most_kinds + 1).collect()
    if len(rows) > most_kinds:
        return None
    kinds = left.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rows)], T.StructType([T.StructField(name, T.IntegerType()), *right.select(*columns).schema.fields]))
    number = right.join(F.broadcast(kinds.toDF(name, *(f"__{c}" for c in columns))), F.expr(" and ".join(f"`{c}` <=> `__{c}`" for c in columns) or "true"))
    copy = F.row_number().over(Window.partitionBy(other).orderBy(name))
    arrays = number.select(chunk(other).alias("__chunk"), copy.alias("__copy"), F.struct(place(other), name).alias("__entry")).groupBy("__chunk", "__copy").agg(F.map_from_entries(F.collect_list("__entry")).alias("__map"))
    arrays = arrays.select("__chunk", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.try_element_at("__map", i)).alias("__numbers"))
    met = left.join(F.broadcast(arrays), chunk(key) == F.col("__chunk")).withColumn(name, F.get("__numbers", place(key)))
    return met.filter(F.col(name).isNotNull()).drop("__chunk", "__numbers"), kinds
