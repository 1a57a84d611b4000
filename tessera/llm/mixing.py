"""Operator 10: mixing sources to target weights by iterative proportional fitting.

Tokens are counted over all documents by source, language and topic. The cells'
weights are raked in turn to the target shares of the three marginals, and after each
turn no cell may exceed what it holds (its tokens over the budget), so the
fitted weights can be sampled without repeating a document. A document stays with
the probability (budget x weight / tokens) of its cell, by a hash of its ``doc_id``.

A target is a dictionary of shares, or by default the token shares raised to ``temper`` and
normalised, which lifts small sources. ``fraction`` of all tokens is the budget.

Cells are few beside documents: up to ``local_cells`` of them are raked in numpy on the
driver, more by window aggregates in Spark with stored rounds; both give the same weights and the same errors.

Tokens are counted with the ``tokenizer`` (a file of ranks, read where tasks run) on whole texts. Without one, a token stands for
four UTF-8 bytes, rounded up: a unit that SQL can count too, but not a token of any vocabulary.

Defined results: nulls in source, lang and topic are the value ''; a document has 1 token at least, also when the text is null or empty;
values without a target get no weight; a key with targets of which none occurs in the table, or that are negative or not finite, is a ValueError;
repeated ``doc_id``s are drawn alike, a null ``doc_id`` is drawn by its text.
A column ``topic`` in the input is used if there is one, else topics come from marks in the text; other columns, whatever their names, are passed
through. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._bpe import count_column
from tessera.llm._shared import stored

KEYS = ("source", "lang", "topic")
TEMPER = 0.7
FRACTION = 0.5
ROUNDS = 12
LOCAL_CELLS = 50_000


def topic_of(text: Column) -> Column:
    """Topic by marks in the text: legal lines, contact data, links, listings, else prose."""
    low = F.lower(text)
    return (
        F.when(low.contains("license") | low.contains("copyright"), "legal")
        .when(low.contains("@"), "contact")
        .when(low.contains("http"), "web")
        .when(low.rlike("[0-9]{4}"), "figures")
        .otherwise("prose")
    )


def _checked(targets: dict[str, dict[str, float]] | None) -> dict[str, dict[str, float]]:
    targets = targets or {}
    for key, shares in targets.items():
        if key not in KEYS:
            raise ValueError(f"no marginal {key!r}")
        if not all(np.isfinite(x) and x >= 0 for x in shares.values()):
            raise ValueError(f"shares of {key} must be finite and not negative")
    return targets


def _unmet(key: str) -> ValueError:
    return ValueError(f"none of the targets for {key} occurs in the table")


def _keyed(docs: DataFrame) -> list[Column]:
    """The cell of a document and its draw."""
    text = F.coalesce(F.col("text"), F.lit(""))
    topic = F.col("topic").cast("string") if "topic" in docs.columns else topic_of(text)
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), text).cast("binary"))
    cell = {"source": F.col("source").cast("string"), "lang": F.col("lang").cast("string"), "topic": topic}
    return [*(F.coalesce(c, F.lit("")).alias(k) for k, c in cell.items()), (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / float(1 << 52)).alias("draw")]


def _counted(docs: DataFrame, tokenizer: str | None) -> DataFrame:
    """(doc_id, source, lang, topic, draw, n_tokens) of every document."""
    if tokenizer is None:
        estimate = F.greatest(F.lit(1), F.ceil(F.octet_length(F.coalesce("text", F.lit(""))) / 4)).cast("long")
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_keyed(docs), estimate.alias("n_tokens"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], np.maximum(1, count_column(tokenizer, batch.column(batch.num_columns - 1)))], ["doc_id", *KEYS, "draw", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_keyed(docs), "text").mapInArrow(run, "doc_id long, source string, lang string, topic string, draw double, n_tokens long")


def rake(names: list[np.ndarray], tokens: np.ndarray, targets: dict[str, dict[str, float]], temper: float, fraction: float, rounds: int) -> np.ndarray:
    """Sampling probability of each cell."""
    total = tokens.sum()
    budget = fraction * total
    weight, room = tokens / total, tokens / budget
    goals = []
    for key, name in zip(KEYS, names):
        values, of = np.unique(name.astype(str), return_inverse=True)
        share = np.array([targets[key].get(v, 0.0) for v in values]) if key in targets else (np.bincount(of, tokens) / total) ** temper
        if share.sum() == 0:
            raise _unmet(key)
        goals.append((of, share / share.sum()))
    for _ in range(rounds):
        for of, goal in goals:
            now = np.bincount(of, weight)
            weight = np.minimum(weight * np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)[of], room)
    return np.minimum(1.0, weight / room)


def _raked_in_spark(cells: DataFrame, targets: dict[str, dict[str, float]], temper: float, fraction: float, rounds: int) -> DataFrame:
    total = cells.agg(F.sum("tokens")).first()[0]
    now = cells.withColumn("weight", F.col("tokens") / float(total)).withColumn("room", F.col("tokens") / (fraction * total))
    for key in KEYS:
        if key in targets:
            pairs = [x for v, share in targets[key].items() for x in (F.lit(v), F.lit(float(share)))]
            raw = F.coalesce(F.element_at(F.create_map(*pairs), F.col(key)), F.lit(0.0)) if pairs else F.lit(0.0)
        else:
            raw = (F.sum("tokens").over(Window.partitionBy(key)) / float(total)) ** temper
        now = now.withColumn(f"raw_{key}", raw)
        norm = now.select(key, f"raw_{key}").distinct().agg(F.sum(f"raw_{key}")).first()[0]
        if not norm:
            raise _unmet(key)
        now = now.withColumn(f"goal_{key}", F.col(f"raw_{key}") / norm)
    for _ in range(rounds):
        for key in KEYS:
            held = F.sum("weight").over(Window.partitionBy(key))
            now = now.withColumn("weight", F.least(F.when(held > 0, F.col("weight") * F.col(f"goal_{key}") / held).otherwise(0.0), F.col("room")))
        now = stored(now, "raked")
    return now.select(*KEYS, F.least(F.lit(1.0), F.col("weight") / F.col("room")).alias("p"))


def _with_p(keyed: DataFrame, counted: DataFrame, targets: dict[str, dict[str, float]] | None, temper: float, fraction: float, rounds: int, local_cells: int) -> DataFrame:
    """``keyed`` with the probability ``p`` of each row's cell, from the tokens of ``counted``."""
    targets = _checked(targets)
    cells = stored(counted.groupBy(*KEYS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    count = cells.count()
    if count == 0:
        return keyed.withColumn("p", F.lit(1.0))
    if count > local_cells:
        return keyed.join(_raked_in_spark(cells, targets, temper, fraction, rounds), [*KEYS])
    table = cells.toPandas().sort_values([*KEYS])
    table["p"] = rake([table[k].to_numpy() for k in KEYS], table["tokens"].to_numpy(np.float64), targets, temper, fraction, rounds)
    raked = keyed.sparkSession.createDataFrame(table[[*KEYS, "p"]], ", ".join(f"{k} string" for k in KEYS) + ", p double")
    return keyed.join(F.broadcast(raked), [*KEYS])


def sampled(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: float = TEMPER, fraction: float = FRACTION, rounds: int = ROUNDS, local_cells: int = LOCAL_CELLS, tokenizer: str | None = None) -> DataFrame:
    """The documents drawn, with the columns of ``docs``."""
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *_keyed(docs))
    kept = _with_p(keyed, _counted(docs, tokenizer), targets, temper, fraction, rounds, local_cells).filter("draw < p")
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def drawn(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: float = TEMPER, fraction: float = FRACTION, rounds: int = ROUNDS, local_cells: int = LOCAL_CELLS, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, probability, sampled) of every document."""
    counted = _counted(docs, tokenizer)
    counted = stored(counted, "counted") if tokenizer else counted
    out = _with_p(counted, counted, targets, temper, fraction, rounds, local_cells)
    return out.select("doc_id", *KEYS, "n_tokens", F.round("p", 6).alias("probability"), (F.col("draw") < F.col("p")).alias("sampled"))


def _sql() -> str:
    steps = "SELECT *, tokens / total AS w, tokens / (0.5 * total) AS room FROM goals"
    for _ in range(ROUNDS):
        for key in KEYS:
            steps = f"SELECT * REPLACE (least(w * goal_{key} / sum(w) OVER (PARTITION BY {key}), room) AS w) FROM ({steps})"
    goals = ", ".join(f"power(sum(tokens) OVER (PARTITION BY {k}) / total, {TEMPER}) / (SELECT sum(r) FROM (SELECT power(sum(tokens) / any_value(total), {TEMPER}) AS r FROM cells GROUP BY {k})) AS goal_{k}" for k in KEYS)
    return f"""
WITH d AS (
  SELECT doc_id, text, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
    CASE WHEN lower(text) LIKE '%license%' OR lower(text) LIKE '%copyright%' THEN 'legal' WHEN text LIKE '%@%' THEN 'contact'
         WHEN lower(text) LIKE '%http%' THEN 'web' WHEN regexp_matches(text, '[0-9]{{4}}') THEN 'figures' ELSE 'prose' END AS topic,
    greatest(1, ceil(octet_length(encode(coalesce(text, ''))) / 4))::BIGINT AS n_tokens,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 13))::BIGINT / {float(1 << 52)} AS u FROM documents),
cells AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens, sum(sum(n_tokens)) OVER ()::DOUBLE AS total FROM d GROUP BY source, lang, topic),
goals AS (SELECT *, {goals} FROM cells),
raked AS ({steps})
SELECT doc_id, source, lang, topic, n_tokens, round(least(1.0, w / room), 6) AS probability, u < least(1.0, w / room) AS sampled
FROM d JOIN raked USING (source, lang, topic)
"""


SQL = _sql()
