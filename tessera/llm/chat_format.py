"""Operator 6: chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; runs of adjacent turns of
one role become one message, their texts joined by a line end; the messages are
concatenated with role markers.

Defined results: rows with a null ``conv_id`` are left out; exact repeats of a turn
(same number, role and text) count once; turns of one number go by role, then text, and turns
without a number come last; a null role is 'unknown' and a null text ''; the marker
opening ``<|`` inside a text is written ``< |``, so a text can't forge a role. Texts are never cut. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def formatted(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_messages, chat), one row per conversation."""
    turn = F.struct(F.col("turn").isNull().alias("unnumbered"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"))
    collected = conversations.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_set(turn)).alias("turns"))
    starts = collected.withColumn("starts", F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"])))
    texts = lambda at, end: F.transform(F.slice("turns", at + 1, end - at), lambda t: t["text"])
    merged = starts.withColumn(
        "messages", F.transform("starts", lambda at, k: F.struct(F.get("turns", at)["role"].alias("role"), F.array_join(texts(at, F.coalesce(F.get("starts", k + 1), F.size("turns"))), "\n").alias("content")))
    )
    line = lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))
    return merged.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.size("messages").cast("long").alias("n_messages"), F.array_join(F.transform("messages", line), "").alias("chat"))


SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS place FROM t),
n AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY place) = role THEN 0 ELSE 1 END AS new FROM o),
r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY place) AS run FROM n),
m AS (SELECT conv_id, run, any_value(role) AS role, string_agg(text, chr(10) ORDER BY place) AS content, count(*) AS turns FROM r GROUP BY conv_id, run)
SELECT conv_id, sum(turns)::BIGINT AS n_turns, count(*) AS n_messages, string_agg('<|im_start|>' || role || chr(10) || content || '<|im_end|>' || chr(10), '' ORDER BY run) AS chat
FROM m GROUP BY conv_id
"""
