"""Operator 3: best-fit decreasing packing of documents into bins of fixed capacity.

Only (doc_id, tokens) move: documents are spread by hash over packing groups of about
``per_group`` documents, and every group packs its own bins, longest document first. A
segment tree over the remaining capacities 0..capacity tells which hold an
open bin; the tightest one that fits is found in O(log capacity), among equals the bin opened first.

A document longer than the capacity fills whole bins and its rest is packed like any other.

Tokens are counted with the ``tokenizer`` (a file of ranks, read where tasks run) on whole texts, as operator 9 does; only
the counts leave the task. Without one, a token stands for four UTF-8 bytes, the last for what is left: an estimate, below
the true count of most texts, so that bins packed by it can exceed the capacity in real tokens.

Defined results: null and empty texts have no tokens and are not packed; a null ``doc_id`` is packed and stays null; repeated rows are packed each.
Ties go by ``doc_id``. Other columns, whatever their names, are not read; an empty table gives an empty one; long texts are counted whole. Bins are numbered group * 2**32 + number in the group.
"""

from __future__ import annotations

from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._bpe import count_column
from tessera.llm._shared import stored

CAPACITY = 2048
PER_GROUP = 20_000


class Capacities:
    """Segment tree over remaining capacities, each with the open bins that have just that much left."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = bytearray(2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, left: int, number: int) -> None:
        heappush(self.bins[left], number)
        node, tree = left + self.size, self.tree
        while node and not tree[node]:
            tree[node] = 1
            node >>= 1

    def tightest(self, need: int) -> int:
        """The smallest remaining capacity of at least ``need`` that some bin has, or -1."""
        tree, node = self.tree, need + self.size
        if not tree[node]:
            while node & 1 or not tree[node + 1]:
                node >>= 1
                if node <= 1:
                    return -1
            node += 1
        while node < self.size:
            node = 2 * node + (not tree[2 * node])
        return node - self.size

    def take(self, left: int) -> int:
        """One bin with that much left, the first opened, which leaves the tree."""
        number = heappop(self.bins[left])
        node, tree = left + self.size, self.tree
        if not self.bins[left]:
            tree[node] = 0
            node >>= 1
            while node and not (tree[2 * node] or tree[2 * node + 1]):
                tree[node] = 0
                node >>= 1
        return number


def pack(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(item, token where the piece begins, tokens, bin, place in the bin) for items in order of preference among equals."""
    out, rest, bins = [], [], 0
    for item, length in enumerate(lengths):
        whole = length // capacity
        for i in range(whole):
            out.append((item, i * capacity, capacity, bins, 0))
            bins += 1
        if length % capacity:
            rest.append((-(length % capacity), item, whole * capacity))
    open_ = Capacities(capacity)
    for minus, item, begin in sorted(rest):
        left = open_.tightest(-minus)
        if left < 0:
            number, left = bins, capacity
            bins += 1
        else:
            number = open_.take(left)
        out.append((item, begin, -minus, number, capacity - left))
        if left + minus:
            open_.add(left + minus, number)
    return out


def counted(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, tokens) of every document with a text."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), count_column(tokenizer, batch.column(1))], ["doc_id", "tokens"])

    return docs.filter("octet_length(text) > 0").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, tokens long")


def packed(docs: DataFrame, capacity: int = CAPACITY, per_group: int = PER_GROUP, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece_begin, piece_tokens, bin, bin_offset) for every piece of every document."""
    estimate = F.ceil(F.octet_length("text") / 4).cast("long").alias("tokens")
    sized = stored((counted(docs, tokenizer) if tokenizer else docs.select(F.col("doc_id").cast("long"), estimate)).filter("tokens > 0"), "sized")
    groups = max(1, -(-sized.count() // per_group))
    spread = sized.withColumn("group", F.pmod(F.xxhash64("doc_id", "tokens"), F.lit(groups)))

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["doc_id"].to_pylist(), table["tokens"].to_pylist()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        base = table["group"][0].as_py() << 32
        got = pack([r[1] for r in rows], capacity)
        columns = [[rows[p[0]][0] for p in got], [p[1] for p in got], [p[2] for p in got], [base + p[3] for p in got], [p[4] for p in got]]
        return pa.table(dict(zip(("doc_id", "piece_begin", "piece_tokens", "bin", "bin_offset"), (pa.array(c, pa.int64()) for c in columns))))

    return spread.groupBy("group").applyInArrow(run, "doc_id long, piece_begin long, piece_tokens long, bin long, bin_offset long")
