"""Operator 2: word n-gram Jaccard self-join with a token-group matrix.

Documents are sets of word n-grams. The join finds every pair of documents whose
sets have Jaccard similarity of at least ``threshold``; it is exact up to
collisions of 58-bit gram hashes.

1. Every document joins the *group* named by the smallest mixed hash among the
   first half of its grams and by a class of its size, so copies and near copies mostly share a group. In a large family every changed
   text may have a smallest hash of its own, and the pairs of its groups would grow with the square of the family; so sets that share a *band*
   of smallest hashes with ``crowd`` sets or more move to the group of the smallest ``doc_id`` among them. Any choice of groups finds the same pairs.
2. The token-group matrix is kept sparse, as rows (gram, group): for each
   document only the ``(1 - threshold)`` share of its grams that comes first in a
   global order, and ``meetings`` more, enters: by how common the gram's rarest word is,
   then by hash. Two sets that reach the threshold must meet there ``meetings`` times, so a group
   that meets a query's group less often, too late in the order or only at incompatible
   sizes has a bound below the threshold and stays closed. The words are counted over all documents in a
   table of fixed size; collisions in it cost order, not results.
3. For the pairs of groups that remain, the documents of the smaller one travel,
   with their whole texts, to the larger one. There the bound is taken against the
   full union of the group's grams; only queries that pass it open the group, where
   overlaps are counted exactly.

Groups of over ``block`` distinct sets are cut into blocks that visit each other, and the guests of a
block are cut likewise, so an opened group is one block of members and one of guests; nothing is dropped.

Defined results: texts without a word and null texts have no grams and no
partners; a text of fewer than ``n`` words is one gram of all its words. Rows
with a null ``doc_id`` are left out. Documents with equal sets are linked, at
1.0, to the smallest ``doc_id`` among them, which alone is compared
further; ``copies_a`` and ``copies_b`` tell how many documents each id stands
for. Rows that repeat a ``doc_id`` are one document, whose set is the union of the grams
of its texts; equal texts count once. Texts are read whole at any length. Other columns, whatever their names, are not read,
or are passed through by ``keep_one``; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _words as words
from tessera.llm._shared import discard, stored

N = 3
THRESHOLD = 0.55
BLOCK = 1024
COUNTERS = 1 << 20
FILTER_BITS = 1 << 23
CROWD = 32
BANDS, BAND = 8, 4
CLASS = 1.3
_EPS = 1e-9
_POSTINGS = 1 << 17
_MOST_AT, _MOST_N = (1 << 16) - 1, (1 << 24) - 1
_TOKEN = np.uint64((1 << 64) - (1 << 16))


def token_sets(s: words.Slice, n: int, common: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted distinct grams of each row, in the global order: those of rare words first, then by hash."""
    x = words.scan(s)
    gram = words.grams(x.hash, n)
    each = common[(x.hash & np.uint64(len(common) - 1)).astype(np.int64)]
    rarest = each[: len(gram)]
    for i in range(1, n):
        rarest = np.minimum(rarest, each[i : i + len(gram)])
    value = (rarest.astype(np.uint64) << np.uint64(58)) | (gram >> np.uint64(6))
    for row in range(s.count):
        a, b = x.of_row[row], x.of_row[row + 1]
        if b - a >= n:
            yield np.unique(value[a : b - n + 1])
        elif b > a:
            yield words.grams(x.hash[a:b], int(b - a)) >> np.uint64(6)
        else:
            yield np.zeros(0, np.uint64)


def doc_sets(column: pa.Array, n: int, common: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, grams) of a column of lists of texts: the sets of a row's texts united."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    of, last, sets = pc.list_parent_indices(column).to_numpy(), -1, []
    for s in words.slices(column.flatten()):
        for i, g in enumerate(token_sets(s, n, common)):
            if of[s.first + i] != last:
                if sets:
                    yield last, sets[0] if len(sets) == 1 else np.unique(np.concatenate(sets))
                last, sets = int(of[s.first + i]), []
            sets.append(g)
    if sets:
        yield last, sets[0] if len(sets) == 1 else np.unique(np.concatenate(sets))


def meetings(size):
    """How many shared grams a set of this size must show before its group is opened."""
    return 1 + (size * 2) // 25


def prefix_length(size: int, threshold: float) -> int:
    """Grams of the order's beginning that hold the first ``meetings`` shared grams of any similar pair."""
    return min(size, size - int(np.ceil(threshold * size - _EPS)) + meetings(size))


def home_of(grams: np.ndarray) -> int:
    """Group of a document (39 bits): the smallest mixed hash among the first half of its grams, for each class of size."""
    return int(in_class(words.mix(grams[: max(1, len(grams) // 2)]).min(), len(grams))[0])


def in_class(home, size):
    """Groups (39 bits) from hashes and sizes: sizes of a group lie within ``CLASS``, else the bounds of a mixed group would be as loose as its smallest set."""
    return (words.mix(np.atleast_1d(home).astype(np.uint64) + np.floor(np.log(size) / np.log(CLASS)).astype(np.uint64)) >> np.uint64(25)).astype(np.int64)


def bands_of(grams: np.ndarray) -> np.ndarray:
    """Hashes of runs of ``BAND`` smallest mixed hashes, one of each equal range of hashes; an empty range takes the next one's."""
    h = np.sort(words.mix(grams))
    begin = np.arange(BANDS * BAND, dtype=np.uint64) << np.uint64(64 - int(BANDS * BAND - 1).bit_length())
    return words.grams(h[np.searchsorted(h, begin) % len(h)], BAND)[::BAND].view(np.int64)


def _differing(docs: DataFrame) -> DataFrame:
    """The ``doc_id``s whose rows differ in text, but for upper case."""
    text = F.xxhash64(F.lower("text"))
    return docs.filter("doc_id is not null").groupBy("doc_id").agg(F.min(text).alias("low"), F.max(text).alias("high")).filter("low <> high").select("doc_id")


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, texts) with all texts of a ``doc_id`` in one row; only rows with equal texts may repeat."""
    some = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), F.lower("text").alias("text"))
    differing = stored(_differing(some), "differing")
    alone = some.select("doc_id", F.array("text").alias("texts"))
    if differing.isEmpty():
        return alone
    united = some.join(differing, "doc_id", "left_semi").groupBy("doc_id").agg(F.sort_array(F.collect_set("text")).alias("texts"))
    return alone.join(differing, "doc_id", "left_anti").unionByName(stored(united, "united"))


def word_levels(texts: DataFrame, counters: int = COUNTERS) -> np.ndarray:
    """How common the words of each counter are, in steps of a doubling; summed over all documents."""
    width = counters // 16

    def count(batches):
        total = np.zeros(counters, np.uint32)
        for batch in batches:
            for s in words.slices(batch.column(1).flatten()):
                at, often = np.unique((words.scan(s).hash & np.uint64(counters - 1)).astype(np.int64), return_counts=True)
                total[at] += often.astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(range(16), pa.int32()), pa.array([total[i * width : (i + 1) * width].tobytes() for i in range(16)], pa.binary())], ["part", "counts"])

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(width, np.uint64)
        for x in table["counts"]:
            total += np.frombuffer(x.as_buffer(), np.uint32)
        return pa.table({"part": table["part"][:1], "levels": pa.array([np.ceil(np.log2(total + 1.0)).astype(np.uint8).tobytes()], pa.binary())})

    rows = texts.mapInArrow(count, "part int, counts binary").groupBy("part").applyInArrow(merge, "part int, levels binary").collect()
    levels = np.zeros(counters, np.uint8)
    for row in rows:
        levels[row.part * width : (row.part + 1) * width] = np.frombuffer(row.levels, np.uint8)
    return levels


def _profiles(texts: DataFrame, n: int, levels) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            rows = [(int(ids[i]), len(g), int(np.bitwise_xor.reduce(words.mix(g + np.uint64(1))).view(np.int64)), home_of(g), bands_of(g)) for i, g in doc_sets(batch.column(1), n, levels.value) if len(g)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())))], ["doc_id", "n", "set_hash", "home", "bands"])

    return texts.mapInArrow(run, "doc_id long, n int, set_hash long, home long, bands array<long>")


def _moves(sets: DataFrame, crowd: int) -> DataFrame:
    """(rep, to): the group, by its own size, of the smallest ``rep`` met in a band that ``crowd`` sets or more share."""

    def run(batches):
        parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if parts:
            band, rep, home, n = (np.concatenate(c) for c in zip(*parts))
            order = np.lexsort((rep, band))
            band, rep, home, n = band[order], rep[order], home[order], n[order]
            first = np.flatnonzero(np.r_[True, band[1:] != band[:-1]])
            many = np.diff(np.r_[first, len(band)])
            hub, crowded = np.repeat(first, many), np.repeat(many, many) >= crowd
            yield pa.RecordBatch.from_arrays([rep[crowded], rep[hub[crowded]], in_class(home[hub[crowded]], n[crowded])], ["rep", "hub", "to"])

    spots = sets.select(F.explode(F.array_distinct("bands")).alias("band"), "rep", "home", "n").repartition("band")
    return spots.mapInArrow(run, "rep long, hub long, to long").groupBy("rep").agg(F.min_by("to", F.struct("hub", "to")).alias("to"))


def _postings(texts: DataFrame, n: int, threshold: float, levels) -> DataFrame:
    """(token_at, home_n) of ``texts`` (doc_id, texts, home), where a null home is the text's own."""

    def batch_of(tokens, groups):
        return pa.RecordBatch.from_arrays([np.concatenate(tokens).view(np.int64), np.concatenate(groups)], ["token_at", "home_n"])

    def run(batches):
        for batch in batches:
            tokens, groups, held = [], [], 0
            given = batch.column(2)
            for i, g in doc_sets(batch.column(1), n, levels.value):
                if len(g):
                    home = given[i].as_py()
                    k = prefix_length(len(g), threshold)
                    tokens.append((g[:k] & _TOKEN) | np.minimum(np.arange(k), _MOST_AT).astype(np.uint64))
                    groups.append(np.full(k, ((home_of(g) if home is None else home) << 24) | min(len(g), _MOST_N)))
                    held += k
                if held >= _POSTINGS:
                    yield batch_of(tokens, groups)
                    tokens, groups, held = [], [], 0
            if tokens:
                yield batch_of(tokens, groups)

    return texts.mapInArrow(run, "token_at long, home_n long")


def unpacked(token_at: np.ndarray, home_n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Token, group, size and grams left, from the two words of a posting.

    Places and sizes too large for their bits are cut where that only loosens the bounds.
    """
    n = home_n & _MOST_N
    tail = np.where(n == _MOST_N, np.int64(1) << 40, n - (token_at & _MOST_AT))
    return token_at >> 16, home_n >> 24, n, tail


def meeting_groups(token: np.ndarray, home: np.ndarray, n: np.ndarray, tail: np.ndarray, threshold: float, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs of groups that share tokens at compatible sizes, with enough grams left from there on.

    With each pair, how many tokens they share here and how many they must share in all.
    """
    if len(token) == 0:
        return
    order = np.lexsort((home, token))
    token, home, n, tail = token[order], home[order], n[order], tail[order]
    first = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (home[1:] != home[:-1])])
    low, high = np.minimum.reduceat(n, first).astype(np.int64), np.maximum.reduceat(n, first).astype(np.int64)
    token, home, tail = token[first], home[first], np.maximum.reduceat(tail, first).astype(np.int64)
    run = np.cumsum(np.r_[0, token[1:] != token[:-1]])
    shared = np.bincount(run)[run] > 1
    home, low, high, run, tail = home[shared], low[shared], high[shared], run[shared], tail[shared]
    order = np.lexsort((low, run))
    home, low, high, run, tail = home[order], low[order], high[order], run[order], tail[order]
    wide = np.int64(1) << 40
    until = np.searchsorted(run * wide + low, run * wide + np.floor(high / threshold + _EPS).astype(np.int64), side="right")
    partners = np.maximum(0, until - np.arange(len(home)) - 1)
    total = np.cumsum(partners)
    at = 0
    while at < len(home):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        left = np.repeat(np.arange(at, end), partners[at:end])
        begin = np.cumsum(partners[at:end]) - partners[at:end]
        right = left + 1 + np.arange(len(left)) - np.repeat(begin, partners[at:end])
        must, most_met = meetings(np.minimum(low[left], low[right])), meetings(np.minimum(high[left], high[right]))
        enough = np.minimum(tail[left], tail[right]) + most_met - 1 >= threshold / (1 + threshold) * (low[left] + low[right]) - _EPS
        a, b, must = home[left[enough]], home[right[enough]], must[enough]
        a, b = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((b, a))
        a, b, must = a[order], b[order], must[order]
        if len(a):
            new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            yield a[new], b[new], np.diff(np.r_[new, len(a)]), np.minimum.reduceat(must, new)
        at = end


def _marked(texts: DataFrame, wanted: DataFrame, bits: int) -> DataFrame:
    """``texts`` with ``asked``, which is true for every ``doc_id`` in ``wanted``, and for few others unless the bit table of fixed size fills up."""
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    parts = wanted.select(spot("doc_id").alias("spot")).groupBy(F.shiftright("spot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("value")).toPandas()
    table = np.zeros(bits // 64, np.int64)
    table[parts["word"].to_numpy(np.int64)] = parts["value"].to_numpy(np.int64)
    row = texts.sparkSession.createDataFrame(pa.table({"bits": pa.array([table], pa.list_(pa.int64()))}))
    marked = texts.withColumn("spot", spot("doc_id")).crossJoin(F.broadcast(row))
    asked = F.expr("(shiftright(element_at(bits, cast(shiftright(spot, 6) as int) + 1), cast(spot & 63 as int)) & 1) = 1")
    return marked.select(*texts.columns, asked.alias("asked"))


def only_of(texts: DataFrame, wanted: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """``texts`` without most rows whose ``doc_id`` isn't in ``wanted``, before they are shuffled to a join with it.

    A bit table of fixed size, made by an aggregation of ``wanted``; where that is large the table fills up and lets all rows pass.
    """
    return _marked(texts, wanted, bits).filter("asked").select(*texts.columns)


def _at_home(texts: DataFrame, moved: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """``texts`` with ``home`` of ``moved`` (doc_id, home), or null; only texts that may have moved are shuffled."""
    if moved.isEmpty():
        return texts.withColumn("home", F.lit(None).cast("long"))
    marked = _marked(texts, moved, bits)
    return marked.filter("not asked").select("doc_id", "texts", F.lit(None).cast("long").alias("home")).unionByName(marked.filter("asked").join(moved, "doc_id", "left").select("doc_id", "texts", "home"))


def _group_pairs(texts: DataFrame, n: int, threshold: float, levels) -> DataFrame:
    def run(batches):
        parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if parts:
            for found in meeting_groups(*unpacked(*(np.concatenate(c) for c in zip(*parts))), threshold):
                yield pa.RecordBatch.from_arrays(list(found), ["home_a", "home_b", "met", "must"])

    found = _postings(texts, n, threshold, levels).repartition(F.shiftright("token_at", 16)).mapInArrow(run, "home_a long, home_b long, met long, must long")
    return found.groupBy("home_a", "home_b").agg(F.sum("met").alias("met"), F.min("must").alias("must")).filter("met >= must").select("home_a", "home_b")


def overlaps(sets: list[np.ndarray], members: int) -> np.ndarray:
    """Shared grams of every set with each of the first ``members`` sets."""
    sizes = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    _, column, frequency = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((len(sets), members), np.float32)
    common = frequency[column] > 1
    row, column = row[common], column[common]
    dense = frequency[column] * 12 >= len(sets)
    if dense.any():
        name, at = np.unique(column[dense], return_inverse=True)
        rows, width = row[dense], max(1, (1 << 22) // len(sets))
        for c in range(0, len(name), width):
            block = np.zeros((len(sets), min(width, len(name) - c)), np.float32)
            here = (at >= c) & (at < c + width)
            block[rows[here], at[here] - c] = 1
            out += block @ block[:members].T
    row, column = row[~dense], column[~dense]
    if len(row):
        order = np.lexsort((row, column))
        row, column = row[order], column[order]
        ends = np.searchsorted(column, column, side="right")
        begins = np.searchsorted(column, column, side="left")
        count = ends - begins
        step = max(1, (1 << 21) // max(1, int(count.max())))
        for at in range(0, len(row), step):
            k = count[at : at + step]
            left = np.repeat(row[at : at + step], k)
            right = row[np.repeat(begins[at : at + step], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)]
            keep = right < members
            np.add.at(out, (left[keep], right[keep]), 1)
    return out


def open_group(ids: np.ndarray, sets: list[np.ndarray], guest: np.ndarray, threshold: float, forest: bool, among: bool = True, copies: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Similar pairs among a group's members, unless ``among`` is false, and between them and the guests that pass the bound.

    With ``forest`` and ``copies``, (id, id, links) rows follow: how many documents, counted with their copies, each is similar to here.
    """
    order = np.lexsort((ids, guest))
    ids, guest, sets = ids[order], guest[order], [sets[i] for i in order]
    copies = None if copies is None else copies[order]
    members = int((~guest).sum())
    none = np.zeros(0, np.int64)
    if members == 0 or len(ids) < 2:
        return none, none, np.zeros(0)
    sizes = np.array([len(x) for x in sets])
    union = np.unique(np.concatenate(sets[:members]))
    least = sizes[:members].min()
    open_ = np.ones(len(ids), bool)
    for i in range(members, len(ids)):
        met = int((union[np.minimum(np.searchsorted(union, sets[i]), len(union) - 1)] == sets[i]).sum())
        open_[i] = met >= threshold / (1 + threshold) * (sizes[i] + max(least, threshold * sizes[i])) - _EPS
    kept = np.flatnonzero(open_)
    ids, sizes, sets = ids[kept], sizes[kept], [sets[i] for i in kept]
    shared = overlaps(sets, members)
    jaccard = shared / (sizes[:, None] + sizes[None, :members] - shared.astype(np.float64))
    similar = jaccard >= threshold - _EPS
    similar[np.arange(members), np.arange(members)] = False
    if not among:
        similar[:members] = False
    if forest:
        seen = np.zeros(len(ids), bool)
        a, b = [], []
        whole = np.zeros((len(ids), len(ids)), bool)
        whole[:, :members] = similar
        whole[:members, :] |= similar.T
        for i in range(len(ids)):
            if seen[i]:
                continue
            seen[i] = True
            edge = [i]
            while len(edge):
                edge = np.flatnonzero(whole[edge].any(0) & ~seen)
                seen[edge] = True
                a += [ids[i]] * len(edge)
                b += list(ids[edge])
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        a, b, value = np.minimum(a, b), np.maximum(a, b), np.ones(len(a))
        if copies is None:
            return a, b, value
        links = similar @ copies[kept[:members]].astype(np.float64)  # of members once for either side, of guests with members
        links[:members] += similar[members:].T @ copies[kept[members:]].astype(np.float64)
        some = links > 0
        return np.r_[a, ids[some]], np.r_[b, ids[some]], np.r_[value, links[some]]
    i, j = np.nonzero(similar)
    once = (i > j) & (ids[i] != ids[j])
    i, j = i[once], j[once]
    return np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), jaccard[i, j]


def _near(docs: DataFrame, n: int, threshold: float, block: int, forest: bool, crowd: int = CROWD, count: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs of different sets, exact copies as pairs, the distinct sets).

    With ``forest`` the pairs of one opened group are thinned to a spanning forest that
    connects the same documents; ``jaccard`` is then 1.0 throughout. With ``count`` too, rows of one document with itself
    have there how many documents it was found similar to, which add up over all rows.
    """
    texts = _texts(docs)
    levels = docs.sparkSession.sparkContext.broadcast(word_levels(texts))
    profiles = stored(_profiles(texts, n, levels), "profiles")
    key = ["set_hash", "n", "home"]
    sets = stored(profiles.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count_distinct("doc_id").alias("copies"), F.any_value("bands").alias("bands")), "sets")
    moves = stored(_moves(sets, crowd), "moves")
    moved = stored(profiles.join(sets.join(moves, "rep"), key).groupBy("doc_id").agg(F.min("to").alias("home")), "moved")
    copies = profiles.join(sets, key).filter("doc_id <> rep").select(F.col("rep").alias("id_a"), F.col("doc_id").alias("id_b"), F.lit(1.0).alias("jaccard")).distinct()
    pairs = stored(_group_pairs(_at_home(texts, moved), n, threshold, levels), "pairs")
    named = sets
    sets = sets.join(moves, "rep", "left").withColumn("home", F.coalesce("to", "home"))
    blocks = sets.groupBy("home").agg(F.count("*").alias("sets"))
    cut = F.pmod(F.xxhash64("rep"), F.ceil(F.col("sets") / block))
    members = sets.join(blocks, "home").select("rep", "copies", "n", "home", "sets", cut.cast("int").alias("block"))
    within = blocks.filter("sets > 1").select("home", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("sets") / block) - 1).cast("int"))).alias("block"), (F.ceil(F.col("sets") / block) - 1).cast("int").alias("last"))
    inside = within.select("home", "block", F.col("home").alias("host"), F.explode(F.sequence(F.col("block"), F.col("last"))).alias("host_block"))
    a, b = (blocks.select(F.col("home").alias(f"home_{x}"), F.col("sets").alias(f"sets_{x}")) for x in "ab")
    met = pairs.join(a, "home_a").join(b, "home_b")
    smaller = F.struct("sets_a", "home_a") < F.struct("sets_b", "home_b")
    met = met.select(
        F.when(smaller, F.col("home_a")).otherwise(F.col("home_b")).alias("home"), F.least("sets_a", "sets_b").alias("few"),
        F.when(smaller, F.col("home_b")).otherwise(F.col("home_a")).alias("host"), F.greatest("sets_a", "sets_b").alias("many"),
    )
    last = lambda c: (F.ceil(F.col(c) / block) - 1).cast("int")
    across = met.select("home", "host", "many", F.explode(F.sequence(F.lit(0), last("few"))).alias("block")).select("home", "block", "host", F.explode(F.sequence(F.lit(0), last("many"))).alias("host_block"))
    hosts = across.select(F.col("host").alias("home"), F.col("host_block").alias("block"), "host", "host_block")
    visits = inside.unionByName(across).unionByName(hosts).groupBy("home", "block").agg(F.collect_set(F.struct("host", "host_block")).alias("hosts"))
    travel = members.join(visits, ["home", "block"]).select(F.col("rep").alias("doc_id"), "copies", "home", "block", F.explode("hosts").alias("to"))
    guest = ((F.col("to.host") != F.col("home")) | (F.col("to.host_block") != F.col("block"))).alias("guest")
    seats = stored(travel.select("doc_id", "copies", "to.host", "to.host_block", guest), "seats")
    tables = seats.filter("guest").groupBy("host", "host_block").agg((F.ceil(F.count("*") / block) - 1).cast("int").alias("last"))
    own = F.sequence(F.lit(0), F.coalesce("last", F.lit(0)))
    seated = seats.join(tables, ["host", "host_block"], "left").select(
        "doc_id", "copies", "host", "host_block", "guest", F.explode(F.when(F.col("guest"), F.array(F.pmod(F.xxhash64("doc_id"), F.col("last") + 1).cast("int"))).otherwise(own)).alias("guest_block")
    )
    visit = F.struct("copies", "host", "host_block", "guest", "guest_block")
    to = seated.groupBy("doc_id").agg(F.collect_list(visit).alias("visits")).join(only_of(texts, seats), "doc_id").select("doc_id", "texts", F.explode("visits").alias("to")).select("doc_id", "texts", "to.*")

    def group(table: pa.Table) -> pa.Table:
        first_block = table["guest_block"][0].as_py() == 0
        table = table.select(["doc_id", "guest", "texts", "copies"])
        ids, first = np.unique(table["doc_id"].to_numpy(), return_index=True)
        guest = table["guest"].to_numpy(zero_copy_only=False).astype(bool)[first]
        grams = [g for _, g in doc_sets(table["texts"].take(pa.array(first)), n, levels.value)]
        a, b, j = open_group(ids, grams, guest, threshold, forest, first_block, table["copies"].to_numpy()[first] if count else None)
        return pa.table({"id_a": a.astype(np.int64), "id_b": b.astype(np.int64), "jaccard": j.astype(np.float64)})

    near = to.groupBy("host", "host_block", "guest_block").applyInArrow(group, "id_a long, id_b long, jaccard double")
    return near, copies, named


def similar_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Pairs (id_a < id_b, jaccard, copies_a, copies_b) of similar documents."""
    near, copies, sets = _near(docs, n, threshold, block, False)
    counts = sets.groupBy("rep").agg(F.max("copies").alias("copies"))
    a, b = (counts.select(F.col("rep").alias(f"id_{x}"), F.col("copies").alias(f"copies_{x}")) for x in "ab")
    named = near.join(a, "id_a").join(b, "id_b").unionByName(copies.join(a, "id_a").withColumn("copies_b", F.lit(1).cast("long")))
    return named.select("id_a", "id_b", F.round("jaccard", 9).alias("jaccard"), "copies_a", "copies_b")


def classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, links) of every document: the smallest ``doc_id`` it is connected to by similar pairs, and to how many others it is similar.

    Copies count as documents, in ``links`` too; a document without partners is a class of its own.
    """
    near, copies, sets = _near(docs, n, threshold, block, True, count=True)
    near = stored(near, "near")
    met = near.filter("id_a = id_b").groupBy(F.col("id_a").alias("rep")).agg(F.sum("jaccard").cast("long").alias("met"))
    roots = components(near.filter("id_a <> id_b")).withColumnRenamed("doc_id", "rep")
    linked = sets.select("rep", "copies").join(met, "rep", "left").join(roots, "rep", "left").select("rep", F.coalesce("root", "rep").alias("class_id"), (F.coalesce("met", F.lit(0)) + F.col("copies") - 1).alias("links"))
    own = copies.select(F.col("id_b").alias("doc_id"), F.col("id_a").alias("rep")).unionByName(sets.select(F.col("rep").alias("doc_id"), "rep"))
    named = own.join(linked, "rep").select("doc_id", "class_id", "links")
    every = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return every.join(named, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, root) of every document with an edge; root is the smallest id it is connected to.

    Large-star and small-star rounds (Kiveris et al., 2014) on the edge table by minima and joins, without a list of any
    vertex's neighbours; each is stored in the shared folder in place of the last, until a round changes nothing.
    """
    lowest = lambda e: e.groupBy("u").agg(F.min("v").alias("m"))
    now = stored(edges.select(F.greatest("id_a", "id_b").alias("u"), F.least("id_a", "id_b").alias("v")).filter("u <> v").distinct(), "edges")
    mark = None
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = lowest(both).withColumn("m", F.least("m", "u"))
        large = both.filter("v > u").join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = lowest(large)
        hung = large.join(down, "u").select("m", F.explode(F.array("u", "v")).alias("u"))
        after = stored(hung.filter("u <> m").select("u", F.col("m").alias("v")).distinct(), "edges")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        discard(now)
        now = after
        if state == mark:
            return lowest(now).select(F.col("u").alias("doc_id"), F.col("m").alias("root"))
        mark = state


def keep_one(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``docs`` with one document, of the smallest ``doc_id``, of each group of connected similar documents.

    Rows that repeat a ``doc_id`` with equal text, but for upper case, are reduced to one, the least by its
    columns; with different texts each text is a document of its own here, numbered
    by ``doc_id`` and hash. Rows with a null ``doc_id`` and rows without a word all stay.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(row, F.col("doc_id").cast("long").alias("number"), "text")
    if not _differing(docs).isEmpty():
        mark = F.xxhash64(F.lower("text")).alias("mark")
        texts = docs.filter("doc_id is not null").select(F.col("doc_id").alias("id"), mark).distinct().orderBy("id", "mark")
        numbers = stored(texts.withColumn("number", F.monotonically_increasing_id()), "numbers")
        rows = stored(docs.select(row, F.col("doc_id").alias("id"), "text", mark).join(numbers, ["id", "mark"], "left").select("row", "number", "text"), "numbered")
    near, copies, _ = _near(rows.select(F.col("number").alias("doc_id"), "text"), n, threshold, block, True)
    gone = stored(components(near).select(F.col("doc_id").alias("number")).unionByName(copies.select(F.col("id_b").alias("number"))).distinct(), "gone")
    left = rows.join(gone, "number", "left_anti")
    columns = [F.col("row")[c].alias(c) for c in docs.columns]
    repeated = stored(rows.filter("number is not null").groupBy("number").count().filter("count > 1").select("number"), "repeated")
    if repeated.isEmpty():
        return left.select(*columns)
    one = left.join(repeated, "number", "left_semi").groupBy("number").agg(F.min("row").alias("row")).select(*columns)
    return left.join(repeated, "number", "left_anti").select(*columns).unionByName(one)
