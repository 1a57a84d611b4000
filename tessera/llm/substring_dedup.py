"""Operator 5: passages that repeat across documents, found with compressed FM-indexes.

A passage repeats when ``least`` consecutive words of a document (50; case and
punctuation apart) also stand in a document with another ``doc_id``. All
stretches covered by such passages are reported.

1. Every window of ``least`` words names an *anchor*, the smallest hash among its
   runs of ``least // 2`` words. Equal windows name equal anchors, so only text around
   anchors that occur in two documents or more can repeat; the rest of the corpus
   leaves here, without loss.
2. The stretch of text whose windows name one anchor is its *context*. Of contexts with equal bytes only one, of the
   smallest ``doc_id``, goes to a shard, by anchor; what is found in it holds for all of them. Tasks stream the sorted contexts and
   hold one shard of about ``shard_words`` words, closed where an anchor ends. A shard is an FM-index over the words of its distinct
   contexts: a wavelet matrix of the Burrows-Wheeler transform, longest common prefixes in a byte each with block minima, and
   packed bit vectors with rank counts for document borders; no suffix array, about five bytes a word.
3. The contexts are streamed through the index by backward search, all in step, which
   gives their matching statistics, capped at ``least``; a match counts only while its suffix
   interval spans two documents. Starts with a full match become intervals, merged per document.
4. An anchor with more than ``most_contexts`` distinct contexts, as inside a license text, would be a shard without a bound. Its
   windows are grouped by their hash instead, which gives the same intervals.

The suffixes are sorted to 64 words, which makes the index exact for patterns up to that length; ``least`` must lie between 2 and 64.

Defined results: null and blank texts and null ``doc_id``s have no intervals;
rows that repeat a ``doc_id`` are one document and do not repeat each other; repetition inside one document
does not count. Intervals are [begin, end) in UTF-8 bytes of the text, from the first
letter of a word to the last of another. Other columns are not read, or are passed through by
``remove_repeats``, whatever their names. Texts are searched whole at any length; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import _words as words
from tessera.llm._shared import stored

LEAST = 50
DEPTH = 64
SHARD_WORDS = 1 << 18
MOST_CONTEXTS = 2048
_BYTE = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)


def anchors(hashes: np.ndarray, of_row: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(anchor, row, first word, last word) of each run of windows that name one anchor."""
    none = np.zeros(0, np.int64)
    k = least // 2
    m = len(hashes) - least + 1
    if m <= 0:
        return none, none, none, none
    gram = words.grams(hashes, k)
    bits = np.uint64(int(len(gram)).bit_length())
    low = (gram >> bits << bits) | np.arange(len(gram), dtype=np.uint64)
    span, width = least - k + 1, 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if span > width:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    at = (low[:m] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    row = np.repeat(np.arange(len(of_row) - 1), np.diff(of_row))
    start = np.flatnonzero(row[:m] == row[least - 1 :])
    if len(start) == 0:
        return none, none, none, none
    at = at[start]
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)])
    last = np.r_[new[1:], len(start)] - 1
    return gram[at[new]].view(np.int64), row[start[new]], start[new], start[last] + least - 1


class Bits:
    """A packed bit vector with rank counts."""

    def __init__(self, bits: np.ndarray):
        packed = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        bytes_ = np.packbits(bits.astype(bool), bitorder="little")
        packed[: len(bytes_)] = bytes_
        self.blocks = packed.view(np.uint64)
        self.ones = np.r_[0, np.cumsum(np.bitwise_count(self.blocks).astype(np.int64))].astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block = at >> 6
        inside = self.blocks[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.ones[block] + np.bitwise_count(inside)


class Prefixes:
    """Common prefixes, a byte each, with minima over blocks of 64 and of 4,096 to look for the next smaller one."""

    def __init__(self, lcp: np.ndarray):
        self.levels = [self._blocks(lcp.astype(np.int8))]
        for _ in range(2):
            self.levels.append(self._blocks(self.levels[-1].min(1)))

    @staticmethod
    def _blocks(values: np.ndarray) -> np.ndarray:
        out = np.full(-(-len(values) // 64) * 64, 127, np.int8)
        out[: len(values)] = values
        return out.reshape(-1, 64)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.levels[0].ravel()[at]

    def smaller(self, at: np.ndarray, value: np.ndarray, way: int) -> np.ndarray:
        """The nearest place before (way -1) or after (way 1) each place whose prefix is below the value; there must be one."""
        out, level, place, open_ = np.empty(len(at), np.int64), 0, at, np.arange(len(at))
        inside = np.arange(64)
        while len(open_):
            last = level == len(self.levels) - 1
            rows = self.levels[level].ravel()[None] if last else self.levels[level][place >> 6]
            column = np.arange(rows.shape[1])[None] if last else inside[None]
            own = (place if last else place & 63)[:, None]
            fits = (rows < value[open_, None]) & ((column < own) if way < 0 else (column > own))
            hit = fits.any(1)
            first = fits[hit].argmax(1) if way > 0 else rows.shape[1] - 1 - fits[hit][:, ::-1].argmax(1)
            found = first if last else (place[hit] >> 6 << 6) + first
            for lower in range(level - 1, -1, -1):
                below = self.levels[lower][found] < value[open_[hit], None]
                found = (found << 6) + (below.argmax(1) if way > 0 else 63 - below[:, ::-1].argmax(1))
            out[open_[hit]] = found
            place, open_, level = place[~hit] >> 6, open_[~hit], level + 1
        return out


class FMIndex:
    """FM-index over word codes (1 and up; 0 ends a context), exact for patterns of up to ``DEPTH`` words."""

    def __init__(self, text: np.ndarray, document: np.ndarray, several: np.ndarray, least: int = DEPTH):
        n = self.n = len(text)
        rank = np.unique(text, return_inverse=True)[1].astype(np.int32)
        ranks, width, order = [np.append(rank, np.int32(-1))], 1, np.argsort(rank, kind="stable")
        while width < DEPTH:
            key = (rank.astype(np.int64) + 1) * (n + 2)
            key[: max(0, n - width)] += rank[width:] + 1
            order = np.argsort(key, kind="stable")
            key = key[order]
            rank = np.empty(n, np.int32)
            rank[order] = np.cumsum(np.r_[0, key[1:] != key[:-1]])
            ranks.append(np.append(rank, np.int32(-1)))
            width *= 2
        lcp = np.zeros(n - 1, np.int64)
        a, b = order[:-1], order[1:]
        for level in range(len(ranks) - 2, -1, -1):
            same = ranks[level][np.minimum(a + lcp, n)] == ranks[level][np.minimum(b + lcp, n)]
            lcp += same << level
        del ranks, key, rank
        lcp = np.r_[-1, lcp, -1].astype(np.int8)
        self.lcp = Prefixes(lcp)
        of = document[order]
        codes, counts = np.unique(text, return_counts=True)
        code_count = np.zeros(int(text.max()) + 2, np.int64)
        code_count[codes + 1] = counts
        self.start = np.cumsum(code_count)
        self.changes = Bits(np.r_[False, of[1:] != of[:-1]])
        self.multiple = Bits(several[order])
        groups = lcp[:-1] < least
        self.groups, self.smallest = Bits(groups), np.minimum.reduceat(of, np.flatnonzero(groups))
        self._wavelet(text[(order - 1) % n])

    def _wavelet(self, symbols: np.ndarray) -> None:
        self.levels = []
        for level in range(int(symbols.max()).bit_length() - 1, -1, -1):
            one = (symbols >> level) & 1 == 1
            self.levels.append((level, Bits(one), int((~one).sum())))
            symbols = np.concatenate([symbols[~one], symbols[one]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in the transform before each place."""
        begin, at = np.zeros_like(at), at.copy()
        both = np.concatenate([begin, at])
        twice = np.concatenate([symbol, symbol])
        for level, bits, zeros in self.levels:
            one = bits.rank(both)
            both = np.where((twice >> level) & 1, zeros + one, both - one)
        return both[len(at) :] - both[: len(at)]

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: intervals of symbol + pattern from those of pattern."""
        count = self.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return self.start[symbol] + count[: len(low)], self.start[symbol] + count[len(low) :]

    def widen(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Parent intervals and their lengths."""
        left, right = self.lcp[low], self.lcp[high]
        length = np.maximum(left, right)
        low, high = low.copy(), high.copy()
        for at, edge, way in ((low, left, -1), (high, right, 1)):
            wide = np.flatnonzero((edge == length) & (length >= 0))
            at[wide] = self.lcp.smaller(at[wide], length[wide], way)
        return low, high, length.astype(np.int64)

    def shared(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether an interval holds suffixes of two documents or more."""
        some = np.flatnonzero(high > low)
        a, b = low[some], high[some]
        out = np.zeros(len(low), bool)
        out[some] = (self.changes.rank(b) > self.changes.rank(a + 1)) | (self.multiple.rank(b) > self.multiple.rank(a))
        return out

    def owner(self, row: np.ndarray) -> np.ndarray:
        """The smallest document of the suffixes that share ``least`` words with that of each row."""
        return self.smallest[self.groups.rank(row + 1) - 1]


def matching_statistics(index: FMIndex, text: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Longest match, up to ``least``, of each place of each pattern text[begin:end] with another document's text.

    The second array is, where the match is full, the row of its interval, else -1.
    """
    length, row = np.zeros(len(text), np.int64), np.full(len(text), -1, np.int64)
    place, low = end - 1, np.zeros(len(begin), np.int64)
    high, size = np.full(len(begin), index.n, np.int64), np.zeros(len(begin), np.int64)
    live = np.flatnonzero(place >= begin)
    while len(live):
        i = place[live]
        new_low, new_high = index.step(text[i], low[live], high[live])
        good = index.shared(new_low, new_high)
        grown, at = live[good], i[good]
        low[grown], high[grown] = new_low[good], new_high[good]
        size[grown] += 1
        length[at] = size[grown]
        place[grown] -= 1
        full = size[grown] == least
        row[at[full]] = low[grown[full]]
        grown = grown[full]
        if len(grown):
            size[grown] = least - 1
            wide_low, wide_high, parent = index.widen(low[grown], high[grown])
            wide = parent == least - 1
            low[grown[wide]], high[grown[wide]] = wide_low[wide], wide_high[wide]
        failed = live[~good]
        empty = size[failed] == 0
        place[failed[empty]] -= 1
        failed = failed[~empty]
        if len(failed):
            wide_low, wide_high, parent = index.widen(low[failed], high[failed])
            low[failed], high[failed], size[failed] = wide_low, wide_high, np.maximum(parent, 0)
        live = live[place[live] >= begin[live]]
    return length, row


def repeats_in_shard(hashes: np.ndarray, bounds: np.ndarray, document: np.ndarray, copied: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Per word of the contexts: whether a repeated passage starts there, and the smallest document that has it.

    ``copied`` tells of which contexts further documents have copies.
    """
    sizes = np.diff(bounds)
    whole = np.r_[np.uint64(0), np.cumsum(hashes * words.powers(words._BASE, len(hashes)))]
    key = words.mix((whole[bounds[1:]] - whole[bounds[:-1]]) * words.powers(words._BASE_INV, len(hashes) + 1)[bounds[:-1]] + sizes.astype(np.uint64))
    _, sample, of = np.unique(key, return_index=True, return_inverse=True)
    order = np.lexsort((document, of))
    first = np.flatnonzero(np.r_[True, of[order][1:] != of[order][:-1]])
    least_doc = np.minimum.reduceat(document[order], first)
    several = (least_doc != np.maximum.reduceat(document[order], first)) | np.logical_or.reduceat(copied[order], first)
    count = sizes[sample]
    end = np.cumsum(count + 1) - 1
    begin = end - count
    total = int(end[-1]) + 1 if len(end) else 0
    source = np.repeat(bounds[:-1][sample] - begin, count) + np.arange(count.sum()) + np.repeat(np.arange(len(sample)), count)
    to = np.arange(count.sum()) + np.repeat(np.arange(len(sample)), count)
    text = np.zeros(total, np.int32)
    text[to] = np.unique(hashes[source], return_inverse=True)[1] + 1
    holder = np.repeat(np.arange(len(sample)), count + 1)
    index = FMIndex(text, least_doc[holder], several[holder], least)
    _, row = matching_statistics(index, text, begin, end, least)
    owner_at = np.where(row >= 0, index.owner(np.maximum(row, 0)), 0)
    place = np.repeat(begin[of] - bounds[:-1], sizes) + np.arange(len(hashes))
    return row[place] >= 0, owner_at[place]


def _anchor_rows(docs: DataFrame, least: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for s in words.slices(batch.column(2)):
                x = words.scan(s)
                anchor, row, first, last = anchors(x.hash, x.of_row, least)
                if len(anchor):
                    begin, end = x.begin[first], x.end[last]
                    context = words.hashes(s.data, begin, end, _BYTE).view(np.int64)
                    begin, end = begin - s.bounds[row], end - s.bounds[row]
                    yield pa.RecordBatch.from_arrays([anchor, context, ids[s.first + row], keys[s.first + row], begin.astype(np.int32), end.astype(np.int32)], ["anchor", "context", "doc_id", "key", "begin", "end"])

    return docs.mapInArrow(run, "anchor long, context long, doc_id long, key long, begin int, end int")


def _repeated(rows: DataFrame) -> DataFrame:
    """The rows of anchors that occur in two documents or more, by one shuffle; sorts and windows spill to disk.

    ``lead`` marks one row of each distinct context, of its smallest document; ``copied``, that other documents have it too;
    ``contexts`` is the number of distinct ones of the anchor.
    """
    by, of = Window.partitionBy("anchor"), Window.partitionBy("anchor", "context")
    met = rows.withColumn("low", F.min("doc_id").over(by)).withColumn("high", F.max("doc_id").over(by)).filter("low < high").drop("low", "high")
    place = F.row_number().over(of.orderBy("doc_id", "key", "begin"))
    last = F.max("doc_id").over(of.orderBy("doc_id", "key", "begin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    marked = met.withColumn("lead", place == 1).withColumn("copied", last > F.col("doc_id"))
    return marked.withColumn("contexts", F.sum(F.col("lead").cast("int")).over(by))


def _search(contexts: DataFrame, least: int, shard_words: int) -> DataFrame:
    """(anchor, context, begin, end, owner) of the repeated stretches in ``contexts``, in bytes from the context's begin."""

    def found(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        anchor, context, doc, copied = (table[c].to_numpy(zero_copy_only=False) for c in ("anchor", "context", "doc_id", "copied"))
        (s,) = words.slices(table["text"], 1 << 62)
        x = words.scan(s)
        start, owner = repeats_in_shard(x.hash, x.of_row, doc, copied.astype(bool), least)
        start, owner = np.flatnonzero(start), owner[start]
        row = np.searchsorted(x.of_row, start, side="right") - 1
        new = np.flatnonzero(np.r_[len(start) > 0, (start[1:] != start[:-1] + 1) | (row[1:] != row[:-1]) | (owner[1:] != owner[:-1])])
        last = np.r_[new[1:], len(start)][: len(new)] - 1
        r = row[new]
        begin, end = x.begin[start[new]] - s.bounds[r], x.end[start[last] + least - 1] - s.bounds[r]
        return pa.RecordBatch.from_arrays([anchor[r], context[r], begin.astype(np.int32), end.astype(np.int32), owner[new]], ["anchor", "context", "begin", "end", "owner"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            edges = np.flatnonzero(np.diff(anchor := batch.column(0).to_numpy(zero_copy_only=False))) + 1
            if held and batch.num_rows and held[-1].column(0)[-1].as_py() != anchor[0]:
                edges = np.r_[0, edges]
            at = 0
            for edge in edges:
                part = batch.slice(at, edge - at)
                if size + batch.column(4).slice(at, edge - at).nbytes >= 6 * shard_words:
                    yield found(pa.Table.from_batches([*held, part]))
                    held, size, at = [], 0, edge
            if at < batch.num_rows:
                held.append(batch.slice(at))
                size += batch.column(4).slice(at).nbytes
        if held:
            yield found(pa.Table.from_batches(held))

    sorted_ = contexts.select("anchor", "context", "doc_id", "copied", "text").repartition("anchor").sortWithinPartitions("anchor")
    return sorted_.mapInArrow(run, "anchor long, context long, begin int, end int, owner long")


def _windows(texts: DataFrame, least: int) -> DataFrame:
    """(window, doc_id, key, begin, end) of every window of ``least`` words in the ``places`` of the texts."""

    def run(batches):
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for i in range(batch.num_rows):
                data, places = batch.column(2)[i].as_py().encode(), batch.column(3)[i].as_py()
                for part in words.slices(pa.array([data[p["begin"] : p["end"]] for p in places], pa.binary())):
                    x = words.scan(part)
                    window = words.grams(x.hash, least).view(np.int64)
                    row = np.repeat(np.arange(part.count), np.diff(x.of_row))
                    at = np.flatnonzero(row[: len(window)] == row[least - 1 :]) if len(window) else np.zeros(0, np.int64)
                    shift = np.array([p["begin"] for p in places[part.first : part.first + part.count]], np.int64) - part.bounds[:-1]
                    begin, end = x.begin[at] + shift[row[at]], x.end[at + least - 1] + shift[row[at]]
                    yield pa.RecordBatch.from_arrays([window[at], np.full(len(at), ids[i]), np.full(len(at), keys[i]), begin.astype(np.int32), end.astype(np.int32)], ["window", "doc_id", "key", "begin", "end"])

    return texts.mapInArrow(run, "window long, doc_id long, key long, begin int, end int")


def _pieces(docs: DataFrame, least: int, shard_words: int, most_contexts: int) -> DataFrame:
    """(doc_id, key, begin, end, later) of repeated stretches; ``later`` where a smaller ``doc_id`` has them too."""
    if not 2 <= least <= DEPTH:
        raise ValueError(f"least must lie between 2 and {DEPTH}")
    whole = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    rows = stored(_repeated(_anchor_rows(whole, least)), "anchored")
    few = rows.filter(F.col("contexts") <= most_contexts)
    place = F.struct("anchor", "context", "copied", "begin", "end")
    leads = few.filter("lead").groupBy("doc_id", "key").agg(F.collect_list(place).alias("places"))
    bytes_ = F.expr("cast(substring(cast(text as binary), at.begin + 1, at.end - at.begin) as string)")
    contexts = whole.join(leads, ["doc_id", "key"]).select("doc_id", "text", F.explode("places").alias("at")).select("at.anchor", "at.context", "doc_id", "at.copied", bytes_.alias("text"))
    found = _search(contexts, least, shard_words).withColumnsRenamed({"begin": "from", "end": "to"})
    pieces = few.join(found, ["anchor", "context"]).select("doc_id", "key", (F.col("begin") + F.col("from")).alias("begin"), (F.col("begin") + F.col("to")).alias("end"), (F.col("owner") != F.col("doc_id")).alias("later"))
    many = rows.filter(F.col("contexts") > most_contexts)
    if many.isEmpty():
        return pieces
    places = many.groupBy("doc_id", "key").agg(F.collect_set(F.struct("begin", "end")).alias("places"))
    low, high = (f("doc_id").over(Window.partitionBy("window")) for f in (F.min, F.max))
    hot = _windows(whole.join(places, ["doc_id", "key"]), least).withColumn("low", low).withColumn("high", high).filter("low < high")
    return pieces.unionByName(hot.select("doc_id", "key", "begin", "end", (F.col("low") < F.col("doc_id")).alias("later")))


def _merged(pieces: DataFrame) -> DataFrame:
    """Overlapping and touching intervals of a document made one."""
    by = Window.partitionBy("doc_id", "key").orderBy("begin", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = pieces.select("doc_id", "key", "begin", "end", (F.coalesce(reach, F.lit(-1)) < F.col("begin")).cast("int").alias("new"))
    run = marked.withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy("doc_id", "key", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("run")


def repeated_intervals(docs: DataFrame, least: int = LEAST, shard_words: int = SHARD_WORDS, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """(doc_id, begin, end): every stretch of a document that repeats in another one."""
    return _merged(_pieces(docs, least, shard_words, most_contexts)).select("doc_id", "begin", "end").distinct()


def remove_repeats(docs: DataFrame, least: int = LEAST, shard_words: int = SHARD_WORDS, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """``docs`` without the passages that a document of smaller ``doc_id`` has as well.

    ``n_chars``, where there is one, follows the text. Documents of which no word is left go.
    """
    later = _merged(_pieces(docs, least, shard_words, most_contexts).filter("later")).groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("cuts"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"))
    joined = whole.join(later, ["doc_id", "key"], "left")
    kept = F.expr(
        "cast(array_join(transform(sequence(0, size(cuts)), i -> cast(substring(cast(row.text as binary), if(i = 0, 0, cuts[greatest(i - 1, 0)].end) + 1,"
        " if(i = size(cuts), octet_length(row.text), cuts[least(i, size(cuts) - 1)].begin) - if(i = 0, 0, cuts[greatest(i - 1, 0)].end)) as string)), '') as string)"
    )
    cut = joined.select("row", "cuts", F.when(F.col("cuts").isNull(), F.col("row.text")).otherwise(kept).alias("kept"))
    out = cut.filter(F.col("cuts").isNull() | F.col("kept").rlike(words.WORD_PATTERN))
    chars = lambda kind: F.when(F.col("cuts").isNull(), F.col("row.n_chars")).otherwise(F.length("kept")).cast(kind)
    changed = {"text": lambda _: F.col("kept"), "n_chars": chars}
    return out.select(*[(changed[c](kind) if c in changed else F.col("row")[c]).alias(c) for c, kind in docs.dtypes])
