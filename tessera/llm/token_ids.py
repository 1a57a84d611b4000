"""Operator 9: token ids in binary shards with a minimal perfect hash index.

Each task tokenises its documents and appends the raw little-endian ids (two bytes each while the vocabulary allows) to a
shard of its own in the shared folder, whose first ``HEAD`` bytes tell the width of an id: payloads are never shuffled. Only their places are: by hash of the document key to index partitions,
each of which builds a minimal perfect hash over its keys, in levels of bit vectors with rank counts (as in
BBHash; Limasset et al., 2017). The slot of a key gives, in constant time, a stored fingerprint, by which foreign keys
are turned away, and the shard, offset and length of its ids.

Defined results: a null ``doc_id`` has no key and is left out; a null or empty text is an entry without ids; rows
that repeat a ``doc_id`` are entries each, which the slot lists one after the other. Keys are whole numbers; others are an error of the cast. Texts are
tokenised whole at any length; other columns are not read; an empty table gives an empty one. The tokenizer's file is a parameter and is read where tasks run.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _words as words
from tessera.llm._bpe import encoding, ids_of
from tessera.llm._shared import filesystem, fresh_path, stored

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
KEYS_PER_INDEX = 1_000_000
GAMMA = 2.0
HEAD = 8
_FINGER = np.uint64(0xA24BAED4963EE407)


def key_hash(keys: np.ndarray) -> np.ndarray:
    """A one-to-one hash of 64-bit keys."""
    return words.mix(keys.astype(np.int64).view(np.uint64) ^ np.uint64(0x9FB21C651E98DF25))


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit hashes: level bit vectors and their ranks."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels, self.ranks, total = levels, [], 0
        for bits in levels:
            rank = np.cumsum(np.r_[0, np.bitwise_count(bits).astype(np.int64)]) + total
            self.ranks.append(rank)
            total = int(rank[-1])
        self.size = total

    @staticmethod
    def _place(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        return (words.mix(hashes + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, hashes: np.ndarray, gamma: float = GAMMA) -> PerfectHash:
        levels, left = [], hashes
        while len(left):
            size = max(64, -(-int(gamma * len(left)) // 64) * 64)
            at = cls._place(left, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each hash; -1 where a foreign hash meets no level."""
        out, open_ = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        for level, (bits, rank) in enumerate(zip(self.levels, self.ranks)):
            at = self._place(hashes[open_], level, len(bits) * 64)
            word, bit = bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_[hit]] = (rank[at >> 6] + np.bitwise_count(below))[hit]
            open_ = open_[~hit]
            if not len(open_):
                break
        return out


class ShardIndex:
    """Index partition: the hash, and per slot a fingerprint and the range of the key's entries."""

    def __init__(self, function: PerfectHash, finger: np.ndarray, first: np.ndarray, shard: np.ndarray, offset: np.ndarray, count: np.ndarray):
        self.function, self.finger, self.first, self.shard, self.offset, self.count = function, finger, first, shard, offset, count

    @classmethod
    def build(cls, keys: np.ndarray, shard: np.ndarray, offset: np.ndarray, count: np.ndarray) -> ShardIndex:
        order = np.lexsort((offset, shard, keys))
        keys, shard, offset, count = keys[order], shard[order], offset[order], count[order]
        distinct, first = np.unique(keys, return_index=True)
        hashes = key_hash(distinct)
        function = PerfectHash.build(hashes)
        slot = function.slots(hashes)
        by_slot = np.argsort(slot)
        sizes = np.diff(np.r_[first, len(keys)])[by_slot]
        edge = np.r_[0, np.cumsum(sizes)]
        take = np.repeat(first[by_slot] - edge[:-1], sizes) + np.arange(len(keys))
        finger = (words.mix(hashes ^ _FINGER) >> np.uint64(32)).astype(np.uint32)[by_slot]
        return cls(function, finger, edge, shard[take], offset[take], count[take])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first entry, entries) of each key; no entries for a key whose fingerprint differs."""
        hashes = key_hash(keys)
        slot = self.function.slots(hashes)
        known = slot >= 0
        finger = (words.mix(hashes ^ _FINGER) >> np.uint64(32)).astype(np.uint32)
        known &= len(self.finger) > 0 and self.finger[np.maximum(slot, 0)] == finger
        at = np.where(known, slot, 0)
        return np.where(known, self.first[at], 0), np.where(known, self.first[at + 1] - self.first[at], 0) if len(self.finger) else np.zeros(len(keys), np.int64)

    def save(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, finger=self.finger, first=self.first, shard=self.shard, offset=self.offset, count=self.count, **{f"level{i}": x for i, x in enumerate(self.function.levels)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> ShardIndex:
        x = np.load(io.BytesIO(data))
        levels = [x[f"level{i}"] for i in range(sum(n.startswith("level") for n in x.files))]
        return cls(PerfectHash(levels), x["finger"], x["first"], x["shard"], x["offset"], x["count"])


def _put(folder: str, name: str, write) -> None:
    """Writes a file under a draft's name and then moves it, so that a task which runs again leaves one whole file."""
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    draft = f"{root}/_draft-{uuid.uuid4().hex}"
    with fs.open_output_stream(draft, compression=None) as out:
        write(out)
    fs.move(draft, f"{root}/{name}")


def shards(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Writes the id shards; (doc_id, shard, byte_offset, n_tokens) of every entry."""

    def run(batches):
        kind = np.dtype("<u4" if encoding(tokenizer).max_token_value > 0xFFFF else "<u2")
        shard, rows = TaskContext.get().partitionId(), []

        def write(out) -> None:
            out.write(b"ids" + bytes([kind.itemsize]) + bytes(HEAD - 4))
            offset = HEAD
            for batch in batches:
                keys = batch.column(0).to_numpy(zero_copy_only=False)
                counts = []
                for text in batch.column(1):
                    (ids,) = ids_of(tokenizer, [text.as_py() or ""])
                    out.write(ids.astype(kind).tobytes())
                    counts.append(len(ids))
                edge = np.r_[0, np.cumsum(np.array(counts, np.int64))]
                rows.append((keys.astype(np.int64), offset + edge[:-1] * kind.itemsize, np.diff(edge)))
                offset += int(edge[-1]) * kind.itemsize

        _put(folder, f"ids-{shard:06d}.bin", write)
        if rows:
            keys, offsets, counts = map(np.concatenate, zip(*rows))
            yield pa.RecordBatch.from_arrays([keys, np.full(len(keys), shard, np.int32), offsets, counts], ["doc_id", "shard", "byte_offset", "n_tokens"])

    entries = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, shard int, byte_offset long, n_tokens long")
    return stored(entries, "id-entries")


def indexed(entries: DataFrame, folder: str, keys_per_index: int = KEYS_PER_INDEX) -> int:
    """Builds the index over ``entries`` in ``folder``; the number of its partitions."""
    parts = max(1, -(-entries.count() // keys_per_index))

    def build(table: pa.Table) -> pa.Table:
        column = lambda c: table[c].to_numpy()
        index = ShardIndex.build(column("doc_id"), column("shard"), column("byte_offset"), column("n_tokens"))
        part = table["part"][0].as_py()
        _put(folder, f"index-{part:06d}.npz", lambda out: out.write(index.save()))
        return pa.table({"part": pa.array([part], pa.int32()), "keys": pa.array([index.function.size], pa.int64())})

    placed = entries.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))
    stored(placed.groupBy("part").applyInArrow(build, "part int, keys long"), "index-parts")
    return parts


def looked_up(keys: DataFrame, folder: str, parts: int) -> DataFrame:
    """(doc_id, slot, shard, byte_offset, n_tokens) of the given doc_ids, found through the index; unknown ones give no row."""

    def find(table: pa.Table) -> pa.Table:
        fs, root = filesystem(folder)
        path = f"{root}/index-{table['part'][0].as_py():06d}.npz"
        if fs.get_file_info(path).is_file:
            with fs.open_input_file(path) as f:
                index = ShardIndex.load(f.read())
        else:
            index = ShardIndex.build(*(np.zeros(0, np.int64) for _ in range(4)))
        wanted = table["doc_id"].to_numpy()
        first, count = index.find(wanted)
        at = np.repeat(first - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        slot = np.repeat(index.function.slots(key_hash(wanted)), count)
        return pa.table({"doc_id": np.repeat(wanted, count), "slot": slot, "shard": index.shard[at].astype(np.int32), "byte_offset": index.offset[at], "n_tokens": index.count[at]})

    asked = keys.filter("doc_id is not null").select(F.col("doc_id").cast("long")).distinct()
    return asked.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")).groupBy("part").applyInArrow(find, "doc_id long, slot long, shard int, byte_offset long, n_tokens long")


def ids_at(folder: str, shard: int, byte_offset: int, n_tokens: int) -> np.ndarray:
    """The ids of one entry, by one ranged read, in the width that the shard's head tells."""
    fs, root = filesystem(folder)
    with fs.open_input_file(f"{root}/ids-{shard:06d}.bin") as f:
        head = f.read_at(HEAD, 0)
        if head[:3] != b"ids" or head[3] not in (2, 4):
            raise ValueError(f"shard {shard} is not a shard of ids")
        return np.frombuffer(f.read_at(n_tokens * head[3], byte_offset), f"<u{head[3]}")


def located(docs: DataFrame, tokenizer: str = TOKENIZER, keys_per_index: int = KEYS_PER_INDEX, folder: str | None = None) -> DataFrame:
    """Tokenises ``docs`` into shards, builds the index, and looks every document up in it."""
    folder = folder or fresh_path(docs.sparkSession, "token-ids")
    entries = shards(docs, folder, tokenizer)
    return looked_up(docs.select("doc_id"), folder, indexed(entries, folder, keys_per_index))
