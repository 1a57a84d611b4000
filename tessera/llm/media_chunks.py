"""Operator 1: media columns as content-defined chunks.

A rolling gear hash over the payload's bytes cuts it where the hash's top bits are zero, between ``least`` and ``most``
bytes from the last cut, so an insertion moves only the cuts beside it. Every chunk has a SHA-256 digest.

Payloads are written once, without a shuffle: each task appends the chunks it hasn't met to a pack
file in the shared folder, compressed one by one. What is shuffled is metadata only: the *manifest* (ordered
chunk digests of each medium) and the chunks' places. A Spark aggregation keeps one place per digest over all packs, a join
gives each manifest its places, and the ordered list is read back from the packs, neighbouring chunks by one ranged read, joined, and verified by the
digests of the chunks and of the whole medium. Media are spread for that by ranges of their first chunk's place and their number, so
those that share a first chunk are spread too. A chunk met by several tasks is in several packs, of which one copy is
referenced; ``unreferenced`` lists the others for a later compaction.

Defined results: a null payload is null again, an empty one empty, both without chunks and ``verified``; ids may be null or
repeat, every row is a medium; a lost or damaged chunk gives ``verified`` false. Payloads are chunked whole at any length. Columns are found by name;
other columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import bisect
import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _words as words
from tessera.llm._shared import filesystem, fresh_path, stored

LEAST, MOST, BITS = 512, 16384, 11
GAP, AT_ONCE, PER_TASK = 1 << 14, 1 << 22, 1 << 24
GEAR = (words.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def cut_points(data: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places after which the gear hash of the last 32 bytes allows a cut."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            h[k:] += h[:-k] << np.uint32(k)
    return np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1


def cuts(points: list[int], begin: int, end: int, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of data[begin:end]."""
    out, at = [], begin
    while at < end:
        i = bisect.bisect_left(points, at + least)
        stop = min(points[i] if i < len(points) else end, at + most, end)
        out.append(stop)
        at = stop
    return out


def chunked(media: DataFrame, folder: str, least: int = LEAST, most: int = MOST, bits: int = BITS) -> DataFrame:
    """Packs the payloads of ``media`` (id, payload binary); one row per medium with its chunks' digests and places."""

    def run(batches):
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        context = TaskContext.get()
        pack, draft = f"pack-{context.partitionId():06d}", f"{root}/_pack-{context.taskAttemptId()}-{uuid.uuid4().hex}"
        known: dict[bytes, tuple[int, int]] = {}
        offset, number = 0, context.partitionId() << 40
        with fs.open_output_stream(draft, compression=None) as out:
            for batch in batches:
                ids, column = batch.column(0).to_pylist(), batch.column(1)
                missing = column.is_null().to_pylist()
                for s in words.slices(column, 1 << 20):
                    points = cut_points(s.data, bits).tolist()
                    view = memoryview(s.data)
                    rows = []
                    for i in range(s.count):
                        begin, end, chunks, at = int(s.bounds[i]), int(s.bounds[i + 1]), [], int(s.bounds[i])
                        for stop in cuts(points, begin, end, least, most):
                            name = hashlib.sha256(view[at:stop]).digest()
                            if name not in known:
                                packed = zlib.compress(view[at:stop], 1)
                                out.write(packed)
                                known[name] = (offset, len(packed))
                                offset += len(packed)
                            place, size = known[name]
                            chunks.append({"digest": name, "pack": f"{folder}/{pack}", "offset": place, "packed": size})
                            at = stop
                        gone = missing[s.first + i]
                        rows.append({"medium": number, "id": ids[s.first + i], "n_bytes": None if gone else end - begin, "sha256": None if gone else hashlib.sha256(view[begin:end]).hexdigest(), "chunks": chunks})
                        number += 1
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
        fs.move(draft, f"{root}/{pack}")

    return stored(media.select(F.col("id").cast("long"), F.col("payload").cast("binary")).mapInArrow(run, _SCHEMA), "manifest")


_SCHEMA = "medium long, id long, n_bytes long, sha256 string, chunks array<struct<digest: binary, pack: string, offset: long, packed: long>>"
_ARROW = pa.schema([("medium", pa.int64()), ("id", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.string()), ("chunks", pa.list_(pa.struct([("digest", pa.binary()), ("pack", pa.string()), ("offset", pa.int64()), ("packed", pa.int64())])))])


def _places(manifest: DataFrame) -> DataFrame:
    return manifest.select("medium", F.posexplode("chunks").alias("place", "c")).select("medium", "place", "c.*")


def chunk_store(manifest: DataFrame) -> DataFrame:
    """(digest, pack, offset, packed): the one copy of each chunk that is referenced."""
    return _places(manifest).groupBy("digest").agg(F.min(F.struct("pack", "offset", "packed")).alias("at")).select("digest", "at.*")


def unreferenced(manifest: DataFrame) -> DataFrame:
    """(digest, pack, offset, packed): copies that no manifest needs after deduplication."""
    return _places(manifest).select("digest", "pack", "offset", "packed").distinct().join(chunk_store(manifest), ["digest", "pack", "offset"], "left_anti")


def reconstructed(manifest: DataFrame) -> DataFrame:
    """(id, payload, n_bytes, sha256, verified) of every medium, read from the deduplicated chunks."""
    store = chunk_store(manifest).withColumnRenamed("packed", "size")
    placed = _places(manifest).select("medium", "place", "digest").join(store, "digest")
    lists = placed.groupBy("medium").agg(F.sort_array(F.collect_list(F.struct("place", "digest", "pack", "offset", "size"))).alias("list"))
    first = F.get("list", F.lit(0))
    ordered = manifest.select("medium", "id", "n_bytes", "sha256").join(lists, "medium", "left").select("*", first["pack"].alias("near"), first["offset"].alias("at"))

    def run(batches):
        open_: dict[str, object] = {}

        def read(pack: str, begin: int, size: int) -> bytes:
            if pack not in open_:
                if len(open_) >= 64:
                    open_.pop(next(iter(open_))).close()
                fs, name = filesystem(pack)
                open_[pack] = fs.open_input_file(name)
            return open_[pack].read_at(size, begin)

        try:
            for batch in batches:
                rows, held = [], 0
                for k in range(batch.num_rows):
                    row = {name: batch.column(name)[k].as_py() for name in ("id", "n_bytes", "sha256", "list")}
                    parts, good = [], True
                    for run_ in together(row["list"] or ()):
                        begin, end = run_[0]["offset"], run_[-1]["offset"] + run_[-1]["size"]
                        try:
                            data = read(run_[0]["pack"], begin, end - begin)
                        except OSError:
                            data = b""
                        for c in run_:
                            try:
                                part = zlib.decompress(data[c["offset"] - begin : c["offset"] - begin + c["size"]])
                                good &= hashlib.sha256(part).digest() == c["digest"]
                                parts.append(part)
                            except zlib.error:
                                good = False
                    payload = None if row["sha256"] is None else b"".join(parts)
                    good &= payload is None or hashlib.sha256(payload).hexdigest() == row["sha256"]
                    rows.append({"id": row["id"], "payload": payload, "n_bytes": row["n_bytes"], "sha256": row["sha256"], "verified": good})
                    held += len(payload or b"")
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_pylist(rows, schema=_OUT)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_OUT)
        finally:
            for f in open_.values():
                f.close()

    by = ("near", "at", "medium")
    tasks = -(-(manifest.agg(F.sum("n_bytes")).first()[0] or 1) // PER_TASK)
    return stored(ordered, "ordered").repartitionByRange(tasks, *by).sortWithinPartitions(*by).mapInArrow(run, "id long, payload binary, n_bytes long, sha256 string, verified boolean")


def together(chunks: list[dict]) -> list[list[dict]]:
    """Consecutive chunks in runs that one read of a pack can fetch: in order, with small gaps, not too long."""
    out: list[list[dict]] = []
    for c in chunks:
        last = out[-1][-1] if out else None
        if last and c["pack"] == last["pack"] and 0 <= c["offset"] - last["offset"] - last["size"] <= GAP and c["offset"] + c["size"] - out[-1][0]["offset"] <= AT_ONCE:
            out[-1].append(c)
        else:
            out.append([c])
    return out


_OUT = pa.schema([("id", pa.int64()), ("payload", pa.binary()), ("n_bytes", pa.int64()), ("sha256", pa.string()), ("verified", pa.bool_())])


def round_trip(media: DataFrame, **sizes: int) -> DataFrame:
    """``media`` (id, payload) chunked into packs in the shared folder and put together again."""
    return reconstructed(chunked(media, fresh_path(media.sparkSession, "packs"), **sizes))


SQL = "SELECT page_id, html, octet_length(encode(html)) AS n_bytes, sha256(html) AS sha256, true AS verified FROM pages"
