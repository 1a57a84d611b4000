"""Operators 1, 8 and 9: exact round trips."""

import base64
import hashlib
import io
import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import _bpe, _shared, media_chunks, token_ids, warc


def payloads():
    rng = random.Random(1)
    shared = rng.randbytes(40_000)
    return [(1, shared), (2, b"x" + shared), (3, shared[:20_000] + b"!" + shared[20_000:]), (4, b""), (5, None), (None, b"abc"), (1, shared), (6, b"\0" * 100_000), (7, rng.randbytes(300))]


def test_media_round_trip(spark):
    df = spark.createDataFrame(payloads(), "id long, payload binary").repartition(3)
    manifest = media_chunks.chunked(df, _shared.fresh_path(spark, "packs"))
    got = media_chunks.reconstructed(manifest).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, bytes(r[1] or b""))
    assert sorted(((r.id, None if r.payload is None else bytes(r.payload)) for r in got), key=key) == sorted(payloads(), key=key)
    assert all(r.verified for r in got)
    store = media_chunks.chunk_store(manifest)
    assert store.count() == store.select("digest").distinct().count()
    assert store.count() < manifest.selectExpr("explode(chunks)").count()


def test_media_columns_by_name_and_large_payloads(spark):
    large = random.Random(5).randbytes(3_500_000)
    rows = [("kind", large, i, b"__") for i in range(3)] + [("kind", large[:40_000] + b"%d" % i, 10 + i, b"__") for i in range(20)]
    df = spark.createDataFrame(rows, "kind string, payload binary, id long, digest binary").repartition(2)
    got = {r.id: bytes(r.payload) for r in media_chunks.round_trip(df).collect() if r.verified}
    assert got == {i: data for _, data, i, _ in rows}


def test_neighbouring_chunks_are_read_together():
    at = lambda pack, offset, size: {"pack": pack, "offset": offset, "size": size}
    chunks = [at("a", 0, 10), at("a", 10, 5), at("a", 20, 5), at("a", 5, 5), at("b", 10, 1), at("b", 10 + (1 << 22), 9)]
    assert [len(x) for x in media_chunks.together(chunks)] == [3, 1, 1, 1] and media_chunks.together([]) == []


def test_media_that_share_a_first_chunk_are_spread(spark):
    shared = random.Random(8).randbytes(60_000)
    df = spark.createDataFrame([(i, shared + b"%d" % i) for i in range(2000)], "id long, payload binary").repartition(4)
    out = media_chunks.round_trip(df, least=4096, most=16384)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 2000 and max(sizes) < 1500


def test_damaged_chunk_is_not_verified(spark):
    folder = _shared.fresh_path(spark, "packs")
    manifest = media_chunks.chunked(spark.createDataFrame([(1, b"q" * 5000)], "id long, payload binary").coalesce(1), folder)
    path = _shared.filesystem(manifest.first().chunks[0].pack)[1]
    data = bytearray(open(path, "rb").read())
    data[len(data) // 2] ^= 255
    open(path, "wb").write(data)
    assert [r.verified for r in media_chunks.reconstructed(manifest).collect()] == [False]


def test_cuts_equal_a_byte_by_byte_gear_hash():
    data = np.frombuffer(random.Random(2).randbytes(30_000), np.uint8)
    points = media_chunks.cut_points(data).tolist()
    want, h = [], 0
    for i, b in enumerate(data):
        h = ((h << 1) + int(media_chunks.GEAR[b])) & 0xFFFFFFFF
        if h >> (32 - media_chunks.BITS) == 0:
            want.append(i + 1)
    assert points == want
    ends = media_chunks.cuts(points, 0, len(data))
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes.max() <= media_chunks.MOST and sizes[:-1].min() >= media_chunks.LEAST


def test_empty_tables(spark):
    assert media_chunks.round_trip(spark.createDataFrame([], "id long, payload binary")).count() == 0
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert token_ids.located(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_warc_round_trip(spark):
    pages = [(1, "http://a/é?x=%20", "<p>ü</p>"), (2, None, None), (None, "u\r\nWARC-Type: x", ""), (1, "http://a/é?x=%20", "<p>ü</p>"), (3, "h", "a\r\n\r\nb" * 90_000)]
    df = spark.createDataFrame([(*p, 0) for p in pages], "page_id long, url string, html string, sha1 int").repartition(2)
    got = warc.round_trip(df).collect()
    assert sorted(((r.page_id, r.url, r.html) for r in got), key=repr) == sorted(pages, key=repr)
    assert all(r.verified for r in got)


def test_warc_reader_survives_damage():
    good = [warc.member("resource", f"u{i}", b"body%d" % i * 50, {"page_id": i}) for i in range(4)]
    broken = bytearray(good[1])
    broken[len(broken) // 2] ^= 255
    wrong = warc.member("resource", "w", b"abc", {"page_id": 9}).replace(b"", b"")
    text = zlib.decompress(wrong, 31).replace(b"\r\n\r\nabc", b"\r\n\r\nabd")
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    wrong = pack.compress(text) + pack.flush()
    stream = good[0] + bytes(broken) + good[2] + b"noise" + wrong + good[3] + good[0][:-20]
    for size in (1, 7, 1000, len(stream)):
        found = [(b, ok) for _, b, ok in warc.records(io.BytesIO(stream), size)]
        sound = [b for b, ok in found if ok]
        assert sound == [b"body0" * 50, b"body2" * 50, b"body3" * 50]
        assert (b"abd", False) in found
    assert warc.digest(b"x") == "sha1:" + base64.b32encode(hashlib.sha1(b"x").digest()).decode()


def packed(head: list[str], body: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(["WARC/1.0", *head]).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + pack.flush()


def test_warc_files_of_other_writers(spark, tmp_path):
    page, http = "<p>\u00fc</p>".encode(), b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    sized = lambda b: f"Content-Length: {len(b)}"
    digest = "WARC-Block-Digest: sha256:" + hashlib.sha256(http + page).hexdigest()
    members = [
        packed(["WARC-Type: warcinfo", sized(b"software: x")], b"software: x"),
        packed(["WARC-Type: request", "WARC-Target-URI: http://a/", sized(b"GET / HTTP/1.1\r\n\r\n")], b"GET / HTTP/1.1\r\n\r\n"),
        packed(["WARC-Type: response", "WARC-Target-URI: http://a/", digest, sized(http + page)], http + page),
        packed(["WARC-Type: response", "WARC-Target-URI: http://b/", "WARC-Block-Digest: " + warc.digest(b"other"), sized(http)], http),
        packed(["WARC-Type: resource", "Content-Length: \u00b2"], b"ab"), packed(["WARC-Type: resource", sized(b"cd"), "X-Columns: [1]"], b"cd"),
        packed(["WARC-Type: resource", sized(b"ef"), "X-Columns: " + json.dumps({"page_id": "x", "url": 3})], b"ef"), packed(["WARC-Type: resource", "WARC-Target-URI: u", sized(b"\xff")], b"\xff"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(members))
    paths = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz", 1)], "path string, sha1 int")
    got = [(r.page_id, r.url, r.html, r.verified) for r in warc.read(spark, paths).collect()]
    assert got == [(None, "http://a/", "<p>\u00fc</p>", True), (None, "http://b/", "", False), (None, None, "ab\r\n\r\n", False), (None, None, "cd", False), (None, None, "ef", False), (None, "u", "\ufffd", None)]
    assert [r.type for r in warc.listed(spark, paths).collect()] == ["warcinfo", "request", "response", "response", *["resource"] * 4]


def test_warc_recovers_behind_a_large_damaged_member():
    large = bytearray(warc.member("resource", "big", random.Random(3).randbytes(20 << 20), {"page_id": 0}, 0))
    large[-5000] ^= 255
    inside = warc.member("resource", "in", b"inner", {"page_id": 1})
    large[1000 : 1000 + len(inside)] = inside
    found = [(h["warc-target-uri"], ok) for h, _, ok in warc.records(io.BytesIO(bytes(large) + warc.member("resource", "u", b"behind", {"page_id": 2})))]
    assert [uri for uri, ok in found if ok] == ["in", "u"]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash_is_minimal(n):
    keys = np.arange(n, dtype=np.int64) * 7919 - 5
    hashes = token_ids.key_hash(keys)
    function = token_ids.PerfectHash.build(hashes)
    assert sorted(function.slots(hashes).tolist()) == list(range(n))


def test_index_turns_foreign_keys_away():
    keys = np.arange(2000, dtype=np.int64)
    index = token_ids.ShardIndex.load(token_ids.ShardIndex.build(keys, keys * 0, keys * 2, keys * 0 + 3).save())
    assert index.find(keys)[1].tolist() == [1] * 2000
    assert index.find(keys + 10_000)[1].sum() == 0


def test_ids_round_trip(spark):
    texts = [(1, "Héllo wörld, it's 42!"), (2, ""), (3, None), (4, "<|endoftext|> " * 5), (5, "word " * 30_000), (5, "another"), (None, "lost"), (6, "\U0001f600\n\n x")]
    df = spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id long, text string, slot int").repartition(3)
    folder = _shared.fresh_path(spark, "ids")
    rows = token_ids.located(df, keys_per_index=2, folder=folder).collect()
    encoding = _bpe.encoding(token_ids.TOKENIZER)
    got = sorted((r.doc_id, encoding.decode(token_ids.ids_at(folder, r.shard, r.byte_offset, r.n_tokens).tolist())) for r in rows)
    assert got == sorted((i, t or "") for i, t in texts if i is not None)
    unknown = token_ids.looked_up(spark.range(100, 200).withColumnRenamed("id", "doc_id"), folder, 3)
    assert unknown.count() == 0
