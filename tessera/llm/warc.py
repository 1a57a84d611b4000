"""Operator 8: WARC files, written and read sequentially.

Every record is a gzip member of its own. The writer makes one file per task in the
shared folder. The reader gets a table of paths and streams each file: blocks of compressed bytes go through
incremental zlib, a record's header ends at the blank line, its body is framed by Content-Length, and the digest that the
WARC-Block-Digest names (SHA-1, SHA-256 or MD5, in base 32 or hexadecimal) is computed as the body arrives. Memory is one record, whatever
the file's size. After damage the reader goes back to one byte behind the damaged member's begin and looks for the next that opens, however
long that member was.

``read`` gives the pages: ``resource`` records as they are, and the payloads of ``response`` records, behind their HTTP header. ``listed`` gives
every record of any type, ``request``, ``warcinfo`` and others included.

Defined results: nulls in ``page_id``, ``url`` and ``html`` come back as nulls (a header in JSON carries the columns
exactly, so that line ends or any other character in a url survive); files of other writers have no such header, so ``page_id`` is null there and the url is
the target's; an empty or null html is a record with an empty body; a digest that
differs, a body cut short, a Content-Length that is no number or columns that are no JSON object give ``verified`` false, a record without a digest null. Bytes
of a page that are not UTF-8 are replaced by U+FFFD; ``sha1`` and ``n_bytes`` are those of the bytes read. Damaged bytes are skipped up to the next member that
opens. Repeated pages are records each, of any length. Other columns are not written; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._shared import filesystem, fresh_path, stored

BLOCK = 1 << 16
LEVEL = 4
SCHEMA = "page_id long, url string, html string, n_bytes long, sha1 string, verified boolean"
_MAGIC = b"\x1f\x8b\x08"


def digest(body: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()


def member(kind: str, uri: str, body: bytes, columns: dict, level: int = LEVEL) -> bytes:
    """One record as a gzip member."""
    name = uuid.UUID(bytes=hashlib.md5(json.dumps([uri, columns]).encode() + hashlib.sha1(body).digest()).digest())
    safe = "".join(c if c.isprintable() and not c.isspace() else "%%%02X" % (ord(c) & 255) for c in uri)
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {safe}",
        "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", f"WARC-Block-Digest: {digest(body)}", "X-Columns: " + json.dumps(columns),
    ]
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + pack.flush()


def written(pages: DataFrame, folder: str, level: int = LEVEL) -> DataFrame:
    """Writes ``pages`` to WARC files in ``folder``; (path, records, bytes) of each. A task that runs again replaces its file."""

    def run(batches):
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        context = TaskContext.get()
        name, draft = f"part-{context.partitionId():06d}.warc.gz", f"{root}/_part-{context.taskAttemptId()}-{uuid.uuid4().hex}"
        records = size = 0
        with fs.open_output_stream(draft, compression=None) as out:
            for batch in batches:
                for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                    data = member("resource", url or "", (html or "").encode(), {"page_id": page_id, "url": url, "null": html is None}, level)
                    out.write(data)
                    records, size = records + 1, size + len(data)
        if records:
            fs.move(draft, f"{root}/{name}")
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "records": records, "bytes": size}])
        else:
            fs.delete_file(draft)

    files = pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "path string, records long, bytes long")
    return stored(files, "warc-files")


class Framer:
    """One record, from the plain bytes of its member as they arrive."""

    def __init__(self):
        self.head, self.headers, self.body, self.tail = bytearray(), None, [], b""
        self.size, self.left, self.sum, self.wanted = -1, 0, None, ""

    def feed(self, data: bytes) -> None:
        if self.headers is None:
            seen = max(0, len(self.head) - 3)
            self.head += data
            gap = self.head.find(b"\r\n\r\n", seen)
            if gap < 0:
                return
            data = bytes(self.head[gap + 4 :])
            self._begin(bytes(self.head[:gap]))
        taken = data if self.size < 0 else data[: self.left]
        if taken:
            self.left -= len(taken)
            self.body.append(taken)
            if self.sum:
                self.sum.update(taken)
        self.tail = (self.tail + data[len(taken) :])[:5]

    def _begin(self, head: bytes) -> None:
        self.head = bytearray(head[:5])
        lines = head.decode("utf-8", "replace").split("\r\n")
        self.headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        if re.fullmatch("[0-9]{1,18}", self.headers.get("content-length", "")):
            self.size = self.left = int(self.headers["content-length"])
        name, _, self.wanted = self.headers.get("warc-block-digest", "").partition(":")
        name = name.lower().replace("-", "")
        self.sum = hashlib.new(name) if name in ("sha1", "sha256", "md5") else None

    def record(self, whole: bool) -> Iterator[tuple[dict[str, str], bytes, bool | None]]:
        """(headers, body, whether length and digest are right: null without a digest), or nothing if no record began."""
        if self.headers is None or self.head != b"WARC/":
            return
        good = whole and self.size >= 0 and self.left == 0 and self.tail == b"\r\n\r\n"
        if good and "warc-block-digest" in self.headers:
            good = self.sum is not None and self.wanted.lower().rstrip("=") in (self.sum.hexdigest(), base64.b32encode(self.sum.digest()).decode().lower().rstrip("="))
        elif good:
            good = None
        yield self.headers, b"".join(self.body), good


def records(stream: BinaryIO, block: int = BLOCK) -> Iterator[tuple[dict[str, str], bytes, bool | None]]:
    """(headers, body, verified) of each record in a file of compressed members."""
    start, ahead, read = 0, b"", 0
    while True:
        unzip, frame, whole = zlib.decompressobj(31), Framer(), True
        try:
            while not unzip.eof:
                piece = ahead or stream.read(block)
                if not piece:
                    break
                read, ahead = read + len(piece) - len(ahead), b""
                frame.feed(unzip.decompress(piece, 1 << 20))
                while unzip.unconsumed_tail and not unzip.eof:
                    frame.feed(unzip.decompress(unzip.unconsumed_tail, 1 << 20))
        except zlib.error:
            whole = False
        if whole and unzip.eof:
            yield from frame.record(True)
            ahead = unzip.unused_data
            start = read - len(ahead)
            continue
        if whole and start == read:
            return
        yield from frame.record(False)
        start = _next_member(stream, start + 1, block)
        if start < 0:
            return
        stream.seek(start)
        ahead, read = b"", start


def _next_member(stream: BinaryIO, at: int, block: int) -> int:
    """Where the next gzip member seems to begin, from ``at`` on; -1 for nowhere."""
    stream.seek(at)
    held = b""
    while piece := stream.read(max(block, 64)):
        held += piece
        found = held.find(_MAGIC)
        if found >= 0:
            return at + found
        at, held = at + max(0, len(held) - 2), held[-2:]
    return -1


def _of_files(paths: DataFrame, row, block: int, schema: str, names: list[str], kinds: tuple) -> DataFrame:
    """``row`` of (path, headers, body, verified), where it isn't null, for every record; one file per task."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = filesystem(path)
                with fs.open_input_file(name) as stream:
                    rows, held = [], 0
                    for headers, body, good in records(stream, block):
                        if (made := row(path, headers, body, good)) is not None:
                            rows.append(made)
                            held += len(body)
                        if held > 1 << 22 or len(rows) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return paths.select("path").repartition(max(1, paths.count()), "path").mapInArrow(run, schema)


def _page(path: str, headers: dict[str, str], body: bytes, good: bool | None) -> tuple | None:
    kind = headers.get("warc-type")
    if kind not in ("resource", "response"):
        return None
    if kind == "response" and body.startswith(b"HTTP/"):
        body = body.partition(b"\r\n\r\n")[2]
    try:
        columns = json.loads(headers.get("x-columns", "{}"))
    except ValueError:
        columns = None
    page_id = columns.get("page_id") if isinstance(columns, dict) else None
    if not isinstance(columns, dict) or not (page_id is None or type(page_id) is int and -(1 << 63) <= page_id < 1 << 63) or not isinstance(columns.get("url"), str | None):
        columns, page_id, good = {}, None, False
    url = columns["url"] if "url" in columns else headers.get("warc-target-uri")
    return page_id, url, None if columns.get("null") else body.decode("utf-8", "replace"), len(body), hashlib.sha1(body).hexdigest(), good


def read(spark: SparkSession, paths: DataFrame, block: int = BLOCK) -> DataFrame:
    """The pages in the files of ``paths`` (path string)."""
    names = ["page_id", "url", "html", "n_bytes", "sha1", "verified"]
    return _of_files(paths, _page, block, SCHEMA, names, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()))


def listed(spark: SparkSession, paths: DataFrame, block: int = BLOCK) -> DataFrame:
    """(path, type, uri, n_bytes, verified) of every record in the files of ``paths`` (path string)."""
    row = lambda path, headers, body, good: (path, headers.get("warc-type"), headers.get("warc-target-uri"), len(body), good)
    return _of_files(paths, row, block, "path string, type string, uri string, n_bytes long, verified boolean", ["path", "type", "uri", "n_bytes", "verified"], (pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_()))


def round_trip(pages: DataFrame) -> DataFrame:
    """``pages`` written to WARC files in the shared folder and read from them."""
    folder = fresh_path(pages.sparkSession, "warc")
    return read(pages.sparkSession, written(pages, folder))


SQL = "SELECT page_id, url, html, octet_length(encode(coalesce(html, ''))) AS n_bytes, sha1(coalesce(html, '')) AS sha1, true AS verified FROM pages"
