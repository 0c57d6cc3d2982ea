"""WARC derivatives: metadata and plain-text conversion records made from response records.

Each response gives one metadata record (JSON: the source record's headers, the HTTP status line and
headers, title and links) and one conversion record (the visible text). Both refer to the response
by WARC-Refers-To, keep its target URI and date, and name each other by WARC-Concurrent-To; blocks
carry SHA-1 digests in base 32, as do the source's. Record ids are derived from the source's id, so a
second run gives the same records.

Blocks are bytes. Files go through Spark's own text source, which any store that Spark reaches can
hold: each record is one gzip member, as WARC readers expect, with a mark in its header's extra field
that the text source takes as line separator. So a large file is read in splits, record by record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm.common import field, type_of
from attestra.llm.html_text import Node, render, title_of, tree
from attestra.sources.shared import spread

RECORD = "record_id string, record_type string, target_uri string, warc_date string, headers string, block binary"
END = b"\r\n\r\n"
#: Start of a gzip member whose extra field is the mark. The mark is this module's own.
MARK = b"WS\x0c\x00record:2f6c91"
MEMBER = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + len(MARK).to_bytes(2, "little") + MARK


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def derived_id(source: str, role: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{source}#{role}')}>"


def header_text(fields: list[tuple[str, str]]) -> str:
    """A record's head: the version line and named fields; line ends inside a value become spaces."""
    return "WARC/1.1\r\n" + "\r\n".join(f"{name}: {re.sub(r'[\r\n]+', ' ', value)}" for name, value in fields)


def decoded(raw: bytes) -> str:
    """Header text: UTF-8, or Latin-1 where it is no UTF-8."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def header_fields(head: str) -> list[tuple[str, str]]:
    """Named fields of a head, in order; a line that starts with white space goes on with the one before."""
    out: list[tuple[str, str]] = []
    for line in head.split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def _value(fields: list[tuple[str, str]], name: str) -> str | None:
    return next((v for n, v in fields if n.lower() == name.lower()), None)


def responses(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2025-01-01T00:00:00Z") -> DataFrame:
    """Response records of crawled pages: (id, the fields of RECORD).

    Null markup is an empty body, a null URL an empty target. Pages equal in id, URL and markup have
    equal record ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, url, body in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                raw, url = (body or "").encode(), (url or "")
                whole = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(raw)}\r\n\r\n".encode() + raw
                name = derived_id(f"{key}\n{url}\n{digest(raw)}", "response")
                head = header_text([("WARC-Type", "response"), ("WARC-Record-ID", name), ("WARC-Target-URI", url), ("WARC-Date", date), ("WARC-Payload-Digest", digest(raw)), ("WARC-Block-Digest", digest(whole)), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(whole)))])
                rows.append((name, "response", url, date, head, whole))
            yield _batch(batch.column(0), rows)

    key = field(id_col)
    chosen = spread(pages).select(key.alias("id"), key.cast("string").alias("key"), field(url_col).cast("string").alias("url"), field(html_col).cast("string").alias("html"))
    return chosen.mapInArrow(run, f"id {type_of(pages, id_col)}, {RECORD}").withColumnRenamed("id", id_col)


def _batch(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, pa.binary() if k == 5 else pa.string()) for k, c in enumerate(zip(*rows, strict=True) if rows else [[]] * 6)]
    return pa.RecordBatch.from_arrays([ids, *columns], names=["id", "record_id", "record_type", "target_uri", "warc_date", "headers", "block"])


def _links(root: Node) -> list[dict[str, str]]:
    """Targets of links and embedded content, in document order."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if "=" in node.attrs:
            for name in ("href", "src"):
                if name in node.attrs and (target := node.get(name)):
                    out.append({"path": f"{node.tag.upper()}@/{name}", "url": target})
        stack += [k for k in reversed(node.kids) if isinstance(k, Node)]
    return out


def _body_text(raw: bytes, content_type: str) -> str:
    """A body in the character set that its type names, UTF-8 otherwise; bytes that do not fit are replaced."""
    named = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", content_type, re.I)
    try:
        return raw.decode(named[1] if named else "utf-8", "replace")
    except LookupError:
        return raw.decode("utf-8", "replace")


def _pairs(fields: list[tuple[str, str]]) -> list[dict[str, str]]:
    """Headers in order; a name may occur several times."""
    return [{"name": n, "value": v} for n, v in fields]


def derive_one(head: str, block: bytes) -> tuple[tuple, tuple]:
    """The metadata and the conversion record of one response record."""
    source = header_fields(head)
    name, target, date = (_value(source, x) or "" for x in ("WARC-Record-ID", "WARC-Target-URI", "WARC-Date"))
    http, _, body = block.partition(END)
    status, *lines = decoded(http).split("\r\n")
    fields = header_fields("\r\n".join(["", *lines]))
    content_type = _value(fields, "Content-Type") or ""
    kind = content_type.partition(";")[0].strip().lower()
    root = tree(_body_text(body, content_type)) if kind in ("text/html", "application/xhtml+xml", "") else None
    text = render(root) if root else _body_text(body, content_type) if kind.startswith("text/") else ""
    ids = {role: derived_id(name, role) for role in ("metadata", "conversion")}
    envelope = {
        "Envelope": {
            "WARC-Header-Metadata": _pairs(source), "Payload-Metadata": {
                "HTTP-Response-Metadata": {"Response-Message": status, "Headers": _pairs(fields), "HTML-Metadata": {"Head": {"Title": root and title_of(root)}, "Links": _links(root) if root else []}},
                "Actual-Payload-Digest": digest(body), "Actual-Block-Digest": digest(block), "Actual-Content-Length": len(body),
            },
        },
        "Conversion-Record-ID": ids["conversion"],
    }

    def record(role: str, kind: str, content: str, other: str) -> tuple:
        raw = content.encode()
        fields = [("WARC-Type", role), ("WARC-Record-ID", ids[role]), ("WARC-Refers-To", name), ("WARC-Concurrent-To", ids[other]), ("WARC-Target-URI", target), ("WARC-Date", date), ("WARC-Block-Digest", digest(raw)), ("Content-Type", kind), ("Content-Length", str(len(raw)))]
        return ids[role], role, target, date, header_text(fields), raw

    return record("metadata", "application/json", json.dumps(envelope, ensure_ascii=False), "conversion"), record("conversion", "text/plain; charset=utf-8", text, "metadata")


def derive(records: DataFrame, *, id_col: str = "page_id") -> DataFrame:
    """(id, the fields of RECORD): a metadata and a conversion record for every response in ``records``.

    Records of other types and those without headers are passed over; a null block counts as empty.
    Repeated responses give repeated records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x for head, block in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True) for x in derive_one(head, block or b"")]
            yield _batch(batch.column(0).take(pa.array([k for k in range(batch.num_rows) for _ in range(2)], pa.int64())), rows)

    chosen = records.where("record_type = 'response' and headers is not null").select(field(id_col).alias("id"), "headers", "block")
    return chosen.mapInArrow(run, f"id {type_of(records, id_col)}, {RECORD}").withColumnRenamed("id", id_col)


def member(head: str, block: bytes) -> bytes:
    """A record as one gzip member that ends in a zero byte, as sizes under 16 MB do; a larger one is followed by an empty member."""
    whole = head.encode() + END + block + END
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    made = MEMBER + packer.compress(whole) + packer.flush() + zlib.crc32(whole).to_bytes(4, "little") + (len(whole) & 0xFFFFFFFF).to_bytes(4, "little")
    return made if made[-1] == 0 else made + gzip.compress(b"", mtime=0)


def write_files(records: DataFrame, path: str, *, records_a_file: int = 50_000) -> None:
    """Write records as WARC files of one gzip member a record.

    Records without headers are left out, as no reader could part them; a null block is empty. The
    text source ends every row with a separator, here the zero byte that ends a member.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 200):
                batch = whole.slice(k, 200)
                made = [member(head, block or b"")[:-1] for head, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])

    made = records.where("headers is not null").select("headers", F.col("block").cast("binary").alias("block")).mapInArrow(run, "value binary")
    made.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\u0000").option("maxRecordsPerFile", records_a_file).text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files, parted by their Content-Length: (file, the fields of RECORD).

    Files that ``write_files`` made are read in splits. ``*.gz`` files of any maker are unpacked by
    Spark's reader in a stream, one task a file, and ``*.warc`` files are read whole. A file that is
    cut short inside a record, or holds what is no record, fails the read.
    """
    rows = lambda separator, glob: spark.read.option("recursiveFileLookup", "true").option("encoding", "ISO-8859-1").option("lineSep", separator).option("pathGlobFilter", glob).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    own = rows(MEMBER.decode("latin-1"), "*.txt").mapInArrow(_records(_members), f"file string, {RECORD}")
    streams = rows(_VERSION.decode(), "*.gz").mapInArrow(_records(_parted), f"file string, {RECORD}")
    plain = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc").load(path).select(F.col("path").alias("file"), F.col("content").alias("value"))
    plain = plain.mapInArrow(_records(lambda pieces: _parted(x for whole in pieces for x in whole.split(_VERSION))), f"file string, {RECORD}")
    return own.unionByName(streams).unionByName(plain)


#: What every record starts with; the pieces between are a file's rows.
_VERSION = b"WARC/1."


def _records(parser):
    """A function of batches (file, piece) to batches of records; a file's pieces follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ((name, piece or b"") for batch in batches for name, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for name, some in groupby(pieces, key=lambda x: x[0]):
            held: list[tuple] = []
            size = 0
            for record in parser(piece for _, piece in some):
                held.append(record)
                size += len(record[5])
                if len(held) >= 1000 or size > 16 << 20:
                    yield _named(name, held)
                    held, size = [], 0
            if held:
                yield _named(name, held)

    return run


def _named(name: str, rows: list[tuple]) -> pa.RecordBatch:
    made = _batch(pa.array([name] * len(rows)), rows)
    return made.rename_columns(["file", *made.schema.names[1:]])


def _members(pieces: Iterable[bytes]) -> Iterator[tuple]:
    """Records from the pieces between marks. A member's last byte is the row's separator or the reader's."""
    held = b""
    for k, piece in enumerate(pieces):
        if not k and not piece:  # before the first mark
            continue
        held = held + MEMBER + piece if held else piece
        unpacked = zlib.decompressobj(-15)
        try:
            whole = unpacked.decompress(held)
        except zlib.error:
            whole = b""
        if unpacked.eof:
            if len(unpacked.unused_data) < 7 or zlib.crc32(whole) != int.from_bytes(unpacked.unused_data[:4], "little"):
                raise ValueError("a record is cut short")
            yield _one(whole)
            held = b""
    if held:  # a mark inside a record's own bytes parts it, and the next pieces complete it
        raise ValueError("a record is cut short")


def _parted(pieces: Iterable[bytes]) -> Iterator[tuple]:
    """Records from the pieces between version marks, which may occur inside blocks too."""
    held, need = b"", 0
    for k, piece in enumerate(pieces):
        if not k:
            if piece.strip(b"\r\n"):
                raise ValueError("no WARC record at the start")
            continue
        held += _VERSION + piece
        if len(held) < need:
            continue
        if not need:
            head, found, _ = held.partition(END)
            size = _value(header_fields(decoded(head)), "Content-Length") if found else None
            if size is None:
                raise ValueError("no WARC record with a length")
            need = len(head) + len(END) + int(size)
            if len(held) < need:
                continue
        if held[need:].strip(b"\r\n"):
            raise ValueError("no WARC record after a record's end")
        yield _one(held[:need] + END)
        held, need = b"", 0
    if held:
        raise ValueError("a record is cut short")


def _one(whole: bytes) -> tuple:
    """The fields of a record: its head, a blank line, the block, two line ends."""
    head, found, rest = whole.partition(END)
    fields = header_fields(decoded(head))
    size = _value(fields, "Content-Length")
    if not found or not head.startswith(_VERSION) or size is None or len(rest) != int(size) + len(END):
        raise ValueError("no WARC record")
    return (*(_value(fields, x) for x in ("WARC-Record-ID", "WARC-Type", "WARC-Target-URI", "WARC-Date")), decoded(head), rest[: int(size)])
