"""Derivatives of WARC responses: linked metadata records and plain-text conversion records.

A response record becomes two records that refer to it by its id, URI and date. The metadata record keeps the
response's HTTP status, all its headers in order and the digests of its block and payload; the conversion record
has the visible text of the page, in UTF-8. Block digests are SHA-1 in base 32, record ids are name-based UUIDs of
the response's id and the kind, so building again gives the same records.

Each response is converted by itself, without a shuffle; write() makes one gzip file per task, a member for each record.

Defined results: a null page has an empty body, a null URL no target URI and an empty name in its id; a response
without a block has an empty one. Repeated rows make equal records. Long pages are converted whole, in time linear in
their length; an open comment, script or tag runs to the end, a head to its end tag or the first text or element that
can't be in a head, and a self-closed svg is empty. A charset that is unknown, or no charset of texts, is taken as UTF-8, and what
it can't read becomes replacement characters. Responses whose block has no blank line are all header. White space and control
characters of a URI are percent-encoded in header fields, as they would end these. An empty table gives no records.
Columns other than the id, URL and page, or RESPONSE's, are not looked at, whatever their names.
"""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import html as entities
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import files

DATE = "2024-01-01T00:00:00Z"
NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:lectern:warc")
#: The digests are the response's own where it has them; else they are computed.
RESPONSE = "record_id string, target_uri string, date string, block binary, block_digest string, payload_digest string"
RECORD = "record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, block_digest string, block binary, headers array<struct<name:string,value:string>>"

#: What a head can hold; all else ends it.
_IN_HEAD = r"""\s++|<!--.*?(?:-->|\Z)|<![^>]*>|<(title|script|style|noscript|template|noframes)\b[^>]*>.*?(?:</\2\s*>|\Z)|</?(?:base|basefont|bgsound|link|meta)\b[^>]*>"""
_HIDDEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<svg\b(?:[^>"']|"[^"]*"|'[^']*')*/>|<(script|style|noscript|template|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)|<head(?![\w-])[^>]*>(?:{_IN_HEAD})*+(?:</head\s*>)?""", re.S | re.I)
_BREAKS = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^>]*>|<![^>]*>|<\?[^>]*>")
_SPACE = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")


_ZEROS, _HUGE = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[0-9]{8,};?")


def plain_text(page: str) -> str:
    """The visible text: hidden parts and tags go, blocks end lines, entities are resolved, white space is single.

    The empty declaration put at the end closes an open tag, so no pattern looks for an end that isn't there.
    """
    text = _TAG.sub("", _BREAKS.sub("\n", _HIDDEN.sub(" ", page + "<!>")))
    text = entities.unescape(_HUGE.sub("\ufffd", _ZEROS.sub("&#", text)))
    return _LINES.sub("\n", _SPACE.sub(" ", text)).strip()


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*names: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, chr(10).join(names))}>"


def split_block(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head and payload."""
    m = re.search(rb"\r?\n\r?\n", block)
    return (block[: m.start()], block[m.end() :]) if m else (block, b"")


def metadata_block(block: bytes, block_digest: str | None = None, payload_digest: str | None = None) -> bytes:
    """Fields of a metadata record: status, headers as they were, and the digests given, else computed."""
    head, payload = split_block(block)
    status, *lines = head.replace(b"\r\n", b"\n").split(b"\n") if head else [b""]
    fields = [b"source-status: " + status, *(b"source-header: " + x for x in lines if x), b"source-payload-length: %d" % len(payload), b"source-payload-digest: " + (payload_digest or digest(payload)).encode(), b"source-block-digest: " + (block_digest or digest(block)).encode()]
    return b"\r\n".join(fields) + b"\r\n"


#: Codecs of Python that are no charsets of pages.
NO_CHARSETS = {"idna", "punycode", "undefined", "unicode_escape", "raw_unicode_escape", "mbcs", "oem"}


def decoded(head: bytes, payload: bytes) -> str:
    """The payload in the charset that the HTTP head names."""
    m = re.search(rb"(?im)^content-type:[^\r\n]*charset=\"?([\w-]+)", head)
    try:
        codec = codecs.lookup(m[1].decode("ascii") if m else "utf-8").name
        return payload.decode("utf-8" if codec.replace("-", "_") in NO_CHARSETS else codec, "replace")
    except (LookupError, ValueError):  # unknown, not of texts, or one that can't replace what it can't read
        return payload.decode("utf-8", "replace")


def _in_field(uri: str | None) -> str | None:
    return uri and re.sub(r"[\x00-\x20\x7f-\x9f\u2028\u2029]", lambda c: "".join(f"%{x:02X}" for x in c[0].encode()), uri)


def derive_one(of: str, uri: str | None, date: str, block: bytes | None, block_digest: str | None = None, payload_digest: str | None = None) -> list[tuple]:
    """The two records of one response, as rows of RECORD."""
    block = block or b""
    head, payload = split_block(block)
    text = plain_text(decoded(head, payload)).encode("utf-8", "replace")
    out, to = [], _in_field(uri)
    for kind, content, body in (("metadata", "application/warc-fields", metadata_block(block, block_digest, payload_digest)), ("conversion", "text/plain; charset=utf-8", text)):
        own, mark = record_id(of, kind), digest(body)
        fields = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", to), ("WARC-Refers-To", of), ("WARC-Refers-To-Target-URI", to), ("WARC-Refers-To-Date", date), ("WARC-Block-Digest", mark), ("Content-Type", content), ("Content-Length", str(len(body)))]
        out.append((kind, own, of, uri, date, content, mark, body, [{"name": k, "value": v} for k, v in fields if v is not None]))
    return out


def responses(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", date: str = DATE) -> DataFrame:
    """Response records of a table of pages: the id column and RESPONSE."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            ids, blocks, marks = [], [], []
            for key, uri, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                body = body or b""
                ids.append(record_id("" if key is None else str(key), uri or "", "response"))
                blocks.append(b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body)
                marks.append((digest(blocks[-1]), digest(body)))
            of_blocks, of_payloads = zip(*marks, strict=True) if marks else ([], [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.string()), b.column(1), pa.array([date] * len(ids), pa.string()), pa.array(blocks, pa.binary()), pa.array(of_blocks, pa.string()), pa.array(of_payloads, pa.string())], names=[id_col, *(x.split()[0] for x in RESPONSE.split(", "))])

    return pages.select(id_col, F.col(url).cast("string").alias("u"), F.encode(F.col(html), "UTF-8").alias("h")).mapInArrow(run, f"`{id_col}` {kind}, {RESPONSE}")


def derive(found: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Two rows (RECORD) for each response, after its id column."""
    kind = found.schema[id_col].dataType.simpleString()
    names = [id_col, "record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "block_digest", "block", "headers"]
    strings = [pa.string()] * 7

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                keys, rows = [], []
                for key, *response in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    rows += derive_one(*response)
                    keys += [key, key]
                types = [*strings, pa.binary(), pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))]
                yield pa.RecordBatch.from_arrays([pa.array(keys, b.column(0).type), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=names)

    return found.select(id_col, *(x.split()[0] for x in RESPONSE.split(", "))).mapInArrow(run, f"`{id_col}` {kind}, {RECORD}")


def serialise(headers: list[dict], block: bytes) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(f"{h['name']}: {h['value']}\r\n".encode() for h in headers) + b"\r\n" + block + b"\r\n\r\n"


def write(records: DataFrame) -> list[str]:
    """Writes records as .warc.gz files in the shared folder, one for each task; their URIs."""
    folder = C.fresh_path(records.sparkSession, "warc")

    def run(batches):
        def parts():
            for b in batches:
                for headers, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    yield gzip.compress(serialise(headers, block), 6, mtime=0)

        uri = files.write_new(folder, "derived.warc.gz", parts())
        yield pa.RecordBatch.from_arrays([pa.array([uri])], names=["uri"])

    return sorted(r.uri for r in records.select("headers", "block").mapInArrow(run, "uri string").collect())  # a row for each task


def _records(chunks):
    """(headers, block) of each record in the byte strings of an uncompressed file, holding one record at a time."""
    held, end = bytearray(), False
    chunks = iter(chunks)

    def more() -> None:
        nonlocal end
        part = next(chunks, None)
        end = part is None
        held.extend(part or b"")

    while True:
        at = 0
        while (stop := held.find(b"\r\n\r\n", at)) < 0 and not end:
            at = max(0, len(held) - 3)
            more()
        if stop < 0:
            if held:
                raise ValueError("a record ends early")
            return
        fields = [x.partition(": ")[::2] for x in held[:stop].decode().split("\r\n")[1:]]
        size = stop + 8 + int(dict(fields)["Content-Length"])
        while len(held) < size and not end:
            more()
        if len(held) < size:
            raise ValueError("a record ends early")
        yield [{"name": k, "value": v} for k, v in fields], bytes(held[stop + 4 : size - 4])
        del held[:size]


def _unzipped(source, size: int = 1 << 20):
    """Bytes of a file of gzip members, a part at a time."""
    unzip, data = zlib.decompressobj(31), source.read(size)
    while data:
        part = unzip.decompress(data, size)
        if part:
            yield part
        if unzip.eof:
            data = unzip.unused_data or source.read(size)
            unzip = zlib.decompressobj(31)
        else:
            data = unzip.unconsumed_tail or source.read(size)


def read(spark: SparkSession, uris: list[str], batch_bytes: int = 16_000_000) -> DataFrame:
    """(headers, block) of the records in files that write() made. Files are streamed: a worker holds batch_bytes and a record, whatever their size."""

    def batch(heads, blocks):
        return pa.RecordBatch.from_arrays([pa.array(heads, pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), pa.array(blocks, pa.binary())], names=["headers", "block"])

    def run(batches):
        for b in batches:
            for uri in b.column(0).to_pylist():
                where, path = files.store(uri)
                heads, blocks, n = [], [], 0
                with where.open_input_stream(path, compression=None) as source:
                    for head, block in _records(_unzipped(source)):
                        heads.append(head)
                        blocks.append(block)
                        n += len(block)
                        if n > batch_bytes:
                            yield batch(heads, blocks)
                            heads, blocks, n = [], [], 0
                yield batch(heads, blocks)

    listed = spark.createDataFrame([(u,) for u in uris], "uri string").repartition(max(1, min(len(uris), 10_000)))
    return listed.mapInArrow(run, "headers array<struct<name:string,value:string>>, block binary")
