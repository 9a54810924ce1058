"""Media columns: archives of images, planned by byte ranges and read member by member.

store() streams 8-bit grey PNG images into tar archives of the shared folder. Beside each archive lies an index
(Arrow) of its members' ids, offsets, sizes and checksums; a list, which Spark writes and commits, names the archives of tasks
that ended well, so what a lost or repeated attempt left behind is not read, and goes with the folder. The data source
"image_archives" plans partitions over byte ranges of all archives, reads the index rows whose offsets fall in its
range, and streams payloads in Arrow batches of a bounded size. The planner holds a row for each archive and range;
their sizes rise with the input, so that there are at most MOST_ARCHIVES and MOST_RANGES or about as many. A member that cannot be read, or whose checksum is wrong, is tried again from its own offset, with the
archive opened anew; the others are not read twice.

Defined results: a null text is empty; an empty text is one row of 576 bytes of 255. Equal texts give equal
images. Repeated rows and null ids are kept. Long texts are stored whole. An empty table makes no archive. Of an
image that could not be read (on_error=row) all features are null. Columns other than the id and the text are not looked at.
"""

from __future__ import annotations

import binascii
import hashlib
import itertools
import math
import struct
import time
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import common as C
from . import files

WIDTH = 576
PAD = b"\xff"
ARCHIVE_BYTES = 64_000_000
RANGE_BYTES = 16_000_000
BATCH_BYTES = 4_000_000
MOST_ARCHIVES, MOST_RANGES = 50_000, 100_000
LEVEL = 1
SIGNATURE = b"\x89PNG\r\n\x1a\n"
TRIES = 4


def payload_of(text: bytes | None) -> bytes:
    """The text, padded to a positive multiple of WIDTH."""
    data = text or b""
    return data + PAD * (-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", binascii.crc32(body, binascii.crc32(kind)))


def encode(payload: bytes, level: int = LEVEL) -> bytes:
    """A grey PNG image of 8-bit samples, WIDTH wide, without row filters."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    plain = np.zeros((len(rows), WIDTH + 1), np.uint8)
    plain[:, 1:] = rows
    data, most = zlib.compress(plain.tobytes(), level), 2**30
    parts = [_chunk(b"IDAT", data[i : i + most]) for i in range(0, len(data), most)]
    return b"".join([SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)), *parts, _chunk(b"IEND", b"")])


def decode(image: bytes) -> bytes:
    """The samples of an image that encode() made."""
    if image[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    at, size, data = 8, None, []
    while at < len(image):
        n, kind = struct.unpack_from(">I4s", image, at)
        body = image[at + 8 : at + 8 + n]
        if binascii.crc32(body, binascii.crc32(kind)) != struct.unpack_from(">I", image, at + 8 + n)[0]:
            raise ValueError(f"chunk {kind} is damaged")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if size is None or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an image of 8-bit grey samples")
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    if rows[:, 0].any():
        raise ValueError("rows are filtered")
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Size, mean and deviation of the samples, and which cells of an 8 by 8 grid (rows by columns) are above their mean."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    cells = x.reshape(len(x), 8, -1).mean(axis=2)
    edges = np.linspace(0, len(x), 9).astype(int)
    grid = np.array([cells[a : max(b, a + 1)].mean(axis=0) if a < len(x) else cells[-1] for a, b in zip(edges, edges[1:], strict=False)])
    mark = int.from_bytes(np.packbits(grid > grid.mean()).tobytes(), "big")
    return f"{len(x)}x{WIDTH} mean={x.mean():.3f} sd={x.std():.3f} grid={mark:016x}"


def _tar_header(name: str, size: int) -> bytes:
    """A ustar header without owner and time."""
    length = b"%011o\0" % size if size < 8**11 else b"\x80" + size.to_bytes(11, "big")
    head = name.encode().ljust(100, b"\0") + b"0000644\0" + b"0000000\0" * 2 + length + b"%011o\0" % 0 + b" " * 8 + b"0" + b"\0" * 100 + b"ustar\x0000" + b"\0" * 247
    return head[:148] + b"%06o\0 " % sum(head) + head[156:]


def store(docs: DataFrame, id_col: str = "doc_id", text: str = "text", archive_bytes: int | None = None, level: int = LEVEL) -> str:
    """Writes the images of all rows into archives; the folder, for the data source to load.

    An archive ends after archive_bytes; unless that is given, after ARCHIVE_BYTES, or more where the plan states an input of more than MOST_ARCHIVES of these.
    """
    spark = docs.sparkSession
    folder = C.fresh_path(spark, "media")
    wanted = docs.select(id_col, text)
    most = archive_bytes or max(ARCHIVE_BYTES, math.ceil(C.stated_bytes(wanted) / MOST_ARCHIVES))

    def write(batches):
        kind = None

        def members():
            nonlocal kind
            for b in batches:
                kind = b.column(0).type
                yield from zip(b.column(0).to_pylist(), b.column(1), strict=True)

        rest = members()
        for first in rest:
            uri, stream = files.create(folder, "images.tar")
            ids, rows, at = [], [], 0
            with stream as out:
                for key, value in itertools.chain([first], rest):
                    image = encode(payload_of(value.as_py()), level)
                    head = _tar_header(f"{len(ids):08d}.png", len(image))
                    ids.append(key)
                    rows.append((at + 512, len(image), binascii.crc32(image)))
                    for part in (head, image, b"\0" * (-len(image) % 512)):
                        out.write(part)
                        at += len(part)
                    if at >= most:
                        break
                out.write(b"\0" * 1024)
            sink = pa.BufferOutputStream()
            index = pa.table([pa.array(ids, kind), *(pa.array(x, pa.int64()) for x in zip(*rows, strict=True))], names=["id", "offset", "size", "crc"])
            with pa.ipc.new_file(sink, index.schema) as out:
                out.write_table(index, max_chunksize=4096)
            own = files.write_new(folder, "index.arrow", [sink.getvalue()])
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([own]), pa.array([at + 1024])], names=["archive", "index", "bytes"])

    made = wanted.select(id_col, F.encode(F.col(text), "UTF-8").alias("t")).mapInArrow(write, "archive string, index string, bytes long")
    kind = docs.schema[id_col].dataType.simpleString()
    made.withColumn("kind", F.lit(kind)).write.parquet(f"{folder}/list")
    where, path = files.store(folder)
    with where.open_output_stream(f"{path}/id-type") as out:
        out.write(kind.encode())
    return folder


class ByteRange(InputPartition):
    def __init__(self, archive: str, index: str, lo: int, hi: int):
        self.archive, self.index, self.lo, self.hi = archive, index, lo, hi


class ImageArchives(DataSource):
    """Options: path; range_bytes; batch_bytes; tries; on_error (fail, or row: a row with the error and no image)."""

    @classmethod
    def name(cls):
        return "image_archives"

    def schema(self):
        where, path = files.store(self.options["path"])
        with where.open_input_stream(f"{path}/id-type") as f:
            return f"id {f.read().decode()}, offset long, image binary, error string"

    def reader(self, schema):
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        number = lambda k, d: int(options.get(k, d))
        self.range_bytes, self.batch_bytes, self.tries = number("range_bytes", 0), number("batch_bytes", BATCH_BYTES), number("tries", TRIES)
        self.fail = options.get("on_error", "fail") == "fail"

    def partitions(self):
        from pyarrow import fs, parquet

        where, path = files.store(self.path)
        parts = [f.path for f in where.get_file_info(fs.FileSelector(f"{path}/list")) if f.base_name.startswith("part-")]
        listed = [r for p in sorted(parts) for r in parquet.read_table(p, columns=["archive", "index", "bytes"], filesystem=where).to_pylist()]
        size = self.range_bytes or max(RANGE_BYTES, math.ceil(sum(a["bytes"] for a in listed) / MOST_RANGES))
        return [ByteRange(a["archive"], a["index"], lo, lo + size) for a in listed for lo in range(0, a["bytes"], size)] or [ByteRange("", "", 0, 0)]

    def read(self, part):
        if not part.archive:
            return
        where, path = files.store(part.index)
        with where.open_input_file(path) as f:
            index = pa.ipc.open_file(f).read_all()
        offsets = index.column("offset").to_numpy()
        index = index.slice(int(np.searchsorted(offsets, part.lo)), int(np.searchsorted(offsets, part.hi) - np.searchsorted(offsets, part.lo)))
        where, path = files.store(part.archive)
        source, rows, held = None, [], 0

        def batch():
            ids, at, images, errors = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, index.schema.field("id").type), pa.array(at, pa.int64()), pa.array(images, pa.binary()), pa.array(errors, pa.string())], names=["id", "offset", "image", "error"])

        for key, offset, size, crc in zip(*(index.column(c).to_pylist() for c in ("id", "offset", "size", "crc")), strict=True):
            image, error = None, None
            for k in range(self.tries):
                try:
                    source = source or where.open_input_file(path)
                    source.seek(offset)
                    data = source.read(size)
                    if len(data) != size or binascii.crc32(data) != crc:
                        raise OSError(f"member at {offset} of {part.archive} is damaged")
                    image, error = data, None
                    break
                except (OSError, pa.ArrowException) as e:
                    source, error = None, str(e)
                    if k + 1 < self.tries:
                        time.sleep(0.05 * 2**k)
            if error and self.fail:
                raise OSError(error)
            rows.append((key, offset, image, error))
            held += len(image or b"")
            if held >= self.batch_bytes:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()


def load(spark: SparkSession, folder: str, **options) -> DataFrame:
    """(id, offset, image, error) of all members."""
    spark.dataSource.register(ImageArchives)
    return spark.read.format("image_archives").options(**{k: str(v) for k, v in options.items()}).option("path", folder).load()


def features(images: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of load()'s rows: the payload read back and what is computed from it."""
    kind = images.schema["id"].dataType.simpleString()
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for b in batches:
            rows = []
            for key, image in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = image.as_py()
                if data is None:
                    rows.append((key, *(None,) * 7))
                    continue
                p = decode(data)
                rows.append((key, len(p.rstrip(PAD)), len(p), hashlib.sha256(p).hexdigest(), binascii.crc32(p[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(p)))
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            types = [b.column(0).type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return images.select("id", "image").mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
