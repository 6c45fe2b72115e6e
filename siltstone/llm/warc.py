"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames of about ``FRAME_BYTES``; each frame is compressed by
itself, frames follow one another in a bundle, and a bundle ends with a seek table
(a skippable frame of the Zstandard seekable format: compressed and plain size of
each frame, their number, a magic number). Any Zstandard reader unpacks a bundle as
a whole, and one record costs the end of the bundle and one frame. An index maps
record identifiers to bundle, frame and the offset inside the plain frame.

Copies are found by payload digests in narrow rows; only groups of more than one are
kept, with the largest id in each. Pages meet that table once, on their digest, and
then go straight into bundles: a page that copies another becomes a revisit without
payload. Tasks write bundles under new names and the index names those that count,
so a task that runs again leaves a file that nobody reads, and no half-written one is ever read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import new_folder, stored, table

#: Plain bytes after which a frame ends, and packed bytes after which a bundle does; a record lies in one frame.
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 128 << 20
LEVEL = 3
#: Plain bytes that a task reads back.
TASK_BYTES = 32 << 20
#: Payloads of fewer bytes are never revisits.
MIN_REVISIT_BYTES = 0

# Fixed values of the public formats.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
_PRINTABLE = "".join(map(chr, range(0x21, 0x7F))).replace("%", "").replace("<", "").replace(">", "")
#: Rows of one output batch.
OUTPUT_ROWS = 4096

INDEX = "id_text string, record_id string, bundle string, frame int, offset long, length long"
RECORD = "id_text string, record_id string, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to_text string, refers_to_record string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(id_text: str | None, sha1: str) -> str:
    """The identifier of a page's record: rows with one id and one payload share it."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{id_text}|{sha1}'.encode()).digest()[:16], version=5)}>"


def record(id_text: str | None, uri: str | None, payload: bytes, refers_to: str | None) -> tuple[str, bytes]:
    """The identifier and the bytes of a page's record: a response, or a revisit if it refers to another."""
    sha1 = digest(payload)
    own = record_id(id_text, sha1)
    http = _HTTP + b"Content-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {own}",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {quote(uri, _PRINTABLE)}"] if uri is not None else []),
        f"WARC-Payload-Digest: sha1:{sha1}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, sha1)}", f"X-Refers-To-Page: {quote(refers_to, _PRINTABLE)}"] if refers_to is not None else []),
        *([f"X-Page: {quote(id_text, _PRINTABLE)}"] if id_text is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return own, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Header fields (names in lower case), HTTP payload and end of the record at an offset."""
    stop = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:stop].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no record at offset {at}")
    fields = {k.lower(): v.strip() for k, v in (line.split(":", 1) for line in lines)}
    begin, end = stop + 4, stop + 4 + int(fields["content-length"])
    return fields, data[data.index(b"\r\n\r\n", begin) + 4 : end], end + 4


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


class BundleWriter:
    """Appends records to a bundle of frames; ``close`` adds the seek table."""

    def __init__(self, path: str):
        fs, at = file_system(path)
        self.path, self.out = path, fs.open_output_stream(at, compression=None)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.frames: list[tuple[int, int]] = []
        self.plain: list[bytes] = []
        self.held = self.written = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """The frame that takes the record, and its offset there."""
        if self.held and self.held + len(data) > FRAME_BYTES:
            self.end_frame()
        place = len(self.frames), self.held
        self.plain.append(data)
        self.held += len(data)
        return place

    def end_frame(self) -> None:
        packed = self.packer.compress(b"".join(self.plain))
        self.out.write(packed)
        self.frames.append((len(packed), self.held))
        self.plain, self.held, self.written = [], 0, self.written + len(packed)

    def close(self) -> None:
        if self.held:
            self.end_frame()
        body = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.out.close()


class BundleReader:
    """Reads single frames of a bundle through its seek table."""

    def __init__(self, path: str):
        fs, at = file_system(path)
        self.file = fs.open_input_file(at)
        size = self.file.size()
        self.file.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        entry = 12 if flags & 0x80 else 8  # with checksums an entry has four more bytes
        self.file.seek(size - 9 - n * entry)
        table = self.file.read(n * entry)
        self.starts = [0]
        for k in range(n):
            self.starts.append(self.starts[-1] + struct.unpack_from("<I", table, k * entry)[0])

    def frame(self, k: int) -> bytes:
        self.file.seek(self.starts[k])
        return zstandard.ZstdDecompressor().decompress(self.file.read(self.starts[k + 1] - self.starts[k]))

    def close(self) -> None:
        self.file.close()


def with_originals(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Adds ``original`` to ``pages(id, uri, payload binary)``: the largest id with an equal payload, where that is another row's."""
    keyed = pages.withColumn("sha", F.sha2("payload", 256))
    narrow = keyed.where(F.octet_length("payload") >= min_bytes).select("sha", "id")
    groups = stored(narrow.groupBy("sha").agg(F.max("id").alias("original"), F.count("*").alias("n")).where("n > 1 and original is not null").select("sha", "original"), "copies")
    # One narrow row for a digest is hashed, pages stream past it unsorted; adaptive execution splits a digest with many pages.
    out = keyed.join(groups.hint("shuffle_hash"), "sha", "left")
    return out.select("id", "uri", "payload", F.when(~F.col("id").eqNullSafe(F.col("original")), F.col("original")).alias("original"))


def written(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Archive ``pages`` as bundles in ``folder``; returns the stored index of records.

    The index has ``id_text, record_id, bundle, frame, offset, length``, a row per input
    row. A null html is an empty payload; a very long one is a frame by itself. Of
    equal payloads of ``min_bytes`` or more that with the largest id is a response and
    the others refer to it; rows that share this id as well (repeated rows) are all
    responses, with one record identifier. A null id is never the largest; where
    all ids of a group are null, all are responses. A null url has no target field.
    Other columns are ignored. An empty table gives an empty index.
    """
    named = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("uri"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = with_originals(named, min_bytes).select(F.col("id").cast("string").alias("id"), "uri", "payload", F.col("original").cast("string").alias("original"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, found = None, []
        for b in batches:
            ids, uris, payloads, originals = b.columns
            for k in range(b.num_rows):
                if out is None:
                    out = BundleWriter(f"{folder}/{uuid.uuid4().hex}.warc.zst")
                own, data = record(ids[k].as_py(), uris[k].as_py(), payloads[k].as_py(), originals[k].as_py())
                found.append((ids[k].as_py(), own, out.path, *out.add(data), len(data)))
                if out.written >= BUNDLE_BYTES:
                    out.close()
                    out = None
                if len(found) >= OUTPUT_ROWS:
                    yield _batch(found, INDEX)
                    found = []
        if out is not None:
            out.close()
        yield _batch(found, INDEX)

    return stored(rows.mapInArrow(write, INDEX), "warc-index")


_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _batch(rows: list[tuple], shape: str) -> pa.RecordBatch:
    fields = [f.split() for f in shape.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def records(places: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records at ``places(bundle, frame, offset, length)``: rows of an index, all or a few.

    Places of one frame meet in one task, which unpacks it once; a bundle's other
    frames are not read. The length and the digest of a response are those of the
    bytes read, and a digest that its header contradicts is an error; a revisit
    has those of its header. ``with_payload`` adds the bytes (null for a revisit).
    Places are few bytes and what they lead to is many, so the number of tasks
    follows the ``length`` of the records.
    """
    total = places.agg(F.sum("length")).first()[0] or 0
    shape = RECORD + ", payload binary" * with_payload

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = frame = data = bundle = None
        rows, size = [], 0
        for b in batches:
            for new_path, new_frame, offset in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if new_path != path:
                    if bundle is not None:
                        bundle.close()
                    path, bundle, frame = new_path, BundleReader(new_path), None
                if new_frame != frame:
                    frame, data = new_frame, bundle.frame(new_frame)
                rows.append(_row(data, offset, with_payload))
                size += len(rows[-1][-1] or b"") if with_payload else 0
                if len(rows) >= OUTPUT_ROWS or size > 16 * FRAME_BYTES:
                    yield _batch(rows, shape)
                    rows, size = [], 0
        if bundle is not None:
            bundle.close()
        yield _batch(rows, shape)

    dealt = places.select("bundle", "frame", "offset").repartition(max(1, -(-total // TASK_BYTES)), "bundle", "frame").sortWithinPartitions("bundle", "frame", "offset")
    return dealt.mapInArrow(read, shape)


def _row(data: bytes, offset: int, with_payload: bool) -> tuple:
    fields, payload, _ = parsed(data, offset)
    told, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
    text = lambda name: unquote(fields[name]) if name in fields else None
    if kind == "revisit":
        at = data.index(b"\r\n\r\n", offset) + 4
        http = data[at : at + 512]
        n = int(re.search(rb"Content-Length: (\d+)", http)[1])
    else:
        n = len(payload)
        if digest(payload) != told:
            raise ValueError(f"{fields['warc-record-id']}: the payload is not what its digest says")
    found = (text("x-page"), fields["warc-record-id"], kind, text("warc-target-uri"), n, told, text("x-refers-to-page"), fields.get("warc-refers-to"))
    return (*found, payload if kind == "response" else None) if with_payload else found


def fetched(index: DataFrame, wanted: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of ``wanted(record_id)``, through the index; identifiers it doesn't hold have no row."""
    return records(index.join(wanted.select("record_id").distinct(), "record_id", "left_semi"), with_payload)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    found = records(written(pages, new_folder(spark, "warc")))
    return found.select(F.col("id_text").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_text").cast(kind).alias("refers_to"))


#: Base 32 of a SHA-1: 32 groups of five bits of its 40 hexadecimal digits, each within two digits.
_BASE32 = " || ".join(f"'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(CAST('0x' || h[{5 * k // 4 + 1}:{5 * k // 4 + 2}] AS BIGINT) >> {3 - 5 * k % 4}) % 32 + 1]" for k in range(32))

ORACLE_SQL = f"""
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), newest AS (
  SELECT *, max(page_id) OVER (PARTITION BY html) AS original FROM payloads
)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM original AND original IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM original THEN original END AS refers_to
FROM newest
"""
