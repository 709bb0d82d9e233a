"""Web archives as seekable Zstandard bundles.

A bundle is a run of WARC 1.1 records compressed as independent Zstandard
frames (one frame holds several small records), followed by a skippable frame
with the seek table (compressed and uncompressed size per frame) and its
footer, so any frame can be found and decompressed alone. The index maps each
record id to (bundle, frame, offset inside the frame, length).

Records of equal payload are stored once: of equal payloads of at least
``min_revisit`` bytes the smallest id is a ``response``, the others are
``revisit`` records that carry the HTTP header, the digest and the id referred
to, but no payload.

Bundles are rows of a Parquet table (name, bytes, index) in the shared folder:
Spark's commit protocol makes a half-written bundle of a lost executor
invisible, and every store Spark can write to will do. :func:`export_bundles`
copies them out as ``.warc.zst`` files.

Defined cases: a null payload is empty; a null url is written as an empty one;
a null id gets the record name ``null``. Rows repeated with the smallest id of
their payload are all responses. A payload longer than a frame or a bundle has
one of its own. Only id, url and payload are read. An empty table gives no
bundles.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm.common import ship, stash

__all__ = ["archive_records", "write_bundles", "read_bundles", "read_record", "bundle_index",
           "export_bundles", "roundtrip"]

# Fixed values of the seekable Zstandard format.
SEEK_MAGIC = 0x8F92EAB1
SKIPPABLE_MAGIC = 0x184D2A5E
# Defaults of this writer.
FRAME_BYTES = 256 * 1024
BUNDLE_BYTES = 4 * 1024 * 1024
ID_PREFIX = "urn:x-page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Capture time is not in the table; a fixed date keeps archives reproducible.
WARC_DATE = "1970-01-01T00:00:00Z"

BUNDLE_SCHEMA = ("bundle string, data binary, index array<struct<record_id: string, frame: int, "
                 "offset: bigint, length: bigint>>")
RECORD_SCHEMA = ("page_id string, url string, record_type string, payload_bytes bigint, "
                 "payload_digest string, refers_to string, payload binary, bundle string")


def archive_records(df: DataFrame, id_col: str = "page_id", url_col: str = "url",
                    payload_col: str = "html", min_revisit: int = 100) -> DataFrame:
    """``page_id, url, payload, digest, first`` — ``first`` is the id of the
    response where the row is a revisit, else null."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # only digests and ids are grouped; a digest used once needs no lookup
    shared = (df.select(F.col(id_col).alias("_id"), payload.alias("_p"))
                .where(F.octet_length("_p") >= min_revisit)
                .groupBy(F.sha2("_p", 256).alias("_digest"))
                .agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
                .where("_n > 1").select("_digest", "_first"))
    shared = stash(shared, "warc-shared")
    rows = rows.join(shared, rows["digest"] == shared["_digest"], "left")
    first = F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    return rows.select("page_id", "url", "payload", "digest", first.alias("first"))


def _http_header(size: int) -> bytes:
    return (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
            f"Content-Length: {size}\r\n\r\n").encode()


def _record(page_id, url, payload: bytes, digest: str, first) -> tuple[str, bytes]:
    name = f"{ID_PREFIX}{'null' if page_id is None else page_id}"
    block = _http_header(len(payload))
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}",
            f"WARC-Record-ID: <{name}>", f"WARC-Date: {WARC_DATE}",
            "WARC-Target-URI: " + " ".join((url or "").split()),
            f"WARC-Payload-Digest: sha256:{digest}"]
    if first is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: <{ID_PREFIX}{first}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return name, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", c, d) for c, d in frames)
    body += struct.pack("<IBI", len(frames), 0, SEEK_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


class _Bundle:
    """Collects records into frames; holds at most one bundle in memory."""

    def __init__(self, frame_bytes: int, level: int):
        import zstandard
        self.frame_bytes = frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level)
        self.out, self.frames, self.index = io.BytesIO(), [], []
        self.open, self.size = [], 0

    def add(self, name: str, record: bytes) -> None:
        if self.open and self.size + len(record) > self.frame_bytes:
            self.close_frame()
        self.index.append((name, len(self.frames), self.size, len(record)))
        self.open.append(record)
        self.size += len(record)

    def close_frame(self) -> None:
        if self.open:
            data = self.compressor.compress(b"".join(self.open))
            self.out.write(data)
            self.frames.append((len(data), self.size))
            self.open, self.size = [], 0

    def finish(self) -> bytes:
        self.close_frame()
        self.out.write(_seek_table(self.frames))
        return self.out.getvalue()


def _make_writer(frame_bytes: int, bundle_bytes: int, level: int):
    def write(batches: Iterator) -> Iterator:
        import pandas as pd
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        n, bundle, held = 0, _Bundle(frame_bytes, level), 0

        def row():
            names = ("record_id", "frame", "offset", "length")
            return pd.DataFrame({"bundle": [f"part-{part:06d}-{n:06d}"], "data": [bundle.finish()],
                                 "index": [[dict(zip(names, x, strict=True)) for x in bundle.index]]})

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                page_id = None if r.page_id is None else str(r.page_id)
                first = None if r.first is None else str(r.first)
                name, record = _record(page_id, r.url, r.payload, r.digest, first)
                if held and held + len(record) > bundle_bytes:
                    yield row()
                    n, bundle, held = n + 1, _Bundle(frame_bytes, level), 0
                bundle.add(name, record)
                held += len(record)
        if held:
            yield row()

    return write


def write_bundles(records: DataFrame, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES,
                  level: int = 3) -> DataFrame:
    """Write the records of :func:`archive_records` as bundles and return the
    written table ``bundle, data, index``."""
    ship(records)
    rows = records.select(F.col("page_id").cast("string"), "url", "payload", "digest",
                          F.col("first").cast("string"))
    return stash(rows.mapInPandas(_make_writer(frame_bytes, bundle_bytes, level), BUNDLE_SCHEMA), "warc")


def frame_table(data: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, size) of each frame, from the footer."""
    count, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEK_MAGIC or flags:
        raise ValueError("not a seekable Zstandard bundle")
    begin, start, out = len(data) - 9 - 8 * count, 0, []
    for k in range(count):
        packed, size = struct.unpack_from("<II", data, begin + 8 * k)
        out.append((start, packed, size))
        start += packed
    if start != begin - 8:
        raise ValueError("the seek table does not match the bundle")
    return out


def _frame(data: bytes, frame: tuple[int, int, int]) -> bytes:
    import zstandard
    start, packed, size = frame
    return zstandard.ZstdDecompressor().decompress(data[start:start + packed], max_output_size=size or 1)


def read_record(data: bytes, frame: int, offset: int, length: int) -> bytes:
    """One record by its index entry: only its frame is decompressed."""
    return _frame(data, frame_table(data)[frame])[offset:offset + length]


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each WARC record in a decompressed frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record at {at}")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(": "), "") for x in lines[1:])
        begin = end + 4
        stop = begin + int(fields["Content-Length"])
        if data[stop:stop + 4] != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        yield fields, data[begin:stop]
        at = stop + 4


def _make_reader(with_payload: bool):
    def read(batches: Iterator) -> Iterator:
        import hashlib

        import pandas as pd

        cut = len(ID_PREFIX)
        cols = [c.split(" ")[0] for c in RECORD_SCHEMA.split(", ")]
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                for frame in frame_table(r.data):
                    out = []
                    for fields, block in parse_records(_frame(r.data, frame)):
                        http, _, body = block.partition(b"\r\n\r\n")
                        kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].partition(":")[2]
                        if kind == "response" and hashlib.sha256(body).hexdigest() != digest:
                            raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
                        size = int(next(x for x in http.decode().split("\r\n")
                                        if x.startswith("Content-Length: "))[16:])
                        name = fields["WARC-Record-ID"][1 + cut:-1]
                        refers = fields.get("WARC-Refers-To")
                        out.append((None if name == "null" else name, fields["WARC-Target-URI"], kind, size,
                                    digest, refers and refers[1 + cut:-1],
                                    body if with_payload and kind == "response" else None, r.bundle))
                    yield pd.DataFrame(out, columns=cols)

    return read


def read_bundles(bundles: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record of the bundles, a frame at a time. Payload digests are
    checked on the way; a revisit has a null payload and names its response."""
    ship(bundles)
    return bundles.select("bundle", "data").mapInPandas(_make_reader(with_payload), RECORD_SCHEMA)


def bundle_index(bundles: DataFrame) -> DataFrame:
    """record_id, bundle, frame, offset, length."""
    return bundles.select("bundle", F.explode("index").alias("x")).select("x.record_id", "bundle", "x.frame",
                                                                         "x.offset", "x.length")


def export_bundles(bundles: DataFrame, folder: str) -> DataFrame:
    """Copy bundles to ``<folder>/<name>.warc.zst`` on a file system mounted on
    all machines; a file appears under its name only when complete."""
    ship(bundles)

    def write(batches: Iterator) -> Iterator:
        import os
        import uuid

        import pandas as pd

        for pdf in batches:
            done = []
            for r in pdf.itertuples(index=False):
                path = os.path.join(folder, f"{r.bundle}.warc.zst")
                part = f"{path}.{uuid.uuid4().hex}.part"
                with open(part, "wb") as f:
                    f.write(r.data)
                os.replace(part, path)
                done.append((path, len(r.data)))
            yield pd.DataFrame(done, columns=["path", "bytes"])

    return bundles.select("bundle", "data").mapInPandas(write, "path string, bytes bigint")


def roundtrip(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
              min_revisit: int = 100) -> DataFrame:
    """Archive every row, read the archives back, and return what they hold."""
    bundles = write_bundles(archive_records(df, id_col, url_col, payload_col, min_revisit))
    kind = df.schema[id_col].dataType
    back = read_bundles(bundles, with_payload=False)
    return back.select(F.col("page_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest",
                       "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "bundle")
