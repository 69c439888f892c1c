"""WARC archives in Zstandard: one frame a record, with the dictionary in the leading skippable frame.

The writer makes an archive of each partition's records, cut at TARGET bytes: a skippable frame (magic
0x184D2A5D) with a dictionary trained on the archive's first records, then a frame for each record. The reader takes a list of archives, loads the
dictionary, decodes frame by frame and validates version, headers, lengths and digests. Neither holds more than one
record and the writer's sample in memory. Archives are written under names of their own attempt and reported as rows,
so a retried task leaves an orphan at most, and only reported archives are read.

Records: response with the whole payload, or revisit (identical-payload-digest) with none, which names the
response it refers to and the payload's length and digest.

Defined cases: a null html is an empty payload; payloads under MIN_SHARED bytes are all responses; rows that
share the smallest page_id of a payload are all responses; rows without page_id are responses, unless a
row with a page_id has their payload. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import arrow_options, arrow_store
from .common import Scratch

MAGIC, SKIPPABLE = 0xFD2FB528, 0x184D2A5D
TARGET, SAMPLE, DICTIONARY, MIN_SHARED = 64 << 20, 2 << 20, 64 << 10, 100
LEVEL = 3


def record_id(page_id: int | None) -> str:
    """The page's id in the last eight bytes; a page without id gets a random one."""
    if page_id is None:
        return f"<urn:uuid:{uuid.uuid4()}>"
    return f"<urn:uuid:{uuid.UUID(bytes=struct.pack('>Qq', 0xCA1A5E7000008000, page_id))}>"


def page_of(identifier: str) -> int | None:
    head, page_id = struct.unpack(">Qq", uuid.UUID(identifier.removeprefix("<urn:uuid:").removesuffix(">")).bytes)
    return page_id if head == 0xCA1A5E7000008000 else None


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    block = b"" if refers_to is not None else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Payload-Length: {len(payload)}",
    ]
    if url:
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() and c != " " else "%%%02X" % ord(c) for c in url))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: text/html", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names lower-cased) and block of one record; ValueError if anything doesn't fit."""
    head, found, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not found or version != "WARC/1.1":
        raise ValueError(f"not a WARC/1.1 record: {version[:40]!r}")
    headers = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name or name.lower() in headers:
            raise ValueError(f"bad or repeated header: {line[:80]!r}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"no header {name}")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length is {n}; the record has {len(rest) - 4} bytes")
    return headers, rest[:n]


def encode_archive(records: Iterable[bytes], target: int) -> Iterator[tuple[bytes, int]]:
    """(bytes to append, records in them) of one archive at a time; an empty piece ends an archive."""
    import zstandard as zstd

    records = iter(records)
    while True:
        first, size = [], 0
        for r in records:
            first.append(r)
            size += len(r)
            if size >= SAMPLE:
                break
        if not first:
            return
        try:
            trained = zstd.train_dictionary(DICTIONARY, [r[: 128 << 10] for r in first])
        except zstd.ZstdError:  # too little to learn from
            trained = zstd.ZstdCompressionDict(b"".join(first)[-DICTIONARY:] or b"\0" * 8, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        content = zstd.ZstdCompressor(level=LEVEL).compress(trained.as_bytes())
        yield struct.pack("<II", SKIPPABLE, len(content)) + content, 0
        press = zstd.ZstdCompressor(level=LEVEL, dict_data=trained, write_content_size=True, write_checksum=True)
        size = 0
        for r in first:
            frame = press.compress(r)
            size += len(frame)
            yield frame, 1
        while size < target and (r := next(records, None)) is not None:
            frame = press.compress(r)
            size += len(frame)
            yield frame, 1
        yield b"", 0


def read_archive(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of one archive, in order. Only one frame is held at a time."""
    import zstandard as zstd

    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("the archive doesn't begin with a dictionary frame")
    content = stream.read(size)
    if len(content) != size:
        raise ValueError("the dictionary frame is cut short")
    if content[:4] == struct.pack("<I", MAGIC):
        content = zstd.ZstdDecompressor().decompress(content)
    known = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_AUTO)
    press = zstd.ZstdDecompressor(dict_data=known)
    rest = b""
    while True:
        frame, out = press.decompressobj(), []
        rest = rest or stream.read(1 << 18)
        if not rest:
            return
        while not frame.eof:
            if not rest and not (rest := stream.read(1 << 18)):
                raise ValueError("a frame is cut short")
            out.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else b""
        yield decode_record(b"".join(out))


def checked_row(headers: dict[str, str], block: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a record, with lengths and digests compared."""
    kind, digest, size = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha256:"), int(headers["payload-length"])
    if kind == "response":
        if len(block) != size or hashlib.sha256(block).hexdigest() != digest:
            raise ValueError(f"{headers['warc-record-id']}: the payload is not what its header says")
        refers_to = None
    elif kind == "revisit" and not block:
        refers_to = page_of(headers["warc-refers-to"])
    else:
        raise ValueError(f"unexpected record: {kind}, {len(block)} bytes")
    return page_of(headers["warc-record-id"]), size, digest, kind, refers_to


def write_archives(pages: DataFrame, scratch: Scratch, folder: str) -> DataFrame:
    """Write pages (page_id, url, html) as archives into a folder that all executors share; rows (path, records, bytes)."""
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    keyed = pages.select("page_id", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("size"))
    shared = keyed.where(F.col("size") >= MIN_SHARED).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("_d"), "first")
    # a table of its own: its size is known, and a very common payload's rows can be split among tasks
    shared = scratch.save(shared, "shared")
    marked = pages.withColumn("digest", F.sha2("payload", 256)).join(shared, F.col("digest") == F.col("_d"), "left")
    marked = marked.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))

    options = arrow_options(scratch.spark, folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def records():
            for pdf in batches:
                for p, url, payload, digest, r in zip(pdf.page_id, pdf.url, pdf.payload, pdf.digest, pdf.refers_to):
                    yield encode_record(None if pd.isna(p) else int(p), url, bytes(payload), digest, None if pd.isna(r) else int(r))

        system, base = arrow_store(folder, options)
        system.create_dir(base, recursive=True)
        out, path, n, size = None, "", 0, 0
        for piece, count in encode_archive(records(), TARGET):
            if not piece:
                out.close()
                yield pd.DataFrame({"path": [f"{folder}/{path}"], "records": [n], "bytes": [size]})
                out = None
                continue
            if out is None:
                path, n, size = f"{uuid.uuid4().hex}.warc.zst", 0, 0
                out = system.open_output_stream(f"{base}/{path}", compression=None)
            out.write(piece)
            n, size = n + count, size + len(piece)

    columns = marked.select("page_id", "url", "payload", "digest", "refers_to")
    as_text = columns.withColumn("page_id", F.col("page_id").cast("string")).withColumn("refers_to", F.col("refers_to").cast("string"))  # so that pandas keeps 64 bits beside nulls
    return scratch.save(as_text.mapInPandas(run, "path string, records long, bytes long"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """Rows (page_id, payload_bytes, payload_digest, record_type, refers_to) of all records of archives (path)."""
    options = arrow_options(archives.sparkSession, "s3a://")  # of use for such paths only

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
            rows.clear()
            return out

        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = arrow_store(path, options)
                with system.open_input_stream(name, compression=None) as stream:
                    for headers, block in read_archive(stream):
                        rows.append(checked_row(headers, block))
                        if len(rows) >= 5000:
                            yield flush()
        if rows:
            yield flush()

    return archives.select("path").repartition(max(1, min(archives.count(), 10_000))).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, scratch: Scratch) -> DataFrame:
    return read_archives(write_archives(pages, scratch, scratch.path("warc")))
