"""WARC archives with dictionary-compressed records, written and read by Spark.

An archive is a .warc.zst file: a skippable frame with a Zstandard dictionary built from
the first records of the archive itself, then one frame for each record. Spark's text
writer puts the frames in files, so any file system Spark can write will do and a lost task
leaves no half archive; the line separator is an empty skippable frame, which readers pass
over. A line holds about `CHUNK_BYTES` of frames and a file ARCHIVE_CHUNKS lines, then the
next archive of the partition begins, with a dictionary of its own: archives are bounded
whatever the partitions are (one record larger than a chunk is a chunk by itself).

The payload is the html in UTF-8; null counts as empty. Of pages with equal payloads of
at least `least_bytes`, the one with the largest page_id is stored as response and the
others as revisit records that refer to it; smaller payloads are always stored. Rows
that share the largest page_id as well are all responses. A null page_id comes back as
null and is never referred to unless no other row of its payload has an id; then those
rows are responses. A null url is left out. Record ids hold the row's number besides the
page id, so they are unique whatever repeats. An empty table gives no archive rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import chain
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkindex.llm.common import map_batches, materialize

LEAST_BYTES = 1000
LEVEL = 3
DICTIONARY_BYTES = 1 << 16
#: Bytes of an archive's first records that its dictionary is built from, at most.
SAMPLE_BYTES = 2 << 20
#: Bytes of frames in a line, about, and lines in an archive.
CHUNK_BYTES, ARCHIVE_CHUNKS = 2 << 20, 32
#: Payloads that occur more than once, up to which each executor gets their table at once.
SHARED_PAYLOADS = 200_000
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
#: A skippable frame of no bytes, which is ASCII.
EMPTY_FRAME = b"P*M\x18\0\0\0\0"
_UNSAFE = re.compile(r"[\x00-\x20\x7f-\x9f\u2028\u2029]|\A\Z")
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None, row: int) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}:{row}>"


def page_of(urn: str) -> int | None:
    number = urn.removeprefix("<urn:x-page:").split(":", 1)[0]
    return int(number) if number else None


def record(kind: str, headers: Iterable[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, row: int, url: str | None, payload: bytes, refers_to: tuple[int, int] | None = None) -> bytes:
    """A response record, or a revisit record if the page and row it refers to are given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    headers = [("WARC-Record-ID", record_id(page_id, row)), ("WARC-Date", DATE)]
    if url is not None:
        target = _UNSAFE.sub(lambda m: quote(m[0]), url)
        headers.append(("WARC-Target-URI", target))
        if target != url:  # not a URI as it stands: kept as JSON, to come back as it was
            headers.append(("X-Original-URI", json.dumps(url)))
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is None:
        return record("response", headers, http + payload)
    return record("revisit", [*headers, ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(*refers_to))], http)


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; the plain text of the samples where they are too few to train."""
    try:
        return zstandard.train_dictionary(size, samples, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def archives(records: Iterable[bytes], chunk_bytes: int = CHUNK_BYTES, chunks: int = ARCHIVE_CHUNKS) -> Iterator[bytes]:
    """The frames of archives in chunks; each archive but the last has `chunks` of them.
    Only the sample and a chunk are held back."""
    records = iter(records)
    for first in records:
        yield from _archive(chain([first], records), chunk_bytes, chunks)


def _archive(records: Iterator[bytes], chunk_bytes: int, chunks: int) -> Iterator[bytes]:
    """One archive of records, which are not empty; what does not fit is left to the next."""
    held, size = [], 0
    for one in records:
        held.append(one)
        size += len(one)
        if size >= min(SAMPLE_BYTES, chunk_bytes):  # no more than one archive holds
            break
    dictionary = build_dictionary(held)
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
    info = record("warcinfo", [("WARC-Record-ID", "<urn:x-archive:info>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
    frames = [struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)), dictionary, *map(press.compress, [info, *held])]
    del held
    size = sum(map(len, frames))
    for _ in range(chunks - 1):
        if size < chunk_bytes:
            for one in records:
                frames.append(press.compress(one))
                size += len(frames[-1])
                if size >= chunk_bytes:
                    break
        if not frames:
            return
        yield b"".join(frames)
        frames, size = [], 0
    for one in records:
        frames.append(press.compress(one))
        size += len(frames[-1])
        if size >= chunk_bytes:
            break
    if frames:
        yield b"".join(frames)


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that starts at `at` ends, by its block headers."""
    described = data[at + 4]
    single = described >> 5 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[described & 3] + ((1 if single else 0), 2, 4, 8)[described >> 6]
    last = 0
    while not last:
        head = int.from_bytes(data[at : at + 3], "little")
        last, kind = head & 1, head >> 1 & 3
        at += 3 + (1 if kind == 1 else head >> 3)
    return at + 4 * (described >> 2 & 1)


def records_of(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one after another."""
    view, at, expand = memoryview(data), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        (magic,) = struct.unpack_from("<I", view, at)
        if magic == FRAME_MAGIC:
            end = frame_end(view, at)
            yield expand.decompress(view[at:end])
        elif magic & 0xFFFFFFF0 == 0x184D2A50:
            (size,) = struct.unpack_from("<I", view, at + 4)
            end = at + 8 + size
            if magic == DICTIONARY_MAGIC:
                expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(view[at + 8 : end])))
        else:
            raise ValueError(f"no frame at byte {at}")
        at = end


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """The WARC headers and the block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])]


def with_decision(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES, shared_payloads: int = SHARED_PAYLOADS) -> DataFrame:
    """(id, row, url, html, kept): kept is the page and row that a revisit refers to, and
    null for what is stored as response. While few payloads occur more than once, every
    executor gets their table and no html is shuffled."""
    html = F.coalesce(pages[html_col], F.lit(""))
    known = pages.select(pages[id_col].alias("id"), F.monotonically_increasing_id().alias("row"), pages[url_col].alias("url"), html.alias("html"))
    known = known.withColumn("digest", F.when(F.octet_length("html") >= least_bytes, F.unhex(F.sha1("html"))))
    kept = known.where("digest is not null").groupBy("digest").agg(F.max(F.struct("id", "row")).alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1 and kept.id is not null").select("digest", "kept")
    kept = materialize(kept, "kept")
    if kept.count() <= shared_payloads:
        kept = F.broadcast(kept)
    revisit = F.when(~F.col("id").eqNullSafe(F.col("kept.id")), F.col("kept"))
    return known.join(kept, "digest", "left").select("id", "row", "url", "html", revisit.alias("kept"))


def write_archives(decided: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES, chunks: int = ARCHIVE_CHUNKS) -> None:
    """Write (id, row, url, html, kept) as archives, one or more for each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[bytes]:
            for batch in batches:
                for i, row, url, html, kept in zip(*batch.columns, strict=True):
                    refers_to = (kept["id"].as_py(), kept["row"].as_py()) if kept.is_valid else None
                    yield page_record(i.as_py(), row.as_py(), url.as_py(), html.as_py().encode("utf-8", "surrogatepass"), refers_to)

        for chunk in archives(rows(), chunk_bytes, chunks):
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.binary())], ["frames"])

    frames = map_batches(decided.select("id", "row", "url", "html", "kept"), run, "frames binary")
    lines = frames.select(F.col("frames").cast("string").alias("value"))
    lines.write.option("lineSep", EMPTY_FRAME.decode()).option("maxRecordsPerFile", chunks).text(path)
    jvm = decided.sparkSession.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(decided.sparkSession.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("part-") and name.endswith(".txt"):
            fs.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(folder, name.removesuffix(".txt") + ".warc.zst"))


def read_archives(spark: SparkSession, path: str, with_html: bool = False) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to [, html]) for
    each page record of the archives in path; html is null for a revisit. A stored
    payload is measured and hashed as it was read; one that does not match its record's
    digest is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("html", pa.string())] * with_html)
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for data in records_of(content.as_py()):
                    headers, block = parse_record(data)
                    if headers["WARC-Type"] not in ("response", "revisit"):
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
                    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    stored = headers["WARC-Type"] == "response"
                    if stored and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"the payload of {headers['WARC-Record-ID']} is damaged")
                    url = json.loads(headers["X-Original-URI"]) if "X-Original-URI" in headers else headers.get("WARC-Target-URI")
                    row = (page_of(headers["WARC-Record-ID"]), url, length, digest, headers["WARC-Type"], None if stored else page_of(headers["WARC-Refers-To"]))
                    rows.append((*row, payload.decode("utf-8", "surrogatepass") if stored else None) if with_html else row)
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
                        rows = []
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    kinds = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", html string" * with_html
    return map_batches(spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("content"), run, kinds)
