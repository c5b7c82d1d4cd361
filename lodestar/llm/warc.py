"""WARC archives: one gzip member per record, written and read by Spark jobs.

Writing: each row becomes a response record, or a revisit record if an equal
payload of at least ``LEAST_REVISIT`` bytes has a row with a smaller id. The
members of a task form its archive files; they go through Spark's own text
writer, so archives appear with its commit protocol in any store Spark writes
to. A member ends with the high byte of its length, which is zero below 16 MB:
that byte is given to the writer as line separator. (A larger payload's member
is followed by an empty member, so the file still ends in a zero byte.)

Reading: an archive is read in order; members are inflated piece by piece with
zlib, records framed by Content-Length, and block and payload digests checked.

Defined cases: a null payload counts as empty; a null id is written without a
page id, is never the one referred to, and revisits an equal payload that has
an id; rows that share an id and payload are all responses if theirs is the
least id; an empty table gives no records; extra columns are left alone.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.shared import bounded_batches, work_path

LEAST_REVISIT = 100
#: Folders of archives by bytes of the payload: (name, from, below, records of a file). So files are read whole and stay under 512 MB, or one payload's size.
SIZES = [("small", 0, 256 << 10, 2_000), ("large", 256 << 10, 8 << 20, 64), ("huge", 8 << 20, 1 << 62, 1)]
#: Parts that the rows of one payload are dealt to.
SALTS = 32
#: Bytes given to zlib at once.
PIECE = 64 << 10

#: Fixed names of the format.
VERSION = b"WARC/1.1"
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00" + bytes(8)


def member(data: bytes) -> bytes:
    """A gzip member of its own."""
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _one_line(url: str) -> str:
    return "".join(c if c.isprintable() else " " for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_to_url: str | None = None) -> bytes:
    """The bytes of a response or revisit record with an id of its own; a revisit has no payload but names its length and digest, and the URL and date of the response."""
    kind = "response" if refers_to is None else "revisit"
    block = payload if refers_to is None else b""
    headers = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("X-Payload-Length", str(len(payload)))]
    if url is not None:
        headers.append(("WARC-Target-URI", _one_line(url)))
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("X-Refers-To-Page", str(refers_to))]
        if refers_to_url is not None:
            headers += [("WARC-Refers-To-Target-URI", _one_line(refers_to_url)), ("WARC-Refers-To-Date", DATE)]
    headers.append(("Content-Length", str(len(block))))
    head = b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in headers)])
    return head + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_references(pages: DataFrame, wanted: Column | None = None) -> DataFrame:
    """(page_id, url, payload, digest, refers_to, refers_to_url): a payload's rows are dealt to SALTS parts, so none gathers them all; ``wanted`` picks rows."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = (pages if wanted is None else pages.where(wanted)).select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    narrow = pages.select("page_id", "url", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n"))
    firsts = narrow.where(f"n >= {LEAST_REVISIT}").groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("digest", F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url"))
    dealt = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = salted.join(dealt, ["digest", "salt"], "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to"), F.when(refers.isNotNull(), F.col("first_url")).alias("refers_to_url"))


def write(pages: DataFrame, path: str) -> None:
    """Archives of ``pages`` (page_id, url, html) under ``path``, in a folder for each of ``SIZES``: of large payloads an archive holds few."""
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = zip(*(batch.slice(at, 256).column(i).to_pylist() for i in range(6)), strict=True)
                out = []
                for row in rows:
                    packed = member(record(*row))
                    out.append(packed if packed[-1] == 0 else packed + _EMPTY_MEMBER)
                yield pa.RecordBatch.from_arrays([pa.array([x[:-1] for x in out], pa.binary())], ["value"])

    size = F.octet_length(F.coalesce("html", F.lit("")))
    for name, low, high, records in SIZES:
        rows = with_references(pages, (size >= low) & (size < high))
        members = rows.mapInArrow(run, "value binary")
        members.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\x00").option("maxRecordsPerFile", records).text(f"{path}/{name}")


def members_of(archive: bytes) -> Iterator[bytes]:
    """The inflated members of an archive, one after another; a member that breaks off raises."""
    view, at = memoryview(archive), 0
    while at < len(view):
        inflater, parts = zlib.decompressobj(31), []
        while not inflater.eof:
            piece = view[at : at + PIECE]
            if not piece:
                raise ValueError("an archive ends inside a member")
            parts.append(inflater.decompress(piece))
            at += len(piece) - len(inflater.unused_data)
        yield b"".join(parts)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of the records in a member."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].split(b"\r\n")
        if lines[0] != VERSION:
            raise ValueError("a record does not begin with its version")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.decode().partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError("a record's block is not as long as Content-Length says")
        yield headers, block
        at = end + 8 + size


def records_of(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive, their digests verified."""
    for data in members_of(archive):
        for headers, block in parse(data):
            found = hashlib.sha256(block).hexdigest()
            told = headers.get("warc-block-digest")
            if told is not None and told != f"sha256:{found}":
                raise ValueError(f"block digest of {headers.get('warc-record-id')} differs")
            if headers["warc-type"] == "response" and headers.get("warc-payload-digest", f"sha256:{found}") != f"sha256:{found}":
                raise ValueError(f"payload digest of {headers.get('warc-record-id')} differs")
            yield headers, block


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload): a row for each record; revisits have no payload."""
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                rows: list[tuple] = []
                for headers, block in records_of(archive.as_buffer()):
                    whole = headers["warc-type"] == "response"
                    number = lambda name, h=headers: int(h[name]) if name in h else None
                    rows.append((number("x-page-id"), headers.get("warc-target-uri"), headers["warc-type"], len(block) if whole else number("x-payload-length"), headers["warc-payload-digest"].removeprefix("sha256:"), number("x-refers-to-page"), block if whole else None))
                    if len(rows) == 256:
                        yield _batch(rows, kinds, names)
                        rows = []
                if rows:
                    yield _batch(rows, kinds, names)

    schema = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"
    bounded_batches(spark)
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True).load(path).select("content")
    return archives.mapInArrow(run, schema)


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """``pages`` written as archives (in the shared folder, unless ``path`` is given) and read back."""
    path = path or work_path(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path)
