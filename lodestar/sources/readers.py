"""Readers of manifests, documents, labels and binary files, as DataFrames."""

from __future__ import annotations

import struct
import zipfile
import zlib
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

BOM = "﻿"


def text_schema(columns: Sequence[str]) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's file system has the path."""
    try:
        spark.read.format("binaryFile").load(path).select("path").limit(1).collect()
    except Exception as error:  # the missing path is the only case that counts as absent
        if "PATH_NOT_FOUND" in str(error):
            return False
        raise
    return True


def csv_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, missing_ok: bool = False) -> DataFrame:
    """A CSV file with a header, all cells as strings; a byte order mark is dropped; a missing file is an empty table if allowed."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], text_schema(columns or []))
    rows = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path)
    rows = rows.toDF(*[c.removeprefix(BOM).strip() for c in rows.columns])
    if columns:
        absent = [c for c in columns if c not in rows.columns]
        if absent:
            raise ValueError(f"missing columns: {absent}")
    return rows


def typed(rows: DataFrame, types: dict[str, str]) -> DataFrame:
    """Blank cells as null and columns cast; a cell that does not parse is null."""
    return rows.select(*[F.nullif(F.trim(c), F.lit("")).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in rows.columns])


def json_document(spark: SparkSession, path: str, schema: StructType, entries: str) -> DataFrame:
    """The rows of an array inside one JSON document; a document that does not fit the schema raises."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.inline(entries))


def quarantined(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(rows that parse, raw records that do not) of a JSON-lines file; each is a read of its own."""
    whole = StructType([*schema.fields, StructField("_corrupt", StringType())])
    told = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", whole, {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return told.where("r._corrupt IS NULL").select("r.*").drop("_corrupt"), told.where("r._corrupt IS NOT NULL").select("r._corrupt")


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, split, label, name, sha256, length) of the files below a folder; split and label are the last two folders."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    part = lambda i: F.regexp_extract("path", r"([^/]+)/([^/]+)/([^/]+)$", i)
    return rows.select("path", part(1).alias("split"), part(2).alias("label"), part(3).alias("name"), F.sha2("content", 256).alias("sha256"), "length")


def _numbers(line: Column) -> Column:
    return F.transform(F.split(F.trim(line), r"\s+"), lambda x: x.try_cast("double"))


def polygon_labels(spark: SparkSession, path: str, width: float, height: float) -> DataFrame:
    """(path, class_id, x1, y1, x2, y2): the boxes of polygon lines ``class x y x y ...``; lines of under three points or odd counts are skipped."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), _numbers(F.col("value")).alias("v"))
    points = F.slice("v", 2, F.greatest(F.size("v") - 1, F.lit(0)))
    rows = rows.where((F.size(points) >= 6) & (F.size(points) % 2 == 0) & ~F.exists("v", lambda x: x.isNull()))
    xs, ys = F.filter(points, lambda _, i: i % 2 == 0), F.filter(points, lambda _, i: i % 2 == 1)
    return rows.select("path", F.col("v")[0].cast("int").alias("class_id"), (F.array_min(xs) * width).alias("x1"), (F.array_min(ys) * height).alias("y1"), (F.array_max(xs) * width).alias("x2"), (F.array_max(ys) * height).alias("y2"))


def box_labels(spark: SparkSession, path: str) -> DataFrame:
    """(path, class_id, cx, cy, w, h) of five-field lines; malformed ones are skipped."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), _numbers(F.col("value")).alias("v"))
    good = (F.size("v") == 5) & ~F.exists("v", lambda x: x.isNull())
    return rows.where(good).select("path", F.col("v")[0].cast("int").alias("class_id"), *[F.col("v")[i].alias(n) for i, n in enumerate(("cx", "cy", "w", "h"), 1)])


def listed(spark: SparkSession, path: str, column: str = "path") -> DataFrame:
    """(path) from a CSV with that column or a text file with a path on each line."""
    if path.endswith(".csv"):
        return csv_table(spark, path, [column]).select(F.col(column).alias("path"))
    return spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")


#: Fixed values of the ZIP format: what a local header begins with, its size without names, and the known ways of packing.
LOCAL_HEADER, LOCAL_SIZE, STORED, DEFLATED = b"PK\x03\x04", 30, 0, 8
_INDEX = "archive string, member string, folder string, offset bigint, packed bigint, size bigint, crc bigint, method int, status string"


def _opened(path: str) -> pa.NativeFile:
    """A file of any file system that Arrow knows, for reads of ranges."""
    system, inner = FileSystem.from_uri(path)
    return system.open_input_file(inner)


def archive_index(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, folder, offset, packed, size, crc, method, status): a row for each member of the ZIP archives below a folder.

    Only the central directory at an archive's end is read. An archive that has none is one row with its error as ``status``; files of no bytes are not listed by Spark.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in _INDEX.split(", ")]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                try:
                    with _opened(name) as file, zipfile.ZipFile(file) as archive:
                        rows = [(name, x.filename, x.filename.rpartition("/")[0].rpartition("/")[2], x.header_offset, x.compress_size, x.file_size, x.CRC, x.compress_type, "ok") for x in archive.infolist() if not x.is_dir()]
                except (OSError, pa.ArrowException, zipfile.BadZipFile, NotImplementedError) as error:
                    rows = [(name, *[None] * 7, f"{type(error).__name__}: {error}")]
                kinds = [pa.string(), pa.string(), pa.string(), *[pa.int64()] * 4, pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

    # the content column is not read: only paths leave the scan
    paths = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path).select("path")
    return paths.mapInArrow(run, _INDEX)


def archive_entries(spark: SparkSession, path: str, archive: str, folder: str = "") -> DataFrame:
    """The index of an archive from a JSON document {"entries": [{name, local_header_offset, compressed_size, uncompressed_size, crc32, method}]}, as ``archive_index``: members below ``folder``; of one lower-case base name, the last."""
    schema = "entries array<struct<name: string, local_header_offset: bigint, compressed_size: bigint, uncompressed_size: bigint, crc32: bigint, method: int>>"
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.posexplode("entries").alias("place", "e")).select("place", "e.*")
    wanted = rows.where(F.startswith("name", F.lit(folder)) & ~F.endswith("name", F.lit("/")))
    last = wanted.groupBy(F.lower(F.element_at(F.split("name", "/"), -1))).agg(F.max_by(F.struct(*wanted.columns), "place").alias("e")).select("e.*")
    place = F.element_at(F.split("name", "/"), -2)
    return last.select(F.lit(archive).alias("archive"), F.col("name").alias("member"), F.when(F.contains("name", F.lit("/")), place).otherwise("").alias("folder"), F.col("local_header_offset").alias("offset"), F.col("compressed_size").alias("packed"), F.col("uncompressed_size").alias("size"), F.col("crc32").alias("crc"), "method", F.lit("ok").alias("status"))


def member_contents(index: DataFrame) -> DataFrame:
    """(archive, member, folder, content, status) for the rows of ``archive_index``: each member's own range is read and unpacked.

    ``status``: ok, or why there is no content. Members are dealt to tasks by
    themselves, so a large archive is read by many; one member is held at a time.
    """

    def content(file: pa.NativeFile, offset: int, packed: int, size: int, crc: int | None, method: int) -> tuple[bytes | None, str]:
        file.seek(offset)
        head = file.read(LOCAL_SIZE)
        if len(head) < LOCAL_SIZE or head[:4] != LOCAL_HEADER:
            return None, "no local header"
        names, extra = struct.unpack_from("<HH", head, 26)
        file.seek(offset + LOCAL_SIZE + names + extra)
        data = file.read(packed)
        if len(data) < packed:
            return None, "truncated"
        if method not in (STORED, DEFLATED):
            return None, f"unknown method {method}"
        try:
            plain = data if method == STORED else zlib.decompress(data, -zlib.MAX_WBITS)
        except zlib.error:
            return None, "corrupt"
        if len(plain) != size:
            return None, "wrong size"
        return (None, "wrong checksum") if crc is not None and zlib.crc32(plain) != crc else (plain, "ok")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, file = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["status"] != "ok":
                    found = None, row["status"]
                else:
                    try:
                        if row["archive"] != now:
                            if file is not None:
                                file.close()
                            now, file = None, _opened(row["archive"])
                            now = row["archive"]
                        found = content(file, *(row[c] for c in ("offset", "packed", "size", "crc", "method")))
                    except (OSError, pa.ArrowException, TypeError) as error:
                        found = None, f"{type(error).__name__}: {error}"
                values = (row["archive"], row["member"], row["folder"], *found)
                kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["archive", "member", "folder", "content", "status"])
        if file is not None:
            file.close()

    dealt = index.repartition("archive", "member").sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(run, "archive string, member string, folder string, content binary, status string")


def archive_members(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(archive, member, folder, content, status) of ZIP archives, a row for each member with the suffix and for each archive that cannot be read."""
    index = archive_index(spark, path)
    return member_contents(index.where(F.col("member").isNull() | F.endswith("member", F.lit(suffix))))


def parquet_metadata(spark: SparkSession, path: str, columns: Sequence[str] = ()) -> DataFrame:
    """(path, rows, row_groups, first_row, status) of the Parquet files below a folder, from their footers; ``first_row`` counts the rows of the good files before, by path.

    A file that cannot be read, or lacks one of ``columns``, is a row with its error; it does not end the scan.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                try:
                    with _opened(name) as file:
                        told = pq.ParquetFile(file)
                        absent = [c for c in columns if c not in told.schema_arrow.names]
                        row = (name, told.metadata.num_rows, told.metadata.num_row_groups, f"missing columns: {absent}" if absent else "ok")
                except (OSError, pa.ArrowException) as error:
                    row = (name, None, None, f"{type(error).__name__}: {str(error)[:200]}")
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["path", "rows", "row_groups", "status"])

    paths = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select("path")
    found = paths.mapInArrow(run, "path string, rows bigint, row_groups bigint, status string")
    # a row a file: the table of files, not of rows, is ordered as a whole
    before = F.sum(F.when(F.col("status") == "ok", F.col("rows")).otherwise(0)).over(W.orderBy("path").rowsBetween(W.unboundedPreceding, -1))
    return found.select("path", "rows", "row_groups", F.when(F.col("status") == "ok", F.coalesce(before, F.lit(0))).alias("first_row"), "status")


def inflated(rows: DataFrame, content: str, size: str) -> DataFrame:
    """``rows`` with raw-deflate ``content`` inflated and ``status``: ok, wrong size or corrupt."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, status = [], []
            for data, told in zip(batch.column(content).to_pylist(), batch.column(size).to_pylist(), strict=True):
                try:
                    plain = zlib.decompress(data, -15)
                    status.append("ok" if len(plain) == told else "wrong size")
                    out.append(plain if len(plain) == told else None)
                except (zlib.error, TypeError):
                    status.append("corrupt")
                    out.append(None)
            columns = [pa.array(out, pa.binary()) if n == content else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(status)], [*names, "status"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, schema + ", status string")


def arrow_streams(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of Arrow IPC stream files, a task for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                with pa.ipc.open_stream(content.as_buffer()) as reader:
                    yield from reader

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def png_size(content: Column) -> list[Column]:
    """Width and height from a PNG header; null for other bytes and for a side of 0."""
    head = F.hex(F.substring(content, 1, 24))
    side = lambda at: F.conv(F.substring(head, at, 8), 16, 10).cast("long")
    good = F.startswith(head, F.lit("89504E470D0A1A0A")) & (F.length(head) == 48) & (side(33) > 0) & (side(41) > 0)
    return [F.when(good, side(33)).alias("width"), F.when(good, side(41)).alias("height")]


#: Fixed values of JPEG: markers without a segment, and those of segments that tell the size.
_ALONE = {0x01, *range(0xD0, 0xD9)}
_SIZED = set(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}


def _jpeg_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) from the first segment that tells them; segments are skipped by their lengths."""
    at = 2 if data[:2] == b"\xff\xd8" else len(data)
    while at < len(data) - 9:
        mark = data.find(b"\xff", at)
        if mark < 0 or mark >= len(data) - 9:
            return None
        at = mark
        while at < len(data) and data[at] == 0xFF:
            at += 1
        if at >= len(data):
            return None
        kind, at = data[at], at + 1
        if kind in _ALONE:
            continue
        length = int.from_bytes(data[at : at + 2], "big")
        if at + 2 > len(data) or length < 2 or at + length > len(data):
            return None
        if kind in _SIZED and length >= 7:
            height, width = struct.unpack_from(">HH", data, at + 3)
            return (width, height) if width and height else None
        at += length
    return None


def image_size(content: Column) -> Column:
    """struct(width, height) from the header of a JPEG or PNG; null for other, empty or truncated bytes. Nothing is decoded."""

    @F.pandas_udf("width bigint, height bigint")
    def jpeg(parts: pd.Series) -> pd.DataFrame:
        found = [None if x is None else _jpeg_size(bytes(x)) for x in parts]
        return pd.DataFrame({n: pd.array([None if f is None else f[i] for f in found], "Int64") for i, n in enumerate(("width", "height"))})

    width, height = png_size(content)
    # only bytes that begin like a JPEG go to Python
    told = jpeg(F.when(F.startswith(F.hex(F.substring(content, 1, 2)), F.lit("FFD8")), content))
    pair = F.struct(F.coalesce(width, told["width"]).alias("width"), F.coalesce(height, told["height"]).alias("height"))
    return F.when(pair["width"].isNotNull(), pair)


def late_rows(narrow: DataFrame, wide: DataFrame, key: str) -> DataFrame:
    """The wide rows of the narrow selection: the wide columns are read only after the selection."""
    return wide.join(narrow.select(key).distinct(), key, "left_semi")
