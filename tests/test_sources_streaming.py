"""Readers, writers and streams on small files."""

import zipfile
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lodestar.operators import tracking
from lodestar.sources import readers, writers
from lodestar.streaming import stateful


def test_csv_with_byte_order_mark(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("﻿id,name\n1, x \n2,\n", encoding="utf-8")
    rows = readers.typed(readers.csv_table(spark, str(path), ["id", "name"]), {"id": "int", "name": "string"})
    assert sorted(tuple(r) for r in rows.collect()) == [(1, "x"), (2, None)]
    assert readers.csv_table(spark, str(tmp_path / "none.csv"), ["id"], missing_ok=True).count() == 0
    with pytest.raises(ValueError, match="missing columns"):
        readers.csv_table(spark, str(path), ["other"])


def test_labels(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0 0 0 1 0 1 1\n1 0 0 1\n2 0 0 1 0 x 1\n")
    rows = readers.polygon_labels(spark, str(tmp_path / "a.txt"), 10, 20).collect()
    assert [tuple(r)[1:] for r in rows] == [(0, 0.0, 0.0, 10.0, 20.0)]
    (tmp_path / "b.txt").write_text("3 0.5 0.5 0.1 0.2\nbad line\n")
    assert [tuple(r)[1:] for r in readers.box_labels(spark, str(tmp_path / "b.txt")).collect()] == [(3, 0.5, 0.5, 0.1, 0.2)]


def test_archives_and_arrow(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as archive:
        archive.writestr("x/one.txt", b"1")
        archive.writestr("x/two.png", b"2")
    rows = readers.archive_members(spark, str(tmp_path), ".txt").collect()
    assert [(r["member"], r["folder"], bytes(r["content"]), r["status"]) for r in rows] == [("x/one.txt", "x", b"1", "ok")]
    table = pa.table({"a": pa.array([1, 2, 3], pa.int64())})
    with pa.ipc.new_stream(str(tmp_path / "t.arrows"), table.schema) as sink:
        sink.write_table(table)
    assert sorted(r["a"] for r in readers.arrow_streams(spark, str(tmp_path / "t.arrows"), "a bigint").collect()) == [1, 2, 3]
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    data = packer.compress(b"hello") + packer.flush()
    rows = spark.createDataFrame([(bytearray(data), 5), (bytearray(data), 4), (bytearray(b"zz"), 1), (None, 1)], "content binary, size int")
    assert [r["status"] for r in readers.inflated(rows, "content", "size").collect()] == ["ok", "wrong size", "corrupt", "corrupt"]


def test_quarantine_and_writers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{"a": "x"}\n')
    good, bad = readers.quarantined(spark, str(tmp_path / "a.jsonl"), StructType([StructField("a", LongType())]))
    assert good.count() == 1 and bad.count() == 1
    with pytest.raises(ValueError, match="no rows"):
        writers.csv_file(spark.createDataFrame([], StructType([StructField("a", StringType())])), str(tmp_path / "out"))
    rows = spark.createDataFrame([(1, "train"), (2, "test"), (3, "train")], "id int, split string")
    assert {r["split"]: r["n"] for r in writers.by_split(rows, str(tmp_path / "splits")).collect()} == {"train": 2, "test": 1}
    writers.replaced_partitions(spark.createDataFrame([(9, "test")], "id int, split string"), str(tmp_path / "splits"), ["split"])
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "splits")).collect()) == [1, 3, 9]


def _stream(spark, rows, path):
    rows.repartition(1).write.mode("overwrite").parquet(str(path))
    return spark.readStream.schema(rows.schema).parquet(str(path))


def _results(spark, frame, name):
    q = frame.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streams_equal_their_batch_twins(spark, tmp_path):
    rows = spark.range(60).select((F.col("id") % 3).alias("user"), F.col("id").alias("event"), (F.col("id") * 2.5).alias("at"))
    batch = sorted(r["event"] for r in tracking.cooled_down(rows, ["user"], "at", "event", 8.0).collect())
    stream = _results(spark, stateful.announced(_stream(spark, rows, tmp_path / "e"), ["user"], "at", "event", 8.0), "cooldown")
    assert sorted(r["event"] for r in stream.collect()) == batch
    boxes = spark.range(40).select((F.col("id") % 2).alias("session"), F.floor(F.col("id") / 4).alias("frame"), F.col("id"), (F.col("id") % 4 * 30 + F.floor(F.col("id") / 4)).alias("x1"), F.lit(0).cast("long").alias("y1"), (F.col("id") % 4 * 30 + F.floor(F.col("id") / 4) + 20).alias("x2"), F.lit(20).cast("long").alias("y2"))
    twin = sorted(tuple(r) for r in tracking.tracked(boxes, "session", "frame").collect())
    live = _results(spark, stateful.tracked(_stream(spark, boxes, tmp_path / "b"), "session", "frame"), "tracks")
    assert sorted(tuple(r) for r in live.collect()) == twin


def test_archives_by_ranges(spark, tmp_path):
    """Large, damaged and foreign archives: members by their own ranges, failures as rows."""
    import json
    import os
    import random

    rng = random.Random(1)
    bodies = {f"D/in/m{i:03d}.bin": rng.randbytes(200_000 if i % 10 == 0 else 50) for i in range(60)}
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as archive:
        for i, (name, body) in enumerate(bodies.items()):
            archive.writestr(name, body, zipfile.ZIP_DEFLATED if i % 2 else zipfile.ZIP_STORED)
        archive.writestr("D/in/", b"")
        archive.writestr("top.bin", b"top")
        archive.writestr("D/odd.bin", b"zz" * 99, zipfile.ZIP_BZIP2)
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    index = readers.archive_index(spark, f"file://{tmp_path}")
    assert index.where("status = 'ok'").count() == 62
    assert sorted(os.path.basename(r.archive) for r in index.where("status <> 'ok'").collect()) == ["bad.zip"]
    found = {r.member: (r.folder, r.content, r.status) for r in readers.archive_members(spark, f"file://{tmp_path}", ".bin").collect() if r.member}
    assert {k: bytes(v[1]) for k, v in found.items() if v[2] == "ok"} == bodies | {"top.bin": b"top"}
    assert found["D/in/m000.bin"][0] == "in" and found["top.bin"][0] == ""
    assert found["D/odd.bin"] == ("D", None, "unknown method 12")
    # bytes are lost or changed behind the index's back
    data = bytearray((tmp_path / "a.zip").read_bytes())
    rows = {r.member: r for r in index.where("status = 'ok'").collect()}
    data[rows["D/in/m001.bin"].offset] = 0
    body = rows["D/in/m002.bin"].offset + 30 + len("D/in/m002.bin")
    data[body] ^= 1
    (tmp_path / "a.zip").write_bytes(bytes(data[: rows["D/in/m050.bin"].offset + 1000]))
    held = spark.createDataFrame(list(rows.values()), index.schema)
    status = {r.member: r.status for r in readers.member_contents(held).collect()}
    assert status["D/in/m001.bin"] == "no local header" and status["D/in/m002.bin"] == "wrong checksum" and status["D/in/m050.bin"] == "truncated" and status["top.bin"] == "no local header"
    assert status["D/in/m003.bin"] == "ok"
    gone = spark.createDataFrame([r.asDict() | {"archive": f"file://{tmp_path}/none.zip"} for r in list(rows.values())[:1]], index.schema)
    assert "FileNotFound" in readers.member_contents(gone).first().status
    # an index kept as JSON
    entries = [{"name": n, "local_header_offset": r.offset, "compressed_size": r.packed, "uncompressed_size": r.size, "crc32": r.crc, "method": r.method} for n, r in rows.items()]
    entries += [{"name": "D/in/", "local_header_offset": 0, "compressed_size": 0, "uncompressed_size": 0, "crc32": 0, "method": 0}, entries[3] | {"name": "D/other/M003.BIN"}]
    (tmp_path / "index.json").write_text(json.dumps({"entries": entries}))
    told = readers.archive_entries(spark, str(tmp_path / "index.json"), f"file://{tmp_path}/a.zip", "D/")
    assert told.count() == 61
    assert {r.member: (r.folder, r.status) for r in readers.member_contents(told.where("member ilike '%m003.bin'")).collect()} == {"D/other/M003.BIN": ("other", "ok")}


def test_image_sizes(spark):
    def segment(kind, body):
        return bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body

    size = lambda w, h: b"\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + b"\x03" + b"\x01\x22\x00" * 3
    tail = b"\xff\xda" + bytes(20)
    jpeg = b"\xff\xd8" + segment(0xE0, b"JFIF" + bytes(10)) + segment(0xC4, bytes(30))
    png = b"\x89PNG\r\n\x1a\n" + (13).to_bytes(4, "big") + b"IHDR"
    side = lambda n: n.to_bytes(4, "big")
    cases = [
        (jpeg + segment(0xC0, size(640, 480)) + tail, (640, 480)), (jpeg + b"\xff\xff\xff" + segment(0xC2, size(1, 65535))[1:] + tail, (1, 65535)), (b"\xff\xd8\xff\x01\xff\xd0" + segment(0xCF, size(7, 8)) + tail, (7, 8)),
        (b"\xff\xd8xx" + segment(0xC1, size(9, 5)) + tail, (9, 5)), (jpeg + segment(0xC0, size(0, 480)) + tail, None), ((jpeg + segment(0xC0, size(640, 480)))[:30], None), (jpeg + tail, None), (jpeg + b"\xff\xe1\x00\x01" + bytes(20), None), (b"\xff\xd8", None),
        (png + side(3000) + side(20) + bytes(5), (3000, 20)), (png + side(2**31) + side(1), (2**31, 1)), (png + side(3000) + side(0), None), ((png + side(1) + side(1))[:23], None), (b"GIF89a" + bytes(30), None), (b"", None), (None, None),
    ]
    frame = spark.createDataFrame([(i, data) for i, (data, _) in enumerate(cases)], "i int, content binary")
    got = {r.i: r.size and tuple(r.size) for r in frame.select("i", readers.image_size(F.col("content")).alias("size")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}
    assert frame.limit(0).select(readers.image_size(F.col("content"))).isEmpty()


def test_parquet_metadata(spark, tmp_path):
    for i in (1, 2, 4):
        spark.range(10 * i).withColumn("x", F.col("id")).coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
    (tmp_path / "p3").mkdir()
    (tmp_path / "p3" / "x.parquet").write_bytes(b"PAR1 nothing")
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "p5"))
    got = readers.parquet_metadata(spark, f"file://{tmp_path}", ["x"]).orderBy("path").collect()
    assert [(r.rows, r.first_row) for r in got] == [(10, 0), (20, 10), (None, None), (40, 30), (5, None)]
    assert [r.status == "ok" for r in got] == [True, True, False, True, False]
    assert "missing columns" in got[4].status
