"""Readers, writers and the stream of OCR tables."""

import struct
import zlib

from quillgrid.sources import files
from quillgrid.streaming import tsv
from tests.test_ocr import SAMPLE


def png(path, rows):
    raw = b"".join(b"\0" + bytes(v for p in row for v in p) for row in rows)
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 2, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


def test_tsv_round_trip(spark, tmp_path):
    (tmp_path / "a.tsv").write_text(SAMPLE.replace("\n", "\r\n"))
    rows = files.read_tsv(spark, str(tmp_path))
    assert rows.count() == 6
    files.write_tsv(rows.withColumn("src", rows.page_num), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 6


def test_images(spark, tmp_path):
    png(tmp_path / "a.png", [[(1, 2, 3), (4, 5, 6)], [(200, 250, 255), (0, 0, 0)]])
    got = [(r.y, r.x, r.r, r.g, r.b) for r in files.read_images(spark, str(tmp_path)).orderBy("y", "x").collect()]
    assert got == [(0, 0, 1, 2, 3), (0, 1, 4, 5, 6), (1, 0, 200, 250, 255), (1, 1, 0, 0, 0)]


def test_ppm(spark, tmp_path):
    (tmp_path / "a.ppm").write_text("P3\n# c\n2 1\n255\n0 0 0 255 16 1\n9\n")
    assert [(r.cindex, r.color) for r in files.read_ppm_palette(spark, str(tmp_path)).orderBy("cindex").collect()] == [(0, "#ff1001"), (1, "#000000")]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in "ab":
        (tmp_path / "in" / f"{name}.tsv").write_text(SAMPLE)
    q = tsv.group_stream(tsv.tsv_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 6 and got.select("src").distinct().count() == 2
