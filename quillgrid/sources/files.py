"""Readers and writers of OCR tables, images, palettes and vector documents."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ocr


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """OCR rows of the files under a path; src is the file, ord the line."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("src"), F.regexp_replace("value", "\r\n", "\n").alias("content"))
    return ocr.parse_tsv(whole)


def write_tsv(words: DataFrame, path: str) -> None:
    """Rows as tab-separated text, a folder for each src; lines stay in order."""
    lines = ocr.tsv_lines(words).repartition("src").sortWithinPartitions("src", "ord")
    lines.select("src", F.col("line").alias("value")).write.partitionBy("src").text(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, y, x, r, g, b) of the images under a path; the origin is the
    id.  A file that cannot be decoded is an error, not a skipped row."""
    raw = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    good = raw.withColumn("data", F.when(F.col("height") > 0, F.col("data")).otherwise(F.raise_error(F.concat(F.lit("unreadable image "), "origin")).cast("binary")))
    rows = good.select(F.col("origin").alias("image_id"), "width", "nChannels", "data", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    at = rows.select("image_id", "y", "nChannels", "data", "width", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))

    def channel(k: int):
        # rows are blue, green, red; one-channel images repeat their value
        first = (F.col("y") * F.col("width") + F.col("x")) * F.col("nChannels")
        return F.conv(F.hex(F.substring(F.col("data"), first + F.when(F.col("nChannels") >= 3, k).otherwise(0) + 1, F.lit(1))), 16, 10).cast("int")

    return at.select("image_id", "y", "x", channel(2).alias("r"), channel(1).alias("g"), channel(0).alias("b"))


def png(pixels: np.ndarray) -> bytes:
    """A picture (height, width, 3) of bytes as a PNG file."""
    height, width, _ = pixels.shape
    rows = np.concatenate((np.zeros((height, 1), np.uint8), pixels.reshape(height, width * 3)), axis=1)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows.tobytes())) + part(b"IEND", b"")


def write_images(pixels: DataFrame, path: str) -> DataFrame:
    """(image_id, file) of the PNG files, one for each image of (image_id, y, x, r,
    g, b), that are written under a path; pixels that are missing are black.  A file
    that a task writes again replaces the one before it."""

    def run(rows: pa.Table) -> pa.Table:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path)
        y, x = (rows.column(c).to_numpy() for c in "yx")
        picture = np.zeros((int(y.max()) + 1, int(x.max()) + 1, 3), np.uint8)
        picture[y, x] = np.stack([rows.column(c).to_numpy() for c in "rgb"], 1)
        store.create_dir(base, recursive=True)
        name = f"{base}/{rows.column('image_id')[0].as_py()}.png"
        with store.open_output_stream(name, compression=None) as out:
            out.write(png(picture))
        return pa.table({"image_id": rows.column("image_id").slice(0, 1), "file": pa.array([name])})

    return pixels.select("image_id", "y", "x", "r", "g", "b").groupBy("image_id").applyInArrow(run, f"image_id {dict(pixels.dtypes)['image_id']}, file string")


def read_ppm_palette(spark: SparkSession, path: str) -> DataFrame:
    """(src, cindex, color) of plain-text pixel maps, last colour first; comments
    and blank lines do not count, an incomplete last colour is dropped."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("src"), F.regexp_replace("value", r"#[^\n]*", "").alias("v"))
    numbers = whole.select("src", F.filter(F.split("v", r"\s+"), lambda x: x != "").alias("n"))
    # magic number, width, height and maximum come first
    values = numbers.select("src", F.expr("slice(n, 5, size(n))").alias("n")).withColumn("k", F.floor(F.size("n") / 3).cast("int"))
    each = values.where("k > 0").select("src", "n", "k", F.explode(F.expr("sequence(0, k - 1)")).alias("i"))
    byte = lambda j: F.expr(f"cast(n[3 * i + {j}] as int)")
    return each.select("src", (F.col("k") - 1 - F.col("i")).alias("cindex"), F.format_string("#%02x%02x%02x", byte(0), byte(1), byte(2)).alias("color"))


def read_svg(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, svg): documents under a path, the file as id."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("svg"))


def write_documents(docs: DataFrame, path: str, col: str = "document") -> None:
    """One text row per document."""
    docs.select(F.col(col).alias("value")).write.text(path, lineSep="\n\n")
