"""OCR tables that arrive as files: grouped file by file as they come.

A file is complete when it appears, so a micro-batch holds whole files and the
batch operators apply to it unchanged; results are appended to a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ocr


def tsv_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """(src, content) of new files under a path."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return reader.option("maxFilesPerTrigger", files_per_batch).load(path).select(F.col("path").alias("src"), F.decode("content", "UTF-8").alias("content"))


def group_stream(files: DataFrame, out: str, checkpoint: str, scale: float = 1.0) -> StreamingQuery:
    """Writes the filtered word groups of each file to Parquet under ``out``, a
    folder per batch; a batch that is run again replaces its folder."""

    def batch(df: DataFrame, n: int) -> None:
        words = ocr.scaled(ocr.words_by_level(ocr.parse_tsv(df)), scale)
        ocr.long_or_numeric(ocr.word_groups(words)).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
