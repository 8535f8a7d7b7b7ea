"""Completion and progress of runs as their events come in.

Events are (findex, cindex, palette_size): a layer that is done has its cindex, a
palette that became known its size; either may be null.  Spark keeps a state per
file, the set of its done layers and its palette's size, and gives each changed
file's counts in each micro-batch.  A batch that is run again replaces its own
folder, so a stream that stops goes on from its checkpoint and ends as if it had
not stopped, however the events were split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT = "findex long, cindex int, palette_size int"


def event_stream(spark: SparkSession, path: str, schema: str = EVENT, files_per_batch: int = 1000) -> DataFrame:
    """Events of new Parquet files under a path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def file_counts(events: DataFrame, colours: int) -> DataFrame:
    """(findex, n_done, n_total, all_done) of each file; n_total is the estimate
    ``colours`` until the file's palette is known.  Layers done twice count once,
    and palettes have 256 colours at most, which bounds a file's state."""
    own = events.groupBy("findex").agg(F.size(F.collect_set("cindex")).cast("long").alias("n_done"), F.max("palette_size").alias("known"))
    total = F.coalesce(F.col("known").cast("long"), F.lit(colours).cast("long"))
    return own.select("findex", "n_done", total.alias("n_total"), (F.col("known").isNotNull() & (F.col("n_done") >= F.col("known"))).alias("all_done"))


def count_stream(events: DataFrame, colours: int, out: str, checkpoint: str) -> StreamingQuery:
    """Writes the counts of files that changed to Parquet under ``out``, a folder a batch."""

    def batch(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={n}")

    return file_counts(events, colours).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_counts(spark: SparkSession, out: str) -> DataFrame:
    """The counts of each file as of its last change."""
    rows = spark.read.schema("findex long, n_done long, n_total long, all_done boolean, batch long").parquet(out)
    return rows.groupBy("findex").agg(F.max_by(F.struct("n_done", "n_total", "all_done"), "batch").alias("c")).select("findex", "c.*")


def overall(counts: DataFrame) -> DataFrame:
    """One row: layers done, in all, and percent to one decimal; null without layers."""
    return counts.agg(F.sum("n_done").alias("n_done"), F.sum("n_total").alias("n_total")).withColumn("percent", F.round(F.try_divide(F.col("n_done") * F.lit(100.0), F.col("n_total")), 1))
