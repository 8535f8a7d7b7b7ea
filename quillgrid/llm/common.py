"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.joins import MAX_BROADCAST_KEYS, hot_join
from ..functions.storage import dropped, lasting, shared_path, temporary, written

__all__ = ["MAX_BROADCAST_KEYS", "dropped", "hot_join", "lasting", "map_arrow", "pieces", "remainder", "shared_path", "table", "temporary", "written"]

#: Rows and bytes of what a task works on at a time; one longer row stands alone.
PIECE_ROWS = 512
PIECE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, through Spark's reader so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batches, rows: int = PIECE_ROWS):
    """The rows of the batches in slices of at most so many rows and, but for
    single longer rows, about ``PIECE_BYTES``."""
    for batch in batches:
        at = 0
        step = max(1, min(rows, PIECE_BYTES * batch.num_rows // max(1, batch.nbytes)))
        while at < batch.num_rows:
            part = batch.slice(at, step)
            while part.num_rows > 1 and part.nbytes > 2 * PIECE_BYTES:  # long rows in a row
                part = part.slice(0, part.num_rows // 2)
            at += part.num_rows
            yield part


def map_arrow(df: DataFrame, run, schema, rows: int = PIECE_ROWS) -> DataFrame:
    """``df.mapInArrow`` over ``pieces`` of Spark's batches, which Spark itself
    bounds by rows and bytes.  Python's and Arrow's free memory goes back to the
    system when a task ends, as workers live on for other stages."""

    def bounded(batches):
        yield from run(pieces(batches, rows))
        gc.collect()
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(bounded, schema)


def remainder(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; null ids count as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % n
