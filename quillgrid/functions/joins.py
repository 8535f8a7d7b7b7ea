"""A join in which one key may have a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

#: A key with more rows than this is hot; its join is dealt out in parts of this size.
HOT_ROWS = 100_000
#: Hot keys that may be broadcast (a few dozen bytes each).
MAX_BROADCAST_KEYS = 1_000_000


def hot_join(rows: DataFrame, keyed: DataFrame, key: str, spread: Column) -> DataFrame:
    """Inner join of ``rows`` with ``keyed`` on ``key``, without a hot key in one task.

    keyed: one row per key, with ``copies``, how many rows carry it (not
    returned).  Keys with more than ``HOT_ROWS`` of them, of which there are at
    most rows / ``HOT_ROWS``, are dealt out in as many parts by the hash of
    ``spread``, a column of ``rows``; their row in ``keyed`` goes to each part.
    """
    parts = F.ceil(F.col("copies") / HOT_ROWS)
    hot = written(keyed.where(F.col("copies") > HOT_ROWS).select(F.col(key).alias("__key"), parts.alias("__parts")), "hot-keys")
    n = hot.limit(MAX_BROADCAST_KEYS + 1).count()
    if not n:
        return rows.join(keyed.drop("copies"), key)
    dealt = rows.join(F.broadcast(hot) if n <= MAX_BROADCAST_KEYS else hot, F.col(key) == F.col("__key"), "left")
    dealt = dealt.withColumn("__part", F.coalesce(F.pmod(F.xxhash64(spread), "__parts"), F.lit(0))).drop("__key", "__parts")
    each = keyed.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("copies")
    return dealt.join(each, [key, "__part"]).drop("__part")
