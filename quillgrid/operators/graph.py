"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import HOT_ROWS, hot_join
from ..functions.storage import dropped, written


def _least(edges: DataFrame) -> DataFrame:
    """u and the least of u and its neighbours."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _with_least(edges: DataFrame, most: int) -> DataFrame:
    """``edges`` with m, the least of u and its neighbours; a node with many
    neighbours, such as the least one of a large component, is dealt out.  most: a
    bound of the rows."""
    if most <= HOT_ROWS:
        return edges.join(_least(edges), "u")
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("copies"))
    return hot_join(edges, least, "u", F.col("v"))


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for each node of the edges (u, v): root is the least node of
    its component.  Each round is written to the shared folder and takes the place of the one before; rounds grow with
    the logarithm of the longest path.  Only counts reach the driver.

    Nulls and self-loops are ignored; repeated edges count once; without edges
    the result is empty.
    """
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    rows = edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * rows).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        twice = rows > HOT_ROWS  # large is read twice below
        if twice:
            large = written(large, "edges")
        small = _with_least(large, 2 * rows).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(_least(large).select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = written(small, "edges")
        dropped(edges, *([large] if twice else []))
        edges = after
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, rows = now, now[0]
    return edges.select(F.col("u").alias("v"), F.col("v").alias("root")).unionByName(edges.select("v", F.col("v").alias("root")).distinct())
