"""Raster operators on pixel tables (image_id, y, x and channels).

Neighbourhoods are bounded window frames inside one row or column of one image,
so an image is never one group.  Masks are sparse: foreground rows only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.storage import written
from .graph import components

#: Labels and pixel numbers are y * STRIDE + x, whatever an image's width.
STRIDE = 1 << 32
HEX = "printf('#%02x%02x%02x', r, g, b)"
ROW, COLUMN = "PARTITION BY image_id, y ORDER BY x", "PARTITION BY image_id, x ORDER BY y"
MARGIN = 2  # brightness by which the foreground exceeds its surroundings
BLOCK = 15
#: Components are searched in squares of so many pixels a side at first.
TILE = 256


def _known(rows: DataFrame, value: int | float | DataFrame, name: str) -> DataFrame:
    """``rows`` with a number that holds for all images, or each image's own from
    a table (image_id, name)."""
    if isinstance(value, DataFrame):
        return rows.join(value.select("image_id", name), "image_id")
    return rows.withColumn(name, F.lit(value))


def sizes(pixels: DataFrame) -> DataFrame:
    """(image_id, width, height) of each image."""
    return pixels.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def palette(pixels: DataFrame) -> DataFrame:
    """(image_id, cindex, color): distinct colours from light to dark; an image
    has a bounded palette, its colours are summed before they are ordered."""
    colours = pixels.select("image_id", "r", "g", "b").distinct()
    return colours.selectExpr("image_id", "CAST(row_number() OVER (PARTITION BY image_id ORDER BY r DESC, g DESC, b DESC) - 1 AS INT) AS cindex", f"{HEX} AS color")


def without_background(colours: DataFrame, background: str) -> DataFrame:
    return colours.where(F.lower("color") != background.lower())


def unused_colour(colours: DataFrame, extra: list[str], from_black: bool = True) -> DataFrame:
    """(image_id, color): the first colour, from black up or white down, that
    neither the palette nor ``extra`` holds.  Of n + 1 candidates one is free."""
    spark = colours.sparkSession
    used = colours.select("image_id", F.lower("color").alias("color"))
    if extra:
        more = spark.createDataFrame([(c.lower(),) for c in extra], "color string")
        used = used.unionByName(colours.select("image_id").distinct().crossJoin(F.broadcast(more)))
    used = used.distinct()
    step = F.col("k") if from_black else F.lit(0xFFFFFF) - F.col("k")
    free = used.groupBy("image_id").count().select("image_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count"))).alias("k"))
    free = free.withColumn("color", F.format_string("#%06x", step)).join(used, ["image_id", "color"], "left_anti")
    return free.groupBy("image_id").agg(F.min_by("color", "k").alias("color"))


def remapped(pixels: DataFrame, colours: DataFrame) -> DataFrame:
    """Pixels in the nearest palette colour (squared distance, then the lower
    index).  Distances are taken per distinct colour, not per pixel."""
    own = pixels.select("image_id", "r", "g", "b").distinct()
    d = "(r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb)"
    near = own.join(colours, "image_id").groupBy("image_id", "r", "g", "b").agg(F.expr(f"min_by(named_struct('pr', pr, 'pg', pg, 'pb', pb), named_struct('d', {d}, 'i', cindex))").alias("n"))
    return pixels.join(near, ["image_id", "r", "g", "b"]).selectExpr("image_id", "y", "x", "n.pr AS r", "n.pg AS g", "n.pb AS b")


def isolated(pixels: DataFrame, colours: DataFrame, index: int, stack: bool = False) -> DataFrame:
    """Black where the palette index is the wanted one (or above, if stacked), white elsewhere."""
    i = pixels.selectExpr("*", f"{HEX} AS color").join(colours.select("image_id", "color", "cindex"), ["image_id", "color"], "left")
    hit = (F.col("cindex") == index) | (F.col("cindex") > index if stack else F.lit(False))
    return i.select("image_id", "y", "x", F.when(hit, 0).otherwise(255).alias("v"))


def filled(pixels: DataFrame) -> DataFrame:
    """Black where a pixel is not transparent."""
    return pixels.select("image_id", "y", "x", F.when(F.col("alpha") > 0, 0).otherwise(255).alias("v"))


def widths(pixels: DataFrame, dpi: int = 90) -> DataFrame:
    return pixels.groupBy("image_id").agg((F.max("x") + 1).alias("width_px")).withColumn("width_in", F.round(F.col("width_px") / dpi, 6))


def grey(pixels: DataFrame) -> DataFrame:
    """Integer luma with weights 299, 587 and 114 in a thousand, rounded."""
    return pixels.selectExpr("image_id", "y", "x", "CAST((r * 299 + g * 587 + b * 114 + 500) div 1000 AS INT) AS v")


def replaced_near(pixels: DataFrame, colour: tuple[int, int, int], fuzz: float = 0.2) -> DataFrame:
    """White where a colour is within a share of the longest colour distance."""
    r, g, b = colour
    most = int(3 * 255 * 255 * fuzz * fuzz)
    near = F.expr(f"(r - {r}) * (r - {r}) + (g - {g}) * (g - {g}) + (b - {b}) * (b - {b}) <= {most}")
    return pixels.select("image_id", "y", "x", *(F.when(near, 255).otherwise(F.col(c)).alias(c) for c in "rgb"))


def point_rescaled(pixels: DataFrame, k: int) -> DataFrame:
    """Each pixel as k x k pixels."""
    step = F.sequence(F.lit(0), F.lit(k - 1))
    up = pixels.select("*", F.explode(step).alias("dy")).select("*", F.explode(step).alias("dx"))
    return up.select("image_id", (F.col("y") * k + F.col("dy")).alias("y"), (F.col("x") * k + F.col("dx")).alias("x"), "g")


def median_cut(pixels: DataFrame, colours: int) -> DataFrame:
    """One-channel quantisation into equally filled buckets by value; the
    representative is the bucket's rounded mean.

    The buckets are cut on the counts of values, at most 256 rows an image, so
    no image is sorted as a whole; equal values stay together.
    """
    n = pixels.groupBy("image_id", "g").agg(F.count("*").alias("n"))
    w = "PARTITION BY image_id"
    at = n.selectExpr("*", f"sum(n) OVER ({w} ORDER BY g ROWS UNBOUNDED PRECEDING) - n AS before", f"sum(n) OVER ({w}) AS total").withColumn("bucket", F.expr(f"CAST(before * {colours} div total AS INT)"))
    mean = at.groupBy("image_id", "bucket").agg(F.expr("CAST((2 * sum(g * n) + sum(n)) div (2 * sum(n)) AS INT)").alias("q"))
    return pixels.join(at.select("image_id", "g", "bucket").join(mean, ["image_id", "bucket"]), ["image_id", "g"]).select("image_id", "y", "x", "q")


def median_cut_rgb(pixels: DataFrame, rounds: int) -> DataFrame:
    """Quantisation to at most 2^rounds colours: in each round every box of
    colours is halved by pixels along its widest channel (ties: r, g, b); a box
    is shown by its rounded mean.

    The rounds run on distinct colours with their counts, one window each, not on
    pixels.
    """
    at = pixels.groupBy("image_id", "r", "g", "b").agg(F.count("*").alias("n")).withColumn("box", F.lit(0))
    w = "PARTITION BY image_id, box"
    for _ in range(rounds):
        spread = (f"max({c}) OVER ({w}) - min({c}) OVER ({w}) AS d{c}" for c in "rgb")
        keyed = at.selectExpr("*", *spread).withColumn("k", F.expr("CASE WHEN dr >= dg AND dr >= db THEN r WHEN dg >= db THEN g ELSE b END"))
        cut = keyed.selectExpr("*", f"sum(n) OVER ({w} ORDER BY k, r, g, b ROWS UNBOUNDED PRECEDING) - n AS before", f"sum(n) OVER ({w}) AS total")
        at = cut.selectExpr("image_id", "r", "g", "b", "n", "2 * box + CAST(2 * before >= total AS INT) AS box")
    mean = at.groupBy("image_id", "box").agg(*(F.expr(f"CAST((2 * sum({c} * n) + sum(n)) div (2 * sum(n)) AS INT)").alias(f"q{c}") for c in "rgb"))
    known = at.select("image_id", "r", "g", "b", "box").join(mean, ["image_id", "box"])
    return pixels.join(known, ["image_id", "r", "g", "b"]).selectExpr("image_id", "y", "x", "qr AS r", "qg AS g", "qb AS b")


def adaptive_mask(pixels: DataFrame) -> DataFrame:
    """Foreground: darker than the mean of the block around it by more than the
    margin; at the border the mean is that of what is there.  Two separable
    window sums over integers."""
    half = BLOCK // 2
    frame = f"ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING"
    rows = pixels.selectExpr("image_id", "y", "x", "255 - g AS v").selectExpr("*", f"sum(v) OVER ({ROW} {frame}) AS s1", f"count(*) OVER ({ROW} {frame}) AS n1")
    both = rows.selectExpr("image_id", "y", "x", "v", f"sum(s1) OVER ({COLUMN} {frame}) AS s", f"sum(n1) OVER ({COLUMN} {frame}) AS n")
    return both.where(f"v * n > s + {MARGIN} * n").select("image_id", "y", "x")


def lines(mask: DataFrame, axis: str, dim: int | DataFrame) -> DataFrame:
    """Opening with a line of dim // 30 pixels (1 at least) along an axis: runs
    shorter than that vanish, longer ones stay whole.  dim: the image's side, one
    for all or (image_id, dim)."""
    other = "y" if axis == "x" else "x"
    runs = mask.selectExpr("*", f"{axis} - row_number() OVER (PARTITION BY image_id, {other} ORDER BY {axis}) AS run")
    counted = runs.selectExpr("*", f"count(*) OVER (PARTITION BY image_id, {other}, run) AS n")
    return _known(counted, dim, "dim").where("n >= greatest(1, dim div 30)").select("image_id", "y", "x")


def eroded(pixels: DataFrame, threshold: int) -> DataFrame:
    """Bilevel by a threshold, then erosion with a diamond: the least of a pixel and its four neighbours."""
    bw = pixels.selectExpr("image_id", "y", "x", f"CASE WHEN g > {threshold} THEN 255 ELSE 0 END AS v")
    near = ", ".join(f"coalesce({f}(v) OVER ({w}), v)" for w in (ROW, COLUMN) for f in ("lag", "lead"))
    return bw.selectExpr("image_id", "y", "x", f"least(v, {near}) AS v")


def tile_labels(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For pixels in the order of (y, x), the number of the first one of each one's
    8-connected component.  Roots hang on smaller roots next to them and pointers
    are then cut short, so rounds grow with the logarithm of the pixels."""
    top, left = int(y.min()), int(x.min())
    grid = np.full((int(y.max()) - top + 3, int(x.max()) - left + 3), -1, np.int64)
    y, x = y - top + 1, x - left + 1
    grid[y, x] = np.arange(len(y))
    pairs = [(np.arange(len(y)), grid[y + dy, x + dx]) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))]
    u, v = (np.concatenate(side) for side in zip(*((a[b >= 0], b[b >= 0]) for a, b in pairs)))
    label = np.arange(len(y))
    while True:
        low, high = np.minimum(label[u], label[v]), np.maximum(label[u], label[v])
        apart = low != high
        if not apart.any():
            return label
        u, v = u[apart], v[apart]
        np.minimum.at(label, high[apart], low[apart])
        while (label != label[label]).any():
            label = label[label]


def _in_tile(rows: pa.Table) -> pa.Table:
    """Pixels of one tile with their component's least number in the tile."""
    y, x = (rows.column(c).to_numpy().astype(np.int64) for c in ("y", "x"))
    order = np.lexsort((x, y))
    at = (y * STRIDE + x)[order]
    rows = rows.take(pa.array(order)).select(["mask", "image_id", "y", "x"])
    return rows.append_column("own", pa.array(at[tile_labels(y[order], x[order])]))


def labelled_each(masks: list[DataFrame], tile: int = TILE) -> list[DataFrame]:
    """(image_id, y, x, label) for each mask: label is the least y * STRIDE + x of
    the pixel's 8-connected component in its mask.

    Components are found tile by tile; only those that touch across a border of
    tiles become edges, and one search joins them for all masks.  A repeated
    pixel counts once.
    """
    pixels = None
    for k, mask in enumerate(masks):
        own = mask.select(F.lit(k).alias("mask"), "image_id", "y", "x")
        pixels = own if pixels is None else pixels.unionByName(own)
    at = ["mask", "image_id", "y", "x"]
    tiles = pixels.distinct().withColumns({"ty": F.floor(F.col("y") / tile), "tx": F.floor(F.col("x") / tile)}).groupBy("mask", "image_id", "ty", "tx")
    found = written(tiles.applyInArrow(_in_tile, T.StructType([*(pixels.schema[c] for c in at), T.StructField("own", T.LongType())])), "tiles")
    last = {c: F.pmod(F.col(c), F.lit(tile)) == tile - 1 for c in "yx"}
    edge = found.where(last["y"] | last["x"] | (F.pmod("y", F.lit(tile)) == 0) | (F.pmod("x", F.lit(tile)) == 0))
    place = lambda dy, dx: F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"))
    beside = F.concat(F.when(last["x"], F.array(*(place(dy, 1) for dy in (-1, 0, 1)))).otherwise(F.array()), F.when(last["y"], F.array(*(place(1, dx) for dx in (-1, 0, 1)))).otherwise(F.array()))
    across = edge.select("mask", "image_id", "own", F.explode(beside).alias("b")).select("mask", "image_id", "b.y", "b.x", F.col("own").alias("near"))
    node = lambda c: F.struct("mask", "image_id", F.col(c).alias("at"))
    edges = written(across.join(edge, at).where("near <> own").select(node("near").alias("u"), node("own").alias("v")).distinct(), "tile-edges")
    if edges.isEmpty():
        whole = found.withColumnRenamed("own", "label")
    else:
        roots = components(edges).select(F.col("v.mask").alias("mask"), F.col("v.image_id").alias("image_id"), F.col("v.at").alias("own"), F.col("root.at").alias("root"))
        whole = found.join(roots, ["mask", "image_id", "own"], "left").withColumn("label", F.coalesce("root", "own"))
    return [whole.where(F.col("mask") == k).select("image_id", "y", "x", "label") for k in range(len(masks))]


def labelled(mask: DataFrame, tile: int = TILE) -> DataFrame:
    """``labelled_each`` for one mask."""
    return labelled_each([mask], tile)[0]


def component_stats(labels: DataFrame) -> DataFrame:
    """Box, area and centre of each component."""
    return labels.groupBy("image_id", "label").agg(
        F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"), F.count("*").alias("area"), (F.sum("x") / F.count("*")).alias("cx"), (F.sum("y") / F.count("*")).alias("cy")
    )


def long_components(labels: DataFrame, axis: str, least: int | DataFrame) -> DataFrame:
    """Pixels of components that are at least so long on an axis; least: one
    number for all images or (image_id, least)."""
    kept = _known(component_stats(labels), least, "least").where(f"{'w' if axis == 'x' else 'h'} >= least").select("image_id", "label")
    return labels.join(kept, ["image_id", "label"], "left_semi").select("image_id", "y", "x")


def despeckled(labels: DataFrame, most: int) -> DataFrame:
    """Pixels of components larger than a speckle."""
    kept = labels.groupBy("image_id", "label").count().where(F.col("count") > most)
    return labels.join(kept, ["image_id", "label"], "left_semi").select("image_id", "y", "x")


def coverage(mask: DataFrame, axis: str, length: int | DataFrame) -> DataFrame:
    """(image_id, fraction): share of columns (rows) with a pixel; with each
    image's own length, (image_id, length), images without a pixel have 0."""
    seen = mask.select("image_id", axis).distinct().groupBy("image_id").agg(F.count("*").alias("n"))
    if isinstance(length, DataFrame):
        seen = length.select("image_id", "length").join(seen, "image_id", "left").na.fill(0, ["n"])
    else:
        seen = seen.withColumn("length", F.lit(length))
    return seen.select("image_id", F.round(F.col("n") / F.col("length"), 6).alias("fraction"))


def both_masks(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def grid_dimensions(stats: DataFrame, separation: float | DataFrame) -> DataFrame:
    """(image_id, rows, cols): clusters of component centres on each axis; one
    begins where a centre is further than ``separation`` (one for all images or
    (image_id, separation)) from the last one's first centre.  The ordered fold
    runs over the distinct centres of one image."""

    own = _known(stats, separation, "separation").groupBy("image_id").agg(F.array_sort(F.collect_set("cy")).alias("ys"), F.array_sort(F.collect_set("cx")).alias("xs"), F.max("separation").cast("double").alias("sep"))
    fold = "aggregate({v}, named_struct('n', 0, 'a', CAST(NULL AS DOUBLE)), (s, v) -> IF(s.a IS NULL OR v - s.a > sep, named_struct('n', s.n + 1, 'a', v), s)).n"
    return own.select("image_id", F.expr(fold.format(v="ys")).alias("rows"), F.expr(fold.format(v="xs")).alias("cols"))
