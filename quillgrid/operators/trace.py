"""From pixels to a layered vector document: quantise, isolate, despeckle, outline.

Each colour of an image is a mask of its own.  An image whose masks fit into a task's
memory is traced there as a whole; the masks of larger ones go through components,
outlines and polygons together, as one table, whose rounds know no bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import map_whole
from ..functions.storage import written
from . import contours, raster, resample, tracebatches
from .svgtext import SVG

#: Cells of all masks of an image that one task traces, and its pixels' rows.
CELLS = 1 << 22


def colour_masks(pixels: DataFrame, palette: DataFrame, stack: bool = False) -> DataFrame:
    """(image_id: struct of image_id and cindex, y, x): where an image has a colour
    of its palette (image_id, cindex, color) or, stacked, one that comes later in it."""
    at = pixels.selectExpr("image_id", "y", "x", f"{raster.HEX} AS color").join(palette, ["image_id", "color"])
    if stack:
        at = at.withColumn("cindex", F.explode(F.sequence(F.lit(0), F.col("cindex"))))
    return at.select(F.struct("image_id", "cindex").alias("image_id"), "y", "x")


def traced(pixels: DataFrame, colours: int, speckle: int = 2, tolerance: float = 1.5, stack: bool = False) -> DataFrame:
    """(image_id, document): each image of (image_id, y, x, r, g, b) as a drawing of
    at most ``colours`` layers, in the order of its palette from light to dark.

    Components of at most ``speckle`` pixels of a layer vanish (0: none do).  A layer is one
    path of closed rings, filled by parity, whose corners are within ``tolerance``
    of the pixels' outlines; stacked layers hold all later ones.  0 colours: as many
    as the image has.
    """
    flat = written(resample.octree(pixels, colours) if colours else pixels.select("image_id", "y", "x", "r", "g", "b"), "flat")
    span = lambda c: F.max(c).cast("long") - F.min(c) + 3
    size = flat.groupBy("image_id").agg((span("y") * span("x")).alias("area"), F.count("*").alias("n"))
    seen = flat.select("image_id", "r", "g", "b").distinct().groupBy("image_id").agg(F.count("*").alias("colours"))
    large = written(size.join(seen, "image_id").where((F.col("area") * F.col("colours") > CELLS) | (F.col("n") > CELLS)).select("image_id"), "large-images")
    if large.isEmpty():
        return _as_a_whole(flat, speckle, tolerance, stack)
    return _as_a_whole(flat.join(large, "image_id", "left_anti"), speckle, tolerance, stack).unionByName(_in_rounds(written(flat.join(large, "image_id", "left_semi"), "flat"), speckle, tolerance, stack))


def _as_a_whole(flat: DataFrame, speckle: int, tolerance: float, stack: bool) -> DataFrame:
    rows = flat.select("image_id", "y", "x", "r", "g", "b").repartition("image_id").sortWithinPartitions("image_id")
    kind = flat.schema["image_id"].dataType.simpleString()
    return map_whole(rows, 1, lambda part: tracebatches.documents(part, speckle, tolerance, stack), f"image_id {kind}, document string")


def _in_rounds(flat: DataFrame, speckle: int, tolerance: float, stack: bool) -> DataFrame:
    palette = written(raster.palette(flat), "palette")
    masks = colour_masks(flat, palette, stack)
    if speckle:
        masks = written(raster.despeckled(raster.labelled(masks), speckle), "masks")
    rings = contours.rings(masks)
    if tolerance > 0:
        rings = contours.simplified(rings, tolerance)
    layers = contours.outlines(rings).select("image_id.image_id", "image_id.cindex", "ring", "d").join(palette, ["image_id", "cindex"])
    d = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ring", "d"))), lambda r: r["d"]), " ")
    layers = layers.groupBy("image_id", "cindex", "color").agg(d.alias("d"))
    body = F.concat(F.lit('<g id="layer'), "cindex", F.lit('"><path fill="'), "color", F.lit('" fill-rule="evenodd" d="'), "d", F.lit('"/></g>'))
    bodies = layers.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("cindex", body.alias("body")))).alias("b"))
    size = raster.sizes(flat).join(bodies, "image_id", "left")
    head = F.concat(F.lit(f'<svg xmlns="{SVG}" version="1.1" width="'), "width", F.lit('" height="'), "height", F.lit('" viewBox="0 0 '), "width", F.lit(" "), "height", F.lit('">\n'))
    lines = F.transform(F.coalesce("b", F.array().cast("array<struct<cindex: int, body: string>>")), lambda x: F.concat(x["body"], F.lit("\n")))
    return size.select("image_id", F.concat(head, F.array_join(lines, ""), F.lit("</svg>")).alias("document"))
