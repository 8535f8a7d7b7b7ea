"""Table or chart: long straight lines, where they cross and what they cover.

Lines are opened with a thirtieth of the image's side and count if their
component reaches ``ratio`` of it.  An image in which enough places hold a
crossing (connected pixels count once), whose long horizontal lines cover a
quarter of its columns and whose long vertical lines cover a quarter of its rows is
a chart; any other one, a blank one included, is a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import written
from . import raster


def long_lines(mask: DataFrame, sizes: DataFrame, ratio: float = 0.4) -> tuple[DataFrame, DataFrame]:
    """Pixels of the horizontal and of the vertical lines that reach ``ratio`` of
    their image's side and four pixels; sizes: (image_id, width, height)."""
    side = {"x": F.col("width"), "y": F.col("height")}
    opened = [raster.lines(mask, axis, sizes.select("image_id", side[axis].alias("dim"))) for axis in "xy"]
    found = zip("xy", raster.labelled_each(opened))
    least = {axis: sizes.select("image_id", F.greatest(F.lit(4), F.floor(F.lit(ratio) * side[axis])).alias("least")) for axis in "xy"}
    h, v = (raster.long_components(labels, axis, least[axis]) for axis, labels in found)
    return h, v


def classified(pixels: DataFrame, crossings: int = 10, cover: float = 0.25, ratio: float = 0.4) -> DataFrame:
    """(image_id, crossings, rows, cols, h_coverage, v_coverage, is_table) for
    every image of (image_id, y, x, g); rows and cols are those of the grid that the
    crossings make, 0 without any."""
    sizes = written(raster.sizes(pixels), "sizes")
    fg = written(raster.adaptive_mask(pixels), "foreground")
    h, v = (written(lines, "long-lines") for lines in long_lines(fg, sizes, ratio))
    stats = written(raster.component_stats(raster.labelled(raster.both_masks(h, v))), "crossings")
    apart = sizes.select("image_id", F.greatest(F.lit(8), F.expr("least(width, height) div 100")).alias("separation"))
    found = stats.groupBy("image_id").agg(F.count("*").alias("crossings")).join(raster.grid_dimensions(stats, apart), "image_id")
    h_cover = raster.coverage(h, "x", sizes.select("image_id", F.col("width").alias("length"))).withColumnRenamed("fraction", "h_coverage")
    v_cover = raster.coverage(v, "y", sizes.select("image_id", F.col("height").alias("length"))).withColumnRenamed("fraction", "v_coverage")
    all_ = h_cover.join(v_cover, "image_id").join(found, "image_id", "left").na.fill(0, ["crossings", "rows", "cols"])
    chart = (F.col("crossings") >= max(4, crossings // 2)) & (F.col("h_coverage") >= cover) & (F.col("v_coverage") >= cover)
    return all_.select("image_id", "crossings", "rows", "cols", "h_coverage", "v_coverage", (~chart).alias("is_table"))
