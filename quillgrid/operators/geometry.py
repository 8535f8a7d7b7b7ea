"""Vector paths and word boxes: transforms, anchors and the spatial match.

A path's anchor is its first move command under the transforms of its ancestors,
outermost first, its own last.  The match of anchors to boxes is a range join;
both sides meet in cells of grids of several levels, so that it is an equi-join on
(page, level, cell) whose rows are checked against the closed box.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import dropped, written

FILL = "#666666"
FONT = "Arial, sans-serif"


def _part(kind: str, source: str, i: int) -> str:
    return rf"try_cast(regexp_extract({source}, '{kind}\\(\\s*([\\d.-]+)\\s*,?\\s*([\\d.-]+)?\\s*\\)', {i}) AS DOUBLE)"


def transform_sql(source: str) -> str:
    """SQL struct of one transform attribute: the first translate and scale of it."""
    tx, ty, sx, sy = _part("translate", source, 1), _part("translate", source, 2), _part("scale", source, 1), _part("scale", source, 2)
    return f"named_struct('tx', coalesce({tx}, 0D), 'ty', coalesce({ty}, 0D), 'sx', coalesce({sx}, 1D), 'sy', coalesce({sy}, {sx}, 1D))"


def parsed_transforms(paths: DataFrame) -> DataFrame:
    """One row per transform attribute with tx, ty, sx, sy."""
    each = paths.select("path_id", F.posexplode("transforms").alias("depth", "attribute"))
    return each.withColumn("t", F.expr(transform_sql("attribute"))).select("path_id", "depth", "attribute", "t.*")


def cumulative_transforms(paths: DataFrame) -> DataFrame:
    """``paths`` with the fold of their transforms: at each step the translation
    counts in the scale so far, then the scale is multiplied."""
    t = transform_sql("a")
    fold = f"""aggregate(transforms, named_struct('sx', 1D, 'sy', 1D, 'tx', 0D, 'ty', 0D), (c, a) -> transform(array({t}), t ->
      named_struct('sx', c.sx * t.sx, 'sy', c.sy * t.sy, 'tx', c.tx + t.tx * c.sx, 'ty', c.ty + t.ty * c.sy))[0])"""
    return paths.withColumn("m", F.expr(fold))


def tree_transforms(nodes: DataFrame) -> DataFrame:
    """(page, node_id, sx, sy, tx, ty): the cumulative transform of each element of
    a tree, from (page, node_id, parent_id, tag, transform).

    Ancestors count up to the nearest svg, which does not.  Transforms of a chain
    join two by two, so pointers double in each round: as many rounds, each written
    to the shared folder, as the depth has binary digits.  Elements whose parent is
    missing end there; circles of parents are an error.
    """
    own = nodes.withColumn("m", F.expr(transform_sql("coalesce(transform, '')"))).where("lower(tag) <> 'svg'")
    now = written(own.join(own.select("page", F.col("node_id").alias("parent_id"), F.lit(True).alias("goes_on")), ["page", "parent_id"], "left").select("page", "node_id", F.when(F.col("goes_on"), F.col("parent_id")).alias("up"), "m.*"), "tree")
    for _ in range(64):
        if now.where("up IS NOT NULL").isEmpty():
            return now.select("page", "node_id", "sx", "sy", "tx", "ty")
        above = now.select("page", F.col("node_id").alias("up"), F.col("up").alias("further"), *(F.col(c).alias(f"a{c}") for c in ("sx", "sy", "tx", "ty")))
        both = now.join(above, ["page", "up"], "left")
        outer = lambda c: F.coalesce(f"a{c}", F.lit(float(c[0] == "s")))
        before, now = now, written(both.select("page", "node_id", F.col("further").alias("up"), *((outer(f"s{k}") * F.col(f"s{k}")).alias(f"s{k}") for k in "xy"), *((outer(f"t{k}") + F.col(f"t{k}") * outer(f"s{k}")).alias(f"t{k}") for k in "xy")), "tree")
        dropped(before)  # its round is over
    raise ValueError("elements whose parents run in a circle")


def start_points(paths: DataFrame) -> DataFrame:
    """(page, path_id, path_ord, x, y) of paths that begin with a move command."""
    return moved_points(cumulative_transforms(paths))


def moved_points(at: DataFrame) -> DataFrame:
    """The same of paths whose whole transform is already known (``m``)."""
    x0, y0 = (F.expr(rf"try_cast(regexp_extract(d, '^[Mm]\\s*([\\d.-]+)[\\s,]+([\\d.-]+)', {i}) AS DOUBLE)") for i in (1, 2))
    return at.withColumns({"x0": x0, "y0": y0}).where("x0 IS NOT NULL AND y0 IS NOT NULL").selectExpr("page", "path_id", "path_ord", "x0 * m.sx + m.tx AS x", "y0 * m.sy + m.ty AS y")


def match_paths(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """(page, path_id, path_ord, word_id, left, top, text): the first box, by
    word order, that holds the point; points in no box give no row.

    A box lies in the grid of its level, whose cells are at least as long as its
    longer side, so it is in four cells at most, whatever its size.  A point looks
    into one cell of each level that its page has, some sixty at most.  Boxes
    of negative size or without a number hold nothing.
    """
    whole = boxes.where("width >= 0 AND height >= 0 AND left IS NOT NULL AND top IS NOT NULL")
    sized = whole.withColumn("level", F.ceil(F.log2(F.greatest("width", "height", F.lit(1)))).cast("int"))
    side = F.pow(F.lit(2.0), F.col("level"))
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / side), F.floor(F.expr(hi) / side)))
    cells = sized.withColumn("cx", span("left", "left + width")).withColumn("cy", span("top", "top + height"))
    levels = sized.groupBy("page").agg(F.collect_set("level").alias("levels"))
    at = points.join(levels, "page").withColumn("level", F.explode("levels")).drop("levels")
    at = at.withColumn("cx", F.floor(F.col("x") / side)).withColumn("cy", F.floor(F.col("y") / side))
    hits = at.join(cells.select("page", "level", "cx", "cy", "word_id", "word_ord", "left", "top", "width", "height"), ["page", "level", "cx", "cy"]).where("x BETWEEN left AND left + width AND y BETWEEN top AND top + height")
    # numbers only, so that the least is kept in place without a sort; the texts come after
    first = hits.groupBy("page", "path_id", "path_ord").agg(F.min(F.struct("word_ord", "word_id")).alias("w")).select("page", "path_id", "path_ord", "w.*")
    return first.join(boxes.select("page", "word_ord", "word_id", "left", "top", "text").dropDuplicates(["page", "word_ord", "word_id"]), ["page", "word_ord", "word_id"]).select("page", "path_id", "path_ord", "word_id", "left", "top", "text")


def paths_per_word(matches: DataFrame) -> DataFrame:
    """Matches by the corner of their box; the text is that of the first path."""
    return matches.groupBy("page", "left", "top").agg(F.count("*").alias("n_paths"), F.min_by("text", "path_ord").alias("text"))


def without_matched(paths: DataFrame, matches: DataFrame) -> DataFrame:
    """Paths that no word has; ids are those of a page and may be another page's, too."""
    return paths.join(matches.select("page", "path_id"), ["page", "path_id"], "left_anti")


def coloured_groups(groups: DataFrame) -> DataFrame:
    """Fills for a document's groups if there are exactly three of them."""
    n = F.count("*").over(Window.partitionBy("doc_id"))
    return groups.withColumn("fill", F.when(n == 3, F.get(F.array(*map(F.lit, ("red", "green", "gray"))), F.col("ord"))))


def text_layer(groups: DataFrame) -> DataFrame:
    """Text elements for groups with visible text: base line at the box's bottom."""
    from .ocr import trimmed

    seen = groups.where(trimmed(F.col("text")) != "")
    return seen.select(
        "src",
        "ord",
        F.format_string("%.2f", F.col("left").cast("double")).alias("x"),
        F.format_string("%.2f", (F.col("top") + F.col("height")).cast("double")).alias("y"),
        F.concat(F.floor(F.col("height") * F.lit(1.1) + 0.5).cast("string"), F.lit("px")).alias("font_size"),
        F.lit(FILL).alias("fill"),
        F.lit(FONT).alias("font_family"),
        "text",
    )
