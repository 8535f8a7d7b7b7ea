"""Box layouts: sizes, running offsets, stretch and alignment.

Items are (layout_id, pos, w, h, stretch, align); a layout is a bounded group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import written

# Alignment flags.
LEFT, RIGHT, HCENTER, TOP, BOTTOM, VCENTER = 0x01, 0x02, 0x04, 0x20, 0x40, 0x80
DIRECTIONS = ("h", "v", "c")


def _axis(direction: str) -> tuple[str, str]:
    if direction not in DIRECTIONS:
        raise NotImplementedError(f"direction {direction}")
    return ("w", "h") if direction == "h" else ("h", "w")


def direction_status(rows: DataFrame) -> DataFrame:
    """``rows`` with status: ok, or not implemented, where a layout would be refused."""
    return rows.withColumn("status", F.when(F.col("direction").isin(*DIRECTIONS), "ok").otherwise("not implemented"))


def unit_values(rows: DataFrame, col: str = "value") -> DataFrame:
    """``rows`` with number, unit and pixels; what has another unit gets nulls."""
    n, u = (F.regexp_extract(col, "^(.*?)(pt|px|in)?$", i) for i in (1, 2))
    r = rows.withColumn("number", n.try_cast("double")).withColumn("unit", F.when(F.col("number").isNotNull(), F.nullif(u, F.lit(""))))
    factor = F.when(F.col("unit") == "pt", 1.25).when(F.col("unit") == "in", 90.0).otherwise(1.0)
    return r.withColumn("px", F.round(F.col("number") * factor, 6))


def box_sizes(items: DataFrame, direction: str, spacing: float = 0, margin: float = 0) -> DataFrame:
    """(layout_id, width, height) of each layout: a composite has its last item's size."""
    along, across = _axis(direction)
    if direction == "c":
        return items.groupBy("layout_id").agg(F.max_by("w", "pos").alias("width"), F.max_by("h", "pos").alias("height"))
    length = (F.sum(along) + F.lit(float(spacing)) * (F.count("*") - 1) + 2 * float(margin)).alias("width" if along == "w" else "height")
    breadth = (F.max(across) + 2 * float(margin)).alias("height" if along == "w" else "width")
    return items.groupBy("layout_id").agg(length, breadth).select("layout_id", "width", "height")


def stretched(items: DataFrame, direction: str, least: float, spacing: float = 0, margin: float = 0) -> DataFrame:
    """Items with ``length`` along the direction after the room up to ``least``
    that items, gaps and margins leave is shared out by stretch; without stretch
    the last item takes it all.  (Down a column the last item grows from its height.)"""
    along, _ = _axis(direction)
    w = "PARTITION BY layout_id"
    # a composite is as long as its last item and the margin behind it
    need = f"max_by({along}, pos) OVER ({w}) + {float(margin)}D" if direction == "c" else f"sum({along}) OVER ({w}) + {float(spacing)}D * (count(*) OVER ({w}) - 1) + {2 * float(margin)}D"
    r = items.selectExpr("*", f"greatest(0D, {float(least)}D - ({need})) AS room", f"sum(stretch) OVER ({w}) AS total", f"max(pos) OVER ({w}) AS last")
    share = F.when(F.col("total") > 0, F.col("stretch") * F.try_divide(F.col("room"), F.col("total"))).when(F.col("pos") == F.col("last"), F.col("room")).otherwise(0.0)
    return r.withColumn("length", F.col(along) + share).drop("room", "total", "last")


def placed(items: DataFrame, direction: str, spacing: float = 0, margin: float = 0, least: float = 0) -> DataFrame:
    """Cells of each item: cx, cy, cw, ch.  Composite items all lie at the origin,
    as wide as the last one."""
    along, across = _axis(direction)
    r = stretched(items, direction, least, spacing, margin)
    breadth = f"max({across}) OVER (PARTITION BY layout_id)"
    if direction == "c":
        return r.selectExpr("layout_id", "pos", "w", "h", "align", "0D AS cx", "0D AS cy", "max_by(w, pos) OVER (PARTITION BY layout_id) AS cw", "length AS ch")
    before = f"{float(margin)}D + coalesce(sum(length + {float(spacing)}D) OVER (PARTITION BY layout_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0D)"
    at = {"cx": before, "cy": f"{float(margin)}D", "cw": "length", "ch": breadth} if along == "w" else {"cx": f"{float(margin)}D", "cy": before, "cw": breadth, "ch": "length"}
    return r.selectExpr("layout_id", "pos", "w", "h", "align", *(f"{e} AS {c}" for c, e in at.items()))


def _put(low: int, high: int, middle: int, at: str, room: str, size: str):
    """Place and size of an item in a cell on one axis."""
    a = F.col("align")
    free = F.col(room) - F.col(size)
    place = F.when(a.bitwiseAND(low) > 0, F.col(at)).when(a.bitwiseAND(high) > 0, F.col(at) + free).when(a.bitwiseAND(middle) > 0, F.col(at) + 0.5 * free).otherwise(F.col(at))
    return place, F.when(a.bitwiseAND(low | high | middle) > 0, F.col(size)).otherwise(F.col(room))


def aligned(cells: DataFrame) -> DataFrame:
    """x, y, width, height of each item in its cell; without a flag it fills the cell."""
    x, width = _put(LEFT, RIGHT, HCENTER, "cx", "cw", "w")
    y, height = _put(TOP, BOTTOM, VCENTER, "cy", "ch", "h")
    return cells.select("layout_id", "pos", x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height"))


def _natural(layouts: DataFrame, items: DataFrame) -> DataFrame:
    """(layout_id, nw, nh): the size that each layout needs, inner ones first; a
    round for each level of nesting, written to the shared folder."""
    known = None
    while True:
        own = items.join(layouts, "layout_id")
        if known is not None:
            inner = known.select(F.col("layout_id").alias("child_id"), "nw", "nh")
            own = own.join(inner, "child_id", "left").withColumn("w", F.coalesce("nw", "w")).withColumn("h", F.coalesce("nh", "h")).drop("nw", "nh")
            own = own.join(known.select("layout_id"), "layout_id", "left_anti")
        waits = F.count_if(F.col("child_id").isNotNull() & (F.col("w").isNull()))
        laid = F.col("kind") != "free"
        n = F.count("*") - 1
        size = own.groupBy("layout_id", "direction", "spacing", "margin").agg(
            waits.alias("waits"), *(f.alias(c) for c, f in (("sw", F.sum(F.when(laid, F.col("w")).otherwise(0.0))), ("mw", F.max(F.when(laid, F.col("w")).otherwise(0.0))), ("lw", F.max_by(F.when(laid, F.col("w")), F.when(laid, F.col("pos")))), ("sh", F.sum(F.when(laid, F.col("h")).otherwise(0.0))), ("mh", F.max(F.when(laid, F.col("h")).otherwise(0.0))), ("lh", F.max_by(F.when(laid, F.col("h")), F.when(laid, F.col("pos")))), ("gaps", n * F.col("spacing"))))
        )
        d = F.col("direction")
        ready = size.where("waits = 0").select(
            "layout_id",
            (F.when(d == "h", F.col("sw") + F.col("gaps")).when(d == "v", F.col("mw")).otherwise(F.coalesce("lw", F.lit(0.0))) + 2 * F.col("margin")).alias("nw"),
            # a composite has one margin in its height
            (F.when(d == "h", F.col("mh")).when(d == "v", F.col("sh") + F.col("gaps")).otherwise(F.coalesce("lh", F.lit(0.0))) + F.when(d == "c", 1).otherwise(2) * F.col("margin")).alias("nh"),
        )
        ready = written(ready, "layout-sizes")
        if ready.isEmpty():
            return known if known is not None else ready
        known = ready if known is None else written(known.unionByName(ready), "layout-sizes")


def nested(layouts: DataFrame, items: DataFrame) -> DataFrame:
    """(layout_id, pos, depth, kind, child_id, x, y, width, height) of every item
    of layouts that hold other layouts, to any depth, placed in the outermost.

    layouts: (layout_id, direction: h, v or c, spacing and, if there is any, margin,
    which is kept free about the items of a row or column); items: (layout_id, pos,
    kind, child_id, w, h, stretch, align, dx, dy).  kind is ``file``; ``layout``,
    whose child_id names the layout and which fills its cell; or ``free``, an item
    without layout, which needs no room, gets its cell's corner moved by (dx, dy)
    and its cell's size.  Items of a layout are as broad as the place that it gets,
    without its margins, or as its broadest item.  A layout that nothing holds is an
    outermost one, at the origin and as large as it needs.  Sizes go from the inner to the outer, places
    back, each a round a level; layouts that hold themselves have no size and give
    no row.
    """
    bad = layouts.where(~F.col("direction").isin(*DIRECTIONS)).limit(1).collect()
    if bad:
        raise NotImplementedError(f"direction {bad[0]['direction']}")
    margin = F.coalesce(F.col("margin").cast("double"), F.lit(0.0)) if "margin" in layouts.columns else F.lit(0.0)
    layouts = layouts.select("layout_id", "direction", F.col("spacing").cast("double").alias("spacing"), margin.alias("margin"))
    items = items.select("layout_id", "pos", "kind", "child_id", *(F.when(F.col("kind") == "layout", F.lit(None)).when(F.col("kind") == "free", F.lit(0.0)).otherwise(F.col(c)).cast("double").alias(c) for c in "wh"), *(F.when(F.col("kind") == "file", F.col(c)).when((F.col("kind") == "layout") & F.lit(c == "stretch"), F.col(c)).otherwise(0).alias(c) for c in ("stretch", "align")), *(F.when(F.col("kind") == "free", F.col(c)).otherwise(0.0).cast("double").alias(c) for c in ("dx", "dy")))
    natural = _natural(layouts, items)
    child = natural.select(F.col("layout_id").alias("child_id"), "nw", "nh")
    sized = items.join(child, "child_id", "left").withColumn("w", F.coalesce("nw", "w")).withColumn("h", F.coalesce("nh", "h")).drop("nw", "nh").join(layouts, "layout_id")
    sized = written(sized, "sized-items")
    held = items.where("child_id IS NOT NULL").select(F.col("child_id").alias("layout_id"))
    now = written(natural.join(held, "layout_id", "left_anti").select("layout_id", F.lit(0).alias("depth"), F.lit(0.0).alias("ox"), F.lit(0.0).alias("oy"), F.lit(0.0).alias("aw"), F.lit(0.0).alias("ah")), "cells")
    done = None
    while not now.isEmpty():
        placed_ = written(_placed_in(sized.join(now, "layout_id")), "placed-items")
        done = placed_ if done is None else done.unionByName(placed_)
        inner = placed_.where("kind = 'layout'").select(F.col("child_id").alias("layout_id"), (F.col("depth") + 1).alias("depth"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("width").alias("aw"), F.col("height").alias("ah"))
        now = written(inner, "cells")
    columns = ["layout_id", "pos", "depth", "kind", "child_id", "x", "y", "width", "height"]
    if done is None:
        return sized.where("false").select("layout_id", "pos", F.lit(0).alias("depth"), "kind", "child_id", *(F.lit(0.0).alias(c) for c in columns[5:]))
    return done.select(*columns)


def _placed_in(items: DataFrame) -> DataFrame:
    """Items of layouts with given places (ox, oy) and sizes (aw, ah)."""
    w = Window.partitionBy("layout_id")
    d, laid = F.col("direction"), F.col("kind") != "free"
    own = F.when(d == "h", F.col("w")).otherwise(F.col("h"))
    across = F.when(d == "h", F.col("h")).otherwise(F.col("w"))
    room_for = F.when(d == "h", F.col("aw")).otherwise(F.col("ah"))
    last = F.max("pos").over(w)
    # room is what the laid items and the gaps behind them leave
    gaps = F.col("spacing") * F.count_if(laid & (F.col("pos") < F.col("last"))).over(w)
    need = F.when(d == "c", F.max_by(F.when(laid, F.col("own")), F.when(laid, F.col("pos"))).over(w) + F.col("margin")).otherwise(F.sum("own").over(w) + gaps + 2 * F.col("margin"))
    r = items.withColumn("last", last).withColumn("own", own).withColumn("across", across)
    r = r.withColumn("room", F.greatest(F.lit(0.0), room_for - F.coalesce(need, F.lit(0.0)))).withColumn("total", F.sum("stretch").over(w))
    share = F.when(F.col("total") > 0, F.col("stretch") * F.try_divide(F.col("room"), F.col("total"))).when(F.col("pos") == F.col("last"), F.col("room")).otherwise(0.0)
    r = r.withColumn("length", F.col("own") + share)
    given = F.when(d == "h", F.col("ah")).otherwise(F.col("aw"))
    breadth = F.when(d == "c", F.max_by(F.when(laid, F.col("w")), F.when(laid, F.col("pos"))).over(w)).otherwise(F.greatest(given, F.max("across").over(w)))
    before = F.coalesce(F.sum(F.col("length") + F.col("spacing")).over(w.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    r = r.withColumn("breadth", F.coalesce(breadth, F.lit(0.0))).withColumn("before", before)
    into = F.when(d == "c", 0.0).otherwise(F.col("margin"))
    r = r.withColumn("cx", F.col("ox") + into + F.when(d == "h", F.col("before")).otherwise(0.0)).withColumn("cy", F.col("oy") + into + F.when(d == "v", F.col("before")).otherwise(0.0))
    r = r.withColumn("cw", F.when(d == "h", F.col("length")).otherwise(F.col("breadth"))).withColumn("ch", F.when(d == "h", F.col("breadth")).otherwise(F.col("length")))
    x, width = _put(LEFT, RIGHT, HCENTER, "cx", "cw", "w")
    y, height = _put(TOP, BOTTOM, VCENTER, "cy", "ch", "h")
    return r.select("layout_id", "pos", "depth", "kind", "child_id", F.round(x + F.col("dx"), 6).alias("x"), F.round(y + F.col("dy"), 6).alias("y"), F.round(width, 6).alias("width"), F.round(height, 6).alias("height"))


#: Stroke and its width of the frame about each kind of item (fixed values).
FRAMES = {"layout": ("black", "2.000000"), "file": ("red", "1.000000"), "free": ("green", "1.000000")}


def debug_boxes(items: DataFrame) -> DataFrame:
    """(layout_id, pos, element): a frame for each placed item, in its kind's colour."""
    number = lambda c: F.format_string("%.6f", F.col(c))
    stroke = F.coalesce(*(F.when(F.col("kind") == k, F.lit(f"{colour}; stroke-width: {width};")) for k, (colour, width) in FRAMES.items()))
    element = F.concat(F.lit('<rect style="fill: none; stroke: '), stroke, *(x for c in ("x", "y", "width", "height") for x in (F.lit(f'" {c}="'), number(c))), F.lit('"/>'))
    return items.select("layout_id", "pos", element.alias("element"))


def extra_groups(items: DataFrame) -> DataFrame:
    """(layout_id, pos, element): the XML that comes with a placed item (``xml``),
    in a group moved to the item's corner; items without any give no row."""
    element = F.concat(F.lit('<g transform="translate('), F.format_string("%.6f,%.6f", "x", "y"), F.lit(')">'), "xml", F.lit("</g>"))
    return items.where("xml IS NOT NULL").select("layout_id", "pos", element.alias("element"))


def checked(cells: DataFrame) -> DataFrame:
    """(layout_id, pos, problem): files laid out twice in a layout, and files that
    their cell would resize: without a flag on an axis they take the cell's size.
    cells: as from ``placed``."""
    n = F.count("*").over(Window.partitionBy("layout_id", "pos"))
    _, width = _put(LEFT, RIGHT, HCENTER, "cx", "cw", "w")
    _, height = _put(TOP, BOTTOM, VCENTER, "cy", "ch", "h")
    resized = (F.round(width, 6) != F.round("w", 6)) | (F.round(height, 6) != F.round("h", 6))
    return cells.select("layout_id", "pos", F.when(n > 1, "duplicate").when(resized, "resized").alias("problem")).where("problem IS NOT NULL").distinct()
