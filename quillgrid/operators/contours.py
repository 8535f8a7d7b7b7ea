"""Outlines of masks as closed rings, and their simplification to polygons.

The sides of pixels that face the background are directed edges with the pixel on
their right; edges in a row are one.  Where two pixels meet at a corner only, the
outline turns left, so it goes round 8-connected components.  An edge knows the one
behind it by a join; which ring it is in and its place there come from doubling
pointers, so rounds grow with the logarithm of the longest ring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import written
from .raster import STRIDE

ROUNDS = 64
#: Directions in which an edge goes: right, down, left, up.
RIGHT, DOWN, LEFT, UP = range(4)


def edges(mask: DataFrame) -> DataFrame:
    """(image_id, dir, y0, x0, y1, x1, id, py, px) of a mask (image_id, y, x): runs
    of sides that face the background, from corner to corner; (py, px) is a pixel
    inside.  id is unique in the image and grows with (y0, x0)."""
    row, column = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    near = lambda f, c, w, by: ~F.coalesce(f(c).over(w) == F.col(c) + by, F.lit(False))
    m = mask.select("image_id", "y", "x").distinct().select("image_id", "y", "x", near(F.lag, "x", row, -1).alias("left"), near(F.lead, "x", row, 1).alias("right"), near(F.lag, "y", column, -1).alias("up"), near(F.lead, "y", column, 1).alias("down"))
    out = None
    for side, direction, along, across in (("up", RIGHT, "x", "y"), ("right", DOWN, "y", "x"), ("down", LEFT, "x", "y"), ("left", UP, "y", "x")):
        w = Window.partitionBy("image_id", across).orderBy(along)
        run = m.where(side).select("image_id", across, along, (F.col(along) - F.row_number().over(w)).alias("run"))
        ends = run.groupBy("image_id", across, "run").agg(F.min(along).alias("lo"), (F.max(along) + 1).alias("hi"))
        at = F.col(across) + (1 if side in ("right", "down") else 0)
        first, last = (F.col("lo"), F.col("hi")) if direction in (RIGHT, DOWN) else (F.col("hi"), F.col("lo"))
        inside = F.col("lo") if direction in (RIGHT, DOWN) else F.col("hi") - 1
        place = {f"{along}0": first, f"{along}1": last, f"{across}0": at, f"{across}1": at, f"p{along}": inside, f"p{across}": F.col(across)}
        one = ends.select("image_id", F.lit(direction).alias("dir"), *(place[c].cast("int").alias(c) for c in ("y0", "x0", "y1", "x1", "py", "px")))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("id", (F.col("y0").cast("long") * (STRIDE // 8) + F.col("x0")) * 4 + F.col("dir"))


def followed(edges_: DataFrame) -> DataFrame:
    """(image_id, id, next): the edge that goes on where one ends, the one to the
    left if there are two."""
    ahead = edges_.select("image_id", F.col("y0").alias("y1"), F.col("x0").alias("x1"), F.col("id").alias("next"), F.col("dir").alias("turned"))
    left = F.pmod(F.col("turned") - F.col("dir"), F.lit(4)) != 3
    return edges_.join(ahead, ["image_id", "y1", "x1"]).groupBy("image_id", "id").agg(F.min_by("next", left).alias("next"))


def rings(mask: DataFrame) -> DataFrame:
    """(image_id, ring, seq, y, x, py, px): corners of each outline in order, seq
    from 0; ring is the number of its first edge, (py, px) a pixel that lies along.

    The first edge of a ring is that with the least (y, x).  Outlines run round
    their component with the pixels on the right, round holes the other way.
    """
    all_ = written(edges(mask), "edges")
    after = written(followed(all_), "next")
    # the least number of each ring, over twice as many edges each round
    now, key = after.select("image_id", "id", F.col("next").alias("to"), F.least("id", "next").alias("low")), ["image_id", "to"]
    before = None
    for _ in range(ROUNDS):
        now = written(now, "ring-low")
        total = now.agg(F.sum(F.col("low").cast("decimal(38,0)"))).first()[0]
        if total == before:
            break
        before = total
        ahead = now.select("image_id", F.col("id").alias("to"), F.col("to").alias("further"), F.col("low").alias("also"))
        now = now.join(ahead, key).select("image_id", "id", F.col("further").alias("to"), F.least("low", "also").alias("low"))
    # the steps that are left to the first edge of the ring, which stops the pointers
    first = F.col("id") == F.col("low")
    home = after.join(now.select("image_id", "id", "low"), ["image_id", "id"])
    left = home.select("image_id", "id", "low", F.when(~first & (F.col("next") != F.col("low")), F.col("next")).alias("to"), F.when(first, 0).otherwise(1).cast("long").alias("left"))
    for _ in range(ROUNDS):
        left = written(left, "ring-left")
        if left.where("to IS NOT NULL").isEmpty():
            break
        ahead = left.select("image_id", F.col("id").alias("to"), F.col("to").alias("further"), F.col("left").alias("more"))
        gone = left.where("to IS NOT NULL").join(ahead, key).select("image_id", "id", "low", F.col("further").alias("to"), (F.col("left") + F.col("more")).alias("left"))
        left = left.where("to IS NULL").unionByName(gone)
    n = F.count("*").over(Window.partitionBy("image_id", "low"))
    seq = F.when(first, F.lit(0)).otherwise(F.col("n") - F.col("left")).cast("int")
    placed = left.withColumn("n", n).select("image_id", F.col("low").alias("ring"), "id", seq.alias("seq"))
    return placed.join(all_, ["image_id", "id"]).select("image_id", "ring", "seq", F.col("y0").alias("y"), F.col("x0").alias("x"), "py", "px")


def _shoelace(corners: DataFrame) -> DataFrame:
    """Corners with twice their part of the ring's area."""
    w = Window.partitionBy("image_id", "ring").orderBy("seq")
    every = Window.partitionBy("image_id", "ring")
    nxt = {c: F.coalesce(F.lead(c).over(w), F.first(c).over(w)) for c in "yx"}
    return corners.withColumn("part", F.col("x").cast("long") * nxt["y"] - nxt["x"].cast("long") * F.col("y")).withColumn("n", F.count("*").over(every))


def outlines(corners: DataFrame) -> DataFrame:
    """(image_id, ring, n_corners, area, d): area is that of the ring's inside,
    below zero for holes; d is the ring as a path."""
    points = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "y", "x"))), lambda p: F.concat(p["x"], F.lit(","), p["y"])), " L ")
    return _shoelace(corners).groupBy("image_id", "ring").agg(F.count("*").alias("n_corners"), (F.sum("part") / 2).cast("double").alias("area"), F.concat(F.lit("M "), points, F.lit(" Z")).alias("d"))


def with_labels(corners: DataFrame, labels: DataFrame) -> DataFrame:
    """(image_id, ring, label) of the rings of labelled pixels."""
    first = corners.where("seq = 0").select("image_id", "ring", F.col("py").alias("y"), F.col("px").alias("x"))
    return first.join(labels, ["image_id", "y", "x"]).select("image_id", "ring", "label")


def simplified(corners: DataFrame, tolerance: float) -> DataFrame:
    """Corners that a polygon needs so that all others are within ``tolerance`` of
    its sides.

    A ring is cut at its first corner and at the one farthest from it.  Level by
    level, the corner farthest from each side (ties: the first) is kept if it is
    beyond the tolerance and cuts the side in two; the rounds are the depth of
    these cuts.  seq stays as it was; a ring keeps two corners at least.
    """
    own = ["image_id", "ring"]
    every = Window.partitionBy(*own)
    first = F.first(F.struct("y", "x")).over(every.orderBy("seq"))
    far = (F.col("y") - F.col("o.y")).cast("long") ** 2 + (F.col("x") - F.col("o.x")).cast("long") ** 2
    now = corners.withColumn("o", first).withColumn("far", far)
    rank = F.row_number().over(every.orderBy(F.desc("far"), "seq"))
    now = written(now.withColumn("kept", (F.col("seq") == 0) | (rank == 1)).drop("far"), "polygon")
    point = F.struct("seq", "y", "x")
    before = every.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    behind = every.orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    while True:
        at = now.withColumn("a", F.last(F.when(F.col("kept"), point), ignorenulls=True).over(before)).withColumn("b", F.first(F.when(F.col("kept"), F.struct("y", "x")), ignorenulls=True).over(behind))
        at = at.withColumn("b", F.coalesce("b", "o")).withColumn("off", _off("y", "x", "a", "b"))
        place = F.row_number().over(Window.partitionBy(*own, "a.seq").orderBy(F.desc("off"), "seq"))
        cut = at.withColumn("cut", ~F.col("kept") & (F.col("off") > tolerance * tolerance)).withColumn("cut", F.col("cut") & (place == 1))
        cut = written(cut.drop("a", "b", "off"), "polygon")
        if cut.where("cut").isEmpty():
            return cut.where("kept").drop("kept", "cut", "o")
        now = cut.withColumn("kept", F.col("kept") | F.col("cut")).drop("cut")


def _off(y: str, x: str, a: str, b: str):
    """Squared distance of (y, x) from the side from a to b; whole numbers up to
    the last division."""
    long = lambda c: F.col(c).cast("long")
    ay, ax, by, bx = long(f"{a}.y"), long(f"{a}.x"), long(f"{b}.y"), long(f"{b}.x")
    py, px = long(y) - ay, long(x) - ax
    sy, sx = by - ay, bx - ax
    length, dot, cross = sy * sy + sx * sx, py * sy + px * sx, px * sy - py * sx
    near, far = py * py + px * px, (long(y) - by) ** 2 + (long(x) - bx) ** 2
    return F.when(dot <= 0, near.cast("double")).when(dot >= length, far.cast("double")).otherwise(cross.cast("double") * cross / length)
