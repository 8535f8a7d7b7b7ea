"""Lanczos rescaling, octree quantisation and error-diffusion dithering.

Colours and grey values are whole numbers from 0 to 255, and so is every
intermediate value, so results do not depend on the order of sums.  Rescaling and
quantisation are joins, windows and sums.  Dithering visits pixels in an order in
which each needs only few before it: Spark brings the pixels of an image together
and sorts them in that order, and a task goes through them as a stream with a state
that is a few diagonals or a short queue, never an image.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .raster import remapped, sizes

#: Weights are multiples of 1 / UNIT; the first pass keeps PLACES more binary digits.
UNIT = 1 << 16
PLACES = 1 << 8
TAPS = 3
DEPTH = 8
#: Errors that Riemersma dithering remembers; the oldest counts 1 / RATIO of the newest.
QUEUE, RATIO = 16, 16
#: Riemersma dithering takes 2^STEP places of the curve from the stream at a time.
STEP = 12
DIGEST = "image_id {id}, y int, x int, r int, g int, b int"


def lanczos_weights(lengths: DataFrame, factor: float, taps: int = TAPS) -> DataFrame:
    """(length, o, s, weight): what source place s weighs in output place o of a
    line of so many pixels.  Places beyond the ends count as the end's.

    The kernel is stretched when a line shrinks.  Weights are whole numbers.
    """
    stretch = min(1.0, factor)
    reach = taps / stretch
    out = F.greatest(F.lit(1), F.floor(F.col("length") * factor + 0.5))
    each = lengths.select("length").distinct().select("length", F.explode(F.sequence(F.lit(0).cast("long"), out - 1)).alias("o"))
    centre = (F.col("o") + 0.5) / factor - 0.5
    each = each.withColumn("centre", centre).select("length", "o", "centre", F.explode(F.sequence(F.ceil(F.col("centre") - reach), F.floor(F.col("centre") + reach))).alias("at"))
    z = (F.col("at") - F.col("centre")) * stretch * float(np.pi)
    weight = F.when(F.abs(z) < 1e-9, F.lit(1.0)).otherwise(taps * F.sin(z) * F.sin(z / taps) / (z * z))
    place = F.least(F.greatest("at", F.lit(0)), F.col("length") - 1).cast("int")
    return each.select("length", F.col("o").cast("int").alias("o"), place.alias("s"), F.floor(weight * UNIT + 0.5).cast("long").alias("weight")).groupBy("length", "o", "s").agg(F.sum("weight").alias("weight")).where("weight <> 0")


def lanczos_rescaled(pixels: DataFrame, factor: float, channels: tuple[str, ...] = ("g",), taps: int = TAPS) -> DataFrame:
    """Pixels of the images scaled by ``factor``, at least one a side: first along
    rows, then along columns, each a join with the table of weights and a sum.

    Where pixels of an image are missing, those that are there share the weight.
    """
    if factor <= 0:
        raise ValueError("a factor must be positive")
    size = sizes(pixels)
    across = lanczos_weights(size.select(F.col("width").alias("length")), factor, taps)
    down = lanczos_weights(size.select(F.col("height").alias("length")), factor, taps)
    at = pixels.join(size, "image_id")
    row = at.join(across.select(F.col("length").alias("width"), F.col("s").alias("x"), F.col("o").alias("ox"), "weight"), ["width", "x"])
    total = F.sum("weight")
    row = row.groupBy("image_id", "height", "y", "ox").agg(total.alias("t"), *(F.sum(F.col("weight") * F.col(c) * PLACES).alias(c) for c in channels)).where("t > 0")
    row = row.select("image_id", "height", "y", "ox", *(_whole(c, "t").alias(c) for c in channels))
    col = row.join(down.select(F.col("length").alias("height"), F.col("s").alias("y"), F.col("o").alias("oy"), "weight"), ["height", "y"])
    col = col.groupBy("image_id", "oy", "ox").agg(total.alias("t"), *(F.sum(F.col("weight") * F.col(c)).alias(c) for c in channels)).where("t > 0")
    return col.select("image_id", F.col("oy").alias("y"), F.col("ox").alias("x"), *(F.least(F.greatest(_whole(c, "t", PLACES), F.lit(0)), F.lit(255)).cast("int").alias(c) for c in channels))


def _whole(a: str, b: str, more: int = 1) -> Column:
    """a / (b * more) to the nearest whole number, halves up, without fractions."""
    return F.expr(f"(2 * {a} + {b} * {more} - pmod(2 * {a} + {b} * {more}, 2 * {b} * {more})) div (2 * {b} * {more})")


def octree(pixels: DataFrame, colours: int) -> DataFrame:
    """Quantisation to at most so many colours an image by a tree in the binary
    digits of colours.

    A node on level k has the colours that share their k first digits in each
    channel.  From the lowest level up, parents become leaves, those with fewest
    pixels first (ties by colour), as long as the image has more than ``colours``
    leaves.  A leaf is shown by its rounded mean.  A level that has to give leaves
    away at all is one above which only whole levels were merged, so each level is
    worked out by itself, from distinct colours.
    """
    if colours < 1:
        raise ValueError("at least one colour")
    n = pixels.groupBy("image_id", "r", "g", "b").agg(F.count("*").alias("n"))
    known = n.withColumn("depth", F.lit(DEPTH))
    for k in range(DEPTH - 1, -1, -1):
        prefix = lambda depth: [F.expr(f"shiftright({c}, {DEPTH - depth})") for c in "rgb"]  # noqa: E731,B023
        inner = n.groupBy("image_id", *(p.alias(f"c{c}") for p, c in zip(prefix(k + 1), "rgb"))).agg(F.sum("n").alias("n"))
        nodes = inner.groupBy("image_id", *(F.expr(f"shiftright(c{c}, 1)").alias(f"p{c}") for c in "rgb")).agg(F.count("*").alias("children"), F.sum("n").alias("n"))
        w = Window.partitionBy("image_id")
        given = F.coalesce(F.sum(F.col("children") - 1).over(w.orderBy("n", "pr", "pg", "pb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        gone = nodes.withColumn("leaves", F.sum("children").over(w)).withColumn("given", given).where(F.col("leaves") - F.col("given") > colours)
        gone = gone.select("image_id", "pr", "pg", "pb", F.lit(k).alias("level"))
        known = known.withColumns({f"p{c}": p for c, p in zip("rgb", prefix(k))}).join(gone, ["image_id", "pr", "pg", "pb"], "left").withColumn("depth", F.least("depth", "level")).drop("pr", "pg", "pb", "level")
    leaf = {f"l{c}": F.expr(f"shiftright({c}, {DEPTH} - depth)") for c in "rgb"}
    key = ["image_id", "depth", *leaf]
    known = known.withColumns(leaf)
    mean = known.groupBy(*key).agg(*(F.expr(f"CAST((2 * sum({c} * n) + sum(n)) div (2 * sum(n)) AS INT)").alias(f"q{c}") for c in "rgb"))
    shown = known.join(mean, key).select("image_id", "r", "g", "b", "qr", "qg", "qb")
    return pixels.join(shown, ["image_id", "r", "g", "b"]).selectExpr("image_id", "y", "x", "qr AS r", "qg AS g", "qb AS b")


def _stream(pixels: DataFrame, palette: DataFrame, step: Column, place: Column, run) -> DataFrame:
    """``run(steps)`` over all images of a task as one stream of (image, numpy table
    of step, y, x, r, g, b), a step at a time: each image's palette (step -1, by
    index) before its pixels in the order of ``step`` and ``place``."""
    kind = dict(pixels.dtypes)["image_id"]
    long = lambda c: c.cast("long")
    rows = pixels.select("image_id", long(step).alias("step"), long(place).alias("place"), "y", "x", "r", "g", "b")
    colours = palette.select("image_id", long(F.lit(-1)).alias("step"), long(F.col("cindex")).alias("place"), F.lit(0).alias("y"), F.lit(0).alias("x"), "r", "g", "b")
    both = rows.unionByName(colours).repartition("image_id").sortWithinPartitions("image_id", "step", "place")

    def cut(batches) -> Iterator[tuple]:
        """(image, table) in pieces that end with an image's step."""
        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            image, numbers = batch.column("image_id").to_pylist(), np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("step", "y", "x", "r", "g", "b")], 1)
            ends = [i for i in range(1, len(image)) if image[i] != image[i - 1] or numbers[i, 0] != numbers[i - 1, 0]]
            for lo, hi in zip([0, *ends], [*ends, len(image)]):
                key = image[lo], numbers[lo, 0]
                if held and held[0] != key:
                    yield held[0][0], np.concatenate(held[1])
                    held = []
                if held:
                    held[1].append(numbers[lo:hi])
                else:
                    held = [key, [numbers[lo:hi]]]
        if held:
            yield held[0][0], np.concatenate(held[1])

    def told(batches):
        out: list = []
        for image, table in run(cut(batches)):
            out.append((image, table))
            if sum(len(t) for _, t in out) >= 20_000:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)

    def _rows(out):
        images = pa.array([i for i, t in out for _ in range(len(t))], id_type)
        table = np.concatenate([t for _, t in out]).astype(np.int32)
        return pa.RecordBatch.from_arrays([images, *(pa.array(np.ascontiguousarray(table[:, k])) for k in range(5))], names=["image_id", "y", "x", "r", "g", "b"])

    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    return both.mapInArrow(told, DIGEST.format(id=kind))


def nearest_colours(values: np.ndarray, palette: np.ndarray) -> np.ndarray:
    """Index of each value's nearest palette colour, the first of equals."""
    return ((values[:, None, :] - palette[None, :, :]) ** 2).sum(2).argmin(1)


def floyd_steinberg(pixels: DataFrame, palette: DataFrame) -> DataFrame:
    """Pixels (image_id, y, x, r, g, b) in colours of their image's palette
    (image_id, cindex, r, g, b), each pixel's error handed on: 7/16 to the right,
    3/16, 5/16 and 1/16 to the left, middle and right of the row below.

    A pixel takes floor(sum of shares / 16).  Pixels with the same x + 2 y do not
    touch each other's values, so an image goes diagonal by diagonal, and its
    state is the errors of the three last ones.  Images without palette give no
    rows; errors do not cross missing pixels.
    """

    def run(steps):
        before, colours, errors = object(), None, {}
        for image, rows in steps:
            if image != before:
                before, colours, errors = image, None, {}
            step = int(rows[0, 0])
            if step < 0:
                colours = rows[:, 3:]
                continue
            if colours is None:
                continue
            y = rows[:, 1]
            shares = np.zeros((len(y), 3), np.int64)
            for back, up, weight in ((1, 0, 7), (1, 1, 3), (2, 1, 5), (3, 1, 1)):
                if (old := errors.get(step - back)) is not None:
                    at = np.searchsorted(old[0], y - up).clip(max=len(old[0]) - 1)
                    shares += weight * old[1][at] * (old[0][at] == y - up)[:, None]
            wanted = rows[:, 3:] + shares // 16
            got = colours[nearest_colours(wanted, colours)]
            errors = {k: v for k, v in errors.items() if k > step - 3} | {step: (y, wanted - got)}
            yield image, np.concatenate((rows[:, 1:3], got), axis=1)

    return _stream(pixels, palette, F.col("x") + 2 * F.col("y"), F.col("y"), run)


def hilbert(x: Column, y: Column, digits: int = 16) -> Column:
    """Place of (x, y) on Hilbert's curve through a square of 2^digits a side.

    From the highest digit down, a quarter is entered and its curve turned or
    mirrored; coordinates are from 0 to 2^digits - 1."""
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def enter(s: Column, k: Column) -> Column:
        side = F.expr("1L") * F.pow(F.lit(2), k).cast("long")
        rx, ry = (F.when(F.floor(s[c] / side) % 2 == 1, F.lit(1)).otherwise(F.lit(0)).cast("long") for c in ("x", "y"))
        low = {c: s[c] % side for c in ("x", "y")}
        flip = (ry == 0) & (rx == 1)
        fx, fy = (F.when(flip, side - 1 - low[c]).otherwise(low[c]) for c in ("x", "y"))
        return F.struct(F.when(ry == 0, fy).otherwise(fx).alias("x"), F.when(ry == 0, fx).otherwise(fy).alias("y"), (s["d"] + side * side * F.when(rx == 1, F.when(ry == 1, 2).otherwise(3)).otherwise(ry)).alias("d"))

    return F.aggregate(F.sequence(F.lit(digits - 1), F.lit(0)), start, enter, lambda s: s["d"])


def queue_weights(length: int = QUEUE, ratio: int = RATIO) -> list[int]:
    """Whole weights of remembered errors, the oldest first, falling by equal
    factors to 1 / ratio; 1 stands for 1,024."""
    return [int(1024 * ratio ** (k / (length - 1) - 1) + 0.5) for k in range(length)]


def riemersma(pixels: DataFrame, palette: DataFrame, length: int = QUEUE, ratio: int = RATIO) -> DataFrame:
    """Pixels in colours of their image's palette, visited along Hilbert's curve:
    each takes the weighted errors of the ``length`` pixels before it.

    A pixel is wanted as its value plus floor(sum of weights * errors / 1,024); its
    error is its value less the colour that it got.  Any size of image: the
    curve goes through the square about it, and what is outside is no step.
    Coordinates are below 2^16.
    """
    weights = np.array(queue_weights(length, ratio))

    def run(steps):
        before, colours, queue = object(), None, deque()
        for image, rows in steps:
            if image != before:
                before, colours, queue = image, None, deque([np.zeros(3, np.int64)] * length, length)
            if rows[0, 0] < 0:
                colours = rows[:, 3:]
                continue
            if colours is None:
                continue
            out = rows[:, 1:].copy()
            for k in range(len(rows)):
                wanted = rows[k, 3:] + (weights @ np.array(queue)) // 1024
                got = colours[((wanted - colours) ** 2).sum(1).argmin()]
                queue.append(rows[k, 3:] - got)
                out[k, 2:] = got
            yield image, out

    along = pixels.withColumn("along", hilbert(F.col("x"), F.col("y")))
    return _stream(along, palette, F.shiftright("along", STEP), F.col("along"), run)


class NeuralMap:
    """A line of neurons that learns an image's colours, pixel by pixel.

    The neuron that is nearest to a pixel, less a bias for those that win seldom,
    moves toward it, its neighbours by less; rate and reach fall as pixels go by.
    """

    BETA, GAMMA = 1 / 1024, 1024.0

    def __init__(self, colours: int, pixels: int):
        self.n, self.left, self.seen = colours, pixels, 0
        self.at = np.repeat(255.0 * np.arange(colours)[:, None] / max(1, colours - 1), 3, axis=1)
        self.often = np.full(colours, 1.0 / colours)
        self.bias = np.zeros(colours)

    def learn(self, colour: np.ndarray) -> None:
        part = self.seen / self.left
        self.seen += 1
        far = ((self.at - colour) ** 2).sum(1)
        won = int((far - self.bias).argmin())
        self.often *= 1 - self.BETA
        self.often[won] += self.BETA
        self.bias = self.GAMMA * (1.0 / self.n - self.often)
        rate, reach = 0.5 * (1 - part) ** 2 + 0.002, int(self.n / 8 * (1 - part) ** 2)
        lo, hi = max(0, won - reach), min(self.n, won + reach + 1)
        share = rate * (1 - (np.abs(np.arange(lo, hi) - won) / (reach + 1)) ** 2)
        self.at[lo:hi] += share[:, None] * (colour - self.at[lo:hi])

    def palette(self) -> np.ndarray:
        return np.floor(np.clip(self.at, 0, 255) + 0.5).astype(np.int64)


def neural_palettes(pixels: DataFrame, colours: int) -> DataFrame:
    """(image_id, cindex, r, g, b): what a line of so many neurons has learned
    from all pixels of an image, which it sees in the order of a hash of their places."""
    if colours < 1:
        raise ValueError("at least one colour")
    count = pixels.groupBy("image_id").agg(F.count("*").cast("int").alias("r")).select("image_id", F.lit(0).alias("cindex"), "r", F.lit(0).alias("g"), F.lit(0).alias("b"))

    def told(image, net):
        own = net.palette()
        return image, np.column_stack((np.arange(colours), np.zeros(colours, np.int64), own))

    def run(steps):
        before, net = None, None
        for image, rows in steps:
            if rows[0, 0] < 0:  # how many pixels follow
                if net is not None:
                    yield told(before, net)
                before, net = image, NeuralMap(colours, int(rows[0, 3]))
                continue
            for colour in rows[:, 3:].astype(np.float64):
                net.learn(colour)
        if net is not None:
            yield told(before, net)

    place = F.xxhash64("y", "x")
    return _stream(pixels, count, F.pmod(F.shiftright(place, 44), F.lit(1024)), place, run).select("image_id", F.col("y").alias("cindex"), "r", "g", "b")


def neural(pixels: DataFrame, colours: int) -> DataFrame:
    """Pixels in the nearest colour of their image's neural palette."""
    palettes = neural_palettes(pixels, colours).select("image_id", "cindex", F.col("r").alias("pr"), F.col("g").alias("pg"), F.col("b").alias("pb"))
    return remapped(pixels, palettes)
