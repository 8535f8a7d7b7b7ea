"""Rescaling, octree and dithering against plain loops on small images."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillgrid.operators import resample

RGB = "image_id long, y int, x int, r int, g int, b int"
PALETTE = [(0, 0, 0), (255, 255, 255), (200, 30, 30), (30, 30, 200)]


def image(seed, width, height):
    rnd = random.Random(seed)
    return {(y, x): tuple(rnd.randrange(256) for _ in range(3)) for y in range(height) for x in range(width)}


SIZES = [(1, 1), (1, 5), (7, 1), (5, 6), (9, 13), (16, 16)]
IMAGES = {k: image(k, w, h) for k, (w, h) in enumerate(SIZES)}


@pytest.fixture(scope="module")
def pixels(spark):
    return spark.createDataFrame([(k, y, x, *c) for k, px in IMAGES.items() for (y, x), c in px.items()], RGB).repartition(5)


@pytest.fixture(scope="module")
def palettes(spark):
    # the first image has no palette
    return spark.createDataFrame([(k, i, *c) for k in IMAGES if k for i, c in enumerate(PALETTE)], "image_id long, cindex int, r int, g int, b int")


def nearest(v):
    return min(PALETTE, key=lambda c: (sum((a - b) ** 2 for a, b in zip(v, c)), PALETTE.index(c)))


def collected(df):
    return {(r.image_id, r.y, r.x): (r.r, r.g, r.b) for r in df.collect()}


def test_floyd_steinberg_pixel_by_pixel(pixels, palettes):
    want = {}
    for k, px in IMAGES.items():
        errors = defaultdict(lambda: (0, 0, 0))
        for y, x in sorted(px) if k else []:
            shares = [7 * a + 3 * b + 5 * c + d for a, b, c, d in zip(errors[y, x - 1], errors[y - 1, x + 1], errors[y - 1, x], errors[y - 1, x - 1])]
            wanted = [v + s // 16 for v, s in zip(px[y, x], shares)]
            got = nearest(wanted)
            errors[y, x] = tuple(a - b for a, b in zip(wanted, got))
            want[k, y, x] = got
    assert collected(resample.floyd_steinberg(pixels, palettes)) == want


def curve(n):
    """Hilbert's curve by its grammar: n digits, from (0, 0) to the right end of the first axis."""
    x = y = 0
    out = [(0, 0)]
    turns = {"A": "+BF-AFA-FB+", "B": "-AF+BFB+FA-"}
    text = "A"
    for _ in range(n):
        text = "".join(turns.get(c, c) for c in text)
    dx, dy = 1, 0
    for c in text:
        if c == "F":
            x, y = x + dx, y + dy
            out.append((x, y))
        elif c == "+":
            dx, dy = -dy, dx
        elif c == "-":
            dx, dy = dy, -dx
    return out


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_hilbert_is_the_curve(spark, digits):
    side = 1 << digits
    rows = spark.range(side * side).select((F.col("id") % side).alias("x"), F.expr(f"id div {side}").alias("y")).select("x", "y", resample.hilbert(F.col("x"), F.col("y"), digits).alias("d")).collect()
    walk = [(r.x, r.y) for r in sorted(rows, key=lambda r: r.d)]
    assert sorted(r.d for r in rows) == list(range(side * side))
    assert walk in (curve(digits), [(y, x) for x, y in curve(digits)])


def test_riemersma_pixel_by_pixel(spark, pixels, palettes, monkeypatch):
    monkeypatch.setattr(resample, "STEP", 2)  # many pieces
    weights = resample.queue_weights()
    assert weights[-1] == 1024 and weights[0] == 64
    ranks = {(r.x, r.y): r.d for r in spark.range(256).selectExpr("id % 16 AS x", "id div 16 AS y").select("x", "y", resample.hilbert(F.col("x"), F.col("y")).alias("d")).collect()}
    want = {}
    for k, px in IMAGES.items():
        queue = [(0, 0, 0)] * 16
        for y, x in sorted(px, key=lambda p: ranks[p[1], p[0]]) if k else []:
            wanted = [v + sum(w * e[c] for w, e in zip(weights, queue)) // 1024 for c, v in enumerate(px[y, x])]
            got = nearest(wanted)
            queue = queue[1:] + [tuple(a - b for a, b in zip(px[y, x], got))]
            want[k, y, x] = got
    assert collected(resample.riemersma(pixels, palettes)) == want


def test_dithering_of_nothing(spark, pixels, palettes):
    for f in (resample.floyd_steinberg, resample.riemersma):
        assert f(pixels.limit(0), palettes).count() == 0
        assert f(pixels, palettes.limit(0)).count() == 0


def kernel(z):
    return 1.0 if abs(z) < 1e-9 else 3 * math.sin(math.pi * z) * math.sin(math.pi * z / 3) / (math.pi * z) ** 2


def rescaled(line, factor, more):
    """One pass along a line of whole numbers."""
    stretch, n, out = min(1.0, factor), len(line), []
    for o in range(max(1, math.floor(n * factor + 0.5))):
        centre, total, value = (o + 0.5) / factor - 0.5, 0, 0
        for at in range(math.ceil(centre - 3 / stretch), math.floor(centre + 3 / stretch) + 1):
            w = math.floor(kernel((at - centre) * stretch) * 65536 + 0.5)
            total, value = total + w, value + w * line[min(max(at, 0), n - 1)]
        value *= more
        out.append((2 * value + total) // (2 * total))
    return out


@pytest.mark.parametrize("factor", [0.3, 1.0, 1.7, 2.5])
def test_lanczos_pixel_by_pixel(pixels, factor):
    want = {}
    for k, px in IMAGES.items():
        w, h = SIZES[k]
        rows = [rescaled([px[y, x][0] for x in range(w)], factor, 256) for y in range(h)]
        for x in range(len(rows[0])):
            for y, v in enumerate(rescaled([row[x] for row in rows], factor, 1)):
                want[k, y, x] = min(255, max(0, (v + 128) // 256))
    got = {(r.image_id, r.y, r.x): r.r for r in resample.lanczos_rescaled(pixels, factor, ("r",)).collect()}
    assert got.keys() == want.keys()
    # the second pass rounds once, the loop twice
    assert all(abs(got[p] - want[p]) <= 1 for p in want)
    if factor == 1.0:
        assert all(got[k, y, x] == px[y, x][0] for k, px in IMAGES.items() for y, x in px)


def test_lanczos_refuses_no_size(pixels):
    with pytest.raises(ValueError):
        resample.lanczos_rescaled(pixels, 0)


def tree_colours(px, most):
    """Leaves merged one parent at a time, the lowest level first."""
    count = Counter(px.values())
    leaf = {c: (8, c) for c in count}
    for level in range(7, -1, -1):
        parents = defaultdict(set)
        for c, (depth, p) in leaf.items():
            if depth == level + 1:
                parents[tuple(v >> 1 for v in p)].add((depth, p))
        of = lambda q: sum(n for c, n in count.items() if tuple(v >> (8 - level) for v in c) == q)  # noqa: E731,B023
        for q in sorted(parents, key=lambda q: (of(q), q)):
            if len(set(leaf.values())) <= most:
                break
            leaf = {c: (level, q) if x in parents[q] else x for c, x in leaf.items()}
    mean = {}
    for x in set(leaf.values()):
        own = [(c, n) for c, n in count.items() if leaf[c] == x]
        n = sum(m for _, m in own)
        mean[x] = tuple((2 * sum(c[i] * m for c, m in own) + n) // (2 * n) for i in range(3))
    return {p: mean[leaf[c]] for p, c in px.items()}


@pytest.mark.parametrize("most", [1, 4, 17, 300])
def test_octree_parent_by_parent(pixels, most):
    got = collected(resample.octree(pixels, most))
    for k, px in IMAGES.items():
        own = {(y, x): c for (i, y, x), c in got.items() if i == k}
        assert own == tree_colours(px, most)
        assert len(set(own.values())) <= most


def learned(px, order, n):
    """A neural map in plain numbers."""
    at = [[255.0 * i / max(1, n - 1)] * 3 for i in range(n)]
    often, bias = [1.0 / n] * n, [0.0] * n
    for t, p in enumerate(sorted(px, key=order.__getitem__)):
        part, c = t / len(px), px[p]
        far = [(a[0] - c[0]) ** 2 + (a[1] - c[1]) ** 2 + (a[2] - c[2]) ** 2 - b for a, b in zip(at, bias)]
        won = far.index(min(far))
        often = [o * (1 - 1 / 1024) + (1 / 1024 if i == won else 0) for i, o in enumerate(often)]
        bias = [1024.0 * (1.0 / n - o) for o in often]
        rate, reach = 0.5 * (1 - part) ** 2 + 0.002, int(n / 8 * (1 - part) ** 2)
        for i in range(max(0, won - reach), min(n, won + reach + 1)):
            share = rate * (1 - (abs(i - won) / (reach + 1)) ** 2)
            at[i] = [a + share * (v - a) for a, v in zip(at[i], c)]
    return [tuple(math.floor(min(255, max(0, v)) + 0.5) for v in a) for a in at]


@pytest.mark.parametrize("n", [1, 5, 24])
def test_neural_palettes_pixel_by_pixel(pixels, n):
    hashes = {(r.image_id, r.y, r.x): (r.s, r.h) for r in pixels.select("image_id", "y", "x", F.expr("pmod(shiftright(xxhash64(y, x), 44), 1024) AS s"), F.xxhash64("y", "x").alias("h")).collect()}
    got = {}
    for r in resample.neural_palettes(pixels, n).orderBy("image_id", "cindex").collect():
        got.setdefault(r.image_id, []).append((r.r, r.g, r.b))
    assert got == {k: learned(px, {(y, x): hashes[k, y, x] for y, x in px}, n) for k, px in IMAGES.items()}
    shown = collected(resample.neural(pixels, n))
    for (k, y, x), c in shown.items():
        d = [sum((a - b) ** 2 for a, b in zip(IMAGES[k][y, x], p)) for p in got[k]]
        assert c == got[k][d.index(min(d))]


def test_neural_palette_of_two_colours_finds_them(spark):
    rows = [(1, y, x, *((250, 10, 20) if (x // 8) % 2 else (5, 200, 90))) for y in range(40) for x in range(40)]
    got = {(r.r, r.g, r.b) for r in resample.neural(spark.createDataFrame(rows, RGB), 8).distinct().select("r", "g", "b").distinct().collect()}
    assert len(got) == 2 and all(min(sum(abs(a - b) for a, b in zip(c, w)) for w in ((250, 10, 20), (5, 200, 90))) < 30 for c in got)
