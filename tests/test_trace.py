"""Traced images, drawn again by filling their paths by parity."""

import random
import re

import pytest

from quillgrid.operators import resample, svgtree, trace

RGB = "image_id long, y int, x int, r int, g int, b int"


def picture(seed, width, height, colours):
    rnd = random.Random(seed)
    palette = [tuple(rnd.randrange(256) for _ in range(3)) for _ in range(colours)]
    px = {(y, x): palette[0] for y in range(height) for x in range(width)}
    for _ in range(12):
        y, x, h, w, c = rnd.randrange(height), rnd.randrange(width), rnd.randrange(1, 7), rnd.randrange(1, 7), rnd.choice(palette)
        px.update({(v, u): c for v in range(y, min(height, y + h)) for u in range(x, min(width, x + w))})
    return px


IMAGES = {1: picture(1, 12, 9, 3), 2: picture(2, 1, 1, 1), 3: picture(3, 17, 16, 6)}


def drawn(document):
    """Pixels of a document whose paths have only upright and level sides."""
    width, height = map(int, re.search(r'width="(\d+)" height="(\d+)"', document).groups())
    out = {}
    for colour, d in re.findall(r'fill="#([0-9a-f]{6})" fill-rule="evenodd" d="([^"]*)"', document):
        rings = [[tuple(map(int, p.split(","))) for p in ring.strip().removeprefix("M ").split(" L ")] for ring in d.split("Z") if ring.strip()]
        sides = [(a, b) for ring in rings for a, b in zip(ring, ring[1:] + ring[:1]) if a[0] == b[0]]
        for y in range(height):
            for x in range(width):
                if sum(a[0] <= x and min(a[1], b[1]) <= y < max(a[1], b[1]) for a, b in sides) % 2:
                    out[y, x] = tuple(bytes.fromhex(colour))
    return out


@pytest.fixture(scope="module")
def pixels(spark):
    return spark.createDataFrame([(k, y, x, *c) for k, px in IMAGES.items() for (y, x), c in px.items()], RGB).repartition(4)


@pytest.mark.parametrize("stack", [False, True])
def test_documents_draw_the_image(spark, pixels, stack):
    got = {r.image_id: r.document for r in trace.traced(pixels, 0, 0, 0.0, stack).collect()}
    assert {k: drawn(d) for k, d in got.items()} == IMAGES


def test_documents_draw_the_quantised_image(spark, pixels):
    want = {}
    for r in resample.octree(pixels, 2).collect():
        want.setdefault(r.image_id, {})[r.y, r.x] = (r.r, r.g, r.b)
    assert {r.image_id: drawn(r.document) for r in trace.traced(pixels, 2, 0, 0.0).collect()} == want


def test_speckles_go_and_documents_are_well_formed(spark, pixels):
    rows = trace.traced(pixels, 4, 3, 1.0, True)
    docs = rows.selectExpr("image_id AS doc_id", "document AS svg")
    assert svgtree.problems(docs).count() == 0
    assert {r.image_id for r in rows.collect()} == set(IMAGES)
    assert all("<path" not in r.document for r in rows.where("image_id = 2").collect())  # one pixel is a speckle


def test_no_image(spark, pixels):
    assert trace.traced(pixels.limit(0), 3).count() == 0
