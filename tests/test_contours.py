"""Outlines and polygons of small masks, and components across tiles."""

import random
import re
from collections import Counter

import pytest

from quillgrid.operators import contours, raster

KIND = "image_id long, y int, x int"


def dots(text):
    return [(y, x) for y, row in enumerate(text.split("/")) for x, c in enumerate(row) if c == "#"]


def blobs(seed, side=24, share=0.55):
    rnd = random.Random(seed)
    return [(y, x) for y in range(side) for x in range(side) if rnd.random() < share]


MASKS = {1: dots("#"), 2: dots("###/#.#/###"), 3: dots("#.#/.#./#.#"), 4: dots("####/####/..##"), 5: blobs(1), 6: blobs(2, 17, 0.4), 7: dots("#####/#...#/#.#.#/#...#/#####")}


def frame(spark, masks):
    return spark.createDataFrame([(k, y, x) for k, px in masks.items() for y, x in px] * 2, KIND)


def components(px):
    left, out = set(px), {}
    while left:
        todo = [min(left)]
        root = todo[0]
        left.discard(root)
        while todo:
            y, x = todo.pop()
            out[y, x] = root
            for near in [(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]:
                if near in left:
                    left.discard(near)
                    todo.append(near)
    return out


@pytest.mark.parametrize("tile", [1, 3, 7, 256])
def test_labels_do_not_depend_on_tiles(spark, tile):
    got = {(r.image_id, r.y, r.x): r.label for r in raster.labelled(frame(spark, MASKS), tile).collect()}
    assert got == {(k, y, x): root[0] * raster.STRIDE + root[1] for k, px in MASKS.items() for (y, x), root in components(px).items()}


def test_labels_of_several_masks(spark):
    a, b = {1: MASKS[5]}, {1: MASKS[2], 9: MASKS[6]}
    for mask, df in zip((a, b), raster.labelled_each([frame(spark, a), frame(spark, b)], 5)):
        assert {(r.image_id, r.y, r.x): r.label for r in df.collect()} == {(k, y, x): c[0] * raster.STRIDE + c[1] for k, px in mask.items() for (y, x), c in components(px).items()}
    assert raster.labelled(frame(spark, a).limit(0)).count() == 0


@pytest.fixture(scope="module")
def ring_rows(spark):
    return contours.rings(frame(spark, MASKS)).cache()


def test_ring_areas_are_those_of_components(spark, ring_rows):
    labels = raster.labelled(frame(spark, MASKS))
    rows = contours.outlines(ring_rows).join(contours.with_labels(ring_rows, labels), ["image_id", "ring"]).collect()
    area, outer = Counter(), Counter()
    for r in rows:
        area[r.image_id, r.label] += r.area
        outer[r.image_id, r.label] += r.area > 0
    want = Counter((k, c[0] * raster.STRIDE + c[1]) for k, px in MASKS.items() for c in components(px).values())
    assert area == want
    assert set(outer.values()) == {1}  # one outline a component, all others are holes
    assert {(r.n_corners, r.area, r.d) for r in rows if r.image_id == 2} == {(4, 9.0, "M 0,0 L 3,0 L 3,3 L 0,3 Z"), (4, -1.0, "M 1,1 L 1,2 L 2,2 L 2,1 Z")}


def test_rings_are_closed_and_take_each_side_once(ring_rows):
    rings = {}
    for r in ring_rows.collect():
        rings.setdefault((r.image_id, r.ring), {})[r.seq] = (r.y, r.x)
    sides = Counter()
    for (image, _), at in rings.items():
        assert sorted(at) == list(range(len(at)))
        for i in at:
            (y, x), (v, u) = at[i], at[(i + 1) % len(at)]
            assert (y == v) != (x == u)
            step = (v > y) - (v < y), (u > x) - (u < x)
            while (y, x) != (v, u):
                sides[image, y, x, step] += 1
                y, x = y + step[0], x + step[1]
    want = Counter()
    for k, px in MASKS.items():
        px = set(px)
        for y, x in px:
            for dy, dx, start, step in ((-1, 0, (y, x), (0, 1)), (0, 1, (y, x + 1), (1, 0)), (1, 0, (y + 1, x + 1), (0, -1)), (0, -1, (y + 1, x), (-1, 0))):
                if (y + dy, x + dx) not in px:
                    want[k, *start, step] += 1
    assert sides == want


def off(p, a, b):
    (y, x), (ay, ax), (by, bx) = p, a, b
    length = (by - ay) ** 2 + (bx - ax) ** 2
    t = 0 if not length else min(1, max(0, ((y - ay) * (by - ay) + (x - ax) * (bx - ax)) / length))
    return ((ay + t * (by - ay) - y) ** 2 + (ax + t * (bx - ax) - x) ** 2) ** 0.5


@pytest.mark.parametrize("tolerance", [0.0, 0.8, 1.5, 5.0])
def test_dropped_corners_are_near(ring_rows, tolerance):
    full, kept = {}, {}
    for rows, into in ((ring_rows, full), (contours.simplified(ring_rows, tolerance), kept)):
        for r in rows.collect():
            into.setdefault((r.image_id, r.ring), {})[r.seq] = (r.y, r.x)
    assert full.keys() == kept.keys()
    for key, at in full.items():
        own = sorted(kept[key])
        assert own[0] == 0 and len(own) >= 2
        for seq, p in at.items():
            a = max(s for s in own if s <= seq)
            b = min((s for s in own if s > seq), default=0)
            assert seq in kept[key] or off(p, at[a], at[b]) <= tolerance + 1e-9
    if not tolerance:
        assert kept == full


def test_paths_begin_with_a_move(spark, ring_rows):
    from quillgrid.operators import geometry

    paths = contours.outlines(contours.simplified(ring_rows, 1.5)).selectExpr("image_id AS page", "ring AS path_id", "ring AS path_ord", "d", "CAST(array() AS array<string>) AS transforms")
    points = geometry.start_points(paths)
    assert points.count() == paths.count() > 0
    assert all(re.fullmatch(r"M \d+,\d+( L \d+,\d+)+ Z", r.d) for r in paths.collect())


def test_nothing_has_no_outline(spark):
    assert contours.rings(frame(spark, MASKS).limit(0)).count() == 0
