"""Layers and outlines of one image in numpy, by the rules of ``contours``.

All layers lie in one grid, one below the other with a gap between, so components,
edges and polygons of an image's layers are found together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ..functions.batches import changed
from .raster import tile_labels
from .svgtext import SVG


def _edges(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (corners, as y * (width + 1) + x) and direction of each run of sides
    that face the background, sorted by start and direction.  No pixel lies at the rim."""
    width = mask.shape[1] + 1
    sides = []
    for direction, (dy, dx) in enumerate(((-1, 0), (0, 1), (1, 0), (0, -1))):
        side = mask & ~np.roll(mask, (-dy, -dx), (0, 1))
        along = side if dy else side.T
        first = np.argwhere(along & ~np.roll(along, 1, 1))
        last = np.argwhere(along & ~np.roll(along, -1, 1))
        across, lo, hi = first[:, 0] + (direction in (1, 2)), first[:, 1], last[:, 1] + 1
        begin, end = (lo, hi) if direction < 2 else (hi, lo)
        at = (lambda p, a=across: a * width + p) if dy else (lambda p, a=across: p * width + a)
        sides.append((at(begin), at(end), np.full(len(lo), direction)))
    begin, end, direction = (np.concatenate(c) for c in zip(*sides))
    order = np.argsort(begin * 4 + direction)
    return begin[order], end[order], direction[order]


def _rings(begin: np.ndarray, end: np.ndarray, direction: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges ring by ring, each from its least, and where rings begin among them."""
    key = begin * 4 + direction
    turned = [end * 4 + (direction + turn) % 4 for turn in (3, 1)]
    place = [np.minimum(np.searchsorted(key, t), max(0, len(key) - 1)) for t in turned]
    after = np.where(key[place[0]] == turned[0], place[0], place[1]).tolist()
    seen, order, begins = bytearray(len(after)), [], []
    for e in range(len(after)):
        if not seen[e]:
            begins.append(len(order))
            while not seen[e]:
                seen[e] = 1
                order.append(e)
                e = after[e]
    return np.array(order, np.int64), np.array(begins, np.int64)


def _kept(y: np.ndarray, x: np.ndarray, begins: np.ndarray, tolerance: float) -> np.ndarray:
    """Corners that ``contours.simplified`` keeps, of rings that begin at these places."""
    n = len(y)
    sizes = np.diff(np.append(begins, n))
    first = np.repeat(begins, sizes)
    kept = np.zeros(n, bool)
    kept[begins] = True
    kept[_firsts((y - y[first]) ** 2 + (x - x[first]) ** 2, begins)[0]] = True
    ends = np.repeat(begins + sizes, sizes)
    side = np.flatnonzero(kept)  # sides that may be cut, by their first corners
    while len(side):
        all_ = np.flatnonzero(kept)
        stop = np.append(all_, n)[np.searchsorted(all_, side) + 1]
        stop = np.minimum(stop, ends[side])
        b = np.where(stop < ends[side], np.minimum(stop, n - 1), first[side])
        count = stop - side
        starts = np.cumsum(count) - count
        at = np.arange(count.sum()) + np.repeat(side - starts, count)
        far, most = _firsts(_off(y, x, at, np.repeat(side, count), np.repeat(b, count)), starts)
        cut = most > tolerance * tolerance
        far = at[far[cut]]
        kept[far] = True
        side = np.sort(np.concatenate([side[cut], far]))
    return kept


def _firsts(values: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of the largest value of each run, and that value."""
    most = np.maximum.reduceat(values, begins)
    run = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(values))))
    at = np.flatnonzero(values == most[run])
    return at[np.append(True, run[at][1:] != run[at][:-1])], most


def _off(y, x, at, a, b) -> np.ndarray:
    """Squared distances of corners from the sides from a to b, as ``contours`` has them."""
    py, px, sy, sx = y[at] - y[a], x[at] - x[a], y[b] - y[a], x[b] - x[a]
    length, dot, cross = sy * sy + sx * sx, py * sy + px * sx, px * sy - py * sx
    near, far = py * py + px * px, (y[at] - y[b]) ** 2 + (x[at] - x[b]) ** 2
    between = cross.astype(np.float64) * cross / np.maximum(length, 1)
    return np.where(dot <= 0, near, np.where(dot >= length, far, between))


def layers(y: np.ndarray, x: np.ndarray, cindex: np.ndarray, n: int, speckle: int, tolerance: float, stack: bool) -> list[tuple[int, str]]:
    """(cindex, path) of each layer of an image that has any."""
    top, left = int(y.min()), int(x.min())
    height, width = int(y.max()) - top + 3, int(x.max()) - left + 3
    grid = np.zeros((n, height, width), bool)
    grid[cindex, y - top + 1, x - left + 1] = True
    if stack:
        grid = np.maximum.accumulate(grid[::-1])[::-1]
    mask = grid.reshape(n * height, width)
    if speckle and mask.any():
        at = np.argwhere(mask)
        label = tile_labels(at[:, 0], at[:, 1])
        gone = at[np.bincount(label)[label] <= speckle]
        mask[gone[:, 0], gone[:, 1]] = False
    begin, end, direction = _edges(mask)
    if not len(begin):
        return []
    order, begins = _rings(begin, end, direction)
    cy, cx = np.divmod(begin[order], width + 1)
    kept = _kept(cy, cx, begins, tolerance) if tolerance > 0 else np.ones(len(order), bool)
    layer = cy[begins] // height
    at = np.flatnonzero(kept)
    ring = np.searchsorted(begins, at, "right") - 1
    said = [f"{u},{v}" for u, v in zip((cx[at] + left - 1).tolist(), (cy[at] - layer[ring] * height + top - 1).tolist())]
    lo = np.searchsorted(ring, np.arange(len(begins))).tolist()
    paths: dict[int, list[str]] = {}
    for i, k in enumerate(layer.tolist()):
        paths.setdefault(k, []).append(f"M {' L '.join(said[lo[i] : lo[i + 1] if i + 1 < len(lo) else len(said)])} Z")
    return [(k, " ".join(p)) for k, p in sorted(paths.items())]


def documents(rows: pa.RecordBatch, speckle: int, tolerance: float, stack: bool) -> pa.RecordBatch:
    """(image_id, document) of whole images (image_id, y, x, r, g, b)."""
    y, x, r, g, b = (rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in "yxrgb")
    begins = np.flatnonzero(changed([rows.column(0)]))
    out = []
    for lo, hi in zip(begins.tolist(), [*begins[1:].tolist(), len(y)]):
        colours, at = np.unique(-(r[lo:hi] << 16 | g[lo:hi] << 8 | b[lo:hi]), return_inverse=True)
        width, height = int(x[lo:hi].max()) + 1, int(y[lo:hi].max()) + 1
        body = "".join(f'<g id="layer{k}"><path fill="#{-int(colours[k]):06x}" fill-rule="evenodd" d="{d}"/></g>\n' for k, d in layers(y[lo:hi], x[lo:hi], at, len(colours), speckle, tolerance, stack))
        out.append(f'<svg xmlns="{SVG}" version="1.1" width="{width}" height="{height}" viewBox="0 0 {width} {height}">\n{body}</svg>')
    return pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(begins)), pa.array(out, pa.string())], names=["image_id", "document"])
