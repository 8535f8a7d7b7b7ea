"""Arrow batches of whole keys, for functions that go over sorted partitions."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Rows and bytes of a slice, unless one key has more.
ROWS = 1 << 16
BYTES = 1 << 20


def changed(columns: list[pa.Array]) -> np.ndarray:
    """Where a row differs from the one before it; nulls are equal, the first row differs."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    out[:1] = True
    for c in columns:
        same = pc.fill_null(pc.equal(c[1:], c[:-1]), False)
        if c.null_count:
            same = pc.or_(same, pc.and_(pc.is_null(c[1:]), pc.is_null(c[:-1])))
        out[1:] |= ~same.to_numpy(zero_copy_only=False)
    return out


def whole(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Slices of sorted batches in which no key, the first ``keys`` columns, is cut."""
    held: list[pa.RecordBatch] = []

    def told():
        return pa.concat_batches(held) if len(held) > 1 else held[0]

    for batch in batches:
        step = max(1, min(ROWS, BYTES * batch.num_rows // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            begins = np.flatnonzero(changed(part.columns[:keys]))
            if held and not changed([pa.concat_arrays([held[-1].column(k)[-1:], part.column(k)[:1]]) for k in range(keys)])[1]:
                if len(begins) == 1:
                    held.append(part)
                    continue
                held.append(part.slice(0, begins[1]))
                part, begins = part.slice(begins[1]), begins[1:] - begins[1]
            if held:
                yield told()
            if len(begins) > 1:
                yield part.slice(0, begins[-1])
            held = [part.slice(begins[-1])]
    if held:
        yield told()


def map_whole(df: DataFrame, keys: int, run: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``run`` over slices of whole keys of ``df``, whose partitions are sorted by
    its first ``keys`` columns.  Free memory goes back to the system when a task ends."""

    def bounded(batches):
        for part in whole(batches, keys):
            out = run(part)
            for at in range(0, out.num_rows, ROWS):
                yield out.slice(at, ROWS)
        gc.collect()
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(bounded, schema)
