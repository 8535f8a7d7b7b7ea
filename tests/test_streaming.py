"""Completion and progress as a stream, split and stopped anywhere."""

import random

import pytest

from quillgrid.streaming import progress


def events(seed):
    rnd = random.Random(seed)
    rows = [(f, c, None) for f in range(6) for c in range(rnd.randrange(1, 6)) for _ in range(rnd.randrange(1, 3))]
    rows += [(f, None, 3) for f in range(5)] + [(9, None, None)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_stream_ends_as_the_batch_does(spark, tmp_path, parts):
    rows = events(parts)
    batch = spark.createDataFrame(rows, progress.EVENT)
    want = sorted(map(tuple, progress.file_counts(batch, 4).collect()))
    for k in range(parts):  # each part is a run of its own that goes on from the checkpoint
        spark.createDataFrame(rows[k::parts], progress.EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        progress.count_stream(progress.event_stream(spark, f"{tmp_path}/in", files_per_batch=1), 4, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    counts = progress.latest_counts(spark, f"{tmp_path}/out")
    assert sorted(map(tuple, counts.collect())) == want
    own = {f: {c for g, c, _ in rows if g == f and c is not None} for f in {r[0] for r in rows}}
    assert want == sorted((f, len(c), 3 if f < 5 else 4, f < 5 and len(c) >= 3) for f, c in own.items())
    (total,) = progress.overall(counts).collect()
    assert (total.n_done, total.n_total) == (sum(len(c) for c in own.values()), 15 + 2 * 4)
    assert total.percent == round(100 * total.n_done / total.n_total, 1)


def test_totals_are_corrected_when_the_palette_is_known(spark):
    rows = [(1, 0, None), (1, 1, None)]
    before = progress.file_counts(spark.createDataFrame(rows, progress.EVENT), 16).collect()
    after = progress.file_counts(spark.createDataFrame([*rows, (1, None, 2)], progress.EVENT), 16).collect()
    assert [tuple(r) for r in before] == [(1, 2, 16, False)] and [tuple(r) for r in after] == [(1, 2, 2, True)]
    assert progress.overall(spark.createDataFrame([], "findex long, n_done long, n_total long, all_done boolean")).first().percent is None
