"""Intermediate tables: how long they stay, and joins with hot keys."""

import os

import pytest
from pyspark.sql import functions as F

from quillgrid.functions import joins, storage
from quillgrid.operators import graph


def path_of(table):
    return storage._paths[table].removeprefix("file://")


def test_tables_go_with_their_scope(spark):
    outer = storage.written(spark.range(3), "outer")
    with storage.temporary(spark):
        a, b, c = (storage.written(spark.range(n), "inner") for n in (1, 2, 3))
        storage.dropped(a)
        assert not os.path.exists(path_of(b) + "-") and os.path.exists(path_of(b))
        kept = storage.lasting(c)
        with storage.temporary(spark):
            d = storage.lasting(storage.written(spark.range(4), "innermost"))
        assert d.count() == 4
    assert [os.path.exists(path_of(x)) for x in (outer, b, kept, d)] == [True, False, True, False]
    assert (outer.count(), kept.count()) == (3, 3)
    storage.dropped(outer, kept)
    assert not os.path.exists(storage.application_folder(spark).removeprefix("file://") + "/nothing")


def test_tables_go_when_a_step_fails(spark):
    with pytest.raises(RuntimeError), storage.temporary(spark):
        table = storage.written(spark.range(1), "lost")
        raise RuntimeError
    assert not os.path.exists(path_of(table))


def test_rounds_leave_one_table(spark):
    before = set(os.listdir(storage.application_folder(spark).removeprefix("file://")))
    edges = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r.root for r in graph.components(edges).collect()} == {0}
    assert len(set(os.listdir(storage.application_folder(spark).removeprefix("file://"))) - before) == 1


@pytest.mark.parametrize("hot", [5, 100_000])
def test_hubs_and_chains_have_the_same_components(spark, monkeypatch, hot):
    monkeypatch.setattr(graph, "HOT_ROWS", hot)
    monkeypatch.setattr(joins, "HOT_ROWS", hot)
    pairs = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(40)] + [(500, 500), (501, None), (300, 302), (302, 300), (300, 302)]
    got = {r.v: r.root for r in graph.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(60)} | {i: 100 for i in range(100, 141)} | {300: 300, 302: 300}


def test_hot_keys_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_ROWS", 10)
    rows = spark.range(300).select(F.col("id"), F.when(F.col("id") < 250, 7).otherwise(F.col("id")).cast("long").alias("k"))
    keyed = rows.groupBy("k").agg(F.count("*").alias("copies"), F.min("id").alias("low"))
    got = sorted((r.id, r.low) for r in joins.hot_join(rows, keyed, "k", F.col("id")).collect())
    assert got == [(i, 0 if i < 250 else i) for i in range(300)]


def test_clear(spark):
    storage.written(spark.range(1), "any")
    storage.clear(spark)
    assert not os.path.exists(storage.application_folder(spark).removeprefix("file://"))
