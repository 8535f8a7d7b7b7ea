"""Tables and paths in the folder that all executors share.

Intermediate tables of an application lie in one folder of its own, which ``clear``
removes when its results are written.  ``temporary`` removes the tables written
within it as soon as it ends, and ``dropped`` single tables that nothing reads any
more, such as those of an earlier round.
"""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables that DataFrames of ``written`` read, and open scopes' paths.
_paths: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
_scopes: list[set[str]] = []


def application_folder(spark: SparkSession) -> str:
    """This application's folder in the one all executors share
    (``spark.checkpoint.dir``).

    Where that setting is absent, a temporary folder of this machine takes its
    place on a local master, set once for the session; on a cluster, whose
    machines would not see it, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master or 'the cluster'} share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tables-{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the application's folder."""
    return f"{application_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends here, and a lost
    executor costs a reread instead of a recomputation."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    if _scopes:
        _scopes[-1].add(path)
    return out


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def dropped(*tables: DataFrame) -> None:
    """Removes the tables of ``written``; nothing may read them any more."""
    for table in tables:
        path = _paths.pop(table)
        for scope in _scopes:
            scope.discard(path)
        _remove(table.sparkSession, path)


def lasting(table: DataFrame) -> DataFrame:
    """A table of ``written`` that outlasts the scope it was written in; it goes
    with the next outer one."""
    path = _paths[table]
    if _scopes and path in _scopes[-1]:
        _scopes[-1].discard(path)
        if len(_scopes) > 1:
            _scopes[-2].add(path)
    return table


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables written within go when it ends, but for those made ``lasting``."""
    _scopes.append(set())
    try:
        yield
    finally:
        for path in _scopes.pop():
            _remove(spark, path)


def clear(spark: SparkSession) -> None:
    """Removes all intermediate tables of the application; to be called when its
    results are written."""
    _remove(spark, application_folder(spark))
