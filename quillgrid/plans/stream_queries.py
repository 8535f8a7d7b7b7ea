"""Registered queries that run a stream over the given tables to its end."""

from pyspark.sql import functions as F

from ..functions.storage import shared_path
from ..streaming import progress
from . import views as v
from .registry import query

COLOURS = 16
#: An order's lines are a picture's layers; a picture's palette is known when its first line has come.
EVENT = "l_orderkey AS findex, CAST(CASE WHEN l_linestatus = 'F' THEN l_linenumber END AS INT) AS cindex, CAST(CASE WHEN l_linenumber = 1 AND l_orderkey % 3 > 0 THEN 1 + l_orderkey % 7 END AS INT) AS palette_size"
EVENTS = f"ev AS (SELECT {EVENT} FROM lineitem), own AS (SELECT findex, count(DISTINCT cindex) AS n_done, max(palette_size) AS known FROM ev GROUP BY findex), counts AS (SELECT findex, n_done, CAST(coalesce(known, {COLOURS}) AS BIGINT) AS n_total, coalesce(n_done >= known, FALSE) AS all_done FROM own)"


def streamed(s, d):
    table = v.table(s, d, "lineitem")
    # by a pattern: the table may be one file, which is no base path of a stream
    lines = s.readStream.schema(table.schema).parquet(f"{d}/lineitem.parquet*")
    out = shared_path(s, "counts")
    progress.count_stream(lines.selectExpr(*EVENT.split(", ")), COLOURS, out, shared_path(s, "counts-checkpoint")).awaitTermination()
    return progress.latest_counts(s, out)


@query("layer_completion_stream", f"WITH {EVENTS} SELECT * FROM counts")
def layer_completion_stream(s, d):
    return streamed(s, d)


@query("progress_percent_stream", f"WITH {EVENTS} SELECT CAST(sum(n_done) AS BIGINT) AS n_done, CAST(sum(n_total) AS BIGINT) AS n_total, round(sum(n_done) * 100.0::DOUBLE / sum(n_total), 1) AS percent FROM counts")
def progress_percent_stream(s, d):
    return progress.overall(streamed(s, d)).select(F.col("n_done"), "n_total", "percent")
