"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions.

Each source is one stream of characters, its documents in an order given by a
hash of their id, cut into blocks of ``block_chars``.  Weights are integers w out
of their sum W.  Block i (from 0) of a source is released at slot
floor(i*W/w) and due at slot ceil((i+1)*W/w); every slot takes, of the released
blocks, the one that is due first (ties: the source listed first).  As the
weights of all sources that still have blocks add up to one slot a slot, each
source has at every slot within one block of its share.

When a source ends, a new phase begins with the weights of the others; all rows
are kept.  A schedule repeats every W slots, so a phase is one template of W
slots, made by folding over the slots of one row that has a column value per
source: the work on it depends on the weights only.  A document's slot is then
arithmetic on the block in which it starts.

Running character counts come in two steps, so that a hot source is no single
task: within a bucket (source, first three hex digits of the hash), and over
the at most 4,096 bucket totals of each source.

Defined cases: sources that are not listed, null ones included, share
``other_weight``; null text and empty text have no characters and stand in the
block at which they occur; a text longer than a block takes up its share of
slots, so what follows in that source comes later; equal ids are ordered by
text; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OTHER = "(other)"
#: The sum of weights is the length of a schedule's template; with the number of
#: sources it bounds what is broadcast (4,096 totals and a template a source).
MAX_WEIGHT_SUM = 10_000
MAX_SOURCES = 256


def _plan(counts: DataFrame, weights: dict[str, int]) -> DataFrame:
    """For each source its phases: from block ``lo`` to before ``hi``, the slot
    ``base`` at which the phase starts, weight w, period and slots of a period.

    counts: (src, blocks), one row a source.
    """
    names, n = list(weights), len(weights)
    one = counts.groupBy().agg(*(F.coalesce(F.max(F.when(F.col("src") == s, F.col("blocks"))), F.lit(0)).alias(f"b{i}") for i, s in enumerate(names)))
    start = one.selectExpr(f"array({','.join(f'cast(b{i} as bigint)' for i in range(n))}) AS total")
    w = f"array({','.join(f'{weights[s]}L' for s in names)})"
    sources = f"sequence(0, {n - 1})"
    # a fold over phases; state: blocks placed so far, slots used, the phases
    active = f"transform({sources}, s -> IF(p.done[s] < total[s], {w}[s], 0L))"
    period = "aggregate(a, 0L, (x, y) -> x + y)"
    # earliest deadline of the released blocks; deadline and place make one sortable struct
    due = "array_min(transform(filter({src}, s -> a[s] > 0 AND (c.n[s] * w) div a[s] <= t), s -> named_struct('due', ((c.n[s] + 1) * w + a[s] - 1) div a[s], 's', s))).s"
    fold = (
        "aggregate(sequence(0L, w - 1), named_struct('n', transform({src}, s -> 0L), 'pick', cast(array() as array<int>)), "
        "(c, t) -> transform(array(" + due + "), k -> named_struct('n', transform(c.n, (x, s) -> IF(s = k, x + 1, x)), 'pick', concat(c.pick, array(k))))[0])"
    ).replace("{src}", sources)
    # slots (from 0) of each source in one period
    slots = f"transform({sources}, s -> filter(transform(sequence(0, size(pick) - 1), t -> IF(pick[t] = s, t, -1)), t -> t >= 0))"
    # the slot of a source's last block decides when the phase ends
    last = f"array_min(transform(filter({sources}, s -> a[s] > 0), s -> ((total[s] - p.done[s] - 1) div a[s]) * w + at[s][int((total[s] - p.done[s] - 1) % a[s])] + 1))"
    taken = f"transform({sources}, s -> IF(a[s] = 0, 0L, (len div w) * a[s] + size(filter(at[s], t -> t < len % w))))"
    state = "named_struct('done', transform(total, x -> 0L), 'base', 0L, 'phases', cast(array() as array<struct<base:bigint,w:bigint,a:array<bigint>,lo:array<bigint>,hi:array<bigint>,at:array<array<int>>>>))"

    def let(name: str, value: str, body: str) -> str:
        return f"transform(array({value}), {name} -> {body})[0]"

    step = let(
        "a",
        active,
        let(
            "w",
            period,
            "IF(w = 0, p, "
            + let("pick", f"{fold}.pick", let("at", slots, let("len", f"bigint({last})", let("got", taken,
                "named_struct('done', transform(p.done, (x, s) -> x + got[s]), 'base', p.base + len, 'phases', concat(p.phases, array(named_struct("
                "'base', p.base, 'w', w, 'a', a, 'lo', p.done, 'hi', transform(p.done, (x, s) -> x + got[s]), 'at', at))))"))))
            + ")",
        ),
    )
    plan = start.selectExpr(f"aggregate(sequence(1, {n}), {state}, (p, i) -> {step}).phases AS phases")
    each = plan.select(F.explode(F.arrays_zip(F.array(*map(F.lit, names)).alias("src"), F.sequence(F.lit(0), F.lit(n - 1)).alias("s"))).alias("z"), "phases")
    return each.selectExpr("z.src AS src", "transform(phases, p -> named_struct('base', p.base, 'w', p.w, 'a', p.a[z.s], 'lo', p.lo[z.s], 'hi', p.hi[z.s], 'at', p.at[z.s])) AS phases")


def mixed(documents: DataFrame, weights: dict[str, int], other_weight: int = 1, block_chars: int = 65_536) -> DataFrame:
    """(doc_id, source, n_chars, block, slot, start_char) of every document: the
    corpus in the order (slot, start_char, doc_id) is the mixture."""
    weights = {**weights, OTHER: other_weight}
    if min(weights.values()) < 1 or sum(weights.values()) > MAX_WEIGHT_SUM or len(weights) > MAX_SOURCES:
        raise ValueError(f"weights are integers from 1 up, for {MAX_SOURCES} sources and {MAX_WEIGHT_SUM} in all at most")
    listed = F.col("source").isin([s for s in weights if s != OTHER])
    rows = documents.select("doc_id", "source", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h"), F.md5(F.coalesce("text", F.lit(""))).alias("t"))
    rows = rows.withColumn("src", F.when(listed, F.col("source")).otherwise(F.lit(OTHER))).withColumn("bucket", F.substring("h", 1, 3))
    # totals of buckets come from their own scan: a few numbers a bucket cross the network
    totals = rows.groupBy("src", "bucket").agg(F.sum("n_chars").alias("chars"))
    before = totals.selectExpr("src", "bucket", "coalesce(sum(chars) OVER (PARTITION BY src ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before")
    # a source of empty texts only still has the block in which they stand
    blocks = totals.groupBy("src").agg(F.greatest(F.ceil(F.sum("chars") / block_chars), F.lit(1)).cast("long").alias("blocks"))
    plan = _plan(blocks, weights).join(blocks, "src")
    own = "coalesce(sum(n_chars) OVER (PARTITION BY src, bucket ORDER BY h, doc_id, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    placed = rows.selectExpr("doc_id", "source", "n_chars", "src", "bucket", f"{own} AS own").join(F.broadcast(before), ["src", "bucket"])
    placed = placed.withColumn("start_char", F.col("own") + F.col("before")).join(F.broadcast(plan), "src")
    # texts without characters at a source's very end stand in its last block
    placed = placed.withColumn("block", F.least(F.expr(f"start_char div {block_chars}"), F.col("blocks") - 1))
    phase = F.expr("filter(phases, p -> block >= p.lo AND block < p.hi)[0]")
    slot = F.expr("p.base + ((block - p.lo) div p.a) * p.w + p.at[int((block - p.lo) % p.a)]")
    return placed.withColumn("p", phase).select("doc_id", "source", "n_chars", "block", slot.alias("slot"), "start_char")


def places(documents: DataFrame, weights: dict[str, int], other_weight: int = 1, block_chars: int = 65_536) -> DataFrame:
    """(__id, slot, start_char): of each id, the first place in the mixture."""
    at = mixed(documents, weights, other_weight, block_chars).groupBy("doc_id").agg(F.min(F.struct("slot", "start_char")).alias("at"))
    return at.select(F.col("doc_id").alias("__id"), "at.slot", "at.start_char")


def with_places(rows: DataFrame, at: DataFrame) -> DataFrame:
    """``rows`` with the place of their doc_id, as many as before."""
    return rows.join(at, F.col("doc_id").eqNullSafe(F.col("__id"))).drop("__id")


def in_mixed_order(documents: DataFrame, weights: dict[str, int], other_weight: int = 1, block_chars: int = 65_536) -> DataFrame:
    """``documents``, range-partitioned and sorted by the mixture's order: files
    written from it hold the mixture from the first to the last row."""
    at = places(documents, weights, other_weight, block_chars)
    known = with_places(documents, at.withColumnsRenamed({"slot": "__slot", "start_char": "__start"}))
    order = ["__slot", "__start", "doc_id"]
    return known.repartitionByRange(*order).sortWithinPartitions(*order).select(*documents.columns)


def oracle(weights: dict[str, int], other_weight: int, block_chars: int) -> str:
    """DuckDB SQL for ``mixed``: the schedule slot by slot, without templates."""
    weights = {**weights, OTHER: other_weight}
    values = ", ".join(f"('{s}', {i}, {w}::BIGINT)" for i, (s, w) in enumerate(weights.items()))
    listed = ", ".join(f"'{s}'" for s in weights if s != OTHER) or "NULL"
    return f"""
WITH RECURSIVE w(src, k, w) AS (VALUES {values}),
docs AS (
  SELECT doc_id, source, CAST(coalesce(length(text), 0) AS BIGINT) AS n_chars, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h, md5(coalesce(text, '')) AS t,
         CASE WHEN source IN ({listed}) THEN source ELSE '{OTHER}' END AS src FROM documents),
placed AS (
  SELECT *, CAST(coalesce(sum(n_chars) OVER (PARTITION BY src ORDER BY h, doc_id, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_char FROM docs),
n AS (
  SELECT w.src, k, w, CAST(greatest(ceil(sum(n_chars) / {block_chars}), 1) AS BIGINT) AS blocks FROM docs JOIN w USING (src) GROUP BY ALL),
src AS (SELECT list(struct_pack(src, w, blocks) ORDER BY k) AS s FROM n),
-- done: blocks placed; lo: blocks placed before the phase; t: slot within the phase; ww: sum of weights of the phase
run AS (
  SELECT 0::BIGINT AS slot, 0::BIGINT AS t, list_transform(s, lambda x: 0::BIGINT) AS done, list_transform(s, lambda x: 0::BIGINT) AS lo,
         list_sum(list_transform(s, lambda x: x.w))::BIGINT AS ww, -1::BIGINT AS pick, s FROM src
  UNION ALL
  SELECT slot + 1,
         CASE WHEN done2[pick2] = s[pick2].blocks THEN 0 ELSE t + 1 END,
         done2,
         CASE WHEN done2[pick2] = s[pick2].blocks THEN done2 ELSE lo END,
         CASE WHEN done2[pick2] = s[pick2].blocks THEN ww - s[pick2].w ELSE ww END,
         pick2, s
  FROM (SELECT *, list_transform(done, lambda d, i: CASE WHEN i = pick2 THEN d + 1 ELSE d END) AS done2
        FROM (SELECT *, list_min(list_transform(list_filter(range(1, len(s) + 1), lambda i: done[i] < s[i].blocks AND ((done[i] - lo[i]) * ww) // s[i].w <= t),
                 lambda i: struct_pack(due := ((done[i] - lo[i] + 1) * ww + s[i].w - 1) // s[i].w, i := i))).i AS pick2
              FROM run WHERE ww > 0))),
slots AS (SELECT s[pick].src AS src, done[pick] - 1 AS block, slot - 1 AS slot FROM run WHERE pick > 0)
SELECT doc_id, source, n_chars, b.block, slots.slot, start_char
FROM (SELECT placed.*, least(start_char // {block_chars}, n.blocks - 1) AS block FROM placed JOIN n USING (src)) b
JOIN slots ON slots.src = b.src AND slots.block = b.block
"""
