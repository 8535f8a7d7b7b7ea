"""Source divergence audit: which sources of a language use which terms unlike the others.

Method: in-mapper stripes.  Each task folds whole documents into hash stripes: per
language a map from term to its document frequency and its count by source.  When
the stripes of a task hold more than ``HELD`` counts they are handed on and
begun anew.  Spark brings the stripes of a key together, sorted, and they
are merged one key after another; a stripe whose term is in too few documents of
its language goes.  Merged stripes are dealt out in buckets of bounded size by
(language, hash of term) and meet the totals of their language's sources, which
gives each bucket's share of every divergence at once: no pair of documents and
no pair of rows is ever made.  Shares are summed by Spark.

All arithmetic is exact: p, q and f are integers of 64 bits, sums of f go in two
halves.

Defined cases: null text, lang and source count as empty text; a group without
terms has p = 1 + floor(10^9 / V) for each term; a language without kept terms
gives pairs of value 0; one without another source gives no pairs; a sum beyond
2^63 - 1 is null.  Equal values rank by the item's UTF-8 bytes.  Documents
that repeat a doc_id count each; ids and other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_KEYS, hot_join, map_arrow, written

TERM = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
GAP = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]")
#: Bytes of a text that are cut into terms at a time.
SLICE = 1 << 20
#: Counts, and bytes of terms, that a task's stripes hold before they are handed on.
HELD = 700_000
HELD_BYTES = 32 << 20
#: Stripes that are merged at a time.
ROWS = 8192
#: Numbers that a bucket's table of counts (terms x sources) has about; with many
#: sources so many times more, lest a bucket return more rows than its table has numbers.
CELLS = 1 << 17
WIDER = 32
#: Sources whose divergences one bucket works out.
BLOCK = 256
SCALE = 1_000_000_000
HALF = 30
RANKS = 200
STRIPE = "lang binary, term binary, df long, sources array<binary>, counts array<long>"


def term_counts(text: bytes) -> Counter:
    """How often each term occurs in the whole text, slice by slice."""
    found: Counter = Counter()
    at = 0
    while at < len(text):
        gap = GAP.search(text, at + SLICE)
        end = gap.end() if gap else len(text)
        found.update(TERM.findall(text[at:end].lower()))
        at = end
    return found


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=[c.split()[0] for c in STRIPE.split(", ")])


def folded(documents: DataFrame) -> DataFrame:
    """Stripes of each task: (lang, term, df, sources, counts)."""
    rows = documents.select(*(F.coalesce(F.col(c), F.lit("")).cast("binary").alias(c) for c in ("lang", "source", "text")))

    def handed_on(stripes):
        rows = [(lang, term, s[0], list(s[1]), list(s[1].values())) for lang, own in stripes.items() for term, s in own.items()]
        for lo in range(0, len(rows), 20_000):
            yield _batch(rows[lo : lo + 20_000])

    def run(batches):
        stripes: dict[bytes, dict[bytes, list]] = {}
        held = size = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
                own = stripes.setdefault(lang, {})
                for term, n in term_counts(text).items():
                    stripe = own.get(term)
                    if stripe is None:
                        own[term] = [1, {source: n}]
                        held += 1
                        size += len(term)
                        continue
                    stripe[0] += 1
                    counts = stripe[1]
                    if source in counts:
                        counts[source] += n
                    else:
                        counts[source] = n
                        held += 1
                if held > HELD or size > HELD_BYTES:
                    yield from handed_on(stripes)
                    stripes, held, size = {}, 0, 0
        yield from handed_on(stripes)

    return map_arrow(rows, run, STRIPE)


def _merge(stripes: pa.RecordBatch) -> pa.RecordBatch:
    """Sorted stripes with those of one key as one."""
    lang, term, df, sources, counts = stripes.columns
    n = stripes.num_rows
    first = np.ones(n, bool)
    if n > 1:
        same = (pc.equal(key.slice(1), key.slice(0, n - 1)).to_numpy(zero_copy_only=False) for key in (lang, term))
        first[1:] = ~np.logical_and(*same)
    starts = np.flatnonzero(first)
    run = np.repeat(np.cumsum(first) - 1, pc.list_value_length(sources).to_numpy(zero_copy_only=False))
    names = sources.flatten().dictionary_encode()
    key = run * len(names.dictionary) + names.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(key, kind="stable")
    own, at = np.unique(key[order], return_index=True)
    sums = np.add.reduceat(counts.flatten().to_numpy(zero_copy_only=False)[order], at)
    offsets = pa.array(np.searchsorted(own // len(names.dictionary), np.arange(len(starts) + 1)).astype(np.int32))
    merged = [pa.ListArray.from_arrays(offsets, names.dictionary.take(pa.array(own % len(names.dictionary)))), pa.ListArray.from_arrays(offsets, pa.array(sums))]
    return pa.RecordBatch.from_arrays([lang.take(pa.array(starts)), term.take(pa.array(starts)), pa.array(np.add.reduceat(df.to_numpy(), starts)), *merged], names=stripes.schema.names)


def merged(stripes: DataFrame, least: int) -> DataFrame:
    """One stripe for each (lang, term) in at least so many documents of its
    language.  A batch's last key waits for the next batch, in which it may go on."""

    def run(batches):
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = pa.RecordBatch.from_arrays(batch.columns, names=[c.split()[0] for c in STRIPE.split(", ")])
            both = _merge(batch if last is None else pa.concat_batches([last, batch]))
            last = both.slice(both.num_rows - 1)
            done = both.slice(0, both.num_rows - 1)
            yield done.filter(pc.greater_equal(done.column("df"), least))
        if last is not None:
            yield last.filter(pc.greater_equal(last.column("df"), least))

    return map_arrow(stripes.repartition("lang", "term").sortWithinPartitions("lang", "term"), run, STRIPE, ROWS)


def shares(count: np.ndarray, total) -> np.ndarray:
    """1 + floor(10^9 * (count + 1) / total), three digits at a time, so that
    nothing grows beyond 1,000 totals."""
    rest, out = count + 1, np.zeros(np.broadcast(count, total).shape, np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def apart(p, q):
    """floor((p - q)^2 / q); p and q are below 2^31, so the square fits."""
    d = p - q
    return d * d // q


def _bucket(stripes: pa.Table, sources: pa.Table, size: int) -> pa.Table:
    """A bucket's part of each divergence of the block's sources: rows (lang,
    source, part, item, hi, lo) with f = hi * 2^30 + lo, summed for pairs."""
    kinds = [("lang", pa.binary()), ("source", pa.binary()), ("part", pa.string()), ("item", pa.binary()), ("hi", pa.int64()), ("lo", pa.int64())]
    schema = pa.schema(kinds)
    if not stripes.num_rows or not sources.num_rows:
        return schema.empty_table()
    lang = sources.column("lang")[0].as_py()
    names = sources.column("source").to_pylist()
    place = {s: i for i, s in enumerate(names)}
    terms = stripes.column("term").to_pylist()
    v = sources.column("v")[0].as_py()
    table = np.zeros((len(names), len(terms)), np.int64)
    for t, (own, n) in enumerate(zip(stripes.column("sources").to_pylist(), stripes.column("counts").to_pylist())):
        table[[place[s] for s in own], t] = n
    totals = np.array(sources.column("n").to_pylist(), np.int64)
    p = shares(table, (totals + v)[:, None])
    q = shares(table.sum(0), int(sources.column("n_lang")[0].as_py()) + v)
    block = stripes.column("block")[0].as_py()
    out: list[list] = [[] for _ in range(5)]
    for g in range(block * size, min(len(names), (block + 1) * size)):
        f = apart(p[g], p)
        hi, lo = (f >> HALF).sum(1), (f & ((1 << HALF) - 1)).sum(1)
        others = [h for h in range(len(names)) if h != g]
        out[0] += [names[g]] * len(others)
        out[1] += ["pair"] * len(others)
        out[2] += [names[h] for h in others]
        out[3] += hi[others].tolist()
        out[4] += lo[others].tolist()
        own = np.flatnonzero((table[g] > 0) & (p[g] > q))
        f = apart(p[g, own], q[own])
        if own.size > RANKS:  # the last ranks of the bucket, with all that tie there
            keep = f >= np.partition(f, own.size - RANKS)[own.size - RANKS]
            own, f = own[keep], f[keep]
        out[0] += [names[g]] * own.size
        out[1] += ["term"] * own.size
        out[2] += [terms[t] for t in own.tolist()]
        out[3] += [0] * own.size
        out[4] += f.tolist()
    return pa.table([pa.array([lang] * len(out[0]), pa.binary()), *(pa.array(x, kind) for x, (_, kind) in zip(out, kinds[1:]))], schema=schema)


def audit(documents: DataFrame, least: int = 3) -> DataFrame:
    """lang, source, part, item, value, rank: for each (lang, source) group its
    divergence from every other source of the language (part ``pair``), and the
    terms that it uses more than its language does (part ``term``, 200 ranks)."""
    stripes = written(merged(folded(documents), least), "stripes")
    groups = documents.select(*(F.coalesce(F.col(c), F.lit("")).cast("binary").alias(c) for c in ("lang", "source"))).distinct()
    counted = stripes.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    kept = stripes.groupBy("lang").agg(F.count("*").alias("v"))
    w = Window.partitionBy("lang")
    totals = groups.join(counted, ["lang", "source"], "left").join(kept, "lang", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "v": F.coalesce("v", F.lit(0))})
    totals = written(totals.withColumns({"n_lang": F.sum("n").over(w), "n_sources": F.count("*").over(w)}), "totals")
    # a language's terms in buckets, for each block of its sources anew
    langs = totals.groupBy("lang").agg(F.first("v").alias("v"), F.first("n_sources").alias("s"))
    terms = F.greatest(F.lit(1), F.floor(CELLS / F.col("s")), F.least("s", F.floor(CELLS * WIDER / F.col("s"))))
    dealt = langs.select("lang", F.ceil(F.col("v") / terms).alias("buckets"), F.ceil(F.col("s") / BLOCK).alias("blocks"), F.col("v").alias("copies"))
    few = dealt.count() <= MAX_BROADCAST_KEYS
    by_lang = stripes.join(F.broadcast(dealt.drop("copies")), "lang") if few else hot_join(stripes, dealt, "lang", F.col("term"))
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    own = by_lang.select("lang", "term", "sources", "counts", F.pmod(F.xxhash64("term"), "buckets").alias("bucket"), blocks)
    told = totals.where("v > 0").join(dealt.drop("copies"), "lang").select("lang", "source", "n", "v", "n_lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)).alias("bucket"), blocks)
    key, size = ["lang", "bucket", "block"], BLOCK
    parts = own.groupBy(*key).cogroup(told.groupBy(*key)).applyInArrow(lambda _, a, b: _bucket(a, b.sort_by("source"), size), "lang binary, source binary, part string, item binary, hi long, lo long")
    # a term has one row a group, a pair one a bucket
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    parts = written(parts.groupBy("lang", "source", "part", "item").agg((exact("hi") * (1 << HALF) + exact("lo")).try_cast("long").alias("value")), "parts")
    # of languages without terms
    none = totals.where("v = 0").select("lang", "source")
    none = none.join(none.select("lang", F.col("source").alias("item")), "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    pairs = parts.where("part = 'pair'").unionByName(none).withColumn("rank", rank)
    ranked = pairs.unionByName(parts.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= RANKS))
    return ranked.select(*(F.col(c).cast("string").alias(c) for c in ("lang", "source")), "part", F.col("item").cast("string").alias("item"), "value", "rank")


def oracle(least: int = 3) -> str:
    return rf"""WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
tf AS (SELECT i, lang, source, term, count(*) AS n FROM (SELECT i, lang, source, unnest(ws) AS term FROM d) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, sum(n)::HUGEINT AS cl FROM tf GROUP BY ALL HAVING count(*) >= {least}),
c AS MATERIALIZED (SELECT lang, source, term, sum(n)::HUGEINT AS c FROM tf JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(cl)::HUGEINT AS nl FROM kept GROUP BY lang),
n AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM c GROUP BY ALL),
p AS MATERIALIZED (SELECT g.lang, g.source, kept.term, coalesce(c.c, 0) AS c, 1 + ({SCALE} * (coalesce(c.c, 0) + 1)) // (coalesce(n.n, 0) + v.v) AS p, 1 + ({SCALE} * (cl + 1)) // (nl + v.v) AS q
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.f, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE c > 0 AND p > q),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT * FROM k WHERE part = 'pair' OR rank <= {RANKS}"""
