"""SimHash near-duplicates with anchor-point covering.

Fingerprint: XXH64 of every word shingle (ASCII lower case, ASCII white space);
a bit is set if it is set in more than half of the hashes.

Method: anchors are the words of a covering code.  A code is a product over
blocks of bits: two blocks of 23 bits carry the perfect binary Golay code
(covering radius 3), a third of 15 bits, which is used for more than
``TWO_BLOCKS`` fingerprints, the perfect Hamming code (radius 1).  The other bits
are left free.  A fingerprint has one home anchor (each block within its radius)
and is replicated to every anchor within covering radius plus threshold.  Since
a difference of t bits is shared out between the blocks, that is every anchor
whose distances exceed the radii by t bits together: for t = 2, 61 anchors a
fingerprint of 2^24 with two blocks, about 153 of 2^35 with three, whatever the
data.  Two fingerprints within t bits meet at the home anchor of either; they are
compared there.

Hot anchors: where more than ``HOT`` distinct fingerprints are at home, the
anchor is split by a second code, the same one over the bits in another order
(``ORDERS``), in which the bits that were free stand first: its fingerprints meet
at pairs of anchors, one of each code, and what is still hot is split by the third
order.  A pair within t bits meets at every level for the same reason, so nothing
is capped or dropped; at the last level all of an anchor's fingerprints are
compared, by a join that Spark may deal out.

Equal fingerprints are merged before the search.

``near_duplicates_removed`` (the pipeline's stage) goes by the same fingerprints of
whole texts, anchors and links: documents of one component are candidates, and an
exact check on five-word shingles, at a Jaccard similarity of 0.8, decides.  Pairs
at that similarity may differ in 4 to 18 bits, where covering codes would replicate
to everything.  For those, which are beyond the links, it takes several more SimHash
fingerprints a document, each of a few shingles sampled by least permuted hash: of
equal samples, fingerprints are equal.  Those that share one are candidates, too.
Sets of up to seven shingles meet exactly, by their subsets of one shingle less.

Defined cases: null text is the empty text; a text without words has
fingerprint zero and links like any other; rows with the same doc_id are the
same document; null ids get the component of their fingerprint; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, hot_join, lasting, map_arrow, temporary, written
from ..operators.graph import components

#: Generator polynomials (fixed values) of the binary Golay code and the Hamming code.
GOLAY = 0b110001110101
HAMMING = 0b10011
#: (bits, generator, covering radius) of the blocks of a code.
BLOCKS = ((23, GOLAY, 3), (23, GOLAY, 3), (15, HAMMING, 1))
#: Up to so many distinct fingerprints, 16 a home anchor, two blocks are enough.
TWO_BLOCKS = 1 << 28
#: Bits to which a fingerprint is turned before each level's code.
ORDERS = (0, 46, 23)
HOT = 64
#: Differing bits at which two fingerprints are linked.
BITS = 2
#: Words of a shingle of the fingerprints of whole texts.
WORDS = 3
SEED = 42


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle of the whole text, repeats included; fewer words
    make one shingle, no word none."""
    import xxhash

    h = xxhash.xxh64_intdigest
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([h(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = [0, *(ends[:-words] + 1).tolist()]
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash."""
    if not hashes.size:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, hashes.size, 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > hashes.size).tobytes(), "big", signed=True)


def fingerprints(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp) of every whole text."""

    def run(batches):
        for b in batches:
            fps = [fingerprint(shingle_hashes(t.as_py(), words)) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return map_arrow(documents.select("doc_id", "text"), run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, fp long")


@lru_cache(maxsize=2)
def _code(bits: int, generator: int, radius: int) -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """Syndrome of each word of a perfect cyclic code; for each syndrome, the
    error patterns whose weight exceeds the covering radius by exactly 0 to ``BITS``."""
    check = generator.bit_length() - 1
    basis = []
    for i in range(bits):
        x = 1 << i
        for k in range(bits - 1, check - 1, -1):
            if x >> k & 1:
                x ^= generator << (k - check)
        basis.append(x)
    syndrome = np.zeros(1 << bits, np.uint16)
    for i, x in enumerate(basis):
        syndrome[1 << i : 2 << i] = syndrome[: 1 << i] ^ x
    found: list[list[list[int]]] = [[[] for _ in range(BITS + 1)] for _ in range(1 << check)]
    for weight in range(radius + BITS + 1):
        for places in combinations(range(bits), weight):
            e = sum(1 << b for b in places)
            found[syndrome[e]][max(0, weight - radius)].append(e)
    return syndrome, [[np.array(x, np.int64) for x in own] for own in found]


def turned(fp: int, by: int) -> int:
    """The 64 bits of a fingerprint, turned."""
    fp &= (1 << 64) - 1
    return (fp >> by | fp << (64 - by)) & (1 << 64) - 1


def anchors(fp: int, bits: int, blocks: int = 2, order: int = 0) -> np.ndarray:
    """Anchors within covering radius plus ``bits`` of a fingerprint, home first."""
    word, at = turned(fp, order), 0
    out = [np.zeros(1, np.int64)] + [np.zeros(0, np.int64)] * bits  # by how much they exceed the radii
    for size, generator, radius in BLOCKS[:blocks]:
        syndrome, errors = _code(size, generator, radius)
        own = word >> at & (1 << size) - 1
        near = [(e ^ own) << at for e in errors[syndrome[own]][: bits + 1]]
        out = [np.concatenate([(out[i][:, None] | near[k - i]).ravel() for i in range(k + 1)]) for k in range(bits + 1)]
        at += size
    return np.concatenate(out)


def _at_anchors(fps: DataFrame, level: int, bits: int, blocks: int) -> DataFrame:
    """``fps`` (fp and the anchors a0, a1, ... of the levels before) with the
    anchors of a level that are in reach; for 0 bits the home anchor alone."""
    names = [*(f"a{i}" for i in range(level)), "fp"]

    def run(batches):
        for b in batches:
            each = [anchors(int(x), bits, blocks, ORDERS[level]) for x in b.column("fp").to_numpy(zero_copy_only=False)]
            n = [len(x) for x in each]
            yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(b.column(c).to_numpy(zero_copy_only=False), n)) for c in names), pa.array(np.concatenate(each))], names=[*names, f"a{level}"])

    return map_arrow(fps.select(*names), run, ", ".join(f"{c} long" for c in (*names, f"a{level}")), 4096)


def links(fps: DataFrame) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``fp`` that differ in at most
    ``BITS`` bits: all of them."""
    blocks = 2 if fps.count() <= TWO_BLOCKS else 3
    home, near, edges = fps.select("fp"), fps.select("fp"), None
    for level in range(len(ORDERS)):
        at = [f"a{i}" for i in range(level + 1)]
        home, near = _at_anchors(home, level, 0, blocks), _at_anchors(near, level, BITS, blocks)
        hot, any_hot = None, False
        if level + 1 < len(ORDERS):
            hot = written(home.groupBy(*at).count().where(F.col("count") > HOT).select(*at), "hot-anchors")
            any_hot = not hot.isEmpty()
        calm = home.join(hot, at, "left_anti") if any_hot else home
        # the home anchor of the smaller fingerprint of a pair is enough; Spark does not know that each row of near
        # is one of many, and would broadcast them
        met = calm.withColumnRenamed("fp", "u").join(near.withColumnRenamed("fp", "v").hint("merge"), at).where(f"u < v AND bit_count(u ^ v) <= {BITS}").select("u", "v")
        edges = met if edges is None else edges.unionByName(met)
        if not any_hot:
            break
        home, near = written(home.join(hot, at, "left_semi"), "hot-home"), written(near.join(hot, at, "left_semi"), "hot-near")
    return edges


def _rooted(nodes: DataFrame) -> DataFrame:
    """``nodes``, a written table of one row per fingerprint fp, with root, the least
    one reachable over links."""
    roots = components(links(nodes.select("fp")))
    return nodes.join(roots.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_groups(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id
    reachable over links of at most ``BITS`` differing bits) of every document."""
    fps = written(fingerprints(documents, words), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "nodes")
    rooted = _rooted(nodes)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(rooted.select("fp", "root", "copies").join(least, "root").select("fp", "copies", "component_id"), "named")
    return hot_join(fps, named, "fp", F.col("doc_id")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: A pair at similarity q shares none of its fingerprints with probability
#: (1 - q**SAMPLE)**TABLES: 3e-8 at 0.8.
TABLES = 24
SAMPLE = 3
#: Fingerprints under which documents are compared first; under the others, those
#: that are then joined need no comparison.
FIRST = 4
NEIGHBOURS = 4
#: Members and shingles of a block, and shingles of a step, in whole comparisons of a bucket.
BLOCK_ROWS = 1024
BLOCK_SHINGLES = 1 << 19
BLOCK_COLUMNS = 4096


@lru_cache(maxsize=1)
def _odd() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 2**63, TABLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _row():
    """A hash of the text: rows that share a doc_id are told apart by it."""
    return F.xxhash64("text")


def _sketches(documents: DataFrame, words: int) -> DataFrame:
    """doc_id; row, a hash of the text; node, a hash of the words; fp, the fingerprint of the whole text; keys, for
    each table the SimHash of the sampled shingles and the next least hash; shingles, the distinct shingles as
    32-bit hashes."""

    def run(batches):
        import xxhash

        for b in batches:
            node, fps, keys, sets = [], [], [], []
            for value in b.column("text"):
                text = value.as_py() or ""
                node.append(xxhash.xxh3_64_intdigest(b" ".join(text.encode("utf-8", "surrogatepass").lower().split()), SEED) - (1 << 63))
                fps.append(fingerprint(shingle_hashes(text, WORDS)))
                h = np.unique(shingle_hashes(text, words))
                own = []
                for k, odd in enumerate(_odd()):
                    order = h * odd
                    order ^= order >> np.uint64(29)
                    if h.size > SAMPLE + 1:
                        least = np.argpartition(order, SAMPLE + 1)[: SAMPLE + 1]
                        least = least[np.argsort(order[least])]
                    else:
                        least = np.argsort(order)
                    tail = int(order[least[SAMPLE]] >> np.uint64(1)) if least.size > SAMPLE else -1
                    own.append({"place": k, "key": fingerprint(h[least[:SAMPLE]]), "tail": tail})
                keys.append(own)
                sets.append(np.unique((h >> np.uint64(32)).astype(np.uint32).view(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    b.column("row"),
                    pa.array(node, pa.int64()),
                    pa.array(fps, pa.int64()),
                    pa.array(keys, pa.list_(pa.struct([("place", pa.int32()), ("key", pa.int64()), ("tail", pa.int64())]))),
                    pa.array(sets, pa.list_(pa.int32())),
                ],
                names=["doc_id", "row", "node", "fp", "keys", "shingles"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_arrow(documents.select("doc_id", "text", _row().alias("row")), run, f"doc_id {kind}, row long, node long, fp long, keys array<struct<place:int,key:long,tail:long>>, shingles array<int>")


def _linked_buckets(sketch: DataFrame) -> DataFrame:
    """(node, at, tail): the nodes of ``sketch``, those of each component of linked
    fingerprints in a bucket; place -1 tells these from the buckets of samples."""
    prints = written(sketch.select("node", "fp").distinct(), "prints")
    rooted = _rooted(written(prints.groupBy("fp").agg(F.count("*").alias("copies")), "fingerprints"))
    # texts of equal fingerprints stand next to each other
    return hot_join(prints, written(rooted, "components"), "fp", F.col("node")).select("node", F.struct(F.lit(-1).alias("place"), F.col("root").alias("key")).alias("at"), F.col("fp").alias("tail"))


def _linked_roots(similarity: float):
    """For applyInPandas on a pair of blocks of a bucket, the members whose own
    block is i against those of j: the links (u, v) that join their components
    (``root``), at most one per component."""

    def run(rows):
        import pandas as pd

        i, j, own = rows["i"].iloc[0], rows["j"].iloc[0], rows["own"].to_numpy()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        sets, root = rows["shingles"].tolist(), rows["root"].to_numpy()
        sizes = np.array([len(x) for x in sets], np.int64)
        member = np.repeat(np.arange(len(sets)), sizes)
        values, column, seen = np.unique(np.concatenate([*sets, np.zeros(0, np.int32)]), return_inverse=True, return_counts=True)
        shared = seen > 1  # a shingle of one member alone is common to none
        member, column = member[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
        common = np.zeros((left.size, right.size), np.float32)
        for lo in range(0, int(shared.sum()), BLOCK_COLUMNS):
            part = (column >= lo) & (column < lo + BLOCK_COLUMNS)
            has = np.zeros((len(sets), BLOCK_COLUMNS), np.float32)
            has[member[part], column[part] - lo] = 1
            common += has[left] @ has[right].T
        most = sizes[left][:, None] + sizes[right] - common
        a, b = np.nonzero((common > 0) & (common >= similarity * most - 1e-6))
        # least root over all links, until nothing changes
        roots, code = np.unique(root, return_inverse=True)
        a, b = code[left[a]], code[right[b]]
        label = np.arange(roots.size)
        while True:
            lower = label.copy()
            np.minimum.at(lower, a, label[b])
            np.minimum.at(lower, b, label[a])
            lower = lower[lower]
            if (lower == label).all():
                break
            label = lower
        moved = np.flatnonzero(label != np.arange(roots.size))
        return pd.DataFrame({"u": roots[moved], "v": roots[label[moved]]})

    return run


def _links_of_the_rest(at: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links between components that still share a bucket: there, every pair of
    members of different components that can reach ``similarity`` by size is compared.

    Only buckets with members of several components count.  A member goes to the
    band of its size, its home, and to the next lower one, so that sizes which allow
    the similarity meet; a band without a home has only pairs that meet in another.
    In a band, the members of the largest component are dealt to blocks apart from
    the others; each block of others is compared with every block, so a large group
    of copies costs its size for each block of others and not its square.  A pair
    of blocks is one group.  No pairs are made as rows.
    """
    rooted = at.select("at", "node").join(roots.withColumnRenamed("v", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    # up to so many members, the neighbours have been all
    crowded = rooted.groupBy("at").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("copies"))
    still = crowded.where(f"low < high AND copies > {NEIGHBOURS + 1}").select("at", "copies")
    sized = hot_join(rooted, still, "at", F.col("node")).join(sets.select("node", F.size("shingles").alias("size")), "node")
    home = F.floor(F.log("size") / F.log(F.lit(1 / similarity)) + F.lit(1e-9)).cast("int")
    banded = sized.where("size > 0").withColumn("home", home).withColumn("band", F.explode(F.array("home", F.col("home") - 1)))
    banded = banded.select(F.struct("at", "band").alias("at"), (F.col("home") == F.col("band")).alias("home"), "node", "root")
    banded = written(banded, "bands")
    by_root = banded.groupBy("at", "root").agg(
        F.count("*").alias("n"), F.count_if("home").alias("homes"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("same")
    )
    groups = by_root.groupBy("at").agg(
        F.count("*").alias("roots"), F.sum("homes").alias("homes"), F.sum("n").alias("n"), F.sum("same").alias("same"), F.max(F.struct("n", "root")).alias("top")
    )
    # the same members under several keys are compared once
    once = groups.where("roots > 1 AND homes > 0").groupBy("same", "n").agg(F.min(F.struct("at", "top")).alias("k")).select("k.*", "n")
    rows = F.greatest(F.lit(1), F.least(F.lit(BLOCK_ROWS), F.floor(BLOCK_SHINGLES * F.pow(F.lit(similarity), F.col("at.band") + 2))))
    once = once.select("at", F.col("top.root").alias("top"), F.ceil((F.col("n") - F.col("top.n")) / rows).alias("others"), F.ceil(F.col("top.n") / rows).alias("tops"), F.col("n").alias("copies"))
    dealt = hot_join(banded, once, "at", F.col("node")).withColumn("is_top", F.expr("root = top"))
    dealt = dealt.withColumn("own", F.expr("if(is_top, others + pmod(xxhash64(node), tops), pmod(xxhash64(node), others))"))
    dealt = dealt.withColumn("other", F.expr("explode(sequence(0L, if(is_top, others, others + tops) - 1))"))
    dealt = dealt.select("at", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root")
    return dealt.join(sets, "node").groupBy("at", "i", "j").applyInPandas(_linked_roots(similarity), "u long, v long").distinct()


def _short_pairs(sketch: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v) of nodes whose sets differ by one shingle that only one of
    them has.  For sets so small that two differences are below ``similarity``
    these are all pairs but for equal sets, which share every fingerprint.

    A set meets the one that it is without one of its shingles: at most one
    pair a shingle, however many sets have it in common.
    """
    most = math.ceil(round(2 * similarity / (1 - similarity), 9)) - 1 if similarity < 1 else 0
    sets = sketch.where(F.size("shingles").between(1, most + 1)).select("node", "shingles").distinct()
    whole = sets.groupBy(F.xxhash64("shingles").alias("set")).agg(F.min("node").alias("u"))
    less = sets.select(F.col("node").alias("v"), F.explode(F.expr("transform(shingles, x -> xxhash64(filter(shingles, y -> y <> x)))")).alias("set"))
    return less.join(whole, "set").where("u <> v").select("u", "v")


def _candidates(at: DataFrame) -> DataFrame:
    """Pairs (u, v) of members of a bucket that are in different components
    (``root``): each with the least member and the next ``NEIGHBOURS``.

    Buckets within one component give none.
    """
    me = F.struct("node", "root")
    least = at.groupBy("at").agg(F.min(me).alias("n0"), F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), F.count("*").alias("copies")).where("low < high")
    # neighbours in the order of the next least hash; large buckets are salted
    salted = hot_join(at, least, "at", F.col("node")).withColumn("salt", F.expr(f"pmod(xxhash64(node), ceil(n / {BLOCK_ROWS}))"))
    bucket = "PARTITION BY at, salt ORDER BY tail, node"
    near = salted.select(me.alias("a"), "n0", *(F.expr(f"lead(struct(node, root), {i}) OVER ({bucket})").alias(f"n{i}") for i in range(1, NEIGHBOURS + 1)))
    met = F.array(*(f"n{i}" for i in range(NEIGHBOURS + 1)))
    pairs = near.select("a", F.explode(F.filter(met, lambda b: b.root != F.col("a.root"))).alias("b"))
    return pairs.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose whole shingle sets reach ``similarity``."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("x")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("y")), "v")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= F.lit(similarity) * (F.size("x") + F.size("y") - common) - F.lit(1e-6)).select("u", "v")


def similar_groups(documents: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, row, copies, keeper, keeper_row) of every doc_id and text: row is
    a hash of the text, copies how many rows have both, and keeper and keeper_row
    are those of the smallest (doc_id, row) of its group of near-duplicates by
    shingle-set similarity; null ids come last.

    Documents whose whole texts' fingerprints are linked share a bucket
    (``_linked_buckets``), and so do those that share a fingerprint of a sample.
    First each is compared with the least one and a few neighbours of its bucket,
    which joins almost all that belong together: in the bucket of its links and under
    the first ``FIRST`` samples all, then under the others those that are not joined yet.  Then buckets which still hold
    several components are compared whole (``_links_of_the_rest``), so no pair of
    a bucket is left out.  Pairs of the smallest sets, which have few samples, are
    found exactly (``_short_pairs``).
    """
    sketch = written(_sketches(documents, words), "sketches")
    sampled = sketch.select("node", F.explode("keys").alias("k")).select("node", F.struct("k.place", "k.key").alias("at"), "k.tail").distinct()
    all_at = written(_linked_buckets(sketch).unionByName(sampled), "buckets")
    shared = all_at.groupBy("at").agg(F.count("*").alias("copies")).where("copies > 1")
    at = written(hot_join(all_at, shared, "at", F.col("node")), "shared-buckets")
    dropped(all_at)
    short = written(_short_pairs(sketch, similarity), "short-pairs")
    compared = at.select("node").unionByName(short.select(F.explode(F.array("u", "v")).alias("node"))).distinct()
    # copies are merged before the join, so that none of them is a hot key
    sets = sketch.groupBy("node").agg(F.min_by("shingles", "row").alias("shingles")).join(compared, "node", "left_semi")
    sets = written(sets.where("shingles IS NOT NULL"), "shingle-sets")
    first = _candidates(at.where(f"at.place < {FIRST}").withColumn("root", F.col("node")))
    known = first.unionByName(short.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))).distinct()
    linked = written(_alike(written(known, "first-candidates"), sets, similarity), "first-links")
    roots = written(components(linked), "first-roots").withColumnRenamed("v", "node")
    later = at.where(f"at.place >= {FIRST}").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    linked = linked.unionByName(_alike(written(_candidates(later), "candidates"), sets, similarity))
    roots = written(components(linked), "roots")
    rest = written(_links_of_the_rest(at, roots, sets, similarity), "rest")
    ids = written(sketch.groupBy("doc_id", "row", "node").agg(F.count("*").alias("rows")), "rows")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row"))
    nodes = ids.groupBy("node").agg(least.alias("least"), F.count("*").alias("copies")).join(roots.withColumnRenamed("v", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    if not rest.isEmpty():
        joined = components(rest).select(F.col("v").alias("root"), F.col("root").alias("top"))
        nodes = nodes.join(joined, "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top")
    nodes = written(nodes, "rooted")
    first_of = nodes.groupBy("root").agg(F.min("least").alias("keeper"), F.count("*").alias("copies"))
    known = hot_join(nodes.select("node", "root", F.col("copies").alias("n")), first_of, "root", F.col("node")).select("node", "keeper", F.col("n").alias("copies"))
    told = hot_join(ids, written(known, "keepers"), "node", F.xxhash64("doc_id", "row"))
    return told.select("doc_id", "row", F.col("rows").alias("copies"), F.col("keeper.doc_id").alias("keeper"), F.col("keeper.row").alias("keeper_row"))


def near_duplicates_removed(documents: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``documents`` with one row of each group of near-duplicates, that of the
    smallest id (then hash of the text; null ids come last).

    Rows are told apart by id and text, so a text of its own stays although
    another row with its id goes; of rows that repeat both, one stays.
    """
    with temporary(documents.sparkSession):
        told = similar_groups(documents, words, similarity)
        keeps = F.col("doc_id").eqNullSafe(F.col("keeper")) & (F.col("row") == F.col("keeper_row"))
        told = told.select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), keeps.alias("__keeps"), "copies").where("NOT __keeps OR copies > 1").drop("copies")
        told = lasting(written(told, "decisions"))
    rows = documents.withColumn("__row_of", _row())
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__row_of") == F.col("__row"))
    out = rows.join(told, same, "left_anti")
    repeated = told.where("__keeps")
    if not repeated.isEmpty():
        out = out.unionByName(rows.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "__row_of"]))
    return out.select(*documents.columns)
