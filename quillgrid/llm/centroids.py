"""Centroid clustering of integer vectors by bit planes and population counts.

Method: component x of a vector becomes the integer floor(256 * x).  Bit k of
its 64 components is one unsigned 64-bit word, its plane k; in two's complement
the last plane has a negative weight.  With planes A_i of a vector and C_j of a
centroid, their dot product is the sum of w_i * w_j * popcount(A_i & C_j), and
squared distances follow from it exactly.  Sums of members come from counts of
set bits a plane.  Planes are packed once, into a table of some 80 bytes a
vector that every round reads again; a round returns one row for each centroid,
component and 31-bit limb of a task's sums.

Defined cases: rows whose vector is null, has another number of components than
64, or has a component that is null, NaN or infinite are left out; a vector of
any finite size is counted exactly, with as many planes as it needs.  A distance
or inertia beyond 2^63 - 1 is null.  A null vec_id hashes as empty text.  Equal
hashes (repeated ids) go by the components, ascending; with fewer than k vectors
there are fewer centroids, without any the result is empty.  Of equal centroids
the one with the smallest number takes the vectors; one without vectors stays.
Repeated rows count as often as they occur, and other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, written

DIM = 64
#: Vectors that are worked on at a time.
ROWS = 4096
#: Up to so many bits a component, squared distances of 64 components fit 64 bits.
NARROW = 28
LIMB = 31
LARGEST = (1 << 63) - 1


def kept(embeddings: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v: array<double>) of the vectors that take part."""
    v = F.col(vec_col).cast("array<double>")
    # a comparison with infinity is false for NaN, which Spark orders above it
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return embeddings.select("vec_id", v.alias("v")).where((F.size("v") == DIM) & finite)


def integers(values: np.ndarray) -> np.ndarray:
    """floor(256 * x), as 64-bit integers where they fit, else as Python's."""
    whole = np.floor(values * 256.0)
    if np.isfinite(whole).all() and (not whole.size or np.abs(whole).max() < 2.0**62):
        return whole.astype(np.int64)
    exact = [int(x) * 256 if abs(x) >= 2.0**53 else int(y) for x, y in zip(values.ravel().tolist(), whole.ravel().tolist())]
    return np.array(exact, object).reshape(values.shape)


def width_of(numbers: np.ndarray) -> int:
    """Bits of two's complement that hold all the numbers."""
    if not numbers.size:
        return 1
    return max(int(x).bit_length() if x >= 0 else int(~x).bit_length() for x in (numbers.max(), numbers.min())) + 1


def pack(numbers: np.ndarray) -> np.ndarray:
    """(rows, planes) words of integers (rows, 64), the lowest plane first."""
    planes = [np.packbits((numbers >> k & 1).astype(np.uint8), axis=1, bitorder="little").view("<u8") for k in range(width_of(numbers))]
    return np.concatenate(planes, axis=1) if len(numbers) else np.zeros((0, 1), "<u8")


def weights(planes: int) -> list[int]:
    return [1 << k for k in range(planes - 1)] + [-(1 << (planes - 1))]


def dots(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Dot products of packed vectors (rows, planes) with packed ones (k, planes)."""
    wide = a.shape[1] + c.shape[1] > 2 * NARROW
    out = np.zeros((len(a), len(c)), object if wide else np.int64)
    for i, wi in enumerate(weights(a.shape[1])):
        for j, wj in enumerate(weights(c.shape[1])):
            n = np.bitwise_count(a[:, i, None] & c[None, :, j])
            out += n.astype(object) * (wi * wj) if wide else n.astype(np.int64) * (wi * wj)
    return out


def own_squares(a: np.ndarray) -> np.ndarray:
    """Each packed vector's dot product with itself."""
    w, p = weights(a.shape[1]), a.shape[1]
    wide = p > NARROW
    out = np.zeros(len(a), object if wide else np.int64)
    for i in range(p):
        for j in range(i, p):
            n = np.bitwise_count(a[:, i] & a[:, j])
            out += (n.astype(object) if wide else n.astype(np.int64)) * (w[i] * w[j] * (1 if i == j else 2))
    return out


def nearest(a: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each packed vector, and the squared distance."""
    d = own_squares(a)[:, None] - 2 * dots(a, c) + own_squares(c)[None, :]
    best = d.argmin(1) if d.dtype != object else np.array([min(range(len(c)), key=row.__getitem__) for row in d], np.int64)
    return best, d[np.arange(len(a)), best]


def member_sums(a: np.ndarray, best: np.ndarray, k: int) -> np.ndarray:
    """(k, 64) sums of members as Python integers, from counts of set bits."""
    bits = np.unpackbits(np.ascontiguousarray(a, "<u8").view(np.uint8), axis=1, bitorder="little").reshape(len(a), -1)
    member = np.zeros((k, len(a)), np.float32)
    member[best, np.arange(len(a))] = 1
    counts = (member @ bits.astype(np.float32)).astype(np.int64).reshape(k, a.shape[1], DIM).astype(object)
    return sum(counts[:, i] * w for i, w in enumerate(weights(a.shape[1])))


def unpacked(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of a column of packed planes and their words, by number of planes."""
    raw = column.to_pylist()
    size = np.array([len(x) for x in raw])
    return [(rows := np.flatnonzero(size == n), np.frombuffer(b"".join(raw[i] for i in rows), "<u8").reshape(len(rows), -1)) for n in np.unique(size)]


def packed(vectors: DataFrame) -> DataFrame:
    """(vec_id, planes) of (vec_id, v): the words of all planes of a slice."""

    def run(batches):
        for batch in batches:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM)
            words = pack(integers(v))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([x.tobytes() for x in words], pa.binary())], names=["vec_id", "planes"])

    return map_arrow(vectors, run, "vec_id bigint, planes binary", ROWS)


def first_centroids(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the smallest hashes, in their order, as Python integers."""
    key = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(key.alias("hash"), "v").orderBy("hash", "v").limit(k).collect()
    return integers(np.array([r["v"] for r in rows]).reshape(-1, DIM)).astype(object)


def moved(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of their members' means."""
    k, c = len(centroids), pack(centroids)

    def run(batches):
        total, n = np.zeros((k, DIM), object), np.zeros(k, np.int64)
        for batch in batches:
            for _, a in unpacked(batch.column("planes")):
                best, _ = nearest(a, c)
                total = total + member_sums(a, best, k)
                n += np.bincount(best, minlength=k)
        rows = []
        for i in np.flatnonzero(n).tolist():
            rows.append((i, -1, 0, int(n[i])))
            for j, x in enumerate(total[i].tolist()):
                limb = 0
                while not -(1 << LIMB) <= x < 1 << LIMB:
                    rows.append((i, j, limb, x & ((1 << LIMB) - 1)))
                    x, limb = x >> LIMB, limb + 1
                rows.append((i, j, limb, x))
        yield pa.RecordBatch.from_arrays([pa.array([r[m] for r in rows], t) for m, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["cluster", "j", "limb", "v"])

    sums = map_arrow(table.select("planes"), run, "cluster int, j int, limb int, v long", ROWS)
    # at most k * 65 rows for each limb of the largest sum
    new, count = np.zeros((k, DIM), object), [0] * k
    for r in sums.groupBy("cluster", "j", "limb").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():
        if r["j"] < 0:
            count[r["cluster"]] = int(r["v"])
        else:
            new[r["cluster"], r["j"]] += int(r["v"]) << LIMB * r["limb"]
    return np.array([[x // n for x in row] if n else old for row, n, old in zip(new.tolist(), count, centroids.tolist())], object).reshape(k, DIM)


def assigned(table: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every packed vector."""
    c = pack(centroids)

    def run(batches):
        for batch in batches:
            cluster, distance = np.zeros(batch.num_rows, np.int32), [0] * batch.num_rows
            for rows, a in unpacked(batch.column("planes")):
                best, d = nearest(a, c)
                cluster[rows] = best
                for i, x in zip(rows.tolist(), d.tolist()):
                    distance[i] = x if x <= LARGEST else None
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    return map_arrow(table, run, "vec_id bigint, cluster int, distance bigint", ROWS)


def clusters(embeddings: DataFrame, k: int = 40, rounds: int = 5, salt: str = "2:", vec_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of
    every vector that takes part."""
    vectors = kept(embeddings, vec_col)
    centroids = first_centroids(vectors, k, salt)
    spark = embeddings.sparkSession
    if not len(centroids):
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    table = written(packed(vectors), "planes")
    for _ in range(rounds):
        centroids = moved(table, centroids)
    told = written(assigned(table, centroids), "assigned")
    # k rows at most; a sum that lacks a distance too large is unknown
    exact = F.when(F.count("*") == F.count("distance"), F.sum(F.col("distance").cast("decimal(38,0)")))
    sums = {r["cluster"]: r["s"] for r in told.groupBy("cluster").agg(exact.alias("s")).collect()}
    fits = lambda x: None if x is None or x > LARGEST else int(x)
    total = None if None in sums.values() else sum(sums.values())
    rows = [(i, fits(s), fits(total), hashlib.sha256(",".join(map(str, centroids[i].tolist())).encode()).hexdigest()) for i, s in sums.items()]
    said = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return told.join(F.broadcast(said), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 40, rounds: int = 5, salt: str = "2:") -> str:
    """The same in SQL, round by round, on the components."""
    sql = f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS cluster, v AS c FROM (SELECT sha256('{salt}' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM kept ORDER BY h, v LIMIT {k}))"""
    near = "SELECT i, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (SELECT i, cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, c{r}) GROUP BY i"
    for r in range(rounds):
        sql += f""",
a{r} AS MATERIALIZED ({near.format(r=r)}),
s{r} AS (SELECT cluster, j, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range(1, {DIM + 1})) AS j FROM a{r} JOIN kept USING (i)) GROUP BY cluster, j),
m{r} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c FROM s{r} GROUP BY cluster),
c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (cluster))"""
    return f"""{sql},
e AS MATERIALIZED ({near.format(r=rounds)})
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM e JOIN kept USING (i) JOIN c{rounds} USING (cluster)"""
