"""Centroid clustering against exact integers in plain loops, on odd and empty tables."""

import hashlib
import math
import random

import numpy as np
import pytest

from quillgrid.llm import centroids

KIND = "vec_id long, embedding array<double>, label int, cluster int, distance long, planes binary"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, b"x") for i, v in rows], KIND)


def brute_force(rows, k, rounds):
    kept = [(i, [math.floor(256 * x) if abs(x) < 2**45 else int(x) * 256 for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    c = [v for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min(((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c)))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            own = [v for (_, v), a in zip(kept, at) if a == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own)]
    told = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = {j: sum(d for _, a, d in told if a == j) for j in {a for _, a, _ in told}}
    fits = lambda x: x if x < 2**63 else None
    whole = None if any(d >= 2**63 for _, _, d in told) else fits(sum(inertia.values()))
    part = lambda j: None if any(d >= 2**63 for _, a, d in told if a == j) else fits(inertia[j])
    return sorted(((i, j, fits(d), part(j), whole, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in told), key=repr)


def got(df):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect()), key=repr)


def vectors(seed, n, scale=0.3):
    rnd = random.Random(seed)
    return [(i, [rnd.gauss(rnd.choice([-1, 0, 1]) * scale, scale) for _ in range(64)]) for i in range(n)]


ODD = [(900, None), (901, []), (902, [0.5] * 63), (903, [0.5] * 65), (904, [0.5] * 63 + [None]), (905, [0.5] * 63 + [math.nan]), (906, [math.inf] + [0.5] * 63), (None, [0.25] * 64), (3, [-0.1] * 64), (3, [-0.1] * 64), (3, [0.0] * 64)]


@pytest.mark.parametrize(("k", "rounds"), [(40, 5), (3, 2), (1, 1), (7, 0)])
def test_against_plain_loops(spark, k, rounds):
    rows = vectors(1, 150) + ODD
    assert got(centroids.clusters(frame(spark, rows).repartition(5), k, rounds)) == brute_force(rows, k, rounds)


def test_fewer_vectors_than_centroids_and_equal_ones(spark):
    rows = vectors(2, 5) + [(i, [0.5] * 64) for i in range(20, 26)]
    assert got(centroids.clusters(frame(spark, rows))) == brute_force(rows, 40, 5)


@pytest.mark.parametrize("scale", [1e3, 1e5, 1e9, 1e17, 1e30])
def test_any_finite_size_is_exact(spark, scale):
    rows = vectors(3, 30) + [(100 + i, v) for i, v in vectors(4, 30, scale)]
    assert got(centroids.clusters(frame(spark, rows).repartition(3), 6, 2)) == brute_force(rows, 6, 2)


def test_no_vectors(spark):
    assert centroids.clusters(frame(spark, ODD).limit(0)).count() == 0
    assert centroids.clusters(frame(spark, ODD[:7])).count() == 0


def test_bit_planes_give_exact_products():
    rng = np.random.default_rng(5)
    for low, high in ((-1, 1), (-200, 150), (0, 1 << 26), (-(1 << 26), 5)):
        a, c = rng.integers(low, high, (9, 64)), rng.integers(-300, 300, (4, 64))
        pa, pc = centroids.pack(a), centroids.pack(c)
        assert (centroids.dots(pa, pc) == a @ c.T).all()
        assert (centroids.own_squares(pa) == (a * a).sum(1)).all()
        best = np.array([0, 1, 2, 3, 0, 1, 2, 3, 0])
        assert (centroids.member_sums(pa, best, 4).astype(np.int64) == np.stack([a[best == j].sum(0) for j in range(4)])).all()
