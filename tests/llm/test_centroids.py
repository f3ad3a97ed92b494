"""Clustering against plain rounds; bounds never above the true distance."""

import hashlib
import math

import numpy as np
import pytest
from llm import centroids

COLUMNS = "vec_id long, embedding array<float>, point string, near string, cluster string, key string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, *["mark"] * 4) for i, v in rows], COLUMNS)


def plain(rows, clusters=16, rounds=3, size=64):
    kept = [
        (i, [min(max(math.floor(min(max(64 * x, -(2.0**40)), 2.0**40)), -(1 << 27)), 1 << 27) for x in np.array(v, np.float32).astype(float).tolist()])
        for i, v in rows
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)
    ]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:clusters]
    centres = [v for _, v in first]

    def measure(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        own = [measure(v)[1] for _, v in kept]
        for n in range(len(centres)):
            members = [v for (_, v), c in zip(kept, own, strict=True) if c == n]
            if members:
                centres[n] = [sum(column) // len(members) for column in zip(*members, strict=True)]
    last = [measure(v) for _, v in kept]
    inertia = {n: sum(d for d, c in last if c == n) for n in range(len(centres))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, c, d, inertia[c], sum(inertia.values()), digest[c]) for (i, _), (d, c) in zip(kept, last, strict=True)]


def same(got, want):
    def order(rows):
        return sorted(map(tuple, rows), key=repr)

    return order(got) == order(want)


def blobs(n, seed=3, groups=6, size=64, spread=0.05):
    draw = np.random.default_rng(seed)
    middles = draw.normal(size=(groups, size))
    return [(k, (middles[k % groups] + spread * draw.normal(size=size)).astype(np.float32).tolist()) for k in range(n)]


def test_blobs_with_odd_rows(spark):
    """Repeated vectors and ids, ties, and vectors that are not kept."""
    rows = blobs(300)
    rows += [(1000 + k, rows[0][1]) for k in range(200)] + [(7, rows[9][1]), (7, rows[9][1]), (None, rows[3][1])]
    odd = list(rows[1][1])
    odd[5] = float("nan")
    rows += [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [1.0] * 65), (2004, odd), (2005, [None] + [0.5] * 63), (2006, [float("inf")] * 64)]
    rows += [(2007, [0.0] * 64), (2008, [-0.0] * 64), (2009, [-0.001] * 64)]
    assert same(centroids.clusters_of(frame(spark, rows).repartition(5)).collect(), plain(rows))


def test_few_empty_and_huge(spark):
    few = blobs(5)
    assert same(centroids.clusters_of(frame(spark, few)).collect(), plain(few))
    assert same(centroids.clusters_of(frame(spark, [(1, [0.5] * 64)] * 40)).collect(), plain([(1, [0.5] * 64)] * 40))
    for none in ([], [(1, None), (2, [1.0])]):
        out = centroids.clusters_of(frame(spark, none))
        assert out.collect() == [] and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    huge = [(k, [1e30 if k % 2 else -1e30] * 63 + [float(k)]) for k in range(30)]
    got = centroids.clusters_of(frame(spark, huge)).collect()
    assert [(r.vec_id, r.cluster, r.distance) for r in sorted(got)] == [w[:3] for w in sorted(plain(huge))]


def test_other_sizes(spark):
    rows = blobs(120, size=8)
    got = centroids.clusters_of(frame(spark, rows), clusters=5, rounds=2, dimensions=8, pivots=3, pairs=2).collect()
    assert same(got, plain(rows, clusters=5, rounds=2, size=8))


@pytest.mark.parametrize("spread", [0.01, 1.0, 1000.0])
def test_bounds_stay_below(spread):
    draw = np.random.default_rng(5)
    points = np.floor(64 * spread * draw.normal(size=(400, 64))).astype(np.int64)
    points[:50] = points[0] + draw.integers(-1, 2, (50, 64))
    centres = np.concatenate([points[:8], points[50:58]])
    pivots = centroids.choose_pivots(centres)
    near, centre_near = centroids.pivot_distances(points, pivots), centroids.pivot_distances(centres, pivots)
    for c, of in zip(centres, centre_near, strict=True):
        assert (centroids.lower_bounds(near, of, pivots) <= centroids.squares(points, c)).all()


def test_bounds_spare_distances():
    """On vectors in groups most distances are never measured."""
    points = np.floor(64 * np.array([v for _, v in blobs(2000, groups=16)])).astype(np.int64)
    centres = points[:16]
    pivots = centroids.choose_pivots(centres)
    cluster, best, measured = centroids.nearest(points, centroids.pivot_distances(points, pivots), centres, pivots)
    full = np.stack([centroids.squares(points, c) for c in centres], axis=1)
    assert (cluster == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all()
    assert measured < 0.5 * full.size
