"""Exact centroid clustering with Ptolemaic pivots.

Euclidean distance obeys Ptolemy's inequality: for pivots p and q

    d(x, c) * d(p, q)  >=  | d(x, p) * d(c, q) - d(x, q) * d(c, p) |

A vector's distances to a few fixed pivots are computed once and kept beside it.
In every round the inequality turns them into lower bounds on its distance to
each centroid, over fixed pairs of pivots. One centroid is measured exactly, and
another one only if its bound, rounded down by more than the arithmetic can be
off, does not exceed the best distance yet. Vectors and centroids are whole
numbers, so checked distances and sums are exact.

Each round is one pass over the written vectors; a task hands over sums per
cluster and component, never vectors. Nothing is grouped by vector, so equal ones
in any number are no hot key.

Defined results: vectors with another number of components, or with a null or
non-finite one, are not kept; components are cut to +-2^27 after scaling, so that
distances fit a long; fewer vectors than clusters give that many clusters; a null
id comes last among the starts; rows equal in id start in order of their
components; sums of distances beyond a long are null; no vectors, no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common

DIMENSIONS = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
SEED = "1"
#: Pivots, and the pairs of them that are farthest apart.
PIVOTS = 8
PAIRS = 12
#: Vectors that a worker looks at together.
VECTORS = 4096
LIMIT = 1 << 27
#: Far above the relative error of a bound's few roundings (each 2^-53).
SLACK = 2.0**-46


class Pivots(NamedTuple):
    """Pivot vectors, and (p, q, distance) of the pairs used."""

    points: np.ndarray
    pairs: list[tuple[int, int, float]]


def kept(column: str | Column, dimensions: int = DIMENSIONS) -> Column:
    """Whether a vector has all its components, each a finite number."""
    column = F.col(column) if isinstance(column, str) else column
    finite = F.forall(column, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce((F.size(column) == dimensions) & finite, F.lit(False))


def whole(column: str | Column, scale: int = SCALE) -> Column:
    """Components as whole numbers ``floor(scale * x)``."""
    most = F.lit(float(LIMIT))
    return F.transform(column, lambda x: F.floor(F.greatest(F.least(scale * x.cast("double"), most), -most)).cast("int"))


def starts(vectors: DataFrame, clusters: int = CLUSTERS, scale: int = SCALE, seed: str = SEED) -> np.ndarray:
    """The first centroids: ``clusters`` rows by the hash of their id; each task hands over that many at most."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(key.alias("key"), whole("embedding", scale).alias("point"))
    first = rows.orderBy(F.col("key").asc_nulls_last(), "point").limit(clusters).collect()
    return np.array([r.point for r in first], np.int64)


def squares(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-number points to one."""
    away = points - centre
    return np.einsum("ij,ij->i", away, away)


def choose_pivots(points: np.ndarray, pivots: int = PIVOTS, pairs: int = PAIRS) -> Pivots:
    """Pivots among ``points``, each the farthest from those before, and the widest pairs of them."""
    chosen = [0]
    nearest = squares(points, points[0])
    while len(chosen) < min(pivots, len(points)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, squares(points, points[chosen[-1]]))
    held = points[chosen]
    apart = [(p, q, float(np.sqrt(float(squares(held[p : p + 1], held[q])[0])))) for p, q in combinations(range(len(held)), 2)]
    return Pivots(held, sorted(apart, key=lambda pair: (-pair[2], pair[0], pair[1]))[:pairs])


def pivot_distances(points: np.ndarray, pivots: Pivots) -> np.ndarray:
    return np.sqrt(np.stack([squares(points, p).astype(np.float64) for p in pivots.points], axis=1))


def lower_bounds(near: np.ndarray, centre: np.ndarray, pivots: Pivots) -> np.ndarray:
    """Of points with pivot distances ``near``: no more than their squared distance to a centroid with ``centre``.

    Rounding can move a bound by a few times 2^-53 of the two products; ``SLACK``
    of them is taken off before the bound is used.
    """
    bound = np.zeros(len(near))
    for p, q, apart in pivots.pairs:
        one, other = near[:, p] * centre[q], near[:, q] * centre[p]
        np.maximum(bound, (np.abs(one - other) - SLACK * (one + other)) / apart, out=bound)
    return bound * bound * (1 - SLACK)


def nearest(points: np.ndarray, near: np.ndarray, centres: np.ndarray, pivots: Pivots) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of each point's nearest centroid (ties: the smaller number), and distances measured."""
    from_pivots = pivot_distances(centres, pivots)
    bounds = np.stack([lower_bounds(near, c, pivots) for c in from_pivots], axis=1)
    # The centroid of the least bound is measured first; it cuts off most others.
    cluster = bounds.argmin(axis=1)
    away = points - centres[cluster]
    best = np.einsum("ij,ij->i", away, away)
    first, measured = cluster.copy(), len(points)
    for number, centre in enumerate(centres):
        # Distances are below 2^62 and turn into doubles with an error under SLACK.
        open_ = np.flatnonzero((bounds[:, number] <= best.astype(np.float64) * (1 + SLACK)) & (first != number))
        measured += len(open_)
        found = squares(points[open_], centre)
        better = (found < best[open_]) | ((found == best[open_]) & (number < cluster[open_]))
        best[open_[better]], cluster[open_[better]] = found[better], number
    return cluster, best, measured


def gathered(batches: Iterator[pa.RecordBatch], rows: int = VECTORS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``rows`` (the last one may be shorter)."""
    held: list[pa.RecordBatch] = []
    for batch in common.batches(batches, rows):
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def matrix(batch: pa.RecordBatch, name: str, dtype: type) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    values = batch.column(batch.schema.get_field_index(name)).flatten()
    return values.to_numpy(zero_copy_only=False).astype(dtype).reshape(batch.num_rows, -1)


def with_pivots(vectors: DataFrame, pivots: Pivots, scale: int = SCALE) -> DataFrame:
    """vec_id, whole components and distances to the pivots of every kept vector."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            near = pivot_distances(matrix(batch, "point", np.int64), pivots)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(near.ravel()), near.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["vec_id", "point", "near"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole("embedding", scale).alias("point"))
    return rows.mapInArrow(measure, "vec_id long, point array<int>, near array<double>")


def assigned(rows: DataFrame, centres: np.ndarray, pivots: Pivots) -> DataFrame:
    """vec_id, cluster, distance: every vector's nearest centroid."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            cluster, best, _ = nearest(matrix(batch, "point", np.int64), matrix(batch, "near", np.float64), centres, pivots)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(best)], ["vec_id", "cluster", "distance"]
            )

    return rows.mapInArrow(assign, "vec_id long, cluster int, distance long")


def sums(rows: DataFrame, centres: np.ndarray, pivots: Pivots) -> DataFrame:
    """cluster, place, total, n: per task, sums of its vectors by nearest centroid and component."""
    clusters, dimensions = centres.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, n = np.zeros((clusters, dimensions), np.int64), np.zeros(clusters, np.int64)
        for batch in gathered(batches):
            points = matrix(batch, "point", np.int64)
            cluster, _, _ = nearest(points, matrix(batch, "near", np.float64), centres, pivots)
            own = (cluster == np.arange(clusters)[:, None]).astype(np.float64)
            # Sums of a batch stay below 2^53, where doubles are exact.
            totals += (own @ points).astype(np.int64)
            n += np.bincount(cluster, minlength=clusters)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.arange(clusters, dtype=np.int32), dimensions)),
                pa.array(np.tile(np.arange(dimensions, dtype=np.int32), clusters)),
                pa.array(totals.ravel()),
                pa.array(np.repeat(n, dimensions)),
            ],
            ["cluster", "place", "total", "n"],
        )

    return rows.select("point", "near").mapInArrow(add, "cluster int, place int, total long, n long")


def moved(rows: DataFrame, centres: np.ndarray, pivots: Pivots) -> np.ndarray:
    """Centroids after one round: floor of the mean of each cluster's vectors, empty ones as they were.

    The driver gets one row per cluster and component.
    """
    added = sums(rows, centres, pivots).groupBy("cluster", "place").agg(
        F.sum(F.col("total").cast("decimal(28,0)")).alias("total"), F.sum("n").alias("n")
    )
    after = centres.copy()
    for r in added.where("n > 0").collect():
        after[r.cluster, r.place] = int(r.total) // r.n
    return after


class Clustering(NamedTuple):
    """``rows`` (vec_id, cluster, distance), final centroids, and how they were measured."""

    rows: DataFrame
    centroids: np.ndarray
    pivots: Pivots


def cluster(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS,
    scale: int = SCALE, seed: str = SEED, pivots: int = PIVOTS, pairs: int = PAIRS,
) -> Clustering | None:
    """Cluster ``vectors`` (vec_id, embedding); None where no vector is kept."""
    good = vectors.where(kept("embedding", dimensions))
    centres = starts(good, clusters, scale, seed)
    if not len(centres):
        return None
    fixed = choose_pivots(centres, pivots, pairs)
    rows = common.stage(with_pivots(good, fixed, scale), "pivot-distances")
    for _ in range(rounds):
        centres = moved(rows, centres, fixed)
    return Clustering(common.stage(assigned(rows, centres, fixed), "clusters"), centres, fixed)


RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def clusters_of(vectors: DataFrame, **options: int | str) -> DataFrame:
    """Each kept vector with its cluster, distance, sums of distances, and the centroid's digest."""
    spark = vectors.sparkSession
    found = cluster(vectors, **options)
    if found is None:
        return spark.createDataFrame([], RESULT)
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in found.centroids]
    # One row per cluster.
    names = spark.createDataFrame(list(enumerate(digests)), "cluster int, centroid_sha256 string")
    own = found.rows.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    total = found.rows.agg(F.try_sum("distance")).head()[0]
    each = own.join(F.broadcast(names), "cluster").withColumn("inertia", F.lit(total).cast("long"))
    return found.rows.join(F.broadcast(each), "cluster").select(*[c.split()[0] for c in RESULT.split(", ")])


def query(spark: SparkSession, folder: str) -> DataFrame:
    return clusters_of(common.table(spark, folder, "embeddings"))


def _round(number: int) -> str:
    """Assignment to centroids ``c<number>`` as ``a<number>``."""
    return f"""
a{number} AS MATERIALIZED (
  SELECT id, vec_id, point, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance
  FROM (SELECT v.id, v.vec_id, v.point, c.cluster,
               CAST(list_sum(list_transform(list_zip(v.point, c.point), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS BIGINT) AS distance
        FROM v, c{number} c)
  GROUP BY ALL)"""


def _means(number: int) -> str:
    """Centroids ``c<number>`` from the assignment before."""
    return f"""
c{number} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.point, c.point) AS point
  FROM c{number - 1} c LEFT JOIN (
    SELECT cluster, list(value ORDER BY place) AS point
    FROM (SELECT cluster, place, CAST(sum(x) // count(*) - CASE WHEN sum(x) < 0 AND sum(x) % count(*) <> 0 THEN 1 ELSE 0 END AS BIGINT) AS value
          FROM (SELECT cluster, unnest(point) AS x, unnest(range(64)) AS place FROM a{number - 1}) GROUP BY ALL)
    GROUP BY cluster) m USING (cluster))"""


SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS point
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS INT) AS cluster, point
  FROM (SELECT * FROM v ORDER BY sha256('{SEED}:' || vec_id) LIMIT 16)),
{"".join(f"{_round(n)}, {_means(n + 1)}, " for n in range(3))}
{_round(3)}
SELECT vec_id, cluster, distance,
       CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c3.point, ',')) AS centroid_sha256
FROM a3 JOIN c3 USING (cluster)
"""
