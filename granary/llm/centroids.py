"""Centroid clustering whose assignments come from the threshold algorithm.

For every dimension the centroids' values are a sorted list. A vector enters each list at its own value and walks outward, the nearer end first; a step
in all lists names the centroids met there, whose exact distances are worked out once each. A centroid not met yet lies in every dimension at least as far as the
last step there, so the sum of the squared last steps (the frontier) is a lower bound of its distance: a vector is done when the frontier strictly exceeds its best
exact distance (equal distances go to the smaller centroid number, so an equal frontier is not enough), or when all centroids were met.

Each round is one job over a table of integer vectors: every task assigns its rows, sums them up by centroid, and Spark adds the sums of the tasks. The
driver sees k * dims numbers a round. Lists and centroids have k * dims numbers, a parameter; nothing else is sent to executors.

Defined results: vectors that are null, hold null or non-finite components, or have another number of components take no part; repeated rows count each;
equal seed hashes (repeated ids) go by components; rows without vec_id come last among the seeds and are clustered like others; with fewer than k vectors there are as many centroids; an
empty table gives an empty result. Integers beyond 64 bits, distances and sums too, count as the nearest integer of 64 bits. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import batch_of, materialize
from granary.llm.integer_vectors import clipped, integer_vectors, largest, matrix

K, ROUNDS, DIMS, SCALE, SALT = 8, 10, 64, 1024, "3:"
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
BIG = 2**63 - 1


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of x the number of the nearest centroid and the squared distance; and how many distances were worked out."""
    n, (k, dims) = len(x), centroids.shape
    if (2 * max(largest(x), largest(centroids))) ** 2 * dims > BIG:  # squares do not fit 64 bits: Python's integers
        x, centroids = x.astype(object), centroids.astype(object)
    beyond = BIG if x.dtype != object else 1 << 160
    order = np.argsort(centroids, axis=0, kind="stable")
    values, columns = np.take_along_axis(centroids, order, axis=0), np.arange(dims)[None, :]
    up = np.stack([np.searchsorted(values[:, j], x[:, j]) for j in range(dims)], axis=1) if n else np.zeros((0, dims), np.int64)
    down = up - 1
    best, which, seen = np.full(n, beyond, x.dtype), np.full(n, k), np.zeros((n, k), bool)
    live, exact = np.arange(n), 0
    while len(live):
        at, low, high = x[live], down[live], up[live]
        below = np.where(low >= 0, at - values[np.maximum(low, 0), columns], beyond)
        above = np.where(high < k, values[np.minimum(high, k - 1), columns] - at, beyond)
        back = below <= above
        step, met = np.where(back, below, above), order[np.where(back, low, high), columns]
        down[live], up[live] = low - back, high + ~back
        new = np.zeros((len(live), k), bool)
        new[np.arange(len(live))[:, None], met] = True
        new &= ~seen[live]
        seen[live] |= new
        for c in np.nonzero(new.any(axis=0))[0]:
            rows = live[new[:, c]]
            d = ((x[rows] - centroids[c]) ** 2).sum(axis=1)
            exact += len(rows)
            better = (d < best[rows]) | ((d == best[rows]) & (c < which[rows]))
            best[rows[better]], which[rows[better]] = d[better], c
        frontier = (step**2).sum(axis=1)
        live = live[(frontier <= best[live]) & ~seen[live].all(axis=1)]
    return which, best, exact


def added(x: np.ndarray) -> list[int]:
    """Exact sums of columns."""
    wide = x if largest(x) * max(len(x), 1) <= BIG else x.astype(object)
    return [int(v) for v in wide.sum(axis=0)]


def cluster_sums(rows: DataFrame, centroids: np.ndarray) -> list:
    """cluster, i, n, total: number and sum of component i of the vectors nearest to each centroid that has any."""
    k, dims = centroids.shape
    schema = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0)))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = [0] * k, [[0] * dims for _ in range(k)]
        for batch in batches:
            x = matrix(batch.column("x"), dims)
            which = nearest(x, centroids)[0]
            for c in np.unique(which):
                own = x[which == c]
                n[c] += len(own)
                sums[c] = [a + b for a, b in zip(sums[c], added(own))]
        found = [c for c in range(k) if n[c]]
        yield batch_of(schema, found, [n[c] for c in found], [[Decimal(v) for v in sums[c]] for c in found])

    parts = rows.select("x").mapInArrow(scan, "cluster int, n long, sums array<decimal(38, 0)>")
    each = parts.select("cluster", "n", F.posexplode("sums").alias("i", "s"))
    return each.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("total")).collect()  # k * dims rows


def clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, salt: str = SALT) -> DataFrame:
    """RESULT for every vector: its cluster, its squared distance, sums of distances, and a digest of the cluster's centroid."""
    spark = vectors.sparkSession
    rows = materialize(integer_vectors(vectors, scale, F.col("vec_id").cast("long").alias("vec_id")).filter(F.size("x") == dims), "integer-vectors")
    seeds = rows.orderBy(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "x").limit(k).collect()
    if not seeds:
        return spark.createDataFrame([], RESULT)
    centroids = np.array([r.x for r in seeds], np.int64)
    for _ in range(rounds):
        moved = centroids.copy()
        for r in cluster_sums(rows, centroids):
            moved[r.cluster, r.i] = int(r.total) // r.n
        if np.array_equal(moved, centroids):  # every further round would give the same
            break
        centroids = moved
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, distance, _ = nearest(matrix(batch.column("x"), dims), centroids)
            yield batch_of(schema, batch.column("vec_id"), which.astype(np.int32), clipped(distance))

    assigned = materialize(rows.mapInArrow(assign, "vec_id long, cluster int, distance long"), "assigned-vectors")
    sums = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38, 0)")).alias("s")).collect()}  # k rows
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    facts = [(c, min(s, BIG), min(sum(sums.values()), BIG), digest(c)) for c, s in sums.items()]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
