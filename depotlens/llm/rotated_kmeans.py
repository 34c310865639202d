"""Exact k-means over integer vectors, with centroids ruled out in a rotated space.

Vectors are rotated onto their principal axes once. Stored with each are its leading rotated coordinates and the norm
of the rest. For vector x and centroid c

    |x - c|^2  >=  |lead(x) - lead(c)|^2 + (rest(x) - rest(c))^2

so after the exact distance to the centroid with the smallest bound, all centroids whose bound is larger are ruled out;
the others are compared in integers. Bounds carry a margin for the error of floating point. Rounds exchange sums and
counts of clusters, added up in every task, of which there are as many as clusters whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotlens.llm.common import stored

SCALE = 256
LEADING_SHARE = 0.75  # of the coordinates; nearly round clouds of vectors need so many to rule anything out
BLOCK_ROWS = 4096
MARGIN = 1e-6  # of the squared lengths; 32-bit coordinates are off by less
VECTORS = "vec_id bigint, vector array<bigint>, lead array<float>, rest float"


def integer_vectors(table: DataFrame, size: int, scale: int = SCALE) -> DataFrame:
    """(vec_id, vector): floor(scale * x) of every row with exactly ``size`` components, none NULL or not finite.

    Other rows take no part. A component so large that squared distances could pass 64 bits raises an error.
    """
    most = largest_component(size)
    wide = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (
        F.abs(x.cast("double")) < F.lit(float("inf"))))
    kept = table.where(F.coalesce((F.size("embedding") == size) & finite, F.lit(False)))
    whole = F.transform(wide, lambda x: F.when(
        F.abs(F.floor(x * scale)) <= most, F.floor(x * scale)).otherwise(F.raise_error(
            F.lit(f"a component times {scale} lies beyond {most}"))).cast("bigint"))
    return kept.select(F.col("vec_id").cast("bigint"), whole.alias("vector"))


def largest_component(size: int) -> int:
    """The largest component for which a squared distance fits 63 bits."""
    return int((2 ** 62 / size) ** 0.5 / 2)


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.int64)


def principal_axes(vectors: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean of all vectors and their principal axes as columns, the widest first.

    Tasks add up sums and products per batch; ``size`` squared numbers in all are gathered. The axes only decide how
    much the bounds rule out, never what is found.
    """
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, product, n = np.zeros(size), np.zeros((size, size)), 0
        for batch in batches:
            x = _matrix(batch.column("vector")).astype(float)
            if len(x):
                total, product, n = total + x.sum(0), product + x.T @ x, n + len(x)
        flat = np.concatenate([[n], total, product.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["at", "value"])

    added = vectors.select("vector").mapInArrow(moments, "at bigint, value double").groupBy("at").agg(F.sum("value"))
    flat = np.zeros(1 + size + size * size)
    for at, value in added.collect():
        flat[at] = value
    n = max(flat[0], 1.0)
    mean = flat[1:1 + size] / n
    _, axes = np.linalg.eigh(flat[1 + size:].reshape(size, size) / n - np.outer(mean, mean))
    return mean, axes[:, ::-1]


@dataclass
class Rotation:
    mean: np.ndarray
    axes: np.ndarray
    leading: int

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates and the norm of the others."""
        turned = (x - self.mean) @ self.axes
        return turned[:, :self.leading], np.sqrt((turned[:, self.leading:] ** 2).sum(1))


def rotated(vectors: DataFrame, rotation: Rotation) -> DataFrame:
    """Vectors with their leading coordinates and the norm of the rest."""
    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, rest = rotation.of(_matrix(batch.column("vector")).astype(float)) if batch.num_rows else (
                np.zeros((0, rotation.leading)), np.zeros(0))
            at = np.arange(batch.num_rows + 1) * rotation.leading
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("vector"),
                 pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(lead.ravel(), pa.float32())),
                 pa.array(rest, pa.float32())],
                ["vec_id", "vector", "lead", "rest"])

    return vectors.mapInArrow(turn, VECTORS)


def nearest(x: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, rotation: Rotation
            ) -> tuple[np.ndarray, np.ndarray, int]:
    """Cluster and squared distance of every vector, ties to the smaller number, and how many pairs were verified."""
    lead, rest = lead.astype(float), rest.astype(float)
    c_lead, c_rest = rotation.of(centroids.astype(float))
    bound = ((lead ** 2).sum(1)[:, None] + (c_lead ** 2).sum(1) - 2 * lead @ c_lead.T + (rest[:, None] - c_rest) ** 2)
    # rounding errors are relative to the squared lengths that went in
    largest = (lead ** 2).sum(1) + rest ** 2
    bound -= MARGIN * (largest[:, None] + (c_lead ** 2).sum(1) + c_rest ** 2 + (rotation.mean ** 2).sum() + 1)

    def exact(rows: np.ndarray, of: np.ndarray) -> np.ndarray:
        gap = x[rows] - centroids[of]
        return (gap * gap).sum(1)

    rows = np.arange(len(x))
    cluster = bound.argmin(1)
    distance = exact(rows, cluster)
    rival, of = np.nonzero(bound <= distance[:, None])
    others = of != cluster[rival]
    rival, of = rival[others], of[others]
    found = exact(rival, of)
    # per vector the smallest (distance, number) among the first candidate and its rivals
    row = np.concatenate([rows, rival])
    number, value = np.concatenate([cluster, of]), np.concatenate([distance, found])
    order = np.lexsort((number, value, row))
    best = order[np.searchsorted(row[order], rows)]
    return number[best], value[best], len(value)


def _assign(batch: pa.RecordBatch, centroids: np.ndarray, rotation: Rotation):
    x, lead, rest = _matrix(batch.column("vector")), _matrix(batch.column("lead")), batch.column("rest").to_numpy()
    for at in range(0, len(x), BLOCK_ROWS):
        part = slice(at, at + BLOCK_ROWS)
        yield x[part], *nearest(x[part], lead[part], rest[part], centroids, rotation)[:2]


def _moved(vectors: DataFrame, centroids: np.ndarray, rotation: Rotation) -> np.ndarray:
    """The centroids after one round: floors of the exact means, those without vectors stay."""
    k, size = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, total = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
            for x, cluster, _ in _assign(batch, centroids, rotation):
                order = np.argsort(cluster, kind="stable")
                own, first = np.unique(cluster[order], return_index=True)
                total[own] += np.add.reduceat(x[order], first, axis=0)
                count += np.bincount(cluster, minlength=k)
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(some, size + 1)), pa.array(np.tile(np.arange(size + 1), len(some))),
                 pa.array(np.column_stack([total[some], count[some]]).ravel())], ["cluster", "at", "value"])

    sums = vectors.mapInArrow(add, "cluster bigint, at bigint, value bigint").groupBy("cluster", "at").agg(
        F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    found = {(r.cluster, r.at): int(r.value) for r in sums.collect()}
    return np.array([[found[c, d] // found[c, size] if (c, size) in found else int(centroids[c, d]) for d in range(size)]
                     for c in range(k)], np.int64).reshape(k, size)


def first_centroids(vectors: DataFrame, k: int) -> np.ndarray:
    """The vectors with the ``k`` smallest SHA-256 of '2:<vec_id>', in that order; equal ids by their components."""
    key = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    return np.array([r.vector for r in vectors.orderBy(F.asc_nulls_last(key), "vector").limit(k).collect()], np.int64)


def clustered(table: DataFrame, k: int, rounds: int, size: int, scale: int = SCALE,
              leading: int | None = None) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part.

    With fewer than ``k`` vectors there are as many centroids; without any the result is empty. Repeated vec_ids are
    rows of their own. Distances beyond 64 bits in sum raise an error.
    """
    whole = stored(integer_vectors(table, size, scale), "vectors")
    rotation = Rotation(*principal_axes(whole, size), leading or round(LEADING_SHARE * size))
    vectors = stored(rotated(whole, rotation), "rotated")
    centroids = first_centroids(whole, k).reshape(-1, size)
    for _ in range(rounds if len(centroids) else 0):
        centroids = _moved(vectors, centroids, rotation)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = list(_assign(batch, centroids, rotation))
            cluster, distance = (np.concatenate([p[i] for p in parts] or [np.zeros(0, np.int64)]) for i in (1, 2))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance)],
                ["vec_id", "cluster", "distance"])

    final = vectors.mapInArrow(assign, "vec_id bigint, cluster int, distance bigint")
    final = stored(final, "assigned")
    wide = F.sum(F.col("distance").cast("decimal(38,0)"))
    totals = final.groupBy("cluster").agg(wide.cast("bigint").alias("cluster_inertia"))
    digests = [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    named = table.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")
    # one row per centroid
    figures = totals.join(F.broadcast(named), "cluster").withColumn(
        "inertia", final.agg(wide.cast("bigint").alias("inertia")).scalar())
    return final.join(F.broadcast(figures), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
