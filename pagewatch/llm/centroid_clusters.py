"""Centroid clustering with a progressive search in the Walsh-Hadamard domain.

Vectors and centroids are integers, and so are their Walsh-Hadamard
transforms: the squared distance of two transforms is exactly the number of
dimensions times that of the vectors. Differences of coefficients are summed
from coarse (few sign changes) to fine. After each group of coefficients what
is left of a vector and of a centroid bounds what the rest can add; centroids
that are strictly worse than another one are given up, the others go on to the
last coefficient, so nearest centroids, ties and distances are exact.

Vectors stay where they are. A round sends the centroids (k of them) to the
tasks; each task sends back one sum a cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_table
from .integer_vectors import integer_rows, matrix

DIM = 64          # components of a vector, a power of two
SCALE = 64        # a component x becomes floor(SCALE * x)
LIMIT = 1 << 21   # components are smaller: 64 squared differences of coefficients then fit 63 bits
CLUSTERS = 16
ROUNDS = 3
SLICE = 2048      # vectors that a task searches at once


def walsh_hadamard(x: np.ndarray) -> np.ndarray:
    """Exact transform of each row of integers, coefficients in order of their sign changes."""
    out, dim = x.astype(np.int64), x.shape[1]
    step = 1
    while step < dim:
        pairs = out.reshape(len(out), dim // (2 * step), 2, step)
        out = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(len(out), dim)
        step *= 2
    return out[:, sequency(dim)]


def sequency(dim: int) -> np.ndarray:
    """Places of the transform's coefficients from the fewest to the most sign changes."""
    at = np.arange(dim)
    odd = np.bitwise_count(at[:, None] & at[None, :]) & 1
    return np.argsort((odd[:, 1:] != odd[:, :-1]).sum(1), kind="stable")


class ProgressiveSearch:
    """Nearest of some centroids, for many vectors."""

    def __init__(self, centroids: np.ndarray):
        self.coefficients = walsh_hadamard(centroids)
        self.dim = centroids.shape[1]
        self.groups = [(0, 1)] + [(1 << i, 2 << i) for i in range(self.dim.bit_length() - 1)]
        self.left = self._energy_left(self.coefficients)

    def _energy_left(self, coefficients: np.ndarray) -> list[np.ndarray]:
        """Per group of coefficients: the sum of squares of those after it."""
        total = np.cumsum((coefficients ** 2)[:, ::-1], axis=1)[:, ::-1]
        return [total[:, stop] if stop < self.dim else np.zeros(len(total), np.int64) for _, stop in self.groups]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number of the nearest centroid, squared distance) of each row, and how many squared differences it took."""
        parts = [self._nearest(x[i:i + SLICE]) for i in range(0, len(x), SLICE)]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), sum(p[2] for p in parts)

    def _nearest(self, x: np.ndarray):
        own, k = walsh_hadamard(x), len(self.coefficients)
        left = self._energy_left(own)
        row, centre = np.repeat(np.arange(len(x)), k), np.tile(np.arange(k), len(x))  # pairs still in question, by row
        found, work = np.zeros(len(row), np.int64), 0
        for (start, stop), a, b in zip(self.groups, left, self.left, strict=True):
            found += ((own[row, start:stop] - self.coefficients[centre, start:stop]) ** 2).sum(1)
            work += len(row) * (stop - start)
            a, b = a[row], b[centre]
            cross = np.sqrt(a.astype(float)) * np.sqrt(b.astype(float)) * 2
            cross = np.where(cross > 0, cross * (1 + 1e-9) + 1, 0).astype(np.int64)
            begin = np.searchsorted(row, np.arange(len(x)))
            best = np.minimum.reduceat(found + a + b + cross, begin)  # the rest adds at most (|a| + |b|)^2
            stays = found + np.maximum(a + b - cross, 0) <= best[row]  # and at least (|a| - |b|)^2
            row, centre, found = row[stays], centre[stays], found[stays]
        first = np.searchsorted(row, np.arange(len(x)))  # all that are left are equally near
        return centre[first], found[first] // self.dim, work


def _sums(rows: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Per cluster that is not empty: how many vectors and the sum of each component."""
    model = rows.sparkSession.sparkContext.broadcast(centroids)  # k centroids

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, count, total = ProgressiveSearch(model.value), np.zeros(len(model.value), np.int64), np.zeros_like(model.value)
        for batch in batches:
            x = matrix(batch.column(0)).astype(np.int64)
            cluster = search.nearest(x)[0]
            count += np.bincount(cluster, minlength=len(count))
            np.add.at(total, cluster, x)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some]),
                                          pa.array(total[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = rows.select("x").mapInArrow(add, "cluster int, n long, total array<long>")
    dim = centroids.shape[1]
    sums = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(dim)]).alias("total"))
    return {r["cluster"]: (r["n"], r["total"]) for r in sums.collect()}  # one row a centroid


def fit(rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids after ``rounds`` rounds over (id, x): exact floors of means, from the vectors first by hash of their id.

    Ids that are repeated are ordered by their vectors, null ids come last. Empty clusters keep their centroid. With
    fewer vectors than ``clusters`` each is a centroid of its own at first; with none there are no centroids.
    """
    h = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")).cast("binary"), 256)
    first = rows.select(h.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(clusters).collect()
    centroids = np.array([r["x"] for r in first], np.int64).reshape(len(first), len(first[0]["x"]) if first else 1)
    for _ in range(rounds if len(centroids) else 0):
        for cluster, (n, total) in _sums(rows, centroids).items():
            centroids[cluster] = [t // n for t in total]
    return centroids


def assign(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of (id, x): the nearest centroid, the smaller number on ties, and the squared distance."""
    model = rows.sparkSession.sparkContext.broadcast(centroids)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        progressive = ProgressiveSearch(model.value)
        for batch in batches:
            cluster, distance, _ = progressive.nearest(matrix(batch.column(1)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, pa.int32()), pa.array(distance)], ["id", "cluster", "distance"])

    return rows.select("id", "x").mapInArrow(search, "id long, cluster int, distance long")


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS,
            rounds: int = ROUNDS, scale: int = SCALE, dim: int = DIM) -> tuple[DataFrame, DataFrame]:
    """Assignments (id, cluster, distance) and centroids (cluster, size, inertia, centroid) of the clusters that are not empty.

    Vectors that are null, hold null or non-finite components or have not ``dim`` components take no part. Repeated
    rows count as often as they stand there, null ids too. An empty table gives two empty results. Other columns are
    not read. A component x with abs(scale * x) >= 2^21 raises: its distances would not be exact.
    """
    spark = vectors.sparkSession
    rows = write_table(integer_rows(vectors, id_col, vector_col, scale, LIMIT, dim), "centroid_rows")
    centroids = fit(rows, clusters, rounds)
    found = write_table(assign(rows, centroids), "centroid_clusters")
    sums = found.groupBy("cluster").agg(F.count("*").alias("size"), F.sum("distance").alias("inertia")).collect()  # a row a centroid
    table = [(r["cluster"], r["size"], r["inertia"], centroids[r["cluster"]].tolist()) for r in sums]
    return found, spark.createDataFrame(table, "cluster int, size long, inertia long, centroid array<long>")
