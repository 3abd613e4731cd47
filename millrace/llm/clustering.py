"""Centroid clustering in exact integers, screened by float32 products with rounding-error intervals.

Vectors become integers, floor(scale * x). Rows are compared with all centroids by one float32
matrix product a block. Its error is bounded: for d terms, in any order of summation and with
fused products or not, |computed - exact| <= g * |x| * |c| with g = (d + 2) u / (1 - (d + 2) u) and
u = 2**-24 (Higham 2002, section 3.1; two more roundings for the conversions). So each score
|c|**2 - 2 x.c lies in a known interval, and only centroids whose interval reaches below the
lowest upper end can be nearest. Where one is left, it is the nearest; where several overlap,
their distances are computed again in 64-bit integers, and ties go to the smaller number.

Spark: a round is one pass over the integer vectors without a shuffle of rows. Each task returns
sums and counts by centroid, and the centroids (k * d numbers, the model) are all that the driver
holds. Hot vectors or clusters make no task larger.

Nulls, ties, empty input: a vector that is null, of another length, or with a null or non-finite
entry is left out; a row without id is kept and comes last as a seed; rows of equal id are
ordered by their vectors as seeds; repeated vectors may seed equal centroids, of which only the
smallest number gets members; a centroid without members stays where it is; fewer rows than k
give fewer centroids; an empty table gives an empty result. Integers too large for a 64-bit
distance are an error. No other column is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, finite_matrix, list_column, materialise, release, trimmed

#: Entries of a block of scores.
BLOCK = 1 << 20
UNIT = 2.0**-24


class Screen:
    """Finds the nearest of integer centroids (k rows)."""

    def __init__(self, centroids: np.ndarray):
        self.exact = centroids.astype(np.int64)
        self.single = self.exact.astype(np.float32).T.copy()
        self.squares = (self.exact * self.exact).sum(axis=1).astype(np.float64)
        self.lengths = np.sqrt(self.squares) * (1 + 1e-12)
        terms = centroids.shape[1] + 2
        self.gamma = terms * UNIT / (1 - terms * UNIT)

    def intervals(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the intervals that hold |c|**2 - 2 x.c for each row of x and each centroid."""
        dots = (x.astype(np.float32) @ self.single).astype(np.float64)
        score = self.squares - 2 * dots
        lengths = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-12)
        # The second term covers the float64 roundings of squares and score.
        error = 2 * self.gamma * np.outer(lengths, self.lengths) + 2.0**-50 * (self.squares + 2 * np.abs(dots))
        return score - error, score + error

    def nearest(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x), np.int64)
        step = max(1, BLOCK // len(self.exact))
        for first in range(0, len(x), step):
            part = x[first : first + step]
            low, high = self.intervals(part)
            possible = low <= high.min(axis=1, keepdims=True)
            labels = possible.argmax(axis=1)
            several = np.flatnonzero(possible.sum(axis=1) > 1)
            if len(several):
                row, number = np.nonzero(possible[several])
                gap = part[several][row] - self.exact[number]
                distance = (gap * gap).sum(axis=1)
                least = np.minimum.reduceat(distance, np.flatnonzero(np.diff(row, prepend=-1)))
                hits = np.flatnonzero(distance == least[row])
                labels[several] = number[hits[np.unique(row[hits], return_index=True)[1]]]
            out[first : first + step] = labels
        return out


def _integers(dimensions: int, scale: float):
    # All differences squared and summed stay below 2**62.
    limit = isqrt((1 << 62) // dimensions) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, m = finite_matrix(batch.column(1), dimensions)
            x = np.floor(scale * m)
            if len(x) and np.abs(x).max() >= min(limit, 1 << 31):
                raise ValueError(f"an entry times {scale} is beyond {min(limit, 1 << 31)}: distances would not fit 64 bits")
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), list_column(x.astype(np.int32))], ["id", "x"])

    return run


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions).astype(np.int64)


def _sums(screen: Screen, dimensions: int):
    """From (x) batches: one row a task and centroid with members, (cluster, sums with the count behind them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(screen.exact), dimensions + 1), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), dimensions)
            if not len(x):
                continue
            labels = screen.nearest(x)
            order = np.argsort(labels, kind="stable")
            starts = np.flatnonzero(np.diff(labels[order], prepend=-1))
            found = labels[order][starts]
            sums[found, :-1] += np.add.reduceat(x[order], starts, axis=0)
            sums[found, -1] += np.diff(np.append(starts, len(x)))
        full = np.flatnonzero(sums[:, -1])
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), list_column(sums[full])], ["cluster", "sums"])

    return run


def _assigned(screen: Screen, dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dimensions)
            labels = screen.nearest(x)
            gap = x - screen.exact[labels]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(labels.astype(np.int32)), pa.array((gap * gap).sum(axis=1))], ["id", "cluster", "distance"])

    return run


@dataclass
class Clustering:
    """members: (id, cluster, distance), one row a vector that was kept; centroids: integers, one row a centroid."""

    members: DataFrame
    centroids: np.ndarray

    def summary(self) -> list[tuple[int, int, int, str]]:
        """(cluster, its inertia, inertia of all, sha256 of the centroid's integers joined by `,`) of clusters with members."""
        found = {r[0]: int(r[1]) for r in self.members.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)"))).collect()}
        name = lambda c: hashlib.sha256(",".join(map(str, self.centroids[c].tolist())).encode()).hexdigest()
        return [(c, n, sum(found.values()), name(c)) for c, n in sorted(found.items())]


def cluster(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", k: int = 40, rounds: int = 5, dimensions: int = 64, scale: float = 256.0, salt: str = "2:") -> Clustering:
    """k centroids, seeded by the rows with the smallest sha256 of salt and id, after some rounds of assignment and exact floored means."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    kind = vectors.schema[key].dataType.simpleString()
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = materialise(rows.mapInArrow(trimmed(_integers(dimensions, scale)), f"id {kind}, x array<int>"), "integers")
    order = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256).asc_nulls_last()
    seeds = rows.orderBy(order, "x").limit(k).collect()
    centroids = np.array([r.x for r in seeds], np.int64).reshape(-1, dimensions)
    for _ in range(rounds if len(centroids) else 0):
        parts = rows.select("x").mapInArrow(trimmed(_sums(Screen(centroids), dimensions)), "cluster int, sums array<long>")
        parts = parts.select("cluster", F.posexplode("sums").alias("at", "part")).groupBy("cluster", "at").agg(F.sum(F.col("part").cast("decimal(20,0)")).alias("sum"))
        total: dict[int, dict[int, int]] = {}
        for r in parts.collect():
            total.setdefault(r[0], {})[r[1]] = int(r[2])
        moved = centroids.copy()
        for c, sums in total.items():
            moved[c] = [sums[i] // sums[dimensions] for i in range(dimensions)]
        if (moved == centroids).all():
            break
        centroids = moved
    if not len(centroids):
        return Clustering(spark.createDataFrame([], f"id {kind}, cluster int, distance long"), centroids)
    members = rows.mapInArrow(trimmed(_assigned(Screen(centroids), dimensions)), f"id {kind}, cluster int, distance long")
    members = materialise(members, "members")
    release(rows)
    return Clustering(members, centroids)
