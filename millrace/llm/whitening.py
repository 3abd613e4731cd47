"""Embedding whitening by hierarchical merging of singular value decompositions.

Entries become integers, floor(scale * c) + shift. A summary of some rows is their number, the
exact sums of each dimension, and the singular values and right vectors of the centred rows, all
of them. Two summaries merge without loss: both decompositions, each vector times its singular
value, and one more row, the difference of the means times sqrt(n1 n2 / (n1 + n2)), are stacked
and decomposed again. Every task merges its batches, and the tasks' summaries (d * d numbers each)
merge in groups of FAN until one is left. Rows are centred before anything is multiplied, on an
integer pivot first, and means differ by exact integers, so a large shift costs no digits. The
squared singular values by n are the eigenvalues of the covariance, and the vectors its
eigenvectors. Only the last summary comes to the driver.

Whitened rows are centred rows on the eigenvectors, divided by the root of the eigenvalue.

Nulls, ties, empty input: rows whose vector is null or has a null or non-finite entry are left
out, as are vectors of another length than the commonest (of equally common ones the longest), as
they can't be fitted together; rows without id, repeated ids and repeated rows are rows of their
own; a component has its largest entry positive, so reruns agree but for rounding; a component
without variance (constant entries, or fewer rows than dimensions) has whitened null and
explained 0 and doesn't count in identity_error; an empty table gives an empty result. Integers
beyond 2**53 are an error. No other column is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, finite_matrix, list_column, materialise, release, trimmed

FAN = 16
LIMIT = 1 << 53
_SUMMARY = "part int, n long, sums array<long>, singular array<double>, vectors array<double>"


@dataclass
class Summary:
    """Of n rows: exact sums, and the decomposition of the centred rows."""

    n: int
    sums: np.ndarray
    singular: np.ndarray
    vectors: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Summary:
        sums = x.sum(axis=0)
        _, singular, vectors = np.linalg.svd(centred(x, len(x), sums), full_matrices=False)
        return cls(len(x), sums, singular, vectors)

    def merged(self, other: Summary) -> Summary:
        a, b = self.n, other.n
        gaps = np.array([(b * int(x) - a * int(y)) / (a * b) for x, y in zip(self.sums, other.sums, strict=True)])
        rows = [self.singular[:, None] * self.vectors, other.singular[:, None] * other.vectors, (a * b / (a + b)) ** 0.5 * gaps[None]]
        _, singular, vectors = np.linalg.svd(np.vstack(rows), full_matrices=False)
        return Summary(a + b, self.sums + other.sums, singular, vectors)

    def batch(self, part: int) -> pa.RecordBatch:
        row = [pa.array([part], pa.int32()), pa.array([self.n]), *(list_column(x.reshape(1, -1)) for x in (self.sums, self.singular, self.vectors))]
        return pa.RecordBatch.from_arrays(row, ["part", "n", "sums", "singular", "vectors"])

    @classmethod
    def read(cls, row: dict) -> Summary:
        sums = np.array(row["sums"], np.int64)
        return cls(row["n"], sums, np.array(row["singular"]), np.array(row["vectors"]).reshape(-1, len(sums)))


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n: integers less a whole pivot, exactly, then less the rest."""
    pivot = sums // n
    return (x - pivot).astype(np.float64) - (sums - n * pivot) / n


def _integers(column: pa.Array, dimensions: int, scale: float, shift: int) -> tuple[np.ndarray, np.ndarray]:
    rows, m = finite_matrix(column, dimensions)
    x = np.floor(scale * m)
    if len(x) and np.abs(x).max() >= LIMIT - abs(shift):
        raise ValueError(f"an entry times {scale} is beyond 2**53")
    return rows, x.astype(np.int64) + shift


def _summaries(integers):
    """One summary a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = None
        for batch in batches:
            _, x = integers(batch.column(0))
            if len(x):
                done = Summary.of(x) if done is None else done.merged(Summary.of(x))
        if done is not None:
            yield done.batch(TaskContext.get().partitionId())

    return run


def _merged(key: tuple, table: pa.Table) -> pa.Table:
    """The summaries of one group as one, in the order of their parts."""
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    done = Summary.read(rows[0])
    for r in rows[1:]:
        done = done.merged(Summary.read(r))
    return pa.Table.from_batches([done.batch(key[0].as_py())])


@dataclass
class Whitening:
    """The fit: n rows, sums by dimension, eigenvalues (all, falling) and eigenvectors (rows; the largest entry of each is positive)."""

    n: int
    sums: np.ndarray
    eigenvalues: np.ndarray
    components: np.ndarray
    scale: float
    shift: int

    @property
    def explained(self) -> np.ndarray:
        total = self.eigenvalues.sum()
        return self.eigenvalues / total if total > 0 else np.zeros_like(self.eigenvalues)

    def basis(self, most: int) -> np.ndarray:
        """The first components by the root of their eigenvalues, as columns; those without variance are left out."""
        spread = np.sqrt(self.eigenvalues[: min(most, len(self.components))])
        has = spread > (spread.max(initial=0.0) * len(self.sums) * np.finfo(float).eps)
        return (self.components[: len(has)][has] / spread[has, None]).T.copy()


def fit(vectors: DataFrame, vector: str = "embedding", scale: float = 64.0, shift: int = 1_000_000) -> Whitening | None:
    """The decomposition of all usable rows; None if there are none."""
    bounded_batches(vectors.sparkSession)
    lengths = vectors.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("d")).count()
    common = lengths.orderBy(F.desc("count"), F.desc("d")).first()
    if common is None or not common.d:
        return None
    rows = vectors.select(F.col(vector).cast("array<double>").alias("v"))
    dimensions = common.d
    parts = materialise(rows.mapInArrow(trimmed(_summaries(lambda c: _integers(c, dimensions, scale, shift))), _SUMMARY), "summaries")
    while parts.agg(F.max("part")).first()[0]:
        merged = parts.groupBy(F.floor(F.col("part") / FAN).cast("int").alias("group")).applyInArrow(_merged, _SUMMARY)
        done, parts = parts, materialise(merged, "summaries")
        release(done)
    found = parts.collect()
    release(parts)
    if not found:
        return None
    s = Summary.read(found[0].asDict())
    signs = np.sign(s.vectors[np.arange(len(s.vectors)), np.abs(s.vectors).argmax(axis=1)])
    eigenvalues = np.zeros(dimensions)
    eigenvalues[: len(s.singular)] = s.singular**2 / s.n
    return Whitening(s.n, s.sums, eigenvalues, s.vectors * signs[:, None], scale, shift)


def _moments(model: Whitening, basis: np.ndarray):
    """One row a task: sums and products of the whitened rows, in one array."""
    n_components = basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(n_components), np.zeros((n_components, n_components))
        for batch in batches:
            _, x = _integers(batch.column(0), len(model.sums), model.scale, model.shift)
            w = centred(x, model.n, model.sums) @ basis
            sums += w.sum(axis=0)
            products += w.T @ w
        yield pa.RecordBatch.from_arrays([list_column(np.concatenate([sums, products.ravel()])[None])], ["moments"])

    return run


def identity_error(vectors: DataFrame, model: Whitening, vector: str = "embedding", most: int = 32) -> float | None:
    """Largest absolute entry of the whitened rows' covariance minus the identity; None without a component of some variance."""
    basis = model.basis(most)
    k = basis.shape[1]
    if not k:
        return None
    rows = vectors.select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(trimmed(_moments(model, basis)), "moments array<double>")
    sums = rows.select(F.posexplode("moments").alias("at", "part")).groupBy("at").agg(F.sum("part")).collect()
    found = np.array([x for _, x in sorted((r[0], r[1]) for r in sums)]) / model.n
    return float(np.abs(found[k:].reshape(k, k) - np.outer(found[:k], found[:k]) - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Sums over dimensions of (n * x - sums)**2, exact; in Python's integers where 64 bits could be too few."""
    pivot = sums // n
    near, rest = x - pivot, sums - n * pivot
    most = n * (int(np.abs(near).max(initial=0)) + 1)
    if most * most * x.shape[1] < 1 << 62:
        gaps = n * near - rest
        return pa.array((gaps * gaps).sum(axis=1)).cast(pa.decimal128(38, 0))
    gaps = n * near.astype(object) - rest.astype(object)
    return pa.array([Decimal(int(v)) for v in (gaps * gaps).sum(axis=1)], pa.decimal128(38, 0))


def _whitened(model: Whitening, basis: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _integers(batch.column(1), len(model.sums), model.scale, model.shift)
            w = centred(x, model.n, model.sums) @ basis
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), deviations(x, model.n, model.sums), list_column(w)], ["id", "deviation", "whitened"])

    return run


def transform(vectors: DataFrame, model: Whitening, vector: str = "embedding", key: str = "vec_id", most: int = 32) -> DataFrame:
    """(id, deviation decimal(38,0), whitened array<double>): one row a usable vector, with its first components of some variance."""
    bounded_batches(vectors.sparkSession)
    kind = vectors.schema[key].dataType.simpleString()
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInArrow(trimmed(_whitened(model, model.basis(most))), f"id {kind}, deviation decimal(38,0), whitened array<double>")
