"""Vectors in cells around pivots, with angular bounds that tell which cells a vector can have a neighbour in.

A vector belongs to its nearest pivot. With a the angle between two vectors and t the angle of the
threshold, the triangle inequality of angles says of a vector x and a member y of cell c, within t
of each other: a(x, c) <= t + the cell's largest angle, a(x, c) >= its smallest angle - t, and, as y
is no nearer to x's own pivot than to c, a(x, c) - a(x, own) <= 2 t. A cell for which one of these
fails is skipped, whatever the dimension; random vectors of many dimensions skip nothing, clustered
ones nearly all. SLACK covers rounding.

Pivots are at most MAX_PIVOTS rows: the model, on the driver and in each task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from millrace.storage import materialise

CELL_ROWS, MAX_PIVOTS = 2000, 4096
#: Rows are dealt to groups of blocks: about so many, unless one would hold more rows or numbers than a task should.
GROUPS, GROUP_ROWS, GROUP_NUMBERS = 16, 40_000, 4_000_000
SLACK = 1e-6


def unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; zero rows stay zero."""
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of equal length as rows of a matrix; null entries are NaN."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def real(df: DataFrame, vector: str) -> Column:
    """The vectors as they are stored and sent: 4 bytes a number where that is their type, else 8. Products are of 8 bytes a number in any case."""
    return F.col(vector) if getattr(df.schema[vector].dataType, "elementType", None) == FloatType() else F.col(vector).cast("array<double>")


def choose_pivots(vectors: DataFrame, n_rows: int, key: str, vector: str) -> np.ndarray:
    """One row for about CELL_ROWS, those with the smallest md5 of the key; equal ones once."""
    n = min(MAX_PIVOTS, max(1, n_rows // CELL_ROWS))
    rows = vectors.select(F.md5(F.col(key).cast("string")).alias("h"), F.col(vector).cast("array<double>").alias("v")).orderBy("h", "v").limit(n).collect()
    m = np.array([r.v for r in rows], np.float64)
    m = unit(m[np.isfinite(m).all(axis=1)]) if len(rows) else np.zeros((0, 1))
    m = np.unique(m[np.any(m != 0, axis=1)], axis=0)
    return m if len(m) else np.eye(1, max(1, m.shape[1]))


@dataclass
class Cells:
    """pivots; by cell: rows, smallest and largest angle of its members (filled by measure())."""

    pivots: np.ndarray
    threshold: float
    rows: np.ndarray | None = None
    least: np.ndarray | None = None
    most: np.ndarray | None = None

    @property
    def angle(self) -> float:
        return float(np.arccos(np.clip(self.threshold, -1.0, 1.0)))

    @property
    def prunes(self) -> bool:
        """Below 0 the zero vector, which has no angle, is within the threshold of all."""
        return self.threshold >= 0

    def angles(self, units: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(units @ self.pivots.T, -1.0, 1.0))

    def placed(self, vectors: DataFrame, key: str, vector: str) -> DataFrame:
        """(id, v, cell, angle) of the vectors that can be in a pair: finite ones and, unless the threshold is below 0, not zero."""
        cells = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                m = matrix(batch.column(1))
                units = unit(m)
                able = np.isfinite(m).all(axis=1) & (np.any(units != 0, axis=1) | (not cells.prunes))
                angles = cells.angles(units[able])
                own = angles.argmin(axis=1) if len(angles) else np.zeros(0, np.int64)
                part = batch.filter(pa.array(able))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(own.astype(np.int32)), pa.array(angles[np.arange(len(own)), own])], ["id", "v", "cell", "angle"])

        rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), real(vectors, vector).alias("v"))
        return rows.mapInArrow(run, f"id long, v {dict(rows.dtypes)['v']}, cell int, angle double")

    def measure(self, stats: DataFrame) -> None:
        """stats: (cell, n, least, most), any number of rows a cell."""
        n = len(self.pivots)
        self.rows, self.least, self.most = np.zeros(n, np.int64), np.full(n, np.inf), np.full(n, -np.inf)
        for r in stats.groupBy("cell").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")).collect():
            self.rows[r.cell], self.least[r.cell], self.most[r.cell] = r.n, r.least, r.most

    def reached(self, angles: np.ndarray) -> np.ndarray:
        """Of vectors with these angles to the pivots: whether each cell can hold a neighbour. Empty cells can't."""
        if not self.prunes:
            return np.broadcast_to(self.rows > 0, angles.shape)
        t = self.angle + SLACK
        return (angles <= t + self.most) & (angles >= self.least - t) & (angles - angles.min(axis=1, keepdims=True, initial=np.inf) <= t + t)


def statistics(placed: DataFrame) -> DataFrame:
    return placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("least"), F.max("angle").alias("most"))


def celled(vectors: DataFrame, threshold: float, key: str, vector: str, n_rows: int | None = None) -> tuple[Cells, DataFrame]:
    """(cells, placed rows), the rows in shared storage."""
    usable = vectors.where(F.col(vector).isNotNull())
    cells = Cells(choose_pivots(usable, n_rows if n_rows is not None else usable.count(), key, vector), threshold)
    placed = materialise(cells.placed(usable, key, vector), "cells")
    cells.measure(statistics(placed))
    return cells, placed


def group_rows(n: int, block: int, width: int = 1) -> int:
    """Rows of a group of n rows of so many numbers, at least those of a block."""
    return max(block, min(-(-n // GROUPS), GROUP_ROWS, GROUP_NUMBERS // max(1, width)))


class Blocks:
    """Cells cut into blocks of at most about so many rows, by a hash of the id."""

    def __init__(self, cells: Cells, rows: int):
        self.cells, self.size = cells, rows
        self.parts = np.maximum(1, -(-cells.rows // rows))
        self.begins = np.concatenate([[0], np.cumsum(self.parts)])

    def __len__(self) -> int:
        return int(self.begins[-1])

    def groups(self) -> np.ndarray:
        """The group of each block; groups are blocks in succession."""
        most = group_rows(int(self.cells.rows.sum()), self.size, self.cells.pivots.shape[1])
        rows = np.repeat(self.cells.rows / self.parts, self.parts)
        return ((np.cumsum(rows) - rows) // most).astype(np.int32)

    def own(self, ids: np.ndarray, cell: np.ndarray) -> np.ndarray:
        mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return self.begins[cell] + (mixed % self.parts[cell].astype(np.uint64)).astype(np.int64)

    def reached(self, units: np.ndarray) -> list[np.ndarray]:
        """The blocks that each row can have a neighbour in."""
        found = self.cells.reached(self.cells.angles(units))
        return [np.concatenate([np.arange(self.begins[c], self.begins[c + 1]) for c in np.flatnonzero(row)] or [np.zeros(0, np.int64)]).astype(np.int32) for row in found]

    def meeting(self, units: np.ndarray) -> np.ndarray:
        """Rows by blocks: whether the row can have a neighbour in the block."""
        found = [self.cells.reached(self.cells.angles(units[at : at + 1000])) for at in range(0, max(1, len(units)), 1000)]
        return np.repeat(np.concatenate(found), self.parts, axis=1)

    def dealt(self, rows: DataFrame, grouped: bool = False) -> DataFrame:
        """rows (id, v, cell) as (id, v, b, o): one row for each block o in reach, or for each group of blocks; b is its own block (-1 without a cell)."""
        blocks, groups = self, self.groups()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, cell = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
                own = np.where(cell < 0, -1, blocks.own(ids, np.maximum(cell, 0))) if len(ids) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own.astype(np.int32)), pa.array([np.unique(groups[x]) if grouped else x for x in blocks.reached(unit(matrix(batch.column(1))))], pa.list_(pa.int32()))], ["id", "v", "b", "others"])

        wide = rows.select("id", "v", "cell").mapInArrow(run, f"id long, v {dict(rows.dtypes)['v']}, b int, others array<int>")
        return wide.select("id", "v", "b", F.explode("others").alias("o"))
