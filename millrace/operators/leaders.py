"""Removal of rows that are like leading ones, before any pairs are made.

Where most rows have many neighbours, pairs grow with the square of the rows, but the rows that stay
don't. So the first LEAD_ROWS rows in order are decided at once, and one pass over the others drops
what they remove; this goes on while a round removes at least the share WORTH of the rows. Rounds
are a logarithm of the rows, each is linear in what is left, and what is left then has few pairs.

A round's rows, at most LEAD_ROWS, are on the driver and in each task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.cells import matrix, unit
from millrace.storage import materialise

LEAD_ROWS, WORTH = 4000, 0.25
#: Rows of a task that meet the leaders at a time.
ROWS = 1000


def _like(units: np.ndarray, leaders: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each row is like a leader."""
    parts = [(units[at : at + ROWS] @ leaders.T > threshold).any(axis=1) for at in range(0, len(units), ROWS)]
    return np.concatenate(parts or [np.zeros(0, bool)])


def _scan(units: np.ndarray, threshold: float, greedy: bool) -> np.ndarray:
    """Which rows, in order, stay: none before them (greedy: none before them that stays) is like them."""
    stays = np.ones(len(units), bool)
    for x in range(len(units) - 1):
        if stays[x] or not greedy:
            stays[x + 1 :] &= ~(units[x + 1 :] @ units[x] > threshold)
    return stays


def led(rows: DataFrame, threshold: float, greedy: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows that are still open, rows that can still remove them, (row_id) removed), of rows (row_id, v, rank) in order of rank.

    Greedy: only rows that stay remove others, so both are the same. Else every row removes those after it, and rank is a number.
    Leaders that stay are in neither.
    """
    rows = rows.select("row_id", "v", "rank")
    open_, before, tables, n = rows, rows, [], rows.count()
    schema = rows.withColumn("gone", F.lit(False)).schema
    while n > LEAD_ROWS:
        first = before.orderBy("rank").limit(LEAD_ROWS).toArrow()
        if not len(first):
            break
        ids, units = first.column("row_id").to_numpy(), unit(matrix(first.column("v").combine_chunks()))
        stays = _scan(units, threshold, greedy)
        leaders = units[stays] if greedy else units
        done, lost = ids[stays], ids[~stays]

        def run(batches: Iterator[pa.RecordBatch], leaders: np.ndarray = leaders, done: np.ndarray = done, lost: np.ndarray = lost) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.filter(pa.array(~np.isin(batch.column(0).to_numpy(), done)))
                gone = np.isin(batch.column(0).to_numpy(), lost)
                at = np.flatnonzero(~gone)
                gone[at] = _like(unit(matrix(batch.column(1).take(pa.array(at)))), leaders, threshold)
                v = batch.column(1).take(pa.array(np.arange(len(gone)), mask=gone))
                yield pa.RecordBatch.from_arrays([batch.column(0), v, batch.column(2), pa.array(gone)], ["row_id", "v", "rank", "gone"])

        table = materialise(open_.mapInArrow(run, schema), "led")
        tables.append(table)
        open_ = table.where("not gone").select("row_id", "v", "rank")
        before = open_ if greedy else rows.where(F.col("rank") > first.column("rank")[-1].as_py())
        left, n = n, open_.count()
        if n > (1 - WORTH) * left:
            break
    removed = rows.sparkSession.createDataFrame([], "row_id long")
    for table in tables:
        removed = removed.union(table.where("gone").select("row_id"))
    return open_, before, removed
