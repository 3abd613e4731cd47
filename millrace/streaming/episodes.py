"""Streaming: time bins with late data, and batches of new rows de-duplicated against an index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from millrace.plans.pipelines import incremental


def binned(events: DataFrame, duration: str, by: str, variables: list[str], time: str = "charttime", variable: str = "variable", value: str = "value", late: str = "1 hour") -> DataFrame:
    """Means by time window, key and variable; events later than the watermark are dropped, and state goes with it."""
    rows = events.where(F.col(variable).isin(*variables)).withWatermark(time, late)
    one = lambda v: F.avg(F.when(F.col(variable) == v, F.col(value))).alias(v)
    out = rows.groupBy(F.window(time, duration), by).agg(*(one(v) for v in variables))
    return out.select(by, F.col("window.end").alias("upper"), *variables)


def deduplicated(rows: DataFrame, index_path: str, sink: Callable[[DataFrame, int], None], threshold: float = 0.9, key: str = "row_id", vector: str = "embedding") -> DataStreamWriter:
    """Each micro-batch loses its near duplicates, within itself and against all before; sink gets what is left, the same rows if a batch is run again."""

    def step(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            sink(incremental(batch, index_path, threshold, key, vector, batch=number), number)

    return rows.writeStream.foreachBatch(step)
