"""An index of vectors on disk, in cells, to which batches are added and of which a search reads only the cells in reach.

    index/part=<number>-<version>/cell=<c>/   rows (row_id, v, angle, added: number of their batch)
    index/_index/pivots/                      the pivots, chosen from the first batch
    index/_index/manifest/<part>/             (from, cell, n, least, most): what the part holds

A part counts when its manifest is complete, which is written last. compact() writes the parts up to
a number as one, of the next version; its manifest says from which number on it holds batches, and
parts within it no longer count, so a crash at any point leaves either the old parts or the new one
valid. Batches in a compacted part are settled: running one again gives the rows saved then.

Names beginning with an underscore are not seen by readers of the folder, so it can be read as a
table as long as no compaction broke off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import similarity
from millrace.operators.cells import Blocks, Cells, choose_pivots, matrix, statistics, unit

_ROWS = "row_id long, v array<double>, angle double, added int, part string, cell int"


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _found(self, pattern: str) -> list[str]:
        """Names of the folders that are complete."""
        found = self._files.globStatus(self._path(f"{self.path}/{pattern}/_SUCCESS"))
        return [f.getPath().getParent().getName() for f in found or ()]

    def parts(self) -> dict[str, tuple[int, int]]:
        """The parts that count: (first, last) number of the batches in each."""
        names = self._found("_index/manifest/*")
        spans = {}
        for name in names:
            first = self.spark.read.parquet(f"{self.path}/_index/manifest/{name}").select("from").first()
            last = int(name.split("-")[0])
            spans[name] = (first[0] if first else last, last, int(name.split("-")[1]))
        inside = lambda a, b: spans[b][0] <= spans[a][0] and spans[a][1] <= spans[b][1] and spans[b][2] > spans[a][2]
        return {a: spans[a][:2] for a in spans if not any(inside(a, b) for b in spans)}

    def last(self) -> int:
        """The largest number of a batch; -1 if there is none."""
        return max((last for _, last in self.parts().values()), default=-1)

    def settled(self) -> int:
        """Batches up to this number are in a compacted part."""
        return max((last for name, (_, last) in self.parts().items() if not name.endswith("-0")), default=-1)

    def _read(self, names: list[str]) -> DataFrame:
        rows = self.spark.read.schema(_ROWS).option("basePath", self.path).parquet(*(f"{self.path}/part={n}" for n in names))
        return rows.select(F.col("row_id").alias("id"), "v", "angle", "added", "cell")

    def rows(self, number: int) -> DataFrame:
        """The saved rows of one batch."""
        return self._read([n for n, (first, last) in self.parts().items() if first <= number <= last]).where(F.col("added") == number)

    def _cells(self, threshold: float) -> Cells:
        pivots = [r.v for r in self.spark.read.parquet(f"{self.path}/_index/pivots").orderBy("cell").collect()]
        return Cells(np.array(pivots), threshold)

    def reach(self, new: DataFrame, number: int, threshold: float, key: str = "row_id", vector: str = "embedding") -> tuple[Blocks, DataFrame] | None:
        """(blocks of the cells, rows of smaller batches in the cells that new vectors can have a neighbour in); None if there are none."""
        names = [n for n, (first, _) in self.parts().items() if first < number]
        if not names:
            return None
        cells = self._cells(threshold)
        manifest = self.spark.read.parquet(*(f"{self.path}/_index/manifest/{n}" for n in names)).where("n > 0")
        cells.measure(manifest.select("cell", "n", "least", "most"))
        blocks = Blocks(cells, similarity.BLOCK_ROWS)

        def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = np.zeros(len(cells.pivots), bool)
            for batch in batches:
                if len(batch):
                    seen |= cells.reached(cells.angles(unit(matrix(batch.column(0))))).any(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen).astype(np.int32))], ["cell"])

        mine = new.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
        found = [r.cell for r in mine.mapInArrow(touched, "cell int").distinct().collect()]
        return blocks, self._read(names).where(F.col("cell").isin(found) & (F.col("added") < number))

    def like(self, new: DataFrame, number: int, threshold: float, key: str = "row_id", vector: str = "embedding") -> DataFrame | None:
        """(row_id) of new rows with a cosine above the threshold to a row of a smaller batch; None if there is no such batch."""
        found = self.reach(new, number, threshold, key, vector)
        return similarity.hits(new, found[0], found[1], threshold, key, vector) if found else None

    def _save(self, rows: DataFrame, name: str, first: int) -> None:
        """rows (id, v, angle, added, cell) as a part; its manifest comes last."""
        rows.withColumnRenamed("id", "row_id").write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/part={name}")
        stats = statistics(self._read([name])) if self._files.globStatus(self._path(f"{self.path}/part={name}/cell=*")) else statistics(rows.limit(0))
        empty = self.spark.createDataFrame([(0, 0, 0.0, 0.0)], "cell int, n long, least double, most double")
        stats.union(empty).select(F.lit(first).alias("from"), "cell", "n", "least", "most").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_index/manifest/{name}")

    def add(self, rows: DataFrame, number: int, key: str = "row_id", vector: str = "embedding") -> None:
        """Save rows as the batch of this number, in place of what was saved under it."""
        if not self._found("_index/pivots"):
            pivots = choose_pivots(rows.where(F.col(vector).isNotNull()), rows.count(), key, vector)
            table = self.spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(pivots)], "cell int, v array<double>")
            table.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_index/pivots")
        placed = self._cells(-1.0).placed(rows, key, vector).withColumn("v", F.col("v").cast("array<double>")).withColumn("added", F.lit(number))
        self._save(placed, f"{number}-0", number)

    def compact(self, upto: int) -> None:
        """The parts with batches up to a number as one, with one file a cell and writing task; what it replaces is deleted."""
        old = {n: span for n, span in self.parts().items() if span[1] <= upto}
        if len(old) < 2:
            return
        last, version = max(span[1] for span in old.values()), 1 + max(int(n.split("-")[1]) for n in old)
        self._save(self._read(list(old)).repartition("cell"), f"{last}-{version}", min(span[0] for span in old.values()))
        for name in old:
            for path in (f"_index/manifest/{name}", f"part={name}"):
                self._files.delete(self._path(f"{self.path}/{path}"), True)
