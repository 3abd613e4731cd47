"""Embeddings kept on disk by the content of their texts, so that each distinct text is encoded once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.similarity import Encoder, embedded, hash_encoder
from millrace.storage import materialise

#: A text of more than one row in so many is joined by broadcast; there can be at most as many such texts.
HEAVY = 1000


class EmbeddingCache:
    """Vectors by the SHA-256 of their texts, in one folder a batch.

    A batch encodes only texts that no other batch holds. Batches are written one at a time; a batch that is run again replaces
    its own folder and gives the same vectors. Another model needs another path, as vectors of unlike models don't compare.
    A null text counts as empty; repeated texts share a vector; texts of any length are hashed and encoded whole.
    """

    def __init__(self, spark: SparkSession, path: str, make: Callable[[], Encoder] = hash_encoder):
        self.spark, self.path, self.make = spark, path.rstrip("/"), make
        root = self._path(self.path)
        self._files = root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def batches(self) -> list[int]:
        """Numbers of the batches that were written to their end."""
        found = self._files.globStatus(self._path(f"{self.path}/batch=*/_SUCCESS")) or []
        return sorted(int(status.getPath().getParent().getName().partition("=")[2]) for status in found)

    def vectors(self, batches: list[int]) -> DataFrame:
        """(hash, vector) of the batches, each hash once."""
        read = self.spark.read.schema("hash binary, vector array<float>")
        return read.parquet(*(f"{self.path}/batch={n}" for n in batches)) if batches else self.spark.createDataFrame([], "hash binary, vector array<float>")

    def add(self, df: DataFrame, text: Column, batch: int) -> int:
        """Encode the texts of df that no other batch holds, as the batch of this number; returns how many that were.

        Texts are made distinct within each task before they are shuffled, so a text of many rows is a row a task.
        """
        texts = df.select(_whole(text).alias("text")).groupBy(_hash(F.col("text")).alias("hash")).agg(F.first("text").alias("text"))
        others = [n for n in self.batches() if n != batch]
        if others:
            texts = texts.join(self.vectors(others).select("hash"), "hash", "left_anti")
        path = f"{self.path}/batch={batch}"
        embedded(texts, F.col("text"), "vector", self.make).select("hash", "vector").write.mode("overwrite").parquet(path)
        return self.vectors([batch]).count()

    def attach(self, df: DataFrame, text: Column, name: str = "embedding") -> DataFrame:
        """df with its vectors as a last column, null for texts that no batch holds.

        Rows of the few texts that make up much of df meet their vectors by broadcast (at most HEAVY vectors); all others are
        joined by hash, so that no task gets the rows of a text with a fixed share of them. df is written once.
        """
        if name in df.columns:
            raise ValueError(f"there is a column {name} already")
        rows = materialise(df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), _hash(_whole(text)).alias("hash")), "hashed")
        vectors = self.vectors(self.batches())
        heavy = rows.groupBy("hash").count().where(F.col("count") * HEAVY > rows.count()).select("hash")
        hot = materialise(heavy.join(vectors, "hash", "left"), "heavy")
        met = rows.join(F.broadcast(hot), "hash").unionByName(rows.join(F.broadcast(hot.select("hash")), "hash", "left_anti").join(vectors, "hash", "left"))
        return met.select("row.*", F.col("vector").alias(name))


def _whole(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def _hash(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))
