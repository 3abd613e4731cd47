"""Writers. All are distributed; single_file gathers rows and is meant for small results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.relational import split_parts


def csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    flat = df.select(*((F.to_json(c) if t.startswith(("array", "map", "struct")) else F.col(c)).alias(c) for c, t in df.dtypes))
    (flat.coalesce(1) if single_file else flat).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def jsonl(df: DataFrame, path: str) -> None:
    """One object a line; null fields and letters beyond ASCII kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def xml(df: DataFrame, path: str, root: str = "Trials", row: str = "Trial", records: int = 100_000) -> None:
    """Files of at most so many records, as the XML source reads a file in one task."""
    df.write.mode("overwrite").format("xml").option("rootTag", root).option("rowTag", row).option("maxRecordsPerFile", records).save(path)


def report(metrics: DataFrame, path: str) -> None:
    """A one-row or small table of scores as a single JSON-lines file."""
    metrics.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def documents(df: DataFrame, path: str, document: str = "document") -> None:
    """JSON texts, one a line."""
    df.select(document).write.mode("overwrite").text(path)


def by_key(df: DataFrame, path: str, *keys: str) -> None:
    """A folder for each key, as CSV; rows are dealt by the keys first, so each folder has few files."""
    df.repartition(*keys).write.mode("overwrite").option("header", "true").partitionBy(*keys).csv(path)


def by_folder(df: DataFrame, path: str, source: str = "file_path") -> None:
    """A folder for each folder that rows were read from."""
    df.withColumn("folder", F.element_at(F.split(source, "/"), -2)).write.mode("overwrite").partitionBy("folder").parquet(path)


def parts(df: DataFrame, path: str, n: int, *order: str) -> None:
    """n parts of equal row ranges, the rest in the last."""
    split_parts(df, n, *order).write.mode("overwrite").option("header", "true").partitionBy("part").csv(path)
