"""The embedding cache: what is encoded, what is kept, what rows get."""

from __future__ import annotations

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators.embeddings import HEAVY, EmbeddingCache
from millrace.operators.similarity import hash_encoder


def logging_encoder(folder):
    """An encoder that leaves the texts it is given in files of the folder."""

    def make():
        encode = hash_encoder(8)

        def run(texts):
            (folder / uuid.uuid4().hex).write_text("".join(f"{t!r}\n" for t in texts))
            return encode(texts)

        return run

    return make


def said(folder):
    return sorted(line for f in folder.iterdir() for line in f.read_text().splitlines())


@pytest.fixture
def cache(spark, tmp_path):
    (tmp_path / "said").mkdir()
    return EmbeddingCache(spark, f"file://{tmp_path}/cache", logging_encoder(tmp_path / "said")), tmp_path / "said"


def test_only_new_texts_are_encoded(spark, cache):
    made, folder = cache
    first = spark.range(1000).select(F.concat(F.lit("text "), F.col("id") % 500).alias("t")).repartition(7)
    assert made.add(first, F.col("t"), 1) == 500 and len(said(folder)) == 500
    more = first.union(spark.range(10).select(F.concat(F.lit("new "), F.col("id") % 5).alias("t")))  # 1 % new rows
    assert made.add(more, F.col("t"), 2) == 5 and len(said(folder)) == 505 == len(set(said(folder)))
    assert made.add(more, F.col("t"), 3) == 0 and len(said(folder)) == 505 and made.batches() == [1, 2, 3]
    before = made.vectors([1, 2, 3]).orderBy("hash").collect()
    for again in (2, 1):  # batches that are run again replace their own rows only
        made.add(more if again == 2 else first, F.col("t"), again)
    assert made.vectors([1, 2, 3]).orderBy("hash").collect() == before
    encode = hash_encoder(8)
    rows = made.attach(more, F.col("t")).collect()
    assert len(rows) == 1010 and all(np.allclose(r.embedding, encode([r.t])[0]) for r in rows)


def test_odd_texts_and_tables(spark, cache):
    made, folder = cache
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "long " * 100_000, "y"), (4, "long " * 100_000, "y"), (None, " ", None)], "`a.b` int, text string, hash string")
    assert made.attach(df, F.col("text")).where("embedding is null").count() == 5  # nothing is held yet
    assert made.add(df.where("false"), F.col("text"), 1) == 0 and made.add(df, F.col("text"), 2) == 3
    out = made.attach(df, F.col("text"), "v")
    assert out.columns == ["a.b", "text", "hash", "v"] and out.where("v is null").count() == 0
    got = {r["a.b"]: r.v for r in out.collect()}
    assert got[1] == got[2] and got[3] == got[4] and len(got) == 5
    assert made.attach(df.where("false"), F.col("text")).count() == 0
    with pytest.raises(ValueError, match="already"):
        made.attach(df, F.col("text"), "hash")


def test_a_text_of_many_rows_is_no_task_of_its_own(spark, cache):
    """Broadcasts and skew joins off: no task of the join by hash gets the rows of the frequent text."""
    made, _ = cache
    df = spark.range(12_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("t"))
    made.add(df, F.col("t"), 1)
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(old, ("false", "-1", "8"), strict=True):
            spark.conf.set(k, v)
        out = made.attach(df, F.col("t"))
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == 12_000 and out.where("embedding is null").count() == 0
        assert max(sizes) < 12_000 // 3 and 4000 * HEAVY > 12_000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
