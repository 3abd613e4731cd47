"""Exact dedup by two-pass Bloom filtering.

Pass 1 puts every row's digest into a Bloom filter that tells bits set once from bits set
again. Pass 2 probes it: a row with a bit that was set only once is unique and passes
straight through; only the others are shuffled, as narrow rows, and compared exactly.

The filter has about BITS_PER_ROW bits a row and never more than MAX_BITS (64 MB); past
that it lets more rows through to the exact comparison, so it can cost a larger shuffle of
narrow rows but never changes a result.

Nulls, ties, empty input: a null text counts as empty text; rows without an id sort after
all ids; of rows with equal id and text one stays. An empty table gives an empty result. Very
long texts are hashed whole. exact_duplicates() reads no other column; drop_exact_duplicates()
returns all columns unchanged, and only names beginning with two underscores (__name, __maybe,
__digest, __id, __sum, __stays, __n) are its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import attach_groups, materialise, sieved, single_spaced, trimmed

BITS_PER_ROW = 16
MAX_BITS = 1 << 29
SHARD_BITS = 1 << 16
DIGEST = "__digest"


def digest(text: Column) -> Column:
    """SHA-256 of the text with runs of white space as one space."""
    return F.unhex(F.sha2(single_spaced(text), 256))


def _positions(digests: pa.Array, bits: int) -> np.ndarray:
    """Four bit positions a row, from the four 64-bit words of its SHA-256."""
    return np.frombuffer(b"".join(digests.to_pylist()), "<u8").reshape(-1, 4) % np.uint64(bits)


def _mark(bitmap: np.ndarray, positions: np.ndarray) -> None:
    """Set the bits at sorted, distinct positions."""
    if len(positions):
        at = (positions >> np.uint64(3)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        bitmap[at[first]] |= np.bitwise_or.reduceat(np.uint8(1) << (positions & np.uint64(7)).astype(np.uint8), first)


def _test(bitmap: np.ndarray, positions: np.ndarray) -> np.ndarray:
    return (bitmap[(positions >> np.uint64(3)).astype(np.int64)] >> (positions & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def repeat_filter(digests: DataFrame, n_rows: int, max_bits: int = MAX_BITS) -> tuple[bytes, int]:
    """Pass 1: the bits that at least two rows set. Its size is bounded by max_bits."""
    bits = SHARD_BITS
    while bits < min(n_rows * BITS_PER_ROW, max_bits):
        bits *= 2
    shard = SHARD_BITS // 8

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, again = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            if batch.num_rows:
                found, count = np.unique(_positions(batch.column(0), bits), return_counts=True)
                _mark(again, found[(count > 1) | _test(once, found)])
                _mark(once, found)
        for k in np.flatnonzero(once.reshape(-1, shard).any(axis=1)).tolist():
            part = slice(k * shard, (k + 1) * shard)
            pair = [[zlib.compress(x[part].tobytes(), 1)] for x in (once, again)]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), *(pa.array(x, pa.binary()) for x in pair)], ["shard", "once", "again"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, once, again = None, None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([held], pa.int64()), pa.array([again.tobytes()], pa.binary())], ["shard", "again"])
        for batch in batches:
            for k, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = (np.frombuffer(zlib.decompress(z), np.uint8) for z in (x, y))
                if k != held:
                    if held is not None:
                        yield out()
                    held, once, again = k, x.copy(), y.copy()
                else:
                    again |= y | (once & x)
                    once |= x
        if held is not None:
            yield out()

    shards = digests.select(DIGEST).mapInArrow(trimmed(fill), "shard long, once binary, again binary")
    merged = shards.repartition("shard").sortWithinPartitions("shard").mapInArrow(trimmed(merge), "shard long, again binary")
    whole = bytearray(bits // 8)
    for row in merged.toLocalIterator():
        whole[row.shard * shard : (row.shard + 1) * shard] = row.again
    return bytes(whole), bits


def maybe_repeated(digests: DataFrame, n_rows: int, max_bits: int = MAX_BITS):
    """Pass 2: a column function that is false only for digests that certainly occur once."""
    bitmap, bits = repeat_filter(digests, n_rows, max_bits)
    shared = digests.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def probe(digests: pd.Series) -> pd.Series:
        if not len(digests):
            return pd.Series([], dtype=bool)
        return pd.Series(_test(np.frombuffer(shared.value, np.uint8), _positions(pa.array(digests, pa.binary()), bits)).all(axis=1))

    return probe


def exact_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", max_bits: int = MAX_BITS) -> DataFrame:
    """One row a document: key, digest (SHA-256 of the normalised text), keep_id, group_size, kept."""
    rows = materialise(docs.select(F.col(key).alias("doc_id"), digest(F.col(text)).alias(DIGEST), F.monotonically_increasing_id().alias("__row")), "digests")
    n_rows = rows.count()
    probe = maybe_repeated(rows, n_rows, max_bits)
    flagged = rows.withColumn("__maybe", probe(DIGEST))
    ranked = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("__row").alias("row"))
    groups = flagged.where("__maybe").groupBy(DIGEST).agg(F.min(ranked).alias("__keep"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = materialise(groups, "groups")
    alone = flagged.where("not __maybe").select("doc_id", DIGEST, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    shared = attach_groups(flagged.where("__maybe").drop("__maybe"), groups, [DIGEST], n_rows, "group_size").select(
        "doc_id",
        DIGEST,
        F.when(F.col("__keep").isNull(), F.col("doc_id")).otherwise(F.col("__keep.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("__keep").isNull() | (F.col("__keep.row") == F.col("__row"))).alias("kept"),
    )
    return alone.unionByName(shared).withColumnRenamed(DIGEST, "digest")


def drop_exact_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of docs that stay, all their columns unchanged.

    Which go is decided on narrow rows. Rows with an id that none of these has pass straight
    through, without being hashed again; the others meet the list of rows that go by id and digest.
    """
    found = exact_duplicates(docs, text, key, max_bits)
    # Of rows with equal id and text, one stays or none does; so all but one of a kept group go, by number.
    fate = found.groupBy("doc_id", "digest").agg(F.max("kept").alias("__stays"), F.count("*").alias("__n")).where("not __stays or __n > 1")
    fate = materialise(fate.withColumnsRenamed({"doc_id": "__id", "digest": "__sum"}), "dropped")
    ids = fate.select(F.coalesce(F.xxhash64("__id"), F.lit(0)).alias("__name")).distinct()
    marked = sieved(docs.withColumn("__name", F.xxhash64(F.col(key))), "__name", ids, "__maybe")
    alone = marked.where("not __maybe").select(*docs.columns)
    rest = marked.where("__maybe").withColumn(DIGEST, digest(F.col(text)))
    same = F.col(key).eqNullSafe(F.col("__id")) & (F.col(DIGEST) == F.col("__sum"))
    unlike = rest.join(fate, same, "left_anti").select(*docs.columns)
    repeated = fate.where("__stays")
    if repeated.isEmpty():
        return alone.unionByName(unlike)
    first = rest.join(repeated, same, "left_semi").dropDuplicates([key, DIGEST]).select(*docs.columns)
    return alone.unionByName(unlike).unionByName(first)
