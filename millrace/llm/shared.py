"""Helpers that several corpus operators use: shared storage, skew-safe lookups, text chunks."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.storage import clear_scratch, materialise, release, scratch_dir  # noqa: F401  (for the operators)

#: At most this many groups are broadcast by attach_groups(): a proven bound, whatever the input.
HEAVY_GROUPS = 100_000
BATCH_ROWS, BATCH_BYTES = "1000", "8m"


def shared_uri(spark: SparkSession) -> str:
    """scratch_dir() as a URI with its scheme, for readers and writers other than Spark's."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return uri.replace("file:/", "file:///") if uri.startswith("file:/") and not uri.startswith("file://") else uri


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches that suit rows with long texts: BATCH_ROWS rows and BATCH_BYTES at most, set where the session has Spark's defaults."""
    for key, default, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", BATCH_BYTES)):
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, value)


def trimmed(run):
    """run, a function from batches to batches, that gives freed memory back at the end of each task: workers live on between stages."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def single_spaced(text: Column) -> Column:
    """Runs of white space (0x20, 0x09 to 0x0D) become one space; null becomes the empty text. Byte searches, with a pattern only where spaces adjoin."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(c), F.lit(" "))
    return F.when(F.contains(out, F.lit("  ")), F.regexp_replace(out, " {2,}", " ")).otherwise(out)


def word_count(text: Column) -> Column:
    """Number of runs of bytes other than white space (0x20, 0x09 to 0x0D)."""
    out = F.trim(single_spaced(text))
    return F.when(out == "", F.lit(0)).otherwise(F.octet_length(out) - F.octet_length(F.replace(out, F.lit(" "), F.lit(""))) + 1).cast("long")


def attach_groups(rows: DataFrame, groups: DataFrame, keys: list[str], n_rows: int, size: str) -> DataFrame:
    """rows left join groups (unique by keys; size: rows of the group), safe for hot groups.

    Groups of more than n_rows / HEAVY_GROUPS rows are broadcast: there can be at most
    HEAVY_GROUPS of them. All others are joined by a shuffle, in which no key is hot.
    """
    least = max(1, -(-n_rows // HEAVY_GROUPS))
    heavy = F.broadcast(groups.where(F.col(size) >= least))
    if least <= 1:
        return rows.join(heavy, keys, "left")
    hot = rows.join(heavy, keys, "inner")
    rest = rows.join(heavy.select(*keys), keys, "left_anti")
    return hot.unionByName(rest.join(groups.where(F.col(size) < least), keys, "left"))


def sieved(rows: DataFrame, key: str, wanted: DataFrame, flag: str, most_bits: int = 1 << 29) -> DataFrame:
    """rows with a column flag, false only where the key is certainly not among the keys of wanted (one column; at 16 bits a key one in 17 others is true too).

    For joins of wide rows: only what passes needs a shuffle. The bitmap is broadcast; it has
    at most most_bits bits (64 MB), and lets more pass where wanted holds more keys than that suits.
    """
    bits = 1 << 15
    while bits < min(16 * wanted.count(), most_bits):
        bits *= 2
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    maps = wanted.select(at(F.col(wanted.columns[0])).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("__map"))
    marked = rows.withColumn("__at", at(F.col(key))).withColumn("__own", F.bitmap_bucket_number("__at")).withColumn("__bit", F.bitmap_bit_position("__at").cast("int"))
    byte = F.expr("cast(conv(hex(substring(__map, cast(floor(__bit / 8) as int) + 1, 1)), 16, 10) as int)")
    found = marked.join(F.broadcast(maps), F.col("__own") == F.col("__bucket"), "left")
    return found.withColumn(flag, F.coalesce(F.call_function("getbit", byte, F.col("__bit") % 8) == 1, F.lit(False))).drop("__at", "__own", "__bit", "__bucket", "__map")


def sieve(rows: DataFrame, key: str, wanted: DataFrame, most_bits: int = 1 << 29) -> DataFrame:
    """The rows that pass sieved(), for a semi-join."""
    return sieved(rows, key, wanted, "__passes", most_bits).where("__passes").select(*rows.columns)


def text_chunks(column: pa.Array, limit: int, most: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of at most most rows with about limit bytes of text; null is empty.

    Bounds what numpy holds at once by the limit or the longest single text, whichever is more.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        end = min(first + most, max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def finite_matrix(column: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, matrix) of the lists of doubles that have so many entries, none null, NaN or infinite."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == dimensions)
    m = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dimensions)
    finite = np.isfinite(m).all(axis=1)
    return rows[finite], m[finite]


def list_column(matrix: np.ndarray) -> pa.Array:
    """A matrix as a column of lists, one a row."""
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(width)), pa.array(matrix.ravel()))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd 64-bit base."""
    global _POWERS
    if n > len(_POWERS):
        grown = np.full(max(n, 64, 2 * len(_POWERS)), 0x9E3779B97F4A7C15, np.uint64)
        grown[0] = 1
        _POWERS = np.multiply.accumulate(grown)
    return _POWERS[:n]


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of the texts in data (A-Z lower-cased), and each word's text number.

    Words are runs of bytes other than space and 0x09 to 0x0D; a text's end ends a word.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = (data != 32) & ((data < 9) | (data > 13))
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    edges = offsets[:-1][(offsets[:-1] < len(data))]
    opens[edges] = inside[edges]
    starts = np.flatnonzero(opens)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    letters = data[inside]
    letters = letters + ((letters >= 65) & (letters <= 90)).astype(np.uint8) * np.uint8(32)
    begins = np.flatnonzero(opens[inside])
    lengths = np.diff(np.append(begins, len(letters)))
    place = np.arange(len(letters)) - np.repeat(begins, lengths)
    terms = (letters.astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()))[place]
    hashes = mix64(np.add.reduceat(terms, begins) ^ (lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    return hashes, np.searchsorted(offsets, starts, "right") - 1
