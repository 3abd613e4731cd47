"""Byte-level BPE encoding of texts of any length by overlapping chunks, and decoding.

A tokenizer is a file of ranks and a pattern, each match of which is encoded by itself. Texts
above CHUNK characters are cut into chunks of CHUNK characters that overlap the next by OVERLAP,
and chunks, not texts, are the rows that tasks work on. Pre-tokenising starts blindly at a chunk's
first character, so its first boundaries may be wrong. But a match depends only on the text from
its first character on, so from the first boundary that a chunk has in common with the one before,
both go on alike, and that one is right there by the same argument, back to the text's beginning.
A text is cut into pieces at these common boundaries, each piece is encoded by itself, and the ids
are joined in order. Boundaries within LOOK characters of a chunk's end are not trusted, as the
pattern may have looked beyond.

Where two chunks have no common boundary, as within a match longer than OVERLAP, they are joined
into one and scanned again, until all neighbours meet; at worst a text becomes one chunk.

The pattern's classes of characters are read from the encoder's own library and written out as
ranges, as libraries differ in the version of Unicode they know.

Shuffles: chunks of long texts meet their two boundaries by (row, chunk), a key of one row, and
the ids of a long text meet to be joined; short texts pass straight through.

Nulls, ties, empty input: a null text is the empty text, of no ids; rows without id, with equal
ids or with equal texts are rows of their own; very long texts need the memory of the text and its
ids; an empty table gives an empty result. Of the input only the id and the text are read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, materialise, release, trimmed

CHUNK, OVERLAP, LOOK = 16_384, 512, 2
#: Bytes of ids or text in a batch of results.
BATCH = 1 << 22

_TOKENIZERS: dict[tuple[str, str], Tokenizer] = {}


def _ranges(chars: str) -> str:
    """Characters as the inside of a class of a regular expression."""
    at = np.unique(np.frombuffer(chars.encode("utf-32-le"), np.uint32)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(at) > 1)
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(at[np.append(0, cuts + 1)], at[np.append(cuts, len(at) - 1)], strict=True))


def spelt_out(pattern: str) -> str:
    r"""The pattern with its classes \p{..}, \s and \S as ranges of the characters that the encoder's library counts among them."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    bytes_only = {bytes([i]): i for i in range(256)}
    members: dict[str, str] = {}

    def ranges(name: str) -> str:
        if name not in members:
            found = tiktoken.Encoding(name, pat_str=name, mergeable_ranks=bytes_only, special_tokens={})
            members[name] = _ranges(found.decode(found.encode_ordinary(every)))  # what doesn't match is skipped
        return members[name]

    out, inside = [], False
    for token in re.findall(r"\\p\{\w+\}|\\.|.", pattern, re.S):
        if token == r"\S" and not inside:
            out.append(f"[^{ranges(chr(92) + 's')}]")
        elif token == r"\s" or token.startswith(r"\p"):
            out.append(ranges(token) if inside else f"[{ranges(token)}]")
        else:
            inside = token == "[" or (inside and token != "]")
            out.append(token)
    return "".join(out)


class Tokenizer:
    """Of a file of ranks (a line each: base64 of the bytes, rank) and a pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern, self._split = pattern, None
        self.bytes = np.frombuffer(b"".join(ranks), np.uint8)
        lengths = np.zeros(max(ranks.values()) + 2, np.int64)
        starts = np.zeros_like(lengths)
        at = 0
        for token, rank in ranks.items():
            starts[rank], lengths[rank] = at, len(token)
            at += len(token)
        self.starts, self.lengths = starts, lengths

    def boundaries(self, text: str) -> np.ndarray:
        """0 and the ends of the matches."""
        if self._split is None:
            self._split = re.compile(spelt_out(self.pattern))
        return np.fromiter((0, *(m.end() for m in self._split.finditer(text))), np.int64)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        at = np.frombuffer(ids, "<u4")
        lengths = self.lengths[at]
        if len(at) and not lengths.all():
            raise ValueError("an id without a token")
        ends = np.cumsum(lengths)
        return self.bytes[np.arange(ends[-1] if len(at) else 0) + np.repeat(self.starts[at] - ends + lengths, lengths)].tobytes()


def tokenizer(path: str, pattern: str) -> Tokenizer:
    """One for each worker process."""
    if (path, pattern) not in _TOKENIZERS:
        _TOKENIZERS[path, pattern] = Tokenizer(path, pattern)
    return _TOKENIZERS[path, pattern]


def _encoded(path: str, pattern: str, passed: int):
    """The first passed columns, and the ids of the texts in the column behind them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path, pattern).encode
        for batch in batches:
            texts, first, held = batch.column(passed), 0, []
            for i in range(len(texts)):
                held.append(encode(texts[i].as_py() or ""))
                if i + 1 == len(texts) or sum(map(len, held[-64:])) > BATCH or len(held) >= 256:
                    columns = [c.slice(first, len(held)) for c in batch.columns[:passed]]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([len(x) // 4 for x in held], pa.int64()), pa.array(held, pa.binary())], [*batch.schema.names[:passed], "n_tokens", "ids"])
                    first, held = i + 1, []

    return run


def _cut(chunk: int, overlap: int):
    """From (id, row, text) batches: (id, row, chunk, begin, step, last, body); a body holds step characters and the overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (row, cell) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), strict=True)):
                text = cell.as_py()
                begins = range(0, max(1, len(text) - overlap), chunk)
                for first in range(0, len(begins), 64):
                    some = begins[first : first + 64]
                    numbers = np.arange(first, first + len(some))
                    name = batch.column(0).take(pa.array([i] * len(some)))
                    narrow = [pa.array([row] * len(some), pa.int64()), pa.array(numbers.astype(np.int32)), pa.array(list(some), pa.int64()), pa.array([chunk] * len(some), pa.int64()), pa.array(numbers == len(begins) - 1)]
                    yield pa.RecordBatch.from_arrays([name, *narrow, pa.array([text[b : b + chunk + overlap] for b in some])], ["id", "row", "chunk", "begin", "step", "last", "body"])

    return run


_CHUNKS = "row long, chunk int, begin long, step long, last boolean, body string"


def _scanned(path: str, pattern: str, overlap: int, look: int):
    """From chunks: (row, chunk, begin, last, length, head, tail), boundaries near the begin and in what the next chunk has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = tokenizer(path, pattern).boundaries
        for batch in batches:
            heads, tails, lengths = [], [], []
            for begin, step, last, body in zip(*(batch.column(c).to_pylist() for c in ("begin", "step", "last")), batch.column("body"), strict=True):
                text = body.as_py()
                at = split(text)
                at = at[at <= len(text) - (0 if last else look)]
                closed = lambda some: [begin + i for i in some.tolist() if not i or not text[i - 1].isspace()]  # noqa: B023, E731
                heads.append(closed(at[at <= overlap]))
                tails.append(closed(at[at >= step]))
                lengths.append(len(text))
            longs = pa.list_(pa.int64())
            narrow = [batch.column(c) for c in ("row", "chunk", "begin", "last")]
            yield pa.RecordBatch.from_arrays([*narrow, pa.array(lengths, pa.int64()), pa.array(heads, longs), pa.array(tails, longs)], ["row", "chunk", "begin", "last", "length", "head", "tail"])

    return run


_SCANNED = "row long, chunk int, begin long, last boolean, length long, head array<long>, tail array<long>"


def _joined(key: tuple, table: pa.Table) -> pa.Table:
    """Chunks that follow each other as one: all but the last without their overlap."""
    rows = sorted(table.to_pylist(), key=lambda r: r["begin"])
    body = "".join(r["body"][: r["step"]] for r in rows[:-1]) + rows[-1]["body"]
    first, end = rows[0], rows[-1]
    out = {"row": first["row"], "chunk": key[1].as_py(), "begin": first["begin"], "step": end["begin"] + end["step"] - first["begin"], "last": end["last"], "body": body}
    return pa.Table.from_pylist([out], pa.schema([("row", pa.int64()), ("chunk", pa.int32()), ("begin", pa.int64()), ("step", pa.int64()), ("last", pa.bool_()), ("body", pa.string())]))


def _meetings(scanned: DataFrame) -> DataFrame:
    """(row, chunk, begin, last, length, meets): meets is the first boundary in common with the chunk before, null if there is none; 0 for the first chunk."""
    before = scanned.select("row", (F.col("chunk") + 1).alias("chunk"), F.col("tail").alias("before"))
    meets = F.when(F.col("chunk") == 0, F.lit(0).cast("long")).otherwise(F.array_min(F.array_intersect("head", "before")))
    return scanned.join(before, ["row", "chunk"], "left").select("row", "chunk", "begin", "last", "length", meets.alias("meets"))


def stitched(chunks: DataFrame, path: str, pattern: str, overlap: int = OVERLAP) -> tuple[DataFrame, DataFrame]:
    """(chunks, meetings): the chunks, some joined, so that all neighbours meet, and where they do."""
    done: list[tuple[DataFrame, DataFrame]] = []
    while True:
        scanned = materialise(chunks.mapInArrow(trimmed(_scanned(path, pattern, overlap, LOOK)), _SCANNED), "scanned")
        met = materialise(_meetings(scanned), "meetings")
        release(scanned)
        apart = met.where("meets is null").select("row").distinct()
        if apart.isEmpty():
            break
        done.append((chunks.join(apart, "row", "left_anti"), met.join(apart, "row", "left_anti")))
        # What is left is numbered by how many meetings there are before, in the narrow rows of a text.
        runs = met.join(apart, "row", "left_semi").selectExpr("row", "chunk", "cast(sum(if(meets is null, 0, 1)) over (partition by row order by chunk) as int) - 1 as run")
        chunks = _written(chunks.join(runs, ["row", "chunk"]).groupBy("row", "run").applyInArrow(_joined, _CHUNKS))
    for a, b in done:
        chunks, met = chunks.unionByName(a), met.unionByName(b)
    return chunks, met


def _written(chunks: DataFrame) -> DataFrame:
    """chunks in shared storage, in small row groups, so that the chunks of one text are many tasks' work."""
    return materialise(chunks, "chunks", **{"parquet.block.size": str(4 << 20)})


def _whole(key: tuple, table: pa.Table) -> pa.Table:
    """The ids of one text, joined in the order of its chunks."""
    order = np.argsort(table.column("chunk").to_numpy())
    ids = table.column("ids").combine_chunks() if table.num_rows else []
    out = b"".join(ids[int(i)].as_py() for i in order)
    return pa.table({"row": pa.array([key[0].as_py()], pa.int64()), "n_tokens": pa.array([len(out) // 4], pa.int64()), "ids": pa.array([out], pa.binary())})


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row a document: id, n_tokens, ids (binary: little-endian unsigned 32-bit integers), in any order."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    docs = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    is_long = F.length("text") > chunk + overlap
    short = docs.where(~is_long).mapInArrow(trimmed(_encoded(path, pattern, 1)), f"id {kind}, n_tokens long, ids binary")
    wide = docs.withColumn("row", F.monotonically_increasing_id()).where(is_long).select("id", "row", "text")
    cut = _written(wide.mapInArrow(trimmed(_cut(chunk, overlap)), f"id {kind}, {_CHUNKS}"))
    names = cut.where("chunk = 0").select("id", "row")
    chunks, met = stitched(cut.drop("id"), path, pattern, overlap)
    # A piece goes from where its chunk meets the one before to where the next one meets it.
    following = met.select("row", (F.col("chunk") - 1).alias("chunk"), F.col("meets").alias("until"))
    pieces = met.join(following, ["row", "chunk"], "left").select("row", "chunk", F.col("meets").alias("from"), F.coalesce("until", F.col("begin") + F.col("length")).alias("until"))
    texts = chunks.join(pieces, ["row", "chunk"]).select("row", "chunk", F.expr("substring(body, cast(from - begin + 1 as int), cast(until - from as int))").alias("piece"))
    ids = texts.mapInArrow(trimmed(_encoded(path, pattern, 2)), "row long, chunk int, n_tokens long, ids binary")
    whole = ids.select("row", "chunk", "ids").groupBy("row").applyInArrow(_whole, "row long, n_tokens long, ids binary")
    return short.unionByName(names.join(whole, "row").select("id", "n_tokens", "ids"))


def _decoded(path: str, pattern: str, n_columns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = tokenizer(path, pattern).decode
        for batch in batches:
            ids = batch.column(n_columns - 1)
            for i in range(0, len(batch), 64):
                part = batch.slice(i, 64)
                out = [decode(x.as_py()) if x.is_valid else None for x in ids.slice(i, 64)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """encoded with decoded (binary): the bytes of its ids one after another; null for null."""
    bounded_batches(encoded.sparkSession)
    rows = encoded.select(*(c for c in encoded.columns if c != ids), ids)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(trimmed(_decoded(path, pattern, len(rows.columns))), f"{kinds}, decoded binary")
