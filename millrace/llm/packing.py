"""Packing documents into sequences of fixed length by cutting-stock column generation.

Documents become token ids and an end id; texts longer than a sequence are cut into whole
sequences and a rest. Only lengths then matter: the histogram of piece lengths, in classes
of UNIT tokens, goes to the driver (at most capacity / UNIT numbers, whatever the input).
There a linear program over packing patterns is solved by the revised simplex method; an
unbounded knapsack (dynamic programming over the capacity) prices new patterns, and the
bound of Farley stops it within GAP of the optimum. Pattern counts are rounded down; what
that leaves is packed best-fit decreasing into single patterns. Pieces are ranked within
their class, and rank intervals of a class belong to the slots of patterns, so each piece
finds its sequence from (class, rank) alone.

Skew: a class may hold any share of the rows; ranks come from counts by (class, salt) and a
numbering inside each. Ids are never shuffled.

Nulls, ties, empty input: a null text is the empty text, one piece with the end id alone;
repeated rows are pieces of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_batches, materialise, mix64, powers, text_chunks, trimmed

UNIT = 8
GAP = 5e-4
CACHED_WORDS = 600_000
CHUNK_BYTES, CHUNK_ROWS = 1 << 20, 4096

#: The tokenizer's pattern of the parts of a word (fixed value).
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_IS_MARK = np.isin(np.arange(256), np.frombuffer(b".,;:!?", np.uint8))
_IS_ALNUM = np.array([chr(b).isalnum() and b < 128 for b in range(256)])


def word_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, length, text number) of words; marks at the end of a word after a letter or digit are units of their own."""
    inside = (data != 32) & ((data < 9) | (data > 13))
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    opens[edges] = inside[edges]
    at = np.flatnonzero(inside)
    if not len(at):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    letters = data[at]
    begins = np.flatnonzero(opens[at])
    last = np.maximum.reduceat(np.where(_IS_MARK[letters], -1, np.arange(len(letters))), begins)
    ends = np.append(begins[1:], len(letters))
    cut = (last >= 0) & (last + 1 < ends)
    cut[cut] = _IS_ALNUM[letters[last[cut]]]
    begins = np.sort(np.concatenate([begins, last[cut] + 1]))
    lengths = np.diff(np.append(begins, len(letters)))
    small = letters + ((letters >= 65) & (letters <= 90)).astype(np.uint8) * np.uint8(32)
    place = np.arange(len(letters)) - np.repeat(begins, lengths)
    terms = (small.astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()))[place]
    hashes = mix64(np.add.reduceat(terms, begins) ^ (lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    return hashes, at[begins], lengths, np.searchsorted(offsets, at[begins], "right") - 1


class WordTokens:
    """Token ids by the given tokenizer, each distinct word (by a 64-bit hash, A-Z lower-cased) encoded once while it is held.

    Valid for tokenizers that drop case and white space and treat words apart, as word-level BPE
    with word-end marks does; the tests compare it with whole-text encoding.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.index: dict[int, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 15, np.int64)
        self.used = 0

    def learn(self, keys: list[int], words: list[str]) -> None:
        """Encode new words, all in one text: each part of a word has one token that ends a word, and parts are counted beforehand."""
        parts = np.array([1 if w.isalpha() else len(_PARTS.findall(unicodedata.normalize("NFC", w).lower())) for w in words], np.int64)
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) == parts.sum() and not any("<|" in w for w in words):
            lengths = np.diff(np.concatenate([[0], ends])[np.cumsum(parts)], prepend=0)
        else:  # the tokenizer sees parts otherwise: word by word then
            each = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            ids, lengths = np.array([i for x in each for i in x], np.uint32), np.array([len(x) for x in each], np.int64)
        n = len(self.index)
        while n + len(words) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[n + 1 : n + 1 + len(words)] = self.used + np.cumsum(lengths)
        self.used += len(ids)
        self.index.update(zip(keys, range(n, n + len(words)), strict=True))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each text."""
        hashes, first, size, owner = word_units(data, offsets)
        if len(self.index) > CACHED_WORDS:
            self.clear()
        codes, unlike = pd.factorize(hashes)
        numbers = np.fromiter((self.index.get(h, -1) for h in unlike.tolist()), np.int64, len(unlike))
        if (new := np.flatnonzero(numbers < 0)).size:
            where = np.zeros(len(unlike), np.int64)
            where[codes[::-1]] = np.arange(len(codes))[::-1]
            raw = data.tobytes()
            words = [raw[a : a + n].decode("utf-8", "replace") for a, n in zip(first[where[new]].tolist(), size[where[new]].tolist(), strict=True)]
            self.learn(unlike[new].tolist(), words)
            numbers[new] = np.arange(len(self.index) - len(new), len(self.index))
        at = numbers[codes]
        begin = self.starts[at]
        lengths = self.starts[at + 1] - begin
        ends = np.cumsum(lengths)
        ids = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + lengths, lengths)]
        bounds = np.concatenate([[0], ends])[np.searchsorted(owner, np.arange(len(offsets)))]
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def encode_texts(self, texts: list[str]) -> list[list[int]]:
        raw = [t.encode() for t in texts]
        return [x.tolist() for x in self.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))]


_TOKENS: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One for each worker process."""
    if path not in _TOKENS:
        _TOKENS[path] = WordTokens(path)
    return _TOKENS[path]


def _pieces(tokenizer: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(tokenizer)
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(1), CHUNK_BYTES, CHUNK_ROWS):
                part = batch.slice(first, end - first)
                out: list[tuple] = []
                for key, row, ids in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), tokens.encode(data, offsets), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(ids), capacity):
                        piece = ids[start : start + capacity]
                        out.append((key, row, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of greatest value: an unbounded knapsack by dynamic programming over the capacity."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for w in range(1, capacity + 1):
        fits = int(np.searchsorted(sizes, w, "right"))
        if fits:
            gain = best[w - sizes[:fits]] + values[:fits]
            k = int(gain.argmax())
            if gain[k] > best[w - 1]:
                best[w], pick[w] = gain[k], k
                continue
        best[w] = best[w - 1]
    counts, w = np.zeros(len(sizes)), capacity
    while w > 0:
        if pick[w] < 0:
            w -= 1
        else:
            counts[pick[w]] += 1
            w -= sizes[pick[w]]
    return float(best[capacity]), counts


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP, most: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows: counts by class) and how often each is used (fractions) in a nearly least number of sequences."""
    fill = capacity // sizes
    basis, inverse = np.diag(fill).astype(float), np.diag(1.0 / fill)
    level = demand / fill
    for _ in range(most):
        duals = inverse.sum(axis=0)
        value, pattern = price(duals, sizes, capacity)
        if value <= 1.0 + gap:  # level.sum() / value is a lower bound
            break
        step = inverse @ pattern
        ratio = np.where(step > 1e-10, np.maximum(level, 0.0) / np.where(step > 1e-10, step, 1.0), np.inf)
        out = int(ratio.argmin())
        level = level - ratio[out] * step
        level[out] = ratio[out]
        row = inverse[out] / step[out]
        inverse = inverse - np.outer(step, row)
        inverse[out] = row
        basis[:, out] = pattern
    return basis.T.astype(np.int64), np.maximum(level, 0.0)


def plan(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns with whole multiplicities that hold exactly the demand."""
    if not len(sizes):
        return []
    patterns, level = column_generation(sizes, demand.astype(float), capacity)
    left, out = demand.astype(np.int64).copy(), []
    for pattern, x in zip(patterns, np.floor(level + 1e-7).astype(np.int64), strict=True):
        used = pattern > 0
        x = min(int(x), int((left[used] // pattern[used]).min()) if used.any() else 0)
        if x:
            out.append((pattern, x))
            left -= x * pattern
    room: list[int] = []
    held: list[Counter] = []
    for k in np.argsort(-sizes):
        for _ in range(int(left[k])):
            fits = [(r - sizes[k], i) for i, r in enumerate(room) if r >= sizes[k]]
            if fits:
                i = min(fits)[1]
            else:
                i = len(room)
                room.append(capacity)
                held.append(Counter())
            room[i] -= int(sizes[k])
            held[i][int(k)] += 1
    for same, n in Counter(tuple(sorted(h.items())) for h in held).items():
        pattern = np.zeros(len(sizes), np.int64)
        for k, c in same:
            pattern[k] = c
        out.append((pattern, n))
    return out


def pack(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", capacity: int = 4096, end_id: int = 2, unit: int = UNIT) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    bounded_batches(docs.sparkSession)
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    pieces = plain.mapInArrow(trimmed(_pieces(tokenizer, capacity, end_id)), "doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long")
    pieces = materialise(pieces.withColumn("class", F.ceil(F.col("length") / unit).cast("int")), "pieces")
    salts = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("row", "start"), F.lit(salts)))
    counts = pieces.groupBy("class", "salt").agg(F.count("*").alias("n"))
    histogram = sorted((r[0], r[1]) for r in counts.groupBy("class").agg(F.sum("n")).collect())
    sizes, demand = np.array([h[0] for h in histogram], np.int64), np.array([h[1] for h in histogram], np.int64)
    begins: dict[int, list[tuple[int, int, int]]] = {int(s): [] for s in sizes}
    taken, base = np.zeros(len(sizes), np.int64), 0
    for pattern, n in plan(sizes, demand, capacity // unit):
        for k in np.flatnonzero(pattern):
            begins[int(sizes[k])].append((int(taken[k]), int(pattern[k]), base))
            taken[k] += pattern[k] * n
        base += n
    slots = {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in begins.items()}

    @F.pandas_udf("long")
    def sequence(classes: pd.Series, ranks: pd.Series) -> pd.Series:
        out = np.zeros(len(classes), np.int64)
        kinds, rank = classes.to_numpy(), ranks.to_numpy(np.int64)
        for k in np.unique(kinds):
            rows = np.flatnonzero(kinds == k)
            first, each, base = slots[int(k)]
            at = np.searchsorted(first, rank[rows], "right") - 1
            out[rows] = base[at] + (rank[rows] - first[at]) // each[at]
        return pd.Series(out)

    before = Window.partitionBy("class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("class", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    numbered = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("class", "salt").orderBy("row", "start")) - 1)
    placed = numbered.join(shifts, ["class", "salt"]).withColumn("sequence_id", sequence("class", F.col("rank") + F.col("shift")))
    order = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "row", "start").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long").alias("offset")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset)
