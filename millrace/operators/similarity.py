"""Embedding near-duplicates: cosine pairs, greedy and one-shot removal, within and across sets.

Pairs are found in blocks: rows are dealt to cells around pivots, cells to blocks, and each pair of
blocks with rows in reach of each other (see cells.py) is one task group, a matrix product in
numpy; only pairs above the threshold come back. Greedy removal in row order is the
lexicographically first maximal independent set of the pairs (Blelloch, Fineman and Shun 2012),
found component by component (see graph.py). Equal vectors are compared once: all but the first of
them go in any case, so large groups of copies cost no pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.numeric import cosine
from millrace.operators.cells import Blocks, celled, group_rows, matrix, real, unit
from millrace.operators.graph import scanned
from millrace.operators.leaders import led
from millrace.storage import materialise

BLOCK_ROWS = 4000
#: Rows of a block that meet another block at a time, and pairs that a task gathers before it hands them on.
AT_ONCE, HELD = 250, 100_000

Encoder = Callable[[list[str]], np.ndarray]


def _materialise(df: DataFrame) -> DataFrame:
    """df written to the shared folder of spark.checkpoint.dir and read again."""
    return materialise(df, "vectors")


def _groups(n: int, width: int = 1) -> int:
    return max(1, -(-n // group_rows(n, BLOCK_ROWS, width)))


def _unit(vectors: pd.Series) -> np.ndarray:
    return unit(np.array(vectors.tolist(), np.float64))


def _in_reach(vectors: DataFrame, threshold: float, key: str, vector: str, n_rows: int | None = None) -> tuple[DataFrame, int]:
    """((id, v, b, p, q): each row once for each pair of blocks, its own and one in its reach; the number of blocks)."""
    cells, placed = celled(vectors, threshold, key, vector, n_rows)
    blocks = Blocks(cells, BLOCK_ROWS)
    return blocks.dealt(placed).select("id", "v", "b", F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q")), len(blocks)


def _by_block(part: pa.Table, blocks: Blocks) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By block of the rows (id, v, b): ids, unit vectors, and which blocks each can have a neighbour in."""
    ids, of, units = part.column("id").to_numpy(), part.column("b").to_numpy(), unit(matrix(part.column("v").combine_chunks()))
    order = np.argsort(of, kind="stable")
    own = np.split(order, np.flatnonzero(np.diff(of[order])) + 1)
    return {int(of[rows[0]]): (ids[rows], units[rows], blocks.meeting(units[rows])) for rows in own if len(rows)}


def _pairs(sides: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], met: list[tuple[int, int]], threshold: float) -> Iterator[pa.RecordBatch]:
    """(i, j, cosine) of the blocks that meet, in batches of at most HELD pairs and those of AT_ONCE rows with a block."""
    held, n = [], 0

    def batch() -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)] if held else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["i", "j", "cosine"])

    for x, y in met:
        (ids, units, meets), (others, theirs, back) = sides[x], sides[y]
        rows, b = np.flatnonzero(meets[:, y]), np.flatnonzero(back[:, x])
        columns = theirs[b].T
        for at in range(0, len(rows), AT_ONCE):
            a = rows[at : at + AT_ONCE]
            found = units[a] @ columns
            left, right = np.nonzero(found > threshold)
            i, j, c = ids[a[left]], others[b[right]], found[left, right]
            ok = i < j if x == y else i != j
            held.append((np.minimum(i, j)[ok], np.maximum(i, j)[ok], c[ok]))
            n += len(held[-1][0])
            if n >= HELD:
                yield batch()
                held, n = [], 0
    yield batch()


def cosine_pairs(vectors: DataFrame, threshold: float, key: str = "row_id", vector: str = "embedding", n_rows: int | None = None) -> DataFrame:
    """(i, j, cosine) with i before j by key and cosine above the threshold. Rows without a vector are in no pair.

    A task holds two groups of rows, never all pairs of them.
    """
    cells, placed = celled(vectors, threshold, key, vector, n_rows)
    blocks = Blocks(cells, BLOCK_ROWS)
    groups = blocks.groups()

    @F.pandas_udf("int")
    def group(b: pd.Series) -> pd.Series:
        return pd.Series(groups[b.to_numpy()])

    dealt = blocks.dealt(placed, grouped=True).withColumn("g", group("b")).select("id", "v", "b", F.least("g", "o").alias("p"), F.greatest("g", "o").alias("q"))

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(batches).combine_chunks()
        p, q = part.column("p")[0].as_py(), part.column("q")[0].as_py()
        sides = _by_block(part, blocks)
        del part
        met = [(x, y) for x in sides for y in sides if groups[x] == p and groups[y] == q and (p != q or x <= y)]
        yield from _pairs(sides, met, threshold)

    return dealt.groupBy("p", "q").applyInArrow(block, "i long, j long, cosine double")


def pruning(vectors: DataFrame, threshold: float, key: str = "row_id", vector: str = "embedding") -> DataFrame:
    """One row on what cosine_pairs() does: blocks, block_pairs, skipped (pairs of blocks without a product), products (of two vectors), all_products (without cells)."""
    dealt, n = _in_reach(vectors, threshold, key, vector)
    rows = vectors.where(F.col(vector).isNotNull()).count()
    sides = dealt.groupBy("p", "q").agg(F.sum((F.col("b") == F.col("p")).cast("long")).alias("x"), F.sum((F.col("b") == F.col("q")).cast("long")).alias("y"))
    made = F.when(F.col("p") == F.col("q"), F.floor(F.col("x") * (F.col("x") - 1) / 2)).otherwise(F.col("x") * F.col("y"))
    total = sides.withColumn("made", made).agg(F.count_if(F.col("made") > 0).alias("met"), F.coalesce(F.sum("made"), F.lit(0)).alias("products"))
    return total.select(F.lit(n).cast("long").alias("blocks"), F.lit(n * (n + 1) // 2).cast("long").alias("block_pairs"), (F.lit(n * (n + 1) // 2) - F.col("met")).alias("skipped"), "products", F.lit(rows * (rows - 1) // 2).cast("long").alias("all_products"))


def cosine_pairs_sql(vectors: DataFrame, threshold: float, key: str = "row_id", vector: str = "embedding") -> DataFrame:
    """The same by a nested-loop join of built-in functions; for small tables."""
    a = vectors.select(F.col(key).alias("i"), F.col(vector).alias("a"))
    b = vectors.select(F.col(key).alias("j"), F.col(vector).alias("b"))
    return a.join(b, F.col("i") < F.col("j")).withColumn("cosine", cosine(F.col("a"), F.col("b"))).where(F.col("cosine") > threshold).select("i", "j", "cosine")


def similarity_histogram(vectors: DataFrame, bins: int = 50, key: str = "row_id", vector: str = "embedding") -> DataFrame:
    """(bin, pairs) of the cosines of all pairs, -1 to 1; each block returns its own counts. Rows without a vector are left out."""
    vectors = vectors.where(F.col(vector).isNotNull())
    b = _groups(vectors.count())
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(b)).cast("int").alias("b"))
    dealt = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(b - 1)))).select("id", "v", "b", F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"))

    def block(part: pd.DataFrame) -> pd.DataFrame:
        p, q = int(part.p.iloc[0]), int(part.q.iloc[0])
        left, right = part[part.b == p], part[part.b == q]
        x, y, n = _unit(left.v), _unit(right.v), np.zeros(bins, np.int64)
        for i in range(0, len(x), BLOCK_ROWS):
            for j in range(i if p == q else 0, len(y), BLOCK_ROWS):
                found = np.round(x[i : i + BLOCK_ROWS] @ y[j : j + BLOCK_ROWS].T, 9)
                if p == q and i == j:
                    found = found[np.triu_indices(len(found), 1)]
                at = np.clip(np.floor((found.ravel() + 1) / 2 * bins), 0, bins - 1).astype(np.int64)
                n += np.bincount(at, minlength=bins)
        return pd.DataFrame({"bin": np.arange(bins), "pairs": n})[n > 0]

    return dealt.groupBy("p", "q").applyInPandas(block, "bin int, pairs long").groupBy("bin").agg(F.sum("pairs").alias("pairs"))


def greedy_removed(pairs: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """(row_id) of what a scan in order removes: each kept row removes all later rows paired with it.

    pairs: (i, j). order: (row_id, rank) where the order isn't that of the ids.
    """
    edges = pairs.select("i", "j")
    if order is not None:
        ranked = edges.join(order.select(F.col("row_id").alias("i"), F.col("rank").alias("x")), "i").join(order.select(F.col("row_id").alias("j"), F.col("rank").alias("y")), "j")
        edges = ranked.select(F.when(F.col("x") < F.col("y"), F.col("i")).otherwise(F.col("j")).alias("i"), F.when(F.col("x") < F.col("y"), F.col("j")).otherwise(F.col("i")).alias("j"))
    return scanned(edges)


def copies_removed(df: DataFrame, vector: str, threshold: float, key: str = "row_id", rank: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """((row_id, v, rank) of the first row of each vector, (row_id) of the others): they are paired with the first and with all that it is paired with.

    First is by rank, else by key. Zero vectors and vectors with entries that are no numbers are in no pair and stay; so do all where the threshold is outside 0 to 1.
    """
    rows = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("row_id"), F.col(vector).alias("v"), (F.col(key) if rank is None else rank).alias("rank"))
    squares = F.aggregate(F.transform("v", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    alike = (squares > 0) & (squares < float("inf")) if 0 <= threshold < 1 - 1e-9 else F.lit(False)
    rows = rows.withColumn("alone", F.when(F.coalesce(alike, F.lit(False)), F.lit(None)).otherwise(F.col("row_id")))
    groups = materialise(rows.groupBy("v", "alone").agg(F.min(F.struct("rank", "row_id")).alias("first")).select(F.col("first.row_id").alias("row_id"), "v", F.col("first.rank").alias("rank")), "unlike")
    gone = rows.where("alone is null").select("row_id").join(groups, "row_id", "left_anti")
    return groups, gone


def any_earlier_removed(pairs: DataFrame) -> DataFrame:
    """(row_id) of every row with an earlier neighbour, removed or not."""
    return pairs.select(F.col("j").alias("row_id")).distinct()


def across_removed(new: DataFrame, old: DataFrame, threshold: float, key: str = "row_id", vector: str = "embedding") -> DataFrame:
    """(row_id) of new rows with a cosine above the threshold to any old row. Rows without a vector are like none.

    Old rows are in cells and blocks; a new row meets the blocks in its reach, together with about BLOCK_ROWS others.
    """
    cells, placed = celled(old, threshold, key, vector)
    return hits(new, Blocks(cells, BLOCK_ROWS), placed, threshold, key, vector)


def hits(new: DataFrame, blocks: Blocks, placed: DataFrame, threshold: float, key: str, vector: str, earlier: bool = False) -> DataFrame:
    """(row_id) of new rows that are like one of placed (id, v, cell), or like one with a smaller id; cells and blocks of placed are given."""
    groups = blocks.groups()
    mine = new.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), real(new, vector).alias("v"))
    parts = _groups(mine.count(), blocks.cells.pivots.shape[1])
    mine = blocks.dealt(mine.withColumn("cell", F.lit(-1)), grouped=True).select("id", "v", F.lit(-1).alias("b"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("p"), F.col("o").alias("q"))

    @F.pandas_udf("b int, q int")
    def own(ids: pd.Series, cell: pd.Series) -> pd.DataFrame:
        b = blocks.own(ids.to_numpy(), cell.to_numpy())
        return pd.DataFrame({"b": b, "q": groups[b]})

    theirs = placed.select("id", "v", own("id", "cell").alias("own")).select("id", "v", "own.b", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p"), "own.q")

    def block(part: pa.Table) -> pa.Table:
        sides = _by_block(part, blocks)
        ids, units, meets = sides.pop(-1, (np.zeros(0, np.int64), np.zeros((0, 0)), None))
        hit = np.zeros(len(ids), bool)
        for b, (others, theirs, _) in sides.items():
            for at in range(0, len(ids), BLOCK_ROWS):
                x = at + np.flatnonzero(meets[at : at + BLOCK_ROWS, b] & ~hit[at : at + BLOCK_ROWS])
                found = units[x] @ theirs.T > threshold
                hit[x] = (found & (others[None, :] < ids[x, None]) if earlier else found).any(axis=1)
        return pa.table({"row_id": pa.array(ids[hit])})

    return mine.unionByName(theirs).groupBy("p", "q").applyInArrow(block, "row_id long").distinct()


def removed_in_order(df: DataFrame, vector: str, threshold: float, key: str = "row_id", rank: Column | None = None) -> DataFrame:
    """(row_id) of what a scan in order of rank, else of key, removes: copies, what leading rows remove, then the pairs of what is left."""
    unlike, copies = copies_removed(df, vector, threshold, key, rank)
    left, _, gone = led(unlike, threshold)
    pairs = cosine_pairs(left, threshold, "row_id", "v")
    return copies.union(gone).union(greedy_removed(pairs, left.select("row_id", "rank") if rank is not None else None))


def earlier_removed(df: DataFrame, vector: str, threshold: float, key: str = "row_id") -> DataFrame:
    """(row_id) of every row with an earlier neighbour, removed or not."""
    unlike, copies = copies_removed(df, vector, threshold, key)
    left, before, gone = led(unlike, threshold, greedy=False)
    cells, placed = celled(before, threshold, "row_id", "v")
    return copies.union(gone).union(hits(left, Blocks(cells, BLOCK_ROWS), placed, threshold, "row_id", "v", earlier=True))


def within(df: DataFrame, vector: str, threshold: float = 0.9, key: str = "row_id", greedy: bool = True) -> tuple[DataFrame, DataFrame]:
    """(kept rows, removed ids) of one pass."""
    removed = removed_in_order(df, vector, threshold, key) if greedy else earlier_removed(df, vector, threshold, key)
    return df.join(removed, df[key] == removed.row_id, "left_anti"), removed


def qa_within(df: DataFrame, threshold: float = 0.9, question: str = "question_embedding", answer: str = "answer_embedding", key: str = "row_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """A question pass, then an answer pass on what it left: (kept, ids by question, ids by answer)."""
    left, by_question = within(df, question, threshold, key)
    left = _materialise(left)
    kept, by_answer = within(left, answer, threshold, key)
    return kept, by_question, by_answer


def qa_across(new: DataFrame, old: DataFrame, threshold: float = 0.9, question: str = "question_embedding", answer: str = "answer_embedding", key: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """Rows of new that are like an old row by question or by answer go: (kept, removed ids)."""
    removed = across_removed(new, old, threshold, key, question).union(across_removed(new, old, threshold, key, answer)).distinct()
    return new.join(removed, new[key] == removed.row_id, "left_anti"), removed


def text_within(df: DataFrame, columns: list[str], threshold: float = 0.9, key: str = "row_id", make: Callable[[], Encoder] | None = None) -> tuple[DataFrame, DataFrame]:
    """One pass over the embedding of several columns joined into one text: (kept rows, removed ids)."""
    from millrace.functions.text import joined_columns

    rows = _materialise(embedded(df, joined_columns(*(F.col(c) for c in columns)), "__v", make or hash_encoder))
    kept, removed = within(rows, "__v", threshold, key)
    return kept.drop("__v"), removed


def text_across(new: DataFrame, old: DataFrame, columns: list[str], threshold: float = 0.9, key: str = "row_id", make: Callable[[], Encoder] | None = None) -> tuple[DataFrame, DataFrame]:
    """new without rows whose joined text is like one of old: (kept rows, removed ids)."""
    from millrace.functions.text import joined_columns

    sides = [_materialise(embedded(df, joined_columns(*(F.col(c) for c in columns)), "__v", make or hash_encoder)) for df in (new, old)]
    removed = across_removed(sides[0], sides[1], threshold, key, "__v")
    return new.join(removed, new[key] == removed.row_id, "left_anti"), removed


# --- encoders --------------------------------------------------------------------------

def hash_encoder(dimensions: int = 256, n: int = 3, normalise: bool = True) -> Encoder:
    """Signed hashed character n-grams: a stand-in where no model is at hand. Any callable from texts to a matrix can take its place."""
    import zlib

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions), np.float32)
        for row, text in zip(out, texts, strict=True):
            padded = f" {text.lower()} ".encode()
            for i in range(max(1, len(padded) - n + 1)):
                h = zlib.crc32(padded[i : i + n])
                row[h % dimensions] += 1.0 if h & 0x80000000 else -1.0
        if normalise:
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            out = np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)
        return out

    return encode


def embedded(df: DataFrame, text: Column, name: str, make: Callable[[], Encoder] = hash_encoder, batch: int = 64) -> DataFrame:
    """df with name: array<float>. The encoder is made once in each worker; batches are sorted by length to cut padding."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make()
        for part in parts:
            texts = part.fillna("").tolist()
            order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
            out: list = [None] * len(texts)
            for at in range(0, len(order), batch):
                chosen = order[at : at + batch]
                for i, v in zip(chosen, encode([texts[i] for i in chosen]), strict=True):
                    out[i] = v
            yield pd.Series(out)

    return df.withColumn(name, run(F.coalesce(text.cast("string"), F.lit(""))))
