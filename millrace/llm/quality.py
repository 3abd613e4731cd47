"""Quality classifier: supervised subword embeddings.

Every word and every character n-gram inside words (NGRAMS bytes long, a word's edge counts
as a character) is hashed to one of BUCKETS learned vectors; a word that repeats one of the LAGS words before
it counts as one more token, the same for all words. A document is the average of
its vectors, a softmax layer gives the class probabilities, and both are trained together by
stochastic gradient descent in numpy.

Training reads a bounded sample: about TRAIN_DOCS labelled documents (documented bound),
chosen by a hash of their id. Scoring reads every whole text; as the softmax is linear in
the average, each bucket's vector is folded into one number before the model is broadcast
(BUCKETS numbers, whatever the input).

Nulls, ties, empty input: null text is empty text; a text without words gets the prior of
the training labels; without labels, or with one label only, every score is that prior. A
document with both labels counts as labelled 1; repeated rows are trained on and scored each
for itself; very long texts are read whole, one at a time. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, hashed_words, text_chunks, trimmed

TRAIN_DOCS = 6000
BUCKETS = 1 << 17
NGRAMS = (3, 4)
LAGS = 3
DIMENSIONS = 8
EPOCHS = 5
RATE = 0.5
CHUNK_BYTES, CHUNK_ROWS = 1 << 20, 4096


def hashed_ngrams(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte n-grams inside words, A-Z lower-cased, and the byte at which each starts.

    White space may be the first or the last byte of an n-gram only; none crosses texts.
    """
    size = len(data) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lower = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    lower = np.where(space, np.uint8(32), lower)
    good = np.ones(size, bool)
    for j in range(1, n - 1):
        good &= ~space[j : j + size]
    for j in range(1, n):
        cut = offsets[1:-1] - j
        good[cut[(cut >= 0) & (cut < size)]] = False
    hashes = np.zeros(size, np.uint32)
    for j in range(n):
        hashes = (hashes ^ lower[j : j + size]) * np.uint32(0x01000193)
    hashes ^= hashes >> np.uint32(15)
    hashes = hashes * np.uint32(0x2C1B3C6D) + np.uint32(n)
    at = np.flatnonzero(good)
    return (hashes[at] >> np.uint32(7)).astype(np.int64) % BUCKETS, at


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, text numbers) for words, for words that stand 1 to LAGS words before too, then for each n-gram length."""
    words, owner = hashed_words(data, offsets)
    yield (words >> np.uint64(20)).astype(np.int64) % BUCKETS, owner
    for lag in range(1, LAGS + 1):
        again = owner[lag:][(words[lag:] == words[:-lag]) & (owner[lag:] == owner[:-lag])]
        yield np.full(len(again), lag), again
    for n in NGRAMS:
        buckets, at = hashed_ngrams(data, offsets, n)
        yield buckets, np.searchsorted(offsets, at, "right") - 1


@dataclass
class Model:
    values: np.ndarray  # float32, one number a bucket
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        total, count = np.zeros(n), np.zeros(n)
        for buckets, owner in features(data, offsets):
            total += np.bincount(owner, self.values[buckets], n)
            count += np.bincount(owner, minlength=n)
        return 1.0 / (1.0 + np.exp(-(total / np.maximum(count, 1.0) + self.bias)))


def train(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Labels 0 or 1; classes are weighed alike, and the prior comes back through the bias."""
    prior = float(np.clip(np.mean(labels), 1e-3, 1 - 1e-3)) if labels else 0.5
    log_odds = float(np.log(prior / (1 - prior)))
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), log_odds)
    bags = []
    for text in texts:
        raw = text.encode("utf-8", "surrogatepass")
        data, offsets = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
        found = np.concatenate([b for b, _ in features(data, offsets)])
        buckets, counts = np.unique(found, return_counts=True)
        bags.append((buckets, (counts / max(1, len(found))).astype(np.float32)))
    random = np.random.Generator(np.random.PCG64(seed))
    vectors = random.uniform(-1, 1, (BUCKETS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    layer, bias = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
    truth = np.array(labels)
    weight = np.where(truth == 1, 0.5 / prior, 0.5 / (1 - prior))
    steps, done = EPOCHS * len(bags), 0
    for _ in range(EPOCHS):
        for i in random.permutation(len(bags)):
            buckets, share = bags[i]
            rate = np.float32(RATE * (1 - done / steps) * min(4.0, weight[i]))
            done += 1
            hidden = share @ vectors[buckets]
            logits = hidden @ layer + bias
            error = np.exp(logits - logits.max())
            error /= error.sum()
            error[truth[i]] -= 1.0
            back = layer @ error
            layer -= rate * np.outer(hidden, error)
            bias -= rate * error
            vectors[buckets] -= (rate * len(buckets) ** 0.5 * share)[:, None] * back
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, text: str = "text", key: str = "doc_id", most: int = TRAIN_DOCS) -> tuple[list[str], list[int]]:
    """Texts and labels of about most labelled documents, chosen by a hash of the key."""
    marked = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("__key"), F.col(label).cast("int").alias("__label")).groupBy("__key").agg(F.max("__label").alias("__label"))
    share = min(1.0, most / max(1, marked.count()))
    chosen = marked.where(F.pmod(F.xxhash64(F.col("__key").cast("string"), F.lit("quality")), F.lit(1 << 40)) < int(share * (1 << 40)))
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(F.broadcast(chosen), "__key").collect()
    rows.sort(key=lambda r: (str(r["__key"]), r["__text"] or ""))
    return [r["__text"] or "" for r in rows], [r["__label"] for r in rows]


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, score, predicted) of every document."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.values, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Model(*shared.value)
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(1), CHUNK_BYTES, CHUNK_ROWS):
                found = held.scores(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(trimmed(run), "doc_id long, score double, predicted int")


def fold(key: Column, folds: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds))
