"""Clustering, whitening and byte-level BPE against brute force."""

from __future__ import annotations

import hashlib
from math import inf, nan

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from millrace.llm import byte_bpe, clustering, queries, whitening

P = pytest.importorskip("public_tokenizers")
RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def odd_vectors(spark):
    """Nulls, wrong lengths, non-finite entries, repeated rows and ids, rows without id, a clashing column."""
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=4).tolist()) for i in range(30)]
    rows += [(3, rows[4][1]), (5, rows[5][1]), (5, rows[5][1]), (None, rows[6][1]), (40, None), (41, []), (42, [1.0, 2.0]), (43, [1.0, None, 1.0, 1.0]), (44, [1.0, nan, 0.0, 0.0]), (45, [1.0, inf, 0.0, 0.0]), (46, [-0.0, 0.0, 0.0, 0.0])]
    return spark.createDataFrame([(*row, 7, "x") for row in rows], "vec_id long, embedding array<double>, cluster int, id string").repartition(5)


def usable(rows, d):
    return [(i, v) for i, v in rows if v is not None and len(v) == d and all(e is not None and np.isfinite(e) for e in v)]


def lloyd(rows, k, rounds, scale=256):
    """[(id, cluster, distance)], centroids, in Python's integers."""
    rows = [(i, [int(np.floor(scale * e)) for e in v]) for i, v in rows]
    order = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [list(v) for _, v in order[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), j) for j, y in enumerate(c))
    for _ in range(rounds):
        labels = [near(x)[1] for _, x in rows]
        for j in range(len(c)):
            own = [x for (_, x), label in zip(rows, labels, strict=True) if label == j]
            if own:
                c[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    return [(i, near(x)[1], near(x)[0]) for i, x in rows], c


def none_last(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def test_clusters_equal_brute_force(spark, sf, odd_vectors):
    for k, rounds in ((5, 3), (100, 2)):
        rows = usable([(r.vec_id, r.embedding) for r in odd_vectors.collect()], 4)
        members, centroids = lloyd(rows, k, rounds)
        got = clustering.cluster(odd_vectors, k=k, rounds=rounds, dimensions=4)
        assert none_last(tuple(r) for r in got.members.collect()) == none_last(members) and got.centroids.tolist() == centroids
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    members, centroids = lloyd(usable([(r.vec_id, r.embedding) for r in table.collect()], 64), 40, 5)
    own, everything = {}, sum(d for *_, d in members)
    for _, c, d in members:
        own[c] = own.get(c, 0) + d
    expected = {(i, c, d, own[c], everything, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in members}
    found = queries.op11_clustering(spark, sf)
    assert found.dtypes == [("vec_id", "bigint"), ("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string")]
    assert {tuple(r) for r in found.collect()} == expected


def test_no_vectors_and_vectors_too_large(spark, odd_vectors):
    none = clustering.cluster(odd_vectors.limit(0), dimensions=4)
    assert none.members.count() == 0 and none.summary() == []
    with pytest.raises(Exception, match="64 bits"):
        clustering.cluster(spark.createDataFrame([(1, [1e20])], "vec_id long, embedding array<double>"), dimensions=1)


@pytest.mark.parametrize("scale", [1, 300, 2**20])
def test_intervals_hold_the_exact_scores(scale):
    """Also for integers that a float32 can't hold; and what is near a tie is found exactly."""
    r = np.random.default_rng(scale)
    c = r.integers(-scale, scale + 1, (40, 64))
    c[7] = c[3]
    x = np.concatenate([r.integers(-scale, scale + 1, (500, 64)), c, (c[:20] + c[20:]) // 2])
    low, high = clustering.Screen(c).intervals(x)
    exact = [[sum(int(b) * int(b) - 2 * int(a) * int(b) for a, b in zip(p, q, strict=True)) for q in c] for p in x]
    assert all(int(np.floor(low[i, j])) <= exact[i][j] <= int(np.ceil(high[i, j])) for i in range(len(x)) for j in range(40))
    assert clustering.Screen(c).nearest(x).tolist() == [int(np.argmin([sum((int(a) - int(b)) ** 2 for a, b in zip(p, q, strict=True)) for q in c])) for p in x]


def test_overlapping_intervals_are_recomputed():
    """Centroids one apart from each other at a great distance: float32 alone can't tell them."""
    c = np.full((3, 64), 1 << 22) + np.eye(3, 64, dtype=np.int64)
    x = np.zeros((3, 64), np.int64) + np.eye(3, 64, dtype=np.int64) * 2
    low, high = clustering.Screen(c).intervals(x)
    assert ((low <= high.min(axis=1, keepdims=True)).sum(axis=1) > 1).all()
    assert clustering.Screen(c).nearest(x).tolist() == [0, 1, 2]
    assert clustering.Screen(c).nearest(np.zeros((1, 64), np.int64)).tolist() == [0]


def plain_whitening(x):
    """(n, sums, eigenvalues, vectors as rows) by an eigenvalue solver, from exact sums."""
    n, sums = len(x), x.sum(axis=0)
    y = (n * x - sums).astype(np.float64) / n
    e, v = np.linalg.eigh(y.T @ y / n)
    return n, sums, y, e[::-1], v[:, ::-1].T


def test_whitening_equals_brute_force(spark, sf, monkeypatch):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = table.collect()
    x = np.floor(64 * np.array([r.embedding for r in rows])).astype(np.int64) + 1_000_000
    n, sums, y, e, v = plain_whitening(x)
    found = queries.op13_whitening(spark, sf)
    assert found.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    got = found.toPandas().sort_values(["vec_id", "component"])
    assert len(got) == n * 32 and set(got.n) == {n} and (got.groupby("vec_id").component.apply(list).map(lambda c: c == list(range(1, 33)))).all()
    w = got.whitened.to_numpy().reshape(n, 32)
    order = np.argsort([r.vec_id for r in rows])
    expected = (y @ v[:32].T / np.sqrt(e[:32]))[order]
    signs = np.sign((w * expected).sum(axis=0))
    assert np.abs(w * signs - expected).max() < 1e-8
    assert np.allclose(got.explained.to_numpy().reshape(n, 32)[0], e[:32] / e.sum(), rtol=1e-10)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-10
    exact = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, sums, strict=True)) for r in x[order]]
    assert got.deviation.to_numpy().reshape(n, 32)[:, 0].tolist() == exact
    # The same by many small partitions, in three levels of merging.
    monkeypatch.setattr(whitening, "FAN", 3)
    many = whitening.fit(table.repartition(17))
    assert many.n == n and many.sums.tolist() == sums.tolist() and np.allclose(many.eigenvalues, e, rtol=1e-10)
    assert np.allclose(np.abs((many.components * v).sum(axis=1)), 1, atol=1e-9)


def test_merging_loses_nothing():
    """Also where parts have fewer rows than dimensions, and means far apart."""
    r = np.random.default_rng(0)
    x = np.concatenate([r.integers(-50, 50, (3, 6)), r.integers(-50, 50, (40, 6)) + 10**9, r.integers(0, 2, (1, 6))])
    whole = whitening.Summary.of(x)
    merged = whitening.Summary.of(x[:3]).merged(whitening.Summary.of(x[3:20])).merged(whitening.Summary.of(x[20:43]).merged(whitening.Summary.of(x[43:])))
    assert merged.n == len(x) and merged.sums.tolist() == x.sum(axis=0).tolist()
    assert np.allclose(merged.singular[:1], whole.singular[:1], rtol=1e-12)
    near = x.copy()
    near[3:43] -= 10**9
    whole = whitening.Summary.of(near)
    merged = whitening.Summary.of(near[:3]).merged(whitening.Summary.of(near[3:20])).merged(whitening.Summary.of(near[20:43]).merged(whitening.Summary.of(near[43:])))
    assert np.allclose(merged.singular, whole.singular, rtol=1e-10)
    cov = lambda s: (s.vectors.T * s.singular**2) @ s.vectors
    assert np.allclose(cov(merged), cov(whole), rtol=1e-10, atol=1e-8)


def test_whitening_odd_rows(spark, odd_vectors):
    rows = usable([(r.vec_id, r.embedding) for r in odd_vectors.collect()], 4)
    model = whitening.fit(odd_vectors)
    x = np.floor(64 * np.array([v for _, v in rows])).astype(np.int64) + 1_000_000
    assert model.n == len(rows) and model.sums.tolist() == x.sum(axis=0).tolist()
    got = whitening.transform(odd_vectors, model)
    assert none_last([(r.id,) for r in got.collect()]) == none_last([(i,) for i, _ in rows])
    assert whitening.identity_error(odd_vectors, model) < 1e-10
    assert whitening.fit(odd_vectors.limit(0)) is None and whitening.fit(odd_vectors.where("vec_id = 40")) is None and whitening.fit(odd_vectors.where("vec_id = 43")) is None
    flat = whitening.fit(odd_vectors.where("vec_id = 5 and embedding[0] is not null").limit(2))
    assert flat.n == 2 and whitening.identity_error(odd_vectors.where("vec_id = 5"), flat) is None and not flat.explained.any()
    assert whitening.transform(odd_vectors.where("vec_id = 5"), flat).first().whitened == []


def test_deviations_beyond_64_bits():
    x = np.array([[10**12, 5], [-(10**12), 7]])
    sums = x.sum(axis=0)
    got = whitening.deviations(x, 2, sums)
    assert [int(d.as_py()) for d in got] == [sum((2 * int(a) - int(s)) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]


# --- byte-level BPE ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    t = byte_bpe.Tokenizer(RANKS, P.PATTERN)
    return lambda text: np.array(t.encoding.encode_ordinary(text or ""), "<u4").tobytes()


def test_classes_are_those_of_the_library():
    every = "".join(chr(c) for c in [*range(0xD800), *range(0xE000, 0x110000)])
    one = {bytes([i]): i for i in range(256)}
    import re

    for p in (r"\p{L}", r"\p{N}", r"\s", r"[^\s\p{L}\p{N}]", r"\S"):
        theirs = tiktoken.Encoding("t", pat_str=p, mergeable_ranks=one, special_tokens={})
        assert bytes(theirs.encode_ordinary(every)).decode() == "".join(re.findall(byte_bpe.spelt_out(p), every))


TEXTS = [
    None,
    "",
    " ",
    "a",
    "I'll don't 'tis ''s 're  'm\n's",
    "x" * 5000,
    " " * 3000,
    "\n \t" * 700,
    "word " * 900 + "y" * 400 + " end" * 50,
    "ab 12 " * 20 + " " * 300 + "été naïve 你好世界 " * 60 + "'" * 200 + "re" + "🙂🙃" * 100,
    "  x　 " * 120,
    "'ll" * 500,
    "a\r\n\r\n" * 300,
    "\x00\x1c\x1f\x85" * 100,
]


@pytest.mark.parametrize(("chunk", "overlap"), [(16_384, 512), (64, 16), (50, 7)])
def test_encoding_equals_the_library(spark, reference, chunk, overlap):
    df = spark.createDataFrame([(i if i != 3 else None, t, 1, b"k") for i, t in enumerate([*TEXTS, TEXTS[9]])], "doc_id int, text string, n_tokens int, ids binary").repartition(3)
    got = byte_bpe.decode(byte_bpe.encode(df, RANKS, P.PATTERN, chunk=chunk, overlap=overlap), RANKS, P.PATTERN)
    rows = {r.id: r for r in got.collect()}
    assert len(rows) == len(TEXTS) + 1 and got.columns == ["id", "n_tokens", "ids", "decoded"]
    for i, t in enumerate([*TEXTS, TEXTS[9]]):
        r = rows[i if i != 3 else None]
        assert (bytes(r.ids), r.n_tokens, bytes(r.decoded)) == (reference(t), len(r.ids) // 4, (t or "").encode()), i


def test_random_texts_at_random_cuts(spark, reference):
    r = np.random.default_rng(9)
    letters = np.array(list("ab'sretlvmd 1 \n\t!?é你🙂 "))
    texts = ["".join(r.choice(letters, r.integers(0, 400), p=None)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.id: bytes(x.ids) for x in byte_bpe.encode(df, RANKS, P.PATTERN, chunk=23, overlap=6).collect()}
    assert got == {i: reference(t) for i, t in enumerate(texts)}


def test_neighbours_meet_where_they_can(spark):
    """One long word makes its chunks one; the rest stay apart."""
    text = "some words here " * 40 + "z" * 500 + " and more " * 40
    chunks = byte_bpe._cut(64, 16)(iter([pa.record_batch({"id": [1], "row": [1], "text": [text]})]))
    rows = [r for b in chunks for r in b.to_pylist()]
    df = spark.createDataFrame(rows, f"id long, {byte_bpe._CHUNKS}")
    joined, met = byte_bpe.stitched(df.drop("id"), RANKS, P.PATTERN, 16)
    assert 5 < joined.count() < len(rows) - 5 and met.where("meets is null").count() == 0 and joined.count() == met.count()


def test_byte_bpe_query(spark, sf, reference):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = queries.op12_byte_bpe(spark, sf)
    assert found.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    rows = found.collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = reference(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())
    assert byte_bpe.encode(spark.read.parquet(f"{sf}/documents.parquet").limit(0), RANKS, P.PATTERN).count() == 0


def test_no_id_without_a_token():
    t = byte_bpe.Tokenizer(RANKS, P.PATTERN)
    assert t.decode(b"") == b""
    with pytest.raises((ValueError, IndexError)):
        t.decode(np.array([2**31], "<u4").tobytes())
