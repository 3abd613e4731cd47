"""Near-duplicate operators against a sequential scan."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import cells, graph, leaders
from millrace.operators import similarity as s


def cos(a, b):
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return float(np.dot(a, b) / n) if n else 0.0


def scan(v, order, t):
    removed = set()
    for x, i in enumerate(order):
        if i not in removed:
            removed |= {j for j in order[x + 1 :] if j not in removed and cos(v[i], v[j]) > t}
    return removed


def table(spark, v):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "row_id long, embedding array<double>")


@pytest.mark.parametrize("seed", range(3))
def test_greedy_is_the_sequential_scan(spark, seed, monkeypatch):
    monkeypatch.setattr(s, "BLOCK_ROWS", 20)
    v = np.random.default_rng(seed).normal(size=(70, 4))
    df = table(spark, v)
    kept, removed = s.within(df, "embedding", 0.8)
    assert {r[0] for r in removed.collect()} == scan(v, list(range(70)), 0.8)
    ids = sorted(r.row_id for r in kept.collect())
    assert all(cos(v[i], v[j]) <= 0.8 for i in ids for j in ids if i < j)
    again, gone = s.within(kept, "embedding", 0.8)
    assert gone.count() == 0 and again.count() == len(ids)


def test_order_by_rank(spark):
    v = np.random.default_rng(5).normal(size=(40, 3))
    df = table(spark, v)
    rank = df.select("row_id", (-F.col("row_id")).alias("rank"))
    got = {r[0] for r in s.greedy_removed(s.cosine_pairs(df, 0.8), rank).collect()}
    assert got == scan(v, list(range(39, -1, -1)), 0.8)


def test_chain_zero_vector_and_strict_threshold(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.5]), (2, [0.5, 0.9]), (3, [0.0, 0.0]), (4, [2.0, 0.0])], "row_id long, embedding array<double>")
    assert sorted(r[0] for r in s.within(df, "embedding", 0.8)[1].collect()) == [1, 4]
    assert sorted(r[0] for r in s.within(df, "embedding", 0.8, greedy=False)[1].collect()) == [1, 2, 4]
    assert s.cosine_pairs(df, 1.0).count() == 0
    a = {(r.i, r.j) for r in s.cosine_pairs(df, 0.5).collect()}
    assert a == {(r.i, r.j) for r in s.cosine_pairs_sql(df, 0.5).collect()}


def test_across(spark, monkeypatch):
    monkeypatch.setattr(s, "BLOCK_ROWS", 10)
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(25, 3)), rng.normal(size=(35, 3))
    got = {r[0] for r in s.across_removed(table(spark, a), table(spark, b), 0.9).collect()}
    assert got == {i for i in range(25) if any(cos(a[i], y) > 0.9 for y in b)}


def test_empty(spark):
    df = spark.createDataFrame([], "row_id long, embedding array<double>")
    kept, removed = s.within(df, "embedding")
    assert kept.count() == removed.count() == 0


def test_encoder(spark):
    df = s.embedded(spark.createDataFrame([("abc",), (None,), ("abc",)], "t string"), F.col("t"), "v")
    rows = [r.v for r in df.collect()]
    assert rows[0] == rows[2] and len(rows[1]) == 256


def test_rows_without_a_vector(spark):
    from millrace.operators import similarity

    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0, 0.001]), (4, None)], "row_id long, embedding array<double>")
    kept, removed = similarity.within(v, "embedding", 0.9)
    assert {r.row_id for r in kept.collect()} == {1, 2, 4} and {r.row_id for r in removed.collect()} == {3}
    assert [r.row_id for r in similarity.across_removed(v, v.where("row_id = 1"), 0.9).collect()] in ([1, 3], [3, 1])
    assert similarity.similarity_histogram(v).agg({"pairs": "sum"}).first()[0] == 1


def test_a_batch_run_again_keeps_the_same_rows(spark, tmp_path):
    """As after a failed sink or a restart: nothing is lost, and earlier batches still count."""
    from millrace.plans.pipelines import incremental

    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (4, [0.01, 1.0]), (5, [-1.0, 0.0])], "row_id long, embedding array<double>")
    path = str(tmp_path / "index")
    ids = lambda df: sorted(r.row_id for r in df.collect())
    for _ in range(2):
        assert ids(incremental(v.where("row_id < 4"), path, batch=0)) == [1, 3]
    for _ in range(2):
        assert ids(incremental(v.where("row_id >= 4"), path, batch=1)) == [5]
    assert ids(incremental(v, path)) == []
    assert ids(spark.read.parquet(path)) == [1, 3, 5]


# --- cells, components, index -------------------------------------------------------------


def clustered(r, n, clusters, dimensions=16, spread=0.05):
    centres = r.normal(size=(clusters, dimensions))
    return centres[r.integers(0, clusters, n)] + spread * r.normal(size=(n, dimensions))


@pytest.mark.parametrize("threshold", [0.9, 0.3, 0.0, -0.2])
def test_pruned_pairs_are_all_pairs(spark, monkeypatch, threshold):
    """Zero vectors, copies and small cells included."""
    monkeypatch.setattr(cells, "CELL_ROWS", 15)
    monkeypatch.setattr(s, "BLOCK_ROWS", 25)
    r = np.random.default_rng(2)
    v = np.concatenate([clustered(r, 150, 8), r.normal(size=(40, 16)), np.zeros((2, 16)), clustered(r, 1, 1).repeat(30, axis=0)])
    df = table(spark, v)
    got = {(x.i, x.j) for x in s.cosine_pairs(df, threshold).collect()}
    assert got == {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if cos(v[i], v[j]) > threshold}
    removed = {x[0] for x in s.within(df, "embedding", threshold)[1].collect()}
    assert removed == scan(v, list(range(len(v))), threshold)


def test_clusters_take_a_third_of_the_products_at_most(spark, monkeypatch):
    monkeypatch.setattr(cells, "CELL_ROWS", 20)
    monkeypatch.setattr(s, "BLOCK_ROWS", 50)
    r = np.random.default_rng(3)
    got = s.pruning(table(spark, clustered(r, 600, 12)), 0.9).first()
    assert got.all_products == 600 * 599 // 2 and 0 < got.products < got.all_products / 3
    assert got.skipped > got.block_pairs / 2
    loose = s.pruning(table(spark, r.normal(size=(200, 16))), 0.1).first()
    assert loose.products == loose.all_products and loose.skipped == 0


def test_large_groups_of_copies_make_no_pairs(spark):
    v = np.concatenate([np.ones((500, 4)), np.zeros((3, 4)), [[1, 1, 1, 0.9], [np.nan, 1, 0, 0], [np.nan, 1, 0, 0]]])
    df = table(spark, v)
    unlike, gone = s.copies_removed(df, "embedding", 0.9)
    assert sorted(r.row_id for r in unlike.collect()) == [0, 500, 501, 502, 503, 504, 505] and gone.count() == 499
    assert {r[0] for r in s.within(df, "embedding")[1].collect()} == {*range(1, 500), 503}
    order = {r.row_id for r in s.copies_removed(df, "embedding", 0.9, rank=-F.col("row_id"))[0].collect()}
    assert 499 in order and 0 not in order


def test_components_of_a_path_a_star_and_strays(spark):
    edges = [(i, i + 1) for i in range(2000)] + [(5000, 5001 + i) for i in range(300)] + [(9000, 8000), (8000, 8500)]
    df = spark.createDataFrame(edges, "i long, j long").repartition(6)
    got = dict(graph.components(df).collect())
    assert got == {**{i: 0 for i in range(2001)}, **{i: 5000 for i in range(5000, 5301)}, 8000: 8000, 8500: 8000, 9000: 8000}
    assert graph.components(df.limit(0)).count() == 0


def test_a_long_chain_is_a_few_jobs(spark, monkeypatch):
    """10,000 rows each paired with the next: every second goes; by components, and as one task."""
    monkeypatch.setattr(graph, "BUCKET", 2000)
    chain = spark.range(9999).select(F.col("id").alias("i"), (F.col("id") + 1).alias("j")).union(spark.createDataFrame([(20000, 20001), (20001, 20002)], "i long, j long"))
    steps = []
    real = graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, label: steps.append(label) or real(df, label))
    assert {r[0] for r in graph.scanned(chain).collect()} == {*range(1, 10000, 2), 20001}
    assert len(steps) < 30
    monkeypatch.setattr(graph, "BUCKET", 20_000)
    steps.clear()
    assert graph.scanned(chain).count() == 5001 and len(steps) == 1


def test_components_too_large_for_a_task(spark, monkeypatch):
    monkeypatch.setattr(graph, "BUCKET", 50)
    monkeypatch.setattr(graph, "FIT", 100)
    r = np.random.default_rng(6)
    v = np.concatenate([clustered(r, 60, 1), clustered(r, 30, 5)])
    df = table(spark, v)
    assert {x[0] for x in s.greedy_removed(s.cosine_pairs(df, 0.97)).collect()} == scan(v, list(range(90)), 0.97)


def test_an_index_reads_the_cells_in_reach(spark, monkeypatch, tmp_path):
    from millrace.operators.index import VectorIndex
    from millrace.plans.pipelines import incremental

    monkeypatch.setattr(cells, "CELL_ROWS", 10)
    r = np.random.default_rng(8)
    v = clustered(r, 300, 10, spread=0.25)
    near = v[:1] + 0.01 * r.normal(size=(40, 16))
    df, more = table(spark, v), table(spark, np.concatenate([near, r.normal(size=(5, 16))])).withColumn("row_id", F.col("row_id") + 1000)
    path = str(tmp_path / "index")
    ids = lambda df: sorted(x.row_id for x in df.collect())
    first = ids(incremental(df.where("row_id < 200"), path, 0.98))
    second = ids(incremental(df.where("row_id >= 200"), path, 0.98))
    assert first == [i for i in range(200) if i not in scan(v, list(range(200)), 0.98)]
    own = [i for i in range(200, 300) if i not in scan(v, list(range(200, 300)), 0.98)]
    assert second == [i for i in own if all(cos(v[i], v[j]) <= 0.98 for j in first)]
    index = VectorIndex(spark, path)
    saved = len(first) + len(second)
    _, read = index.reach(more.where("row_id < 1040"), 2, 0.98)
    assert 0 < read.count() < saved / 3
    assert any("PartitionFilters" in x and "cell" in x for x in read._jdf.queryExecution().toString().splitlines())
    third = ids(incremental(more, path, 0.98))
    assert third == ids(incremental(more, path, 0.98, batch=2)) and set(third) <= set(range(1000, 1045)) and not set(third) & set(range(1000, 1040))
    # Compaction changes no result: not of a later batch, nor of one that is run again.
    index.compact(1)
    assert index.parts() == {"1-1": (0, 1), "2-0": (2, 2)} and index.settled() == 1
    assert third == ids(incremental(more, path, 0.98, batch=2))
    assert second == ids(incremental(df.where("row_id >= 200"), path, 0.98, batch=1)) and first == ids(incremental(df.where("row_id < 200"), path, 0.98, batch=0))
    assert spark.read.parquet(path).count() == saved + len(third)
    index.compact(2)
    assert index.parts() == {"2-2": (0, 2)} and ids(incremental(more, path, 0.98)) == []
    assert spark.read.parquet(path).count() == saved + len(third)


def test_an_index_without_rows(spark, tmp_path):
    from millrace.plans.pipelines import incremental

    empty = spark.createDataFrame([], "row_id long, embedding array<double>")
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "row_id long, embedding array<double>")
    path = str(tmp_path / "index")
    assert incremental(one, path).count() == 2 and incremental(empty, path).count() == 0
    assert [r.row_id for r in incremental(one.withColumn("row_id", F.col("row_id") + 5), path).collect()] == [7]


# --- leading rows and groups of blocks ----------------------------------------------------------------


@pytest.fixture
def few_pairs(monkeypatch):
    """Small rounds; the rows that are given to cosine_pairs()."""
    monkeypatch.setattr(leaders, "LEAD_ROWS", 30)
    monkeypatch.setattr(leaders, "ROWS", 7)
    seen = []
    real = s.cosine_pairs
    monkeypatch.setattr(s, "cosine_pairs", lambda df, *a, **k: seen.append(df.count()) or real(df, *a, **k))
    return seen


def dense(seed, n=400):
    """Rows of which each is like a fifth of the others, with copies, zero vectors and a vector that is none."""
    r = np.random.default_rng(seed)
    return np.concatenate([r.normal(size=(n, 6)), np.zeros((2, 6)), np.ones((3, 6)), [[np.nan] * 6]])


def test_incremental_batches_of_dense_rows_make_few_pairs(spark, tmp_path, few_pairs):
    from millrace.plans.pipelines import incremental

    v = dense(1)
    df, ids = table(spark, v), lambda df: sorted(r.row_id for r in df.collect())
    path = str(tmp_path / "index")
    first = ids(incremental(df.where("row_id < 200"), path, 0.35, batch=0))
    second = ids(incremental(df.where("row_id >= 200"), path, 0.35, batch=1))
    assert first == [i for i in range(200) if i not in scan(v, list(range(200)), 0.35)]
    own = [i for i in range(200, len(v)) if i not in scan(v, list(range(200, len(v))), 0.35)]
    assert second == [i for i in own if all(not cos(v[i], v[j]) > 0.35 for j in first)]
    assert len(few_pairs) == 2 and max(few_pairs) <= 30


def test_order_by_quality_of_dense_rows_makes_few_pairs(spark, few_pairs):
    from millrace.plans.pipelines import removed_by_quality

    v = dense(2)
    df = table(spark, v).withColumn("quality", F.col("row_id") % 3)
    order = sorted(range(len(v)), key=lambda i: (-(i % 3), i))
    assert {r.row_id for r in removed_by_quality(df, "embedding", 0.35).collect()} == scan(v, order, 0.35)
    assert len(few_pairs) == 1 and few_pairs[0] <= 30


def test_greedy_removal_of_dense_rows_makes_few_pairs(spark, few_pairs):
    v = dense(3)
    assert {r.row_id for r in s.within(table(spark, v), "embedding", 0.35)[1].collect()} == scan(v, list(range(len(v))), 0.35)
    assert len(few_pairs) == 1 and few_pairs[0] <= 30


def test_two_passes_over_dense_rows_make_few_pairs(spark, few_pairs):
    v = dense(4)
    df = table(spark, v).withColumn("half", F.slice("embedding", 1, 4))
    kept, by_question, by_answer = s.qa_within(df, 0.6, "embedding", "half")
    first = scan(v, list(range(len(v))), 0.6)
    left = [i for i in range(len(v)) if i not in first]
    second = scan(v[:, :4], left, 0.6)
    assert {r.row_id for r in by_question.collect()} == first and {r.row_id for r in by_answer.collect()} == second and second
    assert {r.row_id for r in kept.collect()} == set(left) - second
    assert len(few_pairs) == 2 and max(few_pairs) <= 100


def test_pairs_are_dealt_to_few_groups(spark, monkeypatch):
    """Vectors that rule nothing out: 80 blocks at least, but no vector is sent more than about GROUPS times."""
    monkeypatch.setattr(cells, "CELL_ROWS", 8)
    monkeypatch.setattr(s, "BLOCK_ROWS", 8)
    sent = []
    real = cells.Blocks.dealt
    monkeypatch.setattr(cells.Blocks, "dealt", lambda self, *a, **k: sent.append((len(self), (df := real(self, *a, **k)).count())) or df)
    v = np.random.default_rng(9).normal(size=(640, 16))
    df = table(spark, v)
    units = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert {(x.i, x.j) for x in s.cosine_pairs(df, 0.5).collect()} == {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(units @ units.T, 1) > 0.5), strict=True)}
    new, old = df.where("row_id % 2 = 1"), df.where("row_id % 2 = 0")
    assert {r.row_id for r in s.across_removed(new, old, 0.5).collect()} == {int(i) for i in range(1, 640, 2) if (units[i] @ units[::2].T > 0.5).any()}
    assert sent[0][0] >= 80 and all(n <= (cells.GROUPS + 1) * 640 for _, n in sent)


@pytest.mark.parametrize("n", [400, 25])
def test_rows_with_an_earlier_neighbour_need_no_pairs(spark, few_pairs, monkeypatch, n):
    """By leading rows, then the few that are left against those before them; and without a round."""
    left = []
    real = s.hits
    monkeypatch.setattr(s, "hits", lambda new, *a, **k: left.append(new.count()) or real(new, *a, **k))
    v = dense(5, n)
    want = {j for j in range(len(v)) if any(cos(v[i], v[j]) > 0.35 for i in range(j))}
    assert {r.row_id for r in s.within(table(spark, v), "embedding", 0.35, greedy=False)[1].collect()} == want
    assert not few_pairs and left[0] <= 31


def test_vectors_are_sent_in_their_own_width(spark, monkeypatch):
    """Numbers of 4 bytes stay so in tables and shuffles, and give the same pairs, bit for bit; other types are sent as 8 bytes."""
    sent = []
    real = cells.Blocks.dealt
    monkeypatch.setattr(cells.Blocks, "dealt", lambda self, rows, *a, **k: sent.append((dict(rows.dtypes)["v"], dict((df := real(self, rows, *a, **k)).dtypes)["v"])) or df)
    v = np.random.default_rng(11).normal(size=(90, 8)).astype(np.float32)
    wide = table(spark, v)
    narrow, whole = (wide.withColumn("embedding", F.col("embedding").cast(t)) for t in ("array<float>", "array<decimal(30,20)>"))
    pairs = lambda df: sorted((x.i, x.j, x.cosine) for x in s.cosine_pairs(df, 0.5).collect())
    got, want, other = pairs(narrow), pairs(wide), pairs(whole)
    assert got == want and want and [x[:2] for x in other] == [x[:2] for x in want]
    assert set(sent[:1]) == {("array<float>",) * 2} and set(sent[1:]) == {("array<double>",) * 2}
    split = lambda a, b: {x.row_id for x in s.across_removed(a.where("row_id < 40"), b.where("row_id >= 40"), 0.5).collect()}
    assert split(narrow, narrow) == split(narrow, wide) == split(wide, narrow) == split(wide, wide) != set()


def test_pairs_leave_a_task_in_small_batches(monkeypatch):
    """Rows that are all like each other: no batch holds more than HELD pairs and those of AT_ONCE rows with a block."""
    monkeypatch.setattr(s, "HELD", 100)
    monkeypatch.setattr(s, "AT_ONCE", 5)
    r = np.random.default_rng(12)
    units = cells.unit(1 + 0.01 * r.normal(size=(120, 4)))
    ids, meets = r.permutation(120), np.ones((40, 3), bool)
    sides = {b: (ids[40 * b : 40 * b + 40], units[40 * b : 40 * b + 40], meets) for b in range(3)}
    batches = list(s._pairs(sides, [(x, y) for x in range(3) for y in range(x, 3)], 0.9))
    assert max(b.num_rows for b in batches) < 100 + 5 * 40
    got = sorted((i, j) for b in batches for i, j in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
    assert got == [(i, j) for i in range(120) for j in range(i + 1, 120)]
    assert [b.num_rows for b in s._pairs(sides, [], 0.9)] == [0]
