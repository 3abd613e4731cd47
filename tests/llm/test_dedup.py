"""Exact and near duplicates against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import exact_dedup, near_dedup, shared
from millrace.llm.shared import attach_groups, sieve

SPACE = re.compile("[\x20\x09-\x0d]+")


def brute_near(rows, width=5, percent=75):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets, parent = {}, {}
    for d, t in rows:
        w = [x for x in SPACE.split((t or "").translate(lower)) if x]
        sets[d] = {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
        parent[d] = d

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            k = len(sets[a] & sets[b])
            if k and 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def near(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect()}


def test_near_is_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert near(docs) == brute_near([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("block", [512, 8])
def test_families_near_the_threshold(spark, monkeypatch, block):
    """Copies with a few to many edits: star pairs miss some links, the pairs between components must not."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    r = random.Random(4)
    base = [f"w{r.randrange(500)}" for _ in range(150)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(r.randrange(0, 7)):
            words[r.randrange(len(words))] = f"e{r.randrange(9999)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_near(rows)
    assert near(df) == want and len({c for _, c in want.values()}) > 1


def test_near_odd(odd_docs, no_docs):
    got = defaultdict(set)
    for x in near_dedup.near_duplicates(odd_docs).collect():
        got[x.doc_id].add((x.n_shingles, x.component_id, x.kept))
    assert got[1] == {(0, 1, True)} and got[2] == {(0, 2, True)} and got[3] == {(0, 3, True)}
    assert got[4] == {(1, 4, True)} and got[5] == {(1, 4, False)} and got[10] == {(12, 9, False)}
    assert got[8] == {(next(iter(got[7]))[0] + 1, 7, False)} and got[None] == {(12, None, True)} and got[12] == {(1, 12, True)}
    assert near_dedup.near_duplicates(no_docs).count() == 0
    left = near_dedup.drop_near_duplicates(odd_docs.where("doc_id is not null"))
    assert left.columns == [c for c in left.columns if c in odd_docs.columns] and {x.doc_id for x in left.collect()} == {1, 2, 3, 4, 7, 9, 12, 13}


def test_near_repeated_ids(spark):
    """Rows of one id are documents of their own: a text that no other row has is never lost."""
    t, u = " ".join(f"t{i}" for i in range(40)), " ".join(f"u{i}" for i in range(40))
    rows = [(3, t, "a"), (5, u, "b"), (5, t, "c"), (7, u + " v", "d"), (7, "w " * 9, "e"), (7, "w " * 9, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string").repartition(3)
    for _ in range(2):
        got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in near_dedup.near_duplicates(df).collect())
        assert got == [(3, 36, 3), (5, 36, 3), (5, 36, 5), (7, 1, 7), (7, 1, 7), (7, 37, 5)]
        left = near_dedup.drop_near_duplicates(df)
        assert left.columns == df.columns
        assert sorted((x.doc_id, x.text) for x in left.collect() if x.doc_id < 7) == [(3, t), (5, u)]
    named = df.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")
    assert {x.component_id for x in near_dedup.near_duplicates(named).collect()} == {"d3", "d5", "d7"}


def test_near_many_rows_without_words(spark, monkeypatch):
    """They take no part in joins, however many there are."""
    monkeypatch.setattr("millrace.llm.shared.HEAVY_GROUPS", 2)
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 > 0, F.lit(None)).otherwise(F.concat(F.lit("a b c d e f g h "), (F.col("id") % 40).cast("string"))).alias("text"))
    got = near_dedup.near_duplicates(df)
    assert got.count() == 400 and got.where("text is null" if "text" in got.columns else "n_shingles = 0").where("component_id <> doc_id or not kept").count() == 0
    assert got.where("n_shingles > 0").select("component_id").distinct().count() == 10


@pytest.mark.parametrize("group", [8192, 4])
def test_a_stray_in_a_large_bucket(spark, monkeypatch, group):
    """Components that share buckets without a link: the comparisons are the stray's with the others."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "GROUP", group)
    r = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(r.randrange(0, 3) if i < 70 else r.randrange(4, 9)):
            words[r.randrange(len(words))] = f"e{r.randrange(9999)}"
        rows.append((i, " ".join(words)))
    assert near(spark.createDataFrame(rows, "doc_id long, text string")) == brute_near(rows)


def test_no_task_holds_a_large_bucket(spark, monkeypatch):
    """A third of the rows in one family of near copies: no join by bucket or leader gets more than a few rows of a key."""
    r = random.Random(4)
    base = [f"w{r.randrange(9999)}" for _ in range(100)]
    family = [" ".join([*base[: (k := r.randrange(90))], f"x{i}", *base[k + 1 :]]) for i in range(700)]
    others = [" ".join(f"o{r.randrange(99999)}" for _ in range(30)) for _ in range(700)]
    docs = spark.createDataFrame(list(enumerate(family + others)), "doc_id long, text string").repartition(8)
    largest: dict[str, int] = {}
    real_groups, real_confirmed = near_dedup.attach_groups, near_dedup._Linker.confirmed

    def groups(rows, found, keys, n_rows, size):
        least = max(1, -(-n_rows // shared.HEAVY_GROUPS))
        rest = rows.join(found.where(F.col(size) >= least).select(*keys), keys, "left_anti").groupBy(*keys).count().agg(F.max("count")).first()[0]
        largest["+".join(keys)] = max(largest.get("+".join(keys), 0), rest or 0)
        return real_groups(rows, found, keys, n_rows, size)

    def confirmed(self, likely):
        dealt = likely.join(likely.groupBy("a").agg(F.ceil(F.count("*") / near_dedup.LED).alias("blocks")), "a")
        most = dealt.groupBy("a", F.pmod(F.xxhash64("b"), F.col("blocks"))).count().agg(F.max("count")).first()[0]
        largest["block"] = max(largest.get("block", 0), most or 0)
        largest["b"] = max(largest.get("b", 0), likely.groupBy("b").count().agg(F.max("count")).first()[0] or 0)
        return real_confirmed(self, likely)

    monkeypatch.setattr(shared, "HEAVY_GROUPS", 2000)
    monkeypatch.setattr(near_dedup, "LED", 64)
    monkeypatch.setattr(near_dedup, "attach_groups", groups)
    monkeypatch.setattr(near_dedup._Linker, "confirmed", confirmed)
    assert near(docs) == brute_near(list(enumerate(family + others)))
    assert largest["key"] <= 40 and largest["a"] <= 40 and largest["block"] <= 128 and largest["b"] <= 64, largest


def test_sketches_estimate():
    rng = np.random.default_rng(0)
    for j in (0.75, 0.9):
        common, own = int(4000 * j), int(4000 * (1 - j) / 2)
        pool = rng.integers(0, 2**63, common + 2 * own, dtype=np.uint64)
        a, b = np.unique(pool[: common + own]), np.unique(np.concatenate([pool[:common], pool[common + own :]]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = near_dedup.odd_sketches(near_dedup.signatures([a, b], 1024), 2048)
        differing = int(np.bitwise_count((x ^ y).view(np.uint64)).sum())
        assert abs(1 + 2048 / (4 * 1024) * np.log(1 - 2 * differing / 2048) - true) < 0.06


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(500, i) for i in range(501, 900)]
    got = {x.node: x.component for x in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert got == {n: find(n) for n in {x for e in edges if e[0] != e[1] for x in e}}
    assert near_dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("bits", [1 << 16, 1 << 29])
def test_exact_is_brute_force(spark, sf, bits):
    """A full filter only lets more rows through to the exact comparison."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    groups = defaultdict(list)
    for r in docs.collect():
        groups[hashlib.sha256(SPACE.sub(" ", r.text or "").encode()).digest()].append(r.doc_id)
    want = {d: (min(g), len(g), d == min(g)) for g in groups.values() for d in g}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(docs, max_bits=bits).collect()} == want


def test_exact_odd(odd_docs, no_docs):
    got = defaultdict(list)
    for r in exact_dedup.exact_duplicates(odd_docs).collect():
        got[r.doc_id].append((r.keep_id, r.group_size, r.kept))
    assert got[1] == [(1, 2, True)] and got[2] == [(1, 2, False)] and got[3] == [(3, 1, True)]
    assert got[4] == [(4, 3, True)] and got[5] == [(4, 3, False)] and sorted(got[10]) == [(10, 2, False), (10, 2, True)]
    assert got[None] == [(9, 2, False)]
    assert exact_dedup.exact_duplicates(no_docs).count() == exact_dedup.drop_exact_duplicates(no_docs).count() == 0
    left = exact_dedup.drop_exact_duplicates(odd_docs)
    assert left.columns == odd_docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 3, 4, 7, 8, 9, 10, 12, 13]


def test_exact_drop_repeated_ids(spark):
    rows = [(1, "a b", "x"), (1, "c", "y"), (2, "a  b", "z"), (2, "d", "z"), (2, "d", "z"), (None, "c", "n"), (None, "q", "n"), (None, "q", "n"), (3, None, "e"), (4, "", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string").repartition(4)
    left = exact_dedup.drop_exact_duplicates(df)
    assert left.columns == df.columns
    assert sorted(map(str, left.collect())) == sorted(map(str, df.where("(doc_id = 1) or (doc_id = 2 and text = 'd') or text = 'q' or doc_id = 3").distinct().collect()))


def test_shared(spark, monkeypatch):
    rows, groups = spark.range(300).selectExpr("id", "id % 7 as k"), spark.createDataFrame([(0, 43, "a"), (1, 43, "b")], "k long, n long, v string")
    want = sorted((r.id, {0: "a", 1: "b"}.get(r.k)) for r in rows.collect())
    for heavy in (100_000, 2):
        monkeypatch.setattr("millrace.llm.shared.HEAVY_GROUPS", heavy)
        assert sorted((r.id, r.v) for r in attach_groups(rows, groups, ["k"], 300, "n").collect()) == want
    got = {r.id for r in sieve(spark.range(5000), "id", spark.range(100)).collect()}
    assert set(range(100)) <= got and len(got) < 900
