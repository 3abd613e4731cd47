"""Graphs of pairs: connected components, and greedy removal solved component by component."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.storage import materialise, release

#: Edges that a task contracts at a time.
HELD = 200_000
#: A component of up to FIT pairs is scanned by one task; tasks get about BUCKET pairs.
FIT, BUCKET = 1_000_000, 200_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of a task as edges from each node to the least node that it is connected with there."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def stars() -> pa.RecordBatch:
        found = [(root(x), x) for x in list(parent)]
        parent.clear()
        u, v = (np.array(c, np.int64) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(u[u < v]), pa.array(v[u < v])], ["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > HELD:
            yield stars()
    yield stars()


def _lowest(rows: DataFrame, least: Column) -> DataFrame:
    """rows (v, u) with m: the least node that is next to v, or as least says."""
    return rows.join(materialise(rows.groupBy("v").agg(least.alias("m")), "low"), "v")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (i, j): the least node that it is connected with.

    Tasks contract what they hold, edges near to each other first, so long paths become short; then
    large-star and small-star steps (Kiveris et al. 2014) alternate until nothing moves.
    """
    pairs = edges.select(F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v")).where("u < v")
    parts = max(1, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    near = pairs.repartitionByRange(parts, "u").mapInArrow(_contract, "u long, v long")
    pairs = materialise(near.distinct(), "edges")
    tally = lambda t: t.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = tally(pairs)
    while before[0]:
        both = pairs.select("v", "u").union(pairs.select(F.col("u").alias("v"), F.col("v").alias("u")))
        large = materialise(_lowest(both, F.least(F.col("v"), F.min("u"))).where("u > v").selectExpr("m as u", "u as v").where("u < v").distinct(), "large")
        small = _lowest(large.select("v", "u"), F.min("u"))
        done, pairs = pairs, materialise(small.selectExpr("m as u", "u as v").where("u < v").union(small.selectExpr("m as u", "v")).distinct(), "edges")
        release(done, large)
        after = tally(pairs)
        if after == before:
            break
        before = after
    return pairs.select(F.col("v").alias("node"), F.col("u").alias("component")).union(pairs.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())


def _scan(part: pd.DataFrame) -> pd.DataFrame:
    """What a scan in order removes, of pairs (i before j): a node is decided when all nodes before it are."""
    codes, ids = pd.factorize(np.concatenate([part.i.to_numpy(), part.j.to_numpy()]))
    first, then = codes[: len(part)], codes[len(part) :]
    order = np.argsort(first, kind="stable")
    after, begins = then[order].tolist(), np.searchsorted(first[order], np.arange(len(ids) + 1)).tolist()
    open_ = np.bincount(then, minlength=len(ids)).tolist()
    removed = [False] * len(ids)
    ready = [x for x, n in enumerate(open_) if not n]
    while ready:
        x = ready.pop()
        for y in after[begins[x] : begins[x + 1]]:
            if not removed[x]:
                removed[y] = True
            open_[y] -= 1
            if not open_[y]:
                ready.append(y)
    return pd.DataFrame({"row_id": ids[np.array(removed, bool)]})


def _by_rounds(edges: DataFrame) -> DataFrame:
    """(row_id) removed, in rounds of joins: nodes with no one before them stay and remove those after them."""
    spark, outs = edges.sparkSession, []
    while not edges.isEmpty():
        kept = edges.select(F.col("i").alias("r")).distinct().join(edges.select(F.col("j").alias("r")).distinct(), "r", "left_anti")
        out = materialise(edges.join(kept, edges.i == kept.r, "left_semi").select(F.col("j").alias("row_id")).distinct(), "out")
        left = edges.join(out, edges.i == out.row_id, "left_anti").join(out, F.col("j") == out.row_id, "left_anti")
        done, edges = edges, materialise(left.join(kept, left.i == kept.r, "left_anti"), "edges")
        outs.append(out)
        release(done)
    removed = spark.createDataFrame([], "row_id long")
    for out in outs:
        removed = removed.union(out)
    removed = materialise(removed.distinct(), "removed")
    release(*outs)
    return removed


def scanned(edges: DataFrame) -> DataFrame:
    """(row_id) of what a scan in order removes, of pairs (i, j), i before j: each row that stays removes all after it that it is paired with.

    Components are independent. Those of up to FIT pairs are scanned in tasks of about BUCKET pairs;
    larger ones are solved in rounds. Few pairs are one task's work without components.
    """
    edges = materialise(edges.select("i", "j"), "edges")
    n = edges.count()
    if n <= BUCKET:
        return edges.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(_scan, "row_id long")
    labels = components(edges).select(F.col("node").alias("i"), "component")
    named = materialise(edges.join(labels, "i"), "named")
    release(edges)
    large = materialise(named.groupBy("component").count().where(F.col("count") > FIT).select("component"), "large")
    dealt = named.join(large, "component", "left_anti").withColumn("g", F.pmod(F.xxhash64("component"), F.lit(-(-n // BUCKET))))
    small = dealt.groupBy("g").applyInPandas(_scan, "row_id long")
    if large.isEmpty():
        return small
    return small.union(_by_rounds(materialise(named.join(large, "component", "left_semi").select("i", "j"), "edges")))
