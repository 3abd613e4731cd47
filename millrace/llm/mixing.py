"""Mixing sources to target weights as a time-varying curriculum.

Each source has a weight, which fixes its share of all words (targets()), and a schedule,
its relative weight over training time 0 to 1, piecewise linear between knots. Integrated
and scaled to the target, the schedule is the source's cumulative demand. A source's
documents are laid one after another in a fixed random order, pass after pass; the demand
at a copy's place, inverted, is its training position, and the mix is the copies
range-sorted by position.

The sources are part of the recipe: one row each (weights, sizes) is handled on the driver
and broadcast to the rows while there are at most BROADCAST_SOURCES, joined by a shuffle
beyond. Prefix sums inside a source, which may hold any share of the rows, come in two
levels: sums by (source, prefix of the order hash), then running sums inside each.

Nulls, ties, empty input: a null source is a source of its own, after all others; a text
that is null or blank has size 0 and is never taken; rows of equal id are documents of their own,
ordered by their texts, so that reruns agree whatever the order of the input; rows that are equal
in id, source and text are interchangeable (mixed_documents() orders them by all their columns);
rows without id are dealt by their texts; very long texts are only counted and hashed; an empty
table gives an empty result. mixed_documents() returns the columns of its input alone; only names
beginning with two underscores (__order, __source, __all, __copy, __position) are its own and must
not occur there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, word_count

MAX_PASSES = 3
BROADCAST_SOURCES = 100_000
ROWS_A_BUCKET = 1_000
MAX_BUCKETS = 1 << 16

#: Relative weight at evenly spaced times for the 1st, 2nd, 3rd, ... source, repeating: early, level and late sources.
SCHEDULES = ((1.25, 1.0, 0.75), (1.0, 1.0, 1.0), (0.75, 1.0, 1.25))
WEIGHTS = (5.0, 2.0, 1.0)


@dataclass
class Source:
    name: str | None
    size: int
    weight: float
    schedule: tuple[float, ...]
    target: float = 0.0


def targets(sources: list[Source], most: float = MAX_PASSES) -> None:
    """Share all words by weight; a target stops at most times its source's size, and the excess goes to the others by weight.

    Sources fill up in the order of size by weight, so one pass over them sorted is enough.
    """
    left, weight = float(sum(s.size for s in sources)), sum(s.weight for s in sources)
    order = sorted(sources, key=lambda s: most * s.size / s.weight)
    for i, s in enumerate(order):
        if s.weight * left < most * s.size * weight:
            for rest in order[i:]:
                rest.target = rest.weight * left / weight
            return
        s.target = float(most * s.size)
        left, weight = left - s.target, weight - s.weight


def demand_curve(schedule: tuple[float, ...]) -> list[tuple[float, float, float, float]]:
    """(share of demand so far, time, weight, slope) at the start of each segment; weights scaled so that the whole demand is 1."""
    step = 1.0 / (len(schedule) - 1)
    total = sum((a + b) / 2 * step for a, b in zip(schedule, schedule[1:], strict=False))
    out, done = [], 0.0
    for i, (a, b) in enumerate(zip(schedule, schedule[1:], strict=False)):
        out.append((done, i * step, a / total, (b - a) / total / step))
        done += (a + b) / 2 * step / total
    return out


def position(share: Column, curve: Column) -> Column:
    """The time at which the share of a demand is reached: the inverse of the curve's segment."""
    part = F.element_at(curve, F.greatest(F.size(F.filter(curve, lambda s: s["share"] <= share)), F.lit(1)))
    rest = share - part["share"]
    root = F.sqrt(F.greatest(part["weight"] * part["weight"] + 2 * part["slope"] * rest, F.lit(0.0)))
    return F.least(part["time"] + F.try_divide(2 * rest, part["weight"] + root), F.lit(1.0))


def place_in_order(key: Column, text: Column) -> Column:
    """What documents of a source are ordered by, the same in any engine: hex digits of an md5 of the id and the text's md5, so rows of one id, or of none, are spread too."""
    return F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text.cast("string"), F.lit(""))), F.lit(":mix")))


def mix(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    schedules: tuple[tuple[float, ...], ...] = SCHEDULES,
    whole: bool = False,
) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken (words, repeats counted), positions (of its copies).

    The last copy of a source's last pass is cut where the demand ends; with whole, it is taken
    whole or not at all, whichever is nearer. Texts are only read to be counted and hashed.
    """
    return _placed(docs, text, key, source, weights, schedules, whole).drop("source", "order")


def _placed(docs: DataFrame, text: str, key: str, source: str, weights: tuple[float, ...], schedules: tuple[tuple[float, ...], ...], whole: bool) -> DataFrame:
    """mix() with source and order, by which rows are found again."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), place_in_order(F.col(key), F.col(text)).alias("order"))
    narrow = materialise(rows, "sizes")
    totals = narrow.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    totals.sort(key=lambda r: (r[0] is None, r[0] or ""))
    sources = [Source(r[0], r[1], weights[i % len(weights)], schedules[i % len(schedules)]) for i, r in enumerate(totals)]
    targets(sources)
    n_rows = sum(r[2] for r in totals)
    digits = 1
    while 16**digits < min(MAX_BUCKETS, n_rows / ROWS_A_BUCKET):
        digits += 1
    table = spark.createDataFrame(
        [(s.name, s.size, round(s.target, 6), demand_curve(s.schedule)) for s in sources],
        "source string, source_size long, target double, curve array<struct<share:double,time:double,weight:double,slope:double>>",
    )
    table = F.broadcast(table) if len(sources) <= BROADCAST_SOURCES else table
    narrow = narrow.withColumn("bucket", F.substring("order", 1, digits))
    sums = narrow.groupBy("source", "bucket").agg(F.sum("size").alias("sum"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("shift"))
    inner = Window.partitionBy("source", "bucket").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    laid = narrow.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    laid = laid.join(shifts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b").withColumn("begin", F.col("inner") + F.col("shift"))
    laid = laid.join(table.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    passes = F.coalesce(F.floor(F.try_divide("target", "source_size") + 1e-9), F.lit(0)).cast("long")
    laid = laid.withColumn("passes", passes).withColumn("part", F.greatest(F.col("target") - F.col("passes") * F.col("source_size"), F.lit(0.0)))
    cut = F.least(F.greatest(F.round("part").cast("long") - F.col("begin"), F.lit(0)), F.col("size"))
    extra = F.when(F.col("begin") + F.col("size") / 2 <= F.col("part"), F.col("size")).otherwise(0) if whole else cut
    laid = laid.withColumn("extra", F.when(F.col("passes") >= MAX_PASSES, F.lit(0)).otherwise(extra).cast("long"))
    # A copy is taken if the demand reaches its first word, at its training position.
    end = F.greatest(F.col("target"), (F.col("passes") * F.col("source_size")).cast("double"))
    share = lambda i: F.try_divide((i - 1) * F.col("source_size") + F.col("begin"), end)
    copy = lambda i: F.struct(F.when(share(i) < 1, position(share(i), F.col("curve"))).alias("position"), F.when(i <= F.col("passes"), F.col("size")).otherwise(F.col("extra")).alias("words"))
    copies = F.filter(F.transform(F.sequence(F.lit(1).cast("long"), F.col("passes") + 1), copy), lambda c: c["position"].isNotNull() & (c["words"] > 0))
    laid = laid.withColumn("copies", copies)
    return laid.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        F.aggregate("copies", F.lit(0).cast("long"), lambda n, c: n + c["words"]).alias("taken"),
        F.col("copies.position").alias("positions"),
        "source",
        "order",
    )


def mixed_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """The mix itself: the rows of docs, whole, as often as they are taken, range-sorted by training position.

    Texts are shuffled twice, once to meet their positions and once to be sorted.
    """
    same = lambda by: F.row_number().over(Window.partitionBy("__order", "__source").orderBy(*by))
    named = lambda c: F.coalesce(F.concat(F.lit(":"), c.cast("string")), F.lit(""))
    mixed = _placed(docs, text, key, source, WEIGHTS, SCHEDULES, True).select(F.col("order").alias("__order"), named(F.col("source")).alias("__source"), "positions")
    mixed = mixed.withColumn("__copy", same([F.size("positions").desc(), "positions"]))
    rows = docs.withColumns({"__order": place_in_order(F.col(key), F.col(text)), "__source": named(F.col(source)), "__all": F.xxhash64(*(F.col(c) for c in docs.columns))})
    copies = rows.withColumn("__copy", same(["__all"])).join(mixed, ["__order", "__source", "__copy"]).select(*docs.columns, F.explode("positions").alias("__position"))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return copies.repartitionByRange(parts, "__position").sortWithinPartitions("__position").drop("__position")
