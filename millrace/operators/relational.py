"""Joins, unions, ordering and numbering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import strip
from millrace.storage import materialise


def with_row_number(df: DataFrame, name: str, *order: str) -> DataFrame:
    """A gapless number from 1, by order or by place in the input, without putting all rows into one task.

    Rows are numbered inside partitions; only one count a partition is gathered.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    marked = placed.withColumn("__id", F.monotonically_increasing_id())
    # Both uses below must see the same rows in the same partitions, so they are written once.
    marked = materialise(marked.withColumn("__part", F.shiftright("__id", 33)).withColumn("__in", F.col("__id").bitwiseAND((1 << 33) - 1)), "numbered")
    counts = marked.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    numbered = marked.join(F.broadcast(shifts), F.col("__part") == F.col("__p"))
    return numbered.withColumn(name, F.col("__in") + F.col("__shift") + 1).drop("__id", "__part", "__in", "__p", "__shift")


def inner(a: DataFrame, b: DataFrame, on: str | list[str]) -> DataFrame:
    return a.join(b, on, "inner")


def left_with_first(a: DataFrame, b: DataFrame, on: str, order: str) -> DataFrame:
    """a left join the first non-null value of each column of b in order."""
    first = b.groupBy(on).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in b.columns if c != on))
    return a.join(first, on, "left")


def group_concat(df: DataFrame, key: str, value: str, order: list[str], separator: str = ", ") -> DataFrame:
    """key, value: the group's values as one text, in order; nulls as `nan`. Values of one key end up in one row, so keys should be ids."""
    item = F.struct(*order, F.coalesce(F.col(value).cast("string"), F.lit("nan")).alias("__v"))
    texts = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["__v"])
    return df.groupBy(key).agg(F.array_join(texts, separator).alias(value))


def outer_chain(tables: list[DataFrame], key: str, fill: str | None = "none") -> DataFrame:
    """Full outer join of all tables on the key; nulls filled. All share one hash partitioning of the key."""
    joined = reduce(lambda a, b: a.join(b, key, "full"), tables)
    return joined.fillna(fill) if fill is not None else joined


def judged(qrels: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Query and document texts of the judged pairs."""
    return qrels.join(queries, "query_id").join(docs, "doc_id")


def keep_keys(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys.select(on), on, "left_semi")


def drop_keys(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys.select(on), on, "left_anti")


def all_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every row of a with every row of b: for small tables, such as trials by sites."""
    return a.crossJoin(b)


def contained_pairs(queries: DataFrame, items: DataFrame, query: str, text: str, label: str = "label") -> DataFrame:
    """All pairs, with label 1 where the text holds the query, in any case."""
    hit = F.contains(F.lower(F.col(text)), F.lower(F.col(query)))
    return queries.crossJoin(items).withColumn(label, F.coalesce(hit, F.lit(False)).cast("int"))


def lookup_both(mapping: DataFrame, left: DataFrame, right: DataFrame, left_key: str, right_key: str, order: str | None = None, missing: str = "raise") -> DataFrame:
    """Mapping rows with the first row of each side by key: first in the order column, else by the values of its columns.

    An id that a side lacks fails the query, or drops the mapping row if missing is `drop`.
    """
    for side, key in ((left, left_key), (right, right_key)):
        rest = [c for c in side.columns if c != key]
        ranked = F.struct(*([F.col(order).alias("__order")] if order in rest else []), *rest)
        first = side.groupBy(key).agg(F.min(ranked).alias("__first"))
        mapping = mapping.join(first, key, "left" if missing == "raise" else "inner")
        if missing == "raise":
            mapping = mapping.where(F.assert_true(F.col("__first").isNotNull(), F.concat(F.lit(f"no row of {key} "), F.col(key).cast("string"))).isNull())
        mapping = mapping.select("*", *(F.col(f"__first.{c}").alias(c) for c in rest)).drop("__first")
    return mapping


def matched_lists(mapping: DataFrame, sites: DataFrame, trial: str, site: str, weight: str, default: float = 1.0) -> DataFrame:
    """trial, sites: array<struct<site, weight>> of the sites that exist, by site; weight defaults."""
    known = mapping.join(sites.select(site).distinct(), site, "left_semi")
    entry = F.struct(F.col(site), F.coalesce(F.col(weight), F.lit(default)).alias(weight))
    return known.groupBy(trial).agg(F.array_sort(F.collect_list(entry)).alias("sites"))


def union_all(tables: list[DataFrame]) -> DataFrame:
    """Union of all columns; missing ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def union_ids(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.union(b), tables).distinct()


def gone(before: DataFrame, after: DataFrame, name: str) -> DataFrame:
    """Values of a column that are left in no row."""
    return before.select(name).distinct().join(after.select(name).distinct(), name, "left_anti")


def split_parts(df: DataFrame, parts: int, *order: str, name: str = "part") -> DataFrame:
    """Row ranges of equal size, the rest in the last; two jobs (a count and the numbering)."""
    n = df.count()
    size = max(1, n // parts)
    numbered = with_row_number(df, "__n", *order)
    return numbered.withColumn(name, F.least(F.floor((F.col("__n") - 1) / size), F.lit(parts - 1)).cast("int")).drop("__n")


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    """Counts by keys, and under a null key the total, in one pass."""
    return df.rollup(*keys).agg(F.count("*").alias("n"))


def value_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys)


def distinct_items(df: DataFrame, column: str, separator: str = ",") -> DataFrame:
    """Distinct trimmed items of a separated column."""
    return df.select(F.explode(F.split(column, separator)).alias("value")).select(strip("value").alias("value")).where("value <> ''").distinct()


def retention(before: DataFrame, after: DataFrame, by: str) -> DataFrame:
    """by, original, final, rate: percent that is left, to two digits, 0 where nothing was."""
    a = before.groupBy(by).agg(F.count("*").alias("original"))
    b = after.groupBy(by).agg(F.count("*").alias("final"))
    out = a.join(b, by, "full").fillna(0, ["original", "final"])
    return out.withColumn("rate", F.coalesce(F.bround(F.try_divide(100.0 * F.col("final"), "original"), 2), F.lit(0.0)))


def running_sums(df: DataFrame, order: Column, sums: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """df with a column for each of sums (name to column): its sum up to the row, in order, within by.

    Rows are dealt by ranges of by and order; running sums inside each range are shifted by the
    sums of the ranges before, one row a range and group, so no task holds a whole group.
    """
    by = by or []
    placed = materialise(df.repartitionByRange(*by, order).withColumn("__part", F.spark_partition_id()), "ranges")
    inner = Window.partitionBy(*by, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = placed.groupBy(*by, "__part").agg(*(F.sum(c).alias(f"__{n}") for n, c in sums.items()))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(F.col("__part").alias("__p"), *(F.col(c).alias(f"__by_{c}") for c in by), *(F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by], F.col("__part") == F.col("__p"))
    found = placed.select("*", *(F.sum(c).over(inner).alias(n) for n, c in sums.items())).join(shifts, same)
    return found.select(*df.columns, *((F.col(n) + F.col(f"__{n}")).alias(n) for n in sums))


def median(df: DataFrame, column: str) -> DataFrame:
    """(median) of a column, exact, by row numbers in order of the value; null if there is none."""
    values = df.select(F.col(column).cast("double").alias("v")).where("v is not null")
    numbered = with_row_number(values, "__n", "v")
    n = numbered.count()
    return numbered.where(F.col("__n").isin((n + 1) // 2, n // 2 + 1)).agg(F.avg("v").alias("median"))
