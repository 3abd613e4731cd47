"""Seeded samples as ranks of a hash, so that every engine and every run draws the same rows.

A draw orders rows by md5(id, seed). Top-n draws are ordered limits, which each partition cuts
before anything is gathered; quotas by group use counts and ranks inside groups.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.relational import with_row_number

#: Groups are dealt to 16**BUCKET_DIGITS buckets by the first digits of the draw.
BUCKET_DIGITS = 3


def draw(key: Column, seed: int = 42) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows without replacement, all rows if there are fewer."""
    return df.withColumn("__d", draw(F.col(key), seed)).orderBy("__d", key).limit(n).drop("__d")


def sample_keys(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    return sample(df.select(key).distinct(), n, key, seed)


def upsample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n draws with replacement: each slot 0 to n - 1 takes the row whose rank is a hash of the slot."""
    spark = df.sparkSession
    size = df.count()
    if not size:
        return df.limit(0)
    ranked = with_row_number(df.withColumn("__d", draw(F.col(key), seed)), "__r", "__d", key).withColumn("__r", F.col("__r") - 1).drop("__d")
    slots = spark.range(n).select(F.pmod(F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}:slot"))), 1, 8), 16, 10).cast("long"), F.lit(size)).alias("__s"))
    return slots.join(ranked, F.col("__s") == F.col("__r")).drop("__s", "__r")


def ranked(df: DataFrame, group: list[str], key: str, seed: int, name: str, most: Column | int | None = None) -> DataFrame:
    """df with the rank, from 1, of each row in its group by its draw; only ranks up to most if that is given.

    A group may hold any share of the rows: it is dealt to buckets by the first digits of the draw,
    whose counts give each bucket's first rank; ranks are then made inside buckets. Buckets that
    begin beyond most are left out before any row is shuffled to be ranked.
    """
    rows = df.withColumn("__d", draw(F.col(key), seed)).withColumn("__bucket", F.substring("__d", 1, BUCKET_DIGITS))
    counts = rows.groupBy(*group, "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(*(F.col(c).alias(f"__by_{c}") for c in group), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in group], F.col("__bucket") == F.col("__b"))
    rows = rows.join(firsts, same)
    if most is not None:
        rows = rows.where(F.col("__shift") < most)
    inside = F.row_number().over(Window.partitionBy(*group, "__bucket").orderBy("__d", key))
    rows = rows.withColumn(name, inside + F.col("__shift"))
    if most is not None:
        rows = rows.where(F.col(name) <= most)
    return rows.select(*df.columns, name)


def per_group(df: DataFrame, group: list[str], n: Column | int, key: str, seed: int = 42) -> DataFrame:
    """At most n rows of each group."""
    return ranked(df, group, key, seed, "__r", n).drop("__r")


def recovered(before: DataFrame, after: DataFrame, group: str, key: str, n: int = 10, seed: int = 42) -> DataFrame:
    """after, and up to n rows of every group of before that after has lost altogether."""
    lost = before.join(after.select(group).distinct(), group, "left_anti")
    return after.unionByName(per_group(lost, [group], n, key, seed))


def train_test(df: DataFrame, label: str, key: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """df with is_test: the same share of every label."""
    share = df.groupBy(F.col(label).alias("__label")).agg(F.round(F.count("*") * test).alias("__most"))
    rows = ranked(df, [label], key, seed, "__r").join(share, F.col(label).eqNullSafe(F.col("__label")))
    return rows.select(*df.columns, (F.col("__r") <= F.col("__most")).alias("is_test"))


def _tier_share(pool: DataFrame, quality: int, n: int, dataset: str, key: str, seed: int) -> DataFrame:
    """n rows of one tier: an even split over its datasets, the remainder to the first names, unused shares from the rest of the tier."""
    tier = pool.where(F.col("quality") == quality)
    names = [r[0] for r in tier.select(dataset).distinct().orderBy(dataset).collect()]
    d = len(names)
    share = F.create_map(*(x for i, name in enumerate(names) for x in (F.lit(name), F.lit(n // d + (1 if i < n % d else 0)))))
    marked = ranked(tier, [dataset], key, seed, "__r").withColumn("__over", (F.col("__r") > F.try_element_at(share, F.col(dataset))).cast("int")).drop("__r")
    return marked.withColumn("__d", draw(F.col(key), seed)).orderBy("__over", "__d", key).limit(n).drop("__over", "__d")


def balanced(df: DataFrame, target: int, dataset: str = "dataset_name", key: str = "row_id", seed: int = 42) -> DataFrame:
    """target rows: first a minimum from every dataset, then tiers of quality from high to low, each split evenly.

    Fewer rows than the target are drawn with replacement; none give none. The reserve of the
    minimum counts in full even where a dataset has less, and the gap is filled at the end.
    """
    n = df.count()
    if n == 0 or n == target:
        return df
    if n < target:
        return upsample(df, target, key, seed)
    k = df.select(dataset).distinct().count()
    least = max(1, target // (4 * k))
    chosen = per_group(df, [dataset], least, key, seed)
    rest = df.join(chosen.select(key), key, "left_anti")
    sizes = {r[0]: r[1] for r in rest.groupBy("quality").count().collect()}
    left, parts = target - least * k, [chosen]
    for quality in sorted(sizes, reverse=True):
        take = min(left, sizes[quality])
        if take > 0:
            parts.append(_tier_share(rest, quality, take, dataset, key, seed))
            left -= take
    picked = reduce(lambda a, b: a.unionByName(b), parts)
    have = picked.count()
    if have > target:
        return sample(picked, target, key, seed)
    if have < target:
        return picked.unionByName(sample(df.join(picked.select(key), key, "left_anti"), target - have, key, seed))
    return picked


def presampled(df: DataFrame, most: int = 50_000, target: int = 20_000, **kw) -> DataFrame:
    """Large groups are cut before the quadratic work."""
    return balanced(df, target, **kw) if df.count() > most else df


def quality_weighted(df: DataFrame, target: int, weight: float = 0.7, key: str = "row_id", seed: int = 42) -> DataFrame:
    """weight of the target from quality 1, the rest from quality 0; what one lacks the other gives."""
    n = {r[0]: r[1] for r in df.groupBy("quality").count().collect()}
    high = min(n.get(1, 0), round(target * weight))
    low = min(n.get(0, 0), target - high)
    high = min(n.get(1, 0), target - low)
    return sample(df.where("quality = 1"), high, key, seed).unionByName(sample(df.where("quality = 0"), low, key, seed))
