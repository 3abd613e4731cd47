"""URL filters: a sort-merge range join of urls with host and path rules.

A host is turned round, label by label, and every label closed by a dot (a.example.org:
"org.example.a."). A rule's host and all its subdomains are then one interval of keys,
[key, key with its last dot raised to the next character), and the intervals of two rules
are nested or apart. The rules give the boundaries of these intervals; each boundary holds
the stack of rules that are active from there on, longest first. Urls and boundaries are
sorted together by key, range-partitioned; each url takes the stack of the last boundary at
or before it, and the first rule of the stack that its path starts with decides.

Only DataFrame operations are used. Urls of one host are spread over partitions by a row
hash behind the key, so no host is a hot key. What crosses partitions is one boundary each.
A stack holds the rules of one host and its parents, so rule lists with very many paths of
one host make wide boundary rows.

Nulls, ties, empty input: a null url has an empty host and path, which no rule fits; of
rules with equal host and path the first action in alphabetical order (allow) wins; without
rules every url gets the default verdict. Rule rows with a null or empty host are ignored,
a null path is the empty path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialise

RULE_SCHEMA = "action string, host string, path string"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels from the last to the first, each closed by a dot."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def rule_rows(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules as (action, "host/path") pairs."""
    rows = [(action, rule.partition("/")[0], "/" + rule.partition("/")[2]) for action, rule in rules]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def boundaries(rules: DataFrame) -> DataFrame:
    """(key, stack): where intervals open or close, with the rules active from there on, longest first."""
    rules = rules.where("host <> ''").select("action", lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    rules = rules.groupBy("host", "path").agg(F.min("action").alias("action")).withColumn("key", host_key(F.col("host")))
    size = F.length("host") + F.length("path")
    entry = F.struct((-size).alias("order"), (-F.length("host")).alias("inner"), F.concat("host", "path").alias("rule"), F.col("path").alias("path"), F.col("action").alias("action"))
    by_host = rules.groupBy("key").agg(F.collect_list(entry).alias("own"))
    labels = F.split(F.expr("substring(key, 1, length(key) - 1)"), r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.array_join(F.slice(labels, 1, i), "."), F.lit(".")))
    lineage = by_host.select(F.col("key").alias("node"), F.explode(parents).alias("key"))
    opens = lineage.join(by_host, "key").groupBy("node").agg(F.sort_array(F.flatten(F.collect_list("own"))).alias("stack"))
    last = F.expr("substring(node, 1, length(node) - 1)")
    closes = opens.select(F.concat(last, F.lit("/")).alias("key"), F.col("node").alias("closed"))
    parent_of = lineage.where("node <> key").groupBy("node").agg(F.max_by("key", F.length("key")).alias("parent"))
    outer = opens.select(F.col("node").alias("parent"), F.col("stack").alias("outer"))
    none = F.expr("filter(array(struct(0 as order, 0 as inner, '' as rule, '' as path, '' as action)), x -> false)")
    closes = closes.join(parent_of.withColumnRenamed("node", "closed"), "closed", "left").join(outer, "parent", "left")
    return opens.select(F.col("node").alias("key"), "stack").union(closes.select("key", F.coalesce("outer", none).alias("stack")))


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """urls with host, path, rule (null if none fits) and verdict in columns of these names."""
    spark = urls.sparkSession
    n_parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kept = [c for c in urls.columns if c.lower() not in {"host", "path", "rule", "verdict"}]
    rows = urls.select(F.struct(*kept).alias("row"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    rows = rows.withColumn("key", host_key(F.col("host")))
    edges = boundaries(rules)
    empty = {f.name: f.dataType for f in edges.schema}["stack"]
    # A boundary opens before the urls of its own key and closes after those before it, so it sorts first (spread null).
    both = rows.select("key", F.xxhash64("row", "path").alias("spread"), "row", "host", "path", F.lit(None).cast(empty).alias("stack")).union(
        edges.select("key", F.lit(None).cast("long"), F.lit(None).cast(rows.schema["row"].dataType), F.lit(None).cast("string"), F.lit(None).cast("string"), "stack")
    )
    placed = both.repartitionByRange(n_parts, "key", F.col("spread").asc_nulls_first()).withColumn("part", F.spark_partition_id())
    placed = materialise(placed, "urls")  # the parts must be the same for both uses below
    inside = Window.partitionBy("part").orderBy("key", F.col("spread").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = placed.withColumn("active", F.last("stack", ignorenulls=True).over(inside))
    # The last boundary of each part holds on in the following ones; at most one row a part, computed from the rules' rows alone.
    carried = placed.groupBy("part").agg(F.max_by("stack", F.when(F.col("stack").isNotNull(), F.col("key"))).alias("end"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select("part", F.last("end", ignorenulls=True).over(before).alias("carried"))
    swept = swept.where("row is not null").join(F.broadcast(carried), "part", "left")
    active = F.coalesce("active", "carried")
    fits = swept.withColumn("hit", F.get(F.filter(active, lambda r: F.col("path").startswith(r["path"])), F.lit(0)))
    return fits.select("row.*", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.action", F.lit(default)).alias("verdict"))
