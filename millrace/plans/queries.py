"""The query list: each applies one operator to the driver tables; where SQL can express it, with the SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import arrays, numeric, parse, text
from millrace.functions.overlap import bleu, entity_f1, rouge, string_ratio, token_f1
from millrace.operators import clean, ehr, features, metrics, relational, sampling, similarity
from millrace.operators.embeddings import EmbeddingCache
from millrace.plans import convert, evaluate, pipelines, prompts
from millrace.sources import readers, writers
from millrace.storage import scratch_path

Tables = Callable[[str], DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Cosine threshold for the driver's embeddings, whose closest pairs lie at 0.5 to 0.6.
T = 0.35


def query(sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r6(c: F.Column | str) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*((r6(c).alias(c) if t == "double" else F.col(c)) for c, t in df.dtypes))


def vectors(t: Tables) -> DataFrame:
    return t("embeddings").select(F.col("vec_id").alias("row_id"), "embedding", "label")


_PAIRS = f"""e AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings),
pairs AS (SELECT a.id AS i, b.id AS j FROM e a JOIN e b ON a.id < b.id WHERE list_cosine_similarity(a.v, b.v) > {T})"""
_FOLD = """greedy AS (SELECT unnest(list_reduce(list(x ORDER BY o), lambda acc, x: CASE WHEN list_has_any(acc, x[2:]) THEN acc ELSE list_append(acc, x[1]) END, []::BIGINT[])) AS id
FROM (SELECT o, list_prepend(id, nb) AS x FROM ranked))"""


# --- near duplicates ----------------------------------------------------------------------------------------


@query(f"""WITH {_PAIRS}, ranked AS (SELECT e.id, e.id AS o, coalesce((SELECT list(i) FROM pairs WHERE j = e.id), []) AS nb FROM e), {_FOLD}
SELECT label, count(*) AS original, count(greedy.id) AS final, round_even(100.0 * count(greedy.id) / count(*), 2) AS rate
FROM e LEFT JOIN greedy USING (id) GROUP BY label""")
def dedup_within_greedy(t: Tables) -> DataFrame:
    v = vectors(t)
    kept, _ = similarity.within(v, "embedding", T)
    return relational.retention(v, kept, "label")


@query(f"WITH {_PAIRS} SELECT id AS row_id FROM e WHERE id NOT IN (SELECT j FROM pairs)")
def dedup_any_earlier(t: Tables) -> DataFrame:
    return similarity.within(vectors(t), "embedding", T, greedy=False)[0].select("row_id")


@query(f"""WITH {_PAIRS.replace('a.id < b.id', 'a.id % 2 = 1 AND b.id % 2 = 0')} SELECT id AS row_id FROM e WHERE id % 2 = 1 AND id NOT IN (SELECT i FROM pairs)""")
def dedup_cross(t: Tables) -> DataFrame:
    v = vectors(t)
    new, old = v.where("row_id % 2 = 1"), v.where("row_id % 2 = 0")
    gone = similarity.across_removed(new, old, T)
    return relational.drop_keys(new, gone, "row_id").select("row_id")


#: The second vector of two-pass queries is the first three quarters of the embedding; both passes use T2.
T2 = 0.42
_PAIRS2 = _PAIRS.replace(f"> {T}", f"> {T2}")
_HALF_PAIRS = f"half AS (SELECT a.id AS i, b.id AS j FROM e a JOIN e b ON a.id < b.id WHERE list_cosine_similarity(a.v[1:3 * len(a.v) // 4], b.v[1:3 * len(b.v) // 4]) > {T2})"


def halved(t: Tables) -> DataFrame:
    return vectors(t).withColumn("half", F.slice("embedding", F.lit(1), F.floor(3 * F.size("embedding") / 4).cast("int")))


@query(f"""WITH {_PAIRS2}, {_HALF_PAIRS}, hit AS (SELECT i, j FROM pairs UNION SELECT j, i FROM pairs UNION SELECT i, j FROM half UNION SELECT j, i FROM half)
SELECT id AS row_id FROM e WHERE label % 2 = 1 AND id NOT IN (SELECT i FROM hit JOIN e o ON o.id = j WHERE o.label % 2 = 0)""")
def dedup_two_pass_union(t: Tables) -> DataFrame:
    v = halved(t)
    return similarity.qa_across(v.where("label % 2 = 1"), v.where("label % 2 = 0"), T2, "embedding", "half")[0].select("row_id")


def _fold(name: str, source: str) -> str:
    return _FOLD.replace("greedy AS", f"{name} AS").replace("FROM ranked", f"FROM {source}")


@query(f"""WITH {_PAIRS}, n AS (SELECT id, row_number() OVER (ORDER BY label % 2 DESC, id) AS o FROM e),
ranked AS (SELECT n.id, n.o, coalesce(list(CASE WHEN y.o < n.o THEN y.id END) FILTER (y.o < n.o), []) AS nb FROM n
  LEFT JOIN (SELECT i, j FROM pairs UNION ALL SELECT j, i FROM pairs) p ON p.j = n.id LEFT JOIN n y ON y.id = p.i GROUP BY n.id, n.o), {_FOLD}
SELECT id AS row_id FROM greedy""")
def dedup_quality_first(t: Tables) -> DataFrame:
    v = vectors(t).withColumn("quality", F.col("label") % 2)
    gone = pipelines.removed_by_quality(v, "embedding", T)
    return relational.drop_keys(v, gone, "row_id").select("row_id")


@query(f"""WITH {_PAIRS2}, {_HALF_PAIRS}, r1 AS (SELECT e.id, e.id AS o, coalesce((SELECT list(i) FROM pairs WHERE j = e.id), []) AS nb FROM e), {_fold('g1', 'r1')},
r2 AS (SELECT g1.id, g1.id AS o, coalesce((SELECT list(i) FROM half WHERE j = g1.id AND i IN (SELECT id FROM g1)), []) AS nb FROM g1), {_fold('g2', 'r2')} SELECT id AS row_id FROM g2""")
def dedup_questions_then_answers(t: Tables) -> DataFrame:
    return similarity.qa_within(halved(t), T2, "embedding", "half")[0].select("row_id")


@query(f"""WITH {_PAIRS}, p2 AS (SELECT i, j FROM pairs JOIN e a ON a.id = i JOIN e b ON b.id = j WHERE a.label % 2 = b.label % 2),
r1 AS (SELECT e.id, e.id AS o, coalesce((SELECT list(i) FROM p2 WHERE j = e.id), []) AS nb FROM e WHERE label % 2 = 0), {_fold('g1', 'r1')},
r2 AS (SELECT e.id, e.id AS o, coalesce((SELECT list(i) FROM p2 WHERE j = e.id), []) AS nb FROM e WHERE label % 2 = 1), {_fold('g2', 'r2')},
k2 AS (SELECT id FROM g2 WHERE id NOT IN (SELECT i FROM pairs WHERE j IN (SELECT id FROM g1) UNION SELECT j FROM pairs WHERE i IN (SELECT id FROM g1)))
SELECT 0 AS run, id AS row_id FROM g1 UNION ALL SELECT 1, id FROM k2 UNION ALL SELECT 2, id FROM k2""")
def incremental_dedup(t: Tables) -> DataFrame:
    """Two corpora one after the other; the second is run twice, as after a failure, and keeps the same rows."""
    v = vectors(t)
    path = shared_path(v, "index")
    runs = [(0, v.where("label % 2 = 0")), (1, v.where("label % 2 = 1")), (1, v.where("label % 2 = 1"))]
    parts = [pipelines.incremental(rows, path, T, batch=n).select(F.lit(i).alias("run"), "row_id") for i, (n, rows) in enumerate(runs)]
    return relational.union_all(parts)


@query("""WITH d AS (SELECT min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT doc_id, trim(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g')) AS k FROM documents) GROUP BY k) SELECT doc_id, copies FROM d""")
def dedup_exact_text(t: Tables) -> DataFrame:
    key = F.trim(F.regexp_replace(F.lower(F.trim("text")), r"\s+", " "))
    return t("documents").groupBy(key.alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("k")


@query(f"WITH {_PAIRS} SELECT i, j, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM pairs JOIN e a ON a.id = i JOIN e b ON b.id = j")
def cosine_pairs(t: Tables) -> DataFrame:
    return rounded(similarity.cosine_pairs(vectors(t), T))


@query("""WITH e AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT least(greatest(floor((round(list_cosine_similarity(a.v, b.v), 9) + 1) / 2 * 50), 0), 49)::INT AS bin, count(*) AS pairs FROM e a JOIN e b ON a.id < b.id GROUP BY 1""")
def similarity_histogram(t: Tables) -> DataFrame:
    return similarity.similarity_histogram(vectors(t))


@query()
def embed_and_compare(t: Tables) -> DataFrame:
    b = similarity.embedded(t("benchmark").withColumnRenamed("item_id", "row_id"), F.col("text"), "embedding")
    return rounded(similarity.cosine_pairs(b, 0.2))


# --- cleaning, counts ------------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT source, count(*) AS original FROM documents GROUP BY 1), b AS (SELECT source, count(*) AS final FROM documents WHERE n_chars >= 1000 GROUP BY 1)
SELECT source, coalesce(original, 0) AS original, coalesce(final, 0) AS final, coalesce(round_even(100.0 * coalesce(final, 0) / original, 2), 0) AS rate FROM a FULL JOIN b USING (source)""")
def retention_by_source(t: Tables) -> DataFrame:
    d = t("documents")
    return relational.retention(d, d.where("n_chars >= 1000"), "source")


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY ROLLUP (source, lang)")
def counts_and_totals(t: Tables) -> DataFrame:
    return relational.counts_by(t("documents"), "source", "lang")


@query(r"""WITH x AS (SELECT regexp_replace(split_part(text, chr(10), 1), '^\s+|\s+$', '', 'g') AS question, regexp_replace(substr(text, strpos(text, chr(10)) + 1), '^\s+|\s+$', '', 'g') AS answer FROM documents WHERE strpos(text, chr(10)) > 0)
SELECT question, answer, answer || chr(10) || '-' AS answer_long, answer || chr(10) || '-' AS dedup_answer, 'documents' AS dataset_name, 1 AS quality FROM x WHERE question NOT IN ('', 'nan') AND answer NOT IN ('', 'nan')""")
def standardize_qa(t: Tables) -> DataFrame:
    cut = F.split("text", "\n", 2)
    rows = t("documents").where(F.contains(F.col("text"), F.lit("\n"))).select(F.concat(F.lit("\t"), cut[0], F.lit(" \r\n")).alias("q"), F.concat(cut[1], F.lit("\n\t")).alias("a"), F.concat(text.strip(cut[1]), F.lit("\n-\n")).alias("l"))
    return clean.standardise_qa(rows, "documents", 1, "q", "a", "l")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 > 0 AND text IS NOT NULL AND regexp_replace(text, '\\s', '', 'g') <> '' AND lower(source) NOT IN ('', 'none', 'nan')")
def filter_blank(t: Tables) -> DataFrame:
    d = t("documents").withColumn("first", F.when(F.col("doc_id") % 3 == 0, F.lit("\t\n ")).otherwise(F.col("text")))
    return clean.drop_blank(d, ["first"]).where(~text.is_nullish(F.concat(F.col("source"), F.lit("\t")))).select("doc_id")


@query("SELECT 'part' AS source, p_name AS question, p_type AS answer, 'p_partkey: ' || p_partkey || ', p_brand: ' || p_brand || ', p_size: ' || p_size AS meta_info FROM part")
def meta_fold(t: Tables) -> DataFrame:
    return clean.folded(t("part").select("p_partkey", "p_brand", "p_size", "p_name", "p_type"), "part", "p_name", "p_type")


@query("SELECT c_custkey, trim(c_name) || ' ' || trim(c_mktsegment) AS combined_text, lower(trim(c_name) || ' ' || trim(c_mktsegment)) AS combined_text_lower FROM customer")
def combined_text(t: Tables) -> DataFrame:
    return clean.with_combined_text(t("customer"), ["c_name", "c_mktsegment", "no_such"]).select("c_custkey", "combined_text", "combined_text_lower")


@query("SELECT doc_id, length(text) AS n, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))::INT AS words FROM documents")
def text_features(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", F.length("text").cast("long").alias("n"), text.word_count(F.col("text")).alias("words"))


@query("SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z]{3,}')), ' ')) AS keywords FROM documents")
def keywords(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", F.md5(text.keywords(F.col("text"))).alias("keywords"))


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, greatest(len(w) - 1, 0)::INT AS n, CASE WHEN len(w) > 1 THEN w[1] || ' ' || w[2] END AS first FROM w""")
def bigrams(t: Tables) -> DataFrame:
    d = t("documents").select("doc_id", text.bigrams(F.col("text")).alias("b"))
    return d.select("doc_id", F.size("b").alias("n"), F.get("b", F.lit(0)).alias("first"))


@query("SELECT doc_id, md5(regexp_replace(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '[^\\p{L}\\p{N}_\\s]', '', 'g')) AS normal FROM documents")
def normalize(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", F.md5(text.normalize_text(F.col("text"))).alias("normal"))


def criteria_texts(t: Tables) -> DataFrame:
    return t("part").select("p_partkey", F.concat_ws("\n", F.lit("Inclusion Criteria:"), "p_name", F.lit(""), "p_type", F.lit("Exclusion Criteria:"), "p_brand").alias("c"))


@query("SELECT p_partkey, lower(trim(p_name)) || '|' || lower(trim(p_type)) AS inclusion, lower(trim(p_brand)) AS exclusion FROM part")
def criteria_split(t: Tables) -> DataFrame:
    s = criteria_texts(t).select("p_partkey", text.split_criteria(F.col("c")).alias("s"))
    return s.select("p_partkey", F.array_join("s.inclusion", "|").alias("inclusion"), F.array_join("s.exclusion", "|").alias("exclusion"))


@query("SELECT p_partkey, trim(p_name) || ' ' || trim(p_type) AS inclusion, trim(p_brand) AS exclusion FROM part")
def criteria_sections(t: Tables) -> DataFrame:
    return criteria_texts(t).select("p_partkey", text.split_criteria_sections(F.col("c")).alias("s")).select("p_partkey", "s.inclusion", "s.exclusion")


@query("SELECT p_partkey, trim(p_name) || chr(10) || trim(p_type) AS inclusion, trim(p_brand) AS exclusion FROM part")
def criteria_eligibility(t: Tables) -> DataFrame:
    return criteria_texts(t).select("p_partkey", text.split_eligibility(F.col("c")).alias("s")).select("p_partkey", "s.inclusion", "s.exclusion")


@query("SELECT p_partkey, 'inclusion criteria:|' || lower(trim(p_name)) || '|' || lower(trim(p_type)) AS inclusion, 'exclusion criteria:|' || lower(trim(p_brand)) AS exclusion FROM part")
def criteria_protocol(t: Tables) -> DataFrame:
    s = criteria_texts(t).select("p_partkey", text.split_protocol(F.col("c")).alias("s"))
    return s.select("p_partkey", F.array_join("s.inclusion", "|").alias("inclusion"), F.array_join("s.exclusion", "|").alias("exclusion"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'inclusion criteria: ' || p_name || chr(10) || 'exclusion criteria: ' || p_brand WHEN 1 THEN 'exclusion criteria: ' || p_brand || chr(10) || 'inclusion criteria: ' || p_name ELSE 'x' END AS t, CASE p_partkey % 3 WHEN 2 THEN 'Inclusion Criteria:' || chr(10) || 'x' || chr(10) || 'Exclusion Criteria:' || chr(10) ELSE 'inclusion criteria: ' || p_name || chr(10) || 'exclusion criteria: ' || p_brand END AS marked FROM part")
def criteria_marked(t: Tables) -> DataFrame:
    inc, exc = F.concat(F.lit("inclusion criteria: "), "p_name"), F.concat(F.lit("exclusion criteria: "), "p_brand")
    k = F.col("p_partkey") % 3
    c = F.when(k == 0, F.concat_ws("\n", inc, exc)).when(k == 1, F.concat_ws("\n", exc, inc)).otherwise("x")
    return t("part").select("p_partkey", c.alias("t"), text.marked_criteria(c).alias("marked"))


@query("SELECT count(*) AS rows, count(*) FILTER (quality IS NULL) AS nulls, 'quality' AS \"column\", 'int' AS type FROM documents LEFT JOIN labels USING (doc_id)")
def null_report(t: Tables) -> DataFrame:
    return clean.null_report(t("documents").join(t("labels"), "doc_id", "left").select(F.col("quality").cast("int").alias("quality")))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'P' THEN 0 END AS outcome FROM orders")
def status_outcome(t: Tables) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", " Completed ").when(F.col("o_orderstatus") == "P", "TERMINATED").otherwise("Recruiting")
    return t("orders").select("o_orderkey", clean.status_outcome(status).alias("outcome"))


@query("SELECT d.doc_id, coalesce(l.toxic, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END)::INT AS outcome FROM documents d LEFT JOIN labels l USING (doc_id)")
def label_overlay(t: Tables) -> DataFrame:
    d = t("documents").join(t("labels"), "doc_id", "left")
    return d.select("doc_id", clean.outcome(F.when(F.col("n_chars") > 1500, "completed").otherwise("withdrawn"), F.col("toxic")).alias("outcome"))


@query("SELECT c_custkey, 'Automobile cars' AS seg FROM customer WHERE c_mktsegment = 'AUTOMOBILE' UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment <> 'AUTOMOBILE'")
def decode_codes(t: Tables) -> DataFrame:
    return clean.decoded(t("customer"), {"c_mktsegment": {"AUTOMOBILE": "Automobile cars"}}).select("c_custkey", F.col("c_mktsegment").alias("seg"))


@query("SELECT p_partkey FROM part WHERE (lower(p_type) LIKE '%medium%' OR lower(p_type) LIKE '%promo%') AND lower(p_brand) LIKE '%#1%'")
def search_and(t: Tables) -> DataFrame:
    return clean.filter_by_criteria(t("part"), {"p_type": ["Medium", "PROMO"], "p_brand": "#1"}).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%blue%' OR lower(p_type) LIKE '%blue%'")
def search_or(t: Tables) -> DataFrame:
    return clean.search(t("part"), "Blue", ["p_name", "p_type"]).select("p_partkey")


@query("SELECT DISTINCT trim(v) AS value FROM (SELECT unnest(string_split(p_type, ' ')) AS v FROM part) WHERE trim(v) <> ''")
def filter_values(t: Tables) -> DataFrame:
    return relational.distinct_items(t("part"), "p_type", " ")


@query("SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS cut FROM documents")
def truncated_text(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", text.truncate(F.col("text"), 500).alias("cut"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN substr(p_type, 1, 5) WHEN 2 THEN p_brand || '. Condition: ' || p_type ELSE 'N/A' END AS summary FROM part")
def summary_fill(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 4
    c = lambda n, col: F.when(k == n, F.col(col)).otherwise(F.lit("none"))
    return t("part").select("p_partkey", clean.summary(c(0, "p_name"), c(1, "p_type"), c(2, "p_brand"), c(2, "p_type"), 5).alias("summary"))


# --- joins, sets, order ---------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ', ' ORDER BY l_linenumber, l_partkey) AS l_partkey FROM lineitem GROUP BY 1")
def group_concat_by_key(t: Tables) -> DataFrame:
    return relational.group_concat(t("lineitem"), "l_orderkey", "l_partkey", ["l_linenumber", "l_partkey"])


@query("""SELECT coalesce(a.k, b.k) AS nationkey, coalesce(customers, 'none') AS customers, coalesce(suppliers, 'none') AS suppliers, coalesce(name, 'none') AS name
FROM (SELECT c_nationkey AS k, count(*)::VARCHAR AS customers FROM customer WHERE c_nationkey % 2 = 0 GROUP BY 1) a
FULL JOIN (SELECT coalesce(s.k, n.k) AS k, suppliers, name FROM (SELECT s_nationkey AS k, count(*)::VARCHAR AS suppliers FROM supplier GROUP BY 1) s FULL JOIN (SELECT n_nationkey AS k, n_name AS name FROM nation) n ON s.k = n.k) b ON a.k = b.k""")
def outer_merge_chain(t: Tables) -> DataFrame:
    text_count = lambda df, k, n: df.groupBy(F.col(k).alias("nationkey")).agg(F.count("*").cast("string").alias(n))
    a = text_count(t("customer").where("c_nationkey % 2 = 0"), "c_nationkey", "customers")
    return relational.outer_chain([a, text_count(t("supplier"), "s_nationkey", "suppliers"), t("nation").select(F.col("n_nationkey").alias("nationkey"), F.col("n_name").alias("name"))], "nationkey")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def inner_split_merge(t: Tables) -> DataFrame:
    return relational.inner(t("orders").withColumnRenamed("o_custkey", "k"), t("customer").withColumnRenamed("c_custkey", "k"), "k").select("o_orderkey", "c_name")


@query("SELECT c_custkey, (SELECT arg_min(o_orderkey, o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS o_orderkey, (SELECT arg_min(o_orderpriority, o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS o_orderpriority FROM customer")
def left_first_row(t: Tables) -> DataFrame:
    o = t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderpriority", F.col("o_orderkey").alias("__o"))
    return relational.left_with_first(t("customer").select("c_custkey"), o, "c_custkey", "__o").drop("__o")


@query("SELECT o_orderkey AS doc_id, c_custkey AS query_id, c_name AS question, o_orderstatus AS answer FROM orders JOIN customer ON o_custkey = c_custkey")
def qrel_three_way(t: Tables) -> DataFrame:
    o = t("orders")
    qrels = o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"))
    return relational.judged(qrels, t("customer").select(F.col("c_custkey").alias("query_id"), F.col("c_name").alias("question")), o.select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("answer")))


@query("""WITH k AS (SELECT DISTINCT o_custkey AS c FROM orders), s AS (SELECT c FROM k ORDER BY md5(c::VARCHAR || ':42'), c LIMIT 50)
SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c FROM s)""")
def semi_sample_keys(t: Tables) -> DataFrame:
    return relational.keep_keys(t("orders"), sampling.sample_keys(t("orders"), 50, "o_custkey"), "o_custkey").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def anti_ids(t: Tables) -> DataFrame:
    return relational.drop_keys(t("customer"), t("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey")


@query("SELECT DISTINCT o_orderpriority FROM orders EXCEPT SELECT o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '1%'")
def except_names(t: Tables) -> DataFrame:
    o = t("orders")
    return relational.gone(o, o.where("o_orderstatus = 'F' and o_orderpriority like '1%'"), "o_orderpriority")


@query("SELECT c_name AS name, c_mktsegment AS segment, NULL::INT AS nation FROM customer UNION ALL SELECT s_name, NULL, s_nationkey FROM supplier")
def union_all_missing(t: Tables) -> DataFrame:
    return relational.union_all([t("customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")), t("supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))])


@query("SELECT DISTINCT k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def union_of_ids(t: Tables) -> DataFrame:
    return relational.union_ids([t("customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("k")), t("supplier").where("s_acctbal > 5000").select("s_nationkey")])


@query("SELECT n_name, r_name, (contains(lower(r_name), lower(n_name)))::INT AS label FROM nation CROSS JOIN region")
def cross_pair_contains(t: Tables) -> DataFrame:
    return relational.contained_pairs(t("nation").select("n_name"), t("region").select("r_name"), "n_name", "r_name")


@query("""WITH m AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0))
SELECT l_partkey, string_agg(l_suppkey::VARCHAR, ',' ORDER BY l_suppkey) AS sites, count(*)::DOUBLE AS weight FROM m GROUP BY 1""")
def trial_site_lists(t: Tables) -> DataFrame:
    m = t("lineitem").select("l_partkey", "l_suppkey", F.lit(None).cast("double").alias("enrollment")).distinct()
    s = t("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    out = relational.matched_lists(m, s, "l_partkey", "l_suppkey", "enrollment")
    total = F.aggregate("sites", F.lit(0.0), lambda a, x: a + x["enrollment"])
    return out.select("l_partkey", F.array_join(F.transform("sites", lambda x: x["l_suppkey"].cast("string")), ",").alias("sites"), total.alias("weight"))


@query("SELECT o_orderkey, least((row_number() OVER (ORDER BY o_orderkey) - 1) // greatest(1, (SELECT count(*) FROM orders) // 7), 6)::INT AS part FROM orders")
def split_n_parts(t: Tables) -> DataFrame:
    return relational.split_parts(t("orders").select("o_orderkey"), 7, "o_orderkey")


@query("SELECT count(*) AS n, p_brand FROM part GROUP BY p_brand")
def brand_counts(t: Tables) -> DataFrame:
    return relational.value_counts(t("part"), "p_brand")


# --- samples -------------------------------------------------------------------------------------------------------


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR || ':42'), doc_id LIMIT 100")
def sample_seeded(t: Tables) -> DataFrame:
    return sampling.sample(t("documents").select("doc_id"), 100, "doc_id")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR || ':42'), doc_id) AS r FROM documents) WHERE r <= 5")
def stratified_sample(t: Tables) -> DataFrame:
    return sampling.per_group(t("documents"), ["source"], 5, "doc_id").select("doc_id")


@query("SELECT doc_id, r <= round(n * 0.2) AS is_test FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR || ':42'), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)")
def train_test_split(t: Tables) -> DataFrame:
    return sampling.train_test(t("documents"), "lang", "doc_id").select("doc_id", "is_test")


@query("""WITH d AS (SELECT doc_id, source, coalesce(quality, 0)::INT AS quality, md5(doc_id::VARCHAR || ':42') AS h FROM documents LEFT JOIN labels USING (doc_id)),
m AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS r FROM d), k AS (SELECT count(DISTINCT source) AS k FROM d),
c AS (SELECT m.* FROM m, k WHERE r <= greatest(1, 100 // (4 * k))), rest AS (SELECT m.* FROM m, k WHERE r > greatest(1, 100 // (4 * k))),
n AS (SELECT quality, count(*) AS n FROM rest GROUP BY 1), need AS (SELECT 100 - k * greatest(1, 100 // (4 * k)) AS need FROM k),
take AS (SELECT quality, greatest(0, least(n, need - coalesce(sum(n) OVER (ORDER BY quality DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS take FROM n, need),
names AS (SELECT quality, source, row_number() OVER (PARTITION BY quality ORDER BY source) AS i, count(*) OVER (PARTITION BY quality) AS d FROM (SELECT DISTINCT quality, source FROM rest)),
q AS (SELECT names.quality, source, take // d + CASE WHEN i <= take % d THEN 1 ELSE 0 END AS quota, take FROM names JOIN take USING (quality)),
o AS (SELECT rest.*, q.take, (row_number() OVER (PARTITION BY rest.quality, rest.source ORDER BY h, doc_id) > quota)::INT AS over FROM rest JOIN q ON rest.quality = q.quality AND rest.source = q.source),
f AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY over, h, doc_id) AS p FROM o)
SELECT doc_id FROM c UNION ALL SELECT doc_id FROM f WHERE p <= take""")
def sample_min_then_tier(t: Tables) -> DataFrame:
    d = t("documents").join(t("labels"), "doc_id", "left").select(F.col("doc_id").alias("row_id"), F.col("source").alias("dataset_name"), F.coalesce("quality", F.lit(0)).cast("int").alias("quality"))
    return sampling.balanced(d, 100).select(F.col("row_id").alias("doc_id"))


@query("""WITH r AS (SELECT item_id, row_number() OVER (ORDER BY md5(item_id::VARCHAR || ':42'), item_id) - 1 AS r, count(*) OVER () AS n FROM benchmark),
s AS (SELECT ('0x' || substr(md5(i::VARCHAR || ':42:slot'), 1, 8))::BIGINT AS h FROM range(500) x(i)) SELECT item_id FROM s JOIN r ON h % n = r""")
def upsample(t: Tables) -> DataFrame:
    return sampling.upsample(t("benchmark"), 500, "item_id").select("item_id")


@query("""WITH k AS (SELECT * FROM documents WHERE source NOT IN ('src1', 'src2')) SELECT doc_id FROM k UNION ALL
SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR || ':42'), doc_id) AS r FROM documents WHERE source IN ('src1', 'src2')) WHERE r <= 10""")
def recovery(t: Tables) -> DataFrame:
    d = t("documents").select("doc_id", "source")
    return sampling.recovered(d, d.where("source not in ('src1', 'src2')"), "source", "doc_id").select("doc_id")


@query("""WITH d AS (SELECT doc_id, quality, md5(doc_id::VARCHAR || ':42') AS h FROM labels), n AS (SELECT count(*) FILTER (quality = 1) AS a, count(*) FILTER (quality = 0) AS b FROM d),
s AS (SELECT least(a, 100 - least(b, 100 - least(a, 70))) AS hi, least(b, 100 - least(a, 70)) AS lo FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY h, doc_id) AS r FROM d)
SELECT doc_id FROM r, s WHERE r <= CASE WHEN quality = 1 THEN hi ELSE lo END""")
def quality_weighted_sample(t: Tables) -> DataFrame:
    return sampling.quality_weighted(t("labels"), 100, key="doc_id").select("doc_id")


# --- scores ---------------------------------------------------------------------------------------------------------


def answers(t: Tables) -> DataFrame:
    """truth: the order's status; prediction: a rule on its priority, null for some."""
    p = F.substring("o_orderpriority", 1, 1)
    guess = F.when(p.isin("1", "2"), "F").when(p == "3", "O").when(p == "4", "P").otherwise(F.when(F.col("o_orderkey") % 2 == 0, "X"))
    return t("orders").select("o_orderkey", F.col("o_orderstatus").alias("truth"), guess.alias("prediction"))


_ANSWERS = """a AS (SELECT o_orderkey, o_orderstatus AS truth, CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'F' WHEN substr(o_orderpriority, 1, 1) = '3' THEN 'O'
  WHEN substr(o_orderpriority, 1, 1) = '4' THEN 'P' WHEN o_orderkey % 2 = 0 THEN 'X' END AS prediction FROM orders), p AS (SELECT truth, coalesce(prediction, '__NO_PREDICTION__') AS prediction FROM a),
labels_ AS (SELECT truth AS label FROM p UNION SELECT prediction FROM p),
k AS (SELECT label, count(*) FILTER (truth = label AND prediction = label) AS tp, count(*) FILTER (prediction = label) AS pp, count(*) FILTER (truth = label) AS support FROM labels_ CROSS JOIN p GROUP BY label),
c AS (SELECT label, CASE WHEN pp > 0 THEN tp / pp ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall, CASE WHEN pp + support > 0 THEN 2 * tp / (pp + support) ELSE 0 END AS f1, support FROM k)"""


@query(f"WITH {_ANSWERS} SELECT x.label AS truth, y.label AS prediction, count(p.truth) AS n FROM labels_ x CROSS JOIN labels_ y LEFT JOIN p ON p.truth = x.label AND p.prediction = y.label GROUP BY ALL")
def confusion(t: Tables) -> DataFrame:
    return metrics.confusion(answers(t))


@query(f"WITH {_ANSWERS} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM c")
def per_class_prf(t: Tables) -> DataFrame:
    return rounded(metrics.per_class(answers(t)))


@query(f"""WITH {_ANSWERS} SELECT {', '.join(f"round(avg({m}), 6) AS macro_{m}, round(avg({m}) FILTER (support > 0), 6) AS valid_{m}, round(sum({m} * support) / sum(support), 6) AS weighted_{m}" for m in ('precision', 'recall', 'f1'))} FROM c""")
def macro_and_weighted(t: Tables) -> DataFrame:
    return rounded(metrics.averages(metrics.per_class(answers(t))))


@query(f"WITH {_ANSWERS} SELECT count(*) AS evaluated, count(*) FILTER (truth = prediction) AS correct, count(*) FILTER (prediction = '__NO_PREDICTION__') AS failed, count(*) FILTER (prediction = 'X') AS invalid FROM p")
def evaluation_counts(t: Tables) -> DataFrame:
    return metrics.evaluation_counts(answers(t))


@query(f"WITH {_ANSWERS} SELECT count(*) AS n, round(avg((truth = prediction)::INT), 6) AS accuracy FROM p WHERE prediction IN ('F', 'O', 'P')")
def valid_only(t: Tables) -> DataFrame:
    return metrics.valid_only(answers(t), "prediction", ["F", "O", "P"]).agg(F.count("*").alias("n"), r6(metrics.accuracy(F.col("truth"), F.col("prediction"))).alias("accuracy"))


@query("""WITH x AS (SELECT CASE WHEN quality = 1 THEN 'Successful' ELSE 'Failed' END AS t, CASE doc_id % 3 WHEN 0 THEN 'Successful' WHEN 1 THEN 'Failed' END AS p0 FROM labels),
y AS (SELECT t, coalesce(p0, CASE t WHEN 'Successful' THEN 'Failed' ELSE 'Successful' END) AS p FROM x),
k AS (SELECT count(*) AS evaluated, count(*) FILTER (t = p) AS hit, count(*) FILTER (t = 'Successful' AND p = 'Successful') AS tp, count(*) FILTER (t = 'Failed' AND p = 'Successful') AS fp, count(*) FILTER (t = 'Successful') AS a, count(*) FILTER (t = 'Failed') AS b FROM y),
m AS (SELECT *, tp / (tp + fp) AS pr, tp / a AS re FROM k)
SELECT evaluated, round(hit / evaluated, 6) AS accuracy, round(pr, 6) AS precision, round(re, 6) AS recall, round(2 * pr * re / (pr + re), 6) AS f1, round((re + 1 - fp / b) / 2, 6) AS roc_auc, round(pr * re + (1 - re) * a / evaluated, 6) AS average_precision FROM m""")
def binary_missing_opposite(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 3
    rows = t("labels").select(F.when(F.col("quality") == 1, "Successful").otherwise("Failed").alias("t"), F.when(k == 0, "Successful").when(k == 1, "Failed").alias("p"))
    return rounded(metrics.binary_metrics(rows, "t", "p", ("Successful", "Failed")))


@query(f"""WITH {_ANSWERS}, z AS (SELECT truth, CASE WHEN prediction IN ('F', 'O', 'P') THEN prediction WHEN truth = 'F' THEN 'O' WHEN truth = 'O' THEN 'P' ELSE 'F' END AS p FROM p),
k2 AS (SELECT label, count(*) FILTER (truth = label AND p = label) AS tp, count(*) FILTER (p = label) AS pp, count(*) FILTER (truth = label) AS support FROM (SELECT DISTINCT truth AS label FROM z UNION SELECT p FROM z) CROSS JOIN z GROUP BY label)
SELECT count(*) AS evaluated, round(avg((truth = p)::INT), 6) AS accuracy, (SELECT round(avg(coalesce(tp / nullif(pp, 0), 0)), 6) FROM k2) AS macro_precision, (SELECT round(avg(coalesce(2 * tp / nullif(pp + support, 0), 0)), 6) FROM k2) AS macro_f1 FROM z""")
def multiclass_cycle(t: Tables) -> DataFrame:
    return rounded(metrics.multiclass_metrics(answers(t), "truth", "prediction", ["F", "O", "P"]).select("evaluated", "accuracy", "macro_precision", "macro_f1"))


@query("""WITH x AS (SELECT l_linenumber % 5 AS t1, l_quantity::INT % 5 AS t2, l_partkey % 5 AS t3, CASE WHEN l_orderkey % 4 > 0 THEN 1 END AS ok, l_suppkey % 5 AS p1, l_quantity::INT % 5 AS p2, l_orderkey % 5 AS p3 FROM lineitem),
l AS (SELECT 'max' AS part, t1 AS t, CASE WHEN ok = 1 THEN p1 ELSE (t1 + 1) % 5 END AS p FROM x UNION ALL SELECT 'min', t2, CASE WHEN ok = 1 THEN p2 ELSE (t2 + 1) % 5 END FROM x UNION ALL SELECT 'avg', t3, CASE WHEN ok = 1 THEN p3 ELSE (t3 + 1) % 5 END FROM x)
SELECT part, round(avg((t = p)::INT), 6) AS accuracy FROM l GROUP BY part
UNION ALL SELECT 'mean', round(avg(a), 6) FROM (SELECT avg((t = p)::INT) AS a FROM l GROUP BY part) UNION ALL SELECT 'all', round(avg(coalesce(ok = 1 AND t1 = p1 AND t2 = p2 AND t3 = p3, false)::INT), 6) FROM x""")
def multilabel_dose(t: Tables) -> DataFrame:
    m = lambda c: F.pmod(F.col(c).cast("int"), F.lit(5))
    truth = F.struct(m("l_linenumber").alias("max"), m("l_quantity").alias("min"), m("l_partkey").alias("avg"))
    guess = F.when(F.col("l_orderkey") % 4 > 0, F.struct(m("l_suppkey").alias("max"), m("l_quantity").alias("min"), m("l_orderkey").alias("avg")))
    return rounded(metrics.dose_metrics(t("lineitem").select(truth.alias("truth"), guess.alias("prediction")), "truth", "prediction").select("part", "accuracy"))


def scored(t: Tables) -> DataFrame:
    return t("labels").join(t("documents"), "doc_id").select("quality", (F.col("n_chars") / 100).cast("int").alias("score"))


_SCORED = "s AS (SELECT quality, (n_chars // 100)::INT AS score FROM labels JOIN documents USING (doc_id))"


@query(f"""WITH {_SCORED}, r AS (SELECT quality, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rank FROM s)
SELECT round((sum(rank) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2) / (count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0)), 6) AS roc_auc FROM r""")
def roc_auc(t: Tables) -> DataFrame:
    return rounded(metrics.roc_auc(scored(t), "quality", "score"))


@query(f"""WITH {_SCORED}, d AS (SELECT score, sum(quality) AS pos, count(*) AS n FROM s GROUP BY 1), c AS (SELECT pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM d WINDOW w AS (ORDER BY score DESC))
SELECT round(sum(pos * tp / seen) / sum(pos), 6) AS average_precision FROM c""")
def average_precision(t: Tables) -> DataFrame:
    return rounded(metrics.average_precision(scored(t), "quality", "score"))


@query(f"""WITH {_ANSWERS}, v AS (SELECT * FROM p WHERE prediction IN (SELECT truth FROM p)),
h AS (SELECT label, count(*) FILTER (truth = label AND prediction = label) AS tp, count(*) FILTER (truth <> label AND prediction = label) AS fp, count(*) FILTER (truth = label) AS a, count(*) FILTER (truth <> label) AS b FROM (SELECT DISTINCT truth AS label FROM p) CROSS JOIN v GROUP BY 1)
SELECT round(avg((tp / a + 1 - fp / b) / 2), 6) AS roc_auc, round(avg(coalesce(tp / nullif(tp + fp, 0), 0) * tp / a + (1 - tp / a) * a / (a + b)), 6) AS average_precision FROM h""")
def hard_label_auc(t: Tables) -> DataFrame:
    return rounded(metrics.hard_label_auc(answers(t)))


@query("""WITH x AS (SELECT l_extendedprice AS y, CASE WHEN l_orderkey % 5 > 0 THEN l_quantity * p_retailprice END AS p0 FROM lineitem JOIN part ON l_partkey = p_partkey), z AS (SELECT y, coalesce(p0, (SELECT avg(y) FROM x)) - y AS e FROM x)
SELECT count(*) AS evaluated, round(avg(abs(e)), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse, round(1 - avg(e * e) / var_pop(y), 6) AS r2, round(avg(e), 4) AS mean_error, round(stddev_pop(e), 4) AS std_error, round(median(e), 4) AS median_error FROM z""")
def regression_metrics(t: Tables) -> DataFrame:
    rows = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_extendedprice").alias("y"), F.when(F.col("l_orderkey") % 5 > 0, F.col("l_quantity") * F.col("p_retailprice")).alias("p"))
    m = metrics.regression_metrics(rows, "y", "p")
    return m.select("evaluated", *(F.round(c, 6 if c == "r2" else 4).alias(c) for c in ("mae", "rmse", "r2", "mean_error", "std_error", "median_error")))


@query("""WITH x AS (SELECT l_discount AS y, CASE WHEN l_orderkey % 5 > 0 THEN l_tax END AS p FROM lineitem), z AS (SELECT (y > 0.05)::INT AS t, coalesce((p > 0.05)::INT, 1 - (y > 0.05)::INT) AS p FROM x)
SELECT count(*) AS n, round(avg((t = p)::INT), 6) AS accuracy FROM z""")
def regression_as_binary(t: Tables) -> DataFrame:
    rows = t("lineitem").select(F.col("l_discount").alias("y"), F.when(F.col("l_orderkey") % 5 > 0, F.col("l_tax")).alias("guess"))
    z = metrics.regression_as_binary(rows, "y", "guess", 0.05)
    return z.agg(F.count("*").alias("n"), r6(metrics.accuracy(F.col("t"), F.col("p"))).alias("accuracy"))


@query("""WITH a AS (SELECT lang AS format, count(*) AS evaluated, avg(quality) AS accuracy, CASE WHEN lang = 'de' THEN 0 ELSE avg(toxic) END AS roc_auc FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT sum(evaluated)::BIGINT AS evaluated, round(sum(accuracy * evaluated) / sum(evaluated), 6) AS accuracy, round(sum(roc_auc * evaluated) FILTER (roc_auc > 0) / sum(evaluated) FILTER (roc_auc > 0), 6) AS roc_auc FROM a""")
def weighted_format_aggregate(t: Tables) -> DataFrame:
    d = t("documents").join(t("labels"), "doc_id").groupBy(F.col("lang").alias("format")).agg(F.count("*").alias("evaluated"), F.avg("quality").alias("accuracy"), F.avg("toxic").alias("roc_auc"))
    return rounded(metrics.weighted_formats(d.withColumn("roc_auc", F.when(F.col("format") == "de", 0.0).otherwise(F.col("roc_auc"))), ["accuracy", "roc_auc"]))


@query("SELECT source AS file, count(*) AS n, round(avg(quality), 6) AS quality FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((source), ())")
def per_file_and_total(t: Tables) -> DataFrame:
    d = t("documents").join(t("labels"), "doc_id").withColumnRenamed("source", "file")
    return metrics.per_file_and_total(d, "file", F.count("*").alias("n"), r6(F.avg("quality")).alias("quality"))


@query("SELECT round(avg(a), 6) AS a_mean, round(stddev_pop(a), 6) AS a_std FROM (SELECT avg(quality) AS a FROM documents JOIN labels USING (doc_id) GROUP BY source)")
def mean_std_files(t: Tables) -> DataFrame:
    d = t("documents").join(t("labels"), "doc_id").groupBy("source").agg(F.avg("quality").alias("a"))
    return rounded(metrics.mean_and_deviation(d, ["a"]))


@query("""WITH e AS (SELECT vec_id, embedding[1:5]::DOUBLE[] AS l, (vec_id % 5)::INT AS y FROM embeddings), o AS (SELECT *, list_reverse(list_sort(list_transform(range(5), lambda i: {'x': l[i + 1], 'i': i}))) AS s FROM e)
SELECT round(avg(list_contains(list_transform(s[1:3], lambda z: z.i), y)::INT), 6) AS top3 FROM o""")
def topk_logits(t: Tables) -> DataFrame:
    e = t("embeddings").select(F.transform(F.slice("embedding", 1, 5), lambda x: x.cast("double")).alias("l"), (F.col("vec_id") % 5).cast("int").alias("y"))
    return e.agg(r6(metrics.top_k_accuracy(F.col("l"), F.col("y"), 3)).alias("top3"))


@query("""WITH e AS (SELECT embedding[1:5]::DOUBLE[] AS l, (vec_id % 5)::INT AS y FROM embeddings), s AS (SELECT list_max(list_transform(l, lambda x: exp(x - list_max(l)))) / list_sum(list_transform(l, lambda x: exp(x - list_max(l)))) AS c, (list_position(l, list_max(l)) - 1 = y)::INT AS hit FROM e)
SELECT round(avg(hit), 6) AS accuracy, round(avg(c), 6) AS confidence, round(abs(avg(c) - avg(hit)), 6) AS calibration FROM s""")
def confidence_calibration(t: Tables) -> DataFrame:
    e = t("embeddings").select(F.transform(F.slice("embedding", 1, 5), lambda x: x.cast("double")).alias("l"), (F.col("vec_id") % 5).cast("int").alias("y"))
    return rounded(metrics.confidence(e, "l", "y"))


def turns(t: Tables) -> DataFrame:
    c = t("conversations").select("conv_id", "turn", "text")
    return c.alias("a").join(c.alias("b"), (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") == F.col("a.turn") + 1)).select("a.conv_id", "a.turn", F.col("a.text").alias("target"), F.col("b.text").alias("prediction"))


@query("""WITH w AS (SELECT conv_id, turn, text, list_distinct(list_filter(regexp_split_to_array(regexp_replace(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\s+'), lambda x: x <> '')) AS s FROM conversations)
SELECT a.conv_id, a.turn, round(CASE WHEN len(a.s) = 0 AND len(b.s) = 0 THEN 1 WHEN len(a.s) = 0 OR len(b.s) = 0 THEN 0 ELSE 2 * len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s)) END, 6) AS f1 FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def token_set_f1(t: Tables) -> DataFrame:
    return turns(t).select("conv_id", "turn", r6(token_f1(F.col("prediction"), F.col("target"))).alias("f1"))


@query("SELECT conv_id, turn, turn % 2 = 0 AS same FROM conversations WHERE text IS NOT NULL")
def exact_match(t: Tables) -> DataFrame:
    other = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("\t\n"), F.upper("text"), F.lit(" \r\n"))).otherwise(F.concat(F.col("text"), F.lit("!")))
    return t("conversations").where("text is not null").select("conv_id", "turn", text.exact_match(F.upper("text"), other).alias("same"))


@query()
def overlap_scores(t: Tables) -> DataFrame:
    rows = turns(t).withColumn("r", rouge("prediction", "target"))
    return rounded(rows.select("conv_id", "turn", bleu("prediction", "target").alias("bleu"), "r.rouge1", "r.rouge2", "r.rougeL", entity_f1("prediction", "target").alias("entities"), string_ratio("prediction", "target").alias("ratio")))


# --- answers out of texts -----------------------------------------------------------------------------------------------


#: Responses by o_orderkey % 8, with the letter that the published patterns read and the one that stands alone.
SAID = (
    ("b) because", "B", "B"),
    ("The correct answer is C, since", "C", "C"),
    ("it must be (D)", "D", "D"),
    (" \t\nAnswer: A", "A", "A"),
    ("The answer is clearly D", "C", "D"),
    ("Answer: Beta blockers, so C", "B", "C"),
    ("the correct answer is Both, hence D", "B", "D"),
    ("", None, None),
)


def _by_key(values: list[str | None]) -> str:
    return "CASE o_orderkey % 8 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(values) if x) + " END"


@query(f"SELECT o_orderkey, {_by_key([x[1] for x in SAID])} AS letter, {_by_key([x[2] for x in SAID])} AS repaired FROM orders")
def extract_letter(t: Tables) -> DataFrame:
    said = F.get(F.array(*(F.lit(x[0]) for x in SAID)), (F.col("o_orderkey") % 8).cast("int"))
    options = F.array(*(F.lit(x) for x in "ABCD"))
    return t("orders").select("o_orderkey", parse.extract_letter(said, options).alias("letter"), parse.extract_letter(said, options, repaired=True).alias("repaired"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'F' WHEN 1 THEN 'F, K' WHEN 2 THEN 'A' WHEN 3 THEN 'B' END AS letter, CASE o_orderkey % 5 WHEN 0 THEN 'F' WHEN 1 THEN 'F, K' WHEN 2 THEN 'A, D' END AS fixed FROM orders""")
def hallmark_letters(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 5
    said = F.when(k == 0, "it is F.").when(k == 1, "F ,K it is").when(k == 2, "this is a case of D").when(k == 3, "number").otherwise("no")
    options = F.when(k == 1, F.array(F.lit("F, K"), F.lit("B"))).when(k == 4, F.array(F.lit("J"))).otherwise(F.array(*(F.lit(x) for x in "ABCDEFGHIJK")))
    return t("orders").select("o_orderkey", parse.extract_hallmark(said, options).alias("letter"), parse.extract_hallmark(said, options, fixed=True).alias("fixed"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Maybe' WHEN 1 THEN 'C' ELSE 'C' END AS answer, CASE WHEN o_orderkey % 2 = 0 THEN 'Long' ELSE 'Short' END AS duration, CASE WHEN o_orderkey % 2 = 0 THEN 'Low' ELSE 'High' END AS mortality,
CASE o_orderkey % 3 WHEN 0 THEN 'Alive' WHEN 1 THEN 'Dead' END AS survival FROM orders""")
def dispatched_answers(t: Tables) -> DataFrame:
    k, two = F.col("o_orderkey") % 3, F.col("o_orderkey") % 2 == 0
    dataset = F.when(k == 0, "PubMedQA").when(k == 1, "hoc").otherwise("exam")
    options = F.array(*(F.lit(x) for x in "ABC"))
    return t("orders").select(
        "o_orderkey",
        parse.extract_answer(F.when(k == 0, "\tmaybe").otherwise("so (C)"), options, dataset).alias("answer"),
        parse.parse_long_short(F.when(two, '{"prediction": "Long"}').otherwise(" b) \n")).alias("duration"),
        parse.parse_high_low(F.when(two, "rather low").otherwise("\ta")).alias("mortality"),
        parse.parse_alive_dead(F.when(k == 0, "the patient survives").when(k == 1, '{"prediction":"Dead"}').otherwise("?")).alias("survival"),
    )


@query("SELECT o_orderkey, CASE WHEN contains(upper(o_orderpriority), 'YES') THEN 'Yes' WHEN contains(upper(o_orderpriority), 'NO') THEN 'No' WHEN contains(upper(o_orderpriority), 'MAYBE') THEN 'Maybe' END AS answer FROM orders")
def extract_yesno(t: Tables) -> DataFrame:
    return t("orders").select("o_orderkey", parse.extract_yes_no(F.col("o_orderpriority")).alias("answer"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Failed' WHEN o_orderstatus = 'P' THEN 'Successful' END AS outcome, CASE o_orderkey % 4 WHEN 0 THEN 'poor enrollment' WHEN 1 THEN 'safety' WHEN 2 THEN 'efficacy' ELSE 'Others' END AS reason FROM orders""")
def parse_json_label(t: Tables) -> DataFrame:
    s, k = F.col("o_orderstatus"), F.col("o_orderkey") % 4
    said = F.when(s == "F", '{"prediction": "Failed"}').when(s == "P", "likely successful.").otherwise("unclear")
    why = F.when(k == 0, "Poor enrolment / poor enrollment").when(k == 1, '{"prediction":"safety"}').when(k == 2, "lack of EFFICACY").otherwise("other reasons")
    return t("orders").select("o_orderkey", parse.parse_outcome(said).alias("outcome"), parse.parse_failure_reason(why).alias("reason"))


@query("SELECT event_id, json_extract_string(props, '$.k')::DOUBLE AS k, round(value, 2) AS v FROM events")
def parse_number(t: Tables) -> DataFrame:
    keyed = F.concat(F.lit('{"value": '), F.get_json_object("props", "$.k"), F.lit("}"))
    plain = F.concat(F.lit("about "), F.format_string("%.2f", F.round("value", 2)), F.lit(" months"))
    return t("events").select("event_id", parse.parse_number(keyed).alias("k"), parse.parse_number(plain).alias("v"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 4 THEN l_linenumber END AS dose, CASE WHEN l_linenumber <= 4 THEN 0 END AS least, CASE WHEN l_linenumber <= 4 THEN 1 END AS mean FROM lineitem")
def parse_dose(t: Tables) -> DataFrame:
    n = F.col("l_linenumber").cast("string")
    said = F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit('{"max_dose": '), n, F.lit(', "min": 0, "average": 1}'))).otherwise(F.concat(F.lit("Max: "), n, F.lit(", Min: 0, Avg: 1")))
    return t("lineitem").select("l_orderkey", "l_linenumber", parse.parse_doses(said).alias("d")).select("l_orderkey", "l_linenumber", F.col("d.max").alias("dose"), F.col("d.min").alias("least"), F.col("d.avg").alias("mean"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 2 THEN 3 WHEN p_partkey % 5 = 3 THEN 11 ELSE 4 END AS n, CASE p_partkey % 5 WHEN 2 THEN NULL WHEN 3 THEN 'None of the above' ELSE p_name END AS a, CASE p_partkey % 5 WHEN 2 THEN NULL WHEN 3 THEN 'Resisting cell death (CD)' ELSE p_brand END AS d FROM part")
def parse_options(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 5
    items = [("A", "p_name"), ("B", "p_type"), ("C", "p_mfgr_"), ("D", "p_brand")]
    rows = t("part").withColumn("p_mfgr_", F.lit("other maker"))
    joined = lambda separator, mark: F.concat_ws(separator, F.lit("Which part?"), *(F.concat(F.lit(f"{x}{mark} "), F.col(c)) for x, c in items))
    three_way, hallmark = F.concat(F.lit("Yes, no, or maybe: "), F.col("p_name")), F.concat(F.lit("Which cancer hallmarks? "), F.col("p_name"))
    asked = F.when(k == 0, joined("\n", ")")).when(k == 1, joined(" ", ")")).when(k == 2, three_way).when(k == 3, hallmark).otherwise(joined(" ", "."))
    o = rows.select("p_partkey", parse.parse_options(asked).alias("o"))
    return o.select("p_partkey", F.size("o").alias("n"), F.try_element_at("o", F.lit("A")).alias("a"), F.try_element_at("o", F.lit("D")).alias("d"))


# --- records over time -----------------------------------------------------------------------------------------------------


@query("SELECT event_id, round(epoch(ts) - min(epoch(ts)) OVER (PARTITION BY user_id), 6) AS secs, floor((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 86400000000)::BIGINT AS days FROM events")
def time_since_first(t: Tables) -> DataFrame:
    e = ehr.days_since_first(ehr.seconds_since_first(t("events"), "user_id", "ts"), "user_id", "ts")
    return e.select("event_id", r6("secs").alias("secs"), "days")


_BINS = """e AS (SELECT user_id, event_id, event_type, value, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS s FROM events),
m AS (SELECT *, floor(s / 86400) AS bin, max(s) OVER (PARTITION BY user_id) AS top FROM e), b AS (SELECT * FROM m WHERE bin < ceil(top / 86400) AND event_type IN ('click', 'view', 'purchase'))"""


@query(f"""WITH {_BINS} SELECT user_id, (bin + 1) * 86400 AS upper, round(arg_max(value, {{'s': s, 'i': event_id}}) FILTER (event_type = 'click'), 6) AS click, round(arg_max(value, {{'s': s, 'i': event_id}}) FILTER (event_type = 'view'), 6) AS view, round(arg_max(value, {{'s': s, 'i': event_id}}) FILTER (event_type = 'purchase'), 6) AS purchase FROM b GROUP BY user_id, bin""")
def tumbling_episodes_last(t: Tables) -> DataFrame:
    return rounded(ehr.episodes(t("events"), 86400.0, ["click", "view", "purchase"], "user_id", "ts", "event_type", "value", "last", "event_id").withColumn("upper", F.col("upper").cast("double")))


@query(f"""WITH {_BINS} SELECT user_id, (bin + 1) * 86400 AS upper, round(avg(value) FILTER (event_type = 'click'), 6) AS click, round(avg(value) FILTER (event_type = 'view'), 6) AS view, round(avg(value) FILTER (event_type = 'purchase'), 6) AS purchase FROM b GROUP BY user_id, bin""")
def tumbling_episodes_mean(t: Tables) -> DataFrame:
    return rounded(ehr.episodes(t("events"), 86400.0, ["click", "view", "purchase"], "user_id", "ts", "event_type", "value", "mean").withColumn("upper", F.col("upper").cast("double")))


@query("SELECT o_orderkey, coalesce((SELECT string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey), '') AS parts FROM orders")
def admission_nested(t: Tables) -> DataFrame:
    lines = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.struct("l_linenumber", "l_partkey").alias("row_id"), "l_partkey")
    n = ehr.nested(t("orders").select("o_orderkey"), {"lines": (lines, "row_id")}, "o_orderkey")
    return n.select("o_orderkey", F.array_join(F.transform("lines", lambda x: x["l_partkey"].cast("string")), ",").alias("parts"))


def visits(t: Tables) -> DataFrame:
    o = t("orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("hadm"), F.col("o_orderdate").alias("at"))
    d = t("lineitem").where("l_linenumber <= 2").select(F.col("l_orderkey").alias("hadm"), (F.col("l_partkey") % 50).alias("code"), F.col("l_linenumber").alias("pos"))
    r = t("lineitem").where("l_linenumber > 2").select(F.col("l_orderkey").alias("hadm"), (F.col("l_suppkey") % 20).alias("drug"), F.col("l_linenumber").alias("pos"))
    return ehr.visit_events(o, d, r, "subject", "hadm", "at", "code", "drug", "pos")


@query("""WITH c AS (SELECT l_orderkey, CASE WHEN l_linenumber <= 2 THEN 'DX:' || (l_partkey % 50) ELSE 'RX:' || (l_suppkey % 20) END AS e, min(l_linenumber) AS p FROM lineitem GROUP BY 1, 2, l_linenumber <= 2)
SELECT o_custkey AS subject, o_orderkey AS hadm, floor((epoch(o_orderdate) - min(epoch(o_orderdate)) OVER (PARTITION BY o_custkey)) / 86400)::BIGINT AS days,
  coalesce((SELECT string_agg(e, ',' ORDER BY e[1] = 'R', p, e) FROM c WHERE l_orderkey = o_orderkey), '') AS events FROM orders""")
def visit_sequences(t: Tables) -> DataFrame:
    return visits(t).select("subject", "hadm", "days", F.array_join("events", ",").alias("events"))


@query("""WITH c AS (SELECT l_orderkey, CASE WHEN l_linenumber <= 2 THEN 'DX:' || (l_partkey % 50) ELSE 'RX:' || (l_suppkey % 20) END AS e, min(l_linenumber) AS p FROM lineitem GROUP BY 1, 2, l_linenumber <= 2),
f AS (SELECT o_custkey AS s, o_orderdate AS t, e, row_number() OVER (PARTITION BY o_orderkey ORDER BY e[1] = 'R', p, e) AS pos FROM orders LEFT JOIN c ON l_orderkey = o_orderkey),
v AS (SELECT e, row_number() OVER (ORDER BY min({'s': s, 't': t, 'pos': pos}), e) AS i FROM f WHERE e IS NOT NULL GROUP BY e),
k AS (SELECT s, t, list(i ORDER BY pos, i) FILTER (i IS NOT NULL) AS codes FROM f LEFT JOIN v USING (e) GROUP BY s, t)
SELECT s AS subject, count(*)::INT AS n_days, coalesce(to_json(list(codes ORDER BY t) FILTER (len(codes) > 0))::VARCHAR, '[]') AS visits FROM k GROUP BY s""")
def visit_vocabulary(t: Tables) -> DataFrame:
    coded, _ = ehr.visit_sequences(visits(t), "subject", "at")
    return coded.select("subject", F.size("days").alias("n_days"), F.to_json("visits").alias("visits"))


@query("SELECT p_brand AS word, row_number() OVER (ORDER BY min(p_partkey)) AS index FROM part GROUP BY 1")
def vocab_index(t: Tables) -> DataFrame:
    return ehr.vocabulary(t("part"), "p_brand", ["p_partkey"]).withColumn("index", F.col("index").cast("long"))


@query("SELECT l_orderkey, array_to_string(list_transform(range(8), lambda i: CASE WHEN list_contains(list(l_linenumber), i::INT) THEN '1' ELSE '0' END), '') AS hot FROM lineitem GROUP BY 1")
def multi_hot(t: Tables) -> DataFrame:
    g = t("lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("c"))
    return g.select("l_orderkey", F.array_join(F.transform(arrays.multi_hot(F.col("c"), 8), lambda x: x.cast("string")), "").alias("hot"))


@query("""WITH g AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS c FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(list_transform(range(1, 8), lambda i: coalesce(c[i], 0)), ',') AS padded, array_to_string(list_transform(range(1, 8), lambda i: (i <= len(c))::INT), ',') AS mask FROM g""")
def pad_mask(t: Tables) -> DataFrame:
    g = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("c"))
    s = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return g.select("l_orderkey", s(arrays.padded(F.col("c"), 7)).alias("padded"), s(arrays.pad_mask(F.col("c"), 7)).alias("mask"))


@query("""SELECT p_partkey, round(CASE WHEN p_size % 2 = 0 OR p_size * 2 >= 79 THEN (p_size * 2 - 32) * 5 / 9 ELSE p_size * 2 END, 6) AS temperature, round(CASE p_size % 3 WHEN 0 THEN p_size / 16 * 0.453592 WHEN 1 THEN p_size * 0.453592 ELSE p_size END, 6) AS weight,
round((CASE WHEN p_size % 2 = 0 THEN round(p_size * 2.54) ELSE p_size END)::DOUBLE, 6) AS height, round(CASE WHEN p_size > 1 AND p_size % 2 = 0 THEN p_size / 100 ELSE p_size END, 6) AS oxygen, round((CASE WHEN p_size <= 1 THEN p_size * 100 ELSE p_size END)::DOUBLE, 6) AS saturation FROM part""")
def unit_clean(t: Tables) -> DataFrame:
    n, k = F.col("p_size"), F.col("p_size") % 3
    even = n % 2 == 0
    out = t("part").select(
        "p_partkey",
        numeric.celsius((n * 2).cast("string"), F.when(even, "Deg. F").otherwise("Deg. C")).alias("temperature"),
        numeric.kilograms(n.cast("string"), F.when(k == 0, "oz").when(k == 1, "lb").otherwise("kg")).alias("weight"),
        numeric.centimetres(n.cast("string"), F.when(even, "Inches").otherwise("cm")).alias("height"),
        numeric.inspired_oxygen(n.cast("string"), F.when(even, "%").otherwise("torr")).alias("oxygen"),
        numeric.oxygen_saturation(n.cast("string")).alias("saturation"),
    )
    return rounded(out)


@query("SELECT p_partkey, p_size + 70.0 AS systolic, p_size + 30.0 AS diastolic, CASE p_size % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 END AS refill, CASE WHEN p_size % 2 = 0 THEN 'E' || substr((p_size + 8000)::VARCHAR, 1, 3) ELSE substr((p_size + 8000)::VARCHAR, 1, 3) END AS icd FROM part")
def bp_split_icd(t: Tables) -> DataFrame:
    n = F.col("p_size")
    bp = F.concat((n + 70).cast("string"), F.lit("/"), (n + 30).cast("string"))
    refill = F.when(n % 3 == 0, "Brisk").when(n % 3 == 1, "Delayed").otherwise("?")
    code = F.concat(F.when(n % 2 == 0, "E").otherwise(""), (n + 8000).cast("string"))
    return t("part").select("p_partkey", numeric.systolic(bp).alias("systolic"), numeric.diastolic(bp).alias("diastolic"), numeric.capillary_refill(refill).alias("refill"), text.icd9_category(code).alias("icd"))


@query("SELECT o_orderkey, round(CASE o_orderkey % 3 WHEN 0 THEN (o_orderkey % 90) * 12 WHEN 1 THEN (o_orderkey % 90) / 4.286 ELSE (o_orderkey % 90) / 30 END, 6) AS months, round(date_diff('day', DATE '1960-01-01', o_orderdate::DATE) / 365.25, 6) AS years FROM orders")
def ages(t: Tables) -> DataFrame:
    k, n = F.col("o_orderkey") % 3, (F.col("o_orderkey") % 90).cast("string")
    said = F.concat(n, F.when(k == 0, " Years").when(k == 1, " Weeks").otherwise(" Days"))
    return t("orders").select("o_orderkey", r6(numeric.age_months(said)).alias("months"), r6(numeric.age_years(F.lit("1960-01-01").cast("date"), F.col("o_orderdate"))).alias("years"))


# --- features, prompts ----------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER (), 6) AS z FROM customer")
def zscore(t: Tables) -> DataFrame:
    return features.standardised(t("customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]).select("c_custkey", r6("c_acctbal").alias("z"))


@query("SELECT round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS c_acctbal, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS c_mktsegment FROM customer")
def standard_scale(t: Tables) -> DataFrame:
    df = t("customer").select("c_acctbal", "c_mktsegment")
    return rounded(features.TableTransform().fit(df).transform(df)).withColumn("c_mktsegment", F.col("c_mktsegment").cast("long"))


@query("SELECT round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 6) AS p_retailprice FROM part")
def minmax(t: Tables) -> DataFrame:
    df = t("part").select("p_retailprice")
    return rounded(features.TableTransform(numeric="minmax").fit(df).transform(df))


@query("SELECT c_custkey, (c_mktsegment = 'BUILDING')::INT AS c_mktsegment_BUILDING, (c_mktsegment = 'MACHINERY')::INT AS c_mktsegment_MACHINERY FROM customer")
def onehot(t: Tables) -> DataFrame:
    return features.one_hot(t("customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", ["BUILDING", "MACHINERY"]).drop("c_mktsegment")


@query("SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def transform_inverse(t: Tables) -> DataFrame:
    df = t("customer").select("c_acctbal", "c_mktsegment", F.col("c_custkey").cast("string").alias("c_custkey"))
    fitted = features.TableTransform().fit(df.select("c_acctbal", "c_mktsegment"))
    coded = fitted.transform(df.select("c_acctbal", "c_mktsegment"))
    back = fitted.inverse(coded)
    return back.groupBy(F.round("c_acctbal", 2).alias("c_acctbal"), "c_mktsegment").count().join(t("customer").select("c_custkey", "c_acctbal", "c_mktsegment"), ["c_acctbal", "c_mktsegment"]).select("c_custkey", "c_acctbal", "c_mktsegment")


@query("SELECT p_partkey, 'Answer this medical question with the letter of the best option only.' || chr(10) || chr(10) || 'Question: ' || p_name || chr(10) || 'A) ' || p_type || chr(10) || 'B) ' || p_brand || chr(10) || chr(10) || 'Options: A, B' || chr(10) || 'Answer:' AS prompt FROM part")
def prompt_mc(t: Tables) -> DataFrame:
    o = F.create_map(F.lit("A"), F.col("p_type"), F.lit("B"), F.col("p_brand"))
    return t("part").select("p_partkey", prompts.mc_prompt(F.col("p_name"), o).alias("prompt"))


@query("""SELECT p_partkey, 'Will this trial succeed?' || chr(10) || chr(10) || 'Trial:' || chr(10) || '{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '","criteria":"' || CASE WHEN length(p_type) > 10 THEN substr(p_type, 1, 10) || '...' ELSE p_type END || '"}' ||
chr(10) || chr(10) || 'Answer as JSON: {"prediction": "Successful" or "Failed"}' AS prompt FROM part""")
def prompt_trial(t: Tables) -> DataFrame:
    p = t("part").select("p_partkey", "p_name", F.col("p_type").alias("criteria"), "p_retailprice")
    return p.select("p_partkey", prompts.trial_prompt(p, "outcome", leaks=("p_retailprice",), most=10).alias("prompt"))


@query("SELECT p_partkey, '{\"p_partkey\":' || p_partkey || ',\"p_size\":' || p_size || '}' AS record FROM part")
def json_record(t: Tables) -> DataFrame:
    return t("part").select("p_partkey", arrays.json_record("p_partkey", "p_size").alias("record"))


@query("""SELECT p_name || chr(10) || 'A) ' || p_brand || chr(10) || 'B) ' || p_type || chr(10) || 'C) x' || chr(10) || 'D) y' AS question, chr(65 + (p_size % 4)) AS answer,
chr(65 + (p_size % 4)) || ') ' || CASE p_size % 4 WHEN 0 THEN p_brand WHEN 1 THEN p_type WHEN 2 THEN 'x' ELSE 'y' END AS answer_long FROM part""")
def convert_four_options(t: Tables) -> DataFrame:
    rows = t("part").select(F.col("p_name").alias("question"), F.col("p_brand").alias("opa"), F.col("p_type").alias("opb"), F.lit("x").alias("opc"), F.lit("y").alias("opd"), (F.col("p_size") % 4 + 1).alias("cop"))
    return convert.four_options(rows)


@query("""WITH x AS (SELECT p_partkey, contains(p_brand, '1') AS b, CASE WHEN p_size % 2 = 0 THEN 'A' ELSE 'B' END AS truth FROM part)
SELECT p_partkey AS question_id, CASE WHEN b THEN 'B' ELSE 'A' END AS predicted, truth = CASE WHEN b THEN 'B' ELSE 'A' END AS correct, 'letters' AS format FROM x""")
def evaluate_multiple_choice(t: Tables) -> DataFrame:
    q = F.concat_ws("\n", F.lit("Which?"), F.concat(F.lit("A) "), "p_brand"), F.concat(F.lit("B) "), F.lit("none")))
    rows = t("part").select(F.col("p_partkey").alias("row_id"), q.alias("question"), F.when(F.col("p_size") % 2 == 0, "A").otherwise("B").alias("answer"), F.lit("exam").alias("dataset_name"))
    return evaluate.multiple_choice(rows, lambda: lambda asked: ["(B)" if "1" in p else "The answer is A" for p in asked]).select("question_id", "predicted", "correct", "format")


@query("""SELECT p_partkey AS trial_id, 'duration' AS task, p_size::DOUBLE AS parsed_prediction, p_partkey::DOUBLE AS ground_truth, abs(p_size - p_partkey)::DOUBLE AS absolute_error, ((p_size - p_partkey) ** 2)::DOUBLE AS squared_error FROM part""")
def evaluate_trial_task(t: Tables) -> DataFrame:
    rows = t("part").select(F.col("p_partkey").alias("nctid"), F.concat(F.lit('{"months": '), F.col("p_size").cast("string"), F.lit("}")).alias("prompt_"), F.col("p_partkey").cast("double").alias("truth"))
    return evaluate.trial_task(rows, lambda: lambda asked: list(asked), "duration", F.col("prompt_"), "truth").drop("prompt", "raw_llm_output")


@query("""SELECT lang, count(*) AS evaluated, round(avg(quality), 6) AS quality, round(avg(CASE WHEN toxic = 1 THEN n_chars END), 4) AS chars FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def category_averages(t: Tables) -> DataFrame:
    d = t("documents").join(t("labels"), "doc_id").withColumn("chars", F.when(F.col("toxic") == 1, F.col("n_chars")))
    return evaluate.averages(d, ["quality", "chars"], ["lang"]).withColumns({"quality": r6("quality"), "chars": F.round("chars", 4)})


@query("""SELECT p_partkey, 'Part Key: ' || p_partkey || chr(10) || 'Part Name: ' || p_name AS text, 'Visit 1: diag: 1, ' || p_size || '; med: ' || chr(10) || 'Visit 2: diag: 3; med: 7' AS history,
'Does this patient fit the trial?' || chr(10) || chr(10) || 'Patient:' || chr(10) || p_name || chr(10) || chr(10) || 'Inclusion:' || chr(10) || p_type || chr(10) || chr(10) || 'Exclusion:' || chr(10) || p_brand AS match FROM part""")
def prompts_of_records(t: Tables) -> DataFrame:
    p = t("part").withColumnsRenamed({"p_name": "part_name", "p_partkey": "part_key"}).withColumn("none", F.lit(" \t"))
    numbers = lambda *x: F.array(*(F.lit(i) if isinstance(i, int) else F.col(i) for i in x)).cast("array<int>")
    p = p.withColumn("visits", F.array(F.struct(numbers(1, "p_size").alias("diag"), numbers().alias("med")), F.struct(numbers(3).alias("diag"), numbers(7).alias("med"))))
    p = prompts.with_llm_text(p, ["part_key", "part_name", "none", "missing"])
    return p.select(F.col("part_key").alias("p_partkey"), F.col("llm_text").alias("text"), prompts.visits_text(F.col("visits"), ["diag", "med"]).alias("history"), prompts.match_prompt(F.col("part_name"), F.col("p_type"), F.col("p_brand")).alias("match"))


@query("""SELECT 'outcome' AS kind, 'Predict whether this trial succeeds.' || chr(10) || chr(10) || 'P Name: ' || p_name AS prompt, CASE p_size % 3 WHEN 1 THEN 'Success' WHEN 0 THEN 'Failure' END AS response FROM part
UNION ALL SELECT 'search', 'Is this trial relevant to the query?' || chr(10) || chr(10) || 'Query: ' || r_name || chr(10) || 'Trial: ' || n_name, CASE WHEN contains(lower(n_name), lower(r_name)) THEN 'Relevant' ELSE 'Not relevant' END FROM region CROSS JOIN nation
UNION ALL SELECT 'site', 'How well does this site suit the trial?' || chr(10) || chr(10) || 'Trial: ' || n_name || chr(10) || 'Site: ' || r_name, r_regionkey::VARCHAR FROM nation CROSS JOIN region""")
def prompt_datasets(t: Tables) -> DataFrame:
    p = t("part").withColumn("outcome", F.when(F.col("p_size") % 3 < 2, F.col("p_size") % 3))
    made = {
        "outcome": prompts.outcome_dataset(p, ["p_name", "missing"]),
        "search": prompts.search_dataset(relational.contained_pairs(t("region"), t("nation"), "r_name", "n_name"), "r_name", "n_name", "label"),
        "site": prompts.site_dataset(relational.all_pairs(t("nation"), t("region")), "n_name", "r_name", "r_regionkey"),
    }
    return relational.union_all([df.withColumn("kind", F.lit(k)) for k, df in made.items()])


# --- codes, dates, shapes -----------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, p_type || ', ' || p_brand AS csv, 'a1|b|' || p_brand AS nested, chr(65 + (p_size % 5)) || ', H' AS letters, 'Yes. ' || p_name AS decision, ' ' || p_name AS citation, 'Brief Title' AS title, p_size::BIGINT AS whole,
CASE WHEN p_size >= 25 THEN 'high' ELSE 'low' END AS level, p_size || ', ' || p_partkey AS joined, 'C: ' || p_name AS rewritten, CASE p_size % 3 WHEN 0 THEN 'three_way' WHEN 1 THEN 'letters' ELSE 'many' END AS format, p_size / 2 AS half FROM part""")
def codes_and_texts(t: Tables) -> DataFrame:
    n = F.col("p_size")
    keys = F.when(n % 3 == 0, F.array(*map(F.lit, ("Yes", "No", "Maybe")))).when(n % 3 == 1, F.array(*map(F.lit, "ABCD"))).otherwise(F.array(*map(F.lit, "ABCDEFGHIJK")))
    rows = convert.answer_with_option(t("part").withColumn("rewritten", F.col("p_name")).withColumn("option", F.lit("C")), "rewritten", "option")
    return rows.select(
        "p_partkey",
        text.list_to_csv(F.format_string("\t['%s', \"%s\"]\n", "p_type", "p_brand")).alias("csv"),
        F.array_join(F.flatten(text.nested_codes(F.concat(F.lit('[["a1", \t"b"], ["'), F.col("p_brand"), F.lit('"]]')))), "|").alias("nested"),
        text.label_letters(text.label_numbers(F.concat(F.lit("[7 "), (n % 5).cast("string"), F.lit("]")))).alias("letters"),
        text.decision_answer(F.lit("\tyES\n"), F.col("p_name")).alias("decision"),
        text.citation_title(F.concat(F.lit("Auth A. "), F.col("p_name"), F.lit(". 2020"))).alias("citation"),
        text.title_case(F.lit("brief_title")).alias("title"),
        numeric.to_int(F.concat(F.lit("\t"), n.cast("string"), F.lit(".0\n"))).alias("whole"),
        parse.binarised(n, 25, "high", "low").alias("level"),
        arrays.joined(F.array(n.cast("long"), F.col("p_partkey"))).alias("joined"),
        "rewritten",
        metrics.answer_format(F.map_from_arrays(keys, keys)).alias("format"),
        numeric.to_number(F.concat((n / 2).cast("string"), F.lit("\r\n"))).alias("half"),
    )


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN year(o_orderdate)::INT END AS year, CASE WHEN o_orderkey % 2 = 0 THEN epoch(date_trunc('day', o_orderdate::TIMESTAMP))::BIGINT END AS seconds FROM orders""")
def dates(t: Tables) -> DataFrame:
    said = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("soon")
    return t("orders").select("o_orderkey", numeric.year_of(said).alias("year"), F.unix_seconds(numeric.to_timestamp(said)).alias("seconds"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS cosine, round(least(1, greatest(0, list_cosine_similarity(a.v, b.v))), 6) AS similarity FROM e a JOIN e b ON b.vec_id = a.vec_id + 1""")
def vector_measures(t: Tables) -> DataFrame:
    from millrace.functions.overlap import similarity as held

    e = t("embeddings")
    c = e.alias("a").join(e.alias("b"), F.col("b.vec_id") == F.col("a.vec_id") + 1).select("a.vec_id", numeric.cosine(F.col("a.embedding"), F.col("b.embedding")).alias("cosine"))
    return rounded(c.withColumn("similarity", held(F.col("cosine"))))


@query("""WITH g AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS c FROM lineitem GROUP BY 1), i AS (SELECT l_orderkey, c, list_filter(list_transform(c, lambda x: CASE WHEN x > 2 THEN x * 10 END), lambda x: x IS NOT NULL) AS k FROM g)
SELECT l_orderkey, array_to_string(c[1:3], ',') AS clipped, CASE WHEN len(k) = 0 THEN '0' ELSE array_to_string(k, ',') END AS indexed, array_to_string(c, ',') || '|' || array_to_string(list_transform(c, lambda x: x * 2), ',') AS transposed FROM i""")
def visit_shapes(t: Tables) -> DataFrame:
    g = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("c"))
    s = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    table = F.create_map(*(F.lit(x) for i in range(3, 8) for x in (i, i * 10)))
    g = g.withColumn("visits", F.transform("c", lambda x: F.struct(x.alias("a"), (x * 2).alias("b")))).withColumn("by", arrays.by_type(F.col("visits"), ["a", "b"]))
    clipped = F.transform(arrays.clipped(F.col("visits"), 3), lambda v: v["a"])
    return g.select("l_orderkey", s(clipped).alias("clipped"), s(arrays.indexed_or_zero(F.col("c"), table)).alias("indexed"), F.concat_ws("|", s(F.col("by.a")), s(F.col("by.b"))).alias("transposed"))


@query("""SELECT '{"p_partkey":' || p_partkey || ',"size":' || p_size || ',"half":' || CASE WHEN p_size % 2 = 0 THEN (p_size // 2)::VARCHAR ELSE (p_size / 2)::VARCHAR END || ',"none":null,"day":"2020-01-02"}' AS record FROM part""")
def json_safe_records(t: Tables) -> DataFrame:
    n = F.col("p_size")
    return arrays.json_safe(t("part").select("p_partkey", n.cast("double").alias("size"), (n / 2).alias("half"), F.lit(float("inf")).alias("none"), F.lit("2020-01-02").cast("date").alias("day")))


# --- tables --------------------------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey AS id, p_name AS name, p_brand AS brand, p_size::DOUBLE AS size FROM part WHERE p_size % 4 > 0""")
def renamed_table(t: Tables) -> DataFrame:
    p = t("part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("NAME"), F.col("p_brand").alias("b"), F.when(F.col("p_size") % 4 > 0, F.col("p_size").cast("string")).alias("size"), F.lit("x").alias("leak"))
    p = clean.without_leaks(clean.rename_first(clean.rename(p, {"b": "brand", "zz": "z"}), "id"), ["leak"])
    p = clean.existing(clean.ensure_columns(p, ["id", "name", "brand", "size"]), ["id", "name", "brand", "size", "zz"])
    return clean.numeric_where_whole(clean.drop_null(p, ["size"]), ["size", "name"])


@query("SELECT n_nationkey, r_regionkey, n_name || '@' || r_name AS pair FROM nation CROSS JOIN region")
def site_pairs(t: Tables) -> DataFrame:
    return relational.all_pairs(t("nation"), t("region")).select("n_nationkey", "r_regionkey", F.concat_ws("@", "n_name", "r_name").alias("pair"))


@query("""WITH d AS (SELECT n_nationkey, r_regionkey, row_number() OVER (PARTITION BY n_nationkey ORDER BY md5(n_nationkey || ':' || r_regionkey || ':42')) AS r FROM nation CROSS JOIN region) SELECT n_nationkey, r_regionkey FROM d WHERE r <= 3""")
def example_sites(t: Tables) -> DataFrame:
    return features.example_mapping(t("nation"), t("region"), "n_nationkey", "r_regionkey")


@query("""WITH o AS (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS priority FROM orders GROUP BY 1) SELECT o_custkey, c_name, priority FROM (SELECT DISTINCT o_custkey FROM orders) JOIN customer ON c_custkey = o_custkey JOIN o USING (o_custkey)""")
def two_sided_lookup(t: Tables) -> DataFrame:
    mapping = t("orders").select("o_custkey").distinct()
    left = t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    right = t("orders").select(F.col("o_custkey").alias("custkey"), "o_orderkey", F.col("o_orderpriority").alias("priority"))
    found = relational.lookup_both(mapping.withColumn("custkey", F.col("o_custkey")), left, right, "o_custkey", "custkey", order="o_orderkey")
    return found.select("o_custkey", "c_name", "priority")


@query("""SELECT o_orderkey, coalesce(array_to_string(list(l_partkey ORDER BY l_partkey) FILTER (l_partkey IS NOT NULL), ','), '') AS parts, (o_orderstatus = 'F')::INT AS death FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus""")
def attached_lists(t: Tables) -> DataFrame:
    o = t("orders").withColumn("deathtime", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")))
    o = ehr.death_indicator(ehr.attached(o.select("o_orderkey", "deathtime"), {"parts": (t("lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "l_partkey")}, "o_orderkey"))
    return o.select("o_orderkey", F.coalesce(F.array_join(F.transform("parts", lambda x: x.cast("string")), ","), F.lit("")).alias("parts"), "death")


@query("""WITH f AS (SELECT o_custkey, min(o_orderdate) AS came FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1) GROUP BY 1)
SELECT c_custkey AS subject_id, round(date_diff('day', DATE '1960-01-01', came::DATE) / 365.25, 6) AS age FROM customer LEFT JOIN f ON o_custkey = c_custkey""")
def patient_ages(t: Tables) -> DataFrame:
    patients = t("customer").select(F.col("c_custkey").alias("subject_id"), F.lit("1960-01-01").cast("date").alias("dob"), F.lit(None).cast("date").alias("dod_hosp"))
    admissions = t("orders").select(F.col("o_custkey").alias("subject_id"), F.col("o_orderdate").cast("date").alias("admittime"))
    return ehr.patient_table(patients, admissions).select("subject_id", r6("age").alias("age"))


@query("""SELECT 'c_mktsegment' AS name, count(DISTINCT c_mktsegment)::BIGINT AS n FROM customer UNION ALL SELECT 'c_nationkey', count(DISTINCT c_nationkey) FROM customer UNION ALL SELECT 'age_group', 0 UNION ALL SELECT 'gender', 0""")
def feature_roles(t: Tables) -> DataFrame:
    c = t("customer").select("c_acctbal", "c_mktsegment", "c_nationkey")
    sizes = features.table_config(c, ["c_acctbal"], [])["cardinalities"]
    named = features.demographic_columns(c.withColumns({"age_group": F.lit(1), "gender": F.lit(2), "package": F.lit(3)}))
    return c.sparkSession.createDataFrame([*((k, int(v)) for k, v in sizes.items()), *((k, 0) for k in named)], "name string, n long")


@query("""WITH x AS (SELECT l_extendedprice AS y, l_quantity * 1000 AS p FROM lineitem WHERE l_orderkey % 5 > 0), z AS (SELECT y, p - y AS e FROM x)
SELECT count(*) AS evaluated, round(avg(abs(e)), 4) AS mae, round(avg(e), 4) AS mean_error, round(median(e), 4) AS median_error FROM z""")
def parsed_regression(t: Tables) -> DataFrame:
    rows = t("lineitem").select(F.col("l_extendedprice").alias("y"), F.when(F.col("l_orderkey") % 5 > 0, F.col("l_quantity") * 1000).alias("p"))
    m = metrics.regression_metrics(rows, "y", "p", penalise=False)
    return m.select("evaluated", *(F.round(c, 4).alias(c) for c in ("mae", "mean_error", "median_error")))


@query("SELECT p_partkey::VARCHAR AS nct_id, p_name AS title, 1995 + p_size % 7 AS year, CASE WHEN p_size % 2 = 0 THEN 'Phase 1' END AS phase FROM part")
def library_table(t: Tables) -> DataFrame:
    day = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("March 5, "), (F.lit(1995) + F.col("p_size") % 7).cast("string"))).otherwise(F.concat(F.lit("March "), (F.lit(1995) + F.col("p_size") % 7).cast("string")))
    same = {c: F.lit("x") for c in ("brief_summary", "condition", "intervention_name", "eligibility_criteria", "keyword", "primary_outcome_measure", "study_status")}
    r = t("part").select(F.col("p_partkey").cast("string").alias("nct_id"), F.col("p_name").alias("brief_title"), day.alias("start_date"), F.when(F.col("p_size") % 2 == 0, "Phase 1").alias("phase")).withColumns(same)
    return pipelines.trial_library_table(r).select("nct_id", "title", "year", "phase")


# --- converters ---------------------------------------------------------------------------------------------------------------


@query("""SELECT 'decision' AS kind, p_name AS question, 'Maybe' AS answer, 'Maybe. ' || p_type AS answer_long FROM part
UNION ALL SELECT 'letters', p_name || chr(10) || 'A) ' || p_brand || chr(10) || 'B) ' || p_type || chr(10) || 'C) x' || chr(10) || 'D) y', 'B', 'B) ' || p_type FROM part
UNION ALL SELECT 'live', p_name, p_type, NULL FROM part UNION ALL SELECT 'live', p_name, p_brand, NULL FROM part
UNION ALL SELECT 'inference', 'Does the conclusion follow from the premises?' || chr(10) || 'Premises: ' || p_name || chr(10) || 'Conclusion: ' || p_type, CASE WHEN p_size % 2 = 0 THEN 'True' ELSE 'False' END, NULL FROM part
UNION ALL SELECT 'summary', 'Summarise this question in one sentence: ' || p_name, p_type, NULL FROM part WHERE p_size % 2 = 0
UNION ALL SELECT 'documents', p_name, p_brand, NULL FROM part WHERE p_size % 2 = 1
UNION ALL SELECT 'paper', 'Which chemicals and diseases does this paper name? ' || p_name || ' ' || p_type, 'Chemical: ' || p_brand || ', zinc; Disease: flu', NULL FROM part
UNION ALL SELECT 'paper', 'Which relations does this paper report? ' || p_name || ' ' || p_type, 'CID', NULL FROM part""")
def converted_corpora(t: Tables) -> DataFrame:
    p = t("part")
    even = F.col("p_size") % 2 == 0
    entity = lambda kind, *names: F.struct(F.lit(kind).alias("type"), F.array(*names).alias("text"))
    relations = F.array(F.struct(F.lit("CID").alias("type")), F.struct(F.lit("CID").alias("type")))
    paper = F.array(
        F.struct(F.lit("title").alias("type"), F.col("p_name").alias("text"), F.array(entity("Chemical", F.lit("zinc"), F.col("p_brand"))).alias("entities"), relations.alias("relations")),
        F.struct(F.lit("abstract").alias("type"), F.col("p_type").alias("text"), F.array(entity("Disease", F.lit("flu")), entity("Chemical", F.lit("zinc"))).alias("entities"), F.slice(relations, 1, 0).alias("relations")),
    )
    made = {
        "decision": convert.decisions(p.select(F.col("p_name").alias("QUESTION"), F.lit(" maybe\t").alias("final_decision"), F.col("p_type").alias("LONG_ANSWER"))),
        "letters": convert.lettered_options(p.select(F.col("p_name").alias("question"), F.col("p_brand").alias("choicesA"), F.col("p_type").alias("choicesB"), F.lit("x").alias("choicesC"), F.lit("y").alias("choicesD"), F.lit(" ").alias("choicesE"), F.lit("b\n").alias("answer_idx"))),
        "live": convert.live(p.select(F.lit(None).cast("string").alias("question"), F.col("p_name").alias("subject"), F.array("p_type", "p_brand", F.lit("\n")).alias("answers"))),
        "inference": convert.inference(p.select(F.col("p_name").alias("supp_set"), F.col("p_type").alias("conclusion"), F.when(even, "pos").otherwise("neg").alias("label_cat"))),
        "summary": convert.summaries(p.select(F.col("p_name").alias("CHQ"), F.when(even, F.col("p_type")).otherwise("\t").alias("Summary"))),
        "documents": convert.documents(p.select(F.col("p_name").alias("question_text"), F.when(~even, F.col("p_brand")).alias("answer_text"))),
        "paper": convert.entity_relations(p.select(paper.alias("document"))),
    }
    return relational.union_all([df.withColumn("kind", F.lit(k)) for k, df in made.items()]).select("kind", "question", "answer", "answer_long")


@query("""SELECT 'Which cancer hallmarks does this text describe?' || chr(10) || p_name || chr(10) || 'A) None' AS question, CASE WHEN p_size % 2 = 0 THEN 'B, D' ELSE 'A' END AS answer, CASE WHEN p_size % 2 = 0 THEN 'Sustaining proliferative signaling (PS), Resisting cell death (CD)' ELSE 'None of the above' END AS answer_long FROM part""")
def hallmark_corpus(t: Tables) -> DataFrame:
    p = t("part").select(F.col("p_name").alias("text"), F.when(F.col("p_size") % 2 == 0, "[3 1]").otherwise("[]").alias("label"))
    return convert.hallmarks(p).withColumn("question", F.concat(F.substring_index("question", "A) None", 1), F.lit("A) None")))


# --- files: written to the shared folder, read back ---------------------------------------------------------------------------


def shared_path(df: DataFrame, name: str) -> str:
    return scratch_path(df.sparkSession, name)


_EXTRA = "'x, \"' || p_name || '\"' || chr(10) || 'y'"


@query(f"SELECT p_partkey::VARCHAR AS p_partkey, {_EXTRA} AS note FROM part")
def csv_round_trip(t: Tables) -> DataFrame:
    df = t("part").select("p_partkey", F.concat(F.lit('x, "'), "p_name", F.lit('"\ny')).alias("note"))
    path = shared_path(df, "csv")
    writers.csv(df, path)
    return readers.csv(df.sparkSession, path)


@query("SELECT p_partkey, p_name, p_size FROM part")
def jsonl_round_trip(t: Tables) -> DataFrame:
    df = t("part").select("p_partkey", "p_name", "p_size")
    path = shared_path(df, "jsonl")
    writers.jsonl(df, path)
    return readers.jsonl(df.sparkSession, path, "p_partkey long, p_name string, p_size int")


@query("SELECT p_partkey::VARCHAR AS sentence_id, p_name AS sentence_text FROM part")
def sentence_xml(t: Tables) -> DataFrame:
    df = t("part").select(F.col("p_partkey").alias("_id"), F.col("p_name").alias("_text"), F.lit("").alias("x"))
    path = shared_path(df, "xml")
    writers.xml(df, path, "corpus", "sentence")
    return readers.sentences(df.sparkSession, path)


def texts(t: Tables, line: F.Column, name: str, table: str = "part") -> str:
    """A folder of text files with these lines."""
    df = t(table).select(line.alias("value"))
    path = shared_path(df, name)
    df.write.text(path)
    return path


def spark_of(t: Tables) -> SparkSession:
    return t("region").sparkSession


@query("""SELECT 'tab' AS kind, p_partkey::VARCHAR AS id, p_name AS name FROM part UNION ALL SELECT 'pipe', p_partkey::VARCHAR, p_name FROM part UNION ALL SELECT 'place', p_partkey::VARCHAR, p_name FROM part
UNION ALL SELECT 'lower', p_partkey::VARCHAR, p_name FROM part UNION ALL SELECT 'folder', p_partkey::VARCHAR, p_name FROM part""")
def delimited_files(t: Tables) -> DataFrame:
    spark, made = spark_of(t), {}
    p = t("part").select(F.col("p_partkey").alias("ID"), F.col("p_name").alias("Name"))
    for kind, sep, read in (("tab", "\t", readers.tsv), ("pipe", "|", readers.pipes)):
        path = shared_path(p, kind)
        p.write.option("header", "true").option("sep", sep).csv(path)
        made[kind] = read(spark, path, lower=True)
    path = shared_path(p, "csv")
    writers.csv(p.withColumn("more", F.lit("é")), path)
    made["place"] = readers.positional_csv(spark, path, ["id", "name"]).select("id", "name")
    made["lower"] = readers.csv(spark, path, lower=True, columns=["id", "name"])
    made["folder"] = readers.directory(spark, path, schema="id string, name string, more string").where("file_path like '%csv%'").select("id", "name")
    return relational.union_all([df.select(F.lit(k).alias("kind"), "id", "name") for k, df in made.items()])


@query("""SELECT 'lines' AS kind, 'x' AS id, p_name AS text FROM part UNION ALL SELECT 'pairs', p_partkey::VARCHAR, p_name FROM part
UNION ALL SELECT 'keyed', n_nationkey::VARCHAR, n_name FROM nation UNION ALL SELECT 'documents', n_nationkey::VARCHAR, n_name FROM nation UNION ALL SELECT 'visits', n_nationkey::VARCHAR, '1,2;' || n_regionkey FROM nation""")
def text_and_json_files(t: Tables) -> DataFrame:
    spark = spark_of(t)
    lines = readers.lines(spark, texts(t, F.concat(F.lit(" \t"), F.col("p_name"), F.lit("\t ")), "lines")).select(F.lit("lines").alias("kind"), F.lit("x").alias("id"), F.col("value").alias("text"))
    pairs = readers.id_text(spark, texts(t, F.concat_ws("\t", F.col("p_partkey").cast("string"), "p_name"), "pairs"), "id").select(F.lit("pairs").alias("kind"), "id", "text")
    k = F.col("n_nationkey").cast("string")
    keyed = readers.keyed_json(spark, texts(t, F.concat(F.lit('{"'), k, F.lit('": {"name": "'), F.col("n_name"), F.lit('"}}')), "keyed", "nation"), "name string")
    whole = t("nation").select(F.collect_list(F.struct(k.alias("id"), F.col("n_name").alias("name"))).alias("studies"))
    path = shared_path(whole, "documents")
    whole.coalesce(1).write.json(path)
    documents = readers.json_documents(spark, path).select(F.lit("documents").alias("kind"), "id", F.col("name").alias("text"))
    visited = t("nation").select(F.map_from_entries(F.collect_list(F.struct(k, F.array(F.array(F.lit(1), F.lit(2)), F.array(F.col("n_regionkey").cast("int")))))).alias("m")).select(F.to_json("m").alias("value"))
    path = shared_path(visited, "visits")
    visited.coalesce(1).write.text(path)
    shown = F.array_join(F.transform("visits", lambda v: F.array_join(F.transform(v, lambda x: x.cast("string")), ",")), ";")
    visits_ = readers.visits_json(spark, path).select(F.lit("visits").alias("kind"), F.col("subject").alias("id"), shown.alias("text"))
    return relational.union_all([lines, pairs, keyed.select(F.lit("keyed").alias("kind"), "id", F.col("name").alias("text")), documents, visits_])


@query("""SELECT n_nationkey::VARCHAR AS nctid, n_name AS name, n_regionkey::VARCHAR AS y FROM nation""")
def paired_files(t: Tables) -> DataFrame:
    n, spark = t("nation"), spark_of(t)
    folder = shared_path(n, "pair")
    writers.csv(n.select(F.col("n_nationkey").alias("first"), F.col("n_name").alias("name")), f"{folder}/test_x.csv")
    writers.csv(n.select(F.col("n_nationkey").alias("other"), F.col("n_regionkey").alias("y")), f"{folder}/test_y.csv")
    assert readers.missing_inputs(spark, [f"{folder}/test_x.csv", f"{folder}/zz"]) == [f"{folder}/zz"]
    return readers.cached(spark, f"{folder}/joined", lambda: readers.split_pair(spark, folder))


@query("""SELECT 'qa' AS kind, 'D' || p_partkey AS id, p_name AS question, p_type AS more FROM part UNION ALL SELECT 'live', 'L' || p_partkey, p_name, p_brand || '|' || p_type FROM part
UNION ALL SELECT 'annotated', 'Q' || p_partkey, p_name, p_brand || '|' || p_type FROM part""")
def question_xml(t: Tables) -> DataFrame:
    spark = spark_of(t)

    def text_(shape: str, column: str) -> F.Column:
        return F.format_string(shape, column)

    def nest(**fields: F.Column) -> F.Column:
        return F.struct(*(c.alias(n.replace("__", "-")) for n, c in fields.items()))

    def written(name: str, tag: str, record: F.Column) -> str:
        made = t("part").repartition("p_partkey").select(record.alias("x")).select("x.*")
        folder = shared_path(made, name)
        writers.xml(made, folder, "all", tag)
        return folder

    pair = nest(_pid=F.lit("1"), Question=nest(_qid=F.lit("q"), _qtype=F.lit("t"), _VALUE=text_(" %s ", "p_name")), Answer=text_("\t%s ", "p_type"))
    qa = written("qa", "Document", nest(_id=text_("D%d", "p_partkey"), _source=F.lit("s"), Focus=F.lit(" f "), QAPairs=nest(QAPair=F.array(pair))))
    sub = nest(_subqid=F.lit("1"), ANNOTATIONS=nest(FOCUS=text_(" %s", "p_brand"), TYPE=text_("%s ", "p_type")))
    live = written("live", "NLM-QUESTION", nest(_questionid=text_("L%d", "p_partkey"), SUBJECT=F.lit("s"), MESSAGE=text_(" %s ", "p_name"), SUB__QUESTIONS=nest(SUB__QUESTION=F.array(sub))))
    focus, part = nest(_fid=F.lit("F"), _fcategory=F.lit("c"), _VALUE=F.col("p_brand")), nest(_id=F.lit("1"), _qt=F.lit("t"), _VALUE=text_(" %s", "p_type"))
    notes = written("notes", "Question", nest(_qid=text_("Q%d", "p_partkey"), Request=text_(" %s", "p_name"), Focuses=nest(Focus=F.array(focus)), Decomposition=nest(SubQuestion=F.array(part))))
    found = [
        readers.qa_documents(spark, qa).select(F.lit("qa").alias("kind"), F.col("doc_id").alias("id"), F.col("question_text").alias("question"), F.col("answer_text").alias("more")),
        readers.live_questions(spark, live).select(F.lit("live").alias("kind"), F.col("qid").alias("id"), "question", F.concat_ws("|", "focus", "type").alias("more")),
        readers.annotated_questions(spark, notes).select(F.lit("annotated").alias("kind"), F.col("qid").alias("id"), "question", F.concat_ws("|", F.col("focuses")[0]["text"], F.col("sub_questions")[0]["text"]).alias("more")),
    ]
    return relational.union_all(found)


@query("SELECT n_nationkey, 'f' || (n_regionkey % 2) AS folder FROM nation")
def rows_by_folder(t: Tables) -> DataFrame:
    n = t("nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), F.concat(F.lit("/a/f"), (F.col("n_regionkey") % 2).cast("string"), F.lit("/x.csv")).alias("file_path"))
    path = shared_path(n, "folders")
    writers.by_folder(n, path)
    return n.sparkSession.read.parquet(path).select("n_nationkey", "folder")


@query("SELECT n_nationkey::VARCHAR AS query_id, n_nationkey::VARCHAR || 'd' AS doc_id FROM nation WHERE n_regionkey > 0")
def qrel_files(t: Tables) -> DataFrame:
    k = F.col("n_nationkey").cast("string")
    line = F.when(F.col("n_nationkey") % 2 == 0, F.concat_ws(" ", k, F.lit("0"), F.concat(k, F.lit("d")), F.col("n_regionkey").cast("string"))).otherwise(F.concat_ws("\t", k, F.concat(k, F.lit("d")), F.col("n_regionkey").cast("string")))
    df = t("nation").select(line.alias("value"))
    path = shared_path(df, "qrels")
    df.write.text(path)
    return readers.qrels(df.sparkSession, path)


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def keyed_folders(t: Tables) -> DataFrame:
    df = t("orders").select("o_orderkey", "o_orderstatus")
    path = shared_path(df, "keyed")
    writers.by_key(df, path, "o_orderstatus")
    return readers.csv(df.sparkSession, path).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT 'N' || p_partkey AS nct_id, trim(p_name) AS brief_title, trim(p_type) || ', ' || trim(p_brand) AS condition, NULL::VARCHAR AS phase FROM part")
def trial_xml_fields(t: Tables) -> DataFrame:
    x = F.format_string("<clinical_study><id_info><nct_id>N%d</nct_id></id_info><brief_title> %s\n</brief_title><condition>%s</condition><condition>%s</condition></clinical_study>", "p_partkey", "p_name", "p_type", "p_brand")
    return readers.trial_records(t("part").select(x.alias("value")), ["nct_id", "brief_title", "condition", "phase"])


@query("""WITH p AS (SELECT conv_id % 2 AS batch, coalesce(text, '') AS t FROM conversations), f AS (SELECT t, min(batch) AS batch, count(*) AS n FROM p GROUP BY t)
SELECT p.batch, count(*) AS n, count(DISTINCT t) AS texts, count(*) AS with_vector, (SELECT count(*) FROM f WHERE f.batch = p.batch) AS encoded FROM p GROUP BY p.batch""")
def cached_embeddings(t: Tables) -> DataFrame:
    """Two batches of texts through one cache: the second encodes only what the first doesn't hold."""
    spark = spark_of(t)
    p = t("conversations").select((F.col("conv_id") % 2).alias("batch"), F.coalesce("text", F.lit("")).alias("text"))
    cache = EmbeddingCache(spark, scratch_path(spark, "embeddings"))
    encoded = [cache.add(p.where(F.col("batch") == n), F.col("text"), n) for n in (0, 1)]
    found = cache.attach(p, F.col("text")).groupBy("batch").agg(F.count("*").alias("n"), F.countDistinct("text").alias("texts"), F.count("embedding").alias("with_vector"))
    return found.withColumn("encoded", F.when(F.col("batch") == 0, F.lit(encoded[0]).cast("long")).otherwise(F.lit(encoded[1]).cast("long")))


def _trial_texts(n: int) -> list[str]:
    """SQL of the texts of the n-th trial field: none for each fifth one, two for each fourth, else one."""
    return [] if n % 5 == 4 else [f"concat('C', conv_id, ' ', turns, ' {n}')", "said_by"][: 1 + (n % 4 == 3)]


def _trial_oracle() -> str:
    fields = ", ".join(f"{' || chr(44) || chr(32) || '.join(_trial_texts(n)) or 'NULL::VARCHAR'} AS {field}" for n, field in enumerate(readers.TRIAL_FIELDS))
    return f"SELECT {fields} FROM (SELECT conv_id, count(*) AS turns, min(role) AS said_by FROM conversations GROUP BY conv_id)"


@query(_trial_oracle())
def trial_xml_collection(t: Tables) -> DataFrame:
    """All fields of trial records, one a conversation, out of files that hold many each; each third field lies one level deeper."""
    parts = [F.lit("<clinical_study rank='1'>")]
    for n, path in enumerate(readers.TRIAL_FIELDS.values()):
        tags = [*(["section"] if n % 3 == 0 else []), *path.split("/")]
        for x in _trial_texts(n):
            parts += [F.lit("".join(f"<{tag}>" for tag in tags) + "\n "), F.expr(x), F.lit("".join(f"</{tag}>" for tag in reversed(tags)))]
    conversations = t("conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.min("role").alias("said_by"))
    made = conversations.select(F.concat(*parts, F.lit("</clinical_study>")).alias("value"))
    path = shared_path(made, "trials")
    made.write.text(path)
    return readers.trial_records(readers.trial_collection(made.sparkSession, path, "*.txt")).drop("file_path")


@query("SELECT 'T' || p_partkey AS qid, p_name AS question, p_type || '|' || p_brand AS answers FROM part")
def live_question_xml(t: Tables) -> DataFrame:
    x = F.format_string('<L><NLM-QUESTION qid="T%d"><MESSAGE>%s</MESSAGE><RefAnswer> %s </RefAnswer><RefAnswer><b>%s</b></RefAnswer></NLM-QUESTION></L>', "p_partkey", "p_name", "p_type", "p_brand")
    q = readers.live_questions_test(t("part").select(x.alias("value")))
    return q.select("qid", "question", F.array_join("answers", "|").alias("answers"))


@query("SELECT p_name AS type FROM part WHERE p_partkey % 3 < 2")
def literal_lines(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 3
    line = F.when(k == 0, F.format_string("[{'type': '%s', 'n': None}]", "p_name")).when(k == 1, F.format_string('[{"type": "%s"}]', "p_name")).otherwise("oops [")
    return readers.python_literals(t("part").select(line.alias("v")), "v", "type string")


@query("SELECT p_partkey::VARCHAR AS uid, 'study_design' AS task, p_name AS input, p_brand AS label, '{\"p_size\":' || p_size || '}' AS meta FROM part")
def task_examples(t: Tables) -> DataFrame:
    df = t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("question"), F.lit("none").alias("inputs"), F.col("p_brand").alias("answer"), "p_size")
    return readers.task_examples(df, "study_design")


@query("SELECT event_id AS e_id, (props->>'$.k')::BIGINT AS e_p_k FROM events")
def flattened_records(t: Tables) -> DataFrame:
    p = F.from_json("props", "k long")
    return readers.flattened(t("events").select(F.struct(F.col("event_id").alias("id"), p.alias("p")).alias("e")), "_")


@query("SELECT (r - 1) // 100 AS batch, count(*) AS n, min(p_partkey) AS first FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS r FROM part) GROUP BY 1")
def row_batches(t: Tables) -> DataFrame:
    b = arrays.batches(t("part").select("p_partkey"), 100, "p_partkey")
    return b.select(F.col("batch"), F.size("rows").cast("long").alias("n"), F.col("rows")[0]["p_partkey"].alias("first"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN NULL ELSE p_retailprice END AS price, strftime(DATE '2020-01-02', '%Y-%m-%d') AS day FROM part")
def jsonable_records(t: Tables) -> DataFrame:
    df = t("part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, float("nan")).otherwise(F.col("p_retailprice")).alias("price"), F.lit("2020-01-02").cast("date").alias("day"))
    return arrays.jsonable(df)


@query("SELECT CASE WHEN p_partkey % 2 = 0 THEN 'N' || p_partkey ELSE 'P' || p_partkey END AS nct_id, p_name AS brief_title, CASE WHEN p_size > 25 THEN 'Completed' ELSE 'none' END AS overall_status, 'none' AS phase FROM part")
def validated_records(t: Tables) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    df = t("part").select(
        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("N"), k)).alias("NCTID"), F.concat(F.lit("P"), k).alias("ID"), F.col("p_name").alias("Brief Title"), F.when(F.col("p_size") > 25, "Completed").alias("study.status")
    )
    return clean.validated(df, ["nct_id", "brief_title", "overall_status", "phase"]).select("nct_id", "brief_title", "overall_status", "phase")


@query("""SELECT 'Inclusion' AS kind, sum(len(string_split(p_type, ' ')))::BIGINT AS n FROM part""")
def labelled_trials(t: Tables) -> DataFrame:
    df = t("part").select(F.col("p_partkey").cast("string").alias("nct_id"), F.col("p_name").alias("brief_title"), F.concat(F.lit("inclusion criteria\n"), F.replace("p_type", F.lit(" "), F.lit("\n"))).alias("eligibility_criteria"), F.lit("c").alias("condition"), F.lit("completed").alias("overall_status"))
    out = pipelines.labelled_trials(df)
    return out.agg(F.lit("Inclusion").alias("kind"), F.sum(F.size("inclusion_criteria")).alias("n"))


@query()
def text_columns_dedup(t: Tables) -> DataFrame:
    b = t("benchmark").withColumnRenamed("item_id", "row_id")
    return similarity.text_within(b, ["text"], 0.9)[0].select("row_id")


@query("SELECT brand AS p_brand, n, round(total, 2) AS total FROM (SELECT p_brand AS brand, count(*) AS n, sum(p_retailprice) AS total FROM part GROUP BY 1)")
def brand_totals(t: Tables) -> DataFrame:
    return t("part").groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("total"))

