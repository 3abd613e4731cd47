"""The thin queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, whitening
from .clustering import cluster
from .exact_dedup import exact_duplicates
from .fingerprints import edited_fingerprints
from .language import fit, identify, training_rows
from .mixing import mix
from .near_dedup import near_duplicates
from .packing import pack
from .quality import fold, labelled_sample, score, train
from .secrets import default_forest, scan
from .url_filters import judge, rule_rows
from .warc import round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE_OP2 = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "pages").select("page_id", "url"), rule_rows(spark, URL_RULES)).drop("url")


ORACLE_OP3 = r"""
WITH u AS (SELECT page_id, coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '') AS h,
                  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
p AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
r(action, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                                   ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action
      FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN m ON p.page_id = m.page_id
"""


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(_table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix by document, range-sorted by first training position (first_place: in millionths of the training time; null if not taken)."""
    found = mix(_table(spark, sf_dir, "documents"))
    place = F.floor(F.try_element_at("positions", F.lit(1)) * 1_000_000)
    found = found.select("doc_id", "size", "source_size", "target", "taken", F.size("positions").cast("long").alias("copies"), place.alias("first_place"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return found.repartitionByRange(parts, "first_place", "doc_id").sortWithinPartitions("first_place", "doc_id")


# The excess is reshared in one step: sources sorted by 3 size / weight, unit: what a weight of 1 gets if all before are full.
# Schedules go linearly from 1.25 to 0.75, stay at 1, or go from 0.75 to 1.25; a position is the root of the quadratic that integrates them, by halves.
ORACLE_OP6 = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) || ':mix') AS place, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, (CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight FROM s),
u AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS unit
      FROM w WINDOW b AS (ORDER BY 3 * source_size / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, i, source_size, round(least(weight * (SELECT max(unit) FROM u), 3.0 * source_size), 6)::DOUBLE AS target FROM u),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-9) ELSE 0 END AS passes FROM t),
l AS (SELECT doc_id, i, size, source_size, target, passes, greatest(target - passes * source_size, 0) AS part, coalesce(sum(size) OVER b, 0) AS begin
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source WINDOW b AS (PARTITION BY d.source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT *, CASE WHEN passes >= 3 THEN 0 ELSE least(greatest(round(part) - begin, 0), size) END AS extra, begin::DOUBLE / nullif(greatest(target, passes * source_size), 0)::DOUBLE AS share FROM l),
c AS (SELECT *, (CASE WHEN size > 0 THEN passes ELSE 0 END + CASE WHEN extra > 0 THEN 1 ELSE 0 END)::BIGINT AS copies,
             (CASE i % 3 WHEN 0 THEN 0.5625 WHEN 1 THEN 0.5 ELSE 0.4375 END)::DOUBLE AS half, (CASE i % 3 WHEN 0 THEN -0.5 WHEN 1 THEN 0 ELSE 0.5 END)::DOUBLE AS slope,
             (CASE i % 3 WHEN 0 THEN 1.25 WHEN 1 THEN 1 ELSE 0.75 END)::DOUBLE AS start FROM e),
f AS (SELECT *, (CASE WHEN half <= share THEN 0.5 ELSE 0 END)::DOUBLE AS time, (CASE WHEN half <= share THEN 1 ELSE start END)::DOUBLE AS level, share - CASE WHEN half <= share THEN half ELSE 0 END AS rest FROM c)
SELECT doc_id, size, source_size, target, (passes * size + extra)::BIGINT AS taken, copies,
       CASE WHEN copies > 0 THEN floor(least(time + 2 * rest / (level + sqrt(greatest(level * level + 2 * slope * rest, 0))), 1) * 1000000)::BIGINT END AS first_place
FROM f
"""


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = train(*labelled_sample(docs, labels.where(fold(F.col("doc_id"), 3) != 1), "quality"))
    return score(docs, model).withColumn("held_out", fold(F.col("doc_id"), 3) == 1)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = training_rows(docs)
    models = fit(docs.where(~held_out))
    found = identify(docs.select("doc_id", "text", held_out.alias("held_out")), models)
    return found.select("doc_id", "held_out", F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"), F.col("__rejected").alias("rejected"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_table(spark, sf_dir, "documents"), default_forest(spark))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# Lengths by strlen(): bytes of UTF-8.
ORACLE_OP10 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest FROM p),
g AS (SELECT payload_digest AS k, max(page_id) AS keep FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN keep IS NULL OR keep = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN keep IS DISTINCT FROM page_id THEN keep END AS refers_to
FROM d LEFT JOIN g ON payload_bytes >= 1000 AND payload_digest = k
"""

def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster(_table(spark, sf_dir, "embeddings"))
    table = spark.createDataFrame(found.summary(), "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.members.join(F.broadcast(table), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle_op11(rounds: int = 5) -> str:
    """Assignments and floored means, written out round by round."""
    nearest = "SELECT vec_id, x, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT vec_id, x, c, list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, {0}) GROUP BY vec_id, x"
    steps = [
        "v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64)",
        "c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1)::INTEGER AS c, x AS y FROM v QUALIFY c < 40)",
    ]
    for r in range(1, rounds + 1):
        steps += [
            f"a{r} AS MATERIALIZED ({nearest.format(f'c{r - 1}')})",
            f"s{r} AS (SELECT c, i, sum(x[i]) AS s, count(*) AS n FROM a{r}, generate_series(1, 64) g(i) GROUP BY c, i)",
            f"m{r} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS y FROM s{r} GROUP BY c)",
            f"c{r} AS MATERIALIZED (SELECT c, coalesce(m{r}.y, o.y) AS y FROM c{r - 1} o LEFT JOIN m{r} USING (c))",
        ]
    steps.append(f"f AS MATERIALIZED ({nearest.format(f'c{rounds}')})")
    return f"""
WITH {", ".join(steps)}
SELECT vec_id, c AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(y, ',')) AS centroid_sha256
FROM f JOIN c{rounds} USING (c)
"""


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    found = byte_bpe.decode(byte_bpe.encode(_table(spark, sf_dir, "documents"), path, pattern), path, pattern)
    return found.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, most = _table(spark, sf_dir, "embeddings"), 32
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = whitening.fit(vectors)
    if model is None:
        return spark.createDataFrame([], schema)
    most = min(most, len(model.sums))
    explained = F.array(*(F.lit(float(e)) for e in model.explained[:most]))
    error = F.lit(whitening.identity_error(vectors, model, most=most)).cast("double")
    rows = whitening.transform(vectors, model, most=most).withColumn("component", F.explode(F.sequence(F.lit(1), F.lit(most))))
    return rows.select(
        F.col("id").alias("vec_id"),
        "component",
        F.lit(model.n).cast("long").alias("n"),
        F.col("deviation").cast("long").alias("deviation"),
        F.try_element_at("whitened", F.col("component")).alias("whitened"),
        F.element_at(explained, F.col("component")).alias("explained"),
        error.alias("identity_error"),
    )


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_url_filters": op3_url_filters,
    "op4_fingerprints": op4_fingerprints,
    "op5_packing": op5_packing,
    "op6_mixing": op6_mixing,
    "op7_quality": op7_quality,
    "op8_language_id": op8_language_id,
    "op9_secrets": op9_secrets,
    "op10_warc": op10_warc,
    "op11_clustering": op11_clustering,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_whitening": op13_whitening,
}
ORACLES = {"op2_exact_dedup": ORACLE_OP2, "op3_url_filters": ORACLE_OP3, "op6_mixing": ORACLE_OP6, "op10_warc": ORACLE_OP10, "op11_clustering": _oracle_op11()}
