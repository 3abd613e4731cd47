"""Mixing, packing, archives, the pipeline and the query list."""

from __future__ import annotations

import hashlib
import os
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing, packing, queries, warc


def test_targets():
    s = [mixing.Source(str(i), size, w, (1.0, 1.0)) for i, (size, w) in enumerate([(10, 5), (100, 2), (1000, 1), (0, 5)])]
    mixing.targets(s)
    assert sum(x.target for x in s) == pytest.approx(1110) and all(x.target <= 3 * x.size + 1e-9 for x in s)
    assert s[0].target == 30 and s[1].target == 300 and s[3].target == 0


def test_positions_follow_the_schedule(spark):
    curve = mixing.demand_curve((2.0, 1.0, 0.5))
    area = lambda t: sum((min(t, a + 0.5) - a) * (w + slope * (min(t, a + 0.5) - a) / 2) for _, a, w, slope in curve if t > a)
    c = F.array(*(F.struct(F.lit(a).alias("share"), F.lit(b).alias("time"), F.lit(w).alias("weight"), F.lit(s).alias("slope")) for a, b, w, s in curve))
    for share in (0.0, 0.2, 0.5, 0.9, 1.0):
        t = spark.range(1).select(mixing.position(F.lit(share), c)).first()[0]
        assert area(t) == pytest.approx(share, abs=1e-9)


def test_mix(spark, sf, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = {r.doc_id: (r.taken, r.positions) for r in mixing.mix(docs).collect()}
    again = {r.doc_id: (r.taken, r.positions) for r in mixing.mix(docs.repartition(9)).collect()}
    assert first == again
    got = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max(F.col("taken") - 3 * F.col("size")).alias("over")).collect()
    assert all(abs(r.taken - r.target) <= 1 and r.over <= 0 for r in got)
    odd = mixing.mix(odd_docs).collect()
    assert len(odd) == odd_docs.count() and all(r.taken == 0 and r.positions == [] for r in odd if r.doc_id in (1, 2, 3))
    assert mixing.mix(no_docs).count() == 0 == mixing.mixed_documents(no_docs).count()
    whole = mixing.mix(docs, whole=True)
    assert whole.where("taken % size <> 0 and size > 0").count() == 0
    copies = mixing.mixed_documents(docs)
    assert copies.columns == docs.columns and copies.count() == whole.agg(F.sum(F.size("positions"))).first()[0]


def test_reruns_agree_for_repeated_and_missing_ids(spark):
    """Rows of one id, of none, of one id in two sources: the order of the input doesn't matter."""
    rows = [(7, f"w{i} " * (i % 9 + 1), "a", i) for i in range(59)] + [(None, f"v{i} " * 3, "a", i) for i in range(40)]
    rows += [(i, f"t{i} one two", s, i) for i in range(40) for s in ("a", "b")] + [(99, "equal rows here", None, i) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int")
    seen = []
    for df in (docs, docs.orderBy(F.col("extra").desc()).repartition(5), docs.repartition(3, "text")):
        taken = mixing.mix(df).collect()
        copies = mixing.mixed_documents(df).collect()
        seen.append((sorted(map(str, taken)), sorted(map(str, copies))))
    assert seen[0] == seen[1] == seen[2] and len(seen[0][0]) == len(rows)


def test_taken_is_of_copies_with_a_position(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    level, late = ({r.doc_id: (r.taken, r.positions) for r in mixing.mix(docs, schedules=(s,)).collect()} for s in ((1.0, 1.0), (0.5, 1.0, 1.5)))
    assert all(level[d][0] == late[d][0] and len(level[d][1]) == len(late[d][1]) for d in level)
    assert sum(sum(p) for _, p in late.values()) > sum(sum(p) for _, p in level.values())
    real = mixing.position
    monkeypatch.setattr(mixing, "position", lambda share, curve: F.when(real(share, curve) < 0.5, real(share, curve)))
    half = {r.doc_id: r.taken for r in queries.op6_mixing(spark, sf).collect()}
    assert 0 < sum(half.values()) < 0.7 * sum(t for t, _ in level.values())


def test_price_and_plan():
    rng = np.random.default_rng(0)
    sizes = np.array([2, 3, 5, 7, 11])
    for _ in range(20):
        values = rng.random(5)
        best = 0.0
        for a in range(12):
            for b in range(8):
                for c in range(5):
                    for d in range(4):
                        for e in range(3):
                            n = np.array([a, b, c, d, e])
                            if n @ sizes <= 23:
                                best = max(best, float(n @ values))
        value, pattern = packing.price(values, sizes, 23)
        assert value == pytest.approx(best) and pattern @ sizes <= 23 and pattern @ values == pytest.approx(best)
    sizes, demand = np.arange(1, 65), rng.integers(0, 300, 64)
    sizes, demand = sizes[demand > 0], demand[demand > 0]
    plan = packing.plan(sizes, demand, 64)
    assert (sum(p * n for p, n in plan) == demand).all() and all(p @ sizes <= 64 for p, _ in plan)
    assert sum(n for _, n in plan) <= 1.02 * (sizes @ demand) / 64 + 1


def test_word_tokens_are_the_tokenizer():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    words, whole = packing.WordTokens(path), Tokenizer.from_file(path)
    texts = ["Hello, world! it's don't  foo).. bar!? «né». É.É né, x<|endoftext|>y <|startoftext|> 12.5, ... a\x1cb  c\x85d İx ΑΣ. ﬁ A\u0301b. 你好，世界。ok?", "", " \n", "!!!", "a.", "x" * 5000]
    texts += [r[0] for r in duckdb.execute("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    for _ in range(2):  # the second time from what is held
        assert words.encode_texts(texts) == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_pack(odd_docs, no_docs, spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    whole = Tokenizer.from_file(path)
    docs = odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    ids = {r.doc_id: np.array([*whole.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4") for r in docs.collect()}
    rows = packing.pack(docs, path).collect()
    held, filled = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        held[r.doc_id].append((r.start, r.length))
        filled[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in held[d]) == len(x) for d, x in ids.items())
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(no_docs, path).count() == 0
    assert packing.pack(odd_docs, path).count() == len(rows) + 2


def test_warc(spark, tmp_path):
    big, small = "<p>ü</p>" * 300, "tiny"
    data = [(1, "http://a/ b\n", big), (2, None, big), (3, "http://c", small), (4, "http://d", small), (5, "e", None), (6, "f", "\r\n\r\nWARC/1.1\r\n" + "x" * 2000), (7, "g", big)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("records", F.lit(1)).repartition(3)
    got = {r.page_id: r for r in warc.round_trip(pages, payloads=True).collect()}
    assert {i: r.record_type for i, r in got.items()} == {1: "revisit", 2: "revisit", 3: "response", 4: "response", 5: "response", 6: "response", 7: "response"}
    assert got[1].refers_to == got[2].refers_to == 7 and got[3].refers_to is None and got[2].url is None and got[1].url == "http://a/%20b%0A"
    for i, _, html in data:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert bytes(got[i].payload) == (raw if got[i].record_type == "response" else b"")
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_odd_pages(spark):
    """Pages without id, repeated rows, very long payloads, clashing columns."""
    big, huge = "x" * 1000, "é" * 3_000_000
    data = [(None, "a", big), (4, "b", big), (4, "b", big), (2, None, big), (None, None, None), (None, "c", "y" * 2000), (None, "d", "y" * 2000), (7, "e", huge), (6, "f", huge)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumns({c: F.lit("z") for c in ("archive", "place", "digest", "bytes", "keep")}).repartition(4)
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()), key=str)
    want = [(None, 1000, "revisit", 4), (4, 1000, "response", None), (4, 1000, "response", None), (2, 1000, "revisit", 4), (None, 0, "response", None)]
    want += [(None, 2000, "response", None)] * 2 + [(7, 6_000_000, "response", None), (6, 6_000_000, "revisit", 7)]
    assert got == sorted(want, key=str)


def test_pages_are_not_shuffled(spark, sf, monkeypatch):
    """Whatever the number of repeated payloads: no exchange of any job holds html."""
    monkeypatch.setattr("millrace.llm.shared.HEAVY_GROUPS", 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pages = spark.read.parquet(f"{sf}/pages.parquet")
        pages = pages.unionByName(pages.withColumn("page_id", F.col("page_id") + 10_000))
        written = warc.write_archives(pages, f"{warc.shared_uri(spark)}/not-shuffled")
        assert "html" not in written.columns
        plan = warc.refer(written)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" in plan and "html" not in plan
        found = warc.refer(written)
        assert found.count() == pages.count() and found.where("refers is not null").count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_normalised_members_stand_alone(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", f"body {i}") for i in range(5)], "page_id long, url string, html string").coalesce(1)
    done = warc.normalise(warc.write_archives(pages, f"file://{tmp_path}/raw"), f"file://{tmp_path}/raw", f"file://{tmp_path}/clean")
    assert done.agg(F.sum("records")).first()[0] == 5
    raw = (tmp_path / "raw/000000.warc.gz").read_bytes()
    d = zlib.decompressobj(31)
    assert d.decompress(raw).count(b"WARC/1.1") == 5 and d.unused_data == b""
    data, index = (tmp_path / "clean/000000.warc.gz").read_bytes(), (tmp_path / "clean/000000.warc.gz.index").read_text().splitlines()
    for i, line in enumerate(map(__import__("json").loads, index)):
        assert zlib.decompress(data[line[0] : line[0] + line[1]], 31).count(b"WARC/1.1") == 1 and line[2] == f"<urn:page:{i}>"


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        docs = docs.persist()
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    from test_dedup import brute_near

    by_id = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    texts = defaultdict(list)
    for d in kept["language_id"]:
        texts[" ".join(by_id[d].split())].append(d)
    assert sorted(kept["exact_dedup"]) == sorted(min(g) for g in texts.values())
    near = brute_near([(d, by_id[d]) for d in kept["exact_dedup"]])
    assert sorted(kept["near_dedup"]) == sorted({c for _, c in near.values()})
    assert set(kept["mixing"]) <= set(kept["near_dedup"])
    packed = p.STAGES[-1][1](spark, docs, sf)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0
    assert p.run(spark, sf).count() > 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    if name not in queries.ORACLES:
        assert df.count() > 0
        return
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{sf}/{t}'")
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in df.select(*columns).collect())
