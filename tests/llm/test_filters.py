"""URL filters, fingerprints, secrets, language and quality."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from millrace.llm import fingerprints, language, quality, secrets, url_filters
from millrace.llm.queries import URL_RULES


def brute_judge(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    best = None
    for action, rule in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or (len(rule), len(h)) > (len(best[1]), len(best[1].partition("/")[0]))):
            best = (action, rule)
    return host, path, best[1] if best else None, best[0] if best else "allow"


def test_urls(spark):
    r = random.Random(3)
    hosts = ["a.org", "example.org", "EXAMPLE.org", "x.example.org", "notexample.org", "org", "com", "b.com", "example.com", "example.com-x", "z.net", "example.org:80"]
    urls = [f"http{r.choice(['', 's'])}://{r.choice(hosts)}{r.choice(['', '/', '/es/', '/es', '/en/1', '/en/12?x=/de/', '/fr/a#b', '/de/'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "http://", "://x.org/", "a://b://org/"]
    rules = [*URL_RULES, ("block", "x.example.org/"), ("allow", "net/a/b/"), ("block", "z.net/")]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash")).repartition(5)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(df, url_filters.rule_rows(spark, rules)).collect()}
    assert got == {i: brute_judge(u, rules) for i, u in enumerate(urls)}
    none = url_filters.rule_rows(spark, [("allow", "org/")]).limit(0)
    assert {r.verdict for r in url_filters.judge(df, none, default="block").collect()} == {"block"}
    assert url_filters.judge(df.limit(0), none).count() == 0


def brute_syncmers(hashes):
    k, s = fingerprints.K, fingerprints.S
    w = k - s + 1
    return [i for i in range(len(hashes) - w + 1) if min(hashes[i], hashes[i + w - 1]) == min(hashes[i : i + w])]


def test_syncmers(spark):
    text = " ".join(f"w{random.Random(i).randrange(50)}" for i in range(200))
    df = spark.createDataFrame([(1, text), (2, "prefix words here " + text), (3, "a b"), (4, None)], "id long, t string")
    smers = {r.id: r["__smers"] for r in fingerprints.with_smers(df, "t").collect()}
    found = {r.id: r.anchors for r in fingerprints.document_anchors(df, "t", "id").collect()}
    assert [a.position for a in found[1]] == brute_syncmers(smers[1]) and len(found[3]) == 1 and found[4] == []
    assert {a.hash for a in found[1]} <= {a.hash for a in found[2]}  # context-free
    anchored = fingerprints.document_anchors(df, "t", "id")
    m = fingerprints.match_offsets(anchored.where("id = 1"), anchored.where("id = 2")).first()
    assert (m.shift, m.matches >= len(found[1]) - 5) == (3, True)


def test_texts_of_few_units_have_an_anchor(spark):
    r = random.Random(6)
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(n)) for n in (1, 4, *[5] * 40, *[6] * 40, 7, 8, 9, 30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {x.id: x.anchors for x in fingerprints.document_anchors(docs).collect()}
    smers = {x.doc_id: x["__smers"] for x in fingerprints.with_smers(docs, "text").collect()}
    for i in range(len(texts)):
        closed = brute_syncmers(smers[i]) if len(smers[i]) > 1 else []
        assert [a.position for a in found[i]] == (closed or [0])
    got = {x.doc_id: x for x in fingerprints.edited_fingerprints(docs).collect()}
    assert len({x.fingerprint for x in got.values()}) == len(texts) and "" not in {x.edited_fingerprint for x in got.values()}
    assert all(x.near_next == 0 for x in got.values())
    for i in found:
        assert [h for _, h in parsed(got[i].fingerprint)] == [a.hash & (2**32 - 1) for a in found[i]]
        assert [p for p, _ in parsed(got[i].fingerprint)] == [a.position for a in found[i]]


def parsed(fingerprint):
    """(position, hash) of the anchors that a fingerprint holds."""
    out, at = [], 0
    for k in range(0, len(fingerprint), fingerprints.WIDTH):
        at += int(fingerprint[k], 16)
        out.append((at, int(fingerprint[k + 1 : k + fingerprints.WIDTH], 16)))
    return out


def brute_likeness(a, b):
    """Share of the links (hash before, distance, hash) that two fingerprints have in common."""
    sets = []
    for found in (parsed(a), parsed(b)):
        sets.append({(-1 if k == 0 else found[k - 1][1], p - (found[k - 1][0] if k else 0), h) for k, (p, h) in enumerate(found)})
    union = sets[0] | sets[1]
    return len(sets[0] & sets[1]) / len(union) if union else 1.0


def test_likeness_is_brute_force(spark, sf):
    """On every document: the fingerprints are those of the texts, and likeness is that of all anchors by position."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs).collect()}
    edits = [(d, t[: len(t) - len(t) // 3] + rows[(i + 1) % len(rows)][1][: len(t) // 3]) for i, (d, t) in enumerate(rows)]
    of = {x.doc_id: x.fingerprint for x in fingerprints.edited_fingerprints(spark.createDataFrame(edits, "doc_id long, text string")).collect()}
    for i, (d, t) in enumerate(rows):
        x, after = got[d], got[rows[(i + 1) % len(rows)][0]]
        assert x.edited_fingerprint == of[d]
        assert x.near_edited == pytest.approx(brute_likeness(x.fingerprint, x.edited_fingerprint))
        assert x.near_next == pytest.approx(brute_likeness(x.fingerprint, after.fingerprint))
    plain = [x for x in got.values() if x.n_chars > 300]
    assert sum(x.near_edited > x.near_next for x in plain) > 0.95 * len(plain)
    assert 0.3 < sum(x.near_edited for x in plain) / len(plain) < 0.7
    shifted = [(1, "lead words come first " + rows[0][1]), (2, rows[0][1])]
    alone = {x.doc_id: x for x in fingerprints.edited_fingerprints(spark.createDataFrame(shifted, "doc_id long, text string")).collect()}
    assert len(parsed(alone[2].fingerprint)) > 20 and alone[2].near_next > 0.8  # matching is by distance, not by place


def test_edited(odd_docs, no_docs, spark):
    docs = odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs).collect()}
    for i, (d, t) in enumerate(rows):
        third, after = len(t) // 3, rows[(i + 1) % len(rows)][1]
        edited = t[: len(t) - third] + after[:third]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
    assert got[9].fingerprint == got[9].fingerprint != got[10].fingerprint and got[2].fingerprint == "" == got[1].fingerprint
    assert got[8].near_next > 0.9 and got[2].near_next == 1.0
    assert fingerprints.edited_fingerprints(no_docs).count() == 0
    assert fingerprints.edited_fingerprints(odd_docs).count() == odd_docs.count()


def test_secrets(spark, odd_docs, no_docs):
    forest = secrets.default_forest(spark)
    r = random.Random(8)
    key = "".join(r.choice("0123456789abcdef") for _ in range(40))
    texts = [
        (f'ä token = "{key}" end', True),
        (f'api_key: "{key}"', True),
        (f"commit {key} was fine", False),
        ("see /usr/share/data/source/files/index1.html", False),
        ("token = your-api-key-here-123", False),
        ("plain text without candidates", None),
        (None, None),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    found = secrets.scan(docs, forest).collect()
    assert {x.doc_id: x.is_secret for x in found} == {i: s for i, (_, s) in enumerate(texts) if s is not None}
    assert all(texts[x.doc_id][0][x.start : x.start + x.length] == x.secret for x in found)
    twice = secrets.scan(spark.createDataFrame([(1, f"token={key} token={key}"), (1, f"token={key} token={key}")], "doc_id long, text string"), forest)
    assert sorted(x.start for x in twice.collect()) == [0, 0, 47, 47]
    assert secrets.scan(no_docs, forest).count() == 0 and secrets.scan(odd_docs, forest).count() >= 0


def test_secrets_under_long_names(spark):
    r = random.Random(21)
    names = ("aws_secret_access_key", "GITHUB_ACCESS_TOKEN", "stripe_secret_key", "azure_storage_access_key")
    keys = ["".join(r.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(40)) for _ in range(12)]
    texts = [f"é {names[i % 4]}{(': ', ' = ', ': "', '="')[i // 4]}{key}" + ('"' if i >= 8 else "") + f" {names[i % 3]} a" for i, key in enumerate(keys)]
    docs = spark.createDataFrame([*enumerate(texts), (99, f"{keys[0]} {keys[1]} {keys[2]}é{keys[3]}")], "doc_id long, text string")
    text = {r.doc_id: r.text for r in docs.collect()}
    found = secrets.candidates(docs).collect()
    for x in found:
        end = x.start + len(x.candidate)
        assert x.before == text[x.doc_id][max(0, x.start - secrets.WINDOW) : x.start].lower() and x.after == text[x.doc_id][end : end + secrets.WINDOW].lower()
    assert sum(x.doc_id == 99 for x in found) == 4
    judged = {(x.doc_id, x.secret): x.is_secret for x in secrets.scan(docs, secrets.default_forest(spark)).collect()}
    assert all(judged[i, key] for i, key in enumerate(keys))


def test_short_and_punctuated_secrets(spark):
    texts = [
        ("password = Tr0ub4dorX9", "Tr0ub4dorX9", True),
        ("ü passwd: 'x9!kQ@2m#Zr$7'.", "x9!kQ@2m#Zr$7", True),
        ("my_database_password: Qx7!aB@93z, next", "Qx7!aB@93z", True),
        ("pwd=K7#mz!Q4p@t2", "pwd=K7#mz!Q4p@t2", True),
        ("api_key = qzjxkvwpbmtrhgfdncls", "qzjxkvwpbmtrhgfdncls", True),
        ("API_KEY: QZJXKVWPBMTRHGFDNCLSQWZX", "QZJXKVWPBMTRHGFDNCLSQWZX", True),
        ("password: required", "required", False),
        ("token = get_token()", "get_token(", False),
        ("a Donaudampfschifffahrt once", "Donaudampfschifffahrt", False),
        ("-" * 40, "-" * 40, False),
        ("pwd=ab1!;password=cd2!&token=ef3!", None, None),
    ]
    docs = spark.createDataFrame([(i, t[0]) for i, t in enumerate(texts)], "doc_id long, text string")
    found = secrets.scan(docs, secrets.default_forest(spark)).collect()
    assert all(texts[x.doc_id][0][x.start : x.start + x.length] == x.secret for x in found)
    assert {(x.doc_id, x.secret): x.is_secret for x in found if x.doc_id < 10} == {(i, s): y for i, (_, s, y) in enumerate(texts) if s}
    assert sorted(x.secret for x in found if x.doc_id == 10) == ["password=cd2!", "pwd=ab1!", "token=ef3!"]
    long = "password = " + "a!" * 50_000
    assert secrets.candidates(spark.createDataFrame([(1, long)], "doc_id long, text string")).first().candidate == long[11:]


def test_forest_on_findings_it_has_not_seen(spark):
    forest = secrets.default_forest(spark)
    fresh = secrets.labelled_findings(600, seed=99)
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(fresh)], "doc_id long, text string")
    hit = {x.doc_id: x.is_secret for x in secrets.scan(df, forest).collect()}
    assert sum(hit.get(i, False) == bool(y) for i, (_, y) in enumerate(fresh)) / len(fresh) > 0.93


def test_language(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.training_rows(docs)
    models = language.fit(docs.where(~out))
    assert set(models) == {"en", "fr", "de", "es"} and all(len(m) <= language.DICTIONARY_BYTES for m in models.values())
    held = language.identify(docs.where(out), models)
    assert held.agg(F.avg((F.col("lang") == F.col("__lang")).cast("double"))).first()[0] > 0.95
    odd = {r.doc_id: (r["__lang"], r["__score"], r["__rejected"]) for r in language.identify(odd_docs, models).collect()}
    assert odd[1] == odd[2] == odd[3] == odd[13] == ("und", 0.0, True) and odd[7][0] in models
    assert language.identify(no_docs, models).count() == 0
    assert language.fit(no_docs) == {} and {r["__lang"] for r in language.identify(odd_docs, {}).collect()} == {"und"}


def test_quality(spark, odd_docs, no_docs):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    seen = labels.where(quality.fold(F.col("doc_id"), 3) != 1)
    model = quality.train(*quality.labelled_sample(docs, seen, "quality", most=1200))
    held = quality.score(docs, model).join(labels.where(quality.fold(F.col("doc_id"), 3) == 1), "doc_id")
    assert held.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0] > 0.97
    odd = quality.score(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert quality.score(no_docs, model).count() == 0
    assert quality.train([], []).bias == 0 and quality.train(["a"], [1]).bias > 0


@pytest.mark.parametrize("text", ["", "a", "ab cd", "aaaa"])
def test_ngrams_stay_inside_words(text):
    import numpy as np

    raw = text.encode()
    got, at = quality.hashed_ngrams(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 3)
    assert [int(i) for i in at] == [i for i in range(len(raw) - 2) if text[i + 1] != " "]
