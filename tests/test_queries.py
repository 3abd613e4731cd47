"""Every query with SQL gives what DuckDB gives on the same tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from millrace.plans.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def canonical(rows):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        return str(float(v)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(ORACLES[name])
    assert sorted(d[0] for d in found.description) == columns
    expected = duck.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({ORACLES[name]})").fetchall()
    assert canonical(tuple(r) for r in df.select(*(f"`{c}`" for c in columns)).collect()) == canonical(expected)


def test_embedded_texts_are_brute_force(spark):
    """The two queries that compare hashed embeddings, against numpy on the same texts."""
    import numpy as np

    from millrace.functions.text import joined_columns  # noqa: F401  (the text that is embedded)
    from millrace.operators.similarity import hash_encoder

    rows = sorted((r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect())
    v = hash_encoder()([t or "" for _, t in rows]).astype(float)
    cosine = v @ v.T
    want = {(rows[i][0], rows[j][0]): round(float(cosine[i, j]), 6) for i in range(len(rows)) for j in range(i + 1, len(rows)) if cosine[i, j] > 0.2}
    got = {(r.i, r.j): r.cosine for r in QUERIES["embed_and_compare"](spark, SF).collect()}
    assert got.keys() == want.keys() and want and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    gone: set = set()
    for (i, j), c in sorted(want.items()):
        if c > 0.9 and i not in gone:
            gone.add(j)
    assert {r.row_id for r in QUERIES["text_columns_dedup"](spark, SF).collect()} == {k for k, _ in rows} - gone


def test_overlap_scores(spark):
    """The batch measures against their plain definitions, a table for the subsequence and difflib, on every pair of turns."""
    import difflib

    from millrace.functions import overlap
    from millrace.plans.queries import turns

    got = {(r.conv_id, r.turn): r for r in QUERIES["overlap_scores"](spark, SF).collect()}
    pairs = {(r.conv_id, r.turn): (r.prediction, r.target) for r in turns(lambda name: spark.read.parquet(f"{SF}/{name}.parquet")).collect()}
    assert got.keys() == pairs.keys() and got
    for key, (p, t) in pairs.items():
        x, y = overlap._rouge_tokens(p), overlap._rouge_tokens(t)
        row = [0] * (len(y) + 1)
        for w in x:
            last = 0
            for j, v in enumerate(y, 1):
                last, row[j] = row[j], last + 1 if w == v else max(row[j], row[j - 1])
        one, two, _ = overlap.rouge_scores(p, t)
        want = overlap.bleu_score(p, t), one, two, 2 * row[-1] / max(1, len(x) + len(y)), overlap.entity_f1_score(p, t), difflib.SequenceMatcher(None, p or "", t or "").ratio()
        assert [got[key][c] for c in ("bleu", "rouge1", "rouge2", "rougeL", "entities", "ratio")] == pytest.approx(want, abs=1.1e-6), key


def test_without_the_corpus_operators(tmp_path):
    """The rest imports, lists its queries and runs one with millrace/llm and tests/llm deleted, with and without corpus_pipeline.py."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    code = (
        "import __spark_entry__ as e\nq, o = e.queries(), e.oracle_sql()\nassert set(o) <= set(q) and 'pipeline' not in q and not [n for n in q if n.startswith('op')], q\n"
        "from millrace.session import session\ns = session('copy', 'local[2]', 2, **{'spark.ui.enabled': 'false'})\nassert q['counts_and_totals'](s, '/root/testdata/sf0.001').count() > 0\n"
    )
    for delete in (False, True):
        if delete and (copy / "corpus_pipeline.py").exists():
            (copy / "corpus_pipeline.py").unlink()
        run = subprocess.run([sys.executable, "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=300)
        assert run.returncode == 0, run.stderr[-2000:]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_overlap_ratio_is_of_whole_texts(spark, tmp_path):
    import difflib

    start = "The dose was raised after the second visit. " * 8
    said = [start + "No adverse event was seen.", start + "zzz 12345 " * 30, "", start[:150], None, start]
    rows = [(1, i, "user", t) for i, t in enumerate(said)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.turn: r.ratio for r in QUERIES["overlap_scores"](spark, str(tmp_path)).collect()}
    assert got == {i: round(difflib.SequenceMatcher(None, said[i + 1] or "", said[i] or "").ratio(), 6) for i in range(len(said) - 1)}
    assert 0 < got[0] < 1
