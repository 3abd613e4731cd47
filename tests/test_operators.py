"""Cleaning, relational, sampling, scores, records, features on small tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.operators import clean, ehr, features, metrics, relational, sampling


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_validated(spark):
    df = spark.createDataFrame([("N1", "a", None, ["x", "y"]), (None, None, "Completed", None)], "NCTID string, `Brief.Title` string, study_status string, keyword array<string>")
    out = clean.validated(df.coalesce(1), ["nct_id", "brief_title", "overall_status", "condition"]).orderBy("nct_id")
    a, b = out.collect()
    assert (a.nct_id, a.brief_title, a.overall_status, a.keyword, a.condition) == ("N1", "a", "none", "x, y", "none")
    assert (b.nct_id, b.overall_status) == ("TRIAL000002", "Completed")


def test_small_cleaning(spark):
    df = spark.createDataFrame([("1", "a"), ("x", " "), (None, "nan")], "n string, t string")
    assert clean.numeric_where_whole(df, ["n"]).schema["n"].dataType.simpleString() == "string"
    assert dict(clean.numeric_where_whole(df.where("n = '1'"), ["n"]).dtypes)["n"] == "double"
    assert clean.drop_nullish(df, ["n", "t"]).count() == 1
    assert clean.resolve_column(df, "N") == "n"
    with pytest.raises(KeyError):
        clean.resolve_column(df, "zz")
    assert clean.search(df, "", ["t"]).count() == 3
    out = clean.standardise_qa(spark.createDataFrame([("q", "A", "A. long"), ("q", "nan", "x"), (None, "a", "b")], "q string, a string, l string"), "d", 1, "q", "a", "l").collect()
    assert [(r.question, r.answer, r.dedup_answer, r.quality) for r in out] == [("q", "A", "A. long", 1)]


def test_numbers_and_parts(spark):
    df = spark.range(10).repartition(3)
    assert [r.n for r in relational.with_row_number(df, "n", "id").orderBy("id").collect()] == list(range(1, 11))
    assert [r.part for r in relational.split_parts(spark.range(10), 3, "id").orderBy("id").collect()] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 2]


def test_first_and_outer(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, None, 1), (1, "x", 2)], "k int, v string, o int")
    assert rows(relational.left_with_first(a, b, "k", "o").select("k", F.coalesce("v", F.lit("-")))) == [(1, "x"), (2, "-")]
    c = spark.createDataFrame([(3, "z")], "k int, w string")
    assert relational.outer_chain([a, b.select("k", "v"), c], "k").where("k = 3").first().v == "none"


def qa(spark, sizes):
    data = [(i, f"{n}", q) for n, (size, q) in enumerate(sizes) for i in range(n * 1000, n * 1000 + size)]
    return spark.createDataFrame(data, "row_id long, dataset_name string, quality int")


def test_balanced(spark):
    df = qa(spark, [(100, 1), (50, 1), (3, 0), (200, 0)])
    out = sampling.balanced(df, 80)
    assert out.count() == 80 and out.select("row_id").distinct().count() == 80
    n = {r[0]: r[1] for r in out.groupBy("dataset_name").count().collect()}
    assert n["2"] >= 3 and n["0"] >= 5 and n["3"] >= 5
    assert rows(out) == rows(sampling.balanced(df.repartition(7), 80))
    assert sampling.balanced(df.limit(0), 5).count() == 0 and sampling.balanced(df, 500).count() == 500


def test_recovered(spark):
    df = qa(spark, [(20, 1), (4, 1)])
    out = sampling.recovered(df, df.where("dataset_name = 'zz'"), "dataset_name", "row_id")
    assert out.groupBy("dataset_name").count().orderBy("dataset_name").collect() == [("0", 10), ("1", 4)]


def test_classification(spark):
    df = spark.createDataFrame([("A", "A"), ("B", "B"), ("D", "C"), ("A", None)], "truth string, prediction string")
    c = {r.label: r for r in metrics.per_class(df).collect()}
    assert c["A"].recall == 0.5 and c["C"].support == 0 and metrics.MISSING in c
    n = metrics.evaluation_counts(df).first()
    assert (n.evaluated, n.correct, n.failed, n.invalid) == (4, 2, 1, 1)
    assert metrics.confusion(df).agg(F.sum("n")).first()[0] == 4 and metrics.confusion(df).count() == 25
    assert metrics.confusion(df.limit(0)).count() == 0


def test_ranking(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1)], "t int, s double")
    assert metrics.roc_auc(df, "t", "s").first()[0] == pytest.approx(0.875)
    assert metrics.average_precision(df, "t", "s").first()[0] == pytest.approx(0.5 + 0.5 * 2 / 3)
    assert metrics.roc_auc(df.where("t = 1"), "t", "s").first()[0] == 0
    hard = spark.createDataFrame([("A", "A"), ("B", "A"), ("B", "B")], "truth string, prediction string")
    r = metrics.hard_label_auc(hard).first()
    assert r.roc_auc == pytest.approx(0.75)


def test_regression_and_doses(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, None), (5.0, 5.0)], "y double, p double")
    r = metrics.regression_metrics(df, "y", "p").first()
    assert (r.mae, r.median_error) == (pytest.approx(1 / 3), 0)
    assert metrics.regression_metrics(df, "y", "p", penalise=False).first().evaluated == 2
    d = spark.createDataFrame([((1, 0, 1), (1, 0, 1)), ((2, 2, 2), None)], "truth struct<max:int,min:int,avg:int>, prediction struct<max:int,min:int,avg:int>")
    assert {r.part: r.accuracy for r in metrics.dose_metrics(d, "truth", "prediction").collect()} == {"max": 0.5, "min": 0.5, "avg": 0.5, "mean": 0.5, "all": 0.5}


def test_task_kind():
    assert metrics.task_kind(None, "trial-duration", "Long") == "binary" and metrics.task_kind(None, "trial-duration", 3.0) == "regression"
    assert metrics.task_kind(None, "dose", {}) == "multilabel" and metrics.task_kind("x", "dose", {}) == "x"
    assert metrics.positive_label(["Low", "High"]) == "High" and metrics.positive_label(["b", "a"]) == "a"


def test_episodes(spark):
    df = spark.createDataFrame([(1, 0, "hr", 1.0), (1, 50, "hr", 2.0), (1, 70, "bp", 3.0), (1, 120, "hr", 9.0), (2, 0, "hr", 1.0)], "hadm_id int, s int, variable string, value double")
    df = df.withColumn("charttime", F.timestamp_seconds("s"))
    out = ehr.episodes(df, 60, ["hr", "bp"]).orderBy("upper").collect()
    assert [(r.hadm_id, r.upper, r.hr, r.bp) for r in out] == [(1, 60, 2.0, None), (1, 120, None, 3.0)]
    assert ehr.episodes(df, 60, ["hr", "bp"], how="mean").orderBy("upper").first().hr == 1.5
    assert ehr.episodes(df, 60, ["hr"], least_rows=2).count() == 0


def test_nesting_and_visits(spark):
    a = spark.createDataFrame([(1, 10, "2020-01-01"), (1, 11, "2020-01-03"), (2, 12, None)], "subject int, hadm int, at string").withColumn("at", F.to_timestamp("at"))
    d = spark.createDataFrame([(10, "x", 1), (10, "x", 2), (10, None, 3), (11, "y", 1)], "hadm int, code string, pos int")
    n = ehr.nested(a, {"dx": (d, "pos")}, "hadm").orderBy("hadm").collect()
    assert [len(r.dx) for r in n] == [3, 1, 0]
    v = ehr.visit_events(a, d, d.withColumnRenamed("code", "drug").limit(0), "subject", "hadm", "at", "code", "drug", "pos")
    assert rows(v.select("hadm", "days", F.array_join("events", ","))) == [(10, 0, "DX:x"), (11, 2, "DX:y")]
    coded, vocab = ehr.visit_sequences(v, "subject", "at")
    assert coded.first().visits == [[1], [2]] and rows(vocab) == [("DX:x", 1), ("DX:y", 2)]
    docs = ehr.sampled_documents(a, {"dx": (d, "pos")}, "hadm", 2)
    assert docs.count() == 2


def test_transform_round_trip(spark):
    df = spark.createDataFrame([(1.0, "a", True, 0), (3.0, "b", False, 5), (None, "a", True, 9)], "x double, c string, b boolean, i int")
    assert features.kinds(df) == {"x": "numerical", "c": "categorical", "b": "boolean", "i": "categorical"}
    for how, cat in (("standard", "label"), ("minmax", "onehot")):
        t = features.TableTransform(numeric=how, category=cat).fit(df)
        back = features.TableTransform.from_json(t.to_json()).inverse(t.transform(df)).collect()
        assert [(r.x, r.c, r.b, r.i) for r in back] == [(1.0, "a", True, "0"), (3.0, "b", False, "5"), (2.0, "a", True, "9")]
    assert features.demographic_columns(spark.createDataFrame([(1, 2)], "gender_f int, x int")) == ["gender_f"]


def test_large_groups_are_ranked_in_buckets(spark):
    """Ranks by counts and buckets are those of one window, and no plan puts all rows into one partition."""
    from pyspark.sql import Window

    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 > 0, "a").when(F.col("id") % 6 == 0, F.lit(None)).otherwise("b").alias("g"), (F.col("id") * 7919 % 101).alias("s"), (F.col("id") % 2).alias("t"))
    want = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(sampling.draw(F.col("id")), "id")))
    got = sampling.ranked(df, ["g"], "id", 42, "r")
    assert rows(got.select("id", "r")) == rows(want.select("id", "r"))
    assert rows(sampling.per_group(df, ["g"], 7, "id").select("id")) == rows(want.where("r <= 7").select("id"))
    curve = metrics.score_curve(df, "t", "s")
    totals = df.groupBy("s").agg(F.sum("t").alias("p"), F.count("*").alias("n")).orderBy(F.desc("s")).collect()
    tp, seen, expected = 0, 0, []
    for x in totals:
        tp, seen = tp + x.p, seen + x.n
        expected.append((x.s, tp, seen - tp))
    assert sorted((x.s, x.tp, x.fp) for x in curve.collect()) == sorted(expected)
    by = metrics.score_curve(df.na.fill("z"), "t", "s", ["g"])
    assert {(x.g, x.P) for x in by.collect()} == {(x.g, x.P) for x in df.na.fill("z").groupBy("g").agg(F.sum("t").alias("P")).collect()}
    for n in (0, 1, 4, 5):
        values = [float(x * x % 7) for x in range(n)]
        one = relational.median(spark.createDataFrame([(v,) for v in values], "e double"), "e").first()[0]
        assert one == (None if not n else pytest.approx(sorted(values)[n // 2] if n % 2 else sum(sorted(values)[n // 2 - 1 : n // 2 + 1]) / 2))
    assert sampling.upsample(df, 5000, "id").count() == 5000
    for made in (sampling.upsample(df, 10, "id"), sampling.train_test(df, "g", "id"), sampling.ranked(df, ["g"], "id", 1, "r"), ehr.vocabulary(df, "g", ["id"])):
        plan = made._jdf.queryExecution().executedPlan().toString()
        windows = [line for line in plan.splitlines() if "Exchange SinglePartition" in line]
        assert len(windows) <= 1  # the window over one row a partition


def test_lookup_both(spark):
    mapping = spark.createDataFrame([(1, "a"), (2, "b")], "x long, y string")
    left = spark.createDataFrame([(1, 5, "late"), (1, 3, "first"), (2, 1, "two")], "x long, o long, v string")
    right = spark.createDataFrame([("a", 1)], "y string, w long")
    found = relational.lookup_both(mapping, left, right, "x", "y", order="o", missing="drop")
    assert [(r.x, r.v, r.w) for r in found.collect()] == [(1, "first", 1)]
    with pytest.raises(Exception, match="no row of y b"):
        relational.lookup_both(mapping, left, right, "x", "y").collect()


def test_confusion_of_free_texts(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "some text"), ("b", "other text"), ("b", None)], "truth string, prediction string")
    found = {(r.truth, r.prediction): r.n for r in metrics.confusion(df, only_truth=True).collect()}
    assert found["a", "__OTHER__"] == 1 and found["b", "__OTHER__"] == 2 and found["a", "a"] == 1 and found["b", "a"] == 0
