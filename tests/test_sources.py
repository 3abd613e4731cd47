"""Readers and writers on small files, and the plans on top."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.functions.text import HALLMARKS
from millrace.plans import convert, evaluate, pipelines, prompts
from millrace.sources import readers, writers


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_tables(spark, tmp_path):
    p = write(tmp_path / "d/a.csv", 'A,b\n"x\ny",1\n')
    assert readers.csv(spark, p, lower=True).first().asDict() == {"a": "x\ny", "b": "1"}
    write(tmp_path / "d/sub/b.csv", "A,b\nz,2\n")
    found = readers.directory(spark, str(tmp_path / "d"), "csv")
    assert found.count() == 2 and found.select("file_path").distinct().count() == 2
    assert readers.pipes(spark, write(tmp_path / "p.txt", "a|b\n1|2\n")).first().b == "2"
    assert [r.value for r in readers.lines(spark, write(tmp_path / "l.txt", " a \n\n b\n")).collect()] == ["a", "b"]
    assert readers.positional_csv(spark, p, ["n"]).columns == ["n"]
    assert readers.resolve_csv(spark, str(tmp_path / "d/a")).endswith("a.csv")
    with pytest.raises(FileNotFoundError):
        readers.resolve_csv(spark, str(tmp_path / "none"))
    assert readers.missing_inputs(spark, [p, str(tmp_path / "no")]) == [str(tmp_path / "no")]


def test_json(spark, tmp_path):
    assert readers.json_documents(spark, write(tmp_path / "s.json", '{"studies": [{"a": {"b": 1}}, {"a": {"b": 2}}]}')).count() == 2
    assert readers.flattened(readers.json_documents(spark, str(tmp_path / "s.json"))).columns == ["a.b"]
    k = readers.keyed_json(spark, write(tmp_path / "k.json", '{"i1": {"q": "x"}, "i2": {"q": "y"}}'), "q string")
    assert sorted(map(tuple, k.collect())) == [("i1", "x"), ("i2", "y")]
    lit = spark.createDataFrame([("[{'type': 'a'}]",), ('[{"type": "b"}]',), ("oops",)], "t string")
    assert sorted(r[0] for r in readers.python_literals(lit, "t", "type string").collect()) == ["a", "b"]
    assert readers.visits_json(spark, write(tmp_path / "v.json", '{"s": [[1, 2], [3]]}')).first().visits == [[1, 2], [3]]


TRIAL = "<clinical_study><id_info><nct_id>N1</nct_id></id_info><brief_title>T</brief_title><brief_summary><textblock> a\n b </textblock></brief_summary><condition>C1</condition><condition>C2</condition></clinical_study>"


def test_xml(spark, tmp_path):
    write(tmp_path / "x/t.xml", TRIAL)
    write(tmp_path / "x/y/bad.xml", "not xml")
    t = readers.trial_records(readers.xml_files(spark, str(tmp_path / "x")), ["nct_id", "brief_summary", "condition", "phase"])
    r = t.where("nct_id is not null").first()
    assert (r.brief_summary, r.condition, r.phase) == ("a b", "C1, C2", None) and t.count() == 2
    with pytest.warns(UserWarning, match="unknown"):
        readers.trial_records(t, ["zz"])
    more = spark.createDataFrame([("<s><phase>1</phase><WhyStopped>no\n funds</WhyStopped></s>",), ("bad",)], "value string")
    assert [r[0] for r in more.select(readers.other_fields(more)).collect()] == [{"why_stopped": "no funds"}, None]
    write(tmp_path / "q/d.xml", '<Document id="1" source="s" url="u"><Focus>F</Focus><QAPairs><QAPair pid="1"><Question qid="1-1" qtype="i">Q?</Question><Answer>A.</Answer></QAPair></QAPairs></Document>')
    d = readers.qa_documents(spark, str(tmp_path / "q")).first()
    assert (d.doc_id, d.question_text, d.answer_text, d.question_type) == ("1", "Q?", "A.", "i")
    assert convert.documents(readers.qa_documents(spark, str(tmp_path / "q"))).count() == 1
    write(tmp_path / "s/s.xml", '<c><sentence id="1" text="hi"/></c>')
    assert tuple(readers.sentences(spark, str(tmp_path / "s")).first()) == ("1", "hi")
    write(tmp_path / "n/n.xml", '<L><NLM-QUESTION questionid="Q1"><SUBJECT>S</SUBJECT><MESSAGE>M</MESSAGE><SUB-QUESTIONS><SUB-QUESTION subqid="1"><ANNOTATIONS><FOCUS>f</FOCUS><TYPE>t</TYPE></ANNOTATIONS><ANSWERS><ANSWER answerid="1"> a1 </ANSWER><ANSWER answerid="2">a2</ANSWER></ANSWERS></SUB-QUESTION></SUB-QUESTIONS></NLM-QUESTION></L>')
    assert [r.answer for r in convert.live(readers.live_questions(spark, str(tmp_path / "n"))).collect()] == ["a1", "a2"]
    test = spark.createDataFrame([('<L><NLM-QUESTION qid="T1"><MESSAGE>M</MESSAGE><ReferenceAnswer>a <b>b</b></ReferenceAnswer></NLM-QUESTION></L>',)], "value string")
    r = readers.live_questions_test(test).first()
    assert (r.qid, r.answers) == ("T1", ["a b"])


def test_trial_fields_from_one_parse(spark, tmp_path):
    odd = [
        None,
        "",
        "<a><b></a>",
        "<!DOCTYPE s><s><x><eligibility><criteria><textblock>in\n <!-- c -->out</textblock></criteria></eligibility></x><criteria><textblock>no</textblock></criteria></s>",
        "<?xml version='1.0' encoding='ISO-8859-1'?><s><keyword>\u00e9 &amp; <![CDATA[<f>]]></keyword><keyword> </keyword><keyword>k<b>no</b>l</keyword></s>",
        "<s><keyword>" + "long " * 200_000 + "</keyword></s>",
    ]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "`a.b` int, value string")
    got = {r["a.b"]: r for r in readers.trial_records(df).collect()}
    assert len(got) == len(odd) and all(got[i][f] is None for i in (0, 1, 2) for f in readers.TRIAL_FIELDS)
    assert (got[3].eligibility_criteria, got[4].keyword) == ("in, out", "\u00e9 & <f>, k, l") and len(got[5].keyword) == 999_999
    assert readers.trial_records(df.where("false")).count() == 0 and readers.trial_records(df).columns == ["a.b", *readers.TRIAL_FIELDS]
    plan = readers.trial_records(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("run(") <= 2 and "xpath" not in plan and plan.count("ArrowEvalPython") == 1  # one parse for all fields


def test_trials_of_one_file_are_cut_anywhere(spark, tmp_path):
    records = [f"<clinical_study rank='{i}'>\n<nct_id>N{i}</nct_id><keyword>\u00e9{'x' * (i % 97)}</keyword>\n</clinical_study>" for i in range(500)]
    write(tmp_path / "t/all.xml", "<?xml version='1.0'?>\n<all>\n" + "\n".join(records) + "\n</all>\n")
    write(tmp_path / "t/sub/one.xml", "<clinical_study><nct_id>one</nct_id></clinical_study>")
    write(tmp_path / "t/none.xml", "<all/>")
    want = sorted([("one", None), *((f"N{i}", f"\u00e9{'x' * (i % 97)}") for i in range(500))], key=str)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in (173, 1000, 1 << 20):
            for k, v in zip(before, (size, 1), strict=True):
                spark.conf.set(k, v)
            df = readers.trial_records(readers.trial_collection(spark, str(tmp_path / "t")), ["nct_id", "keyword"])
            assert sorted(((r.nct_id, r.keyword) for r in df.collect()), key=str) == want
            assert size > 1000 or df.rdd.getNumPartitions() > 20
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_judged(spark, tmp_path):
    q = readers.id_text(spark, write(tmp_path / "q.txt", "q1\twhat\tis\n"), "query_id")
    d = readers.id_text(spark, write(tmp_path / "d.txt", "d1\ttext\n"), "doc_id")
    rel = readers.qrels(spark, write(tmp_path / "r.txt", "q1 0 d1 1\nq1 0 d2 0\nq1 d1 2\n"))
    assert rel.count() == 2
    assert convert.retrieval(rel.distinct(), q, d).first().asDict() == {"question": "what\tis", "answer": "text"}


def test_split_and_tasks(spark, tmp_path):
    write(tmp_path / "t/test_x.csv", ",a\nN1,1\n")
    write(tmp_path / "t/test_y.csv", ",outcome\nN1,0\n")
    assert readers.split_pair(spark, str(tmp_path / "t")).first().asDict() == {"nctid": "N1", "a": "1", "outcome": "0"}
    e = readers.task_examples(spark.createDataFrame([("i", None, "L", 5)], "inputs string, id string, answer string, x int"), "study_design").first()
    assert (e.input, e.label, e.meta) == ("i", "L", '{"x":5}') and e.uid is not None


def test_register():
    pages = {"": {"studies": [1, 2], "nextPageToken": "t"}, "t": {"studies": [3]}}
    q = readers.RegisterQuery(lambda url: pages[url.partition("pageToken=")[2]], "http://x", {"A"})
    assert q.full("e", 3) == [1, 2, 3] and q.count("e") == 3
    for bad in (lambda: q.studies("e", ["B"]), lambda: q.studies("e", ["A"], 5000), lambda: q.full("e", 101)):
        with pytest.raises(ValueError):
            bad()


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", ["a"]), (2, None, None)], "k int, t string, l array<string>")
    writers.csv(df, str(tmp_path / "c"), single_file=True)
    assert readers.csv(spark, str(tmp_path / "c")).count() == 2
    writers.jsonl(df, str(tmp_path / "j"))
    assert "é" in "".join(p.read_text() for p in (tmp_path / "j").glob("*.json")) and readers.jsonl(spark, str(tmp_path / "j")).count() == 2
    writers.xml(df.select("k", "t"), str(tmp_path / "x"))
    assert "<Trial>" in "".join(p.read_text() for p in (tmp_path / "x").glob("part*"))
    writers.by_key(df.select("k", "t"), str(tmp_path / "b"), "k")
    assert (tmp_path / "b/k=1").is_dir()
    writers.parts(spark.range(10), str(tmp_path / "p"), 3, "id")
    assert (tmp_path / "p/part=2").is_dir()
    writers.documents(df.select(F.lit("{}").alias("document")), str(tmp_path / "d"))
    writers.report(df.select("k"), str(tmp_path / "r"))
    made = readers.cached(spark, str(tmp_path / "cache"), lambda: df.select("k"))
    assert made.count() == readers.cached(spark, str(tmp_path / "cache"), lambda: 1 / 0).count() == 2


def test_converters(spark):
    h = convert.hallmarks(spark.createDataFrame([("t", "[1 5]"), ("u", "[]")], "text string, label string")).collect()
    assert [(r.answer, r.answer_long) for r in h] == [("B, F", f"{HALLMARKS['B']}, {HALLMARKS['F']}"), ("A", HALLMARKS["A"])]
    n = convert.inference(spark.createDataFrame([("p", "c", "pos"), ("p", "c", "neg")], "supp_set string, conclusion string, label_cat string"))
    assert [r.answer for r in n.collect()] == ["True", "False"]
    o = convert.lettered_options(spark.createDataFrame([("q", "a", "b", None, "b")], "question string, choicesA string, choicesB string, choicesE string, answer_idx string")).first()
    assert (o.question, o.answer, o.answer_long) == ("q\nA) a\nB) b", "B", "B) b")
    schema = "document array<struct<type:string,text:string,entities:array<struct<type:string,text:array<string>>>,relations:array<struct<type:string>>>>"
    doc = [("title", "T", [("Chemical", ["c"]), ("Disease", ["d", "d"])], [("CID",)])]
    e = convert.entity_relations(spark.createDataFrame([(doc,), ([("abstract", "x", None, None)],)], schema)).collect()
    assert [r.answer for r in e] == ["Chemical: c; Disease: d", "CID"]
    assert convert.decisions(spark.createDataFrame([("q", "yes", None)], "QUESTION string, final_decision string, LONG_ANSWER string")).first().answer == "Yes"
    assert convert.summaries(spark.createDataFrame([("q", "s")], "CHQ string, Summary string")).count() == 1


def test_evaluation(spark):
    df = spark.createDataFrame([(1, "Q?\nA) x\nB) y", "A", "exam"), (2, "no options", "A", "exam"), (3, "Is it? yes/no/maybe", "no", "PubMedQA")], "row_id int, question string, answer string, dataset_name string")

    def make():
        def generate(asked):
            if any("Yes, No" in p for p in asked) and len(asked) > 1:
                raise RuntimeError("one bad batch")
            return ["No." if "Yes, No" in p else "The answer is A" for p in asked]

        return generate

    r = {x.question_id: x for x in evaluate.multiple_choice(df, make).collect()}
    assert set(r) == {1, 3} and r[1].correct and r[3].correct and (r[1].format, r[3].format) == ("letters", "three_way")
    o = evaluate.open_questions(df.limit(1), lambda: lambda asked: ["A"] * len(asked))
    assert evaluate.averages(evaluate.open_scores(o), ["exact_match", "f1", "bleu"]).first().exact_match == 1
    t = spark.createDataFrame([("N1", "x", 4.0)], "nctid string, criteria string, months double")
    out = evaluate.trial_task(t, lambda: lambda asked: ['{"value": 3}'] * len(asked), "duration", prompts.trial_prompt(t, "duration", ("months",)), "months").first()
    assert out.absolute_error == 1 and "months" not in out.prompt.split("Answer as")[0].split("Trial:")[1]


def test_group_pipeline(spark):
    data = [(i, f"question number {i} about {w}", f"answer {i} {w * 3}", "d1" if i % 2 else "d2", i % 2) for i, w in enumerate(["heart", "lung", "skin", "bone", "eye", "ear"])]
    data += [(10 + i, q, a, "d3", 0) for i, (_, q, a, _, _) in enumerate(data[:2])]
    df = pipelines.with_embeddings(spark.createDataFrame(data, "row_id long, question string, dedup_answer string, dataset_name string, quality int"))
    g = pipelines.Group("g", {"d1": 1, "d2": 0}, target=5)
    out = pipelines.group_pipeline([(g, df), (pipelines.Group("h", {}, target=3), df.withColumn("row_id", F.col("row_id") + 100))], 0.99)
    assert out["g"].count() == 5 and out["h"].count() == 3
    assert pipelines.group_statistics({"g": df}, {"g": out["g"]}).count() == 3


def test_registry(spark):
    t = lambda c: spark.createDataFrame([("N1", "x", 1), ("N1", "y", 2)], f"nct_id string, {c} string, id int")
    studies = spark.createDataFrame([("N1", "T", "Completed", 1), ("N2", "U", "Withheld", 2)], "nct_id string, brief_title string, overall_status string, id int")
    tables = {"brief_summaries": t("description"), "studies": studies, "interventions": t("name"), "conditions": t("name"), "keywords": t("name"), "design_outcomes": t("measure"), "eligibilities": t("criteria"), "study_references": t("citation")}
    out = pipelines.registry_table(tables).collect()
    assert len(out) == 1 and out[0].disease == "x, y" and out[0].title == "T"
    raw = spark.createDataFrame([("N1", "T", None, "inclusion\nA\nexclusion\nB", "c", "Completed"), ("N2", "U", "s", "", "c", "Recruiting")], "nct_id string, brief_title string, brief_summary string, eligibility_criteria string, condition string, overall_status string")
    r = pipelines.labelled_trials(raw).collect()
    assert len(r) == 1 and r[0].outcome == 1 and r[0].inclusion_criteria == ["a"] and r[0].brief_summary == "T. Condition: c"


def test_streams(spark, tmp_path):
    from millrace.streaming.episodes import binned, deduplicated

    ev = spark.createDataFrame([("a", "hr", 1.0, "2024-01-01 00:00:10"), ("a", "hr", 3.0, "2024-01-01 00:00:20"), ("a", "bp", 5.0, "2024-01-01 00:01:10")], "stay string, variable string, value double, t string").withColumn("charttime", F.to_timestamp("t")).drop("t")
    ev.write.parquet(str(tmp_path / "ev"))
    s = binned(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev")), "1 minute", "stay", ["hr", "bp"])
    q = s.writeStream.format("memory").queryName("bins").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.hr, r.bp) for r in spark.table("bins").fillna(-1.0).collect()) == [(-1.0, 5.0), (2.0, -1.0)]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0])], "row_id long, embedding array<double>")
    v.write.parquet(str(tmp_path / "v"))
    kept = []
    q = deduplicated(spark.readStream.schema(v.schema).parquet(str(tmp_path / "v")), str(tmp_path / "index"), lambda df, n: kept.extend(r.row_id for r in df.collect())).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(kept) == [1, 3]


def test_downloads(spark, tmp_path):
    import io
    import zipfile

    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a/x.txt", "one")
        z.writestr("../evil.txt", "no")
    pages = {"http://h/b.zip": held.getvalue(), "http://h/c.txt": b"two"}
    with pytest.warns(UserWarning, match="http://h/none"):
        found = readers.downloaded(spark, [*pages, "http://h/none"], str(tmp_path / "got"), lambda url: pages[url])
    assert found == [("http://h/b.zip", True), ("http://h/c.txt", True), ("http://h/none", False)]
    assert (tmp_path / "got/a/x.txt").read_text() == "one" and (tmp_path / "got/c.txt").read_text() == "two" and not (tmp_path / "evil.txt").exists()
    assert readers.manual(spark, "corpus", str(tmp_path / "got"), "http://h") == str(tmp_path / "got")
    with pytest.raises(FileNotFoundError, match="by hand from http://h"):
        readers.manual(spark, "corpus", str(tmp_path / "missing"), "http://h")


def test_register_requests():
    asked = []
    q = readers.RegisterQuery(lambda url: asked.append(url) or {"studies": [], "totalCount": 7, "apiVersion": "2"}, "http://x/")
    assert q.count("a b&c") == 7 and q.version()["apiVersion"] == "2"
    assert asked[0].startswith("http://x/studies?query.term=a%20b%26c&") and asked[1] == "http://x/version"


def test_xml_is_written_in_files_of_bounded_size(spark, tmp_path):
    """The XML source reads a file in one task, so many records are many files."""
    df = spark.range(95).select(F.format_string("Q%d", "id").alias("_qid"), F.lit(" a & b ").alias("Request")).coalesce(1)
    path = str(tmp_path / "notes")
    writers.xml(df, path, "all", "Question", records=10)
    assert len(list((tmp_path / "notes").glob("*.xml"))) == 10
    assert {(r.qid, r.question) for r in readers.annotated_questions(spark, path).collect()} == {(f"Q{i}", "a & b") for i in range(95)}
