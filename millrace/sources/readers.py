"""Readers: tables, lines, JSON, XML, judged retrieval, trial registers, records with several shapes."""

from __future__ import annotations

import ast
import io
import json
import re
import warnings
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import quote
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import nullish_to_null, strip

SUFFIX_FORMATS = {"csv": "csv", "tsv": "csv", "txt": "text", "json": "json", "jsonl": "json", "xml": "text", "parquet": "parquet"}


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def missing_inputs(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths that aren't there."""
    return [p for p in paths if not exists(spark, p)]


def resolve_csv(spark: SparkSession, path: str) -> str:
    """The path itself, or with .csv or .csv.gz; an error if there is none or several."""
    found = [p for p in (path, f"{path}.csv", f"{path}.csv.gz") if exists(spark, p)]
    if len(found) != 1:
        raise FileNotFoundError(f"{path}: {'ambiguous: ' + ', '.join(found) if found else 'no such table'}")
    return found[0]


def directory(spark: SparkSession, path: str, suffix: str = "csv", schema: str | None = None) -> DataFrame:
    """All files of a suffix below a folder, with their path in `file_path`."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{suffix}")
    if schema:
        reader = reader.schema(schema)
    kind = SUFFIX_FORMATS[suffix]
    if kind == "csv":
        reader = reader.option("header", "true").option("multiLine", "true").option("escape", '"').option("sep", "\t" if suffix == "tsv" else ",")
    elif suffix == "json":
        reader = reader.option("multiLine", "true")
    elif suffix == "xml":
        reader = reader.option("wholetext", "true")
    return reader.format(kind).load(path).withColumn("file_path", F.col("_metadata.file_path"))


def csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",", header: bool = True, lower: bool = False, columns: list[str] | None = None, encoding: str = "UTF-8") -> DataFrame:
    """Delimited text with quoted line breaks; texts unless a schema is given. sep: `,`, tab or `|`."""
    reader = spark.read.option("header", str(header).lower()).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", "true").option("encoding", encoding)
    df = (reader.schema(schema) if schema else reader).csv(path)
    if lower:
        df = df.toDF(*(c.lower() for c in df.columns))
    return df.select(*columns) if columns else df


def tsv(spark: SparkSession, path: str, **kw) -> DataFrame:
    return csv(spark, path, sep="\t", **kw)


def pipes(spark: SparkSession, path: str, **kw) -> DataFrame:
    return csv(spark, path, sep="|", **kw)


def positional_csv(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Columns by place, whatever the header calls them."""
    df = csv(spark, path)
    return df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names, strict=False)))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines that aren't blank."""
    return spark.read.text(path).select(strip("value").alias("value")).where("value <> ''")


def jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def json_documents(spark: SparkSession, path: str, unwrap: str = "studies") -> DataFrame:
    """Whole JSON documents; a list under the key unwrap becomes rows."""
    df = spark.read.option("multiLine", "true").json(path)
    return df.select(F.explode(unwrap).alias("__r")).select("__r.*") if unwrap in df.columns else df


def keyed_json(spark: SparkSession, path: str, record: str, key: str = "id") -> DataFrame:
    """`{id: record}` as rows; record: the DDL of a record."""
    kind = T.MapType(T.StringType(), T.StructType.fromDDL(record))
    parsed = spark.read.option("wholetext", "true").text(path).select(F.from_json("value", kind).alias("m"))
    return parsed.select(F.explode("m").alias(key, "__r")).select(key, "__r.*")


def flattened(df: DataFrame, separator: str = ".") -> DataFrame:
    """Nested structs as columns with joined names."""

    def walk(schema: T.StructType, prefix: tuple[str, ...]) -> Iterator[Column]:
        for f in schema.fields:
            path = (*prefix, f.name)
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, path)
            else:
                yield F.col(".".join(f"`{p}`" for p in path)).alias(separator.join(path))

    return df.select(*walk(df.schema, ()))


def python_literals(df: DataFrame, text: str, schema: str) -> DataFrame:
    """Lines that hold Python or JSON literals of lists of documents, as rows of the schema; lines that are neither are skipped."""

    @F.pandas_udf("string")
    def as_json(values: pd.Series) -> pd.Series:
        def one(v: str | None) -> str | None:
            for read in (ast.literal_eval, json.loads):
                try:
                    return json.dumps(read(v))
                except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
                    continue
            return None

        return values.map(one)

    parsed = df.select(F.from_json(as_json(F.col(text)), T.ArrayType(T.StructType.fromDDL(schema))).alias("__a"))
    return parsed.select(F.explode("__a").alias("__r")).select("__r.*")


# --- XML ---------------------------------------------------------------------------------------

#: Field to path in a trial record (fixed values).
TRIAL_FIELDS = {
    "nct_id": "nct_id",
    "brief_title": "brief_title",
    "official_title": "official_title",
    "brief_summary": "brief_summary/textblock",
    "detailed_description": "detailed_description/textblock",
    "study_type": "study_type",
    "phase": "phase",
    "study_status": "overall_status",
    "enrollment": "enrollment",
    "start_date": "start_date",
    "completion_date": "completion_date",
    "primary_completion_date": "primary_completion_date",
    "allocation": "study_design_info/allocation",
    "intervention_model": "study_design_info/intervention_model",
    "primary_purpose": "study_design_info/primary_purpose",
    "masking": "study_design_info/masking",
    "condition": "condition",
    "intervention_type": "intervention/intervention_type",
    "intervention_name": "intervention/intervention_name",
    "eligibility_criteria": "eligibility/criteria/textblock",
    "gender": "eligibility/gender",
    "minimum_age": "eligibility/minimum_age",
    "maximum_age": "eligibility/maximum_age",
    "healthy_volunteers": "eligibility/healthy_volunteers",
    "primary_outcome_measure": "primary_outcome/measure",
    "primary_outcome_timeframe": "primary_outcome/time_frame",
    "secondary_outcome_measure": "secondary_outcome/measure",
    "secondary_outcome_timeframe": "secondary_outcome/time_frame",
    "overall_official_name": "overall_official/last_name",
    "overall_official_role": "overall_official/role",
    "overall_official_affiliation": "overall_official/affiliation",
    "lead_sponsor_name": "sponsors/lead_sponsor/agency",
    "lead_sponsor_class": "sponsors/lead_sponsor/agency_class",
    "location_facility": "location/facility/name",
    "location_city": "location/facility/address/city",
    "location_state": "location/facility/address/state",
    "location_country": "location/facility/address/country",
    "arm_group_label": "arm_group/arm_group_label",
    "arm_group_type": "arm_group/arm_group_type",
    "arm_group_description": "arm_group/description",
    "keyword": "keyword",
    "mesh_term": "mesh_term",
    "org_study_id": "org_study_id",
    "secondary_id": "secondary_id",
    "verification_date": "verification_date",
    "study_first_submitted": "study_first_submitted",
    "study_first_posted": "study_first_posted",
    "last_update_posted": "last_update_posted",
    "has_expanded_access": "has_expanded_access",
    "has_results": "has_results",
}


_XML_SPACES = re.compile(r"[ \t\n\x0b\f\r]+")


def xml_files(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: file_path, value (the whole text)."""
    return directory(spark, path, "xml")


def trial_collection(spark: SparkSession, path: str, files: str = "*.xml", tag: str = "clinical_study") -> DataFrame:
    """One row a record of files that hold many: file_path, value (the text of one element `tag`).

    Files are cut at the closing tag, so one large file is read by many tasks and no task holds more than a record at a time
    (compressed files are one task each). Text outside the elements is left out, and an element that is cut off at the end of its
    file is closed there. The closing tag must not stand in a comment or a CDATA section.
    """
    closed = f"</{tag}>"
    pieces = spark.read.option("lineSep", closed).option("recursiveFileLookup", "true").option("pathGlobFilter", files).text(path)
    record = F.regexp_extract("value", rf"(?s)<{tag}[\s>].*", 0)
    return pieces.select(F.col("_metadata.file_path").alias("file_path"), record.alias("value")).where("value <> ''").withColumn("value", F.concat("value", F.lit(closed)))


def _text_finder(paths: dict[str, str]) -> Callable[[str | None], dict[str, list[str]]]:
    """Texts of the elements at each path, at any depth, from one pass over a document; nothing of a text that isn't XML."""
    by_tag: dict[str, list[tuple[str, list[str]]]] = {}
    for field, path in paths.items():
        steps = path.split("/")
        by_tag.setdefault(steps[-1], []).append((field, steps))

    def find(text: str | None) -> dict[str, list[str]]:
        found: dict[str, list[str]] = {}
        above: list[str] = []
        wanted: list[list[str]] = [[]]
        pending: list[str] = []

        def flush(*_: object) -> None:
            if pending:
                value = _XML_SPACES.sub(" ", "".join(pending)).strip()
                pending.clear()
                if value:
                    for field in wanted[-1]:
                        found.setdefault(field, []).append(value)

        def start(tag: str, _: object) -> None:
            flush()
            above.append(tag)
            wanted.append([field for field, steps in by_tag.get(tag, ()) if above[-len(steps) :] == steps])

        def end(_: str) -> None:
            flush()
            above.pop()
            wanted.pop()

        def said(data: str) -> None:
            if wanted[-1]:
                pending.append(data)

        parser = expat.ParserCreate("utf-8")
        parser.buffer_text = True
        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, said
        parser.CommentHandler = parser.ProcessingInstructionHandler = flush
        try:
            parser.Parse((text or "").strip().encode("utf-8", "replace"), True)
        except expat.ExpatError:
            return {}
        return found

    return find


def trial_records(files: DataFrame, fields: list[str] | None = None, xml: str = "value") -> DataFrame:
    """Trial fields of XML texts, null where absent, repeated ones as `a, b`; only the asked fields are looked up, and unknown ones are left out with a warning.

    A document is parsed once for all fields, in a stream of elements, so nothing but the asked texts is held. A null, an empty
    text and a text that isn't well-formed XML give nulls; rows are neither dropped nor merged.
    """
    unknown = [f for f in fields or () if f not in TRIAL_FIELDS]
    if unknown:
        warnings.warn(f"unknown fields: {', '.join(unknown)}", stacklevel=2)
    chosen = [f for f in fields if f in TRIAL_FIELDS] if fields else list(TRIAL_FIELDS)
    kept = [F.col(f"`{c}`") for c in files.columns if c != xml]
    if not chosen:
        return files.select(*kept)

    @F.pandas_udf(T.StructType([T.StructField(f, T.StringType()) for f in chosen]))
    def run(texts: pd.Series) -> pd.DataFrame:
        find = _text_finder({f: TRIAL_FIELDS[f] for f in chosen})
        rows = [[", ".join(found[f]) if f in found else None for f in chosen] for found in map(find, texts)]
        return pd.DataFrame(rows, columns=chosen, dtype=object)

    return files.select(*kept, run(F.col(f"`{xml}`")).alias("__r")).select(*kept, "__r.*")


def other_fields(files: DataFrame, xml: str = "value") -> Column:
    """map<string,string> of the root's direct children that TRIAL_FIELDS doesn't cover, under snake-case names; null if the text isn't XML.

    Names are not known beforehand, which no path expression can express, so this parses in Python.
    """
    import xml.etree.ElementTree as ET

    from millrace.functions.text import camel_to_snake

    known = {*TRIAL_FIELDS, *(path.partition("/")[0] for path in TRIAL_FIELDS.values())}

    @F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> dict[str, str] | None:
            try:
                root = ET.fromstring(text or "")
            except ET.ParseError:
                return None
            found: dict[str, list[str]] = {}
            for child in root:
                name, value = camel_to_snake(child.tag), " ".join("".join(child.itertext()).split())
                if name not in known and value:
                    found.setdefault(name, []).append(value)
            return {k: ", ".join(v) for k, v in found.items()}

        return texts.map(one)

    return run(files[xml])


def _rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").schema(schema).load(path)


def sentences(spark: SparkSession, path: str) -> DataFrame:
    """(sentence_id, sentence_text) from attributes of sentence elements."""
    df = _rows(spark, path, "sentence", "_id string, _text string")
    return df.select(F.col("_id").alias("sentence_id"), F.col("_text").alias("sentence_text"))


_LIST = "array<string>"


def qa_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row a question-answer pair of document XML, with the document's own fields."""
    pair = "array<struct<_pid:string,Question:struct<_VALUE:string,_qid:string,_qtype:string>,Answer:string>>"
    schema = f"_id string, _source string, _url string, Focus string, FocusAnnotations struct<UMLS:struct<CUIs:struct<CUI:{_LIST}>,SemanticTypes:struct<SemanticType:{_LIST}>,SemanticGroup:string>>, QAPairs struct<QAPair:{pair}>"
    df = _rows(spark, path, "Document", schema).select("*", F.explode_outer("QAPairs.QAPair").alias("pair"))
    return df.select(
        F.col("_id").alias("doc_id"),
        F.col("_source").alias("source"),
        F.col("_url").alias("url"),
        strip("Focus").alias("focus"),
        F.col("FocusAnnotations.UMLS.CUIs.CUI").alias("umls_cuis"),
        F.col("FocusAnnotations.UMLS.SemanticTypes.SemanticType").alias("semantic_types"),
        F.col("FocusAnnotations.UMLS.SemanticGroup").alias("semantic_group"),
        F.col("pair._pid").alias("pid"),
        F.col("pair.Question._qid").alias("question_id"),
        F.col("pair.Question._qtype").alias("question_type"),
        strip("pair.Question._VALUE").alias("question_text"),
        strip("pair.Answer").alias("answer_text"),
    )


def live_questions(spark: SparkSession, path: str) -> DataFrame:
    """One row a sub-question: qid, subject, question, focus, type, answers."""
    answer = "array<struct<_VALUE:string,_answerid:string>>"
    sub = f"array<struct<_subqid:string,ANNOTATIONS:struct<FOCUS:string,TYPE:string>,ANSWERS:struct<ANSWER:{answer}>>>"
    df = _rows(spark, path, "NLM-QUESTION", f"_questionid string, SUBJECT string, MESSAGE string, `SUB-QUESTIONS` struct<`SUB-QUESTION`:{sub}>")
    df = df.select("*", F.explode_outer("SUB-QUESTIONS.SUB-QUESTION").alias("s"))
    return df.select(
        F.col("_questionid").alias("qid"),
        strip("SUBJECT").alias("subject"),
        strip("MESSAGE").alias("question"),
        strip("s.ANNOTATIONS.FOCUS").alias("focus"),
        strip("s.ANNOTATIONS.TYPE").alias("type"),
        F.transform("s.ANSWERS.ANSWER", lambda a: strip(a["_VALUE"])).alias("answers"),
    )


def live_questions_test(files: DataFrame, xml: str = "value") -> DataFrame:
    """As live_questions() for the test layout: answers are reference answers of either spelling, with the text of inner elements."""
    parts = F.regexp_extract_all(F.col(xml), F.lit(r"(?s)<NLM-QUESTION\b.*?</NLM-QUESTION>"), F.lit(0))
    q = files.select(F.explode(parts).alias("q"))
    inner = lambda tag: F.transform(F.regexp_extract_all("q", F.lit(rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1)), lambda x: strip(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), r"\s+", " ")))
    text = lambda tag: F.get(inner(tag), F.lit(0))
    first, other = inner("RefAnswer"), inner("ReferenceAnswer")
    return q.select(
        F.regexp_extract("q", r'<NLM-QUESTION[^>]*\bq(?:uestion)?id="([^"]*)"', 1).alias("qid"),
        text("SUBJECT").alias("subject"),
        F.coalesce(text("MESSAGE"), text("NLM-Summary")).alias("question"),
        text("FOCUS").alias("focus"),
        text("TYPE").alias("type"),
        F.when(F.size(first) > 0, first).otherwise(other).alias("answers"),
    )


def annotated_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions with arrays of annotations: question, focuses and sub-questions as structs."""
    focus = "array<struct<_fid:string,_fcategory:string,_VALUE:string>>"
    sub = "array<struct<_id:string,_qt:string,_VALUE:string>>"
    df = _rows(spark, path, "Question", f"_qid string, Request string, Focuses struct<Focus:{focus}>, Decomposition struct<SubQuestion:{sub}>")
    return df.select(
        F.col("_qid").alias("qid"),
        strip("Request").alias("question"),
        F.transform("Focuses.Focus", lambda x: F.struct(x["_fid"].alias("fid"), x["_fcategory"].alias("fcategory"), strip(x["_VALUE"]).alias("text"))).alias("focuses"),
        F.transform("Decomposition.SubQuestion", lambda x: F.struct(x["_id"].alias("id"), x["_qt"].alias("type"), strip(x["_VALUE"]).alias("text"))).alias("sub_questions"),
    )


# --- judged retrieval -----------------------------------------------------------------------------


def id_text(spark: SparkSession, path: str, key: str) -> DataFrame:
    """`id<TAB>text` lines, cut at the first tab."""
    cut = F.split("value", "\t", 2)
    return spark.read.text(path).where(F.contains(F.col("value"), F.lit("\t"))).select(strip(cut[0]).alias(key), strip(cut[1]).alias("text"))


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id) of judgments above 0, from lines of three or four fields."""
    f = F.split(strip("value"), r"\s+")
    wide = F.size(f) >= 4
    rel = F.when(wide, F.get(f, F.lit(3))).otherwise(F.get(f, F.lit(2))).try_cast("int")
    doc = F.when(wide, F.get(f, F.lit(2))).otherwise(F.get(f, F.lit(1)))
    return spark.read.text(path).where(F.size(f) >= 3).select(F.get(f, F.lit(0)).alias("query_id"), doc.alias("doc_id"), rel.alias("rel")).where("rel > 0").drop("rel")


# --- tables that come in pairs, and tasks ------------------------------------------------------------


def split_pair(spark: SparkSession, folder: str, phase: str = "test", key: str = "nctid") -> DataFrame:
    """`<phase>_x` and `<phase>_y` joined on their first columns."""
    sides = []
    for side in ("x", "y"):
        df = csv(spark, resolve_csv(spark, f"{folder}/{phase}_{side}"))
        sides.append(df.withColumnRenamed(df.columns[0], key))
    return sides[0].join(sides[1].select(key, *(c for c in sides[1].columns if c not in sides[0].columns)), key)


#: Task to the keys that may hold its input, its label and its id, first found counts (fixed values).
TASK_KEYS = {
    "patient_trial_matching": (("inputs", "input", "context", "question"), ("label", "labels", "answer"), ("id", "uid", "patient_id")),
    "trial_search": (("inputs", "question", "query"), ("labels", "label", "answer"), ("id", "uid", "query_id")),
    "trial_summarization": (("inputs", "context", "input"), ("answer", "labels", "label"), ("id", "uid", "nct_id")),
    "study_design": (("question", "inputs", "context"), ("answer", "label", "labels"), ("id", "uid")),
    "sample_size": (("inputs", "question", "context"), ("answer", "label", "labels"), ("id", "uid")),
    "completion_assessment": (("inputs", "question", "context"), ("label", "answer", "labels"), ("id", "uid")),
    "arm_design": (("question", "inputs", "context"), ("answer", "label", "labels"), ("id", "uid")),
    "endpoint_design": (("question", "inputs", "context"), ("answer", "label", "labels"), ("id", "uid")),
}


def task_examples(df: DataFrame, task: str) -> DataFrame:
    """(uid, task, input, label, meta) of a task's records; uid falls back to the row's number."""
    inputs, labels, keys = TASK_KEYS.get(task, (("inputs", "input", "question"), ("label", "labels", "answer"), ("id", "uid")))
    as_text = lambda c: F.col(c).cast("string") if dict(df.dtypes)[c] == "string" or not dict(df.dtypes)[c].startswith(("array", "struct", "map")) else F.to_json(c)
    pick = lambda names: F.coalesce(*(nullish_to_null(as_text(n)) for n in names if n in df.columns), F.lit(None).cast("string"))
    used = {*inputs, *labels, *keys}
    rest = [c for c in df.columns if c not in used]
    numbered = df.withColumn("__n", F.monotonically_increasing_id())
    return numbered.select(
        F.coalesce(pick(keys), F.col("__n").cast("string")).alias("uid"),
        F.lit(task).alias("task"),
        pick(inputs).alias("input"),
        pick(labels).alias("label"),
        (F.to_json(F.struct(*rest)) if rest else F.lit("{}")).alias("meta"),
    )


def visits_json(spark: SparkSession, path: str) -> DataFrame:
    """`{subject: [[codes, ...], ...]}` or lists of visits: (subject, visits: array<array<int>>)."""
    kind = T.MapType(T.StringType(), T.ArrayType(T.ArrayType(T.IntegerType())))
    parsed = spark.read.option("wholetext", "true").text(path).select(F.from_json("value", kind).alias("m"))
    return parsed.select(F.explode("m").alias("subject", "visits"))


def from_pandas(spark: SparkSession, path: str, kind: str, **kw) -> DataFrame:
    """Excel and SAS files, which Spark has no reader for: read by pandas on the driver, so only for files that fit there."""
    frame = {"excel": pd.read_excel, "sas": pd.read_sas}[kind](path, **kw)
    for c in frame.columns:
        if frame[c].dtype == object:
            frame[c] = frame[c].map(lambda v: v.decode("utf-8", "replace") if isinstance(v, bytes) else v)
    return spark.createDataFrame(frame)


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The Parquet table at the path, made and written first if it isn't there: embeddings and other costly results."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


# --- trial register queries -----------------------------------------------------------------------------


class RegisterQuery:
    """The contract of a trial register's REST source: validated requests, paged by token, over a given fetch(url) -> dict.

    There is no network here, so fetch has no default; rows become a DataFrame on the driver.
    """

    def __init__(self, fetch, base: str, known_fields: set[str] | None = None, most_fields: int = 1000, most_full: int = 100):
        self.fetch, self.base, self.known, self.most_fields, self.most_full = fetch, base.rstrip("/"), known_fields, most_fields, most_full

    def _pages(self, url: str, most: int) -> Iterator[dict]:
        token, n = None, 0
        while n < most:
            page = self.fetch(f"{url}&pageToken={token}" if token else url)
            for study in page.get("studies", []):
                if n < most:
                    n += 1
                    yield study
            token = page.get("nextPageToken")
            if not token:
                return

    def studies(self, expression: str, fields: list[str], most: int = 50) -> list[dict]:
        if not 1 <= most <= self.most_fields:
            raise ValueError(f"between 1 and {self.most_fields} studies, not {most}")
        if self.known is not None and (bad := set(fields) - self.known):
            raise ValueError(f"unknown fields: {', '.join(sorted(bad))}")
        return list(self._pages(f"{self.base}/studies?query.term={quote(expression)}&fields={'|'.join(fields)}&pageSize={most}", most))

    def full(self, expression: str, most: int = 50) -> list[dict]:
        if not 1 <= most <= self.most_full:
            raise ValueError(f"between 1 and {self.most_full} studies, not {most}")
        return list(self._pages(f"{self.base}/studies?query.term={quote(expression)}&pageSize={most}", most))

    def count(self, expression: str) -> int:
        page = self.fetch(f"{self.base}/studies?query.term={quote(expression)}&countTotal=true&pageSize=1")
        return page["totalCount"] if "totalCount" in page else sum(1 for _ in self._pages(f"{self.base}/studies?query.term={quote(expression)}&pageSize=1000", 1 << 62))

    def version(self) -> dict:
        return self.fetch(f"{self.base}/version")


# --- downloads ---------------------------------------------------------------------------------------------


def downloaded(spark: SparkSession, urls: list[str], folder: str, fetch) -> list[tuple[str, bool]]:
    """(url, success) of each: fetch(url) gives its bytes, which are put into the folder, the members of a zip archive each by itself.

    There is no network here, so fetch has no default. One failure doesn't stop the others.
    """
    out = []
    for url in urls:
        try:
            data = fetch(url)
            files = {url.rstrip("/").rpartition("/")[2]: data}
            if zipfile.is_zipfile(io.BytesIO(data)):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    files = {n: z.read(n) for n in z.namelist() if not n.endswith("/") and ".." not in n.split("/")}
            for name, content in files.items():
                fs, path = _hadoop(spark, f"{folder}/{name}")
                stream = fs.create(path, True)
                stream.write(bytearray(content))
                stream.close()
            out.append((url, True))
        except Exception as error:  # any failure of a source is a line of the report
            warnings.warn(f"{url}: {error}", stacklevel=2)
            out.append((url, False))
    return out


def manual(spark: SparkSession, name: str, path: str, where: str) -> str:
    """The path of a corpus that must be downloaded by hand; an error that says from where if it isn't there."""
    if not exists(spark, path):
        raise FileNotFoundError(f"{name} must be downloaded by hand from {where} to {path}")
    return path
