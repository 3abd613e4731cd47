"""Pipelines: de-duplicating corpora one after another and in groups, and table builds of trials."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import citation_title, split_criteria, strip
from millrace.operators.clean import NONE, outcome, summary, validated
from millrace.operators.index import VectorIndex
from millrace.operators.relational import group_concat, outer_chain, union_all
from millrace.operators.sampling import balanced, presampled, recovered
from millrace.operators.similarity import Encoder, embedded, hash_encoder, qa_across, removed_in_order, within
from millrace.storage import materialise


@dataclass
class Group:
    """Datasets of a benchmark group with their quality; question_only compares questions alone."""

    name: str
    datasets: dict[str, int]
    question_only: bool = False
    target: int = 2500


#: The benchmark groups, in the order in which each is compared with those before (fixed values).
GROUPS = (
    Group("literature_mc", {"hoc": 0, "PubMedQA": 1}),
    Group("literature_open", {"NFCorpus": 0, "BioNLI": 0, "BC5CDR": 0}),
    Group("exam_mc", {"MedMCQA": 0, "JAMA": 1, "MedBullets5": 1, "MedBullets4": 1}, question_only=True),
    Group("exam_open", {"MedQA-USMLE": 1, "LiveQA": 1, "MedicationQA": 1, "MedQuAD": 1, "MeQSum": 1}),
)


def with_embeddings(df: DataFrame, make: Callable[[], Encoder] = hash_encoder) -> DataFrame:
    """question_embedding and answer_embedding of a question-answer table."""
    return embedded(embedded(df, F.col("question"), "question_embedding", make), F.col("dedup_answer"), "answer_embedding", make)


def removed_by_quality(df: DataFrame, vector: str, threshold: float, key: str = "row_id") -> DataFrame:
    """Greedy removal in order of quality (high first), then key."""
    return removed_in_order(df, vector, threshold, key, F.struct(-F.col("quality"), F.col(key)))


def within_group(df: DataFrame, threshold: float = 0.9, question_only: bool = False, key: str = "row_id", rescue: int = 10) -> DataFrame:
    """Questions, then answers of what is left; datasets that are lost altogether get a few rows back."""
    left = df.join(removed_by_quality(df, "question_embedding", threshold, key).withColumnRenamed("row_id", key), key, "left_anti")
    if not question_only:
        left = materialise(left, "left")
        left = left.join(removed_by_quality(left, "answer_embedding", threshold, key).withColumnRenamed("row_id", key), key, "left_anti")
    return recovered(df, left, "dataset_name", key, rescue)


def group_pipeline(groups: list[tuple[Group, DataFrame]], threshold: float = 0.9, key: str = "row_id") -> dict[str, DataFrame]:
    """Each group de-duplicated within itself and against the samples of all before, then sampled to its target."""
    out: dict[str, DataFrame] = {}
    before: DataFrame | None = None
    for group, rows in groups:
        kept = within_group(presampled(rows, key=key), threshold, group.question_only, key)
        if before is not None:
            kept, _ = qa_across(kept, before, threshold, key=key)
        final = materialise(balanced(kept, group.target, key=key), group.name)
        out[group.name] = final
        before = final if before is None else before.unionByName(final, allowMissingColumns=True)
    return out


def group_statistics(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """group, dataset_name, original, final, rate."""
    from millrace.operators.relational import retention

    return union_all([retention(before[g], after[g], "dataset_name").withColumn("group", F.lit(g)) for g in before])


def incremental(new: DataFrame, index_path: str, threshold: float = 0.9, key: str = "row_id", vector: str = "embedding", batch: int | None = None) -> DataFrame:
    """One more corpus: de-duplicated within itself, then against the saved index, to which what is left is added as its batch.

    A batch is compared with batches of smaller numbers only and replaces what was saved under its
    own number, so running it again, after a failure or not, gives the same rows. Without a number it
    comes after all saved ones. Of the index only the cells in reach of the new rows are read (see
    millrace/operators/index.py).
    """
    index = VectorIndex(new.sparkSession, index_path)
    number = batch if batch is not None else index.last() + 1
    if number <= index.settled():
        return materialise(new.join(index.rows(number).select(F.col("id").alias(key)), key, "left_semi").select(*new.columns), "kept")
    kept, _ = within(new, vector, threshold, key)
    kept = materialise(kept, "kept")
    gone = index.like(kept, number, threshold, key, vector)
    if gone is not None:
        kept = materialise(kept.join(gone, kept[key] == gone.row_id, "left_anti"), "kept")
    index.add(kept, number, key, vector)
    return kept


def registry_table(tables: dict[str, DataFrame], key: str = "nct_id", order: str = "id") -> DataFrame:
    """Study tables as one row a study: lists joined by `, `, full outer, nulls as `none`, withheld studies left out.

    tables: brief_summaries(description), studies(brief_title, overall_status), interventions(name),
    conditions(name), keywords(name), design_outcomes(measure), eligibilities(criteria), study_references(citation).
    """
    parts = {"brief_summaries": "description", "studies": "brief_title", "interventions": "name", "conditions": "name", "keywords": "name", "design_outcomes": "measure", "eligibilities": "criteria", "study_references": "citation"}
    names = {"brief_summaries": "description", "studies": "title", "interventions": "intervention", "conditions": "disease", "keywords": "keyword", "design_outcomes": "outcome_measure", "eligibilities": "criteria", "study_references": "reference"}
    lists = []
    for t, c in parts.items():
        rows = tables[t]
        if t == "study_references":
            rows = rows.withColumn(c, citation_title(F.col(c)))
        rows = rows if order in rows.columns else rows.withColumn(order, F.monotonically_increasing_id())
        lists.append(group_concat(rows, key, c, [order]).withColumnRenamed(c, names[t]))
    status = tables["studies"].groupBy(key).agg(F.min("overall_status").alias("overall_status"))
    out = outer_chain([*lists, status], key, NONE)
    out = out.withColumn("reference", F.when(strip("reference") == "", NONE).otherwise(F.col("reference")))
    return out.where("overall_status <> 'Withheld'")


def labelled_trials(trials: DataFrame, prefer_label: bool = True, drop_undefined: bool = True) -> DataFrame:
    """Validated trials with criteria lists, a summary and an outcome."""
    df = validated(trials, ["nct_id", "brief_title", "brief_summary", "eligibility_criteria", "condition", "overall_status"])
    df = df.withColumn("__c", split_criteria(F.col("eligibility_criteria")))
    df = df.withColumn("inclusion_criteria", F.col("__c.inclusion")).withColumn("exclusion_criteria", F.col("__c.exclusion")).drop("__c")
    detailed = F.col("detailed_description") if "detailed_description" in df.columns else F.lit(None).cast("string")
    df = df.withColumn("brief_summary", summary(F.col("brief_summary"), detailed, F.col("brief_title"), F.col("condition")))
    label = F.col("label") if prefer_label and "label" in df.columns else None
    df = df.withColumn("outcome", outcome(F.col("overall_status"), label))
    return df.where("outcome is not null") if drop_undefined else df


def trial_library_table(records: DataFrame) -> DataFrame:
    """Trial records under the names of the trial library: year, diseases, title, criteria and the rest."""
    year = F.year(F.coalesce(F.try_to_timestamp("start_date", F.lit("MMMM d, yyyy")), F.try_to_timestamp("start_date", F.lit("MMMM yyyy")), F.try_to_timestamp("start_date")))
    return records.select(
        F.col("nct_id").alias("nct_id"),
        F.col("brief_title").alias("title"),
        F.col("brief_summary").alias("description"),
        F.col("condition").alias("disease"),
        F.col("intervention_name").alias("intervention"),
        F.col("eligibility_criteria").alias("criteria"),
        F.col("keyword"),
        F.col("primary_outcome_measure").alias("outcome_measure"),
        F.col("study_status").alias("status"),
        F.col("phase"),
        year.alias("year"),
    )
