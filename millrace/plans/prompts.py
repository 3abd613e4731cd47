"""Prompts as column expressions. Wordings are templates of this library; pass others where scores must be compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.arrays import json_record
from millrace.functions.text import is_nullish, truncate

MC_TEMPLATE = "Answer this {domain} question with the letter of the best option only.\n\nQuestion: "
OPEN_TEMPLATE = "Answer this {domain} question briefly and precisely.\n\nQuestion: "


def mc_prompt(question: Column, options: Column, domain: str = "medical", dataset: Column | None = None) -> Column:
    """The question, its options unless they stand in it already, and what to answer with."""
    embedded = F.forall(F.map_values(options), lambda v: F.contains(question, v)) & (F.size(options) > 0)
    listed = F.array_join(F.transform(F.map_entries(options), lambda e: F.concat(e["key"], F.lit(") "), e["value"])), "\n")
    body = F.when(embedded, question).otherwise(F.concat(question, F.lit("\n"), listed))
    asked = F.concat(F.lit("\n\nOptions: "), F.array_join(F.map_keys(options), ", "), F.lit("\nAnswer:"))
    head = F.lit(MC_TEMPLATE.format(domain=domain))
    if dataset is not None:
        head = F.when(F.lower(dataset).contains("pubmedqa"), F.lit("Answer Yes, No or Maybe only.\n\nQuestion: ")).otherwise(head)
    return F.concat(head, body, asked)


def open_prompt(question: Column, domain: str = "medical") -> Column:
    return F.concat(F.lit(OPEN_TEMPLATE.format(domain=domain)), question, F.lit("\nAnswer:"))


#: Task to what is asked and the form of the answer.
TRIAL_TASKS = {
    "outcome": ("Will this trial succeed?", '{"prediction": "Successful" or "Failed"}'),
    "failure_reason": ("Why did this trial fail?", '{"prediction": "poor enrollment", "safety", "efficacy" or "Others"}'),
    "duration": ("How many months will this trial take?", '{"value": months}'),
    "duration_binary": ("Will this trial be long or short?", '{"prediction": "Long" or "Short"}'),
    "mortality": ("What will the mortality rate of this trial be?", '{"value": rate between 0 and 1}'),
    "mortality_binary": ("Will the mortality of this trial be high or low?", '{"prediction": "High" or "Low"}'),
    "dropout": ("What will the dropout rate of this trial be?", '{"value": rate between 0 and 1}'),
    "adverse_event": ("What will the rate of serious adverse events be?", '{"value": rate between 0 and 1}'),
    "dose": ("Which dose levels, 0 to 4, does this trial use?", '{"max_dose": level, "min_dose": level, "avg_dose": level}'),
    "survival": ("Will this patient survive the study?", '{"prediction": "Alive" or "Dead"}'),
}


def trial_prompt(df: DataFrame, task: str, leaks: tuple[str, ...] = (), simple: bool = False, criteria: str = "criteria", most: int = 2000) -> Column:
    """The record as JSON (or as lines, if simple) without the columns that give the answer away, long criteria cut."""
    asked, form = TRIAL_TASKS[task]
    names = [c for c in df.columns if c not in leaks]
    shown = [(truncate(F.col(c).cast("string"), most) if c == criteria else F.col(c)).alias(c) for c in names]
    if simple:
        body = F.concat_ws("\n", *(F.concat(F.lit(f"{n}: "), c.cast("string")) for n, c in zip(names, shown, strict=True)))
    else:
        body = F.to_json(F.struct(*shown), {"ignoreNullFields": "false"})
    return F.concat(F.lit(f"{asked}\n\nTrial:\n"), body, F.lit(f"\n\nAnswer as JSON: {form}"))


def titled_text(df: DataFrame, columns: list[str]) -> Column:
    """`Column name: value` lines of the columns that hold something."""
    return F.concat_ws("\n", *(F.when(~is_nullish(F.col(c).cast("string")), F.concat(F.lit(c.replace("_", " ").title() + ": "), F.col(c).cast("string"))) for c in columns if c in df.columns))


def with_llm_text(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumn("llm_text", titled_text(df, columns))


def prompt_dataset(df: DataFrame, instruction: str, columns: list[str], response: Column | None = None) -> DataFrame:
    """(prompt, response) of each row."""
    prompt = F.concat(F.lit(f"{instruction}\n\n"), titled_text(df, columns))
    return df.select(prompt.alias("prompt"), (response if response is not None else F.lit(None)).cast("string").alias("response"))


def outcome_dataset(trials: DataFrame, columns: list[str], outcome: str = "outcome") -> DataFrame:
    return prompt_dataset(trials, "Predict whether this trial succeeds.", columns, F.when(F.col(outcome) == 1, "Success").when(F.col(outcome) == 0, "Failure"))


def search_dataset(pairs: DataFrame, query: str, text: str, label: str) -> DataFrame:
    """Pairs of queries and trials as prompts, from relational.contained_pairs()."""
    prompt = F.concat(F.lit("Is this trial relevant to the query?\n\nQuery: "), F.col(query), F.lit("\nTrial: "), F.col(text))
    return pairs.select(prompt.alias("prompt"), F.when(F.col(label) == 1, "Relevant").otherwise("Not relevant").alias("response"))


def site_dataset(pairs: DataFrame, trial_text: str, site_text: str, enrollment: str | None = None) -> DataFrame:
    prompt = F.concat(F.lit("How well does this site suit the trial?\n\nTrial: "), F.col(trial_text), F.lit("\nSite: "), F.col(site_text))
    return pairs.select(prompt.alias("prompt"), (F.col(enrollment).cast("string") if enrollment else F.lit(None).cast("string")).alias("response"))


def patient_text(df: DataFrame, columns: list[str]) -> Column:
    return titled_text(df, columns)


def visits_text(visits: Column, kinds: list[str]) -> Column:
    """`Visit 1: diag: 3, 5; med: 7` lines of array<struct<kind: array>>."""
    one = lambda v: F.concat_ws("; ", *(F.concat(F.lit(f"{k}: "), F.array_join(F.transform(v[k], lambda x: x.cast("string")), ", ")) for k in kinds))
    return F.array_join(F.transform(visits, lambda v, i: F.concat(F.lit("Visit "), (i + 1).cast("string"), F.lit(": "), one(v))), "\n")


def match_prompt(patient: Column, inclusion: Column, exclusion: Column) -> Column:
    return F.concat(F.lit("Does this patient fit the trial?\n\nPatient:\n"), patient, F.lit("\n\nInclusion:\n"), inclusion, F.lit("\n\nExclusion:\n"), exclusion)


def simulation_prompt(history: Column) -> Column:
    return F.concat(F.lit("Continue this patient's record by one visit.\n\n"), history)


def json_prompt(*columns: str) -> Column:
    return json_record(*columns)
