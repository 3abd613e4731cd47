"""Evaluation: prompts to a generator, answers out of responses, scores.

The generator is any callable from a list of prompts to a list of texts; generated() runs it in
the workers, batch by batch. All before and after is column expressions, so stored responses can
be scored again without Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.overlap import bleu, entity_f1, rouge, similarity, token_f1
from millrace.functions.parse import extract_answer, parse_alive_dead, parse_doses, parse_failure_reason, parse_high_low, parse_long_short, parse_number, parse_options, parse_outcome
from millrace.functions.text import exact_match, is_nullish, strip
from millrace.operators.metrics import answer_format
from millrace.plans.prompts import mc_prompt, open_prompt

Generator = Callable[[list[str]], list[str]]


def generated(df: DataFrame, prompt: str, make: Callable[[], Generator], name: str = "raw_response", batch: int = 64) -> DataFrame:
    """df with the generator's texts, null where it fails. It is made once in each worker."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        generate = make()

        def safe(prompts: list[str]) -> list[str | None]:
            try:
                return list(generate(prompts))
            except Exception:  # one bad prompt must not lose its batch
                if len(prompts) == 1:
                    return [None]
                return [x for p in prompts for x in safe([p])]

        for part in parts:
            texts = part.tolist()
            yield pd.Series([x for i in range(0, len(texts), batch) for x in safe(texts[i : i + batch])], dtype=object)

    return df.withColumn(name, run(prompt))


def multiple_choice(df: DataFrame, make: Callable[[], Generator], question: str = "question", answer: str = "answer", dataset: str = "dataset_name", key: str = "row_id", domain: str = "medical") -> DataFrame:
    """question_id, question, options, ground_truth, predicted, correct, raw_response; rows without options are left out, failed ones count as wrong."""
    rows = df.withColumn("options", parse_options(F.col(question))).where(F.size("options") > 0)
    rows = generated(rows.withColumn("prompt", mc_prompt(F.col(question), F.col("options"), domain, F.col(dataset))), "prompt", make)
    predicted = extract_answer(F.col("raw_response"), F.map_keys("options"), F.col(dataset))
    rows = rows.withColumn("predicted", predicted)
    correct = F.coalesce(F.lower("predicted") == F.lower(strip(answer)), F.lit(False))
    return rows.select(F.col(key).alias("question_id"), F.col(question).alias("question"), "options", F.col(answer).alias("ground_truth"), "predicted", correct.alias("correct"), "raw_response", answer_format(F.col("options")).alias("format"))


def open_questions(df: DataFrame, make: Callable[[], Generator], question: str = "question", answer: str = "answer", key: str = "row_id", domain: str = "medical") -> DataFrame:
    rows = generated(df.withColumn("prompt", open_prompt(F.col(question), domain)), "prompt", make, "generated_answer")
    return rows.select(F.col(key).alias("question_id"), F.col(question).alias("question"), F.col(answer).alias("ground_truth"), "generated_answer", "prompt", F.col("generated_answer").isNull().alias("error"))


def open_scores(results: DataFrame, truth: str = "ground_truth", answer: str = "generated_answer", cosine: Column | None = None) -> DataFrame:
    """Scores of each pair; rows where either side is empty are left out."""
    rows = results.where(~is_nullish(F.col(truth)) & ~is_nullish(F.col(answer)))
    rows = rows.withColumn("__r", rouge(answer, truth))
    more = [similarity(cosine).alias("similarity")] if cosine is not None else []
    return rows.select(*results.columns, exact_match(F.col(answer), F.col(truth)).cast("double").alias("exact_match"), token_f1(F.col(answer), F.col(truth)).alias("f1"), bleu(answer, truth).alias("bleu"), "__r.rouge1", "__r.rouge2", "__r.rougeL", entity_f1(answer, truth).alias("entity_f1"), *more)


def averages(scores: DataFrame, metrics: list[str], by: list[str] | None = None) -> DataFrame:
    """Means; missing scores don't count."""
    return scores.groupBy(*(by or [])).agg(F.count("*").alias("evaluated"), *(F.avg(m).alias(m) for m in metrics))


#: Task to the parser of its responses.
PARSERS: dict[str, Callable[[Column], Column]] = {
    "outcome": parse_outcome,
    "failure_reason": parse_failure_reason,
    "duration": parse_number,
    "duration_binary": parse_long_short,
    "mortality": parse_number,
    "mortality_binary": parse_high_low,
    "dropout": parse_number,
    "adverse_event": parse_number,
    "dose": parse_doses,
    "survival": parse_alive_dead,
}


def trial_task(df: DataFrame, make: Callable[[], Generator], task: str, prompt: Column, truth: str, key: str = "nctid") -> DataFrame:
    """trial_id, task, prompt, raw_llm_output, parsed_prediction, ground_truth, and correct, or the absolute and squared error for numbers."""
    rows = generated(df.withColumn("prompt", prompt), "prompt", make, "raw_llm_output").withColumn("parsed_prediction", PARSERS[task](F.col("raw_llm_output")))
    base = [F.col(key).alias("trial_id"), F.lit(task).alias("task"), "prompt", "raw_llm_output", "parsed_prediction", F.col(truth).alias("ground_truth")]
    if PARSERS[task] is parse_number:
        e = F.col("parsed_prediction") - F.col(truth)
        return rows.select(*base, F.abs(e).alias("absolute_error"), (e * e).alias("squared_error"))
    return rows.select(*base, F.coalesce(F.col("parsed_prediction") == F.col(truth), F.lit(False)).alias("correct"))
