"""Converters of question-answer corpora to one table (question, answer, answer_long)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import HALLMARKS, decision_answer, is_nullish, label_letters, label_numbers, option_letter, strip
from millrace.operators.clean import drop_blank
from millrace.operators.relational import judged


def options_text(options: list[tuple[str, Column]]) -> Column:
    """`A) text` lines of the options that hold something."""
    return F.concat_ws("\n", *(F.when(~is_nullish(c), F.concat(F.lit(f"{letter}) "), c)) for letter, c in options))


def passthrough(df: DataFrame, question: str, answer: str) -> DataFrame:
    return drop_blank(df.select(F.col(question).alias("question"), F.col(answer).alias("answer")), ["question", "answer"])


def decisions(df: DataFrame, question: str = "QUESTION", decision: str = "final_decision", reason: str = "LONG_ANSWER") -> DataFrame:
    """Yes, no or maybe questions, with the reason in the long answer."""
    why = F.col(reason) if reason in df.columns else F.lit(None).cast("string")
    out = df.select(F.col(question).alias("question"), decision_answer(F.col(decision)).alias("answer"), decision_answer(F.col(decision), why).alias("answer_long"))
    return drop_blank(out, ["question", "answer"])


def four_options(df: DataFrame, question: str = "question", options: tuple[str, ...] = ("opa", "opb", "opc", "opd"), code: str = "cop", reason: str = "exp") -> DataFrame:
    """Options A to D by code 1 to 4; the long answer names the option, and the reason if there is one."""
    letter = option_letter(F.col(code))
    chosen = F.get(F.array(*options), (F.col(code) - 1).cast("int"))
    named = F.concat(letter, F.lit(") "), chosen)
    text = F.concat(F.col(question), F.lit("\n"), options_text(list(zip("ABCD", map(F.col, options), strict=True))))
    long = F.when(is_nullish(F.col(reason)), named).otherwise(F.concat(named, F.lit(". "), F.col(reason))) if reason in df.columns else named
    return df.where(letter.isNotNull()).select(text.alias("question"), letter.alias("answer"), long.alias("answer_long"))


def lettered_options(df: DataFrame, question: str = "question", prefix: str = "choices", letter: str = "answer_idx") -> DataFrame:
    """Four or five options in columns `<prefix>A` and on; an empty fifth is left out."""
    letters = [x for x in "ABCDE" if f"{prefix}{x}" in df.columns]
    chosen = F.coalesce(*(F.when(F.upper(strip(letter)) == x, F.col(f"{prefix}{x}")) for x in letters))
    text = F.concat(F.col(question), F.lit("\n"), options_text([(x, F.col(f"{prefix}{x}")) for x in letters]))
    out = df.select(text.alias("question"), F.upper(strip(letter)).alias("answer"), F.concat(F.upper(strip(letter)), F.lit(") "), chosen).alias("answer_long"))
    return out.where(F.col("answer_long").isNotNull())


def hallmarks(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Sentences with a label list `[1 5]` as questions with options A to K."""
    table = F.array(*(F.lit(v) for v in HALLMARKS.values()))
    numbers = F.array_sort(F.array_distinct(label_numbers(F.col(label))))
    chosen = F.when(F.size(numbers) == 0, F.array(F.lit(0))).otherwise(numbers)
    names = F.array_join(F.transform(chosen, lambda i: F.get(table, i)), ", ")
    ask = F.concat(F.lit("Which cancer hallmarks does this text describe?\n"), F.col(text), F.lit("\n"), options_text([(k, F.lit(v)) for k, v in HALLMARKS.items()]))
    return df.select(ask.alias("question"), label_letters(numbers).alias("answer"), names.alias("answer_long"))


def documents(pairs: DataFrame, question: str = "question_text", answer: str = "answer_text") -> DataFrame:
    return passthrough(pairs, question, answer)


def live(questions: DataFrame) -> DataFrame:
    """One row an answer; the question is its message, else its subject."""
    rows = questions.select(F.coalesce("question", "subject").alias("question"), F.explode("answers").alias("answer"))
    return drop_blank(rows, ["question", "answer"])


def retrieval(qrels: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Queries with the texts of the documents judged to answer them."""
    return judged(qrels, queries.withColumnRenamed("text", "question"), docs.withColumnRenamed("text", "answer")).select("question", "answer")


def inference(df: DataFrame, premise: str = "supp_set", conclusion: str = "conclusion", label: str = "label_cat") -> DataFrame:
    """Does the conclusion follow? True for `pos`, else False."""
    ask = F.concat(F.lit("Does the conclusion follow from the premises?\nPremises: "), F.col(premise), F.lit("\nConclusion: "), F.col(conclusion))
    return df.select(ask.alias("question"), F.when(F.col(label) == "pos", "True").otherwise("False").alias("answer"))


def summaries(df: DataFrame, text: str = "CHQ", summary: str = "Summary") -> DataFrame:
    ask = F.concat(F.lit("Summarise this question in one sentence: "), F.col(text))
    return drop_blank(df.select(ask.alias("question"), F.col(summary).alias("answer")), ["question", "answer"])


def entity_relations(df: DataFrame, document: str = "document") -> DataFrame:
    """At most two questions a paper: its entities by type, and its relation types. Papers without a title are left out.

    document: array<struct<type, text, entities: array<struct<type, text: array<string>>>, relations: array<struct<type>>>>.
    """
    d = F.col(document)
    of = lambda kind: F.get(F.filter(d, lambda p: F.lower(p["type"]) == kind), F.lit(0))["text"]
    entities = F.flatten(F.transform(d, lambda p: F.coalesce(p["entities"], F.array())))
    named = lambda kind: F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(entities, lambda e: e["type"] == kind), lambda e: e["text"]))))
    relations = F.array_sort(F.array_distinct(F.transform(F.flatten(F.transform(d, lambda p: F.coalesce(p["relations"], F.array()))), lambda r: r["type"])))
    found = F.concat_ws("; ", *(F.when(F.size(named(k)) > 0, F.concat(F.lit(f"{k}: "), F.array_join(named(k), ", "))) for k in ("Chemical", "Disease")))
    text = F.concat_ws(" ", of("title"), of("abstract"))
    ask = lambda q: F.concat(F.lit(q), text)
    pairs = F.array(
        F.struct(ask("Which chemicals and diseases does this paper name? ").alias("question"), F.when(found != "", found).alias("answer")),
        F.struct(ask("Which relations does this paper report? ").alias("question"), F.when(F.size(relations) > 0, F.array_join(relations, ", ")).alias("answer")),
    )
    return df.where(of("title").isNotNull()).select(F.inline(pairs)).where("answer is not null")


def answer_with_option(df: DataFrame, answer: str, option: str) -> DataFrame:
    """The answer rewritten as `letter: text`, as corpora were before they were compared."""
    return df.withColumn(answer, F.concat_ws(": ", F.col(option), F.col(answer)))
