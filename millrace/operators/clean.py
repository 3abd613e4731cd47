"""Cleaning and schema harmonisation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import combined_text, folded_metadata, nullish_to_null, strip

NONE = "none"

#: Registry status to outcome; a status that is missing here has none (fixed values).
STATUS_OUTCOME = {
    "completed": 1,
    "completed with results": 1,
    "approved for marketing": 1,
    "withdrawn": 0,
    "terminated": 0,
    "suspended": 0,
    "no longer available": 0,
}


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns that exist are renamed, others ignored."""
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})


def rename_first(df: DataFrame, name: str) -> DataFrame:
    return df.withColumnRenamed(df.columns[0], name)


def normalised_names(df: DataFrame) -> DataFrame:
    """Lower case; spaces and dots become underscores."""
    return df.toDF(*(c.strip().lower().replace(" ", "_").replace(".", "_") for c in df.columns))


def resolve_column(df: DataFrame, name: str) -> str:
    """The column of this name in any case; KeyError if there is none."""
    for c in df.columns:
        if c.lower() == name.lower():
            return c
    raise KeyError(f"no column {name}; there are {', '.join(df.columns)}")


def ensure_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*(F.col(f"`{resolve_column(df, n)}`").alias(n) for n in names))


def existing(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*(n for n in names if n in df.columns))


def drop_null(df: DataFrame, subset: list[str]) -> DataFrame:
    return df.dropna(subset=subset)


def drop_blank(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with text other than white space in all columns."""
    return df.where(reduce(lambda a, b: a & b, [strip(F.col(c)) != "" for c in columns]))


def drop_nullish(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows where no column is null, empty or the text `nan`."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~strip(F.col(c)).isin("", "nan") for c in columns]))


def validated(df: DataFrame, required: list[str], prefix: str = "TRIAL", key: str = "nct_id", aliases: tuple[str, ...] = ("nctid", "id")) -> DataFrame:
    """Harmonised names, required columns, no nulls (`none` instead), lists as `a, b`, an id for every row.

    Rows without id get `prefix` and six digits from their place in the input. The status alias
    comes before missing columns are filled, so it counts for the default fields too.
    """
    df = normalised_names(df)
    if "overall_status" not in df.columns and "study_status" in df.columns:
        df = df.withColumn("overall_status", F.col("study_status"))
    df = df.withColumns({c: F.array_join(c, ", ") for c, t in df.dtypes if t == "array<string>"})
    known = [c for c in (key, *aliases) if c in df.columns]
    if known:
        df = df.withColumn(key, F.coalesce(*(nullish_to_null(F.col(c).cast("string")) for c in known)))
        missing = df.where(F.col(key).isNull()).limit(1).count() > 0
    else:
        df, missing = df.withColumn(key, F.lit(None).cast("string")), True
    if missing:
        from millrace.operators.relational import with_row_number

        df = with_row_number(df, "__n").withColumn(key, F.coalesce(key, F.format_string(f"{prefix}%06d", F.col("__n")))).drop("__n")
    df = df.withColumns({c: F.lit(NONE) for c in required if c not in df.columns})
    return df.fillna(NONE)


def numeric_where_whole(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns whose every value reads as a number become double."""
    bad = df.agg(*(F.count_if(F.col(c).isNotNull() & F.col(c).cast("string").try_cast("double").isNull()).alias(c) for c in columns)).first()
    return df.withColumns({c: F.col(c).cast("double") for c in columns if bad[c] == 0})


def standardise_qa(df: DataFrame, dataset: str, quality: int, question: str = "question", answer: str = "answer", answer_long: str | None = None) -> DataFrame:
    """The question-answer table: question, answer, answer_long, dedup_answer, dataset_name, quality; blank rows dropped."""
    for c in (question, answer, *([answer_long] if answer_long else [])):
        resolve_column(df, c)
    out = df.select(
        strip(F.col(question).cast("string")).alias("question"),
        strip(F.col(answer).cast("string")).alias("answer"),
        (strip(F.col(answer_long).cast("string")) if answer_long else F.lit(None).cast("string")).alias("answer_long"),
        strip(F.col(answer_long or answer).cast("string")).alias("dedup_answer"),
        F.lit(dataset).alias("dataset_name"),
        F.lit(quality).alias("quality"),
    )
    return drop_nullish(out, ["question", "answer", "dedup_answer"])


def folded(df: DataFrame, source: str, question: str = "question", answer: str = "answer") -> DataFrame:
    """source, question, answer, and all other columns as one text of names and values."""
    rest = [c for c in df.columns if c not in (question, answer)]
    return df.select(F.lit(source).alias("source"), F.col(question).alias("question"), F.col(answer).alias("answer"), (folded_metadata(rest) if rest else F.lit("")).alias("meta_info"))


def with_combined_text(df: DataFrame, columns: list[str], name: str = "combined_text") -> DataFrame:
    df = df.withColumn(name, combined_text(*(F.col(c) for c in columns if c in df.columns)))
    return df.withColumn(f"{name}_lower", F.lower(name))


def status_outcome(status: Column) -> Column:
    """1, 0 or null by the registry status."""
    pairs = [F.lit(x) for kv in STATUS_OUTCOME.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.lower(strip(status)))


def outcome(status: Column, label: Column | None = None) -> Column:
    """A given 0 or 1 goes before the status."""
    derived = status_outcome(status)
    if label is None:
        return derived
    given = label.cast("string").try_cast("double").cast("int")
    return F.coalesce(F.when(given.isin(0, 1), given), derived)


def decoded(df: DataFrame, codes: dict[str, dict[str, str]]) -> DataFrame:
    """Codes to descriptions by column; unknown codes stay, under `<column>_unknown` true."""
    out = {}
    for c, table in codes.items():
        m = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
        found = F.try_element_at(m, F.col(c).cast("string"))
        out[c], out[f"{c}_unknown"] = F.coalesce(found, F.col(c).cast("string")), F.col(c).isNotNull() & found.isNull()
    return df.withColumns(out)


def matches(columns: list[str], value: str) -> Column:
    """Case-insensitive substring of any of the columns; null counts as no."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(value.lower())), F.lit(False)) for c in columns])


def filter_by_criteria(df: DataFrame, criteria: dict[str, str | list[str]]) -> DataFrame:
    """All fields must match, each by any of its values."""
    for field, values in criteria.items():
        if field in df.columns:
            df = df.where(reduce(lambda a, b: a | b, [matches([field], v) for v in ([values] if isinstance(values, str) else values)]))
    return df


def search(df: DataFrame, query: str, fields: list[str]) -> DataFrame:
    """Rows where any field holds the query; all rows for an empty query."""
    return df.where(matches([f for f in fields if f in df.columns], query)) if query else df


def summary(brief: Column, detailed: Column, title: Column, condition: Column, most: int = 1000) -> Column:
    """A brief summary, else the beginning of the detailed one, else title and condition, else N/A."""
    made = F.concat_ws(". ", nullish_to_null(title), F.concat(F.lit("Condition: "), nullish_to_null(condition)))
    return F.coalesce(nullish_to_null(brief), F.substring(nullish_to_null(detailed), 1, most), F.when(made != "", made), F.lit("N/A"))


def without_leaks(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def null_report(df: DataFrame) -> DataFrame:
    """(column, type, nulls, rows) of every column, in one pass."""
    counts = df.agg(F.count("*").alias("__rows"), *(F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns))
    entries = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"`{c}`").alias("nulls"), F.col("__rows").alias("rows")) for c, t in df.dtypes))
    return counts.select(F.inline(entries))


