"""Electronic records: nested admissions, time bins, episodes, visit sequences, patient tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.arrays import ordered_distinct
from millrace.functions.numeric import age_years
from millrace.operators.relational import with_row_number


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def seconds_since_first(df: DataFrame, by: str, time: str, name: str = "secs") -> DataFrame:
    """Seconds since the group's first event."""
    origin = F.min(_micros(F.col(time))).over(Window.partitionBy(by))
    return df.withColumn(name, (_micros(F.col(time)) - origin) / 1e6)


def days_since_first(df: DataFrame, by: str, time: str, name: str = "days") -> DataFrame:
    """Whole days of 24 hours since the group's first event."""
    origin = F.min(_micros(F.col(time))).over(Window.partitionBy(by))
    return df.withColumn(name, F.floor((_micros(F.col(time)) - origin) / 86_400_000_000))


def episodes(events: DataFrame, duration: float, variables: list[str], by: str = "hadm_id", time: str = "charttime", variable: str = "variable", value: str = "value", how: str = "last", tie: str | None = None, least_rows: int = 1) -> DataFrame:
    """One row a bin [j d, (j + 1) d) of each stay with any listed variable: by, upper edge in seconds, a column a variable.

    Bins start at the stay's first event; an event exactly at the last edge belongs to none. how:
    the last value in the bin (ties by the tie column), or the mean.
    """
    rows = seconds_since_first(events, by, time, "__s")
    rows = rows.withColumn("__max", F.max("__s").over(Window.partitionBy(by)))
    rows = rows.withColumn("__bin", F.floor(F.col("__s") / duration)).where(F.col("__bin") < F.ceil(F.col("__max") / duration))
    rows = rows.where(F.col(variable).isin(*variables))
    order = F.struct("__s", *([tie] if tie else []))
    one = lambda v: F.avg(F.when(F.col(variable) == v, F.col(value))) if how == "mean" else F.max_by(value, F.when(F.col(variable) == v, order))
    out = rows.groupBy(by, "__bin").agg(*(one(v).alias(v) for v in variables))
    out = out.withColumn("upper", (F.col("__bin") + 1) * duration).select(by, "upper", *variables)
    if least_rows > 1:
        out = out.withColumn("__n", F.count("*").over(Window.partitionBy(by))).where(F.col("__n") >= least_rows).drop("__n")
    return out


def nested(parent: DataFrame, children: dict[str, tuple[DataFrame, str | None]], key: str) -> DataFrame:
    """parent with one array of structs a child table, ordered by its row id (else by its columns); no rows give an empty array."""
    out = parent
    for name, (table, order) in children.items():
        record = F.struct(*(c for c in table.columns if c != key))
        item = F.struct(*([F.col(order).alias("__o")] if order else []), record.alias("r"))
        rows = table.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["r"]).alias(name))
        out = out.join(rows, key, "left").withColumn(name, F.coalesce(name, F.array()))
    return out


def sampled_documents(admissions: DataFrame, children: dict[str, tuple[DataFrame, str | None]], key: str, n: int, seed: int = 42) -> DataFrame:
    """n admissions drawn by hash, with their rows of every child table, as nested JSON texts (key, document)."""
    from millrace.operators.sampling import sample_keys

    keys = sample_keys(admissions, n, key, seed)
    chosen = admissions.join(keys, key, "left_semi")
    kept = {name: (table.join(keys, key, "left_semi"), order) for name, (table, order) in children.items()}
    return nested(chosen, kept, key).select(key, F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("document"))


def vocabulary(words: DataFrame, word: str, position: list[str], first: int = 1) -> DataFrame:
    """(word, index) in the order of first appearance. Distinct words are numbered by ranges."""
    seen = words.where(F.col(word).isNotNull()).groupBy(F.col(word).alias("word")).agg(F.min(F.struct(*position)).alias("__first"))
    return with_row_number(seen, "__n", "__first", "word").select("word", (F.col("__n") + (first - 1)).alias("index"))


def visit_events(admissions: DataFrame, diagnoses: DataFrame, drugs: DataFrame, subject: str, admission: str, time: str, code: str, drug: str, order: str) -> DataFrame:
    """(subject, admission, days, events): distinct tagged codes, then distinct tagged drugs, in file order; admissions without time are left out."""
    base = days_since_first(admissions.where(F.col(time).isNotNull()), subject, time)
    tag = lambda prefix, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{prefix}:"), F.col(c).cast("string")))
    part = lambda df, prefix, c, name: df.groupBy(admission).agg(ordered_distinct(F.collect_list(F.struct(F.col(order).alias("position"), tag(prefix, c).alias("value")))).alias(name))
    none = F.array().cast("array<string>")
    out = base.join(part(diagnoses, "DX", code, "__dx"), admission, "left").join(part(drugs, "RX", drug, "__rx"), admission, "left")
    return out.select(subject, admission, time, "days", F.concat(F.coalesce("__dx", none), F.coalesce("__rx", none)).alias("events"))


def visit_sequences(visits: DataFrame, subject: str, time: str) -> tuple[DataFrame, DataFrame]:
    """(subject, days, visits: array<array<index>>) and the vocabulary (word, index) in first-seen order; visits without events keep their day only."""
    flat = visits.select(subject, time, "days", F.posexplode_outer("events").alias("__at", "word"))
    vocab = vocabulary(flat, "word", [subject, time, "__at"])
    coded = flat.join(vocab, "word", "left")
    one = coded.groupBy(subject, time, "days").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("index").isNotNull(), F.struct("__at", "index")))), lambda x: x["index"]).alias("codes"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), F.col("days").alias("d"), F.col("codes").alias("c"))))
    out = one.groupBy(subject).agg(ordered.alias("v"))
    return out.select(subject, F.transform("v", lambda x: x["d"]).alias("days"), F.filter(F.transform("v", lambda x: x["c"]), lambda c: F.size(c) > 0).alias("visits")), vocab


def patient_table(patients: DataFrame, admissions: DataFrame, subject: str = "subject_id", birth: str = "dob", death: str = "dod_hosp", admitted: str = "admittime") -> DataFrame:
    """Patients with the first known value of each admission column, and their age at death, else at admission, in years."""
    from millrace.operators.relational import left_with_first

    rows = left_with_first(patients, admissions.withColumn("__order", F.col(admitted)), subject, "__order").drop("__order")
    return rows.withColumn("age", age_years(F.col(birth), F.coalesce(F.col(death), F.col(admitted))))


def death_indicator(admissions: DataFrame, death: str = "deathtime") -> DataFrame:
    return admissions.withColumn("death", F.col(death).isNotNull().cast("int"))


def attached(admissions: DataFrame, tables: dict[str, tuple[DataFrame, str]], key: str = "hadm_id") -> DataFrame:
    """admissions with, for each table, the sorted list of one of its columns."""
    for name, (table, column) in tables.items():
        admissions = admissions.join(table.groupBy(key).agg(F.array_sort(F.collect_list(column)).alias(name)), key, "left")
    return admissions
