"""Column functions on arrays, maps and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def joined(values: Column) -> Column:
    """An array as `a, b`."""
    return F.array_join(F.transform(values, lambda x: x.cast("string")), ", ")


def multi_hot(codes: Column, size: int) -> Column:
    """array<int> of 0 and 1 for codes 0 to size - 1."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.array_contains(codes, i.cast("int")).cast("int"))


def multi_hot_visits(visits: Column, field: str, size: int, most: int) -> Column:
    """The first most visits of array<struct<field: array<int>>> as rows of 0 and 1."""
    return F.transform(F.slice(visits, 1, most), lambda v: multi_hot(v[field], size))


def by_type(visits: Column, fields: list[str]) -> Column:
    """array<struct> of visits as struct of arrays."""
    pick = lambda f: F.transform(visits, lambda v: v[f])
    return F.struct(*(pick(f).alias(f) for f in fields))


def ordered_distinct(pairs: Column) -> Column:
    """Distinct values of array<struct<position, value>> in the order they came, nulls dropped."""
    return F.array_distinct(F.filter(F.transform(F.array_sort(pairs), lambda p: p["value"]), lambda v: v.isNotNull()))


def padded(values: Column, size: Column | int, fill: int = 0) -> Column:
    n = F.lit(size) if isinstance(size, int) else size
    return F.concat(F.slice(values, F.lit(1), n), F.array_repeat(F.lit(fill), F.greatest(n - F.size(values), F.lit(0)).cast("int")))


def pad_mask(values: Column, size: Column | int) -> Column:
    n = F.lit(size) if isinstance(size, int) else size
    return padded(F.transform(values, lambda x: F.lit(1)), n)


def indexed(codes: Column, vocabulary: Column) -> Column:
    """Codes to their numbers in a map; codes that it lacks are dropped."""
    return F.filter(F.transform(codes, lambda c: F.try_element_at(vocabulary, c)), lambda i: i.isNotNull())


def indexed_or_zero(codes: Column, vocabulary: Column) -> Column:
    """As indexed(); no codes give `[0]`, the padding."""
    found = F.coalesce(indexed(codes, vocabulary), F.array().cast("array<int>"))
    return F.when(F.size(found) == 0, F.array(F.lit(0))).otherwise(found)


def clipped(visits: Column, most: int) -> Column:
    """The first most visits."""
    return F.slice(visits, 1, most)


def json_record(*columns: str) -> Column:
    """The columns as JSON text, null fields kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def jsonable(df: DataFrame) -> DataFrame:
    """NaN and infinities to null, dates and times to ISO text."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.when(~F.isnan(c) & ~c.isin(float("inf"), float("-inf")), c)
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        out.append(c.alias(name))
    return df.select(*out)


def json_safe(df: DataFrame, name: str = "record") -> DataFrame:
    """Each row as one JSON text: NaN and infinities null, whole numbers without a fraction, dates and times in ISO form."""
    safe = jsonable(df)

    def field(c: str, kind: str) -> Column:
        one = lambda value: F.to_json(F.struct(value.alias(c)), {"ignoreNullFields": "false"})
        value = F.col(f"`{c}`")
        text = one(value)
        if kind in ("double", "float"):
            text = F.when((value == F.floor(value)) & (F.abs(value) < 1 << 53), one(value.cast("long"))).otherwise(text)
        return F.substring(text, F.lit(2), F.length(text) - 2)

    fields = [field(c, k) for c, k in safe.dtypes]
    return safe.select(F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")).alias(name))


def batches(df: DataFrame, size: int, *order: str) -> DataFrame:
    """Rows (batch, rows): every size rows, in order, as an array of structs.

    Numbers come from counts by range partition, so no single task sees all rows.
    """
    from millrace.operators.relational import with_row_number

    numbered = with_row_number(df, "__n", *order)
    return numbered.groupBy(F.floor((F.col("__n") - 1) / size).alias("batch")).agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", F.struct(*df.columns).alias("row")))), lambda x: x["row"]).alias("rows"))
