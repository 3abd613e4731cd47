"""Column functions on numbers, dates, units and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


def to_int(value: Column) -> Column:
    """`3.0` to 3; blank or not a number to null."""
    return strip(value.cast("string")).try_cast("double").try_cast("bigint")


def to_number(value: Column) -> Column:
    return strip(value.cast("string")).try_cast("double")


def to_timestamp(value: Column, pattern: str | None = None) -> Column:
    """Null if it can't be read."""
    return F.try_to_timestamp(value, F.lit(pattern)) if pattern else F.try_to_timestamp(value)


def year_of(value: Column) -> Column:
    return F.year(F.try_to_timestamp(value))


def age_years(birth: Column, at: Column) -> Column:
    """Days over 365.25; null if negative."""
    age = F.datediff(at, birth) / 365.25
    return F.when(age >= 0, age)


def age_months(text: Column) -> Column:
    """`5 Years`, `3 Weeks`, `10 Days`, ... as months."""
    t = F.lower(strip(text))
    n = F.regexp_extract(t, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    return (
        F.when(t.contains("year"), n * 12)
        .when(t.contains("month"), n)
        .when(t.contains("week"), n / 4.286)
        .when(t.contains("day"), n / 30)
        .when(t.contains("hour"), n / (30 * 24))
        .when(t.contains("minute"), n / (30 * 24 * 60))
    )


def zscore(value: Column, mean: Column, deviation: Column) -> Column:
    """0 mean, sample deviation 1; unchanged columns of no deviation."""
    return F.when(deviation > 0, (value - mean) / deviation).otherwise(value)


# --- units of vital signs ----------------------------------------------------------


def celsius(value: Column, unit: Column) -> Column:
    """Fahrenheit by its unit, or at 79 and above."""
    v = to_number(value)
    return F.when(F.lower(F.coalesce(unit, F.lit(""))).contains("f") | (v >= 79), (v - 32) * 5 / 9).otherwise(v)


def systolic(value: Column) -> Column:
    return F.coalesce(F.regexp_extract(value, r"^(\d+)/(\d+)$", 1).try_cast("double"), value.try_cast("double"))


def diastolic(value: Column) -> Column:
    return F.coalesce(F.regexp_extract(value, r"^(\d+)/(\d+)$", 2).try_cast("double"), value.try_cast("double"))


def capillary_refill(value: Column) -> Column:
    """0 for normal, 1 for delayed, else null."""
    return F.when(value.isin("Normal <3 secs", "Brisk"), 0.0).when(value.isin("Abnormal >3 secs", "Delayed"), 1.0)


def kilograms(value: Column, unit: Column) -> Column:
    v, u = to_number(value), F.lower(F.coalesce(unit, F.lit("")))
    return F.when(u.contains("oz"), v / 16 * 0.453592).when(u.contains("lb"), v * 0.453592).otherwise(v)


def centimetres(value: Column, unit: Column) -> Column:
    v = to_number(value)
    return F.when(F.lower(F.coalesce(unit, F.lit(""))).contains("in"), F.round(v * 2.54)).otherwise(v)


def inspired_oxygen(value: Column, unit: Column) -> Column:
    """A fraction; percentages over 100 parts unless the unit is torr."""
    v = to_number(value)
    return F.when((v > 1.0) & ~F.lower(F.coalesce(unit, F.lit(""))).contains("torr"), v / 100).otherwise(v)


def oxygen_saturation(value: Column) -> Column:
    """Percent; fractions are scaled."""
    v = to_number(value)
    return F.when(v <= 1, v * 100).otherwise(v)


def lab_value(value: Column) -> Column:
    return to_number(value)


# --- vectors --------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either is a zero vector."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    return F.transform(logits, lambda x: F.exp(x - top) / F.aggregate(F.transform(logits, lambda y: F.exp(y - top)), F.lit(0.0), lambda t, y: t + y))


def top_k(logits: Column, k: int) -> Column:
    """0-based numbers of the k largest, of equal ones the later first (as a reversed ascending sort has it)."""
    pairs = F.transform(logits, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.transform(F.slice(F.sort_array(pairs, asc=False), 1, k), lambda p: p["i"])
