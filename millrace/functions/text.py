"""Column functions on text: normalising, tokens, criteria sections, list literals, codes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\p{L}\p{N}_]+"

#: Answers of the hallmark task by letter (fixed values).
HALLMARKS = {
    "A": "None of the above",
    "B": "Sustaining proliferative signaling (PS)",
    "C": "Evading growth suppressors (GS)",
    "D": "Resisting cell death (CD)",
    "E": "Enabling replicative immortality (RI)",
    "F": "Inducing angiogenesis (A)",
    "G": "Activating invasion & metastasis (IM)",
    "H": "Genome instability & mutation (GI)",
    "I": "Tumor-promoting inflammation (TPI)",
    "J": "Deregulating cellular energetics (CE)",
    "K": "Avoiding immune destruction (ID)",
}


#: White space of any kind (fixed values): controls, separators, and the spaces of Unicode.
WHITE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column | str) -> Column:
    """Without white space of any kind at the ends (trim() takes spaces only)."""
    return F.btrim(text, F.lit(WHITE))


def normalize_text(text: Column) -> Column:
    """Stripped, lower-cased, white space collapsed, punctuation deleted."""
    return F.regexp_replace(strip(F.regexp_replace(F.lower(text), r"\s+", " ")), r"[^\p{L}\p{N}_\s]", "")


def words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.filter(F.split(F.lower(text), WORD), lambda w: w != "")


def keywords(text: Column, least: int = 3) -> Column:
    """ASCII words of at least so many letters, joined by spaces."""
    return F.array_join(F.filter(words(text), lambda w: w.rlike(f"^[a-z]{{{least},}}$")), " ")


def bigrams(text: Column) -> Column:
    """Successive word pairs."""
    w = words(text)
    return F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def is_nullish(value: Column) -> Column:
    """Null, blank, or the text `none` or `nan`."""
    return value.isNull() | F.lower(strip(value)).isin("", "none", "nan")


def nullish_to_null(value: Column) -> Column:
    return F.when(~is_nullish(value), value)


def truncate(text: Column, most: int, marker: str = "...") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(marker))).otherwise(text)


def combined_text(*columns: Column) -> Column:
    """The columns that hold something, joined by spaces."""
    return F.array_join(F.filter(F.array(*(strip(c.cast("string")) for c in columns)), lambda x: x.isNotNull() & ~F.lower(x).isin("", "none")), " ")


def joined_columns(*columns: Column) -> Column:
    """All columns joined by spaces, nulls as `nan`: the text that embeddings are made of."""
    return F.concat_ws(" ", *(F.coalesce(c.cast("string"), F.lit("nan")) for c in columns))


def folded_metadata(names: list[str]) -> Column:
    """`name: value, name: value` of columns; nulls as `nan`."""
    return F.concat_ws(", ", *(F.concat(F.lit(f"{n}: "), F.coalesce(F.col(n).cast("string"), F.lit("nan"))) for n in names))


# --- eligibility criteria ----------------------------------------------------


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")


def _first(lines: Column, pattern: str) -> Column:
    """1-based number of the first line that fits, 0 if none does."""
    return F.array_position(F.transform(lines, lambda x: x.rlike(pattern)), True).cast("int")


def _from_to(lines: Column, first: Column, last: Column) -> Column:
    """Lines first to last, 1-based and inclusive; empty if there are none."""
    return F.slice(lines, F.greatest(first, F.lit(1)), F.greatest(last - F.greatest(first, F.lit(1)) + 1, F.lit(0)))


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once a row however often it is used: expressions with lambdas share nothing otherwise."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def split_criteria(text: Column) -> Column:
    """struct<inclusion, exclusion: array<string>>: lower-cased lines after the last inclusion header before the first exclusion header, and after that."""

    def headed(lines: Column) -> Column:
        return F.struct(lines.alias("lines"), _first(lines, "exclusion|exclude").alias("exclusion"))

    def halves(s: Column) -> Column:
        head = F.when(s["exclusion"] > 0, F.slice(s["lines"], F.lit(1), F.greatest(s["exclusion"] - 1, F.lit(0)))).otherwise(s["lines"])
        return _once(head, lambda h: F.struct(s["lines"].alias("lines"), s["exclusion"].alias("exclusion"), h.alias("head"), _first(F.reverse(h), "inclusion|include").alias("back")))

    def sections(s: Column) -> Column:
        lines, exclusion, head = s["lines"], s["exclusion"], s["head"]
        inclusion = F.when(s["back"] > 0, F.size(head) - s["back"] + 1).otherwise(0)
        body = F.when((inclusion == 0) & (exclusion == 0), lines).otherwise(_from_to(head, inclusion + 1, F.size(head)))
        return F.struct(body.alias("inclusion"), F.when(exclusion > 0, _from_to(lines, exclusion + 1, F.size(lines))).otherwise(F.slice(lines, 1, 0)).alias("exclusion"))

    return _once(_once(_once(_lines(F.lower(F.coalesce(text, F.lit("")))), headed), halves), sections)


def split_criteria_sections(text: Column) -> Column:
    """struct<inclusion, exclusion: string>: a running switch at `inclusion criteria` and `exclusion criteria`; lines joined by spaces."""
    start = F.struct(F.lit("i").alias("mode"), F.array().cast("array<string>").alias("i"), F.array().cast("array<string>").alias("e"))

    def step(acc: Column, line: Column) -> Column:
        low = F.lower(line)
        header = low.contains("inclusion criteria") | low.contains("exclusion criteria")
        mode = F.when(low.contains("inclusion criteria"), "i").when(low.contains("exclusion criteria"), "e").otherwise(acc["mode"])
        return F.struct(
            mode.alias("mode"),
            F.when(~header & (acc["mode"] == "i"), F.concat(acc["i"], F.array(line))).otherwise(acc["i"]).alias("i"),
            F.when(~header & (acc["mode"] == "e"), F.concat(acc["e"], F.array(line))).otherwise(acc["e"]).alias("e"),
        )

    out = F.aggregate(_lines(F.coalesce(text, F.lit(""))), start, step)
    return F.struct(F.array_join(out["i"], " ").alias("inclusion"), F.array_join(out["e"], " ").alias("exclusion"))


def _headers(lines: Column, inclusion: str, exclusion: str) -> Column:
    return F.struct(lines.alias("lines"), _first(lines, inclusion).alias("inc"), _first(lines, exclusion).alias("exc"))


def split_eligibility(text: Column) -> Column:
    """struct<inclusion, exclusion: string>: first whole-word headers, case kept, lines joined by newlines; order of the sections is free."""

    def sections(s: Column) -> Column:
        lines, inc, exc, size = s["lines"], s["inc"], s["exc"], F.size(s["lines"])
        until = lambda own, other: F.when(other > own, other - 1).otherwise(size)
        none = F.slice(lines, 1, 0)
        inclusion = F.when(inc > 0, _from_to(lines, inc + 1, until(inc, exc))).when(exc > 0, _from_to(lines, F.lit(1), exc - 1)).otherwise(lines)
        exclusion = F.when(exc > 0, _from_to(lines, exc + 1, until(exc, inc))).otherwise(none)
        return F.struct(F.array_join(inclusion, "\n").alias("inclusion"), F.array_join(exclusion, "\n").alias("exclusion"))

    return _once(_once(_lines(F.coalesce(text, F.lit(""))), lambda lines: _headers(lines, r"(?i)\binclusion\b", r"(?i)\bexclusion\b")), sections)


def split_protocol(text: Column) -> Column:
    """struct<inclusion, exclusion: array<string>>: headers stay in; without both sections of at least a line all is inclusion."""

    def sections(s: Column) -> Column:
        lines, inc, exc, size = s["lines"], s["inc"], s["exc"], F.size(s["lines"])
        both = (inc > 0) & (exc > inc + 1) & (exc < size)
        none = F.slice(lines, 1, 0)
        return F.struct(F.when(both, _from_to(lines, inc, exc - 1)).otherwise(lines).alias("inclusion"), F.when(both, _from_to(lines, exc, size)).otherwise(none).alias("exclusion"))

    return _once(_once(_lines(F.lower(F.coalesce(text, F.lit("")))), lambda lines: _headers(lines, "inclusion", "exclusion")), sections)


def marked_criteria(text: Column) -> Column:
    """The text with both section markers, added where they are missing."""
    t = strip(F.coalesce(text, F.lit("")))
    low = F.lower(t)
    inc, exc = F.locate("inclusion criteria", low), F.locate("exclusion criteria", low)
    head, tail = F.lit("Inclusion Criteria:\n"), F.lit("\nExclusion Criteria:\n")
    part = lambda a, n: strip(F.substring(t, a, n))
    whole = F.length(t)
    after_inc, after_exc = part(inc, F.greatest(exc - inc, F.lit(0))), part(exc, whole)
    return (
        F.when(t == "", F.concat(head, tail))
        .when((inc > 0) & (exc > inc), F.concat(after_inc, F.lit("\n"), after_exc))
        .when((inc > 0) & (exc > 0), F.concat(part(inc, whole), F.lit("\n"), part(exc, F.greatest(inc - exc, F.lit(0)))))
        .when(inc > 0, F.concat(part(inc, whole), tail))
        .when(exc > 0, F.concat(head, part(F.lit(1), exc - 1), F.lit("\n"), after_exc))
        .otherwise(F.concat(head, t, tail))
    )


# --- list literals and codes ---------------------------------------------------


def literal_items(text: Column) -> Column:
    """Quoted items of a list literal `['a', "b"]`, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"'[^']*'|\"[^\"]*\""), F.lit(0)), lambda x: F.regexp_replace(x, r"^['\"]|['\"]$", ""))


def list_to_csv(text: Column) -> Column:
    """A list literal as `a, b`; other texts unchanged."""
    return F.when(strip(text).rlike(r"(?s)^\[.*\]$"), F.array_join(literal_items(text), ", ")).otherwise(text)


def nested_codes(text: Column) -> Column:
    """`[["a", "b"], ["c"]]` (each inner list may be quoted) as array<array<string>>."""
    inner = F.regexp_extract_all(text, F.lit(r"\[[^\[\]]*\]"), F.lit(0))
    return F.transform(inner, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\[|\]$", ""), ","), lambda c: F.regexp_replace(strip(c), r"^['\"]+|['\"]+$", "")))


def label_numbers(text: Column) -> Column:
    """`[1 5]` as array<int>."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))


def label_letters(numbers: Column) -> Column:
    """0 to A, 1 to B, ... in ascending order; A for none."""
    letters = F.transform(F.array_sort(F.array_distinct(numbers)), lambda i: F.char(i + 65))
    return F.when(F.size(letters) == 0, F.lit("A")).otherwise(F.array_join(letters, ", "))


def option_letter(code: Column) -> Column:
    """1 to A, 2 to B, ..."""
    return F.when(code.between(1, 26), F.char(code.cast("int") + 64))


def citation_title(text: Column) -> Column:
    """The second part between dots if there is one."""
    parts = F.split(text, r"\.")
    return F.when(F.size(parts) > 1, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0)))


def camel_to_snake(name: str) -> str:
    return "".join(("_" if i and c.isupper() else "") + c.lower() for i, c in enumerate(name))


def snake_to_camel(name: str) -> str:
    return "".join(part[:1].upper() + part[1:] for part in name.split("_"))


def title_case(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def icd9_category(code: Column) -> Column:
    """The first three characters, four of E codes."""
    return F.when(code.startswith("E"), F.substring(code, 1, 4)).otherwise(F.substring(code, 1, 3))


def tagged(prefix: str, code: Column) -> Column:
    return F.concat(F.lit(f"{prefix}:"), code)


def exact_match(a: Column, b: Column) -> Column:
    return F.lower(strip(a)) == F.lower(strip(b))


def decision_answer(decision: Column, reason: Column | None = None) -> Column:
    """`Yes`, or `Yes. reason` where there is one."""
    head = F.initcap(F.lower(strip(decision)))
    return head if reason is None else F.when(is_nullish(reason), head).otherwise(F.concat(head, F.lit(". "), reason))
