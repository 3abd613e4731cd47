"""Column functions that read answers out of model responses: options, letters, labels, numbers, doses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import HALLMARKS, strip


def _map(items: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in items.items() for x in pair))


def _entries(matches: Column, pattern: str) -> Column:
    """map letter to text of matches that hold both; of repeated letters the first counts."""
    pairs = F.transform(matches, lambda m: F.struct(F.regexp_extract(m, pattern, 1).alias("key"), strip(F.regexp_extract(m, pattern, 2)).alias("value")))
    unlike = F.aggregate(
        F.filter(pairs, lambda p: p["value"] != ""),
        F.array().cast("array<struct<key:string,value:string>>"),
        lambda acc, p: F.when(F.exists(acc, lambda q: q["key"] == p["key"]), acc).otherwise(F.concat(acc, F.array(p))),
    )
    return F.map_from_entries(unlike)


def parse_options(question: Column) -> Column:
    """map of option letters (or the three-way answers) to texts: by the first way that finds at least two, else empty."""
    low = F.lower(question)
    three_way = low.contains("yes") & low.contains("no") & low.contains("maybe") & low.rlike(r"yes\W+(?:or\W+)?no\W+(?:or\W+)?maybe|\byes/no/maybe\b")
    hallmark = low.contains("cancer hallmarks") | question.contains("A) None of the above") | question.contains("B) Sustaining proliferative signaling") | question.contains("[A, B, C, D, E, F, G, H, I, J, K]")
    by_line = _entries(F.regexp_extract_all(question, F.lit(r"(?m)^[ \t]*[A-Z][.)][ \t]*\S[^\n]*"), F.lit(0)), r"^[ \t]*([A-Z])[.)][ \t]*(.*)$")
    inline = _entries(F.regexp_extract_all(question, F.lit(r"(?s)\b[A-Z]\)\s*.+?(?=\s+[A-Z]\)|$)"), F.lit(0)), r"(?s)^([A-Z])\)\s*(.+)$")
    cut = _entries(F.split(question, r"(?=\b[A-Z][.)]\s)"), r"(?s)^([A-Z])[.)]\s+(.+)$")
    enough = lambda m: F.size(m) >= 2
    none = F.create_map().cast("map<string,string>")
    return (
        F.when(question.isNull(), none)
        .when(three_way, _map({"Yes": "Yes", "No": "No", "Maybe": "Maybe"}))
        .when(hallmark, _map(HALLMARKS))
        .when(enough(by_line), by_line)
        .when(enough(inline), inline)
        .when(enough(cut), cut)
        .otherwise(none)
    )


def extract_yes_no(response: Column) -> Column:
    """The first of YES, NO, MAYBE that occurs anywhere."""
    up = F.upper(response)
    return F.when(up.contains("YES"), "Yes").when(up.contains("NO"), "No").when(up.contains("MAYBE"), "Maybe")


def _valid(options: Column, letter: Column) -> Column:
    return F.when((letter != "") & F.array_contains(options, letter), letter)


#: In this order; of each only the first match counts (fixed patterns of the published extraction).
LETTER_PATTERNS = (
    r"(?:correct answer is|answer is|the answer is)\s*([A-Z])",
    r"answer:\s*([A-Z])",
    r"\(([A-Z])\)",
    r"^([A-Z])[\.\)]\s*",
    r"\b([A-Z])\b",
)
#: As these, but the letter must stand alone; for use where scores need not be compared with published ones.
REPAIRED_PATTERNS = (
    r"(?:correct\s+)?answer\s+is:?\s*\(?([A-Z])\b",
    r"answer:\s*\(?([A-Z])\b",
    r"\(([A-Z])\)",
    r"^\s*([A-Z])[.)]",
    r"\b([A-Z])\b",
)


def extract_letter(response: Column, options: Column, repaired: bool = False) -> Column:
    """The option letter of a response: a leading letter that no letter follows, the patterns in order, then the first option contained.

    By default the patterns are the published ones, which read `answer is clearly D` as C; repaired
    wants letters that stand alone.
    """
    said = strip(response)
    known = F.transform(options, lambda o: F.upper(o))
    lead = _valid(known, F.upper(F.regexp_extract(said, r"^([A-Za-z])(?!\p{L})", 1)))
    tries = [_valid(known, F.upper(F.regexp_extract(said, f"(?i){p}", 1))) for p in (REPAIRED_PATTERNS if repaired else LETTER_PATTERNS)]
    contained = F.get(F.filter(known, lambda o: F.upper(said).contains(o)), F.lit(0))
    return F.coalesce(lead, *tries, contained)


def extract_hallmark(response: Column, options: Column, fixed: bool = False) -> Column:
    """Hallmark letters: a list of letters A to K if it is an option as a whole, else the first letter that stands alone, else the first option contained.

    That is the published reading, in which lists count only where options hold such lists; fixed
    returns every letter that stands alone instead, sorted.
    """
    up = F.upper(strip(response))
    known = F.transform(options, lambda o: F.upper(o))
    if fixed:
        several = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(up, F.lit(r"\b([A-K])\b"), F.lit(1)))), ", ")
        return F.when(several != "", several)
    listed = [F.regexp_replace(F.regexp_extract(up, p, 1), r"\s*,\s*", ", ") for p in (r"\b([A-K](?:\s*,\s*[A-K])+)\b", r"^([A-K]\s*,\s*[A-K])")]
    single = F.regexp_extract(up, r"\b([A-K])\b", 1)
    contained = F.get(F.filter(known, lambda o: up.contains(o)), F.lit(0))
    return F.coalesce(*(_valid(known, x) for x in (*listed, single)), contained)


def extract_answer(response: Column, options: Column, dataset: Column) -> Column:
    name = F.lower(F.coalesce(dataset, F.lit("")))
    return F.when(name.contains("pubmedqa"), extract_yes_no(response)).when(name.contains("hoc"), extract_hallmark(response, options)).otherwise(extract_letter(response, options))


# --- labels ----------------------------------------------------------------------


def _json_label(text: Column, labels: tuple[str, ...], key: str = "prediction") -> Column:
    """The label under the key if the whole trimmed text is a JSON object and the label is one of these."""
    t = strip(text)
    found = strip(F.get_json_object(F.when(t.rlike(r"(?s)^\{.*\}$"), t), f"$.{key}"))
    return F.when(found.isin(*labels), found)


def parse_outcome(text: Column) -> Column:
    """Successful, Failed or null. `unsuccessful` reads as Successful, as published scores have it."""
    t = F.lower(strip(text))
    loose = (
        F.when(t.contains("successful") | (t == "success"), "Successful")
        .when(t.contains("failed") | t.contains("failure"), "Failed")
        .when(t.isin("s", "1", "true", "yes"), "Successful")
        .when(t.isin("f", "0", "false", "no"), "Failed")
    )
    return F.coalesce(_json_label(text, ("Successful", "Failed")), loose)


def parse_failure_reason(text: Column) -> Column:
    t = F.lower(strip(text))
    loose = F.when(t.contains("poor") & t.contains("enroll"), "poor enrollment").when(t.contains("safety"), "safety").when(t.contains("efficacy"), "efficacy").when(t.contains("other"), "Others")
    return F.coalesce(_json_label(text, ("poor enrollment", "safety", "efficacy", "Others")), loose)


def parse_two_way(text: Column, first: str, second: str) -> Column:
    """One of two labels by name, or by a leading a or b."""
    t = F.lower(strip(text))
    loose = F.when(t.contains(first.lower()), first).when(t.contains(second.lower()), second).when(t.startswith("a"), first).when(t.startswith("b"), second)
    return F.coalesce(_json_label(text, (first, second)), loose)


def parse_long_short(text: Column) -> Column:
    return parse_two_way(text, "Long", "Short")


def parse_high_low(text: Column) -> Column:
    return parse_two_way(text, "High", "Low")


def parse_alive_dead(text: Column) -> Column:
    t = F.lower(strip(text))
    loose = F.when(t.contains("alive") | t.contains("surviv"), "Alive").when(t.contains("dead") | t.contains("death") | t.contains("deceased"), "Dead")
    return F.coalesce(_json_label(text, ("Alive", "Dead")), loose)


def parse_number(text: Column) -> Column:
    """A number under one of the usual JSON keys, else the first signed decimal."""
    t = strip(text)
    whole = F.when(t.rlike(r"(?s)^\{.*\}$"), t)
    keyed = [F.get_json_object(whole, f"$.{k}").try_cast("double") for k in ("value", "prediction", "rate", "duration", "months")]
    return F.coalesce(*keyed, F.regexp_extract(text, r"([-+]?\d*\.?\d+)", 1).try_cast("double"))


#: Keys that may hold each dose level (fixed values).
DOSE_KEYS = {"max": ("max_dose", "Max", "max", "maximum"), "min": ("min_dose", "Min", "min", "minimum"), "avg": ("avg_dose", "Avg", "avg", "average")}


def parse_doses(text: Column) -> Column:
    """struct<max, min, avg: int> of levels 0 to 4, or null: all three or nothing. A JSON object is parsed once."""
    t = strip(text)
    keyed = F.from_json(F.when(t.startswith("{") & t.endswith("}"), t), "map<string,string>")
    named = lambda m: F.struct(*(F.coalesce(*(F.try_element_at(m, F.lit(k)).try_cast("double").cast("int") for k in keys)).alias(x) for x, keys in DOSE_KEYS.items()))
    written = F.struct(*(F.regexp_extract(text, rf"[{k[0].upper()}{k[0]}]{k[1:]}[:\s]*(\d+)", 1).try_cast("int").alias(k) for k in DOSE_KEYS))
    # A one-element array binds a value to a name, so that nothing is parsed twice.
    checked = lambda made: F.get(F.transform(F.array(made), lambda d: F.when(reduce(lambda a, b: a & b, [d[k].between(0, 4) for k in DOSE_KEYS]), d)), F.lit(0))
    from_json = F.get(F.transform(F.array(keyed), lambda m: F.when(m.isNotNull(), named(m))), F.lit(0))
    return F.coalesce(checked(from_json), checked(written))


def binarised(value: Column, threshold: float, above: str, below: str, inclusive: bool = True) -> Column:
    return F.when(value.isNotNull(), F.when(value >= threshold if inclusive else value > threshold, above).otherwise(below))
