"""Column functions on cases with known answers."""

from __future__ import annotations

import difflib
import itertools

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import arrays, numeric, overlap, parse, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


L = F.lit


def test_criteria(spark):
    t = "Study\nInclusion Criteria:\n Adults \nInclude women\n18+\n\nEXCLUSION criteria\nSmokers\n"
    r = one(spark, text.split_criteria(L(t)))
    assert (r.inclusion, r.exclusion) == (["18+"], ["smokers"])
    r = one(spark, text.split_criteria_sections(L(t)))
    assert (r.inclusion, r.exclusion) == ("Study Adults Include women 18+", "Smokers")
    r = one(spark, text.split_eligibility(L("Exclusion:\nA\nInclusion:\nB")))
    assert (r.inclusion, r.exclusion) == ("B", "A")
    r = one(spark, text.split_protocol(L("inclusion\nexclusion\nx")))
    assert (r.inclusion, r.exclusion) == (["inclusion", "exclusion", "x"], [])
    assert one(spark, text.split_criteria(L(None).cast("string"))).inclusion == []
    assert one(spark, text.marked_criteria(L("exclusion criteria: a\ninclusion criteria: b"))) == "inclusion criteria: b\nexclusion criteria: a"


def test_text(spark):
    assert one(spark, text.normalize_text(L("\n A  b,\tC-d! "))) == "a b cd"
    assert one(spark, text.keywords(L("The cat, a über x1 dogs"))) == "the cat dogs"
    assert one(spark, text.bigrams(L("a b c"))) == ["a b", "b c"] and one(spark, text.bigrams(L("a"))) == []
    assert one(spark, text.list_to_csv(L("['a', \"b\"]"))) == "a, b" and one(spark, text.list_to_csv(L("a"))) == "a"
    assert one(spark, text.nested_codes(L("[[\"['a1', 'b']\"], [\"['c']\"]]"))) == [["a1", "b"], ["c"]]
    assert one(spark, text.label_letters(text.label_numbers(L("[5 1]")))) == "B, F"
    assert one(spark, text.label_letters(text.label_numbers(L("[]")))) == "A"
    assert one(spark, text.icd9_category(L("E8500"))) == "E850" and one(spark, text.icd9_category(L("25000"))) == "250"
    assert one(spark, text.citation_title(L("A B. Title. J"))) == " Title" and one(spark, text.citation_title(L("x"))) == "x"
    assert one(spark, text.decision_answer(L("yes"), L("why"))) == "Yes. why"
    assert text.camel_to_snake("BriefTitle") == "brief_title" and text.snake_to_camel("brief_title") == "BriefTitle"
    assert one(spark, text.title_case(L("brief_title"))) == "Brief Title"


@pytest.mark.parametrize(
    ("said", "letter"),
    [("B", "B"), ("b) x", "B"), ("Because it is C", "C"), ("The answer is (D).", "D"), ("Answer: a", "A"), ("(b)", "B"), ("zzz", None), ("", None), ("Bad", "A")],
)
def test_letter(spark, said, letter):
    assert one(spark, parse.extract_letter(L(said), F.array(*map(L, "ABCD")))) == letter


def test_labels(spark):
    assert one(spark, parse.parse_outcome(L(' {"prediction": "Failed"} '))) == "Failed"
    assert one(spark, parse.parse_outcome(L("unsuccessful"))) == "Successful"
    assert one(spark, parse.parse_outcome(L("?"))) is None
    assert one(spark, parse.parse_failure_reason(L("poor enrollment"))) == "poor enrollment"
    assert one(spark, parse.parse_long_short(L("B."))) == "Short" and one(spark, parse.parse_high_low(L("very high"))) == "High"
    assert one(spark, parse.parse_alive_dead(L("deceased"))) == "Dead"
    assert one(spark, parse.parse_number(L('{"rate": "0.5"}'))) == 0.5 and one(spark, parse.parse_number(L("about -3.5 or 4"))) == -3.5
    assert one(spark, parse.parse_number(L("none"))) is None
    d = one(spark, parse.parse_doses(L('{"Max": 4, "min": 0, "average": "2"}')))
    assert (d.max, d.min, d.avg) == (4, 0, 2)
    assert one(spark, parse.parse_doses(L("Max: 5, Min: 1, Avg: 2"))) is None
    assert one(spark, parse.extract_yes_no(L("I KNOW"))) == "No"
    assert one(spark, parse.extract_hallmark(L("B, C"), F.array(*map(L, "ABC")))) == "B"
    assert one(spark, parse.extract_hallmark(L("B, C"), F.array(*map(L, "ABC")), fixed=True)) == "B, C"


def test_options(spark):
    o = lambda q: one(spark, parse.parse_options(L(q)))
    assert o("What?\nA) x y\nB. z") == {"A": "x y", "B": "z"}
    assert o("What? A) one B) two") == {"A": "one", "B": "two"}
    assert o("Is it so? yes/no/maybe") == {"Yes": "Yes", "No": "No", "Maybe": "Maybe"}
    assert len(o("Which cancer hallmarks?")) == 11
    assert o("No options here") == {}


def test_numbers(spark):
    assert one(spark, numeric.to_int(L(" 3.0 "))) == 3 and one(spark, numeric.to_int(L(""))) is None
    assert one(spark, numeric.age_months(L("2 Years"))) == 24 and one(spark, numeric.age_months(L("N/A"))) is None
    assert one(spark, numeric.celsius(L("98.6"), L("C"))) == pytest.approx(37) and one(spark, numeric.celsius(L("36"), L(None).cast("string"))) == 36
    assert one(spark, numeric.systolic(L("120/80"))) == 120 and one(spark, numeric.diastolic(L("80"))) == 80
    assert one(spark, numeric.age_years(L("2000-01-01").cast("date"), L("1999-01-01").cast("date"))) is None
    assert one(spark, numeric.cosine(F.array(L(0.0)), F.array(L(1.0)))) == 0
    assert one(spark, numeric.top_k(F.array(L(1.0), L(3.0), L(3.0)), 2)) == [2, 1]
    assert sum(one(spark, numeric.softmax(F.array(L(1.0), L(2.0))))) == pytest.approx(1)


def test_arrays(spark):
    assert one(spark, arrays.padded(F.array(L(1), L(2)), 3)) == [1, 2, 0] and one(spark, arrays.pad_mask(F.array(L(5)), 2)) == [1, 0]
    assert one(spark, arrays.multi_hot(F.array(L(1)), 3)) == [0, 1, 0]
    assert one(spark, arrays.ordered_distinct(F.array(F.struct(L(2).alias("position"), L("a").alias("value")), F.struct(L(1).alias("position"), L("b").alias("value")), F.struct(L(3).alias("position"), L("b").alias("value"))))) == ["b", "a"]
    df = spark.createDataFrame([(float("nan"), "a")], "x double, y string")
    assert arrays.jsonable(df).first().x is None
    assert [[x.id for x in r.rows] for r in arrays.batches(spark.range(7), 3, "id").orderBy("batch").collect()] == [[0, 1, 2], [3, 4, 5], [6]]


def test_overlap():
    assert overlap.bleu_score("the cat sat on the mat", "the cat sat on the mat") == pytest.approx(1)
    assert overlap.bleu_score("", "a") == 0 and overlap.bleu_score("x", "y") == 0
    r = overlap.rouge_scores("the cats sat", "the cat sat down")
    assert r[0] == pytest.approx(6 / 7) and r[2] == pytest.approx(6 / 7)
    assert [overlap.porter_stem(w) for w in ("caresses", "ponies", "relational", "hopping", "agreed", "happy", "conditional", "adjustment")] == ["caress", "poni", "relat", "hop", "agre", "happi", "condit", "adjust"]
    assert overlap.entity_f1_score("", "") == 1 and overlap.entity_f1_score("Aspirin 5mg", "Aspirin 5mg") == 1


def test_token_f1(spark):
    assert one(spark, overlap.token_f1(L("a a b"), L("b c"))) == pytest.approx(0.5)
    assert one(spark, overlap.token_f1(L(""), L(""))) == 1 and one(spark, overlap.token_f1(L("a"), L(""))) == 0


@settings(max_examples=400, deadline=None)
@given(st.sampled_from(["ab", "abcdefgh ", "aeiou bcdfgxyzKLM\n\U0001F600"]).flatmap(lambda letters: st.tuples(st.text(letters, max_size=260), st.text(letters, max_size=260), st.booleans())))
def test_ratio_and_subsequence_of_any_texts(case):
    a, b, copied = case
    b = a[: len(a) // 2] + b if copied else b
    assert overlap.similar(a, b) == difflib.SequenceMatcher(None, a, b).ratio()
    ranges = 0, len(a), 0, len(b)
    if a and b:  # both searches give the first longest run
        found = difflib.SequenceMatcher(None, a, b, autojunk=False).find_longest_match(*ranges)
        assert overlap._longest_run_bits(a, b)(*ranges) == overlap._longest_run_sparse(a, b, set())(*ranges) == tuple(found)
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    assert overlap._longest(list(a), list(b)) == row[-1]


def test_batch_measures_of_odd_texts(monkeypatch):
    """Nulls, empty texts, no words, one word, repeats; blocks of one pair and of all."""
    texts = [None, "", "  ", "...", "a", "a a a", "the cats sat on the mat", "The cat sat, on the mats!", "x " * 500, "the cats sat on the mat"]
    p, t = (pd.Series(x) for x in zip(*itertools.product(texts, texts), strict=True))
    for block in (1, 64, overlap.BLOCK):
        monkeypatch.setattr(overlap, "BLOCK", block)
        assert overlap.bleu.func(p, t).tolist() == pytest.approx([overlap.bleu_score(x, y) for x, y in zip(p, t, strict=True)], abs=1e-12)
        assert [tuple(r) for r in overlap.rouge.func(p, t).itertuples(index=False)] == [overlap.rouge_scores(x, y) for x, y in zip(p, t, strict=True)]
        assert overlap.entity_f1.func(p, t).tolist() == [overlap.entity_f1_score(x, y) for x, y in zip(p, t, strict=True)]
    empty = pd.Series([], dtype=object)
    assert len(overlap.bleu.func(empty, empty)) == len(overlap.rouge.func(empty, empty)) == 0


@pytest.mark.parametrize("split", [text.split_eligibility, text.split_criteria, text.split_protocol])
def test_criteria_headers_are_looked_for_once(spark, split):
    """Two headers, two searches in the plan, however often their places are used."""
    df = spark.createDataFrame([("Inclusion\na\nExclusion\nb",)], "c string").select(split(F.col("c")).alias("s")).select("s.inclusion", "s.exclusion")
    plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("rlike") == 2 and plan.count("split(") == 1
    assert df.count() == 1


@pytest.mark.parametrize("split", [text.split_eligibility, text.split_criteria, text.split_protocol])
def test_criteria_headers_are_looked_for_once(spark, split):
    """Two headers, two searches in the plan, however often their places are used."""
    df = spark.createDataFrame([("Inclusion\na\nExclusion\nb",)], "c string").select(split(F.col("c")).alias("s")).select("s.inclusion", "s.exclusion")
    plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("rlike") == 2 and plan.count("split(") == 1
    assert df.count() == 1
