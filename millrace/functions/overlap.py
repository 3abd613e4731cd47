"""Text-overlap measures: token F1 as columns; BLEU, ROUGE and fuzzy entity matching as Arrow UDFs.

The UDFs take whole Arrow batches: n-grams of all texts of a block are counted together in numpy, and the two measures that
need an alignment (longest common subsequence, Ratcliff-Obershelp ratio) keep a row of comparisons in the bits of one integer.
A null text counts as empty. Blocks hold about BLOCK characters, so memory is bounded by that and the longest pair.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import normalize_text


def token_f1(prediction: Column, target: Column) -> Column:
    """F1 of the token sets of the normalised texts: both empty 1, one empty 0."""
    tokens = lambda t: F.array_distinct(F.filter(F.split(normalize_text(t), r"\s+"), lambda w: w != ""))
    p, t = tokens(prediction), tokens(target)
    common = F.size(F.array_intersect(p, t))
    return (
        F.when((F.size(p) == 0) & (F.size(t) == 0), 1.0)
        .when((F.size(p) == 0) | (F.size(t) == 0) | (common == 0), 0.0)
        .otherwise(2.0 * common / (F.size(p) + F.size(t)))
    )


def similarity(cosine: Column) -> Column:
    """A cosine held to 0 to 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), cosine))


_PUNCTUATION, _NOT_WORD = re.compile(r"[^\w\s]+"), re.compile(r"[^a-z0-9]+")

#: Characters of a block of pairs whose n-grams are counted together.
BLOCK = 1 << 21
#: Comparisons (characters of one text times those of the other) that the bits of one integer hold at most: 4 MB.
CELLS = 1 << 25
#: Longest second text whose places are kept as bits.
WIDEST = 1 << 12


def _tokens(text: str | None) -> list[str]:
    return _PUNCTUATION.sub("", (text or "").lower()).split()


def _grams(tokens: list[str], n: int) -> Counter:
    return Counter(zip(*(tokens[i:] for i in range(n)), strict=False))


def bleu_score(prediction: str | None, target: str | None, orders: int = 4, epsilon: float = 0.1) -> float:
    """Sentence BLEU, equal weights, one reference; orders without a match count epsilon (Papineni 2002; Chen and Cherry 2014, method 1)."""
    p, t = _tokens(prediction), _tokens(target)
    if not p or not t or not set(p) & set(t):
        return 0.0
    total = 0.0
    for n in range(1, orders + 1):
        found = _grams(p, n)
        common = sum((found & _grams(t, n)).values())
        total += math.log((common or epsilon) / max(1, sum(found.values())))
    brevity = 1.0 if len(p) > len(t) else math.exp(1 - len(t) / len(p))
    return brevity * math.exp(total / orders)


class _Letters(dict):
    def __missing__(self, code: int) -> str:
        return "c"


_LETTERS = _Letters({ord(v): "v" for v in "aeiou"})


@lru_cache(maxsize=1 << 16)
def _shape(word: str) -> str:
    """c for each consonant, v for each vowel; y is a vowel behind a consonant."""
    shape = word.translate(_LETTERS)
    at = word.find("y", 1)
    while at > 0:
        if shape[at - 1] == "c":
            shape = f"{shape[:at]}v{shape[at + 1 :]}"
        at = word.find("y", at + 1)
    return shape


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _short(word: str) -> bool:
    return len(word) > 2 and _shape(word).endswith("cvc") and word[-1] not in "wxy"


# Suffix tables of the published algorithm (Porter 1980), fixed values.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
_LONGEST_FIRST = [tuple(sorted(table, key=len, reverse=True)) for table in (_STEP2, _STEP3, _STEP4)]


@lru_cache(maxsize=1 << 16)
def porter_stem(word: str) -> str:
    """The stem of a lower-case word (Porter 1980)."""
    w = word
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                if _has_vowel(w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                        w = w[:-1]
                    elif _measure(w) == 1 and _short(w):
                        w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table, ends in zip((_STEP2, _STEP3), _LONGEST_FIRST, strict=False):
        for end in ends if w.endswith(ends) else ():
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + table[end]
                break
    for end in _LONGEST_FIRST[2] if w.endswith(_LONGEST_FIRST[2]) else ():
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def _rouge_tokens(text: str | None) -> list[str]:
    return [porter_stem(t) if len(t) > 3 else t for t in _NOT_WORD.split((text or "").lower()) if t]


def _f(common: int, p: int, t: int) -> float:
    return 2.0 * common / (p + t) if common else 0.0


def _longest(a: list, b: list) -> int:
    """Length of the longest common subsequence, a row of the table at a time as bits (Crochemore and others 2001)."""
    shared = set(a) & set(b)
    a, b = [x for x in a if x in shared], [x for x in b if x in shared]
    where: dict = {}
    for j, y in enumerate(b):
        where[y] = where.get(y, 0) | 1 << j
    full = row = (1 << len(b)) - 1
    for x in a:
        hit = row & where[x]
        row = (row + hit | row - hit) & full
    return len(b) - row.bit_count()


def rouge_scores(prediction: str | None, target: str | None) -> tuple[float, float, float]:
    """F-measures of ROUGE-1, ROUGE-2 and ROUGE-L over stemmed tokens."""
    p, t = _rouge_tokens(prediction), _rouge_tokens(target)
    grams = [_f(sum((_grams(p, n) & _grams(t, n)).values()), max(0, len(p) - n + 1), max(0, len(t) - n + 1)) for n in (1, 2)]
    return grams[0], grams[1], _f(_longest(p, t), len(p), len(t))


def _matched(a: str, b: str) -> int:
    """Characters in the matching blocks that difflib finds.

    Like there, a character that makes up over 1 % of a text b of 200 or more starts no run and only prolongs one.
    """
    often = {c for c in set(b) if b.count(c) > len(b) // 100 + 1} if len(b) >= 200 else set()
    dense = not often and len(b) <= WIDEST and len(a) * len(b) <= CELLS
    longest = _longest_run_bits(a, b) if dense else _longest_run_sparse(a, b, often)
    total = 0
    open_ = [(0, len(a), 0, len(b))]
    while open_:
        alo, ahi, blo, bhi = open_.pop()
        i, j, k = longest(alo, ahi, blo, bhi)
        if often:
            while i > alo and j > blo and a[i - 1] == b[j - 1]:
                i, j, k = i - 1, j - 1, k + 1
            while i + k < ahi and j + k < bhi and a[i + k] == b[j + k]:
                k += 1
        if k:
            total += k
            if alo < i and blo < j:
                open_.append((alo, i, blo, j))
            if i + k < ahi and j + k < bhi:
                open_.append((i + k, ahi, j + k, bhi))
    return total


def _places(text: str, c: str) -> list[int]:
    found, at = [], text.find(c)
    while at >= 0:
        found.append(at)
        at = text.find(c, at + 1)
    return found


Run = Callable[[int, int, int, int], tuple[int, int, int]]


def _longest_run_bits(a: str, b: str) -> Run:
    """The first longest common run of two ranges as (start in a, start in b, length).

    Bit i * width + j of one integer says that a[i] equals b[j], so shifting by width + 1 steps along all diagonals at once,
    in doubling steps. The lowest bit that is left is the first of the longest runs, first in a and then in b.
    """
    bits, one = dict.fromkeys(a, 0), 1
    for c in b:
        if c in bits:
            bits[c] |= one
        one <<= 1

    def longest(alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        if ahi - alo == 1:
            j = b.find(a[alo], blo, bhi)
            return alo, max(j, blo), int(j >= 0)
        if bhi - blo == 1:
            i = a.find(b[blo], alo, ahi)
            return max(i, alo), blo, int(i >= 0)
        part, size = a[alo:ahi], (bhi - blo) // 8 + 1
        width, inside = 8 * size, (1 << bhi - blo) - 1  # one bit more than the range at least, so no run goes on in the next row
        rows = {c: (bits[c] >> blo & inside).to_bytes(size, "little") for c in set(part)}
        cells = int.from_bytes(b"".join(map(rows.__getitem__, part)), "little")
        if not cells:
            return alo, blo, 0
        runs, k = [cells], 1
        while found := runs[-1] & runs[-1] >> k * (width + 1):
            runs.append(found)
            k *= 2
        left, step = runs.pop(), k
        while runs:
            step //= 2
            if found := left & runs.pop() >> k * (width + 1):
                left, k = found, k + step
        i, j = divmod((left & -left).bit_length() - 1, width)
        return alo + i, blo + j, k

    return longest


def _longest_run_sparse(a: str, b: str, often: set[str]) -> Run:
    """The same from the places that match at all, for long texts in which most characters start no run."""
    where = {c: _places(b, c) for c in (set(a) & set(b)) - often}
    at = sorted(i for c in where for i in _places(a, c))

    def longest(alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        best, before, ends = (alo, blo, 0), -1, {}
        for i in at[bisect_left(at, alo) : bisect_left(at, ahi)]:
            places = where[a[i]]
            runs = ends if i == before + 1 else {}
            ends, before = {}, i
            for j in places[bisect_left(places, blo) : bisect_left(places, bhi)]:
                k = ends[j] = runs.get(j - 1, 0) + 1
                if k > best[2]:
                    best = i - k + 1, j - k + 1, k
        return best

    return longest


def similar(a: str | None, b: str | None) -> float:
    """Ratcliff-Obershelp ratio, as difflib gives it."""
    a, b = a or "", b or ""
    return 1.0 if a == b else 2.0 * _matched(a, b) / (len(a) + len(b))


def _may_be_similar(a: str, b: str, least: float) -> bool:
    """False if the lengths or the shared letters rule out a ratio above least."""
    bound = least * (len(a) + len(b)) / 2
    return min(len(a), len(b)) > bound and sum(min(a.count(c), b.count(c)) for c in set(a)) > bound


def default_entities(text: str) -> list[str]:
    """Runs of capitalised words, and words with digits: stands in for a trained recogniser."""
    return [m.lower() for m in re.findall(r"\b(?:[A-Z][\w-]+(?:\s+[A-Z][\w-]+)*|\w*\d\w*)\b", text)]


def entity_f1_score(prediction: str | None, target: str | None, entities: Callable[[str], list[str]] = default_entities, least: float = 0.8) -> float:
    """F1 of a greedy one-to-one matching, equal ones first, then the most similar above least."""
    return _entity_f1(list(dict.fromkeys(entities(prediction or ""))), list(dict.fromkeys(entities(target or ""))), least)


def _entity_f1(p: list[str], t: list[str], least: float) -> float:
    if not t:
        return 0.0 if p else 1.0
    free, hits = list(t), 0
    rest = []
    for x in p:
        if x in free:
            free.remove(x)
            hits += 1
        else:
            rest.append(x)
    for x in rest:
        near = ((similar(x, y), -i) for i, y in enumerate(free) if _may_be_similar(x, y, least))
        ratio, at = max(near, default=(0.0, 0))
        if ratio > least:
            del free[-at]
            hits += 1
    return _f(hits, len(p), len(t))


def _blocks(predictions: pd.Series, targets: pd.Series) -> Iterator[tuple[list[str], list[str]]]:
    p, t = predictions.fillna("").tolist(), targets.fillna("").tolist()
    start = size = 0
    for i, (x, y) in enumerate(zip(p, t, strict=True)):
        size += len(x) + len(y)
        if size >= BLOCK:
            yield p[start : i + 1], t[start : i + 1]
            start, size = i + 1, 0
    if start < len(p):
        yield p[start:], t[start:]


def _coded(texts: list[str], tokens: Callable[[str], list[str]]) -> list[list[int]]:
    """Tokens of each text as numbers, equal for equal tokens; a text that comes twice is split once."""
    ids: dict[str, int] = {}
    seen = {text: [ids.setdefault(w, len(ids)) for w in tokens(text)] for text in dict.fromkeys(texts)}
    return [seen[text] for text in texts]


def _common(p: list[list[int]], t: list[list[int]], orders: int) -> np.ndarray:
    """[order, pair]: n-grams of p that are in t too, each at most as often as there.

    `at` are the places where both ends of the next n-gram are n-grams that the pair shares; no other can be shared.
    """
    lengths = np.array([len(x) for x in (*p, *t)])
    words = np.fromiter(chain.from_iterable((*p, *t)), dtype=np.int64, count=lengths.sum())
    rows = np.repeat(np.arange(len(lengths)), lengths)
    pairs, ours = rows % len(p), rows < len(p)
    grams, at, found = words.copy(), np.arange(len(words)), np.zeros((orders, len(p)), dtype=np.int64)
    kinds = int(words.max(initial=0)) + 1
    for n in range(orders):
        if n:
            follows = np.zeros(len(words) + 1, dtype=bool)
            follows[at] = True
            at = at[follows[at + 1]]
            at = at[rows[at] == rows[at + n]] if len(at) else at
            grams[at] = pd.factorize(grams[at] * kinds + words[at + n])[0]
        key = pairs[at] * (int(grams[at].max(initial=0)) + 1) + grams[at]
        code, keys = pd.factorize(key)
        counts = np.minimum(*(np.bincount(code[side], minlength=len(keys)) for side in (ours[at], ~ours[at])))
        found[n] = np.bincount(keys // (int(grams[at].max(initial=0)) + 1), counts, len(p))
        at = at[counts[code] > 0]
    return found


@F.pandas_udf(T.DoubleType())
def bleu(predictions: pd.Series, targets: pd.Series) -> pd.Series:
    """bleu_score() of each pair, counted by block."""
    scores = []
    for p, t in _blocks(predictions, targets):
        coded = _coded(p + t, _tokens)
        p, t = coded[: len(p)], coded[len(p) :]
        common = _common(p, t, 4)
        sizes = np.array([len(x) for x in p]), np.array([len(x) for x in t])
        orders = np.maximum(1, sizes[0] - np.arange(4)[:, None])
        brevity = np.exp(np.minimum(0.0, 1 - sizes[1] / np.maximum(1, sizes[0])))
        scores.append(np.where(common[0] > 0, brevity * np.exp(np.log(np.where(common > 0, common, 0.1) / orders).mean(axis=0)), 0.0))
    return pd.Series(np.concatenate(scores) if scores else [], dtype=float)


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("rouge1", "rouge2", "rougeL")]))
def rouge(predictions: pd.Series, targets: pd.Series) -> pd.DataFrame:
    """rouge_scores() of each pair, counted by block."""
    scores = [np.zeros((0, 3))]
    for p, t in _blocks(predictions, targets):
        coded = _coded(p + t, _rouge_tokens)
        p, t = coded[: len(p)], coded[len(p) :]
        one, two = _common(p, t, 2)
        scores.append(np.array([[_f(c1, len(x), len(y)), _f(c2, len(x) - 1, len(y) - 1), _f(_longest(x, y), len(x), len(y))] for x, y, c1, c2 in zip(p, t, one.tolist(), two.tolist(), strict=True)]))
    return pd.DataFrame(np.concatenate(scores), columns=["rouge1", "rouge2", "rougeL"])


@F.pandas_udf(T.DoubleType())
def string_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similar(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def entity_f1(predictions: pd.Series, targets: pd.Series) -> pd.Series:
    """entity_f1_score() of each pair; the entities of a text that comes twice in a block are looked up once."""
    scores = []
    for p, t in _blocks(predictions, targets):
        found = {text: list(dict.fromkeys(default_entities(text))) for text in dict.fromkeys(p + t)}
        scores += [_entity_f1(found[x], found[y], 0.8) for x, y in zip(p, t, strict=True)]
    return pd.Series(scores, dtype=float)
