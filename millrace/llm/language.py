"""Language identification by compression.

Each language is a raw-content zstandard dictionary, texts of that language. Texts are
lower-cased and runs of other characters than letters become one space. A text, of whatever
length, is compressed in blocks of BLOCK_BYTES with every dictionary (optimal parsing, matches
from three bytes on, so that short texts tell languages apart too); the language whose
dictionary gives the smallest total wins. A text is rejected when the second best comes within
MIN_MARGIN of it (always on a tie), or when it has no letter.

Fitting reads a bounded sample: of at most LANGUAGES languages (those with most labelled
texts) about SAMPLE_DOCS documents each, chosen by a hash of their id, and of a document the
PASSAGE characters from a place that the hash gives (all of a shorter text); DICTIONARY_BYTES
of these are kept. All four bounds are parameters of fit(). Predicting reads every whole text.

Nulls, ties, empty input: a null text, or one without letters, is `und` with score 0 and
rejected; of languages with equal sizes the first in code-point order is predicted, and the
tie is rejected; without any labelled text everything is `und`. Repeated rows are judged each
for itself; very long texts are read block by block. Columns named __lang, __score or
__rejected are replaced, all others come out as they went in.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bounded_batches, trimmed

SAMPLE_DOCS = 150
DICTIONARY_BYTES = 96 * 1024
PASSAGE = 24 * 1024
LANGUAGES = 200
BLOCK_BYTES = 2048
LEVEL, MIN_MATCH, SEARCHES, WINDOW_LOG = 6, 3, 5, 17
SLICE_ROWS = 256
MIN_MARGIN = 0.005
UNKNOWN = "und"


def fit(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    docs_each: int = SAMPLE_DOCS,
    size: int = DICTIONARY_BYTES,
    passage: int = PASSAGE,
    languages: int = LANGUAGES,
) -> dict[str, bytes]:
    """A dictionary of at most size bytes a language, from about docs_each documents with letters; what reaches the driver has these bounds."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("order", F.pmod(F.xxhash64("key", F.lit("language")), F.lit(1 << 40)) / float(1 << 40))
    commonest = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages)
    counts = {r[0]: r[1] for r in commonest.collect()}
    if not counts:
        return {}
    bounds = F.create_map(*(x for name, n in counts.items() for x in (F.lit(name), F.lit(min(1.0, 1.5 * docs_each / n)))))
    chosen = rows.where(F.col("order") < F.try_element_at(bounds, F.col("lang")))
    place = F.floor(F.pmod(F.xxhash64("key", F.lit("passage")), F.lit(1 << 20)) / float(1 << 20) * (F.greatest(F.length("text") - passage, F.lit(0)) + 1))
    chosen = chosen.select("lang", "order", "key", F.substring("text", place.cast("int") + 1, F.lit(passage)).alias("text")).orderBy("lang", "order", "key", "text").collect()
    out: dict[str, bytes] = {}
    for r in chosen:
        if len(out.get(r.lang, b"")) < size:
            out[r.lang] = out.get(r.lang, b"") + letters_only(r.text)
    return {k: v[:size] for k, v in out.items()}


_NO_LETTERS = re.compile(r"[\W\d_]+")


def letters_only(text: str) -> bytes:
    return _NO_LETTERS.sub(" ", text.lower()).encode("utf-8", "surrogatepass")


_COMPRESSORS: dict[tuple, list] = {}


def _compressor(content: bytes):
    import zstandard

    params = zstandard.ZstdCompressionParameters(
        compression_level=LEVEL, min_match=MIN_MATCH, strategy=zstandard.STRATEGY_BTULTRA, window_log=WINDOW_LOG, search_log=SEARCHES, write_checksum=False, write_content_size=False, write_dict_id=False
    )
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=dictionary)


def _compressors(models: dict[str, bytes]) -> list:
    """(language, compressor), made once in each worker."""
    key = tuple((k, hash(v)) for k, v in models.items())
    if key not in _COMPRESSORS:
        _COMPRESSORS.clear()
        _COMPRESSORS[key] = [(n, _compressor(models[n])) for n in sorted(models)]
    return _COMPRESSORS[key]


def sizes(data: bytes, compressors: list) -> list[int]:
    """Compressed bytes by language."""
    blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
    return [sum(len(c.compress(b)) for b in blocks) for _, c in compressors]


def decide(found: list[int], names: list[str]) -> tuple[str, float, bool]:
    """(language, score, rejected) from the sizes by language."""
    order = sorted(range(len(found)), key=lambda i: (found[i], names[i]))
    best = found[order[0]]
    score = 1.0 / sum(math.pow(2.0, -min(60, found[i] - best)) for i in order)
    margin = found[order[1]] - best if len(order) > 1 else best
    return names[order[0]], score, margin <= MIN_MARGIN * best


def identify(docs: DataFrame, models: dict[str, bytes], text: str = "text") -> DataFrame:
    """docs, all columns unchanged, with __lang, __score and __rejected; small slices, so memory is bounded."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in {"__lang", "__score", "__rejected"}))
    shared = docs.sparkSession.sparkContext.broadcast(models)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _compressors(shared.value)
        names = [m[0] for m in made]
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(first, SLICE_ROWS)
                rows = [decide(sizes(letters_only(t), made), names) if made and t and any(map(str.isalpha, t)) else (UNKNOWN, 0.0, True) for t in part.column(at).to_pylist()]
                lang, score, rejected = zip(*rows, strict=True)
                added = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], [*part.schema.names, "__lang", "__score", "__rejected"])

    schema = T.StructType([*docs.schema.fields, T.StructField("__lang", T.StringType()), T.StructField("__score", T.DoubleType()), T.StructField("__rejected", T.BooleanType())])
    return docs.mapInArrow(trimmed(run), schema)


def training_rows(docs: DataFrame, key: str = "doc_id", folds: int = 4, held_out: int = 2) -> Column:
    """True for rows of the fold that is never learned from."""
    return F.pmod(F.crc32(F.coalesce(docs[key].cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == held_out
