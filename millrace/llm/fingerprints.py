"""Document fingerprints from closed syncmers, with DataFrame functions only.

A text is read as units: runs of up to UNIT characters other than white space, or single
characters of scripts written without spaces. A K-mer is K successive units; its inner
S-mers are hashed, and it is a closed syncmer if the smallest of them is the first or the
last. Whether it is chosen depends on the K-mer alone, not on its surroundings, so the same
passage gives the same anchors in any document and at any place.

anchors() gives them with positions, match_offsets() aligns two documents by them. The
fingerprint is all anchors of the text in order, WIDTH hex digits each: the first is the
distance from the anchor before (in units; at most K - S, as K - S successive K-mers always
hold a closed syncmer), the others are 32 bits of the anchor's hash. So it holds positions
too, and grows with the text. Likeness matches positions: an anchor counts as the same where
the anchor before it has the same hash and stands at the same distance, wherever both stand in
their texts. It is the resemblance of the two sets of such links (shared by all distinct ones),
exact, without a sample.

Nulls, ties, empty input: a null or blank text has the empty fingerprint; a text of fewer
than K units, or of K or K + 1 units without a closed syncmer, has one anchor, the hash of all
its units. Two empty fingerprints are alike (1.0), an empty and another one are not (0.0).
Documents of equal id follow each other in the order of their texts' hashes, equal rows in
any; documents without id come last; an empty table gives an empty result. Very long texts
are read whole. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, S = 5, 2
UNIT = 32
WIDTH = 9
UNIT_PATTERN = rf"[\p{{IsHan}}\p{{IsHiragana}}\p{{IsKatakana}}\p{{IsThai}}]|[^\x20\x09-\x0D\p{{IsHan}}\p{{IsHiragana}}\p{{IsKatakana}}\p{{IsThai}}]{{1,{UNIT}}}"


def with_smers(docs: DataFrame, text: str) -> DataFrame:
    """docs with __smers, the hashes of the text's successive pairs of units (S = 2; one hash of all if fewer than K units), and __size.

    In steps, so that each is computed once.
    """
    rows = docs.withColumn("__units", F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(UNIT_PATTERN), F.lit(0)))
    rows = rows.withColumn("__units", F.transform("__units", lambda u: F.xxhash64(u))).withColumn("__size", F.size("__units"))
    pairs = F.slice(F.zip_with("__units", F.slice("__units", 2, 1 << 30), lambda a, b: F.xxhash64(a, b)), F.lit(1), F.col("__size") - 1)
    whole = F.slice(F.array(F.xxhash64("__units")), F.lit(1), F.col("__size"))
    rows = rows.withColumn("__smers", F.when(F.col("__size") < K, whole).otherwise(pairs)).drop("__units")
    return rows.withColumn("__size", F.size("__smers"))


def without(smer: str, size: str) -> Column:
    """Whether K or K + 1 units have no closed syncmer: each K-mer's smallest S-mer is an inner one."""
    open_ = lambda i: f"least({smer}[{i}], {smer}[{i + 3}]) > least({smer}[{i + 1}], {smer}[{i + 2}])"
    return F.expr(f"case {size} when {K - S + 1} then {open_(0)} when {K - S + 2} then {open_(0)} and {open_(1)} else false end")


def anchors(smer: str, size: str) -> Column:
    """array<struct<position, hash>> of the closed syncmers; smer: a column of smers(), size: its length."""
    one = F.transform(F.col(smer), lambda h: F.struct(F.lit(0).alias("position"), h.alias("hash")))
    inner = K - S
    g = lambda i: f"{smer}[i + {i}]"
    rest = ", ".join(g(j) for j in range(1, inner))
    chosen = F.expr(
        f"filter(transform(sequence(0, greatest({size} - {inner + 1}, 0)), i -> "
        f"if(least({g(0)}, {g(inner)}) <= least({rest}), struct(i as position, xxhash64({g(0)}, {g(1)}, {g(inner)}) as hash), null)), x -> x is not null)"
    )
    return F.when(F.col(size) <= 1, one).when(without(smer, size), F.array(F.struct(F.lit(0).alias("position"), F.xxhash64(smer).alias("hash")))).otherwise(chosen)


def entries(docs: DataFrame, text: str, name: str) -> DataFrame:
    """docs with a column name: the anchors of the text in order, as numbers: distance from the one before, then 32 bits of the hash."""
    inner = K - S
    g = lambda i: f"__smers[i + {i}]"
    rest = ", ".join(g(j) for j in range(1, inner))
    rows = with_smers(docs, text)
    # In steps, so that each is computed once.
    rows = rows.withColumn("__at", F.expr(f"filter(if(__size > {inner}, sequence(0, __size - {inner + 1}), cast(array() as array<int>)), i -> least({g(0)}, {g(inner)}) <= least({rest}))"))
    low = "& 4294967295L"
    chosen = F.expr(f"transform(__at, (i, k) -> shiftleft(cast(i - if(k = 0, 0, __at[k - 1]) as bigint), 32) | (xxhash64({g(0)}, {g(1)}, {g(inner)}) {low}))")
    one = F.expr(f"transform(__smers, h -> h {low})")
    whole = F.array(F.expr(f"xxhash64(__smers) {low}"))
    rows = rows.withColumn(name, F.when(F.col("__size") <= 1, one).when(without("__smers", "__size"), whole).otherwise(chosen))
    return rows.drop("__smers", "__size", "__at")


def as_text(found: str) -> Column:
    return F.expr(f"array_join(transform({found}, e -> lpad(lower(hex(e)), {WIDTH}, '0')), '')")


def links(found: str) -> Column:
    """Hashes of each anchor with its distance from the one before and that one's hash."""
    return F.expr(f"array_distinct(transform({found}, (e, k) -> xxhash64(if(k = 0, -1L, {found}[k - 1] & 4294967295L), e)))")


def likeness(a: str, b: str) -> Column:
    """Resemblance of two columns of links, 0 to 1."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / union).cast("double")


def document_anchors(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(id, anchors) of each document, for match_offsets()."""
    return with_smers(docs.select(F.col(key).alias("id"), F.col(text).alias("__text")), "__text").select("id", anchors("__smers", "__size").alias("anchors"))


def match_offsets(left: DataFrame, right: DataFrame) -> DataFrame:
    """Aligns documents by their anchors: (left_id, right_id, shift, matches), the commonest shift of each pair.

    Both sides: (id, anchors). An anchor that is frequent on both sides gives many pairs; use it
    for chosen documents, not for all against all.
    """
    a = left.select(F.col("id").alias("left_id"), F.inline("anchors")).withColumnRenamed("position", "p")
    b = right.select(F.col("id").alias("right_id"), F.inline("anchors")).withColumnRenamed("position", "q")
    shifts = a.join(b, "hash").groupBy("left_id", "right_id", (F.col("q") - F.col("p")).alias("shift")).count()
    best = F.max(F.struct("count", (-F.abs("shift")).alias("near"), "shift")).alias("best")
    return shifts.groupBy("left_id", "right_id").agg(best).select("left_id", "right_id", "best.shift", F.col("best.count").alias("matches"))


def dealt_with_guests(docs: DataFrame, key: str) -> DataFrame:
    """docs with __b, a range of the key, and __guest: each row once (0) in the partition of its range, and the row that heads a range once more (1), behind the range above.

    One shuffle of the rows. The number of ranges is the number of shuffle partitions, so what reaches
    the driver (one key a range) is bounded.
    """
    spark = docs.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted({int(x) for x in docs.approxQuantile(key, [i / parts for i in range(1, parts)], 0.2 / parts)})
    side = max(1, int(len(cuts) ** 0.5))
    coarse, fine = cuts[::side], [cuts[i : i + side] for i in range(0, len(cuts), side)]
    at = F.col(key)
    longs = lambda xs: F.array(*(F.lit(x) for x in xs))  # noqa: E731  folded to one literal

    def bucket() -> Column:
        """Number of cuts at or below the key: a coarse count, then one within."""
        if not cuts:
            return F.lit(0)
        arrays = F.array(*(longs(f) for f in fine))
        block = F.size(F.filter(longs(coarse), lambda c: c <= at))
        return F.when(block == 0, F.lit(0)).otherwise((block - 1) * side + F.size(F.filter(F.element_at(arrays, F.greatest(block, F.lit(1))), lambda c: c <= at)))

    head = F.struct(F.col(key).alias("key"), F.col("__tie").alias("tie"))
    dealt = docs.withColumn("__bucket", F.coalesce(bucket(), F.lit(-1)))
    tops = [(r[0], r[1][0], r[1][1]) for r in dealt.groupBy("__bucket").agg(F.max(head)).orderBy("__bucket").collect()]
    above = [(b, top, tie, tops[(i + 1) % len(tops)][0]) for i, (b, top, tie) in enumerate(tops)]
    heads = spark.createDataFrame(above, f"__own int, __top {docs.schema[key].dataType.simpleString()}, __top_tie long, __above int")
    dealt = dealt.join(F.broadcast(heads), (F.col("__bucket") == F.col("__own")) & at.eqNullSafe(F.col("__top")) & (F.col("__tie") == F.col("__top_tie")), "left")
    places = F.filter(F.array(F.struct(F.col("__bucket").alias("__b"), F.lit(0).alias("__guest")), F.struct(F.col("__above").alias("__b"), F.lit(1).alias("__guest"))), lambda x: x["__b"].isNotNull())
    return dealt.select(*docs.columns, F.inline(places)).repartition("__b")


def edited_fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row a document: its fingerprint, and that of the text whose last third is replaced by the next document's first third.

    Texts are shuffled once; fingerprints are made behind the shuffle.
    """
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("__tie", F.xxhash64("text"))
    rows = entries(dealt_with_guests(plain, "doc_id"), "text", "own")
    order = Window.partitionBy("__b").orderBy("__guest", F.col("doc_id").desc_nulls_last(), F.col("__tie").desc())
    rows = rows.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in ("text", "own"))).where("__guest = 0")
    n_chars = F.length("text")
    third = F.floor(n_chars / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n_chars - third), F.substring("next_text", F.lit(1), third)))
    rows = rows.select("doc_id", n_chars.cast("long").alias("n_chars"), "edited", "own", "next_own")
    rows = entries(rows, "edited", "other")
    rows = rows.withColumns({"own_links": links("own"), "other_links": links("other"), "next_links": links("next_own")})
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text("own").alias("fingerprint"),
        as_text("other").alias("edited_fingerprint"),
        likeness("own_links", "other_links").alias("near_edited"),
        likeness("own_links", "next_links").alias("near_next"),
    )
