"""Near-duplicate detection: MinHash bands find candidates, Odd sketches screen them, full sets confirm.

A document's set is its distinct w-word shingles (64-bit hashes; A-Z lower-cased). SAMPLES
MinHash values in BANDS bands of ROWS give candidates: a pair of similarity 0.75 shares no
band with probability (1 - 0.75**4)**32 = 5e-6. The samples are also folded into an Odd
sketch, a bitmap of SKETCH_BITS parities; the population count of the XOR of two sketches
gives the similarity of the samples, and pairs far below the threshold (SCREEN, more than
five standard deviations) are not looked at further. The rest are compared on full sets.

Skew: documents of equal sets are one node, known by the number of one of its rows, so ids
may repeat. In a bucket only pairs with a leader, its member of the smallest id, are tried
first, which is linear in its rows. Then connected components tell which buckets still hold
several components. These get two more leaders, the member with the most links so far and one
outside the largest component, tried with members of components other than the leader's, as a
link within a component joins nothing. In buckets that are open even then, the members outside
the largest component (the minors) are compared with all members of other components, each pair
only in the first band it shares and by finer sketches (FINE_SAMPLES samples, five standard
deviations again), which only the members of such buckets get. Members are dealt to blocks of
BLOCK, and only minors are copied, once a block, so a stray document in a large bucket costs as
many comparisons as the bucket has members; minors in turn are dealt to groups of GROUP. So no
pair limit drops a link, and buckets of copies that the leaders joined are never expanded. Large
buckets meet what is known of them by broadcast (at most HEAVY_GROUPS of them, see shared.py), and
the pairs of a leader are dealt to blocks of about LED, each with one copy of its set, so no task
holds a whole large bucket or all pairs of one leader.

Nulls, ties, empty input: a text without words has an empty set and no links, and takes no
part in any join; a row without id is returned unlinked; rows of one id are documents of their
own, linked by their texts. An empty table gives none. Very long texts are read whole, one at
a time. near_duplicates() reads no other column; drop_near_duplicates() returns all columns
unchanged, and only names beginning with two underscores (__handle, __gone) are its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import attach_groups, bounded_batches, hashed_words, materialise, mix64, release, sieve, sieved, text_chunks, trimmed

BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
SCREEN = 0.2
FINE_SAMPLES, FINE_BITS, FINE_SCREEN = 4096, 8192, 0.0375
FINE_ROWS = 256
BLOCK, GROUP = 512, 8192
#: Pairs of one leader that are compared in one task.
LED = 256
CHUNK_BYTES, CHUNK_ROWS = 1 << 20, 1024

_RANDOM = np.random.Generator(np.random.PCG64(20_240_229))
_FACTORS = _RANDOM.integers(1 << 62, 1 << 63, FINE_SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 1 << 63, FINE_SAMPLES, dtype=np.uint64)
_SALTS = _RANDOM.integers(0, 1 << 63, FINE_SAMPLES, dtype=np.uint64)
_PLACES = _RANDOM.integers(1 << 62, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle."""
    words, owner = hashed_words(data, offsets)
    n_docs = len(offsets) - 1
    bounds = np.searchsorted(owner, np.arange(n_docs + 1))
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for j in range(width):
        rolled += words[j : j + len(rolled)] * _PLACES[j]
    rolled = mix64(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            short = np.add.reduce(words[a:b] * _PLACES[: b - a], keepdims=True)
            out.append(mix64(short ^ np.uint64(0x5851F42D4C957F2D + b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], samples: int = SAMPLES) -> np.ndarray:
    """MinHash values of each non-empty set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), samples), np.uint64)
    for i in range(samples):
        out[:, i] = np.minimum.reduceat(flat * _FACTORS[i] + _SHIFTS[i], starts)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(samples), BANDS)).copy()
    for r in range(ROWS):
        keys = mix64(keys ^ samples[:, r::ROWS])
    return keys


def odd_sketches(samples: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity bitmaps of the (sample number, value) pairs, as 64-bit words."""
    at = (mix64(samples ^ _SALTS[: samples.shape[1]]) % np.uint64(bits)).astype(np.int64)
    at += np.arange(len(samples))[:, None] * bits
    counts = np.bincount(at.ravel(), minlength=len(samples) * bits)
    return np.packbits((counts & 1).astype(np.uint8).reshape(len(samples), bits), axis=1).view(">i8").astype(np.int64)


def sketch_similarity(a: str, b: str, samples: int = SAMPLES, bits: int = SKETCH_BITS) -> F.Column:
    """Similarity of the samples of two sketches, from the number of differing bits."""
    differing = F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (t, x) -> t + x)")
    load = F.lit(1.0) - 2.0 * differing / bits
    return F.when(load <= 0.0, F.lit(0.0)).otherwise(1.0 + bits / (4.0 * samples) * F.log(load))


def set_keys(sets: list[np.ndarray]) -> list[bytes | None]:
    """A 128-bit name of each non-empty set."""
    return [hashlib.blake2b(s, digest_size=16).digest() if len(s) else None for s in sets]


def _describe(width: int):
    """From (id, text, handle) batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(1), CHUNK_BYTES, CHUNK_ROWS):
                sets = shingle_sets(data, offsets, width)
                full = [i for i, s in enumerate(sets) if len(s)]
                bands, sketches = ([None] * len(sets) for _ in range(2))
                if full:
                    samples = signatures([sets[i] for i in full])
                    for i, b, s in zip(full, band_keys(samples).view(np.int64), odd_sketches(samples), strict=True):
                        bands[i], sketches[i] = b, s
                longs = pa.list_(pa.int64())
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(set_keys(sets), pa.binary()), pa.array(bands, longs), pa.array(sketches, longs)],
                    ["doc_id", "handle", "n_shingles", "set_key", "bands", "sketch"],
                )

    return run


def _from_sets(width: int, column: str, make):
    """From (node, set_key, text) batches: node and make(sets) of each row whose text has the set of this name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(2), CHUNK_BYTES, CHUNK_ROWS):
                sets = shingle_sets(data, offsets, width)
                part = batch.slice(first, end - first)
                own = [i for i, (name, key) in enumerate(zip(part.column(1).to_pylist(), set_keys(sets), strict=True)) if name == key]
                made = make([sets[i] for i in own]) if own else []
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own, pa.int64())), pa.array(made, pa.list_(pa.int64()))], ["node", column])

    return run


def _members(sets: list[np.ndarray]) -> list[np.ndarray]:
    return [s.view(np.int64) for s in sets]


def _fine_sketches(sets: list[np.ndarray]) -> list[np.ndarray]:
    return [s for i in range(0, len(sets), FINE_ROWS) for s in odd_sketches(signatures(sets[i : i + FINE_ROWS], FINE_SAMPLES), FINE_BITS)]


def components(edges: DataFrame) -> DataFrame:
    """A written table with (node, component) for every node of edges (a, b): the smallest node it is connected with.

    Alternates large-star and small-star steps (Kiveris et al. 2014): each is a minimum per
    node, pre-aggregated, and a lookup of it, for which nodes with very many edges are broadcast.
    The minima of the large-star step also tell when every component is a star, and then are the
    result. edges is read several times.
    """
    pairs, done = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u < v"), []
    below, above = F.max(F.when(F.col("u") < F.col("v"), F.col("u"))), F.max("u") > F.col("v")
    star = (F.min("u") > F.col("v")) | ((below == F.min("u")) & ~above)
    moved = lambda rows: rows.select(F.col("u").alias("v"), F.col("component").alias("u")).where("u < v")
    while True:
        n = pairs.count()
        both = pairs.union(pairs.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("component"), F.count("*").alias("n"), star.alias("star"))
        low = materialise(low.withColumnRenamed("v", "node"), "components")
        if low.where("not star").isEmpty():
            release(*done)
            return low
        large = materialise(moved(attach_groups(both, low.withColumnRenamed("node", "v"), ["v"], 2 * n, "n").where("u > v")), "large")
        release(low, *done)
        least = large.groupBy("v").agg(F.min("u").alias("component"), F.count("*").alias("n"))
        small = attach_groups(large, least, ["v"], n, "n")
        pairs = materialise(moved(small).union(small.select("v", F.col("component").alias("u"))).distinct(), "edges")
        done = [pairs]
        release(large)


def _screened(percent: int, sa: str, sb: str, na: str, nb: str) -> F.Column:
    """False only for pairs whose set sizes or sketches rule a link out."""
    sizes = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
    return sizes & (sketch_similarity(sa, sb) >= max(0.0, percent / 100 - SCREEN))


class _Linker:
    """docs: (handle, text); nodes: (node, doc_id, handle, set_key, n_shingles, bands, sketch)."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, width: int, percent: int):
        self.docs, self.nodes, self.width, self.percent = docs, nodes, width, percent

    def from_texts(self, wanted: DataFrame, column: str, make) -> DataFrame:
        """(node, column) of the wanted nodes, made of their sets: texts are found by handle, sets confirmed by name."""
        named = materialise(wanted.join(self.nodes.select("node", "handle", "set_key"), "node"), "wanted")
        texts = sieve(self.docs, "handle", named.select("handle")).join(named, "handle").select("node", "set_key", "text")
        out = materialise(texts.mapInArrow(trimmed(_from_sets(self.width, column, make)), f"node long, {column} array<long>"), column)
        more = out.count() > named.count()
        release(named)
        if more:  # rows of equal id and text
            out, several = materialise(out.dropDuplicates(["node"]), column), out
            release(several)
        return out

    def confirmed(self, likely: DataFrame) -> DataFrame:
        """The pairs (a, b, na, nb) whose full sets are similar enough.

        a may be in any number of pairs: they are dealt to blocks of about LED by b, and the set of a
        is sent once to each block.
        """
        wanted = likely.select(F.col("a").alias("node")).union(likely.select(F.col("b").alias("node"))).distinct()
        sets = self.from_texts(wanted, "shingles", _members)
        blocks = materialise(likely.groupBy("a").agg(F.count("*").alias("pairs")).withColumn("blocks", F.ceil(F.col("pairs") / LED).cast("int")), "blocks")
        dealt = attach_groups(likely, blocks, ["a"], likely.count(), "pairs").withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
        heads = blocks.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).join(sets.withColumnsRenamed({"node": "a", "shingles": "xa"}), "a")
        members = dealt.select("a", "block", "b", "na", "nb").join(sets.withColumnsRenamed({"node": "b", "shingles": "xb"}), "b")
        common = F.size(F.array_intersect("xa", "xb"))
        links = materialise(members.join(heads, ["a", "block"]).where(100 * common >= self.percent * (F.col("na") + F.col("nb") - common)).select("a", "b"), "links")
        release(likely, sets, blocks)
        return links

    def led(self, rows: DataFrame, leaders: DataFrame) -> DataFrame:
        """Links of bucket members (key, node, c) with the leaders of their bucket (key, size, leaders: of (node, c)) that are of another component c.

        a is the leader of a pair and b the member, which is in no more pairs than it has buckets and leaders.
        """
        n_rows = rows.count()
        pairs = attach_groups(rows, leaders, ["key"], n_rows, "size").where("leaders is not null")
        pairs = pairs.select("node", "c", F.explode("leaders").alias("l")).where("c <> l.c").select(F.col("l.node").alias("a"), F.col("node").alias("b"))
        pairs = pairs.groupBy(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b")
        pairs = materialise(pairs, "pairs")
        side = lambda x: self.nodes.select(F.col("node").alias(x), F.col("sketch").alias(f"s{x}"), F.col("n_shingles").alias(f"n{x}"))
        heads = materialise(pairs.groupBy("a").agg(F.count("*").alias("pairs")).join(side("a"), "a"), "heads")
        seen = attach_groups(pairs, heads, ["a"], n_rows, "pairs").join(side("b"), "b").where(_screened(self.percent, "sa", "sb", "na", "nb"))
        likely = materialise(seen.select("a", "b", "na", "nb"), "likely")
        release(pairs, heads)
        return self.confirmed(likely)

    def open_buckets(self, rows: DataFrame, labels: DataFrame) -> DataFrame:
        """(key, node, c, major, size, blocks, groups): members of the buckets that hold several components, with their component and the bucket's largest."""
        named = rows.join(labels.select("node", "component"), "node", "left").select("key", "node", F.coalesce("component", "node").alias("c"))
        sizes = named.groupBy("key", "c").agg(F.count("*").alias("n"))
        # Of all buckets, so that large ones whose members are all of one component are known as large too.
        shape = sizes.groupBy("key").agg(F.max_by("c", F.struct("n", "c")).alias("major"), F.sum("n").alias("size"), F.max("n").alias("most"))
        shape = shape.select("key", "major", "size", (F.col("most") < F.col("size")).alias("open"), F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("size") - F.col("most")) / GROUP).cast("int").alias("groups"))
        shape = materialise(shape, "shape")
        out = materialise(attach_groups(named, shape, ["key"], rows.count(), "size").where("open").drop("open"), "open")
        release(shape)
        return out

    def between(self, left: DataFrame) -> DataFrame:
        """Links between components that share a bucket, of open_buckets(): its minors with all members of other components."""
        fine = self.from_texts(left.select("node").distinct(), "fine", _fine_sketches)
        sketched = left.join(self.nodes.select("node", "sketch", "n_shingles", "bands"), "node").join(fine, "node")
        columns = ("node", "c", "sketch", "fine", "n_shingles", "bands")
        up_to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        at = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
        x = sketched.where("c <> major").select("key", up_to("blocks").alias("block"), at("groups", "group").alias("part"), *(F.col(c).alias(f"{c}_a") for c in columns))
        y = sketched.select("key", at("blocks", "block").alias("block"), up_to("groups").alias("part"), (F.col("c") == F.col("major")).alias("is_major"), *(F.col(c).alias(f"{c}_b") for c in columns))
        first_shared = F.expr("filter(zip_with(bands_a, bands_b, (p, q) -> if(p = q, p, null)), p -> p is not null)[0] = x.key")
        apart = (F.col("c_a") != F.col("c_b")) & (F.col("is_major") | (F.col("node_a") < F.col("node_b"))) & _screened(self.percent, "sketch_a", "sketch_b", "n_shingles_a", "n_shingles_b")
        near = sketch_similarity("fine_a", "fine_b", FINE_SAMPLES, FINE_BITS) >= max(0.0, self.percent / 100 - FINE_SCREEN)
        x, y = x.alias("x"), y.alias("y")
        same = (F.col("x.key") == F.col("y.key")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.part") == F.col("y.part"))
        pairs = x.join(y, same & apart & first_shared & near).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), F.col("n_shingles_a").alias("na"), F.col("n_shingles_b").alias("nb"))
        likely = materialise(pairs, "likely")
        release(fine)
        return self.confirmed(likely)

    def run(self) -> DataFrame:
        rows = self.nodes.select(F.explode("bands").alias("key"), "node", "doc_id")
        by_hash = F.struct(F.xxhash64("node").alias("h"), "node", "c")
        leaders = lambda *names: F.array(*(F.struct(f"{x}.node", f"{x}.c") for x in names)).alias("leaders")
        first = F.min(F.struct("doc_id", "node", F.col("node").alias("c")))
        lead = rows.groupBy("key").agg(F.count("*").alias("size"), first.alias("first")).where("size > 1")
        lead = materialise(lead.select("key", "size", leaders("first")), "leaders")
        rows = materialise(attach_groups(rows, lead.select("key", "size"), ["key"], BANDS * self.nodes.count(), "size").where("size is not null").drop("size"), "buckets")
        links = self.led(rows.withColumn("c", F.col("node")), lead)
        labels = components(links)
        open_ = self.open_buckets(rows, labels)
        release(lead, rows)
        if open_.isEmpty():
            release(links, open_)
            return labels
        # Again where components are left: led by the member with the most links so far, and by one of the minors.
        ends = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("links"))
        most = F.max(F.struct(F.coalesce("links", F.lit(0)).alias("n"), "node", "c"))
        lead = open_.join(ends, "node", "left").groupBy("key").agg(F.first("size").alias("size"), most.alias("first"), F.min(F.when(F.col("c") != F.col("major"), by_hash)).alias("second"))
        lead = materialise(lead.select("key", "size", leaders("first", "second")), "leaders")
        release(links)
        links = self.led(open_.select("key", "node", "c"), lead)
        labels = self.joined(labels, links)
        left = self.open_buckets(open_.select("key", "node"), labels)
        release(lead, open_)
        links = self.between(left)
        release(left)
        return self.joined(labels, links)

    def joined(self, labels: DataFrame, links: DataFrame) -> DataFrame:
        """components() of a graph whose components were labels, with more links; both tables are released.

        Each component is a star around its label, so only what the links join has to move.
        """
        out = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links.select("a", "b")))
        release(labels, links)
        return out


def _found(docs: DataFrame, text: str, key: str, width: int, percent: int) -> DataFrame:
    """One row a document: doc_id, handle, n_shingles, component_id, kept."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"), handle(key, text).alias("handle"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.mapInArrow(trimmed(_describe(width)), f"doc_id {kind}, handle long, n_shingles long, set_key binary, bands array<long>, sketch array<long>")
    rows = materialise(rows.withColumn("node", F.monotonically_increasing_id()), "described")
    n_rows = rows.count()
    linked = rows.where("set_key is not null and doc_id is not null")
    # The node of a set is its row of the smallest id.
    sets = linked.groupBy("set_key").agg(F.min(F.struct("doc_id", "node")).alias("least"), F.count("*").alias("copies")).select("set_key", "least.doc_id", "least.node", "copies")
    sets = materialise(sets, "nodes")
    nodes = materialise(rows.join(sets.select("node"), "node", "left_semi").select("node", "doc_id", "handle", "set_key", "n_shingles", "bands", "sketch"), "sketches")
    joined = _Linker(docs.select("handle", "text"), nodes, width, percent).run().select("node", "component")
    least = joined.join(sets.select("node", "doc_id"), "node").groupBy("component").agg(F.min(F.struct("doc_id", "node")).alias("first"))
    labels = joined.join(least, "component").select("node", "first")
    named = sets.join(labels, "node", "left").select("set_key", F.coalesce("first.doc_id", "doc_id").alias("component"), F.coalesce("first.node", "node").alias("stays"), "node", "copies")
    named = materialise(named.where("copies > 1 or stays <> node").select("set_key", "component", "stays", "copies"), "named")
    release(nodes, sets)
    narrow = rows.select("doc_id", "handle", "node", "n_shingles", "set_key")
    whole = attach_groups(narrow.where("set_key is not null"), named, ["set_key"], n_rows, "copies")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = whole.select("doc_id", "handle", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id").isNull() | (F.col("stays") == F.col("node")), F.lit(True)).alias("stays"))
    bare = narrow.where("set_key is null").select("doc_id", "handle", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("stays"))
    return out.unionByName(bare).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def handle(key: str, text: str) -> F.Column:
    """A 64-bit name of a row, by which it is found again."""
    return F.xxhash64(F.col(key), F.col(text).cast("string"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, percent: int = 75) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (smallest id reachable over links), kept (it is this id)."""
    return _found(docs, text, key, width, percent).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, percent: int = 75) -> DataFrame:
    """docs without the documents that are linked with one of smaller id (of equal ids one row stays), all columns unchanged.

    Rows that certainly stay pass straight through; the others meet the list of those that go by
    (id, text) handle. Rows of equal id and text go or stay as one.
    """
    found = _found(docs, text, key, width, percent)
    fate = found.where("doc_id is not null").groupBy("handle").agg(F.max("stays").alias("__stays")).where("not __stays")
    gone = materialise(fate.select(F.col("handle").alias("__gone")), "dropped")
    marked = sieved(docs.withColumn("__handle", handle(key, text)), "__handle", gone, "__maybe")
    alone = marked.where("not __maybe").select(*docs.columns)
    rest = marked.where("__maybe").join(gone, F.col("__handle") == F.col("__gone"), "left_anti").select(*docs.columns)
    return alone.unionByName(rest)
