"""WARC archives: writing, normalising and reading.

Archives are first written as monolithic gzip files (one member for the whole file), as some
crawlers leave them, each page a response record. The normaliser inflates such a file once, as
a stream, rewrites every record as a gzip member of its own, so that each can be read alone,
and writes a sidecar index (offset, length, record id, type, payload digest by line). Reading
takes the records back from the normalised archives by their index.

Records with equal payloads of at least LEAST_REVISIT bytes: that with the largest id is
the response, the others are revisit records, which refer to it and carry no payload. Writing
yields one narrow row a record (archive, place in it, id, digest, size); which records repeat a
payload is found on these rows alone, and the normaliser, which gets them by archive and place,
writes the revisit records. So pages themselves are never shuffled, whatever repeats.

Archives go to shared storage (any file system that pyarrow can open by URI) under names
that depend on the partition alone; each is written under a name of its own attempt and then
renamed, so a task that runs again replaces what it left. The normaliser fails if an archive
does not hold the records of its rows.

Nulls, ties, empty input: a null payload is the empty payload; a page without id is a record
`none`, it refers to the response of its payload if that has an id and is a response otherwise;
rows with equal id and payload are all responses; null urls are written as `urn:none`, other
urls percent-encoded where they hold spaces or control characters; an empty table gives no
archives. Very long payloads are held one record at a time. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import attach_groups, bounded_batches, materialise, shared_uri, trimmed

LEAST_REVISIT = 1000
LEVEL = 4
READ_BYTES = 1 << 20
DATE = "2024-01-01T00:00:00Z"
END = b"\r\n\r\n"


def refer(records: DataFrame) -> DataFrame:
    """Rows of write_archives() with refers: the id of the response for revisits, else null."""
    groups = records.where(F.col("bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("size")).where("size > 1 and keep is not null")
    groups = materialise(groups, "responses")
    rows = attach_groups(records, groups, ["digest"], records.count(), "size")
    return rows.withColumn("refers", F.when((F.col("bytes") >= LEAST_REVISIT) & ~F.col("keep").eqNullSafe(F.col("page_id")), F.col("keep"))).drop("keep", "size")


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def record_id(key: int | None) -> str:
    return f"<urn:page:{'none' if key is None else key}>"


def target(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url) if url else "urn:none"


def record(rid: str, uri: str, payload: bytes, digest: str, size: int, refers: str | None = None) -> bytes:
    """The bytes of one WARC record; a revisit has no block."""
    kind = "response" if refers is None else "revisit"
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {rid}\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: {uri}\r\nWARC-Payload-Digest: {digest}\r\nX-Payload-Length: {size}\r\n"
    if refers is not None:
        head += f"WARC-Refers-To: {refers}\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"
        payload = b""
    return f"{head}Content-Type: text/html\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload + END


def parse_head(head: bytes) -> dict[str, str]:
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}


def records(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, payload, whole record) of a stream of inflated bytes; holds one record at a time."""
    held = bytearray()

    def fill(n: int) -> bool:
        while len(held) < n:
            part = next(stream, None)
            if part is None:
                return False
            held.extend(part)
        return True

    while fill(1):
        at = held.find(END)
        while at < 0:
            if not fill(len(held) + 1):
                raise ValueError("a record's header has no end")
            at = held.find(END)
        headers = parse_head(bytes(held[:at]))
        start, size = at + len(END), int(headers["content-length"])
        if not fill(start + size + len(END)):
            raise ValueError("a record is cut short")
        yield headers, bytes(held[start : start + size]), bytes(held[: start + size + len(END)])
        del held[: start + size + len(END)]


def inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Inflates gzip bytes of one or many members, READ_BYTES at a time."""
    inflate = zlib.decompressobj(31)
    for chunk in chunks:
        while chunk:
            part = inflate.decompress(chunk, READ_BYTES)
            if part:
                yield part
            if inflate.eof:
                chunk, inflate = inflate.unused_data, zlib.decompressobj(31)
            else:
                chunk = inflate.unconsumed_tail


def chunks(source) -> Iterator[bytes]:
    while part := source.read(READ_BYTES):
        yield part


WRITTEN = pa.schema([("archive", pa.string()), ("place", pa.int64()), ("page_id", pa.int64()), ("digest", pa.binary()), ("bytes", pa.int64())])


def write_archives(pages: DataFrame, folder: str, payload: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """Writes one monolithic gzip archive a partition; returns a row a record (archive, place, page_id, digest, bytes), already materialised."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col(key).cast("long"), F.col(url).cast("string"), F.coalesce(F.col(payload).cast("string"), F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        name = f"{TaskContext.get().partitionId():06d}.warc.gz"
        draft, n = posixpath.join(base, f".{name}.{uuid.uuid4().hex}"), 0
        deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        with fs.open_output_stream(draft, compression=None) as out:
            for batch in itertools.chain([first], batches):
                found = []
                for i in range(batch.num_rows):
                    k, u, text = (c[i].as_py() for c in batch.columns)
                    body = text.encode("utf-8", "surrogatepass")
                    digest = hashlib.sha1(body)
                    out.write(deflate.compress(record(record_id(k), target(u), body, f"sha1:{digest.hexdigest()}", len(body))))
                    found.append((name, n + i, k, digest.digest(), len(body)))
                n += batch.num_rows
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), WRITTEN.types, strict=True)], schema=WRITTEN)
            out.write(deflate.flush())
        fs.move(draft, posixpath.join(base, name))

    return materialise(rows.mapInArrow(trimmed(run), "archive string, place long, page_id long, digest binary, bytes long"), "written")


def normalise(written: DataFrame, source: str, folder: str, remove: bool = False) -> DataFrame:
    """Rewrites each archive of source into folder, one gzip member a record, with its index; returns (archive, records, size).

    Narrow rows alone are shuffled. A task reads the rows of its archives in step with their records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (fs, base), (out_fs, out_base) = _open(source), _open(folder)
        out_fs.create_dir(out_base, recursive=True)
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for name, own in itertools.groupby(rows, key=lambda row: row[0]):
            tag, at, n = uuid.uuid4().hex, 0, 0
            drafts = [posixpath.join(out_base, f".{name}.{kind}.{tag}") for kind in ("warc", "index")]
            with fs.open_input_stream(posixpath.join(base, name), compression=None) as data, out_fs.open_output_stream(drafts[0], compression=None) as out, out_fs.open_output_stream(drafts[1], compression=None) as index:
                for (headers, _, whole), (_, _, key, refers) in zip(records(inflated(chunks(data))), own, strict=True):
                    rid, kind, digest = record_id(key), "response", headers["warc-payload-digest"]
                    if headers["warc-record-id"] != rid:
                        raise ValueError(f"{name}: record {n} is not {rid}")
                    if refers is not None:
                        kind = "revisit"
                        whole = record(rid, headers["warc-target-uri"], b"", digest, int(headers["x-payload-length"]), record_id(refers))
                    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    member = deflate.compress(whole) + deflate.flush()
                    out.write(member)
                    index.write(json.dumps([at, len(member), rid, kind, digest]).encode() + b"\n")
                    at, n = at + len(member), n + 1
            out_fs.move(drafts[0], posixpath.join(out_base, name))
            out_fs.move(drafts[1], posixpath.join(out_base, name + ".index"))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([at], pa.int64())], ["archive", "records", "size"])

    rows = refer(written).select("archive", "place", "page_id", "refers")
    archives = written.select("archive").distinct().count()
    dealt = rows.repartition(max(1, archives), "archive").sortWithinPartitions("archive", "place")
    done = materialise(dealt.mapInArrow(trimmed(run), "archive string, records long, size long"), "normalised")
    if remove:
        path = done.sparkSession._jvm.org.apache.hadoop.fs.Path(source)
        path.getFileSystem(done.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    return done


RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _number(uri: str | None) -> int | None:
    number = uri.strip("<>").rpartition(":")[2] if uri else "none"
    return None if number == "none" else int(number)


def read_archives(archives: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """One row a record, read member by member at the offsets of the index. Digest and size are those of the full payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                held: list[tuple] = []
                size = 0
                with fs.open_input_stream(posixpath.join(base, name + ".index"), compression=None) as index, fs.open_input_file(posixpath.join(base, name)) as data:
                    for line in lines(chunks(index)):
                        at, length, rid, kind, digest = json.loads(line)
                        data.seek(at)
                        headers, body, _ = next(records(iter([zlib.decompress(data.read(length), 31)])))
                        if headers["warc-record-id"] != rid:
                            raise ValueError(f"{name}: the index and the record at {at} differ")
                        if kind == "response" and f"sha1:{hashlib.sha1(body).hexdigest()}" != digest:
                            raise ValueError(f"{name}: the payload at {at} does not have its digest")
                        uri = headers["warc-target-uri"]
                        full = int(headers["x-payload-length"]) if kind == "revisit" else len(body)
                        held.append((_number(rid), None if uri == "urn:none" else uri, body if payloads else None, full, digest.partition(":")[2], kind, _number(headers.get("warc-refers-to"))))
                        size += len(body) if payloads else 0
                        if len(held) >= 1000 or size >= READ_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

    return archives.select("archive").repartition(max(1, archives.count()), "archive").mapInArrow(trimmed(run), RECORD)


def lines(parts: Iterator[bytes]) -> Iterator[bytes]:
    rest = b""
    for part in parts:
        *whole, rest = (rest + part).split(b"\n")
        yield from whole
    if rest:
        yield rest


def round_trip(pages: DataFrame, payload: str = "html", key: str = "page_id", url: str = "url", payloads: bool = False) -> DataFrame:
    """Writes, normalises and reads pages; the archives stay in the shared folder."""
    root = shared_uri(pages.sparkSession)
    tag = uuid.uuid4().hex
    raw, clean = f"{root}/warc-raw-{tag}", f"{root}/warc-{tag}"
    done = normalise(write_archives(pages, raw, payload, key, url), raw, clean, remove=True)
    return read_archives(done, clean, payloads)
