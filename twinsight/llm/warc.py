"""WARC archives: monolithic gzip in, a gzip member for each record and an offset index out.

Spark's own writers write every file, so archives go to any file system that
Spark writes to and only committed files count. The text writer ends each
value with a separator: CRLF ends a WARC record, and the zero byte ends a
gzip member, whose last byte is the top byte of a size below 2^24.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import new_path, remove, stage

#: Equal payloads of at least this many bytes are stored once.
REVISIT_BYTES = 1000
RECORDS_PER_FILE = 4000
DATE = "1970-01-01T00:00:00Z"
LEVEL = 6
#: Bytes inflated or collected at once.
CHUNK = 1 << 16
BATCH_BYTES = 4 << 20


def _uuid(page_id) -> Column:
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("none"))))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def records(pages: DataFrame) -> DataFrame:
    """(record string: a whole WARC/1.1 record less its last CRLF), one for each row of pages.

    Of rows with equal payloads of REVISIT_BYTES or more, that with the
    largest page_id is the response; rows that repeat it are responses too.
    The others become revisit records. Null html is an empty payload; a null
    url gets a urn. Other columns are not read.
    """
    known = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    known = known.select("*", F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("digest"))
    light = known.where(F.col("size") >= REVISIT_BYTES).groupBy("digest", "size")
    copied = light.agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null")
    copied = stage(copied.select("digest", "size", "first_id"), "copied")  # only payloads found twice
    joined = known.join(copied, ["digest", "size"], "left")
    revisit = F.coalesce(~F.col("first_id").eqNullSafe(F.col("page_id")), F.lit(False)) & F.col("first_id").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    text = lambda c: c.cast("string")
    uri = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20"), F.concat(F.lit("urn:page:"), F.coalesce(text(F.col("page_id")), F.lit("none"))))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _uuid(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"), line("WARC-Refers-To", _uuid(F.col("first_id"))), line("X-Refers-To-Page", text(F.col("first_id"))))).otherwise(F.lit("")),
        F.when(F.col("page_id").isNotNull(), line("X-Page", text(F.col("page_id")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", text(F.octet_length(block))),
    )
    return joined.select(F.concat(head, F.lit("\r\n"), block, F.lit("\r\n")).alias("record"))


def write_monolithic(pages: DataFrame, path: str, per_file: int = RECORDS_PER_FILE) -> str:
    """Writes WARC files that are one gzip stream each."""
    records(pages).write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)
    return path


def inflate(content: bytes) -> Iterator[bytes]:
    """The inflated content of a gzip file, however many members it has, piece by piece."""
    view, at = memoryview(content), 0
    while at < len(view):
        z = zlib.decompressobj(31)
        while not z.eof and at < len(view):
            piece = z.decompress(view[at : at + CHUNK])
            at += CHUNK if not z.eof else min(CHUNK, len(view) - at) - len(z.unused_data)
            if piece:
                yield piece
        if not z.eof:
            raise ValueError("gzip stream ends early")
        while at < len(view) and view[at] == 0:
            at += 1


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole WARC records, with their closing CRLFs, out of an inflated stream."""
    buffer, ended = bytearray(), False

    def more() -> bool:
        nonlocal ended
        piece = next(pieces, None)
        ended = piece is None
        if piece:
            buffer.extend(piece)
        return not ended

    while True:
        while (end := buffer.find(b"\r\n\r\n")) < 0 and more():
            pass
        if end < 0:
            if buffer.strip():
                raise ValueError("WARC stream ends within a header")
            return
        size = int(headers(bytes(buffer[:end]))["content-length"])
        whole = end + 4 + size + 4
        while len(buffer) < whole and more():
            pass
        if len(buffer) < whole:
            raise ValueError("WARC stream ends within a record")
        yield bytes(buffer[:whole])
        del buffer[:whole]


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def member(record: bytes, level: int = LEVEL) -> bytes:
    """A record as its own gzip member; its last byte is zero.

    A record of 2^24 bytes or more gets an empty member after it, which ends
    with a zero byte and inflates to nothing.
    """
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = z.compress(record) + z.flush()
    if out[-1]:
        empty = zlib.compressobj(level, zlib.DEFLATED, 31)
        out += empty.flush()
    return out


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["kind", "seq", "value"]
    index: list[bytes] = []
    seq = offset = held = 0
    values: list[bytes] = []

    def batch(kind: str, out: list[bytes], first: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(out)), pa.array(range(first, first + len(out)), pa.int64()), pa.array(out, pa.binary())], names)

    for files in batches:
        for content in files.column(0):
            for record in split_records(inflate(content.as_py())):
                head = headers(record[: record.index(b"\r\n\r\n")])
                packed = member(record)
                entry = {"offset": offset, "length": len(packed), "id": head["warc-record-id"], "type": head["warc-type"], "uri": head.get("warc-target-uri"), "digest": head.get("warc-payload-digest")}
                index.append(json.dumps(entry).encode())
                values.append(packed[:-1])
                offset += len(packed)
                held += len(packed)
                if held >= BATCH_BYTES:
                    yield batch("archive", values, seq)
                    seq, values, held = seq + len(values), [], 0
    if values:
        yield batch("archive", values, seq)
    for at in range(0, len(index), 10_000):
        yield batch("index", index[at : at + 10_000], at)


def normalise(spark: SparkSession, source: str, target: str) -> str:
    """Rewrites monolithic gzip archives with one member for each record, and writes a sidecar index.

    Each source file is inflated once, as a stream. A task writes its records
    to one file of target/kind=archive, under the name that Spark's writer
    commits; nothing is renamed. target/index has a JSON line (name, offset,
    length, id, type, uri, digest) for each record, `name` being the file's.
    No source files give no files.
    """
    files = spark.read.format("binaryFile").load(source).select("content")
    rows = files.mapInArrow(_normalise, "kind string, seq long, value binary").sortWithinPartitions("kind", "seq")
    rows.select(F.col("value").cast("string").alias("value"), "kind").write.option("lineSep", "\u0000").partitionBy("kind").text(target)
    # A task's archive and index have the same name; the writer's separator of members is no line end, so lines are written anew.
    lines = spark.read.schema("value string").option("lineSep", "\u0000").text(f"{target}/kind=index").select(_name().alias("name"), F.from_json("value", ENTRY).alias("e"))
    lines.select(F.to_json(F.struct("name", "e.*")).alias("value")).write.text(f"{target}/index")
    remove(spark, f"{target}/kind=index")
    return target


#: An index entry.
ENTRY = "offset long, length long, id string, type string, uri string, digest string"


def _name() -> Column:
    return F.element_at(F.split(F.input_file_name(), "/"), -1)


def _archives(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").load(f"{root}/kind=archive").select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def read_index(spark: SparkSession, root: str) -> DataFrame:
    """(name, offset, length, id, type, uri, digest) of every record under root."""
    return spark.read.schema(f"name string, {ENTRY}").json(f"{root}/index")


RECORD = "name string, offset long, length long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def parse(record: bytes) -> tuple:
    """(page_id, payload bytes, digest, type, refers_to) of a record; the payload is held against its digest."""
    end = record.index(b"\r\n\r\n")
    head = headers(record[:end])
    block = record[end + 4 : end + 4 + int(head["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    kind = head["warc-type"]
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of {head['warc-record-id']} doesn't match its digest")
    number = lambda k: int(head[k]) if k in head else None
    return number("x-page"), int(headers(http)["content-length"]), digest, kind, number("x-refers-to-page")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of whole archives, member by member."""
    schema = pa.schema([("name", pa.string()), *((k, pa.int64()) for k in ("offset", "length", "page_id", "payload_bytes")), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    for files in batches:
        for name, content in zip(files.column(0).to_pylist(), files.column(1), strict=True):
            view, at, rows = memoryview(content.as_buffer()), 0, []
            while at < len(view):
                z, parts, start = zlib.decompressobj(31), [], at
                while not z.eof:
                    if at >= len(view):
                        raise ValueError(f"{name} ends within a member")
                    parts.append(z.decompress(view[at : at + CHUNK]))
                    at = min(at + CHUNK, len(view))
                at -= len(z.unused_data)
                if record := b"".join(parts):
                    rows.append((name, start, at - start, *parse(record)))
                else:  # belongs to the record before it
                    rows[-1] = (*rows[-1][:2], at - rows[-1][1], *rows[-1][3:])
                if len(rows) > 5000:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows[:-1]], schema)
                    rows = rows[-1:]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)


def read_archives(spark: SparkSession, root: str) -> DataFrame:
    """Every record that archive and index agree on: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    files = _archives(spark, root)
    found = files.mapInArrow(_walk, RECORD)
    index = read_index(spark, root).select("name", "offset", "length", F.col("type").alias("record_type"))
    both = found.join(index, ["name", "offset", "length", "record_type"])
    return both.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def fetch(spark: SparkSession, root: str, ids: DataFrame) -> DataFrame:
    """(id, record binary) of the records whose `id` is in ids, cut out by their offsets."""
    wanted = read_index(spark, root).join(ids.select("id").distinct(), "id", "left_semi")
    places = wanted.groupBy("name").agg(F.collect_list(F.struct("id", "offset", "length")).alias("places"))
    files = _archives(spark, root)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, own in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                view = memoryview(content.as_buffer())
                got = [(p["id"], b"".join(inflate(bytes(view[p["offset"] : p["offset"] + p["length"]])))) for p in own]
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got]), pa.array([g[1] for g in got], pa.binary())], ["id", "record"])

    return files.join(places, "name").select("content", "places").mapInArrow(cut, "id string, record binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages as archives in the shared folder, normalises them, and reads them back."""
    spark = pages.sparkSession
    whole = write_monolithic(pages, new_path(spark, "warc-monolithic"))
    root = new_path(spark, "warc")
    if not pages.take(1):
        return spark.createDataFrame([], RECORD).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return read_archives(spark, normalise(spark, whole, root))


ORACLE_SQL = """
with p as (
  select page_id, coalesce(html, '') as payload from pages
), r as (
  select page_id, payload, strlen(payload)::bigint as payload_bytes, max(page_id) over (partition by payload) as first_id from p
)
select page_id, payload_bytes, sha1(payload) as payload_digest,
  case when payload_bytes >= 1000 and page_id <> first_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id <> first_id then first_id end as refers_to
from r
"""
