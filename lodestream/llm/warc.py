"""WARC archives of web pages: written as real archive files, read back with segment reassembly.

Writing.  Of the pages with equal payloads the one with the smallest id is a response and the others are revisits that
refer to it; payloads under ``MIN_SHARED`` bytes are always responses.  The body of a response is framed in chunks as HTTP/1.1 sends it.
A block longer than ``SEGMENT`` code points is split: its first record carries segment number 1, and continuation records carry the origin's
identifier, their number and, in the last, the total length.  Spark's text writer puts the records into files, with the blank lines that end
a record as its line separator, so the archives go wherever Spark can write and are committed like any output.

Every row has a serial number, written with its payload and digest before anything else, so the id of a record is known wherever it is
referred to: ``WARC-Refers-To`` of a revisit is the ``WARC-Record-ID`` of a response, ``WARC-Segment-Origin-ID`` that of a first segment.  The number of
the page referred to is in a header field of its own.  Spark's text writer gzips a file as a whole, so other readers can stream the
archives but not seek in them.

Reading.  Files are inflated once and parsed record by record along their content lengths.  Continuations are grouped by origin, put in order of
their number and checked against the total length; only blocks that were split are shuffled.  Then the chunked framing is decoded and the
digest verified.  A file holds at most ``RECORDS`` records of bounded length, so no task reads an unbounded file.

Defined results: null and empty pages have the empty payload; repeated rows of one page id count as that page, so all are responses where
the page is; a page without an id is archived without a page header, never referred to, and a response unless a page with an id has its payload; an
empty table writes no records; ids need not be unique or dense.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import dropped_at_exit, scratch_path, written

MIN_SHARED = 100
#: Code points of a block that go into one record, and code points in a transfer chunk.
SEGMENT = 16_384
CHUNK = 4_096
RECORDS = 400
#: Line ends of the format, and its end of a record (fixed values).
CRLF = "\r\n"
RECORD_END = CRLF + CRLF
VERSION = "WARC/1.1"
GZIP = b"\x1f\x8b"
DATE = "2024-01-01T00:00:00Z"


def roles(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url") -> DataFrame:
    """``serial, page_id, url, payload, payload_bytes, payload_digest, refers_to, refers_serial``; the last two are null for a response.

    Digests are counted by partial aggregation; only those that two pages or more share are joined back.
    """
    digested = pages.select(
        F.monotonically_increasing_id().alias("serial"), F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload")
    ).withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    digested = written(digested, "pages")  # serials are given once
    known = digested.filter((F.col("payload_bytes") >= MIN_SHARED) & F.col("page_id").isNotNull())
    shared = known.groupBy("payload_digest").agg(F.min(F.struct("page_id", "serial")).alias("first"), F.max("page_id").alias("last"))
    # written, so that the planner knows its size, and a payload of very many pages can be split over tasks
    shared = written(shared.filter("first.page_id < last").select("payload_digest", "first"), "shared-payloads")
    later = F.col("page_id") > F.col("first.page_id")
    return digested.join(shared, "payload_digest", "left").select(
        "serial", "page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(later, F.col("first.page_id")).alias("refers_to"), F.when(later, F.col("first.serial")).alias("refers_serial")
    )


def _lines(*fields: tuple[str, Column | str]) -> Column:
    """Header lines; a field with a null value is left out."""
    parts = [F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value.cast("string"), F.lit(CRLF)) for name, value in fields]
    return F.concat_ws("", *parts)


def _uri(serial: Column, segment: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), serial.cast("string"), F.lit(":"), segment.cast("string"), F.lit(">"))


def _chunked(body: Column) -> Column:
    """A body in chunked transfer framing."""
    pieces = F.transform(
        F.sequence(F.lit(0), F.ceil(F.length(body) / CHUNK).cast("int") - 1),
        lambda i: _chunk(F.substring(body, i * CHUNK + 1, F.lit(CHUNK))),
    )
    return F.concat(F.when(F.length(body) > 0, F.array_join(pieces, "")).otherwise(F.lit("")), F.lit("0" + CRLF + CRLF))


def _chunk(piece: Column) -> Column:
    return F.concat(F.lower(F.hex(F.octet_length(piece))), F.lit(CRLF), piece, F.lit(CRLF))


def records(pages: DataFrame) -> DataFrame:
    """The records of :func:`roles`, one string each (column ``value``), without their ends."""
    http = F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF)
    response = F.concat(http, F.lit("Transfer-Encoding: chunked" + RECORD_END), _chunked(F.col("payload")))
    revisit = F.concat(http, F.lit("Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(RECORD_END))
    block = F.when(F.col("refers_to").isNull(), response).otherwise(revisit)
    fields = ("serial", "page_id", "url", "payload_digest", "refers_to", "refers_serial")
    whole = pages.select(*fields, block.alias("block"))
    cut = whole.select("*", F.ceil(F.length("block") / SEGMENT).cast("int").alias("parts"), F.octet_length("block").alias("total"))
    pieces = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct((i + 1).alias("number"), F.substring("block", i * SEGMENT + 1, F.lit(SEGMENT)).alias("piece")))
    each = cut.select(*fields, "parts", "total", F.explode(pieces).alias("p")).select("*", "p.number", "p.piece")
    first = F.col("number") == 1
    split = F.col("parts") > 1
    header = _lines(
        ("WARC-Type", F.when(~first, F.lit("continuation")).when(F.col("refers_to").isNull(), F.lit("response")).otherwise(F.lit("revisit"))),
        ("WARC-Record-ID", _uri(F.col("serial"), F.col("number"))),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", F.regexp_replace("url", "[\\r\\n]+", " ")),
        ("WARC-Page-ID", F.col("page_id")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        ("WARC-Refers-To", F.when(F.col("refers_to").isNotNull(), _uri(F.col("refers_serial"), F.lit(1)))),
        ("WARC-Refers-To-Page-ID", F.col("refers_to")),
        ("WARC-Profile", F.when(F.col("refers_to").isNotNull(), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ("WARC-Segment-Number", F.when(split, F.col("number"))),
        ("WARC-Segment-Origin-ID", F.when(~first, _uri(F.col("serial"), F.lit(1)))),
        ("WARC-Segment-Total-Length", F.when(split & (F.col("number") == F.col("parts")), F.col("total"))),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", F.octet_length("piece")),
    )
    return each.select(F.concat(F.lit(VERSION + CRLF), header, F.lit(CRLF), F.col("piece")).alias("value"))


def write(pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url") -> None:
    """Write one archive file per task and ``RECORDS`` records into the folder ``path``, gzipped."""
    found = records(roles(pages, id_col, payload_col, url_col))
    found.write.option("lineSep", RECORD_END).option("maxRecordsPerFile", RECORDS).option("compression", "gzip").text(path)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record of an archive, which may be gzipped."""
    if archive[:2] == GZIP:
        archive = gzip.decompress(archive)
    at = 0
    while at < len(archive):
        end = archive.index(RECORD_END.encode(), at)
        lines = archive[at:end].decode().split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record begins at byte {at}")
        header = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
        start = end + len(RECORD_END)
        stop = start + int(header["content-length"])
        if archive[stop : stop + len(RECORD_END)] != RECORD_END.encode():
            raise ValueError(f"the record at byte {at} does not end where its length says")
        yield header, archive[start:stop]
        at = stop + len(RECORD_END)


def unchunk(body: bytes) -> bytes:
    """Decode chunked transfer framing; a body that breaks off or has the wrong framing raises."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(parts)
        parts.append(body[at : at + size])
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is shorter or longer than its size says")
        at += size + 2


def payload_of(block: bytes) -> tuple[bytes, int]:
    """The decoded HTTP body and its length; for a block of headers alone, the length that they state."""
    head, _, body = block.partition(RECORD_END.encode())
    fields = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in head.decode().split(CRLF)[1:])}
    if fields.get("transfer-encoding") == "chunked":
        body = unchunk(body)
        return body, len(body)
    return body, int(fields.get("content-length", len(body)))


def _fields(header: dict[str, str]) -> tuple[str, int | None, str, int | None]:
    """Type, page (null where the record names none), stated digest and reference of a record."""
    reference, page = header.get("warc-refers-to-page-id"), header.get("warc-page-id")
    return header["warc-type"], None if page is None else int(page), header["warc-payload-digest"].removeprefix("sha256:"), None if reference is None else int(reference)


def _decoded(kind: str, page: int | None, stated: str, refers_to: int | None, block: bytes) -> tuple:
    """A result row of a whole block; a response must match the digest that it states."""
    body, size = payload_of(block)
    if kind == "response" and hashlib.sha256(body).hexdigest() != stated:
        raise ValueError(f"the payload of page {page} does not match its digest")
    return page, size, stated, kind, refers_to, body if kind == "response" else None


_PAYLOAD = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
#: What parsing gives: decoded rows of whole blocks (``number`` is null, ``body`` the payload), and the segments of split ones (``body`` the piece).
_PARSED = pa.schema(
    [
        ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("body", pa.binary()),
    ]
)


def _sql(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about 4 MB; the last field is what takes the room."""
    out: list[tuple] = []
    held = 0
    for row in rows:
        out.append(row)
        held += 200 + len(row[-1] or b"")
        if held > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def parsed(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Every record of the archives under ``path`` as one row, from one pass over the files."""

    def row(header: dict[str, str], block: bytes) -> tuple:
        kind, page, digest, refers_to = _fields(header)
        if "warc-segment-number" in header:
            total = header.get("warc-segment-total-length")
            origin = header.get("warc-segment-origin-id", header["warc-record-id"])
            return page, None, digest, kind, refers_to, origin, int(header["warc-segment-number"]), int(total) if total else None, block
        *decoded, body = _decoded(kind, page, digest, refers_to, block)
        return *decoded, None, None, None, body if with_payload else None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for archive in batch.column("content"):
                for header, block in parse(archive.as_py()):
                    yield row(header, block)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt*").load(path).select("content")
    return files.mapInArrow(lambda batches: _batches(rows(batches), _PARSED), _sql(_PARSED))


def segments(records: DataFrame) -> DataFrame:
    """Of :func:`parsed` the records of blocks that were split: type, page, digest, reference, origin, number, total length (of the last) and piece."""
    return records.filter("number is not null").select("record_type", "page_id", F.col("payload_digest").alias("digest"), "refers_to", "origin", "number", "total", F.col("body").alias("block"))


def reassembled(pieces: DataFrame) -> DataFrame:
    """Whole blocks of :func:`segments`: ``record_type, page_id, digest, refers_to, block``; missing, repeated or short segments raise.

    A group holds the segments of one block, so it is as large as one page.
    """
    parts = pieces.groupBy("origin").agg(
        F.max("page_id").alias("page_id"),
        F.max("digest").alias("digest"),
        F.max("refers_to").alias("refers_to"),
        F.max(F.when(F.col("number") == 1, F.col("record_type"))).alias("record_type"),
        F.max("total").alias("total"),
        F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts"),
    )
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p["block"]))
    in_order = F.col("parts.number") == F.sequence(F.lit(1), F.size("parts"))
    joint = parts.select("record_type", "page_id", "digest", "refers_to", joined.alias("block"), "total", in_order.alias("in_order"))
    sound = F.coalesce((F.octet_length("block") == F.col("total")) & F.col("in_order") & F.col("record_type").isNotNull(), F.lit(False))
    checked = F.when(sound, F.col("block")).otherwise(F.raise_error(F.concat(F.lit("segments do not add up for page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))).cast("binary"))
    return joint.select("record_type", "page_id", "digest", "refers_to", checked.alias("block"))


def read(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Read archives back: ``page_id, payload_bytes, payload_digest, record_type, refers_to`` and, on request, ``payload`` (null for revisits).

    Unsplit blocks are decoded where they are parsed; split ones are reassembled first.
    """
    schema = _PAYLOAD if with_payload else pa.schema(list(_PAYLOAD)[:-1])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for *fields, block in zip(*(batch.column(c).to_pylist() for c in ("record_type", "page_id", "digest", "refers_to")), batch.column("block"), strict=True):
                    row = _decoded(*fields, block.as_py())
                    yield row if with_payload else (*row[:-1], None)

        for out in _batches(rows(), _PAYLOAD):
            yield out.select(schema.names)

    records = written(parsed(spark, path, with_payload), "records")  # parsed once, read by both ways
    whole = records.filter("number is null").withColumnRenamed("body", "payload").select(*schema.names)
    return whole.unionByName(reassembled(segments(records)).mapInArrow(decode, _sql(schema)))


def round_trip(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url") -> DataFrame:
    """Write the pages to archives in the shared folder and read these back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(pages, path, id_col, payload_col, url_col)
    dropped_at_exit(spark, path)
    return read(spark, path)
