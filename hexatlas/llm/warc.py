"""Web archives: write WARC records, resolve repeated payloads to revisits, write them out again.

Records are written with Spark's text writer: a record ends with two line ends, which is the
writer's line separator, so a written part file is a plain (or gzipped) WARC/1.0 file and any
store that Spark writes to will do. They are read with Spark's binary-file reader and cut by
``Content-Length``, never by looking for a marker in a payload. A writer task makes several
files of at most ``RECORDS_PER_FILE`` records, and a reader task holds one file at a time.

Headers alone are shuffled by digest. What changes goes back to the archives as one row a file,
and the task that reads a file writes its records again. A small table of changes is sent to the
files; a large one is met with them by path, which moves the archives as they are, compressed.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hexatlas.llm.base import query, table
from hexatlas.session import scratch_path, written

CRLF = "\r\n"
RECORDS_PER_FILE = 2000
LEAST_PAYLOAD = 1000
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
BATCH_BYTES = 4 << 20
#: A gzip member leaves at most so many bytes to be looked at again.
GZIP_STEP = 1 << 16

HEADERS = ("record_id string, record_type string, target_uri string, date string, page_id long, "
           "payload_digest string, payload_bytes long, refers_to_id string, refers_to_page long")
RECORDS = HEADERS + ", payload binary"
#: Where a record stands: its archive, and its number there from 0.
PLACES = HEADERS + ", file string, at int"


def _clean(value: Column) -> Column:
    """A header value: one line of text, whatever the column holds; null is empty."""
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[\r\n]+", " ")


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value."""
    return F.coalesce(F.concat(F.lit(name + ": "), value, F.lit(CRLF)), F.lit(""))


def record_text(page_id: Column, kind: Column, url: Column, date: Column, payload: Column, digest: Column,
                payload_bytes: Column, refers_to: Column, own_id: Column | None = None,
                refers_to_id: Column | None = None) -> Column:
    """One WARC record as text, without the two line ends that close it.

    ``digest`` is the bare hex SHA-1 of the whole payload; a revisit keeps it and has no block.
    ``own_id`` and ``refers_to_id`` are record ids; unless given they are made from the page
    ids, so a task that runs again writes the same record.
    """
    block = F.when(kind == "revisit", F.lit("")).otherwise(F.coalesce(payload, F.lit("")))
    own_id = record_id(page_id) if own_id is None else own_id
    refers_to_id = record_id(refers_to) if refers_to_id is None else refers_to_id
    return F.concat(
        F.lit("WARC/1.0" + CRLF),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", F.concat(F.lit("<"), own_id, F.lit(">"))),
        _line("WARC-Date", date),
        _line("WARC-Target-URI", _clean(url)),
        _line("X-Page-ID", page_id.cast("string")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        _line("X-Payload-Length", payload_bytes.cast("string")),
        _line("WARC-Refers-To", F.when(kind == "revisit", F.concat(F.lit("<"), refers_to_id, F.lit(">")))),
        _line("X-Refers-To-Page-ID", F.when(kind == "revisit", refers_to.cast("string"))),
        _line("WARC-Profile", F.when(kind == "revisit", F.lit(PROFILE))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF), block)


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")))


def write_archives(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write a frame of one text column, a record each, as archive files below ``path``."""
    (records.write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", RECORDS_PER_FILE)
     .option("compression", compression).text(path))


def _bytes_of(content: bytes) -> bytes:
    """The archive's bytes; gzip members one after the other are unpacked."""
    if content[:2] != b"\x1f\x8b":
        return content
    parts, view, at = [], memoryview(content), 0
    while at < len(content):
        one = zlib.decompressobj(wbits=31)
        while at < len(content) and not one.eof:
            parts.append(one.decompress(view[at:at + GZIP_STEP]))
            at = min(at + GZIP_STEP, len(content))
        at -= len(one.unused_data)
    return b"".join(parts)


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of an archive."""
    data, at = _bytes_of(content), 0
    while True:
        while data[at:at + 2] == b"\r\n":
            at += 2
        if at >= len(data):
            return
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines if ":" in x)}
        size = int(fields["content-length"])
        yield fields, data[end + 4:end + 4 + size]
        at = end + 4 + size


def _digest(value: str | None) -> str | None:
    """Bare lower-case hex of a ``sha1:`` digest, given in hex or in base 32."""
    if not value:
        return None
    bare = value.rpartition(":")[2]
    if re.fullmatch("[0-9a-fA-F]{40}", bare):
        return bare.lower()
    try:
        return base64.b32decode(bare.upper()).hex()
    except binascii.Error:
        return bare


def _row(fields: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    kind = fields.get("warc-type")
    number = lambda k: int(fields[k]) if fields.get(k) else None
    bare = lambda k: (fields.get(k) or "").strip("<>") or None
    digest = hashlib.sha1(block).hexdigest() if kind == "response" else _digest(fields.get("warc-payload-digest"))
    length = len(block) if kind == "response" else number("x-payload-length")
    row = (bare("warc-record-id") or f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, repr(sorted(fields.items())))}",
           kind, fields.get("warc-target-uri"), fields.get("warc-date"), number("x-page-id"),
           digest, length, bare("warc-refers-to"), number("x-refers-to-page-id"))
    return (*row, block) if with_payload else row


def _frames(rows: Iterator[tuple[tuple, int]], names: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of rows, each a few MB by the bytes given with them, so that a file never stands in memory twice."""
    out, held = [], 0
    types = {c: "Int64" for c in ("page_id", "payload_bytes", "refers_to_page")}
    for row, size in rows:
        out.append(row)
        held += size
        if held >= BATCH_BYTES:
            yield pd.DataFrame(out, columns=names).astype(types)
            out, held = [], 0
    if out:
        yield pd.DataFrame(out, columns=names).astype(types)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.format("binaryFile").option("pathGlobFilter", "part-*")
            .schema("path string, modificationTime timestamp, length long, content binary").load(path)
            .select(F.col("path").alias("file"), "content"))


def read_archives(spark: SparkSession, path: str, payloads: bool) -> DataFrame:
    """Records of all archives below ``path``: headers and either the block or their places.

    The digest and length of a response are taken from the bytes read, those of a revisit from
    its header fields.
    """
    schema = RECORDS if payloads else PLACES
    names = [x.split()[0] for x in schema.split(", ")]

    def rows(batch: pd.DataFrame) -> Iterator[tuple[tuple, int]]:
        for file, content in zip(batch["file"], batch["content"]):
            for at, (fields, block) in enumerate(parse(content)):
                row = _row(fields, block, payloads)
                yield (row, len(block)) if payloads else ((*row, file, at), 500)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from _frames(rows(batch), names)

    return _files(spark, path).mapInPandas(run, schema)


def _originals(headers: DataFrame, least: int) -> DataFrame:
    """``payload_digest, payload_bytes, original, original_id`` of each payload of ``least`` bytes or more.

    Only responses hold a payload; the one of the largest page id keeps it, without page ids the
    one of the least record id.
    """
    large = headers.where((F.col("record_type") == "response") & (F.col("payload_bytes") >= least))
    return large.groupBy("payload_digest", "payload_bytes").agg(
        F.max("page_id").alias("original"), F.min(F.struct(F.col("page_id").isNull(), (-F.col("page_id")).alias("at"), "record_id"))
        .getField("record_id").alias("original_id"))


def resolve_revisits(headers: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """``headers`` that are to be revisits, with ``original`` and ``original_id``.

    Of responses of equal digest and at least ``least`` bytes, that of the largest page id keeps
    the payload. Copies are counted before the shuffle, so a payload held by a third of all pages
    is one row per task; the join back is against one row per repeated payload.
    """
    large = headers.where((F.col("record_type") == "response") & (F.col("payload_bytes") >= least))
    found = large.join(_originals(headers, least), ["payload_digest", "payload_bytes"])
    return found.where(F.col("page_id") < F.col("original"))


def _input_revisits(headers: DataFrame) -> DataFrame:
    """``headers`` of each revisit whose response is there too, with ``to_page`` and ``to_id``.

    The response is the one it refers to, else the one that keeps its digest. Where the
    response gives its payload to another record, that record is meant.
    """
    responses = headers.where(F.col("record_type") == "response")
    by_digest = responses.groupBy("payload_digest").agg(F.min(F.struct(
        F.col("page_id").isNull(), (-F.col("page_id")).alias("at"), "record_id", "page_id")).alias("d"))
    by_id = responses.groupBy("record_id").agg(F.min("payload_digest").alias("by_id"))
    asked = headers.where(F.col("record_type") == "revisit").select(
        "file", "at", "refers_to_id", F.col("payload_digest").alias("own"))
    named = asked.join(by_id.withColumnRenamed("record_id", "_id"), F.col("refers_to_id") == F.col("_id"), "left")
    wanted = named.select("file", "at", F.coalesce("by_id", "own").alias("payload_digest"))
    return wanted.join(by_digest, "payload_digest").select(
        "file", "at", F.col("d.page_id").alias("to_page"), F.col("d.record_id").alias("to_id"))


def _changed(spark: SparkSession, path: str, changes: DataFrame) -> DataFrame:
    """Records of all archives below ``path``, those that ``changes`` names as revisits.

    ``changes``: file, at, to_page, to_id; they are one row a file here, no more than the file has
    records, and that file stands in the task's memory already.
    """
    per_file = changes.groupBy("file").agg(F.collect_list(F.struct(
        "at", F.col("to_page").cast("string").alias("to_page"), "to_id")).alias("changes"))
    # written, so that its size is known where the join is planned
    per_file = written(per_file.withColumnRenamed("file", "_file"), "warc-changes")
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kind, to_id, to_page, payload = (names.index(c) for c in ("record_type", "refers_to_id", "refers_to_page", "payload"))

    def rows(batch: pd.DataFrame) -> Iterator[tuple[tuple, int]]:
        for content, listed in zip(batch["content"], batch["changes"]):
            new = {c["at"]: c for c in (() if listed is None else listed)}
            for at, (fields, block) in enumerate(parse(content)):
                row = list(_row(fields, block, True))
                if at in new:
                    page = new[at]["to_page"]
                    row[kind], row[to_id], row[to_page] = "revisit", new[at]["to_id"], None if page is None else int(page)
                if row[kind] == "revisit":
                    row[payload] = None
                yield tuple(row), len(row[payload] or b"") + 500

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from _frames(rows(batch), names)

    both = _files(spark, path).join(per_file, F.col("file") == F.col("_file"), "left")
    return both.select("content", "changes").mapInPandas(run, RECORDS)


def deduplicate(spark: SparkSession, path: str, out: str, least: int = LEAST_PAYLOAD) -> None:
    """Write the archives below ``path`` again to ``out``, repeated payloads as revisits.

    Records keep their ids and, but for new revisits, their blocks; they take fresh headers,
    since type, lengths and references change. A revisit in the input refers to the response that
    keeps its payload; where none is there it keeps what it referred to.
    """
    headers = written(read_archives(spark, path, payloads=False), "warc-headers")
    new = resolve_revisits(headers, least).select(
        "file", "at", F.col("original").alias("to_page"), F.col("original_id").alias("to_id"))
    records = _changed(spark, path, new.union(_input_revisits(headers)))
    write_archives(records.select(record_text(
        F.col("page_id"), F.col("record_type"), F.col("target_uri"), F.col("date"), F.col("payload").cast("string"),
        F.col("payload_digest"), F.col("payload_bytes"), F.col("refers_to_page"), F.col("record_id"), F.col("refers_to_id"))), out)


def archive_pages(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write each row of ``page_id, url, html`` as a response record (null html: empty)."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    write_archives(pages.select(record_text(
        F.col("page_id"), F.lit("response"), F.col("url"), F.lit(date), payload, F.sha1(payload.cast("binary")),
        F.octet_length(payload).cast("long"), F.lit(None).cast("long"))), path)


def revisits_of_pages(pages: DataFrame, folder: str, least: int = LEAST_PAYLOAD) -> DataFrame:
    """Archive ``pages``, resolve revisits, and return the headers read from the new archives.

    One row per row of ``pages``, repeated rows included. Rows of equal id are told apart by
    payload; a null id is never an original of another record and never a revisit.
    Extra columns are left out. An empty table writes empty archives and gives no rows.
    """
    spark = pages.sparkSession
    archive_pages(pages, f"{folder}/raw")
    deduplicate(spark, f"{folder}/raw", f"{folder}/deduplicated", least)
    return read_archives(spark, f"{folder}/deduplicated", payloads=False)


_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS original FROM h)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND original > page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND original > page_id THEN original END AS refers_to FROM m"""


@query("op3_warc", _SQL)
def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    read = revisits_of_pages(pages, scratch_path(spark, "warc"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type",
                       F.col("refers_to_page").alias("refers_to"))
