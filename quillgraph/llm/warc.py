"""Web archives without repeated payloads (operator 7): revisit resolution.

``write_archives`` shuffles headers (page, digest, length) by payload digest: of pages with equal
payloads of at least ``LEAST_BYTES`` the smallest page_id is written as a ``response``, the others
as ``revisit`` records that refer to its record id and carry no payload.  A digest may be that of a
third of all pages: counts meet pre-aggregated, and its pages are joined to its original in 32
places.  The verdicts then meet the payloads by page, which moves every payload once.  Every record
gets fresh headers and is a gzip member of its own; a file holds whole members of ``FILE_BYTES`` or
one larger one.  Spark's writer names and commits the files (part-*) on whatever file system the shared folder is on,
so retries of lost tasks leave no partial file.

``read_archives`` takes the files as they are, member by member, walks each by Content-Length (a
payload may hold anything, record headers included), checks digests, and joins revisits to their
originals by record id, in 32 places again.

Edge cases: a null payload is empty; rows with a null page_id are left out; rows that repeat a
page_id are records each, and equal payloads under the smallest id are all responses; a url that is
null or holds control signs is written with those percent-encoded (null: `urn:page:<id>`); columns
other than the three are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import corpus, state
from . import textcore as tc

LEAST_BYTES = 100
#: Bytes of a file, compressed, unless one record has more; a file is read as one value.
FILE_BYTES = 16 << 20
#: Bytes inflated at a time.
CHUNK = 16 << 10
#: Payload bytes of one batch of records read.
READ_BYTES = 8 << 20
#: An empty gzip member.  Like that of every record below 16 MB its last byte is zero.
EMPTY = zlib.compressobj(6, zlib.DEFLATED, 31).flush()
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = "page_id long, url string, record_id string, record_type string, header_digest string, refers_to_id string, payload_bytes long, payload_digest string, payload string"


def record_id(page: Column, digest: Column) -> Column:
    """A URN that follows from page and payload, so that a revisit can name its original."""
    h = F.md5(F.concat_ws("|", page.cast("string"), digest).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-" if a < 21 else ">"))])


def _records(rows: DataFrame, date: str) -> Column:
    """The text of a record."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(F.col("first").isNull(), F.concat(http, F.col("payload"))).otherwise(http)
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("first").isNull(), F.lit("response")).otherwise(F.lit("revisit"))),
        line("WARC-Record-ID", record_id(F.col("page_id"), F.col("digest"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("uri")),
        line("X-Page-Id", F.col("page_id").cast("string")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(F.col("first").isNull(), F.lit("")).otherwise(F.concat(line("WARC-Refers-To", record_id(F.col("first"), F.col("digest"))), line("WARC-Profile", F.lit(PROFILE)))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return F.concat(head, block, F.lit("\r\n\r\n"))


def _members(batches):
    """Rows of whole gzip members, one for each record, less their last byte, which the writer's line end puts back."""

    def row(parts: list[bytes]) -> pa.RecordBatch:
        body = b"".join(parts)
        body = body if body.endswith(b"\0") else body + EMPTY
        return pa.RecordBatch.from_arrays([pa.array([body[:-1]], pa.binary())], ["value"])

    wait, size = [], 0
    for batch in tc.each(batches):
        for record in batch.column(0):
            deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = deflate.compress(record.as_buffer()) + deflate.flush()
            if wait and size + len(member) > FILE_BYTES:
                yield row(wait)
                wait, size = [], 0
            wait.append(member)
            size += len(member)
    if wait:
        yield row(wait)


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", date: str = "2024-01-01T00:00:00Z") -> None:
    """One record for each page, repeated payloads as revisits, as gzip files below `path`."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    uri = F.coalesce(F.regexp_replace(F.regexp_replace(F.col(url), r"[\r\n]", "%0A"), r"[\x00-\x1F]", "%20"), F.concat(F.lit("urn:page:"), F.col(key).cast("string")))
    rows = pages.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("page_id"), uri.alias("uri"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha2(F.col("payload"), 256)).withColumn("n", F.octet_length("payload"))
    heads = rows.select("page_id", "digest", "n").where(F.col("n") >= LEAST_BYTES)
    first = heads.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("digest", "first")
    again = corpus.salted_join(heads.select("page_id", "digest"), first, "digest", "page_id").where("page_id > first").dropDuplicates(["page_id", "digest"])
    state.tune(pages.sparkSession)
    text = rows.join(again, ["page_id", "digest"], "left")
    files = text.select(_records(text, date).alias("value")).mapInArrow(_members, "value binary")
    # a row is a file; the text writer takes its bytes as they are
    files.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def _inflated(data: bytes):
    """The content of each gzip member of an archive, or of a plain one as it is."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at = memoryview(data), 0
    while at < len(view):
        inflate, out = zlib.decompressobj(31), []
        while not inflate.eof:
            if at >= len(view):
                raise ValueError("a gzip member is cut off")
            part = view[at : at + CHUNK]
            out.append(inflate.decompress(part))
            at += len(part) - len(inflate.unused_data)
        yield b"".join(out)


def parse(data: bytes):
    """(headers, block) of every record of an archive; gzip, of one member or many, or plain."""
    rest = b""
    for part in _inflated(data):
        part = rest + part if rest else part
        at = 0
        while at < len(part):
            stop = part.find(b"\r\n\r\n", at)
            if not part.startswith(b"WARC/"[: len(part) - at], at):
                raise ValueError(f"no record at byte {at}")
            if stop < 0:
                break
            lines = part[at:stop].decode().split("\r\n")[1:]
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            end = stop + 4 + int(headers["content-length"])
            if end + 4 > len(part):  # goes on in the next member
                break
            yield headers, part[stop + 4 : end]
            at = end + 4
        rest = part[at:]
    if rest:
        raise ValueError("a record is cut off")


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """READ rows as the files have them: a revisit's payload columns are null."""

    kinds = {"long": pa.int64(), "string": pa.string()}
    shape = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in READ.split(", "))])

    def run(batches):
        for batch in tc.each(batches):
            for data in batch.column(0):
                out, size = {n: [] for n in shape.names}, 0
                for h, block in parse(data.as_py()):
                    body = block[block.index(b"\r\n\r\n") + 4 :] if h["warc-type"] == "response" else None
                    digest = body is not None and hashlib.sha256(body).hexdigest()
                    told = h["warc-payload-digest"].removeprefix("sha256:")
                    if body is not None and digest != told:
                        raise ValueError(f"{h['warc-record-id']}: the payload is not what its digest says")
                    row = (int(h["x-page-id"]), h["warc-target-uri"], h["warc-record-id"], h["warc-type"], told, h.get("warc-refers-to"), None if body is None else len(body), digest or None, body.decode() if with_payload and body is not None else None)
                    for name, value in zip(out, row, strict=True):
                        out[name].append(value)
                    size += 200 + len(row[-1] or "")
                    if size > READ_BYTES:
                        yield pa.RecordBatch.from_pydict(out, schema=shape)
                        out, size = {n: [] for n in shape.names}, 0
                yield pa.RecordBatch.from_pydict(out, schema=shape)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, READ)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Every page's record with the payload's length and digest, a revisit's taken from its original, whose page `refers_to` names."""
    rows = read_records(spark, path, with_payload)
    own = rows.where("record_type = 'response'").select("page_id", "url", "record_type", "payload_bytes", "payload_digest", F.lit(None).cast("long").alias("refers_to"), "payload")
    source = rows.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest", "payload").dropDuplicates(["refers_to_id"])
    if not with_payload:
        own, source = own.drop("payload"), source.drop("payload")
    again = rows.where("record_type = 'revisit'").select("page_id", "url", "record_type", "refers_to_id")
    source = source.join(again.select("refers_to_id").distinct(), "refers_to_id", "left_semi")
    again = corpus.salted_join(again, source, "refers_to_id", "page_id", "left")
    return own.unionByName(again.drop("refers_to_id"))


def oracle() -> str:
    """What the archives say when read back, in DuckDB SQL."""
    return f"""
    WITH body AS (SELECT page_id, coalesce(html, '') AS payload FROM pages WHERE page_id IS NOT NULL),
    told AS (SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM body),
    lead AS (SELECT payload_digest, min(page_id) AS original FROM told WHERE payload_bytes >= {LEAST_BYTES} GROUP BY payload_digest)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN page_id > original THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN page_id > original THEN original END AS refers_to
    FROM told LEFT JOIN lead USING (payload_digest)"""


def op7_warc_revisits(spark, sf_dir: str) -> DataFrame:
    path = f"{state.shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
