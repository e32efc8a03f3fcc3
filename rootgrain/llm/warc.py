"""WARC archives of web captures: writing, reading, and assembly of transactions.

A capture is written as three records: the request, the response (or a revisit of an equal payload)
and the metadata. Request and metadata name their response in WARC-Concurrent-To. Reading gives one
row for each record; `captures` joins the records of a transaction and emits one nested row.
"""

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import removed, shared_dir, stored

#: Payloads below this many bytes are always written in full.
MIN_REVISIT = 1000
#: Captures in one archive file, at most.
PER_FILE = 2000
#: Bytes of a file that are unpacked at a time.
CHUNK = 1 << 20
DATE = "2024-01-01T00:00:00Z"


def decisions(pages: DataFrame, key: str = "page_id", payload: str = "html", min_bytes: int = MIN_REVISIT) -> DataFrame:
    """How each distinct (key, payload) is written: (key, payload_digest, payload_bytes, refers_to).

    Of equal payloads of min_bytes or more the one with the largest key is a response, refers_to is
    null; the others are revisits that refer to it. A null payload is an empty one.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    small = pages.select(F.col(key), F.sha1(body.cast("binary")).alias("payload_digest"), F.octet_length(body).cast("long").alias("payload_bytes")).distinct()
    groups = small.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.max(key).alias("_last"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    joined = small.join(groups, "payload_digest", "left")
    refers = F.when((F.col("payload_bytes") >= min_bytes) & (F.col("_last") != F.col(key)), F.col("_last"))
    return joined.select(key, "payload_digest", "payload_bytes", refers.alias("refers_to"))


def _urn(*of: Column) -> Column:
    h = F.md5(F.concat_ws("\x1f", *of))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _record(kind: Column, number: Column, uri: Column, mime: str, block: Column, *more: Column) -> Column:
    """One record without the line feed that ends it: the text writer's line separator is that."""
    eol = F.lit("\r\n")
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), number, F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), uri, F.lit(f"\r\nContent-Type: {mime}"))
    return F.concat(head, *more, F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), eol, eol, block, F.lit("\r\n\r"))


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = MIN_REVISIT, per_file: int = PER_FILE) -> None:
    """Write gzip-compressed WARC files of at most per_file captures each under path.

    Null keys are written as captures of their own, null urls as an empty target, null payloads as
    empty ones; rows of one key and equal payloads get equal record ids and are one capture when read. Files are written by Spark's own
    text writer, so that path can be on any file system that Spark knows.
    """
    how = decisions(pages, key, payload, min_bytes)
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(key, F.regexp_replace(F.coalesce(F.col(url), F.lit("")), "[\r\n\t ]", "").alias("_url"), body.alias("_body"), F.sha1(body.cast("binary")).alias("payload_digest"))
    how = how.select(F.col(key).alias("_key"), F.col("payload_digest").alias("_digest"), "payload_bytes", "refers_to")
    joined = rows.join(how, rows[key].eqNullSafe(how["_key"]) & (rows["payload_digest"] == how["_digest"])).drop("_key", "_digest")
    who, digest = F.coalesce(F.col(key).cast("string"), F.lit("\x00")), F.col("payload_digest")
    named = F.coalesce(F.concat(F.lit("page-id: "), F.col(key).cast("string"), F.lit("\r\n")), F.lit("page-id-missing: 1\r\n"))
    response, again = _urn(F.lit("response"), who, digest), F.col("refers_to").isNotNull()
    concurrent = F.concat(F.lit("\r\nWARC-Concurrent-To: "), response)
    host = F.regexp_extract("_url", "^[a-z]+://([^/?#]*)", 1)
    target = F.regexp_extract("_url", "^[a-z]+://[^/?#]*([^#]*)", 1)
    request = F.concat(F.lit("GET "), F.when(target == "", "/").otherwise(target), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    refers = F.when(again, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), _urn(F.lit("response"), F.col("refers_to").cast("string"), digest))).otherwise("")
    records = F.concat(
        _record(F.lit("request"), _urn(F.lit("request"), who, digest), F.col("_url"), "application/http;msgtype=request", request, concurrent),
        F.lit("\n"),
        _record(F.when(again, "revisit").otherwise("response"), response, F.col("_url"), "application/http;msgtype=response", F.concat(http, F.when(again, "").otherwise(F.col("_body"))), F.lit("\r\nWARC-Payload-Digest: sha1:"), digest, refers),
        F.lit("\n"),
        _record(F.lit("metadata"), _urn(F.lit("metadata"), who, digest), F.col("_url"), "application/warc-fields", named, concurrent),
    )
    unique = joined.select(records.alias("value"))
    unique.write.option("maxRecordsPerFile", per_file).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("lineSep", "\n").text(path)


def _parsed(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a stream of bytes, by the declared lengths."""
    held = bytearray()

    def more() -> bool:
        part = next(chunks, None)
        if part is not None:
            held.extend(part)
        return part is not None

    while True:
        while (at := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("a WARC record breaks off in its header")
                return
        lines = bytes(held[:at]).decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        end = at + 4 + int(headers.get("content-length", 0))
        while len(held) < end + 4 and more():
            pass
        if len(held) < end:
            raise ValueError("a WARC record breaks off in its block")
        yield headers, bytes(held[at + 4 : end])
        del held[: end + 4]


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row for each record of the archives under path: (record_id, record_type, concurrent_to,
    target_uri, date, refers_to, declared_digest, http_head, http_length, block_bytes,
    payload_bytes, payload_digest, payload). payload is what follows the head of an HTTP message, null where
    payload=False; payload_bytes and payload_digest, its bare SHA-1, are measured on what was read,
    http_length is what the head declares."""
    kind = "record_id string, record_type string, concurrent_to string, target_uri string, date string, refers_to string, declared_digest string, http_head string, http_length long, block_bytes long, payload_bytes long, payload_digest string, payload binary"
    schema = pa.schema([(x.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in kind.split(", ")])

    def unpacked(data: bytes) -> Iterator[bytes]:
        if data[:2] != b"\x1f\x8b":
            yield data
            return
        while data:  # members follow one another
            member = zlib.decompressobj(31)
            while not member.eof:
                part = member.decompress(data, CHUNK)
                data = member.unconsumed_tail or member.unused_data
                if part:
                    yield part
                elif not data and not member.eof:
                    raise ValueError("a gzip member breaks off")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for data in batch.column(0):
                for h, block in _parsed(unpacked(data.as_py())):
                    head, body = (block.partition(b"\r\n\r\n")[::2]) if h.get("content-type", "").startswith("application/http") else (b"", block)
                    lengths = [x.split(b":")[1] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                    rows.append((
                        h.get("warc-record-id"), h.get("warc-type"), h.get("warc-concurrent-to"), h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-refers-to"), h.get("warc-payload-digest"),
                        head.decode("utf-8", "replace"), int(lengths[0]) if lengths else None, len(block), len(body), hashlib.sha1(body).hexdigest(), body if payload or h.get("warc-type") == "metadata" else None,
                    ))
                    size += len(block)
                    if len(rows) >= 5000 or size > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, kind)


def captures(records: DataFrame) -> DataFrame:
    """One nested row for each response or revisit: (record_id, target_uri, date, record_type, request,
    response, metadata). request is the request that names the record in concurrent_to, or null;
    metadata an array of all metadata records that do, in order of their ids. Records of one id count
    once; requests and metadata of no response go. All records of a transaction meet in one shuffle."""
    of = F.when(F.col("record_type").isin("response", "revisit"), F.col("record_id")).otherwise(F.col("concurrent_to"))
    main = F.col("record_type").isin("response", "revisit")
    own = F.struct("target_uri", "date", "record_type", F.struct("http_head", "http_length", "payload_bytes", "payload_digest", "declared_digest", "refers_to", "payload").alias("response"))
    request = F.struct("record_id", "http_head", "block_bytes")
    note = F.struct("record_id", F.col("payload").cast("string").alias("fields"))
    met = records.where(of.isNotNull()).groupBy(of.alias("record_id")).agg(
        F.min(F.when(main, own)).alias("main"), F.min(F.when(F.col("record_type") == "request", request)).alias("request"),
        F.sort_array(F.collect_set(F.when(F.col("record_type") == "metadata", note))).alias("metadata"),
    )
    return met.where("main IS NOT NULL").select("record_id", "main.target_uri", "main.date", "main.record_type", "request", "main.response", "metadata")


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", **how) -> DataFrame:
    """Write pages to archives in the shared folder, delete them once they are read, and give the captures that are read back, with the
    page's key from the metadata record and refers_to, the key of the page whose record a revisit names
    (null for others). A capture's column that is called like the key gets warc_ before its name. An
    empty table gives an empty one."""
    path = f"{shared_dir(pages.sparkSession)}/rootgrain/warc-{uuid.uuid4().hex}"
    kind = pages.schema[key].dataType
    write(pages.select(F.col(key).alias("_page"), F.col(url).alias("_page_url"), F.col(payload).alias("_page_body")), path, "_page", "_page_url", "_page_body", **how)
    fields = F.get("metadata", F.lit(0))["fields"]
    own = F.when(fields.startswith("page-id: "), F.regexp_extract(fields, "^page-id: (.*?)\r\n", 1)).cast(kind)
    told = stored(captures(read(pages.sparkSession, path, payload=False)).withColumn("_page", own), "captures")
    removed(pages.sparkSession, path)
    names = told.select(F.col("record_id").alias("_named"), F.col("_page").alias("refers_to"))
    again = told.where(F.col("response.refers_to").isNotNull()).join(names, F.col("response.refers_to") == F.col("_named"), "left").drop("_named")
    both = told.where(F.col("response.refers_to").isNull()).withColumn("refers_to", F.lit(None).cast(kind)).unionByName(again)
    return both.withColumnsRenamed({c: f"warc_{c}" for c in both.columns if c.lower() == key.lower()}).withColumnRenamed("_page", key)
