"""WARC archives: one transaction (request, response or revisit, metadata) per capture.

Writing: records are made as text by Spark SQL and written by Spark's own committer with the
record end as line separator, so files are plain WARC/1.1 and a lost task leaves nothing behind.
Reading: files, bounded in bytes when they were written, are parsed record by record by their
Content-Length (payloads may hold anything, record ends and version lines too); request, response and metadata records are
then joined through WARC-Concurrent-To and each capture becomes one nested row.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import lookup_join, materialise, scratch_path, ship

#: A file has at most so many bytes of payload (or one capture), as a reader takes it whole ...
FILE_BYTES = 64 << 20
#: ... and so many captures. Pages are written by classes of size: up to FILE_BYTES / PER_FILE bytes, up to four times that, and so on.
PER_FILE = 4000
#: Records and payload bytes that a reader hands on at once.
AT_ONCE, BYTES_AT_ONCE = 1000, 4 << 20
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _bare32(hexed):
    """Bare upper-case base32 of a hex SHA-1 column, five bits at a time."""
    bits = F.lpad(F.conv(F.substring(hexed, 1, 10), 16, 2), 40, "0")
    for i in range(1, 4):
        bits = F.concat(bits, F.lpad(F.conv(F.substring(hexed, 10 * i + 1, 10), 16, 2), 40, "0"))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    return F.concat(*[F.substring(F.lit(letters), F.conv(F.substring(bits, 5 * i + 1, 5), 2, 10).cast("int") + 1, 1) for i in range(32)])


def _record(kind: str, rid, more: list, body):
    """One record without its end: header lines, an empty line, the body."""
    head = [F.lit("WARC/1.1\r\nWARC-Type: " + kind + "\r\nWARC-Record-ID: "), rid, F.lit(f"\r\nWARC-Date: {DATE}\r\n")]
    return F.concat(*head, *more, F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body)


CONTROL = [chr(i) for i in [*range(32), 127]]


def _clean(c):
    """A header value: control characters would end it, so they are percent-encoded."""
    text = F.coalesce(c, F.lit(""))
    coded = text
    for x in CONTROL:
        coded = F.replace(coded, F.lit(x), F.lit(f"%{ord(x):02X}"))
    return F.when(text.rlike(r"[\x00-\x1F\x7F]"), coded).otherwise(text)


def mark_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, body, digest, refers_to: equal payloads of at least least_bytes revisit the one with the largest page_id."""
    body = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("body"), _bare32(F.sha1(body.cast("binary"))).alias("digest"))
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(body.cast("binary")).alias("d2"), F.octet_length(body).alias("n"))
    same = narrow.where(F.col("n") >= least_bytes).groupBy("d2").agg(F.max("page_id").alias("first"), F.count("*").alias("w")).where("w > 1")
    same = same.select(_bare32(F.col("d2")).alias("d2"), "first", "w")
    out = lookup_join(p, materialise(same, "payloads"), [("digest", "d2")], "w", F.col("page_id"), ["first"])
    return out.withColumn("refers_to", F.when(F.col("first") != F.col("page_id"), F.col("first"))).drop("first")


def write(pages: DataFrame, path: str, least_bytes: int = 0, per_file: int = PER_FILE, file_bytes: int = FILE_BYTES) -> None:
    """Three records per row of pages (page_id, url, html): request, response or revisit, metadata.

    A URL with control characters is percent-encoded in the headers and kept as it is, in base64,
    in the metadata.
    """
    m = mark_revisits(pages, least_bytes)
    pid = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    # repeated page ids, and rows without one, are captures of their own: they get a serial number
    again = pages.groupBy(F.col("page_id").cast("long").alias("p2")).agg(F.count("*").alias("w"), F.lit(True).alias("again")).where("w > 1 or p2 is null")
    m = lookup_join(m, materialise(again, "again"), [("page_id", "p2")], "w", F.xxhash64("url"), ["again"])
    name = F.concat(pid, F.when(F.col("again"), F.concat(F.lit("-"), F.monotonically_increasing_id())).otherwise(F.lit("")))
    main, req, meta = (F.concat(F.lit(f"<urn:page:{k}:"), F.col("name"), F.lit(">")) for k in ("capture", "request", "metadata"))
    m = m.withColumn("name", name)
    uri = F.concat(F.lit("WARC-Target-URI: "), _clean(F.col("url")), F.lit("\r\n"))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\n"))
    http = F.lit("Content-Type: application/http; msgtype=response\r\n")
    ok = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("body").cast("string"), F.lit("\r\n\r\n"))
    revisit = F.col("refers_to").isNotNull()
    to = F.concat(F.lit("WARC-Refers-To: <urn:page:capture:"), F.col("refers_to").cast("string"), F.lit(f">\r\nWARC-Profile: {PROFILE}\r\n"))
    first = F.when(revisit, _record("revisit", main, [uri, to, digest, http], ok)).otherwise(_record("response", main, [uri, digest, http], F.concat(ok, F.col("body"))))
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/?#]*)", 1)
    get = F.concat(F.lit("GET "), F.regexp_replace(F.regexp_extract(F.coalesce("url", F.lit("")), r"://[^/?#]*(.*)", 1), r"^(?!/)", "/"), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n"))
    with_ = F.concat(F.lit("WARC-Concurrent-To: "), main, F.lit("\r\n"))
    ask = _record("request", req, [uri, with_, F.lit("Content-Type: application/http; msgtype=request\r\n")], get)
    facts = F.concat(F.lit("payload-bytes: "), F.octet_length("body").cast("string"), F.lit("\r\npage-id: "), pid, F.lit("\r\n"))
    odd = F.col("url").rlike(r"[\x00-\x1F\x7F]")
    facts = F.concat(facts, F.when(odd, F.concat(F.lit("url-base64: "), F.translate(F.base64(F.col("url").cast("binary")), "\r\n", ""), F.lit("\r\n"))).otherwise(F.lit("")))
    about = _record("metadata", meta, [uri, with_, F.lit("Content-Type: application/warc-fields\r\n")], facts)
    # one string per capture keeps its records in one file; the writer adds the last record's end
    text = m.select(F.concat(first, F.lit(END), ask, F.lit(END), about), F.octet_length("body").alias("n"))
    least = max(1, file_bytes // per_file)
    kind = F.greatest(F.lit(0), F.ceil(F.log(4.0, F.octet_length(F.coalesce("html", F.lit(""))) / F.lit(least)) - 1e-9)).cast("int")
    kinds = sorted(r[0] or 0 for r in pages.select(kind.alias("k")).distinct().collect()) or [0]  # 16 at most: a string has under 2**31 bytes
    for k in kinds:
        own = text.where((F.col("n") <= least * 4**k) & (F.col("n") > (least * 4 ** (k - 1) if k else -1))).drop("n")
        own.write.mode("append").option("maxRecordsPerFile", max(1, per_file // 4**k)).option("lineSep", END).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record; a cut-off last record is left out."""
    at, n = 0, len(data)
    while at < n:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(head.get("content-length", "0"))
        if end + 4 + size > n:
            return
        yield head, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


RECORD = "type string, record_id string, concurrent_to string, uri string, refers_to string, digest string, payload_bytes long, payload_digest string, block_bytes long, payload binary, fields map<string,string>"


def read_records(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per record; payload_* are taken from the bytes of responses. payload=False leaves the bytes out."""
    ship(spark)

    names = [f.split()[0] for f in RECORD.split(", ")]

    def frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({"payload_bytes": "Int64", "block_bytes": "Int64"})

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf["content"]:
                rows, held = [], 0
                for h, block in parse(bytes(data)):
                    kind, body, digest, fields = h.get("warc-type"), None, None, None
                    if kind == "response":
                        body = block.partition(b"\r\n\r\n")[2]
                        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
                    elif kind == "metadata":
                        fields = {k.strip(): v.strip() for k, s, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n")) if s}
                    rows.append((kind, h.get("warc-record-id"), h.get("warc-concurrent-to"), h.get("warc-target-uri"), h.get("warc-refers-to"), h.get("warc-payload-digest", "").removeprefix("sha1:") or None, None if body is None else len(body), digest, len(block), body if payload else None, fields))
                    held += len(body) if payload and body is not None else 0
                    if len(rows) >= AT_ONCE or held >= BYTES_AT_ONCE:
                        yield frame(rows)
                        rows, held = [], 0
                yield frame(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(records, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture (response or revisit), request, metadata.

    Requests and metadata name their capture in concurrent_to. One whose capture is missing makes
    a row with a null capture; of several that name one capture the smallest record stays.
    """
    names = ["record_id", "uri", "refers_to", "digest", "payload_bytes", "payload_digest", "block_bytes", "payload", "fields"]
    own = F.col("type").isin("response", "revisit")
    # a map cannot be compared, so fields travel as sorted entries
    whole = F.struct("type", *[F.array_sort(F.map_entries("fields")).alias("fields") if n == "fields" else F.col(n) for n in names])
    pick = lambda kinds: F.min(F.when(F.col("type").isin(*kinds), whole))
    key = F.when(own, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id"))
    return records.groupBy(key.alias("capture_id")).agg(pick(["response", "revisit"]).alias("capture"), pick(["request"]).alias("request"), pick(["metadata"]).alias("metadata"))


def round_trip(pages: DataFrame, payload: bool = False) -> DataFrame:
    """Write pages as WARC into the shared folder, read them back, one row per page.

    page_id, payload_bytes, payload_digest, record_type, refers_to, uri. Null html is an empty
    payload; a null page_id reads back as null; repeated rows are captures of their own (of equal
    payloads with one page_id all are responses, and revisits name that page); a null url reads
    back as empty; payloads are whole, however long (a very long one has a file of its own); an
    empty table gives an empty result; other columns are ignored.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(pages, path)
    c = assemble(read_records(spark, path, payload))
    fact = lambda k: F.element_at(F.map_from_entries("metadata.fields"), k).try_cast("long")
    refers = F.regexp_extract("capture.refers_to", r"^<urn:page:capture:(-?\d+)>$", 1)
    return c.select(
        fact("page-id").alias("page_id"),
        F.coalesce("capture.payload_bytes", fact("payload-bytes")).alias("payload_bytes"),
        F.coalesce("capture.payload_digest", "capture.digest").alias("payload_digest"),
        F.col("capture.type").alias("record_type"),
        F.when(F.col("capture.refers_to").isNotNull(), refers.try_cast("long")).alias("refers_to"),
        F.coalesce(F.unbase64(F.element_at(F.map_from_entries("metadata.fields"), "url-base64")).cast("string"), "capture.uri").alias("uri"),
    )
