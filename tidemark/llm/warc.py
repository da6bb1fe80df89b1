"""WARC archives: writing pages, reading records, and assembling each capture's request, response and metadata.

Archives are written by the text writer with the record trailer as line separator, so they go to any store that Spark
writes to, with its commit protocol: a lost executor's files are never seen. They are read as binary files and cut by
Content-Length.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch

CRLF = "\r\n"
#: Payloads below this many bytes are never stored as revisits.
MIN_REVISIT_BYTES = 1000
#: Payload bytes of an archive file at most, if it has more than one page, and of the smallest pages; each further class is 16 times larger.
FILE_BYTES, SMALL_PAGE = 1 << 28, 1 << 16
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record(kind: str, record_id: Column, headers: list[Column | str], content_type: str, block: Column, date: str) -> Column:
    """A record without its trailer. Null headers are left out."""
    head = [F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}WARC-Date: {date}{CRLF}Content-Type: {content_type}"), F.concat(F.lit("WARC-Record-ID: "), record_id), *headers]
    return F.concat(F.concat_ws(CRLF, *head, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))), F.lit(CRLF * 2), block)


def write_archives(pages: DataFrame, path: str, scratch: Scratch, *, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write pages(page_id, url, html) to gzipped WARC files: a request, a response or revisit, and a metadata record each.

    Of pages with equal payloads of at least 1000 bytes, the one with the largest page_id is a response and the others
    revisit it, naming its URL and date; where that page_id repeats, all its rows are responses, as are rows without page_id. Null html is
    an empty payload; a null url leaves the target out. Other columns are ignored. No pages give no file.

    Pages are written by classes of size, so that as many go to a file as have FILE_BYTES together; a larger page has a file of its own. A
    file is one gzip member, since Spark's text writer, which commits files of successful tasks only, compresses whole files.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    based = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"))
    based = based.withColumn("digest", F.sha1("html")).withColumn("bytes", F.octet_length("html").cast("long"))
    thin = based.where(F.col("bytes") >= MIN_REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("top"), F.max_by("url", "page_id").alias("top_url"), F.count("page_id").alias("n"))
    kept = scratch.keep(thin.where("n > 1").select(F.col("digest").alias("of"), "top", "top_url"), "kept")
    dealt = based.join(kept, based["digest"] == kept["of"], "left").withColumn("capture", F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")))
    revisit = F.coalesce((F.col("page_id") < F.col("top")), F.lit(False))

    plain = lambda url: F.regexp_replace(url, r"[\x00-\x20\x7f]", "%20")
    target = F.concat(F.lit("WARC-Target-URI: "), plain("url"))
    refers = [F.concat(F.lit("WARC-Refers-To-Target-URI: "), plain("top_url")), F.lit(f"WARC-Refers-To-Date: {date}"), F.lit(f"WARC-Profile: {_PROFILE}")]
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"))
    concurrent = F.concat(F.lit("WARC-Concurrent-To: "), F.col("capture"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    fresh = lambda: F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))
    get = F.concat(F.lit("GET "), F.coalesce(plain("url"), F.lit("/")), F.lit(f" HTTP/1.1{CRLF}{CRLF}"))
    fields = F.concat(F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(CRLF)), F.lit("")), F.lit("via: pages" + CRLF))
    whole = F.concat(http, F.col("html"))
    answer = F.when(
        revisit, _record("revisit", F.col("capture"), [target, digest, *refers], "application/http;msgtype=response", http, date)
    ).otherwise(_record("response", F.col("capture"), [target, digest], "application/http;msgtype=response", whole, date))
    request = _record("request", fresh(), [target, concurrent], "application/http;msgtype=request", get, date)
    metadata = _record("metadata", fresh(), [target, concurrent], "application/warc-fields", fields, date)
    # 0 up to SMALL_PAGE, then a class more for each factor of 16
    size = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.octet_length("html"), F.lit(1)) / SMALL_PAGE) / 4)).cast("int")
    records = dealt.withColumn("size_class", size).select("size_class", F.explode(F.array(request, answer, metadata)).alias("value"))
    classes = [r[0] for r in pages.select(F.coalesce(F.col("html"), F.lit("")).alias("html")).select(size).distinct().collect()]
    for c in sorted(classes):
        out = records.where(F.col("size_class") == c).select("value").write.option("lineSep", CRLF * 2).option("compression", "gzip")
        out.option("maxRecordsPerFile", 3 * max(1, FILE_BYTES // (SMALL_PAGE << (4 * c)))).mode("append").text(path)
    if not classes:
        records.select("value").write.mode("append").text(path)


def parse_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of a plain WARC stream.

    A header that is repeated has its values in order, parted by line breaks, and a folded one is unfolded. Two headers are added where a
    record is damaged: ``problem`` is "truncated" for a block that ends early, and "skipped" for bytes before a record that are none.
    """
    line, skipped = b"", 0
    while True:
        line = stream.readline()
        while line and not line.startswith(b"WARC/"):
            skipped += len(line.strip())
            line = stream.readline()
        if skipped:
            yield {"problem": "skipped"}, b""
            skipped = 0
        if not line:
            return
        headers: dict[str, str] = {}
        last = None
        while (line := stream.readline()) and line.strip():
            text = line.decode("utf-8", "replace")
            if text[0] in " \t" and last:
                headers[last] += " " + text.strip()
                continue
            name, _, value = text.partition(":")
            last = name.strip().lower()
            headers[last] = f"{headers[last]}\n{value.strip()}" if last in headers else value.strip()
        length = headers.get("content-length", "")
        size = int(length) if length.isdigit() else 0
        block = stream.read(size)
        if len(block) < size or not length.isdigit():
            headers["problem"] = "truncated"
        yield headers, block


_RECORDS = (
    "record_id string, record_type string, concurrent_to array<string>, target_uri string, warc_date string, payload_bytes long, "
    "payload_digest string, page_id long, payload binary, problem string"
)


def _row(headers: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    kind = headers.get("warc-type")
    size = digest = page = payload = None
    if kind in ("response", "revisit"):
        head, _, body = block.partition(b"\r\n\r\n")
        if kind == "response":
            size, digest, payload = len(body), hashlib.sha1(body).hexdigest(), body
        else:
            digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
            size = int(m[1]) if (m := re.search(rb"(?im)^content-length: *(\d+)", head)) else None
    elif kind == "metadata":
        page = int(m[1]) if (m := re.search(rb"(?m)^page-id: (-?\d+)", block)) else None
    h = headers.get
    others = h("warc-concurrent-to").split("\n") if h("warc-concurrent-to") else []
    return h("warc-record-id"), kind, others, h("warc-target-uri"), h("warc-date"), size, digest, page, payload if with_payload else None, h("problem")


def _read(with_payload: bool, at_once: int = 1000):
    kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()]
    names = [x.split()[0] for x in _RECORDS.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, weight = [], 0
        for files in batches:
            for content in files.column(0):
                raw = io.BytesIO(content.as_buffer())
                plain = gzip.GzipFile(fileobj=raw) if raw.getbuffer()[:2] == b"\x1f\x8b" else raw
                for headers, block in parse_records(io.BufferedReader(plain, 1 << 16)):
                    rows.append(_row(headers, block, with_payload))
                    weight += len(block)
                    if len(rows) >= at_once or with_payload and weight >= 1 << 24:
                        yield batch(rows)
                        rows, weight = [], 0
        if rows:
            yield batch(rows)

    return run


def read_archives(spark: SparkSession, path: str, *, with_payload: bool = True) -> DataFrame:
    """A row per record of the WARC files (plain or gzipped, one or many members) below ``path``, in no order; null where a record says nothing.

    ``problem``, else null: "truncated" for a record whose block ends early, which has what there is of it, and "skipped" for bytes
    that are no record, which are a row of nulls. No files give an error, empty files no rows. A file is read by one task, a block at a time.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_read(with_payload), _RECORDS)


def captures(records: DataFrame) -> DataFrame:
    """A nested row per capture: (capture_id, response, request, metadata).

    Records are joined by the record id of the response or revisit, which the others name as concurrent to theirs, one or several. A missing
    request or metadata record is null; records that name no response of the archive are a capture without response; of several
    alike the largest by its fields stays. Records without ids, of other types, and those with a problem take no part. No records give no rows.
    """
    kind = F.col("record_type")
    body = F.struct("record_type", "target_uri", "warc_date", "payload_bytes", "payload_digest", "payload")
    answer = F.max(F.when(kind.isin("response", "revisit"), body))
    request = F.max(F.when(kind == "request", F.struct("record_id", "target_uri")))
    metadata = F.max(F.when(kind == "metadata", F.struct("record_id", "page_id")))
    known = records.where(kind.isin("response", "revisit", "request", "metadata") & F.col("problem").isNull())
    names = F.when(kind.isin("response", "revisit") | (F.size("concurrent_to") == 0), F.array("record_id")).otherwise(F.col("concurrent_to"))
    known = known.withColumn("capture_id", F.explode(names)).where("capture_id is not null")
    return known.groupBy("capture_id").agg(answer.alias("response"), request.alias("request"), metadata.alias("metadata"))


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back and resolve revisits.

    A row per page: page_id, payload_bytes, payload_digest, record_type, refers_to (the page_id of the response that a revisit
    repeats, else null), target_uri. An empty table gives no rows.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    write_archives(pages, scratch.path("archives"), scratch)
    found = captures(read_archives(spark, scratch.path("archives"), with_payload=False))
    flat = found.select(F.col("metadata.page_id").alias("page_id"), "response.payload_bytes", "response.payload_digest", "response.record_type", "response.target_uri")
    flat = scratch.keep(flat, "captures")
    scratch.drop("archives")
    held = flat.where(f"record_type = 'response' and payload_bytes >= {MIN_REVISIT_BYTES}")
    held = held.groupBy(F.col("payload_digest").alias("of")).agg(F.max("page_id").alias("holder"))
    revisited = flat.where("record_type = 'revisit'").select(F.col("payload_digest").alias("of")).distinct()
    held = scratch.keep(held.join(revisited, "of", "left_semi"), "held")
    out = flat.join(held, flat["payload_digest"] == held["of"], "left")
    refers = F.when(F.col("record_type") == "revisit", F.col("holder"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", refers.alias("refers_to"), "target_uri")
