"""WARC archives: writing captures, reading records, assembling transactions.

A capture is up to three or more records: the request, the response (or a
revisit that refers to an earlier equal payload) and metadata. They name each
other in WARC-Concurrent-To. `assemble` joins them through those identifiers
into one nested row per capture.

Archives are written and read by Spark's own file formats alone, so they can lie
in any store Spark reaches. Every record ends in two line ends; with those as
the separator of Spark's text writer, its files are plain runs of WARC records,
compressed as a whole. Reading goes by Content-Length, never by looking for a
separator, and also takes archives of one gzip member per record. A file is read
by one task: keep files small, as the writer here does (`file_bytes`).
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, new_path, stored, weighted_join

CRLF = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base-32 SHA-1 of binary data: five hexadecimal digits make four of base 32."""
    digits = F.sha1(data)
    fives = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*fives), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_uri(kind: str, capture: Column) -> Column:
    """A urn:uuid made from the kind of record and the capture's unique name."""
    h = F.md5(F.concat(F.lit(kind + ":"), capture))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def mark_revisits(rows: DataFrame, key: str, least_bytes: int = 0) -> DataFrame:
    """rows (with key, __capture, __size, __digest) and __refers: the __capture of the response of its payload, null if no other row has it.

    Of rows with equal payloads of at least least_bytes, that with the largest
    key is the response and the others revisit it. Only digests that occur
    twice or more are joined back; their counts are summed before they are
    shuffled, and the join may be split where one payload holds a third of all
    rows. One row of each payload is the response, whatever its keys: null keys
    come after all others, and of rows that repeat the largest one is taken.
    """
    top = F.max(F.struct(F.col(key).alias("key"), F.col("__capture").alias("capture")))
    twice = rows.where(F.col("__size") >= least_bytes).groupBy("__digest").agg(top.alias("top"), F.count("*").alias("c")).where("c > 1")
    return rows.join(twice.select("__digest", F.col("top.capture").alias("__refers")), "__digest", "left")


def _block(text: Column) -> Column:
    return F.octet_length(text).cast("string")


def _record(kind: str, uri: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record without its closing separator."""
    lines = [F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}WARC-Record-ID: "), uri, F.lit(CRLF)]
    for name, value in headers:
        lines.append(F.when(value.isNull(), "").otherwise(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))))
    return F.concat(*lines, F.lit("Content-Length: "), _block(block), F.lit(CRLF + CRLF), block)


def write_captures(
    pages: DataFrame,
    path: str,
    key: str = "page_id",
    url: str = "url",
    body: str = "html",
    least_bytes: int = 0,
    date: str = "2024-01-01T00:00:00Z",
    file_bytes: int = 64 << 20,
) -> None:
    """Write request, response or revisit, and metadata records of every page as gzipped WARC files.

    body may be text (written as UTF-8) or binary; null is an empty payload, a
    null url an empty one. Line ends in a url become spaces. Records of a
    capture may land in any file. An empty table writes no records.

    Every row is a capture of its own, whatever its key: record ids come from a
    random name of the row, which is written with the row before anything uses
    it, so that all records agree on it. The key stands in the metadata only.

    A file gets as many records as make file_bytes at the mean payload's size
    (9,000 at most), and no more than could, all of them the largest, pass what
    a reader's binary column holds.
    """
    payload = F.coalesce(F.col(body).cast("binary"), F.lit(b""))
    named = stored(pages.select(key, url, payload.alias("__payload"), F.octet_length(payload).alias("__size"), base32_sha1(payload).alias("__digest"), F.expr("uuid()").alias("__capture")), "captures")
    rows = mark_revisits(named, key, least_bytes)
    mean, most = named.select(F.coalesce(F.avg("__size"), F.lit(0.0)), F.coalesce(F.max("__size"), F.lit(0))).first()
    # a capture has three records, one of which may hold the payload; some 2,000 bytes are headers
    records_per_file = int(max(3, min(9_000, 3 * file_bytes / (mean + 2_000), 3 * (1 << 30) / (most + 2_000))))
    first = F.col("__refers").isNull() | (F.col("__capture") == F.col("__refers"))
    uri = F.regexp_replace(F.coalesce(F.col(url), F.lit("")), "[\\r\\n]+", " ")
    host = F.coalesce(F.regexp_extract(uri, "^[a-z]+://([^/?#]*)", 1), F.lit(""))
    way = F.regexp_extract(uri, "^[a-z]+://[^/?#]*([^#]*)", 1)
    body_text = F.col("__payload").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("__payload").cast("string"), F.lit(CRLF + CRLF))
    answer = record_uri("answer", F.col("__capture"))
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", uri)]
    digest = F.concat(F.lit("sha1:"), F.col("__digest"))
    response = _record("response", answer, [*common, ("WARC-Payload-Digest", digest), ("Content-Type", F.lit("application/http; msgtype=response"))], F.concat(http, body_text))
    revisit = _record(
        "revisit",
        answer,
        [
            *common,
            ("WARC-Payload-Digest", digest),
            ("WARC-Profile", F.lit(REVISIT_PROFILE)),
            ("WARC-Refers-To", record_uri("answer", F.col("__refers"))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        http,
    )
    request = _record(
        "request",
        record_uri("request", F.col("__capture")),
        [*common, ("WARC-Concurrent-To", answer), ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), F.when(way == "", "/").otherwise(way), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF + CRLF)),
    )
    meta = _record(
        "metadata",
        record_uri("metadata", F.col("__capture")),
        [*common, ("WARC-Concurrent-To", answer), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("key: "), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(CRLF)),
    )
    records = rows.select(F.explode(F.array(request, F.when(first, response).otherwise(revisit), meta)).alias("value"))
    records.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)
    discard(named)


class _Stream:
    """Bytes of an archive, unpacked as they are asked for; gzip members follow one another."""

    def __init__(self, data: bytes, step: int = 1 << 20):
        self.data, self.at, self.step = memoryview(data), 0, step
        self.packed = data[:2] == b"\x1f\x8b"
        self.unzip = zlib.decompressobj(31) if self.packed else None
        self.buffer = bytearray()
        self.offset = 0

    def _more(self) -> bool:
        if self.at >= len(self.data) and not (self.packed and self.unzip.unconsumed_tail):
            return False
        if not self.packed:
            self.buffer += self.data[self.at : self.at + self.step]
            self.at += self.step
            return True
        source = self.unzip.unconsumed_tail or self.data[self.at : self.at + self.step]
        if not self.unzip.unconsumed_tail:
            self.at += self.step
        self.buffer += self.unzip.decompress(source, 4 * self.step)
        if self.unzip.eof:
            rest = self.unzip.unused_data
            self.at = min(self.at, len(self.data)) - len(rest)
            self.unzip = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (end := self.buffer.find(mark, seen)) < 0:
            seen = max(0, len(self.buffer) - len(mark))
            if not self._more():
                return None
        return self.take(end + len(mark))[: -len(mark)]

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self._more():
            pass
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        self.offset += len(out)
        return out


def parse_headers(block: bytes) -> dict[str, list[str]]:
    """Header lines by lower-case name, in order; folded lines join the line before."""
    out: dict[str, list[str]] = {}
    name = None
    for line in block.split(b"\r\n"):
        text = line.decode("utf-8", "replace")
        if text and text[0] in " \t" and name:
            out[name][-1] += " " + text.strip()
        elif ":" in text:
            name, _, value = text.partition(":")
            name = name.strip().lower()
            out.setdefault(name, []).append(value.strip())
    return out


def read_records(data: bytes) -> Iterator[dict]:
    """Records of an archive: offset, version, headers, block, problem.

    A record that is cut short keeps what is there and names the problem; what
    doesn't begin with WARC/ ends the file with a problem row.
    """
    stream = _Stream(data)
    while True:
        at = stream.offset
        head = stream.until(b"\r\n\r\n")
        if head is None:
            if stream.buffer.strip():
                yield {"offset": at, "version": None, "headers": {}, "block": bytes(stream.buffer), "problem": "trailing bytes"}
            return
        head = head.lstrip(b"\r\n")
        if not head:
            continue
        if not head.startswith(b"WARC/"):
            yield {"offset": at, "version": None, "headers": {}, "block": head, "problem": "not a record"}
            return
        version, _, rest = head.partition(b"\r\n")
        headers = parse_headers(rest)
        size = (headers.get("content-length") or [""])[0]
        if not size.isdigit():
            yield {"offset": at, "version": version.decode("latin-1"), "headers": headers, "block": b"", "problem": "no Content-Length"}
            return
        block = stream.take(int(size))
        problem = "cut short" if len(block) < int(size) else None
        yield {"offset": at, "version": version.decode("latin-1"), "headers": headers, "block": block, "problem": problem}
        stream.take(4)


RECORD = (
    "record_id string, type string, concurrent_to array<string>, refers_to string, target_uri string, date string, content_type string, "
    "payload_digest string, http_status int, headers map<string,string>, http_headers map<string,string>, fields map<string,string>, "
    "payload_bytes long, computed_digest string, payload binary, file string, offset long, problem string"
)


def _split_http(block: bytes) -> tuple[int | None, dict[str, str], bytes]:
    head, mark, payload = block.partition(b"\r\n\r\n")
    if not head.startswith(b"HTTP/") or not mark:
        return None, {}, block
    status, _, rest = head.partition(b"\r\n")
    code = status.split()[1:2]
    return (int(code[0]) if code and code[0].isdigit() else None), {k: ", ".join(v) for k, v in parse_headers(rest).items()}, payload


def scan(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives under a path, in the columns of RECORD.

    The payload of a response is its entity body; payload_bytes and
    computed_digest are taken from it. A revisit has no body: its payload_bytes
    is the Content-Length of the HTTP header it keeps, its digest stays as
    declared. with_payload=False leaves payload null.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows: list[dict] = []
                held = 0
                for r in read_records(data.as_buffer().to_pybytes() if data.is_valid else b""):
                    h = {k: ", ".join(v) for k, v in r["headers"].items()}
                    kind = h.get("warc-type")
                    row = {
                        "record_id": h.get("warc-record-id"), "type": kind, "concurrent_to": r["headers"].get("warc-concurrent-to", []), "refers_to": h.get("warc-refers-to"),
                        "target_uri": h.get("warc-target-uri"), "date": h.get("warc-date"), "content_type": h.get("content-type"), "payload_digest": (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
                        "http_status": None, "headers": list(h.items()), "http_headers": [], "fields": [], "payload": None, "payload_bytes": len(r["block"]), "computed_digest": None,
                        "file": name, "offset": r["offset"], "problem": r["problem"],
                    }
                    payload = r["block"]
                    if kind in ("response", "revisit"):
                        row["http_status"], http, payload = _split_http(payload)
                        row["http_headers"] = list(http.items())
                        row["payload_bytes"] = len(payload)
                        if kind == "revisit":
                            size = http.get("content-length", "")
                            row["payload_bytes"] = int(size) if size.isdigit() else None
                    elif h.get("content-type", "").startswith("application/warc-fields"):
                        row["fields"] = [(k, ", ".join(v)) for k, v in parse_headers(payload).items()]
                    if kind != "revisit":
                        row["computed_digest"] = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if with_payload:
                        row["payload"] = payload
                        held += len(payload)
                    rows.append(row)
                    if len(rows) >= 2000 or held > 8 << 20:
                        yield _to_batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _to_batch(rows)

    return files.mapInArrow(run, RECORD)


_TEXT_MAP = pa.map_(pa.string(), pa.string())
_ARROW = pa.schema(
    [
        ("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("content_type", pa.string()),
        ("payload_digest", pa.string()), ("http_status", pa.int32()), ("headers", _TEXT_MAP), ("http_headers", _TEXT_MAP), ("fields", _TEXT_MAP),
        ("payload_bytes", pa.int64()), ("computed_digest", pa.string()), ("payload", pa.binary()), ("file", pa.string()), ("offset", pa.int64()), ("problem", pa.string()),
    ]
)


def _to_batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def assemble(records: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One nested row per capture: capture_id, answer, request, metadata, others.

    A response, revisit or resource record opens a capture under its record id.
    Any other record joins the captures whose id it names in concurrent_to, or
    that name it; failing that, those of a record that it names or that names
    it (metadata that points to the request only). answer is the opening
    record, request the first request by record id, metadata and others are
    lists in order of record id. Records that reach no capture are kept as rows
    with a null answer, each under its own id; a null record id opens a capture
    nothing can join. Equal record ids in several files are one record, the
    first by file and offset. warcinfo records and broken ones are left out.
    columns picks the record columns to carry (all by default).
    """
    carry = columns or list(records.columns)
    named = records.where("problem IS NULL AND type <> 'warcinfo'")
    pick = F.struct(*carry)
    one = (
        named.where("record_id IS NOT NULL")
        .groupBy("record_id")
        .agg(F.min_by(F.struct("type", "concurrent_to", pick.alias("r")), F.struct("file", "offset")).alias("x"))
        .select("record_id", "x.type", "x.concurrent_to", "x.r")
    )
    opens = F.col("type").isin("response", "revisit", "resource")
    links = one.select("record_id", F.explode("concurrent_to").alias("other"))
    pairs = links.union(links.select("other", "record_id")).distinct().toDF("a", "b")
    anchors = one.where(opens).select(F.col("record_id").alias("capture_id"))
    first = pairs.join(anchors, pairs.b == anchors.capture_id, "left_semi").select(F.col("a").alias("record_id"), F.col("b").alias("capture_id"))
    rest = one.where(~opens).select("record_id")
    direct = first.join(rest, "record_id", "left_semi")
    lone = rest.join(direct, "record_id", "left_anti")
    second = (
        pairs.join(lone, pairs.a == lone.record_id, "left_semi")
        .join(direct.select(F.col("record_id").alias("b"), "capture_id"), "b")
        .select(F.col("a").alias("record_id"), "capture_id")
        .distinct()
    )
    placed = direct.union(second)
    members = one.where(~opens).join(placed, "record_id", "left").select(F.coalesce("capture_id", "record_id").alias("capture_id"), "record_id", "type", "r")
    rows = one.where(opens).select(F.col("record_id").alias("capture_id"), "record_id", "type", "r").union(members)
    kind = F.when(F.col("type").isin("response", "revisit", "resource"), "answer").otherwise(F.col("type"))
    own = F.struct("record_id", "r")
    by_id = lambda a, b: F.when(a["record_id"] < b["record_id"], -1).when(a["record_id"] > b["record_id"], 1).otherwise(0)
    listed = lambda keep: F.transform(F.array_sort(F.collect_list(F.when(keep, own)), by_id), lambda x: x["r"])
    out = rows.withColumn("kind", kind).groupBy("capture_id").agg(
        F.min_by(F.when(F.col("kind") == "answer", F.col("r")), F.when(F.col("kind") == "answer", F.col("record_id"))).alias("answer"),
        F.min_by(F.when(F.col("kind") == "request", F.col("r")), F.when(F.col("kind") == "request", F.col("record_id"))).alias("request"),
        listed(F.col("kind") == "metadata").alias("metadata"),
        listed(~F.col("kind").isin("answer", "request", "metadata")).alias("others"),
    )
    nameless = named.where("record_id IS NULL").select(
        F.lit(None).cast("string").alias("capture_id"), pick.alias("answer"), F.lit(None).cast(out.schema["request"].dataType).alias("request"),
        F.array().cast(out.schema["metadata"].dataType).alias("metadata"), F.array().cast(out.schema["others"].dataType).alias("others"),
    )
    return out.union(nameless)


def op1_warc_transactions(spark, sf_dir: str) -> DataFrame:
    """Every page written as WARC records, read back and assembled; one row per page.

    The page id comes from the capture's metadata record, type, sizes and
    digests from its response or revisit record. Null page ids come after all
    others: where a payload has no other, one of its rows is the response, and
    those that revisit it refer to null, its id.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = new_path(spark, "warc")
    write_captures(pages, path)
    records = stored(scan(spark, path, with_payload=False), "records")
    captures = assemble(records, ["type", "payload_bytes", "payload_digest", "computed_digest", "refers_to", "fields"])
    revisit = F.col("answer.type") == "revisit"
    page_id = F.nullif(F.get("metadata", 0)["fields"]["key"], F.lit("")).cast("long")
    pages = captures.where("answer IS NOT NULL").select(
        "capture_id",
        page_id.alias("page_id"),
        F.col("answer.payload_bytes").alias("payload_bytes"),
        F.when(revisit, F.col("answer.payload_digest")).otherwise(F.col("answer.computed_digest")).alias("payload_digest"),
        F.col("answer.type").alias("record_type"),
        F.when(revisit, F.col("answer.refers_to")).alias("to"),
    )
    pages = stored(pages, "pages")
    return with_referred(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def with_referred(pages: DataFrame) -> DataFrame:
    """Stored rows (capture_id, page_id, to, ...) with refers_to: the page_id of the capture that `to` (a WARC-Refers-To) names.

    A null `to`, or one that names no capture here, refers to nothing. How often
    each is named is summed before the shuffle; those that a large share of all
    rows name are joined by broadcast.
    """
    named = pages.where("to IS NOT NULL").groupBy("to").agg(F.count("*").alias("c"))
    found = named.join(pages.select(F.col("capture_id").alias("to"), F.col("page_id").alias("refers_to")), "to")
    rows = pages.where("to IS NOT NULL")
    return weighted_join(rows, found, ["to"], "c", pages.count(), "left").unionByName(pages.where("to IS NULL").withColumn("refers_to", F.lit(None).cast("long")))


_BASE32 = " || ".join(
    " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * i + 1}, 5))::BIGINT >> {s}) & 31)::INT + 1, 1)" for s in (15, 10, 5, 0)) for i in range(8)
)
OP1_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
o AS (SELECT *, row_number() OVER w AS place, first_value(page_id) OVER w AS top FROM p WINDOW w AS (PARTITION BY html ORDER BY page_id DESC NULLS LAST))
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN place > 1 THEN top END AS refers_to
FROM o
"""
