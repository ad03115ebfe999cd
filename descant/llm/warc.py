"""WARC archives: a writer, and a reader that reassembles segmented records.

Writing: a page's payload becomes a `response` record, an HTTP message in chunked transfer framing. A
record block over SEGMENT bytes is cut: the response is segment 1, `continuation` records that name it
as their origin follow, the last one with the total length. Of equal payloads from MIN_DEDUP bytes on,
the page with the smallest id has the response; the others get `revisit` records without a body. A record
is named after its page, its payload's digest and a number of its row, so that rows with equal ids, or
none, have records of their own; a revisit names page and digest of what it refers to. Payloads stay where
they are: only ids and digests of copies are joined with them, broadcast while their size allows it. Spark's
own text writer makes the files (the record end is its line separator), so they go through the commit
protocol to any store, gzipped, with at most FILE_RECORDS records of at most SEGMENT bytes each.

Reading: each archive is parsed on its own, by Content-Length. Unsegmented records are decoded in
place; segments alone are grouped by origin, ordered by segment number and checked: numbers must be
1 .. n and the bytes must sum up to the total length. Then the chunked framing is decoded and the digest
compared. A record that fails is returned with `problem` set.

Edge cases: a null payload is the empty one; a null id sorts after all others and is written as an
empty name; every row gives a record, repeated ones too: rows with the smallest id of a payload are all
responses; an empty table gives an archive without records; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bounded, cut, delete, release, shared_dir

SEGMENT, CHUNK, MIN_DEDUP, FILE_RECORDS = 16_384, 4_096, 100, 2_048
END = b"\r\n\r\n"
RECORDS = "record_type string, record_id string, page string, uri string, refers_to string, segment int, origin string, total_length long, digest string, block binary"


def _record(kind: str, name: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), *headers, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode("utf-8", "surrogatepass") + b"\r\n" + block


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for i in range(0, len(payload), size) if (p := payload[i : i + size])]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """Raises ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if len(body) < at + n + 2 or body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("broken chunk")
        out.append(body[at : at + n])
        at += n + 2


def name_of(page: str, digest: str, row: int | None = None) -> str:
    return f"urn:page:{quote(page, safe='')}:{digest}" + (f":{row}" if row is not None else "")


def page_of(name: str) -> str:
    return unquote(name.split(":")[2])


def page_records(page: str, row: int, uri: str, payload: bytes, digest: str, first: str | None, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one page. first: the page that has the equal payload, for a revisit."""
    name = name_of(page, digest, row)
    uri = "".join(c for c in uri if c not in "\r\n")
    common = [("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if first is not None:
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        yield _record("revisit", name, [*common, ("WARC-Refers-To", f"<{name_of(first, digest)}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")], head)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    if len(parts) == 1:
        yield _record("response", name, common, block)
        return
    yield _record("response", name, [*common, ("WARC-Segment-Number", "1")], parts[0])
    for k, part in enumerate(parts[1:], 2):
        total = [("WARC-Segment-Total-Length", str(len(block)))] if k == len(parts) else []
        yield _record("continuation", f"{name}:{k}", [("WARC-Segment-Number", str(k)), ("WARC-Segment-Origin-ID", f"<{name}>"), *total], part)


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", segment: int = SEGMENT) -> None:
    """Write the archive of all rows as gzipped files below path."""
    plain = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("uri"), F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary")).alias("payload"))
    plain = plain.withColumn("digest", F.sha2("payload", 256))
    large = plain.where(F.octet_length("payload") >= MIN_DEDUP).select("id", "digest")
    first = large.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = large.join(first, "digest").where(~F.col("id").eqNullSafe(F.col("first"))).groupBy(F.col("id").alias("rid"), F.col("digest").alias("rdigest")).agg(F.min("first").alias("first"))
    later = cut(later)
    known = plain.join(bounded(later, 128), F.col("id").eqNullSafe(F.col("rid")) & (F.col("digest") == F.col("rdigest")), "left")
    rows = known.select(F.col("id").cast("string").alias("id"), "uri", "payload", "digest", F.col("first").cast("string").alias("first"), F.col("rdigest").isNotNull().alias("again"), F.monotonically_increasing_id().alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), 256):
                out = []
                for r in batch.slice(begin, 256).to_pylist():
                    out += page_records(r["id"] or "", r["row"], r["uri"], r["payload"], r["digest"], (r["first"] or "") if r["again"] else None, segment)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    records = rows.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)
    release(later)


def _parse(data: bytes) -> Iterator[dict]:
    at = 0
    while at < len(data):
        end = data.index(END, at)
        head = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if not head[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        h = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
        begin = end + 4
        n = int(h["content-length"])
        block = data[begin : begin + n]
        if len(block) != n or data[begin + n : begin + n + 4] != END:
            raise ValueError(f"record at byte {at} has a wrong length")
        name = h["warc-record-id"].strip("<>")
        yield {
            "record_type": h["warc-type"], "record_id": name, "page": page_of(name), "uri": h.get("warc-target-uri"),
            "refers_to": page_of(h["warc-refers-to"].strip("<>")) if "warc-refers-to" in h else None,
            "segment": int(h["warc-segment-number"]) if "warc-segment-number" in h else None,
            "origin": h["warc-segment-origin-id"].strip("<>") if "warc-segment-origin-id" in h else None,
            "total_length": int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None,
            "digest": h.get("warc-payload-digest", "").removeprefix("sha256:") or None, "block": block,
        }
        at = begin + n + 4


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives below path, as RECORDS; each file is parsed in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("page", pa.string()), ("uri", pa.string()), ("refers_to", pa.string()), ("segment", pa.int32()), ("origin", pa.string()), ("total_length", pa.int64()), ("digest", pa.string()), ("block", pa.binary())])
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                data = content.as_py()
                if name.as_py().endswith(".gz"):
                    data = zlib.decompress(data, wbits=31)
                held: list[dict] = []
                for r in _parse(data):
                    held.append(r)
                    if len(held) == 256:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content").mapInArrow(run, RECORDS)


def _payload(kind: str, block: bytes) -> tuple[int, str | None, str | None]:
    """Length, digest and problem of the payload of a whole block."""
    head, _, body = block.partition(END)
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    if kind == "revisit":
        return int(fields.get(b"content-length", b"0")), None, None
    try:
        payload = unchunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body
    except ValueError:
        return 0, None, "broken transfer framing"
    return len(payload), hashlib.sha256(payload).hexdigest(), None


RESULT = "page string, uri string, record_type string, refers_to string, payload_bytes long, payload_digest string, problem string"


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (page, uri, record_type, refers_to, digest, parts) to RESULT."""
    schema = pa.schema([("page", pa.string()), ("uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("problem", pa.string())])
    for batch in batches:
        for begin in range(0, len(batch), 256):
            out = []
            for r in batch.slice(begin, 256).to_pylist():
                parts = r["parts"]
                block = b"".join(p["block"] for p in parts)
                problem = None
                if len(parts) > 1 or parts[0]["segment"] is not None:
                    numbers, total = [p["segment"] for p in parts], [p["total_length"] for p in parts if p["total_length"] is not None]
                    if numbers != list(range(1, len(parts) + 1)) or not total:
                        problem = "a segment is missing"
                    elif total != [len(block)]:
                        problem = "wrong total length"
                n, digest, broken = _payload(r["record_type"], block) if problem is None else (0, None, None)
                problem = problem or broken
                if problem is None and digest is not None and r["digest"] is not None and digest != r["digest"]:
                    problem = "wrong digest"
                out.append({"page": r["page"], "uri": r["uri"], "record_type": r["record_type"], "refers_to": r["refers_to"], "payload_bytes": n, "payload_digest": digest or r["digest"], "problem": problem})
            yield pa.RecordBatch.from_pylist(out, schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row (RESULT) per response or revisit record, its segments reassembled."""
    records = read_records(spark, path)
    part = F.struct("segment", "total_length", "block")
    whole = records.where("record_type in ('response', 'revisit') and segment is null").select("page", "uri", "record_type", "refers_to", "digest", F.array(part).alias("parts"))
    # the origin's own fields come from its first segment; a record's segments are as many as its length needs
    own = records.where("segment is not null").groupBy(F.coalesce("origin", "record_id").alias("origin")).agg(F.max(F.when(F.col("segment") == 1, F.col("page"))).alias("page"), F.max("uri").alias("uri"), F.max("digest").alias("digest"), F.sort_array(F.collect_list(part)).alias("parts"))
    long = own.select("page", "uri", F.lit("response").alias("record_type"), F.lit(None).cast("string").alias("refers_to"), "digest", "parts")
    return whole.mapInArrow(_decode, RESULT).unionByName(long.mapInArrow(_decode, RESULT))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to a new archive in the shared folder, read it back and delete it."""
    spark = pages.sparkSession
    path = shared_dir(spark)
    write(pages, path)
    out = cut(read(spark, path))
    delete(spark, path)
    return out
