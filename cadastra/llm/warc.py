"""WARC archives: write pages as records, read archives back by segment reassembly.

Writing.  A page is an HTTP response in chunked transfer framing.  A block longer
than ``SEGMENT_BYTES`` is cut: the first part is the response record with segment
number 1, the others are ``continuation`` records that name it as their origin, the
last of them with the total length.  Equal payloads of ``REVISIT_BYTES`` or more are
stored once, the others are ``revisit`` records that refer to it.  Every record ends
in two empty lines, which is also how Spark's text writer can end its lines, so
archives are written by Spark's committer: lost or repeated tasks leave no part
records.  Archives hold at most ``ARCHIVE_RECORDS`` records, which bounds their size.

Reading.  Archives are parsed by the lengths in their headers.  Whole records are
done at once; segments are grouped by their origin, ordered by number, checked
against the total length, joined and their chunks decoded.  Payload digests are
verified.  Revisits are resolved by the record that they refer to."""

from __future__ import annotations

import gzip
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

SEGMENT_BYTES = 32 << 10
REVISIT_BYTES = 1000
ARCHIVE_RECORDS = 1000
CHUNK_BYTES = 8192
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: So many digests of repeated payloads at most (32 bytes and an id each) are broadcast.
BROADCAST_DIGESTS = 500_000


def record_id(kind: str, key: int | None, digest: str, part: int = 1) -> str:
    h = hashlib.md5(f"{kind}|{key}|{digest}|{part}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def header(kind: str, name: str, block: bytes, **fields: str | int | None) -> bytes:
    """A record's header and block, without the two empty lines after it."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}", f"Content-Length: {len(block)}"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None]
    return "\r\n".join(lines).encode() + END + block


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        at = end + 2
        out.append(body[at : at + size])
        if len(out[-1]) != size or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        at += size + 2


HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def records_of(key: int | None, url: str | None, payload: bytes, response: int | None, segment: int = SEGMENT_BYTES) -> list[bytes]:
    """The records of one page; ``response`` is the page that it revisits."""
    digest = hashlib.sha1(payload).hexdigest()
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else None
    told = {"WARC_Target_URI": uri, "WARC_Payload_Digest": f"sha1:{digest}", "X_Page_Id": key}
    if response is not None:
        return [header("revisit", record_id("revisit", key, digest), b"HTTP/1.1 200 OK\r\n\r\n", WARC_Profile=PROFILE, WARC_Refers_To=record_id("response", response, digest), Content_Type="application/http;msgtype=response", **told)]
    block, origin = HTTP + chunked(payload), record_id("response", key, digest)
    told |= {"Content_Type": "application/http;msgtype=response"}
    if len(block) <= segment:
        return [header("response", origin, block, **told)]
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = [header("response", origin, parts[0], WARC_Segment_Number=1, **told)]
    for k, part in enumerate(parts[1:], 2):
        out.append(header("continuation", record_id("continuation", key, digest, k), part, WARC_Segment_Origin_ID=origin, WARC_Segment_Number=k, WARC_Segment_Total_Length=len(block) if k == len(parts) else None))
    return out


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """One record per row of ``pages``.  Of equal payloads of ``REVISIT_BYTES`` or more
    the row with the largest id is the response; the others revisit it.  Repeated rows
    of that id are responses too; null ids are never the largest unless all are null,
    and then all are responses.  Null html is an empty payload; null urls are left out.
    Very long pages become segments.  An empty table gives an empty folder.

    Repeated payloads are found by digests and ids alone; the payloads themselves are
    shuffled only where more than ``BROADCAST_DIGESTS`` different ones are repeated."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    digest, long = F.unhex(F.sha2("payload", 256)), F.octet_length("payload") >= REVISIT_BYTES
    stored = rows.where(long).select("id", digest.alias("d")).groupBy("d").agg(F.max("id").alias("stored"), F.count("*").alias("c"))
    stored = shared.checkpoint(stored.where("c > 1").select("d", "stored"))
    response = F.when(~F.col("id").eqNullSafe(F.col("stored")), F.col("stored")).alias("response")
    if stored.count() <= BROADCAST_DIGESTS:  # no payload is shuffled
        marked = rows.withColumn("d", F.when(long, digest)).join(F.broadcast(stored), "d", "left").select("id", "url", "payload", response)
    else:  # short payloads stay out of the join, where they would all have one key
        marked = rows.where(long).withColumn("d", digest).join(stored, "d", "left").select("id", "url", "payload", response)
        marked = marked.union(rows.where(~long).select("id", "url", "payload", F.lit(None).cast("long")))

    def run(batches):
        count = 0
        for b in batches:
            out = []
            for key, url, payload, response in zip(*(c.to_pylist() for c in b.columns)):
                for r in records_of(key, url, payload, response):
                    if count % ARCHIVE_RECORDS == 0:
                        out.append(header("warcinfo", record_id("warcinfo", count, ""), b"format: WARC File Format 1.1\r\n", Content_Type="application/warc-fields"))
                        count += 1
                    out.append(r)
                    count += 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    lines = shared.map_batches(marked, run, "value binary").select(F.col("value").cast("string"))
    lines.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", ARCHIVE_RECORDS).text(path)


def parse(data: bytes):
    """``(fields, block)`` of every record; gzipped archives are inflated first."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no WARC record at byte {at}")
        end = data.index(END, at)
        fields = {}
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            k, _, v = line.partition(":")
            fields[k.strip().lower()] = v.strip()
        size = int(fields["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size or data[end + 4 + size : end + 8 + size] != END:
            raise ValueError("a record is cut short")
        yield fields, block
        at = end + 8 + size


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(END)
    return dechunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head) else body


RECORDS = "kind string, record string, id long, url string, refers string, digest string, segment int, total long, payload_bytes long, payload binary, block binary"


def _finish(block: bytes, digest: str, keep: bool) -> tuple[int, bytes | None]:
    payload = payload_of(block)
    if digest and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("a payload does not have the digest told")
    return len(payload), payload if keep else None


def read_records(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """A row per record.  Whole responses have their payload (its length always),
    segments their block."""
    files = spark.read.format("binaryFile").load(path).select("content")
    kinds = [pa.string()] * 2 + [pa.int64()] + [pa.string()] * 3 + [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    names = [c.split()[0] for c in RECORDS.split(", ")]

    def run(batches):
        for b in batches:
            for content in b.column(0):
                rows = []
                for f, block in parse(content.as_py()):
                    kind = f["warc-type"]
                    if kind not in ("response", "continuation", "revisit"):
                        continue
                    digest = f.get("warc-payload-digest", "").removeprefix("sha1:")
                    segment = int(f["warc-segment-number"]) if "warc-segment-number" in f else None
                    size, payload = _finish(block, digest, keep_payload) if kind == "response" and segment is None else (None, None)
                    rows.append((
                        kind, f.get("warc-segment-origin-id", f["warc-record-id"]), int(f["x-page-id"]) if "x-page-id" in f else None, f.get("warc-target-uri"), f.get("warc-refers-to"),
                        digest or None, segment, int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, size, payload, block if segment is not None else None))
                for i in range(0, len(rows), 500):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 500]), kinds)], names=names)

    return shared.map_batches(files, run, RECORDS)


def reassemble(records: DataFrame, keep_payload: bool = True) -> DataFrame:
    """``(kind, record, id, url, digest, payload_bytes, payload)`` per stored response:
    segments by origin, in order of number, verified against the total length.

    Origins that were written more than once (repeated rows) give as many rows."""
    part = F.struct("segment", "total", "id", "url", "digest", "block")
    groups = records.where("segment IS NOT NULL").groupBy("record").agg(F.sort_array(F.collect_list(part)).alias("parts"))  # one page's block
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["kind", "record", "id", "url", "digest", "payload_bytes", "payload"]

    def run(batches):
        for b in batches:
            rows = []
            for record, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                copies = sum(p["segment"] == 1 for p in parts)
                once = list({p["segment"]: p for p in parts}.values())
                block = b"".join(p["block"] for p in once)
                if [p["segment"] for p in once] != list(range(1, len(once) + 1)) or once[-1]["total"] != len(block):
                    raise ValueError(f"segments of {record} are missing")
                size, payload = _finish(block, once[0]["digest"], keep_payload)
                rows += [("response", record, once[0]["id"], once[0]["url"], once[0]["digest"], size, payload)] * copies
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    joined = groups.mapInArrow(run, "kind string, record string, id long, url string, digest string, payload_bytes long, payload binary")
    return records.where("kind = 'response' AND segment IS NULL").select(*names).union(joined)


def archived_pages(spark: SparkSession, path: str) -> DataFrame:
    """``(id, payload_bytes, payload_digest, record_type, refers_to)`` per page record
    in the archives: responses by their reassembled payload, revisits by the record
    that they refer to (a join on its id; unresolved ones keep null lengths)."""
    records = shared.materialise(read_records(spark, path, keep_payload=False), "warc-records")
    stored = shared.materialise(reassemble(records, keep_payload=False), "warc-pages")
    target = stored.groupBy(F.col("record").alias("refers")).agg(F.first("id").alias("refers_to"), F.first("payload_bytes").alias("size"))
    revisits = records.where("kind = 'revisit'").select("id", "digest", "refers").join(target, "refers", "left")
    return stored.select("id", "payload_bytes", F.col("digest").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).union(
        revisits.select("id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to"))


#: DuckDB SQL of the query: digests and the largest page of equal payloads.
ORACLE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS last FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to FROM q
"""
