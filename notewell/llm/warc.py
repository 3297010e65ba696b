"""WARC archives: written with segmented, chunk-framed responses, and read back by reassembly.

Writing. A page whose payload already stands in an earlier page becomes a revisit record; every
other one is an HTTP response whose body is in chunked transfer framing. Blocks longer than
``segment_bytes`` are cut into a first record and continuation records that name it by
WARC-Segment-Origin-ID; the last one has WARC-Segment-Total-Length. The archives are plain WARC
files behind gzip, written by Spark's text sink with the record terminator as its line separator.

Reading. Each archive is parsed record by record; whole records are decoded where they are and
only the segments of cut ones are grouped by origin, ordered by segment number, checked for a
gapless sequence and the total length, and joined before their framing is decoded.

Scale: equal payloads meet by digest and length alone (a partial minimum, then a join that
adaptive execution splits where one payload is frequent); payloads themselves cross one shuffle
by page_id. An archive holds at most about ``archive_bytes``, so no task holds more than that.

Defined results: a null html is an empty payload; rows with a null page_id are responses that
nothing refers to; repeated rows with one page_id and payload are all responses; payloads of
fewer than ``revisit_bytes`` bytes are never revisited; an empty table makes no record. Malformed
headers, broken segments or framing give a row with a ``status`` other than ``ok``.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewell.llm.common import Workspace

SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
REVISIT_BYTES = 0
ARCHIVE_BYTES = 32_000_000

_END = b"\r\n\r\n"
_DATE = "2024-01-01T00:00:00Z"
RECORD = "row_id bigint, page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, refers_to bigint"
PARSED = "kind string, record_id string, page_id bigint, url string, block binary, payload_bytes bigint, payload_digest string, refers_to bigint, segment bigint, origin string, total bigint, status string"
READ = "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, segments bigint, status string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record_id(page_id: int | None, row_id: int) -> str:
    """A stable urn of a row: the rows of one page_id stay apart."""
    name = hashlib.md5(f"{page_id}:{row_id}".encode(), usedforsecurity=False).hexdigest()
    return f"<urn:uuid:{name[:8]}-{name[8:12]}-{name[12:16]}-{name[16:20]}-{name[20:]}>"


def chunked(payload: bytes, size: int) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(part), part) for part in (payload[k : k + size] for k in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; None if its framing is broken."""
    at, parts = 0, []
    while (line := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:line].partition(b";")[0], 16)
        except ValueError:
            return None
        at = line + 2 + size
        if body[at : at + 2] != b"\r\n" or size < 0:
            return None
        if not size:
            return b"".join(parts)
        parts.append(body[line + 2 : at])
        at += 2
    return None


def _head(fields: dict[str, object]) -> bytes:
    return b"WARC/1.0\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields.items() if v is not None) + b"\r\n"


def records_of(page_id, row_id, url, payload, payload_bytes, payload_digest, refers_to, segment_bytes: int, chunk_bytes: int) -> list[bytes]:
    """The records of one page without their terminators."""
    own = record_id(page_id, row_id)
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    common = {"WARC-Record-ID": own, "WARC-Date": _DATE, "WARC-Target-URI": target or None, "X-Page-ID": page_id}
    payload_fields = {"WARC-Payload-Digest": f"sha1:{payload_digest}", "X-Payload-Length": payload_bytes}
    if refers_to is not None:
        fields = {"WARC-Type": "revisit", **common, **payload_fields, "X-Refers-To-Page-ID": refers_to}
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", "Content-Length": 0}
        return [_head(fields)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload or b"", chunk_bytes)
    parts = [block[k : k + segment_bytes] for k in range(0, len(block), segment_bytes)]
    first = {"WARC-Type": "response", **common, **payload_fields, "Content-Type": "application/http; msgtype=response"}
    if len(parts) == 1:
        return [_head(first | {"Content-Length": len(block)}) + block]
    out = [_head(first | {"WARC-Segment-Number": 1, "Content-Length": len(parts[0])}) + parts[0]]
    for k, part in enumerate(parts[1:], start=2):
        fields = {"WARC-Type": "continuation", "WARC-Record-ID": record_id(page_id, -row_id * 1_000_003 - k), "WARC-Date": _DATE, "WARC-Target-URI": target or None}
        fields |= {"WARC-Segment-Origin-ID": own, "WARC-Segment-Number": k, "WARC-Segment-Total-Length": len(block) if k == len(parts) else None, "Content-Length": len(part)}
        out.append(_head(fields) + part)
    return out


def _decided(pages: DataFrame, revisit_bytes: int) -> DataFrame:
    """Pages with their payload and the page they refer to, if they revisit one."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), payload.alias("payload"))
    seen = base.select("page_id", F.sha1("payload").alias("sha"), F.octet_length("payload").cast("bigint").alias("payload_bytes"))
    first = seen.where(F.col("page_id").isNotNull() & (F.col("payload_bytes") >= revisit_bytes)).groupBy("sha", "payload_bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    copied = seen.where(F.col("page_id").isNotNull()).join(first.where("n > 1").withColumnRenamed("payload_bytes", "bytes").withColumnRenamed("sha", "of"), (F.col("sha") == F.col("of")) & (F.col("payload_bytes") == F.col("bytes")))
    revisits = copied.where(F.col("first") < F.col("page_id")).select("page_id", F.col("sha").alias("of"), F.col("first").alias("refers_to")).distinct()
    with_sha = base.withColumn("sha", F.sha1("payload"))
    joined = with_sha.join(revisits.withColumnRenamed("page_id", "id"), (F.col("page_id") == F.col("id")) & (F.col("sha") == F.col("of")), "left")
    return joined.select(F.monotonically_increasing_id().alias("row_id"), "page_id", "url", "payload", "refers_to")


def write_archives(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, revisit_bytes: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write every page as WARC records into gzipped archives under ``path``."""

    def emit(batches):
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                payload = row["payload"]
                row |= {"payload_bytes": len(payload), "payload_digest": digest(payload)}
                made += records_of(**row, segment_bytes=segment_bytes, chunk_bytes=chunk_bytes)
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])

    per_file = max(1, archive_bytes // segment_bytes)
    records = _decided(pages, revisit_bytes).mapInArrow(emit, "value binary")
    # casting keeps the bytes as they are, and the text sink writes them so
    records.select(F.col("value").cast("string").alias("value")).write.option("lineSep", _END.decode()).option("compression", "gzip").option("maxRecordsPerFile", per_file).mode("overwrite").text(path)


def _unzipped(data: bytes) -> bytes:
    """All gzip members of an archive; a broken one ends it with what it gave until then."""
    parts = []
    while data:
        stream = zlib.decompressobj(31)
        try:
            parts.append(stream.decompress(data))
        except zlib.error:
            break
        data = stream.unused_data
    return b"".join(parts)


def _number(text: str | None) -> int | None:
    """A header's number; None where there is none or it isn't one of 63 bits."""
    if text is None or not re.fullmatch(r"-?[0-9]{1,19}", text):
        return None
    n = int(text)
    return n if -(2**63) <= n < 2**63 else None


def parse_archive(data: bytes) -> list[dict]:
    """Every record of an archive, as its header fields, block and status.

    A record whose header gives no usable length is one of status ``no length``, and reading goes
    on at the next line that begins a record; so it does after bytes that begin none. A torn tail
    is ``torn record``. Header bytes that aren't UTF-8 are replaced.
    """
    found, at = [], 0
    while (at := _next_record(data, at)) >= 0:
        stop = data.find(_END, at)
        if stop < 0:
            found.append({"warc-type": "response", "block": b"", "status": "torn record"})
            break
        lines = data[at:stop].split(b"\r\n")
        fields = {k.decode(errors="replace").lower(): v.strip().decode(errors="replace") for k, _, v in (line.partition(b":") for line in lines[1:])}
        size = _number(fields.get("content-length"))
        if size is None or size < 0:
            found.append(fields | {"warc-type": fields.get("warc-type", "response"), "block": b"", "status": "no length"})
            at = stop
            continue
        block = data[stop + 4 : stop + 4 + size]
        broken = [v for k, v in NUMBERS.items() if v in fields and _number(fields[v]) is None]
        status = "torn record" if len(block) != size else f"broken {broken[0]}" if broken else "ok"
        found.append(fields | {"block": block, "status": status})
        at = stop + 4 + size
    return found


def _next_record(data: bytes, at: int) -> int:
    """Where the next record begins: at once but for line ends, or else at the next line that does."""
    while data[at : at + 2] == b"\r\n":
        at += 2
    if at >= len(data) or data.startswith(b"WARC/", at):
        return at if at < len(data) else -1
    found = data.find(b"\nWARC/", at)
    return found + 1 if found >= 0 else -1


# The header fields that hold numbers.
NUMBERS = {"segment": "warc-segment-number", "total": "warc-segment-total-length", "page_id": "x-page-id", "refers_to": "x-refers-to-page-id", "payload_bytes": "x-payload-length"}


def _payload(block: bytes) -> tuple[bytes | None, str]:
    head, mark, body = block.partition(_END)
    if not mark:
        return None, "no HTTP header"
    if b"transfer-encoding: chunked" in head.lower():
        body = unchunked(body)
        if body is None:
            return None, "broken chunk framing"
    return body, "ok"


def _whole(batches):
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "segments", "status"]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            parts = r.get("parts")
            block, status, segments = r["block"], r["status"], 1
            if parts is not None:
                numbers = [p["segment"] for p in parts]
                block, segments = b"".join(p["block"] for p in parts), len(parts)
                if numbers != list(range(1, len(parts) + 1)) or r["total"] is None:
                    status = "segments missing"
                elif r["total"] != len(block):
                    status = "total length differs"
            payload, size, sha = None, r["payload_bytes"], r["payload_digest"]
            if r["kind"] == "response" and status == "ok":
                payload, status = _payload(block)
                if payload is not None:
                    size, said, sha = len(payload), sha, digest(payload)
                    if said and said != sha:
                        status = "payload digest differs"
            rows.append((r["page_id"], r["url"], payload, size, sha, r["kind"], r["refers_to"], segments, status))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(kinds)], names=names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row for each response or revisit of the archives under ``path``."""

    def parse(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows = []
                for f in parse_archive(_unzipped(content) if content[:2] == b"\x1f\x8b" else content):
                    numbers = {k: _number(f.get(v)) for k, v in NUMBERS.items()}
                    rows.append({
                        "kind": f.get("warc-type"), "record_id": f.get("warc-record-id"), "url": f.get("warc-target-uri"), "block": f["block"], "origin": f.get("warc-segment-origin-id"),
                        "payload_digest": (f.get("warc-payload-digest") or "").rpartition(":")[2] or None, "status": f["status"], **numbers,
                    })
                for at in range(0, len(rows), 500):
                    yield pa.RecordBatch.from_pylist(rows[at : at + 500], schema=PARSED_ARROW)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path).select("content")
    parsed = files.mapInArrow(parse, PARSED)
    main = ["kind", "page_id", "url", "block", "payload_bytes", "payload_digest", "refers_to", "status"]
    cut = F.col("segment").isNotNull()
    whole = parsed.where(~cut & F.col("kind").isin("response", "revisit")).select(*main).mapInArrow(_whole, READ)
    pieces = parsed.where(cut).withColumn("of", F.coalesce("origin", "record_id"))
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    grouped = pieces.groupBy("of").agg(
        F.lit("response").alias("kind"), first("page_id"), F.max("url").alias("url"), F.lit(None).cast("binary").alias("block"), first("payload_bytes"), first("payload_digest"),
        F.lit(None).cast("bigint").alias("refers_to"), F.max("status").alias("status"), F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"),
    )
    return whole.unionByName(grouped.drop("of").mapInArrow(_whole, READ))


PARSED_ARROW = pa.schema([
    ("kind", pa.string()), ("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("block", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("refers_to", pa.int64()), ("segment", pa.int64()), ("origin", pa.string()), ("total", pa.int64()), ("status", pa.string()),
])


def round_trip(pages: DataFrame, **how: int) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    space = Workspace(pages.sparkSession)
    write_archives(pages, space.path("archives"), **how)
    return read_archives(pages.sparkSession, space.path("archives"))
