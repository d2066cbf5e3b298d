"""WARC archives: writing pages as records, and reading archives with segmented records put together again.

A record is a row of text, and Spark's text writer ends each with the two line breaks that the format asks for, so archives go
to any file system Spark writes to, and files hold a bounded number of records. Blocks longer than SEGMENT bytes are cut into a first
record and continuation records, which name it as their origin. Payloads are framed in chunks (transfer-encoding: chunked).
The reader parses each archive by the records' lengths, brings together the segments of a record by their origin, checks their
numbers and total length, and undoes the chunks. Archives may be gzip files of any number of members. What cannot be parsed
gives a row that says so, and the reader goes on at the next record it finds."""

from __future__ import annotations

import base64
import hashlib
import itertools
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, cut, shared_dir, table

SEGMENT, CHUNK, ARCHIVE_RECORDS = 65_536, 16_384, 1000
END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD = "record_id string, page_id {id}, url string, record_type string, refers_to {id}, payload binary, payload_bytes long, payload_digest string, problem string"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [payload[k : k + size] for k in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in [*parts, b""])


def dechunk(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where it should")
        out.append(body[at : at + size])
        at += size + 2


def named(page_id) -> str:
    """An id as it stands in a record's name: what isn't a letter or digit in percent codes; null is nothing, an empty string %."""
    return "" if page_id is None else quote(str(page_id), safe="", errors="surrogatepass") or "%"


def id_of(field: str | None) -> str | None:
    """The id's text in a name or reference that named() made, or None."""
    parts = (field or "").strip("<>").split(":")
    return unquote(parts[2].removesuffix("%") if parts[2] == "%" else parts[2], errors="surrogatepass") if parts[:2] == ["urn", "x-page"] and len(parts) > 2 and parts[2] else None


def _record(kind: str, block: bytes, **fields) -> bytes:
    head = [b"WARC/1.1", b"WARC-Type: " + kind.encode()]
    head += [f"{k.replace('_', '-')}: {v}".replace("\r", "%0D").replace("\n", "%0A").encode("utf-8", "surrogatepass") for k, v in fields.items() if v is not None]
    return b"\r\n".join([*head, b"Content-Length: %d" % len(block), b"", block])


def page_records(page_id, row: int, url, html, refers_to, segment: int = SEGMENT) -> list[bytes]:
    """The records of a page, without their ends. refers_to: the page with the same payload, for a revisit."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    ident = f"<urn:x-page:{named(page_id)}:{row}>"
    common = {"WARC_Target_URI": url, "WARC_Date": "1970-01-01T00:00:00Z", "WARC_Payload_Digest": "sha1:" + sha1_base32(payload)}
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers_to is not None:
        return [_record("revisit", http, WARC_Record_ID=ident, **common, WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", WARC_Refers_To=f"<urn:x-page:{named(refers_to)}>", X_Payload_Length=len(payload), Content_Type="application/http;msgtype=response")]
    block = http + chunked(payload)
    parts = [block[k : k + segment] for k in range(0, len(block), segment)]
    first = {} if len(parts) == 1 else {"WARC_Segment_Number": 1}
    out = [_record("response", parts[0], WARC_Record_ID=ident, **common, **first, Content_Type="application/http;msgtype=response")]
    for k, p in enumerate(parts[1:], 2):
        total = {"WARC_Segment_Total_Length": len(block)} if k == len(parts) else {}
        out.append(_record("continuation", p, WARC_Record_ID=f"{ident[:-1]}:{k}>", WARC_Segment_Origin_ID=ident, WARC_Segment_Number=k, **total))
    return out


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, segment: int = SEGMENT) -> None:
    """Writes archives of a record for each row of pages (and continuation records) to a new folder.

    Of rows with equal payloads of at least `least` bytes, that with the smallest id is a response and the others revisits of it; all smaller
    ones are responses. A null html is an empty payload; a null id is never referred to, and equal payloads of which all ids
    are null are all responses; rows that repeat the smallest id are too. Null urls are left out. An empty table writes empty archives."""
    kind = pages.schema[id_col].dataType.simpleString()
    raw = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.monotonically_increasing_id().alias("row"))
    raw = raw.withColumn("digest", F.unhex(F.sha1(F.coalesce("html", F.lit(""))))).withColumn("big", F.octet_length(F.coalesce("html", F.lit(""))) >= least)
    same = cut(raw.filter("big").groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null"))
    total = same.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if total:
        raw = attach(raw, same, ["digest"], "n", max(total, 1)).withColumn("refers_to", F.when(F.col("big") & ~F.col("id").eqNullSafe(F.col("first")), F.col("first")))
    else:
        raw = raw.withColumn("refers_to", F.lit(None).cast(kind))

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 256):
                rows = b.slice(k, 256).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([x for r in rows for x in page_records(r["id"], r["row"], r["url"], r["html"], r["refers_to"], segment)], pa.binary())], names=["record"])

    records = raw.select("id", "row", "url", "html", "refers_to").mapInArrow(run, "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", ARCHIVE_RECORDS).text(path)


def members(data: bytes) -> tuple[bytes, str | None]:
    """The bytes of an archive that may be compressed, and what was wrong with them."""
    if data[:2] != b"\x1f\x8b":
        return data, None
    out = []
    while data[:2] == b"\x1f\x8b":
        one = zlib.decompressobj(31)
        try:
            out.append(one.decompress(data))
        except zlib.error as e:
            return b"".join(out), f"compression: {e}"
        if not one.eof:
            return b"".join(out), "compression: a member is cut off"
        data = one.unused_data
    return b"".join(out), None


def parse_archive(data: bytes):
    """(fields, block, problem) of the records; field names in lower case. Bytes that are no record are one row with a problem."""
    at, view = 0, memoryview(data)
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogateescape").split("\r\n") if data[at : at + 5] == b"WARC/" and end >= 0 else []
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        stated, start = fields.get("content-length", ""), end + 4
        if lines and stated.isascii() and stated.isdigit() and start + int(stated) <= len(data):
            yield fields, bytes(view[start : start + int(stated)]), None
            at = start + int(stated)
            continue
        after = data.find(b"\r\nWARC/", at)
        yield fields, b"", f"no record at byte {at}" if not lines else f"the record at byte {at} is cut off" if stated.isascii() and stated.isdigit() else f"the record at byte {at} has no length"
        at = len(data) if after < 0 else after + 2


def _decoded(fields: dict, block: bytes, problem: str | None, ident) -> dict:
    """A result row of RECORD; ident makes an id of its text."""
    def given(field):
        try:
            return None if (text := id_of(fields.get(field))) is None else ident(text)
        except ValueError:  # another archive's names
            return None

    out = {"record_id": fields.get("warc-record-id"), "page_id": given("warc-record-id"), "url": fields.get("warc-target-uri"), "record_type": fields.get("warc-type"), "refers_to": None, "problem": problem, "payload": None}
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if out["record_type"] == "revisit":
        stated_length = fields.get("x-payload-length", "0")
        return out | {"refers_to": given("warc-refers-to"), "payload_bytes": int(stated_length) if stated_length.isascii() and stated_length.isdigit() else None, "payload_digest": stated}
    if problem and not block:
        return out | {"payload_bytes": None, "payload_digest": None}
    payload = block
    if fields.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        if b"transfer-encoding: chunked" in head.lower() and problem is None:
            try:
                payload = dechunk(payload)
            except ValueError as e:
                out["problem"] = f"chunks: {e}"
    digest = sha1_base32(payload)
    if stated and stated != digest and fields["warc-payload-digest"].startswith("sha1:"):
        out["problem"] = out["problem"] or "payload digest differs"
    return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": digest}


def read_warc(spark: SparkSession, path: str, id_type: str = "bigint", payload: bool = True) -> DataFrame:
    """A row (RECORD) for each record of the archives in path, of whatever type, continuation records joined to their first.

    problem is null for a sound record, or says what is wrong: no record where one should begin, no or too long a length, missing
    segments, a wrong total length, broken chunks or compression, another digest than stated. page_id and refers_to are those of
    records that write_warc made, else null. Archives hold bounded numbers of records, as write_warc makes them, and each is read whole by
    one task, as Spark's reader of binary files gives them (2 GB at most).
    payload=False leaves the payload column null, after it was measured. Empty archives give no rows."""
    schema = RECORD.format(id=id_type)
    ident = str if id_type == "string" else int
    names = [x.split()[0] for x in schema.split(", ")]
    types = pa.schema([(n, {"binary": pa.binary(), "bigint": pa.int64(), "long": pa.int64(), "int": pa.int32(), "string": pa.string()}[x.split()[1]]) for n, x in zip(names, schema.split(", "))])

    def batch(rows):
        return pa.RecordBatch.from_pylist([{n: None if n == "payload" and not payload else r.get(n) for n in names} for r in rows], types)

    def parse(batches):
        held = pa.schema([*types, ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary()), ("head", pa.map_(pa.string(), pa.string()))])
        for b in batches:
            for k in range(b.num_rows):
                rows = []
                data, broken = members(b.column(0)[k].as_py())
                for fields, block, problem in itertools.chain(parse_archive(data), [({}, b"", broken)] if broken else []):
                    number, total = (int(x) if (x := fields.get(f"warc-segment-{f}", "")).isascii() and x.isdigit() else None for f in ("number", "total-length"))
                    if number is not None and problem is None:
                        rows.append({"origin": fields.get("warc-segment-origin-id") or fields.get("warc-record-id"), "segment": number, "total": total, "block": block, "head": list(fields.items())})
                    else:
                        rows.append(_decoded(fields, block, problem, ident) | ({} if payload else {"payload": None}))
                    if len(rows) >= 256:
                        yield pa.RecordBatch.from_pylist(rows, held)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, held)

    parsed = spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, f"{schema}, origin string, segment int, total long, block binary, head map<string,string>")
    parts = parsed.filter("origin is not null")
    joined = parts.groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("segment", "total", "block"))).alias("parts"), F.max(F.when(F.col("segment") == 1, F.map_entries("head"))).alias("head"))

    def assemble(batches):
        for b in batches:
            for r in b.to_pylist():
                blocks, found = [p["block"] for p in r["parts"]], [p["segment"] for p in r["parts"]]
                whole, total = b"".join(blocks), r["parts"][-1]["total"]
                problem = "segments are missing" if found != list(range(1, len(found) + 1)) or total is None else "total length differs" if total != len(whole) else None
                fields = {e["key"]: e["value"] for e in r["head"] or ()} or {"warc-record-id": r["origin"]}
                yield batch([_decoded(fields, whole, problem, ident)])

    return parsed.filter("origin is null").select(*names).unionByName(joined.mapInArrow(assemble, schema))


def op6_warc(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = shared_dir(spark)
    write_warc(pages, path)
    return read_warc(spark, path, pages.schema["page_id"].dataType.simpleString(), payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) || '0' AS x, min(page_id) OVER (PARTITION BY h) AS one FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('{BASE32}', CAST(1 + ((((strpos('0123456789abcdef', substr(x, CAST(5 * k // 4 + 1 AS INTEGER), 1)) - 1) * 16
    + strpos('0123456789abcdef', substr(x, CAST(5 * k // 4 + 2 AS INTEGER), 1)) - 1) >> CAST(3 - 5 * k % 4 AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = one THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> one THEN one END AS refers_to
FROM d
"""
