"""Operator 6: WARC archives with a salvage reader.

Writer: one gzip member per record, written by Spark's text sink. A row's value is the member's bytes and the line
separator is an empty gzip member, so a file is a plain sequence of members (valid multi-member gzip), committed
by Spark's own commit protocol in any store. Payloads equal to that of a smaller key become revisit records.

Reader: walks an archive member by member (or record by record where it is not compressed) and checks zlib's
CRC, the version line, lengths, the record's end and the block digest. After a failed check it searches the next
place where a valid member or version line starts, goes on there, and logs the bytes between as a gap.

Defined results: a null payload is empty; payloads under ``least`` bytes are never revisits; rows repeating a
response's key are responses; rows with a null key have the id "none" and can only revisit; target URIs are
percent-encoded, null is empty; an empty table gives archives without records.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propval.llm.common import materialize, shared_path, table

# Fixed values of the formats.
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
GZIP_MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
NEXT = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

LEAST_PAYLOAD = 100  # bytes below which a payload is always a response
RECORDS_PER_FILE = 2000
CHUNK = 1 << 16  # bytes given to zlib at once
LEVEL = 3


def record(key: str, uri: str, payload: bytes, digest: str, refers_to: str | None, date: str = DATE) -> bytes:
    """A response record, or a revisit record that keeps only the HTTP head."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:record:{quote(key, safe='')}>",
            f"WARC-Date: {date}", f"WARC-Target-URI: {quote(uri, safe=':/?&=#%+,;@!~*()')}", f"WARC-Payload-Digest: sha256:{digest}",
            f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response",
            f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:record:{quote(refers_to, safe='')}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            part = batch.slice(i, 64)
            made = [member(record(k, u, p, d, r)) for k, u, p, d, r in zip(*[c.to_pylist() for c in part.columns])]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["member"])


def write_warc(pages: DataFrame, path: str, key: str, uri: str, payload: str, least: int = LEAST_PAYLOAD) -> None:
    """Write one record per row into .warc.gz content below ``path``."""
    rows = pages.select(F.col(key).alias("key"), F.coalesce(F.col(uri), F.lit("")).alias("uri"),
                        F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # one row per payload that occurs more than once; written, so that Spark broadcasts it only if its files are small
    firsts = materialize(rows.filter(F.octet_length("payload") >= least).groupBy("digest").agg(
        F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null").select(
        F.col("digest").alias("_digest"), "first"), "warc-firsts")
    marked = rows.join(firsts, rows["digest"] == firsts["_digest"], "left").select(
        F.coalesce(F.col("key").cast("string"), F.lit("none")).alias("key"), "uri", "payload", "digest",
        F.when(~F.col("key").eqNullSafe(F.col("first")), F.col("first")).cast("string").alias("refers_to"))
    made = marked.mapInArrow(_members, "member binary").select(F.col("member").cast("string").alias("value"))
    (made.write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1")
     .option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


class Damaged(ValueError):
    """A check of a member or record failed."""


def _inflate(data: bytes, at: int) -> tuple[bytes, int]:
    """Content and end of the gzip member at ``at``."""
    z, out, pos = zlib.decompressobj(31), [], at
    try:
        while not z.eof:
            if pos >= len(data):
                raise Damaged("truncated member")
            out.append(z.decompress(data[pos:pos + CHUNK]))
            pos += CHUNK
    except zlib.error as e:
        raise Damaged("broken member") from e
    return b"".join(out), min(pos, len(data)) - len(z.unused_data)


def _header(fields: dict[str, str], name: str) -> str:
    if name not in fields:
        raise Damaged(f"no {name}")
    return fields[name]


def _record(data: bytes, at: int) -> tuple[dict, int]:
    """Fields and end of the record whose version line is at ``at``."""
    if not VERSION.match(data, at):
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Damaged("truncated header")
    lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    length = _header(fields, "content-length")
    if not length.isdigit():
        raise Damaged("bad length")
    start, stop = end + 4, end + 4 + int(length)
    if data[stop:stop + 4] != b"\r\n\r\n":
        raise Damaged("no end of record")
    block = data[start:stop]
    kind, given = _header(fields, "warc-type"), fields.get("warc-block-digest")
    if given is not None and given.startswith("sha256:") and given[7:] != hashlib.sha256(block).hexdigest():
        raise Damaged("block digest")
    head, _, body = block.partition(b"\r\n\r\n")
    told = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", head)
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind == "response" and digest and digest != hashlib.sha256(body).hexdigest():
        raise Damaged("payload digest")
    name = lambda x: x.removeprefix("<urn:record:").removesuffix(">")
    return {"record_id": name(fields.get("warc-record-id", "")), "record_type": kind, "uri": fields.get("warc-target-uri", ""),
            "refers_to": name(fields["warc-refers-to"]) if "warc-refers-to" in fields else None,
            "payload_digest": digest if kind == "revisit" else hashlib.sha256(body).hexdigest(),
            "payload_bytes": int(told[1]) if kind == "revisit" and told else len(body), "payload": body}, stop + 4


def salvage(data: bytes) -> Iterator[dict]:
    """Records of one archive with their ``start`` and ``stop``, and gaps (record_type "gap", with a reason)."""
    at, lost, why = 0, None, ""
    while at < len(data):
        try:
            found = []
            if data.startswith(GZIP_MAGIC, at):
                inner, stop = _inflate(data, at)
                pos = 0
                while pos < len(inner):
                    rec, pos = _record(inner, pos)
                    found.append(rec)
            else:
                rec, stop = _record(data, at)
                found.append(rec)
        except Damaged as e:
            lost, why = (at, str(e)) if lost is None else (lost, why)
            following = NEXT.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if lost is not None:
            yield {"record_type": "gap", "start": lost, "stop": at, "reason": why}
            lost = None
        for rec in found:
            yield rec | {"start": at, "stop": stop}
        at = stop
    if lost is not None:
        yield {"record_type": "gap", "start": lost, "stop": len(data), "reason": why}


SCHEMA = ("archive string, start long, stop long, record_type string, record_id string, uri string, refers_to string, "
          "payload_bytes long, payload_digest string, reason string")


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Records and gaps of all archives below ``path`` (SCHEMA; with the payload as text on request)."""
    schema = SCHEMA + (", payload string" if with_payload else "")
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            types = {"start": pa.int64(), "stop": pa.int64(), "payload_bytes": pa.int64()}
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], types.get(n, pa.string())) for n in names], names=names)

        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows = []
                for rec in salvage(content.as_py()):
                    text = rec.pop("payload", b"").decode("utf-8", "replace")
                    rows.append(rec | {"archive": name.as_py()} | ({"payload": text} if with_payload else {}))
                    if len(rows) == 256:
                        yield out(rows)
                        rows = []
                yield out(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, schema)


def q_op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back."""
    path, pages = shared_path(spark, "warc"), table(spark, sf_dir, "pages")
    write_warc(pages, path, "page_id", "url", "html")
    found = materialize(read_warc(spark, path), "warc-index")
    gaps = found.filter("record_type = 'gap'").agg(F.count(F.lit(1)), F.sum(F.col("stop") - F.col("start"))).first()
    records, rows = found.count() - gaps[0], pages.count()
    if gaps[0] or records != rows:
        raise Damaged(f"{gaps[0]} gaps of {gaps[1]} bytes; {records} records of {rows} pages were read back")
    return found.select(F.col("record_id").try_cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                        F.col("refers_to").try_cast("long").alias("refers_to"))
