"""WARC archives: writing with revisits and segments, reading with reassembly.

Archives are WARC/1.1 files in which each record is a gzip member of its own, so a reader can start
at any record. Spark's text writer writes them, so any store that Spark writes will do and a lost
task is written again: the last byte of a member is the high byte of its length, which is zero for
records below 16 MB, and the writer adds that zero as its line separator. An archive holds a bounded
number of records. Blocks beyond ``segment_bytes`` are cut into a first record and continuation
records; reading groups them by origin, orders them by segment number, checks the total length and
decodes the chunked transfer framing.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checked_broadcast, materialise, pick, small_batches

CRLF = b"\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_RECORD = "page_id long, record_type string, refers_to long, payload_digest string, payload binary"
_RAW = "origin string, number long, total long, page_id long, record_type string, refers_to long, payload_digest string, block binary"
_RAW_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
MOST_SEGMENT = 8 << 20


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: ten hex digits are eight base32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def chunked(payload: bytes, size: int) -> bytes:
    out = [b"%x\r\n%s\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join(out) + b"0\r\n\r\n"


def unchunked(block: bytes) -> bytes:
    """Payload of a chunked body; extensions and trailers are skipped, a cut body raises."""
    out, at = [], 0
    while True:
        end = block.index(CRLF, at)
        n = int(block[at:end].split(b";")[0], 16)
        at = end + 2
        if not n:
            return b"".join(out)
        if len(block) < at + n + 2 or block[at + n : at + n + 2] != CRLF:
            raise ValueError("a chunk is cut short")
        out.append(block[at : at + n])
        at += n + 2


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + CRLF + block + CRLF + CRLF


def _member(record: bytes) -> bytes:
    """The record as a gzip member without its last byte, which is a zero."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = pack.compress(record) + pack.flush()
    if out[-1]:
        raise ValueError("a record of 16 MB or more")
    return out[:-1]


def _name(page_id: int | None, digest: str) -> str:
    return f"urn:x-page:{'' if page_id is None else page_id}:{digest}"


def _write(segment_bytes: int, chunk_bytes: int, date: str):
    def task(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                seq += 1
                key = f"<{_name(r['page_id'], r['payload_digest'])}{'' if r['own_name'] else f'#{part}-{seq}'}>"
                uri = "".join(c for c in (r["url"] or "urn:x-page") if c > " ")
                base = [("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{r['payload_digest']}")]
                if r["record_type"] == "revisit":
                    profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
                    refers = ("WARC-Refers-To", f"<{_name(r['refers_to'], r['payload_digest'])}>")
                    out.append(_record([("WARC-Type", "revisit"), ("WARC-Record-ID", key), *base, profile, refers, ("Content-Type", "application/http;msgtype=response")], _HTTP))
                    continue
                block = _HTTP + chunked((r["html"] or "").encode("utf-8", "surrogatepass"), chunk_bytes)
                head = [("WARC-Type", "response"), ("WARC-Record-ID", key), *base, ("Content-Type", "application/http;msgtype=response")]
                if len(block) <= segment_bytes:
                    out.append(_record(head, block))
                    continue
                cuts = range(0, len(block), segment_bytes)
                for k, i in enumerate(cuts, 1):
                    own = [("WARC-Segment-Number", str(k))]
                    if k > 1:
                        own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{key[:-1]}/{k}>"), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Segment-Origin-ID", key), *own]
                        own += [("WARC-Segment-Total-Length", str(len(block)))] * (k == len(cuts))
                    out.append(_record((head + own) if k == 1 else own, block[i : i + segment_bytes]))
            yield pa.record_batch([pa.array([_member(x) for x in out], pa.binary())], names=["value"])

    return task


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", segment_bytes: int = 1 << 15, chunk_bytes: int = 1 << 12, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = 1 << 29) -> None:
    """One record per row, payload the html in UTF-8 (null: empty).

    Of the rows with equal payloads of at least ``least_bytes``, that with the largest id is a
    response and the others revisit it; smaller payloads are all responses. Null ids come before all
    numbers: they revisit a numbered row, and are responses where no number has the payload. Rows
    that repeat the largest id are all responses. A response that revisits name has id and digest as
    its record id; other record ids have a suffix that no other record has. An empty table writes an
    archive without records. No archive holds more than ``archive_bytes`` of blocks.
    """
    if not 0 < segment_bytes <= MOST_SEGMENT:
        raise ValueError(f"segments of 1 to {MOST_SEGMENT} bytes")
    small_batches(pages.sparkSession)
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    src = pick(pages, page_id=(id_col, "long"), url=(url_col, "string"), html=(html_col, "string")).select("*", sha1_base32(body).alias("payload_digest"), F.octet_length(body).cast("long").alias("payload_bytes"))
    payload = ["payload_digest", "payload_bytes"]
    ids = src.where(F.col("payload_bytes") >= least_bytes).groupBy(*payload, "page_id").agg(F.count("*").alias("n"))
    same = ids.groupBy(*payload).agg(F.max("page_id").alias("last_id"), F.max_by("n", "page_id").alias("n_last"), F.sum("n").alias("n")).where("n > 1").drop("n")
    same = checked_broadcast(materialise(same, "warc-same"))
    told = src.join(same, payload, "left")
    revisit = F.col("last_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last_id"))
    # the only row of its payload, or the only one with the largest id
    own_name = F.col("page_id").isNotNull() & (F.col("payload_bytes") >= least_bytes) & ~revisit & (F.coalesce("n_last", F.lit(1)) == 1)
    rows = told.select("page_id", "url", "html", "payload_digest", own_name.alias("own_name"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("last_id")).alias("refers_to"))
    records = rows.mapInArrow(_write(segment_bytes, chunk_bytes, date), "value binary").select(F.col("value").cast("string").alias("value"))
    records.write.option("lineSep", "\0").option("maxRecordsPerFile", max(1, archive_bytes // segment_bytes)).option("compression", "none").text(path)


def parse_records(data: bytes):
    """(fields, block) of each record of an archive, by content lengths."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].split(CRLF)
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines[1:])}
        n = int(fields["content-length"])
        if len(data) < end + 4 + n:
            raise ValueError("the last record is cut short")
        yield fields, data[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


def _members(data: bytes):
    """Each gzip member of an archive, inflated; anything else as it is."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    rest = memoryview(data)
    while len(rest):
        member, parts = zlib.decompressobj(31), []
        # feeding short slices keeps the unused rest, which is copied, short
        while not member.eof:
            if not len(rest):
                raise ValueError("the last member is cut short")
            step, rest = rest[:65536], rest[65536:]
            parts.append(member.decompress(step))
        rest = memoryview(data)[len(data) - len(rest) - len(member.unused_data) :]
        yield b"".join(parts)


def _page(urn: str | None) -> int | None:
    found = (urn or "").strip("<>").removeprefix("urn:x-page:").split(":")[0]
    return int(found) if found.lstrip("-").isdigit() else None


def _payload(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _checked(payload: bytes, digest: str) -> bytes:
    if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"payload does not have the digest {digest}")
    return payload


def _raw(batches):
    """Task: archives -> records, about a megabyte of them at a time; whole ones have no segment number."""

    def packed(rows):
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _RAW_TYPES)], names=_RAW_NAMES)

    for batch in batches:
        for data in batch.column(0):
            rows, size = [], 0
            for member in _members(data.as_py()):
                for f, block in parse_records(member):
                    number, total = f.get("warc-segment-number"), f.get("warc-segment-total-length")
                    if f["warc-type"] == "continuation":
                        rows.append((f["warc-segment-origin-id"], int(number), int(total) if total else None, None, None, None, None, block))
                    else:
                        rows.append((f["warc-record-id"], number and int(number), None, _page(f["warc-record-id"]), f["warc-type"], _page(f.get("warc-refers-to")), f.get("warc-payload-digest", "").removeprefix("sha1:"), block))
                    size += len(block) + 500
                    if size > 1 << 20:
                        yield packed(rows)
                        rows, size = [], 0
            if rows:
                yield packed(rows)


_RAW_NAMES = [part.split()[0] for part in _RAW.split(", ")]


def _unpacked(batches):
    """Task: whole records -> payloads without transfer framing; a revisit's is null."""
    for batch in batches:
        payloads = []
        for kind, digest, block in zip(*(batch.column(c).to_pylist() for c in ("record_type", "payload_digest", "block"))):
            payloads.append(None if kind == "revisit" else _checked(_payload(block), digest))
        yield pa.record_batch([*(batch.column(c) for c in ("page_id", "record_type", "refers_to", "payload_digest")), pa.array(payloads, pa.binary())], names=["page_id", "record_type", "refers_to", "payload_digest", "payload"])


def _reassembled(batches):
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            numbers = [s["number"] for s in r["segments"]]
            block = b"".join(s["block"] for s in r["segments"])
            if numbers != list(range(1, len(numbers) + 1)) or len(block) != r["total"]:
                raise ValueError(f"segments {numbers} of {r['origin']} have {len(block)} bytes, not {r['total']}")
            out.append((r["page_id"], r["record_type"], None, r["payload_digest"], _checked(_payload(block), r["payload_digest"])))
        cols = list(zip(*out)) or [()] * 5
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()])], names=["page_id", "record_type", "refers_to", "payload_digest", "payload"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives below ``path``: page_id, record_type, refers_to, payload_digest, payload.

    The payload of a revisit is null. A wrong total length, a missing segment, a cut chunk or a
    payload that doesn't have its digest raises.
    """
    small_batches(spark)
    raw = materialise(spark.read.format("binaryFile").load(path).select("content").mapInArrow(_raw, _RAW), "warc-records")
    whole = raw.where("number is null").drop("origin", "number", "total").mapInArrow(_unpacked, _RECORD)
    segments = raw.where("number is not null").groupBy("origin").agg(F.max("total").alias("total"), F.max("page_id").alias("page_id"), F.max("record_type").alias("record_type"), F.max("payload_digest").alias("payload_digest"), F.array_sort(F.collect_list(F.struct("number", "block"))).alias("segments"))
    return whole.unionByName(segments.mapInArrow(_reassembled, _RECORD))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit has the bytes of the payload that it refers to.
    """
    rows = materialise(read_warc(spark, path).select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"), "warc-read")
    responses, revisits = rows.where("record_type <> 'revisit'"), rows.where("record_type = 'revisit'")
    full = revisits.select("refers_to", "payload_digest").distinct().join(responses.select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("full_bytes")), ["refers_to", "payload_digest"]).dropDuplicates(["refers_to", "payload_digest"])
    full = checked_broadcast(materialise(full, "warc-full"))
    told = revisits.drop("payload_bytes").join(full, ["refers_to", "payload_digest"], "left").withColumnRenamed("full_bytes", "payload_bytes")
    return responses.unionByName(told).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
