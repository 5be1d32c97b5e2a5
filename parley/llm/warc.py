"""WARC archives with an index.

Writing gives one gzip member a record and an index row of its file, offset, length, URL and digest. Reading starts from
index rows: they are dealt out by file and place, sorted by offset, and ranges that lie near are fetched in one read, of
which each record is cut. Payloads that repeat an earlier one are revisit records without payload.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, store, written

#: Payloads shorter than this are always stored.
LEAST = 1000
#: Bytes after which an archive is closed, that a task reads, that one read spans, and that lie between ranges of one read.
ROLL, DEAL, SPAN, GAP = 256 << 20, 64 << 20, 4 << 20, 64 << 10
LEVEL, DATE = 6, "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id bigint, url string, file string, offset bigint, length bigint, digest string, payload_bytes bigint, record_type string, refers_to bigint"
NAMES = [x.split()[0] for x in INDEX.split(", ")]


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE, level: int = LEVEL) -> bytes:
    """A record as one gzip member. A revisit has the HTTP header only, and its payload's length and digest in the WARC header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(http) + (0 if revisit else len(payload))}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub("[\r\n]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    head = squeeze.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + http)
    return head + (b"" if revisit else squeeze.compress(payload)) + squeeze.compress(b"\r\n\r\n") + squeeze.flush()


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """A record's WARC header (names in lower case) and payload."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record stands at this place")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])].partition(b"\r\n\r\n")[2]


def decisions(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, digest and refers_to of the pages whose payload another page stores: of equal payloads of at least ``least`` bytes, the largest page_id's."""
    long = pages.select("page_id", F.sha1(F.col("payload")).alias("digest"), F.octet_length("payload").alias("n")).where(F.col("n") >= least).select("page_id", "digest")
    kept = long.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return long.join(kept, "digest").where("page_id < refers_to").distinct()


def write(pages: DataFrame, folder: str, least: int = LEAST, roll: int = ROLL) -> DataFrame:
    """Write a record for each row of page_id, url, html to archives under ``folder``; returns the index, itself written beside them.

    A null html is an empty payload, a null url has no target line. A null page_id is stored as a response of its own.
    Rows that repeat both page_id and payload are treated alike: with the largest page_id each is a response. A failed
    attempt leaves an archive that no index row names.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("bigint"), "url", payload.alias("payload"))
    revisit = decisions(rows, least)
    told = rows.withColumn("digest", F.sha1(F.col("payload"))).join(revisit.hint("shuffle_hash"), ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, top = store(folder)
        out, name, at = None, "", 0
        for batch in batches:
            rows_: list[tuple] = []
            for p, u, body, d, r in zip(*(batch.column(i) for i in range(5)), strict=True):
                if out is None or at >= roll:
                    if out is not None:
                        out.close()
                    where.create_dir(top, recursive=True)
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = where.open_output_stream(f"{top}/{name}", compression=None)
                page, url, data, digest, refers = p.as_py(), u.as_py(), body.as_py(), d.as_py(), r.as_py()
                member = record(page, url, data, digest, refers)
                out.write(member)
                rows_.append((page, url, name, at, len(member), digest, len(data), "response" if refers is None else "revisit", refers))
                at += len(member)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows_, strict=True), _KINDS, strict=True)] if rows_ else [pa.array([], k) for k in _KINDS], names=NAMES)
        if out is not None:
            out.close()

    return written(told.mapInArrow(run, INDEX), "warc-index")


_KINDS = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]


def ranges(rows: list[tuple[int, int]], span: int = SPAN, gap: int = GAP) -> list[tuple[int, int, int, int]]:
    """Sorted (offset, length) joined to reads: (first row, row after the last, offset, length). No read spans more than ``span``, but for a longer record."""
    out: list[list[int]] = []
    for i, (offset, length) in enumerate(rows):
        if out and offset - out[-1][3] <= gap and offset + length - out[-1][2] <= span:
            out[-1][1], out[-1][3] = i + 1, max(out[-1][3], offset + length)
        else:
            out.append([i, i + 1, offset, offset + length])
    return [(a, b, s, e - s) for a, b, s, e in out]


def read(index: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """The records of index rows: page_id, url, payload_bytes, payload_digest, record_type, refers_to and (if ``payload``) payload.

    A response's bytes and digest are taken from its payload and must agree with its header; a revisit's stand in its
    header. Payloads of revisits are null. Duplicate index rows are read once each.
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payload]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: len(names)]
    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * payload

    def one(member: bytes) -> tuple:
        fields, body = parsed(member)
        number = lambda k: int(fields[k]) if k in fields else None
        digest, size, kind = fields["warc-payload-digest"].removeprefix("sha1:"), number("x-payload-length"), fields["warc-type"]
        if kind == "response" and (hashlib.sha1(body).hexdigest() != digest or len(body) != size):
            raise ValueError(f"the payload of {fields['warc-record-id']} doesn't have its digest")
        row = (number("x-page-id"), fields.get("warc-target-uri"), size, digest, kind, number("x-refers-to-page-id"))
        return (*row, body if kind == "response" else None) if payload else row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, top = store(folder)
        source, name = None, None
        for batch in batches:
            files, offsets, lengths = (batch.column(i).to_pylist() for i in range(3))
            cuts = [0, *(i for i in range(1, len(files)) if files[i] != files[i - 1]), len(files)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if files[a] != name:
                    if source is not None:
                        source.close()
                    source, name = where.open_input_file(f"{top}/{files[a]}"), files[a]
                for s, e, offset, length in ranges(list(zip(offsets[a:b], lengths[a:b], strict=True))):
                    data = source.read_at(length, offset)
                    out = [one(data[offsets[a + i] - offset : offsets[a + i] - offset + lengths[a + i]]) for i in range(s, e)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        if source is not None:
            source.close()

    # Index rows are tiny beside what they stand for, so the number of tasks is told by the bytes to be read; each has a stretch of neighbouring records.
    size = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-size // DEAL), min(index.sparkSession.sparkContext.defaultParallelism, size >> 20))
    dealt = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, schema)


def archive_folder(spark) -> str:
    """A new folder for archives in the shared folder."""
    return f"{shared_dir(spark)}/parley-warc-{uuid.uuid4().hex}"
