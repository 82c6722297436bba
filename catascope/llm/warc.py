"""WARC archives: written with an index, read back by coalesced byte ranges."""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catascope.llm.common import bounded_batches, ship, stored
from catascope.session import scratch

#: Smaller payloads are always written in full.
LEAST_BYTES = 1000
#: A range read spans up to this many bytes of an archive, and skips gaps up to GAP bytes.
RUN_BYTES = 8 << 20
GAP = 64 << 10
#: The capture time of pages, whose table has none.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id long, url string, digest string, record_type string, file string, offset long, length long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder in the shared store and the path there."""
    uri = re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", uri))  # names that only Hadoop knows
    return fs.FileSystem.from_uri(uri)


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(record: str) -> int | None:
    number = record.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member. A revisit holds the HTTP header of the full response only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parsed(data: bytes) -> dict:
    """The fields and the payload of a record; a response whose digest is wrong is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    response = fields["WARC-Type"] == "response"
    if response and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not match its digest")
    return {
        "page_id": page_of(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"],
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": None if response else page_of(fields["WARC-Refers-To"]),
        "payload": payload if response else None,
    }


def writer(folder: str):
    """Rows to archives, one per task, and a row of the index per record.

    An attempt writes to a file of its own; the index names the files of the attempts that counted,
    so a repeated task leaves at most a file that nothing points to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = opened(folder)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
        try:
            for batch in batches:
                index = []
                for r in batch.to_pylist():
                    if out is None:
                        store.create_dir(path, recursive=True)
                        out = store.open_output_stream(f"{path}/{name}", compression=None)
                    data = record(r["page_id"], r["url"], (r["html"] or "").encode(), r["digest"], r["refers_to"], r["revisit"])
                    out.write(data)
                    kind = "revisit" if r["revisit"] else "response"
                    index.append({"page_id": r["page_id"], "url": r["url"], "digest": r["digest"], "record_type": kind, "file": f"{folder}/{name}", "offset": at, "length": len(data)})
                    at += len(data)
                if index:
                    yield pa.RecordBatch.from_pylist(index, schema)
        finally:
            if out is not None:
                out.close()

    return run


def planned(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, html, digest, revisit, refers_to: which records repeat which payload.

    Payloads that occur once do not take part in the join; Spark broadcasts the others if their
    files are small, and can split a hot payload if not.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", "html", F.sha1(html).alias("digest"), F.octet_length(html).alias("n"), F.xxhash64(html).alias("probe"))
    same = ["digest", "n", "probe"]
    groups = rows.where(F.col("n") >= least).groupBy(*same).agg(F.max("page_id").alias("last"), F.count("*").alias("copies"))
    groups = stored(groups.where("copies > 1").drop("copies"), "payloads")
    rows = rows.join(groups, same, "left")
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return rows.select("page_id", "url", "html", "digest", revisit.alias("revisit"), F.when(revisit, F.col("last")).alias("refers_to"))


def written(pages: DataFrame, folder: str, least: int = LEAST_BYTES) -> DataFrame:
    """Write archives into `folder`; the index: page_id, url, digest, record_type, file, offset, length."""
    bounded_batches(pages.sparkSession)
    return stored(planned(pages, least).mapInArrow(writer(folder), INDEX), "warc-index")


def runs(offsets: list[int], lengths: list[int], gap: int = GAP) -> list[tuple[int, int]]:
    """(offset, length) of the reads that cover sorted records and skip only gaps over `gap`."""
    out: list[tuple[int, int]] = []
    for a, n in zip(offsets, lengths):
        if out and a - (out[-1][0] + out[-1][1]) <= gap:
            start = out[-1][0]
            out[-1] = (start, max(out[-1][1], a + n - start))
        else:
            out.append((a, n))
    return out


def reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, records) to the records, one range read for each run of neighbours."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    for batch in batches:
        for row in batch.to_pylist():
            store, path = opened(row["file"])
            wanted = sorted((r["offset"], r["length"]) for r in row["records"])
            found = []
            with store.open_input_file(path) as source:
                ranges = iter(runs(*map(list, zip(*wanted))))
                start, size = next(ranges)
                data = source.read_at(size, start)
                for a, n in wanted:
                    if a >= start + size:
                        start, size = next(ranges)
                        data = source.read_at(size, start)
                    found.append(parsed(zlib.decompress(data[a - start : a - start + n], 31)))
            yield pa.RecordBatch.from_pylist(found, schema)


def read(index: DataFrame, run_bytes: int = RUN_BYTES) -> DataFrame:
    """The records that the given rows of an index point to, payloads of responses included.

    Records of a file are brought together by stretches of `run_bytes`, and a task holds one stretch
    at a time. Tasks are counted by the bytes they read: index rows say too little about those.
    """
    total = index.agg(F.sum("length").alias("n")).first()["n"] or 0
    stretch = F.floor(F.col("offset") / run_bytes).alias("stretch")
    rows = index.groupBy("file", stretch).agg(F.collect_list(F.struct("offset", "length")).alias("records"))
    rows = rows.repartition(max(1, -(-total // run_bytes)), "file", "stretch")
    return rows.select("file", "records").mapInArrow(reader, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to as read back from new archives.

    Null html is the empty payload, null url an empty address. Of equal payloads of LEAST_BYTES or
    more the largest page_id is the response; rows that repeat this id are responses too, rows
    without id revisit it, and without any id all are responses. An empty table writes no archive
    and gives no rows; other columns are not read.
    """
    index = written(pages, scratch(pages.sparkSession, "warc"))
    return read(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
with t as (
  select page_id, coalesce(html, '') as body, octet_length(encode(coalesce(html, ''))) as n from pages
), g as (
  select page_id, n, sha1(body) as payload_digest, max(page_id) over w as last, count(*) over w as copies
  from t window w as (partition by body)
)
select page_id, n::bigint as payload_bytes, payload_digest,
  case when n >= 1000 and copies > 1 and last is not null and page_id is distinct from last then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and copies > 1 and last is not null and page_id is distinct from last then last end as refers_to
from g
"""

ship(__name__)
