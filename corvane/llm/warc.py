"""WARC archives: writing captures, reading records, and assembling captures.

A capture is a response (or a revisit, where an equal payload stands elsewhere),
its request and its metadata. They are separate records, perhaps in different
files; request and metadata name the response in WARC-Concurrent-To. Reading
gives one row per record; assembly joins them on these identifiers and emits one
nested row per capture.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from zlib import compressobj

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, spread_lookup, stored

#: Bytes of records after which a task goes on in another file.
FILE_BYTES = 1 << 27
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def digest_of(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1, without a prefix."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _target(url: str | None) -> str:
    """A url that fits a header line: spaces and control characters are percent-encoded."""
    return _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url or "")


def _record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member with one record."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers if v), f"Content-Length: {len(block)}", "", ""]
    packer = compressobj(4, wbits=31)
    return packer.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + packer.flush()


def _identifier() -> str:
    return f"<{uuid.uuid4().urn}>"


def capture_records(url: str | None, payload: bytes, page: str, original: str, date: str) -> Iterator[bytes]:
    """The request, response or revisit, and metadata records of one page; ``original`` is empty for a response."""
    target, response = _target(url), _identifier()
    host, _, path = target.partition("://")[2].partition("/")
    request = f"GET /{path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode("utf-8", "surrogatepass")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    common = [("WARC-Target-URI", target), ("WARC-Date", date)]
    yield _record("request", [("WARC-Record-ID", _identifier()), ("WARC-Concurrent-To", response), *common, ("Content-Type", "application/http; msgtype=request")], request)
    own = [("WARC-Record-ID", response), *common, ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"), ("Content-Type", "application/http; msgtype=response")]
    if original:
        own.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    yield _record("revisit" if original else "response", own, head if original else head + payload)
    fields = f"page-id: {page}\r\n" + (f"refers-to-page: {original}\r\n" if original else "")
    yield _record("metadata", [("WARC-Record-ID", _identifier()), ("WARC-Concurrent-To", response), *common, ("Content-Type", "application/warc-fields")], fields.encode())


def with_originals(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload and ``original``: the largest page_id with the same payload, null where it is the row's own.

    Payloads of fewer than ``min_bytes`` bytes have no originals. Null counts as an
    empty payload. Rows that repeat the largest page_id are all their own; so are
    rows without a page_id where no row with the payload has one. Payloads shuffle
    once, and those of popular digests are dealt evenly over the tasks.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    last = rows.where(F.length("payload") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1")
    joined = spread_lookup(rows, stored(last, "warc-digests"), "digest", "n", ["last"])
    other = F.col("last").isNotNull() & ~F.col("last").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "payload", F.when(other, F.col("last")).alias("original"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a capture for every row of ``pages`` (page_id, url, html); returns the manifest (path, n_records).

    ``folder`` must be open to all executors. Files have names of their own attempt,
    and the manifest lists those of finished tasks. Ids go to Python as strings,
    percent-encoded: numbers of any size and texts of any kind come back as they were.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = pyarrow.fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        stream, name, size, n = None, "", 0, 0
        for batch in batches:
            for page, url, payload, original in zip(batch["page_id"], batch["url"], batch["payload"], batch["original"], strict=True):
                if stream is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    stream = system.open_output_stream(f"{base}/{name}", compression=None)
                for record in capture_records(url, bytes(payload), page or "", original or "", date):
                    stream.write(record)
                    size, n = size + len(record), n + 1
                if size >= FILE_BYTES:
                    stream.close()
                    yield pd.DataFrame({"path": [f"{folder}/{name}"], "n_records": [n]})
                    stream = None
        if stream is not None:
            stream.close()
            yield pd.DataFrame({"path": [f"{folder}/{name}"], "n_records": [n]})

    as_text = lambda c: F.url_encode(F.col(c).cast("string")).alias(c)
    rows = with_originals(pages, min_bytes).select(as_text("page_id"), "url", "payload", as_text("original"))
    return stored(rows.mapInPandas(write, "path string, n_records long"), "warc-manifest")


def records_of(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of a gzipped archive."""
    with gzip.GzipFile(fileobj=stream) as data:
        while version := data.readline():
            if not version.strip():
                continue
            if not version.startswith(b"WARC/"):
                raise ValueError("not a WARC record")
            headers = {}
            while (line := data.readline()).strip():
                name, _, value = line.decode("utf-8", "replace").partition(":")
                headers[name.strip().lower()] = value.strip()
            yield headers, data.read(int(headers["content-length"]))


_RECORD = (
    "record_id string, kind string, concurrent_to string, target_uri string, date string, payload_bytes long, "
    "payload_digest string, fields map<string, string>, payload binary"
)


def read_records(spark: SparkSession, manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives in ``manifest`` (column path).

    For responses, length and digest are computed from the payload as read; for
    revisits they are those that the record states of the payload it stands for.
    """
    n = max(1, manifest.count())

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                system, inner = pyarrow.fs.FileSystem.from_uri(path)
                rows = []
                with system.open_input_file(inner) as stream:
                    for headers, block in records_of(stream):
                        rows.append(_row(headers, block, with_payload))
                        if len(rows) == 1000:
                            yield pd.DataFrame(rows)
                            rows = []
                if rows:
                    yield pd.DataFrame(rows)

    return manifest.select("path").repartition(min(n, 10_000), "path").mapInPandas(read, _RECORD)


def _row(headers: dict[str, str], block: bytes, with_payload: bool) -> dict:
    kind = headers.get("warc-type")
    row = dict.fromkeys(("payload_bytes", "payload_digest", "fields", "payload")) | {
        "record_id": headers.get("warc-record-id"), "kind": kind, "concurrent_to": headers.get("warc-concurrent-to"),
        "target_uri": headers.get("warc-target-uri"), "date": headers.get("warc-date"),
    }
    if kind in ("response", "revisit"):
        head, _, payload = block.partition(b"\r\n\r\n")
        if kind == "response":
            row |= {"payload_bytes": len(payload), "payload_digest": digest_of(payload), "payload": payload if with_payload else None}
        else:
            stated = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", head)
            row |= {"payload_bytes": int(stated[1]) if stated else None, "payload_digest": headers.get("warc-payload-digest", "").removeprefix("sha1:")}
    elif kind == "metadata":
        row["fields"] = dict(tuple(x.strip() for x in line.split(":", 1)) for line in block.decode("utf-8", "replace").splitlines() if ":" in line)
    return row


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: response (or revisit), its requests, and its metadata fields (key, value).

    Records whose WARC-Concurrent-To names no response stay out; a response
    without request or metadata has null there.
    """
    answer = F.struct("kind", "target_uri", "date", "payload_bytes", "payload_digest", "payload").alias("response")
    answers = records.where(F.col("kind").isin("response", "revisit")).select("record_id", answer)
    requests = records.where("kind = 'request'").groupBy(F.col("concurrent_to").alias("record_id")).agg(F.collect_list(F.struct(F.col("record_id").alias("id"), "target_uri", "date")).alias("requests"))
    metadata = records.where("kind = 'metadata' and fields is not null").groupBy(F.col("concurrent_to").alias("record_id"))
    metadata = metadata.agg(F.flatten(F.collect_list(F.map_entries("fields"))).alias("metadata"))
    return answers.join(requests, "record_id", "left").join(metadata, "record_id", "left")


def op10_warc(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Columns page_id, payload_bytes, payload_digest, record_type, refers_to, n_requests for every row, as read back.

    Null html is an empty payload; a null url has no target. Of rows that repeat the
    largest page_id of a payload (ties) each is a response. Rows without page_id come
    back without it. An empty table gives no rows. Payloads of any length are written
    whole; a record has to fit a task's memory. Columns of other names are ignored.
    """
    folder = fresh_path(pages.sparkSession, "warc")
    records = stored(read_records(pages.sparkSession, write_archives(pages, folder, min_bytes)), "warc-records")
    kind = dict(pages.dtypes)["page_id"]
    stated = lambda name: F.expr(f"nullif(get(filter(metadata, x -> x.key = '{name}'), 0).value, '')")
    value = lambda name: F.url_decode(stated(name)).cast(kind)
    return assemble(records).select(
        value("page-id").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.kind").alias("record_type"), value("refers-to-page").alias("refers_to"), F.size("requests").alias("n_requests"),
    )


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Base32 of the SHA-1: 5 hex digits are 20 bits, or 4 letters.
OP10_SQL = f"""
with payloads as (
  select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as hex from pages
), digests as (
  select *, max(page_id) over (partition by hex) as last,
    array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda s:
      substr('{_LETTERS}', ((cast('0x' || substr(hex, cast(g * 5 + 1 as int), 5) as bigint) >> s) & 31) + 1, 1)), '')), '') as base32
  from payloads
)
select page_id, cast(octet_length(encode(payload)) as bigint) as payload_bytes, base32 as payload_digest,
  case when page_id = last then 'response' else 'revisit' end as record_type,
  case when page_id = last then null else last end as refers_to, 1 as n_requests
from digests"""
