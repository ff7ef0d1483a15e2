"""Writing web archives (WARC 1.1) and reading records back by index (operator 6).

Index first: a writing task appends gzip members to an archive of its own below
the shared folder and returns, for every record, file, offset, length, URL and
payload digest.  The index is a Parquet table, committed by Spark when all
tasks have ended; archives that a lost or repeated task left behind are in no
index row and are never read.  Reading starts from index rows: they are
range-partitioned by file and offset, sorted, and ranges that lie close together
are read at once, then cut into records.

Of records with equal payloads (of at least ``least_bytes``) the one with the
largest page_id is a ``response``; the others are ``revisit`` records without
payload that refer to it.  Which payloads occur twice comes from a map-side
aggregated digest count; only pages with such a payload are shuffled.

Defined results
* a null html is an empty payload; a null URL leaves out the target field;
* a null page_id is smaller than any other; rows that repeat page_id and payload
  of a response are responses too;
* control characters in a URL are percent-encoded in the record, not in the index;
* an empty table writes no records; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from escrowlens.llm.common import looked_up, staged
from escrowlens.session import scratch_path

TABLE_BITS = 22  # at most 65,536 broadcast rows
ARCHIVE_BYTES = 256_000_000  # a task starts another archive beyond this
READ_GAP, READ_BYTES = 64_000, 8_000_000  # ranges nearer than the gap are read at once
DATE = "2000-01-01T00:00:00Z"
# Fixed value: the profile of a revisit record with the same payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = ("page_id long, url string, file string, offset long, length long, payload_bytes long, "
         "payload_digest string, record_type string, refers_to long")


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder, whatever store its address names."""
    if folder.startswith("file:") or folder.startswith("/"):
        return pafs.LocalFileSystem(), "/" + re.sub(r"^file:/*", "", folder).lstrip("/")
    return pafs.FileSystem.from_uri(folder)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, url) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>"


def record_bytes(page_id, url, payload: bytes, refers_to, refers_url, date: str) -> bytes:
    """One uncompressed record; ``refers_to`` makes it a revisit."""
    revisit = refers_to is not None
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if revisit else http + payload
    safe = lambda u: urllib.parse.quote(u, safe="!#$%&'()*+,/:;=?@[]~")
    fields = {"WARC-Type": "revisit" if revisit else "response", "WARC-Date": date,
              "WARC-Record-ID": record_id(page_id, url),
              "Content-Type": "application/http; msgtype=response",
              "WARC-Payload-Digest": f"sha1:{sha1_base32(payload)}"}
    if url is not None:
        fields["WARC-Target-URI"] = safe(url)
    if page_id is not None:
        fields["X-Page-ID"] = str(page_id)
    if revisit:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to, refers_url),
                   "X-Refers-To-Page-ID": str(refers_to)}
        if refers_url is not None:
            fields["WARC-Refers-To-Target-URI"] = safe(refers_url)
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Record fields, HTTP fields (both by lower-case name) and payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not at the start of a record")
    names = lambda rows: {k.lower(): v.strip() for k, _, v in (r.partition(":") for r in rows)}
    fields = names(lines[1:])
    size = int(fields["content-length"])
    if len(rest) != size + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("record length and Content-Length differ")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    return fields, names(http.decode().split("\r\n")[1:]), payload


def _written(pages: DataFrame, folder: str, date: str, archive_bytes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        out, at, name = None, 0, ""
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, refers_to, refers_url in zip(
                        *(batch.column(k) for k in range(5)), strict=True):
                    page_id, url, refers_to, refers_url = (
                        x.as_py() for x in (page_id, url, refers_to, refers_url))
                    payload = (html.as_py() or "").encode()
                    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = gz.compress(record_bytes(page_id, url, payload, refers_to, refers_url, date))
                    data += gz.flush()
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        store.create_dir(path, recursive=True)
                        name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{path}/{name}", compression=None)
                    out.write(data)
                    rows.append((page_id, url, name, at, len(data), len(payload), sha1_base32(payload),
                                 "response" if refers_to is None else "revisit", refers_to))
                    at += len(data)
                if rows:
                    cols = [list(c) for c in zip(*rows, strict=True)]
                    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(),
                             pa.string(), pa.string(), pa.int64()]
                    names = [f.split()[0] for f in INDEX.split(", ")]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
        finally:
            if out is not None:
                out.close()

    return pages.select("page_id", "url", "html", "refers_to", "refers_url").mapInArrow(run, INDEX)


def write_archives(pages: DataFrame, least_bytes: int = 0, date: str = DATE,
                   archive_bytes: int = ARCHIVE_BYTES) -> tuple[DataFrame, str]:
    """Write every page as a record; returns the index and the archives' folder."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url",
                        F.coalesce("html", F.lit("")).alias("html"))
    base = base.withColumn("_sum", F.sha2("html", 256))
    large = base.filter(F.octet_length("html") >= least_bytes)
    groups = staged(large.groupBy("_sum")
                    .agg(F.max("page_id").alias("_last"), F.max_by("url", "page_id").alias("_last_url"),
                         F.count(F.lit(1)).alias("_n"))
                    .filter("_n > 1").drop("_n"), "warc-groups")
    met = looked_up(base, groups, ["_sum"], TABLE_BITS)
    other = F.col("_last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last"))
    rows = met.withColumns({"refers_to": F.when(other, F.col("_last")),
                            "refers_url": F.when(other, F.col("_last_url"))})
    folder = scratch_path(pages.sparkSession, "llm-warc")
    return staged(_written(rows, folder, date, archive_bytes), "warc-index"), folder


def coalesced(ranges: list[tuple[int, int]], gap: int = READ_GAP,
              most: int = READ_BYTES) -> list[tuple[int, int, int]]:
    """Runs (first, end, length to read) of sorted (offset, length) ranges."""
    out, k = [], 0
    while k < len(ranges):
        start, end, j = ranges[k][0], ranges[k][0] + ranges[k][1], k + 1
        while (j < len(ranges) and ranges[j][0] - end <= gap
               and ranges[j][0] + ranges[j][1] - start <= most):
            end, j = max(end, ranges[j][0] + ranges[j][1]), j + 1
        out.append((k, j, end - start))
        k = j
    return out


def read_records(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of the given index rows, as read from the archives: page_id,
    record_type, refers_to, target_uri, payload_bytes, payload_digest (both of
    the full payload) and, if wanted, payload (null for a revisit).

    A record that doesn't begin at its offset, doesn't end at its length, or
    whose payload hasn't the digest of its header fails the job.
    """
    schema = ("page_id long, record_type string, refers_to long, target_uri string, "
              "payload_bytes long, payload_digest string" + ", payload binary" * with_payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        name, source = None, None
        for batch in batches:
            files, at, size = (batch.column(k).to_pylist() for k in range(3))
            k = 0
            while k < len(files):
                j = k
                while j < len(files) and files[j] == files[k]:
                    j += 1
                if files[k] != name:
                    name, source = files[k], store.open_input_file(f"{path}/{files[k]}")
                ranges = list(zip(at[k:j], size[k:j], strict=True))
                for first, end, length in coalesced(ranges):
                    data = source.read_at(length, ranges[first][0])
                    rows = []
                    for offset, n in ranges[first:end]:
                        skip = offset - ranges[first][0]
                        fields, http, payload = parse_record(zlib.decompress(data[skip:skip + n], 31))
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        revisit = fields["warc-type"] == "revisit"
                        if not revisit and sha1_base32(payload) != digest:
                            raise ValueError(f"payload of {name} at {offset} has another digest")
                        as_int = lambda v: None if v is None else int(v)
                        rows.append((as_int(fields.get("x-page-id")), fields["warc-type"],
                                     as_int(fields.get("x-refers-to-page-id")),
                                     fields.get("warc-target-uri"), int(http["content-length"]), digest)
                                    + ((None if revisit else payload,) if with_payload else ()))
                    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(),
                             pa.binary()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds)],
                        names=[f.split()[0] for f in schema.split(", ")])
                k = j

    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (index.select("file", "offset", "length").repartitionByRange(n, "file", "offset")
            .sortWithinPartitions("file", "offset").mapInArrow(run, schema))
