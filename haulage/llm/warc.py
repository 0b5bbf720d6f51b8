"""WARC archives: a writer, and a splittable reader.

Writer: each record is a gzip member of its own, so a reader may start at any
member. Payloads are digested first; of records with equal payloads (SHA-1
and size) of at least ``MIN_REVISIT`` bytes the one with the largest page_id
is a response and the others revisit it, without their payload.

Reader: files are dealt out as byte ranges, not as whole files. A task scans
its range for the gzip magic, validates each candidate by decoding its first
bytes to a WARC record header, and owns the records that start inside its
range, reading past the range's end to finish the last one. A magic number
that chance put inside compressed data fails the validation, and a member
that was read is skipped whole.

Files are written and read through Arrow's file systems (file, hdfs, s3, gs)
under the folder that the cluster shares. Each task attempt writes a file of
its own name, and only files reported by attempts that succeeded are read.

Payloads meet by digest and size with page numbers only; the html is joined
to what was decided, not shuffled to find its copies. Readers follow the bytes
of the archives, ``TASK_BYTES`` a task.

Defined results: very long payloads and headers (a long url) are written and
read whole, a record at a time; a null html is an empty payload and a null url leaves out
the target; a null page_id is written as a record without page number and
read back as null, and never the response that others revisit while a record
with a number has that payload; repeated rows are records of their own, and
rows that repeat the largest page_id are all responses; other columns are
ignored; an empty table gives empty archives and no rows.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulage.llm.common import shared_write, slices, utf8_list

MIN_REVISIT = 1000
#: Bytes of archive that a reading task scans for records to own.
RANGE_BYTES = 16 << 20
#: Bytes of archive that a reading task gets, in ranges.
TASK_BYTES = 128 << 20
_MAGIC = b"\x1f\x8b\x08"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- writing -------------------------------------------------------------

def with_digests(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_digest, payload_bytes of the full payload."""
    html = F.coalesce(F.col("html"), F.lit(""))
    return pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("payload_digest"),
                        F.octet_length(html).cast("bigint").alias("payload_bytes"))


def with_types(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """``with_digests`` and refers_to: the response's page_id for revisits."""
    rows = with_digests(pages)
    shared = (rows.where(F.col("payload_bytes") >= min_revisit).groupBy("payload_digest", "payload_bytes")
              .agg(F.max("page_id").alias("largest"), F.count("*").alias("n"))
              .where("n > 1 and largest is not null").drop("n"))
    return rows.join(shared, ["payload_digest", "payload_bytes"], "left").withColumn(
        "refers_to", F.when(~F.col("largest").eqNullSafe(F.col("page_id")), F.col("largest"))).drop("largest")


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
           date: str = "2024-01-01T00:00:00Z") -> bytes:
    """A whole WARC/1.1 record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}",
            f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {_REVISIT}"]
    head.append(f"Content-Length: {len(block)}")
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _open_folder(folder: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (
        fs.LocalFileSystem(), folder)
    return system, path


def write_warc(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write ``pages`` as .warc.gz files in the shared ``folder``; the written
    table (path, bytes, records) of the files of successful attempts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open_folder(folder)
        system.create_dir(path, recursive=True)
        name, size, records = f"{path}/part-{uuid.uuid4().hex}.warc.gz", 0, 0
        with system.open_output_stream(name, compression=None) as out:
            for batch in slices(batches, "html"):
                columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "payload_digest", "refers_to"))
                for (page_id, url, digest, refers_to), html in zip(
                        zip(*columns, strict=True), utf8_list(batch.column("html")), strict=True):
                    member = gzip.compress(record(page_id, url, html, digest, refers_to), 4, mtime=0)
                    out.write(member)
                    size += len(member)
                    records += 1
        yield pa.RecordBatch.from_pylist([{"path": name, "bytes": size, "records": records}])

    rows = with_types(pages, min_revisit).select("page_id", "url", "html", "payload_digest", "refers_to")
    return shared_write(rows.mapInArrow(run, "path string, bytes bigint, records bigint"), "warc-files")


# --- reading -------------------------------------------------------------

class _Bytes:
    """Bytes of a file, read forward in steps. What lies before the offset
    asked for goes when a step is read, so each byte is copied a few times."""

    def __init__(self, file, start: int, size: int, step: int = 4 << 20):
        self.file, self.size, self.step = file, size, step
        self.start, self.data = start, b""

    def fill(self, at: int, upto: int) -> None:
        """Have the bytes from ``at`` to ``upto`` (or the file's end)."""
        if at < self.start:  # back into bytes that went
            self.start, self.data = at, b""
        end = self.start + len(self.data)
        if upto > end and end < self.size:
            self.file.seek(end)
            more = self.file.read(min(self.size, max(upto, end + self.step)) - end)
            kept = min(at - self.start, len(self.data))
            self.data = self.data[kept:] + more
            self.start += kept

    def get(self, at: int, n: int) -> bytes:
        self.fill(at, at + n)
        return self.data[at - self.start:at - self.start + n]

    def find(self, what: bytes, at: int, limit: int) -> int:
        """Offset of ``what`` that starts in [at, limit), or -1."""
        last = limit + len(what) - 1
        while at < limit:
            self.fill(at, min(last, at + len(what)))
            found = self.data.find(what, at - self.start, last - self.start)
            if found >= 0:
                return self.start + found
            end = self.start + len(self.data)
            if end >= min(last, self.size):
                return -1
            at = max(at + 1, end - len(what) + 1)
        return -1


def _member(source: _Bytes, at: int) -> tuple[bytes, int] | None:
    """The record of the gzip member at an offset and the member's end, or
    None if no whole WARC record in gzip starts there. A header may have any
    length."""
    unpack = zlib.decompressobj(31)
    out, pos, checked, step = [], at, False, 2 << 10
    try:
        while not unpack.eof:
            data = source.get(pos, step)
            if not data:
                return None
            out.append(unpack.decompress(data))
            pos += len(data) - len(unpack.unused_data)
            step = min(2 * step, 256 << 10)
            if not checked and sum(map(len, out)) >= 5:
                head = b"".join(out)
                if not head.startswith(b"WARC/"):
                    return None
                out, checked = [head], True
    except zlib.error:
        return None
    whole = b"".join(out)
    return (whole, pos) if whole.startswith(b"WARC/") and b"\r\n\r\n" in whole else None


def records_in(file, size: int, start: int, end: int) -> Iterator[bytes]:
    """The records whose gzip members start in [start, end) of an open file."""
    source, at = _Bytes(file, start, size), start
    while (at := source.find(_MAGIC, at, end)) >= 0:
        found = _member(source, at)
        if found:
            yield found[0]
            at = found[1]
        else:
            at += 1


def parse(raw: bytes) -> dict:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url
    and payload (None for a revisit) of a record."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    full = int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
    number = lambda urn: int(m[1]) if urn and (m := re.fullmatch(r"<urn:page:(-?\d+)>", urn)) else None
    kind, stated = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != full or hashlib.sha1(payload).hexdigest() != stated):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {"page_id": number(fields["WARC-Record-ID"]), "payload_bytes": full, "payload_digest": stated,
            "record_type": kind, "refers_to": number(fields.get("WARC-Refers-To")),
            "url": fields.get("WARC-Target-URI"), "payload": payload if kind == "response" else None}


def ranges(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Byte ranges (path, bytes, start, end) that cover the files."""
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(range_bytes).cast("bigint")))
    return files.where("bytes > 0").select("path", "bytes", starts.alias("start")).withColumn(
        "end", F.least(F.col("start") + range_bytes, F.col("bytes")))


def read_warc(files: DataFrame, folder: str, range_bytes: int = RANGE_BYTES, payloads: bool = False) -> DataFrame:
    """The records of the files: page_id, payload_bytes, payload_digest,
    record_type, refers_to, url (and payload, if asked for)."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"] + ["payload"] * payloads
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    schema = pa.schema(list(zip(names, types, strict=False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _open_folder(folder)
        for batch in batches:
            for r in batch.to_pylist():
                with system.open_input_file(r["path"]) as file:
                    rows, held = [], 0
                    for raw in records_in(file, r["bytes"], r["start"], r["end"]):
                        row = parse(raw)
                        rows.append({n: row[n] for n in names})
                        held += len(raw) if payloads else 200
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    dealt = ranges(files, range_bytes)
    total, n = files.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0], dealt.count()
    least = min(n, files.sparkSession.sparkContext.defaultParallelism)
    dealt = dealt.repartition(max(1, least, -(-total // TASK_BYTES)))
    return dealt.mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, "
                                 "refers_to bigint, url string" + ", payload binary" * payloads)


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes) of the archives in a folder, listed by Spark; no content
    is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.warc.gz").load(folder)
    return found.select(_plain(F.col("path")).alias("path"), F.col("length").alias("bytes"))


def _plain(path: Column) -> Column:
    """A path as Arrow's file system of its folder takes it."""
    return F.regexp_replace(F.regexp_replace(path, "^file:/*", "/"), "^(hdfs://[^/]*|viewfs://[^/]*)", "")
