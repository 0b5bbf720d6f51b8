import gzip
import hashlib
import io
import random
import time

from llm_cases import rows_of  # noqa: F401
from haulage.llm import warc
from haulage.llm.common import read_table
from haulage.session import scratch_path
from pyspark.sql import functions as F

COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
BIG = "<p>äö" + "x" * 2000


def pages(spark, rows):
    return spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, refers_to string").repartition(3)


def brute(rows):
    largest = {}
    for i, _, html in rows:
        b = (html or "").encode()
        if len(b) >= 1000 and i is not None:
            largest[b] = max(i, largest.get(b, i))
    out = []
    for i, _, html in rows:
        b = (html or "").encode()
        top = largest.get(b)
        again = top is not None and top != i
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=repr)


ROWS = [(1, "http://a/ü?x=1\r\ny", BIG), (2, None, BIG), (3, "http://c", BIG), (3, "http://c", BIG), (4, "u", "small"), (5, "u", "small"),
        (6, "u", None), (None, "u", BIG), (None, None, None), (7, "u", "\x1f\x0b\x08" * 500 + "\r\n\r\nWARC/1.1"), (8, "u", "z" * 1000), (9, "u", "z" * 999)]


def test_round_trip(spark):
    folder = scratch_path(spark, "warc-test")
    files = warc.write_warc(pages(spark, ROWS), folder)
    assert rows_of(warc.read_warc(files, folder), *COLUMNS) == brute(ROWS)
    texts = {r["page_id"]: r["payload"] for r in warc.read_warc(files, folder, payloads=True).collect() if r["record_type"] == "response"}
    assert texts[7] == ROWS[9][2].encode() and texts[3] == BIG.encode()


def test_long_headers_and_many_records(spark):
    rows = [(0, "u", "a"), (1, "http://x/" + "y" * 70_000, BIG), (2, "u", "b"), (3, "http://x/" + "ü" * 12_000, "c"), (4, "z" * 300_000, BIG)]
    folder = scratch_path(spark, "warc-test")
    files = warc.write_warc(pages(spark, rows), folder)
    for size in (5_000, 16 << 20):
        assert rows_of(warc.read_warc(files, folder, range_bytes=size), *COLUMNS) == brute(rows)
    rng = random.Random(2)
    bodies = [rng.randbytes(600).hex().encode() for _ in range(8000)]
    data = b"".join(gzip.compress(warc.record(i, "u", b, hashlib.sha1(b).hexdigest(), None), 4) for i, b in enumerate(bodies))
    start = time.process_time()
    found = [warc.parse(r)["page_id"] for r in warc.records_in(io.BytesIO(data), len(data), 0, len(data))]
    assert found == list(range(8000)) and time.process_time() - start < 3  # 20 times as long when bytes are copied for each record


def test_any_split_reads_every_record_once(spark):
    folder = scratch_path(spark, "warc-test")
    files = warc.write_warc(pages(spark, ROWS).coalesce(1), folder)
    for size in (1, 7, 64, 1000):
        assert rows_of(warc.read_warc(files, folder, range_bytes=size), *COLUMNS) == brute(ROWS)


def test_chance_magic_inside_a_member_is_no_record():
    rng = random.Random(1)
    noise = b"".join(rng.randbytes(rng.randrange(50, 4000)) + b"\x1f\x8b\x08" for _ in range(60))
    members = [gzip.compress(warc.record(i, "u", noise[i * 97:], hashlib.sha1(noise[i * 97:]).hexdigest(), None), 0) for i in range(5)]
    other = gzip.compress(b"no record at all")
    data = other + members[0] + other + b"".join(members[1:])
    for size in (501, 10_000, len(data)):
        found = []
        for start in range(0, len(data), size):
            found += [warc.parse(r) for r in warc.records_in(io.BytesIO(data), len(data), start, min(start + size, len(data)))]
        # stored (uncompressed) payloads hold gzip magic by chance, never a record
        assert [r["page_id"] for r in found] == list(range(5))


def test_empty_table_and_listing(spark):
    folder = scratch_path(spark, "warc-test")
    files = warc.write_warc(pages(spark, [])  , folder)
    assert warc.read_warc(files, folder).count() == 0
    folder = scratch_path(spark, "warc-test")
    files = warc.write_warc(read_table(spark, "/root/testdata/sf0.001", "pages").withColumn("n", F.lit("x")), folder)
    listed = warc.list_archives(spark, folder)
    assert rows_of(warc.read_warc(listed, folder), *COLUMNS) == rows_of(warc.read_warc(files, folder), *COLUMNS)


def test_files_of_a_failed_attempt_are_not_read(spark):
    folder = scratch_path(spark, "warc-test")
    files = warc.write_warc(pages(spark, ROWS), folder)
    system, path = warc._open_folder(folder)
    with system.open_output_stream(f"{path}/part-left-over.warc.gz", compression=None) as out:
        out.write(gzip.compress(warc.record(99, "u", b"x", hashlib.sha1(b"x").hexdigest(), None)))
    assert rows_of(warc.read_warc(files, folder), *COLUMNS) == brute(ROWS)
