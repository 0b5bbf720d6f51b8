r"""Document fingerprints by locally consistent parsing.

A text's code points are the names of level 0. At each level equal neighbours
are first joined into runs; then deterministic coin tossing gives every name a
small label: the lowest bit in which it differs from its left neighbour, and
that bit's value. Four rounds bring 64-bit names to six labels, in which
neighbours still differ. A name whose label is larger than both neighbours'
starts a phrase, so phrases have 1 to 12 names, and a phrase's name is a hash of
the names in it. Phrases are the next level's names. Where a phrase starts
depends on five names before and one after alone, so a passage has the same
phrases inside wherever it stands; only those near its two ends can differ
(``margin`` says how near).

A fingerprint samples the phrase names of each level: a name's leading bits
choose one of the level's bins, and a bin keeps 12 bits of its smallest name
(three hexadecimal digits, 000 if empty). ``likeness`` compares the bins of the
highest level that is filled enough on both sides, and gives the estimated
share of phrase names in common, 2 |A and B| / (|A| + |B|).

``edited`` builds the texts to compare with: documents are ordered by doc_id,
descending, and each has its last third replaced by the next one's beginning.
Neighbours meet in ranges of that order. The bounds of the ranges are one row for
each shuffle partition, as in Spark's own range partitioning, and the document at
a bound goes to both ranges beside it; texts travel once, compressed.

Defined results: a null or empty text has the empty fingerprint, and likeness 1
to another empty one, 0 to any other; very long texts are parsed whole, some MB
at a time; equal texts have equal fingerprints; a null doc_id comes after all
others, and rows of one doc_id are ordered by a hash of their text, so that
repeated rows follow each other; a single row is its own next document; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulage.llm.common import mix64, slices, utf8_list

#: Bins of each level's sample, from level 1 on (phrases of about 3, 10 and
#: 30 code points).
BINS = (16, 32, 64)
#: Filled bins that a level needs on both sides to be compared.
ENOUGH = 8
#: Rounds of coin tossing: 64 bits to 128 labels, 14, 8 and 6.
ROUNDS = 4

_U64 = np.uint64
_ODD = _U64(0x9E3779B97F4A7C15)
_FACTOR = _U64(0xD6E8FEB86659FD93)


def _labels(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The label of each name; ``first`` marks each text's first name.
    Neighbours within a text differ, before and after."""
    label = names
    for _ in range(ROUNDS):
        one = label.dtype.type(1)
        differ = np.empty_like(label)
        differ[1:] = label[1:] ^ label[:-1]
        differ[first] = one
        differ &= ~differ + one  # the lowest bit alone
        place = np.bitwise_count(differ - one)  # 8 bits from here on
        label = place + place + (label & differ != 0)
    return label


def next_level(names: np.ndarray, text: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrase names, the text that each is in, and where in ``names`` each
    starts. ``text`` numbers the texts that ``names`` follow one another from."""
    n = len(names)
    if not n:
        return names, text, np.empty(0, np.int64)
    new = np.ones(n, bool)
    new[1:] = (names[1:] != names[:-1]) | (text[1:] != text[:-1])
    run = np.flatnonzero(new)
    times = np.diff(run, append=n).astype(_U64)
    names, text = names[run], text[run]
    several = np.flatnonzero(times > 1)
    names[several] = mix64(names[several] + times[several] * _ODD)
    first = np.ones(len(names), bool)
    first[1:] = text[1:] != text[:-1]
    label = _labels(names, first)
    higher = np.zeros(len(names), bool)
    higher[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    ends = np.ones(len(names), bool)  # a text's last name starts no phrase
    ends[:-1] = first[1:]
    start = np.flatnonzero((higher & ~ends) | first)
    within = np.arange(len(names)) - np.repeat(start, np.diff(start, append=len(names)))
    spread = (names + (within.astype(_U64) + _U64(level)) * _ODD) * _FACTOR
    spread ^= spread >> _U64(32)
    return mix64(np.add.reduceat(spread, start) + _U64(level)), text[start], run[start]


def margin(level: int) -> int:
    """Phrases of a level at either end of a passage that what stands around
    the passage may change: those that need names outside it."""
    return (margin(level - 1) + 6) // 2 + 2 if level else 0


def _sample(names: np.ndarray, text: np.ndarray, texts: int, bins: int) -> np.ndarray:
    """[text, bin]: 1 to 4095, 0 if empty."""
    out = np.zeros(texts * bins, np.uint16)
    if len(names):
        spread, bits = (names + _ODD) * _FACTOR, _U64(bins.bit_length() - 1)
        spread ^= spread >> _U64(29)
        cell = text.astype(_U64) * _U64(bins) + (spread >> (_U64(64) - bits))
        cell = cell << _U64(32) | spread << bits >> _U64(32)
        cell.sort()
        at = (cell >> _U64(32)).astype(np.int64)
        lowest = np.flatnonzero(np.diff(at, prepend=-1))
        out[at[lowest]] = (cell[lowest] & _U64(2**32 - 1)) % _U64(4095) + _U64(1)
    return out.reshape(texts, bins)


def sketches(texts: list[str], bins: tuple[int, ...] = BINS) -> np.ndarray:
    """[text, bin] of all levels side by side."""
    lengths = np.array([len(t) for t in texts], np.int64)
    names = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(_U64) + _U64(1)
    text, parts = np.repeat(np.arange(len(texts)), lengths), []
    for level, n in enumerate(bins, 1):
        names, text, _ = next_level(names, text, level)
        parts.append(_sample(names, text, len(texts), n))
    return np.hstack(parts)


_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def written(sketch: np.ndarray) -> list[str]:
    """Three digits a bin; the empty string for a text without code points."""
    digits = np.stack([_HEX[sketch >> 8], _HEX[sketch >> 4 & 15], _HEX[sketch & 15]], axis=-1)
    width = 3 * sketch.shape[1]
    rows, filled = digits.tobytes().decode(), sketch.any(1)
    return [rows[i * width:(i + 1) * width] if some else "" for i, some in enumerate(filled)]


def read(fingerprints: list[str], bins: tuple[int, ...] = BINS) -> np.ndarray:
    """The sketches that ``written`` gave."""
    blank = "0" * 3 * sum(bins)
    raw = np.frombuffer("".join(f or blank for f in fingerprints).encode(), np.uint8).reshape(len(fingerprints), -1, 3)
    digits = np.where(raw >= 97, raw - 87, raw - 48).astype(np.uint16)
    return digits[..., 0] << 8 | digits[..., 1] << 4 | digits[..., 2]


def likeness(a: np.ndarray, b: np.ndarray, bins: tuple[int, ...] = BINS) -> np.ndarray:
    """Row by row, the estimated share (0 to 1) of phrase names in common."""
    out = np.zeros(len(a))
    done = np.zeros(len(a), bool)
    for level in reversed(range(len(bins))):
        part = slice(sum(bins[:level]), sum(bins[:level + 1]))
        x, y = a[:, part], b[:, part]
        enough = (np.count_nonzero(x, 1) >= ENOUGH) & (np.count_nonzero(y, 1) >= ENOUGH) if level else True
        use = ~done & enough
        either = np.count_nonzero(x | y, 1)
        alike = np.count_nonzero((x == y) & (x > 0), 1) / np.maximum(either, 1)
        out = np.where(use, 2 * alike / (1 + alike), out)
        done |= use
    neither = ~a.any(1) & ~b.any(1)
    return np.where(neither, 1.0, out)


def fingerprints(texts: list[str]) -> list[str]:
    return written(sketches(texts))


def fingerprint(docs: DataFrame) -> DataFrame:
    """``docs`` and the column __fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            found = fingerprints([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())],
                                             names=[*batch.schema.names, "__fingerprint"])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(run, f"{schema}, __fingerprint string")


# --- neighbours ----------------------------------------------------------

_ORDER = ("known", "id", "hash")


def _ordered(docs: DataFrame) -> DataFrame:
    """doc_id and text with the three values that order them, descending."""
    return docs.select("doc_id", "text", F.col("doc_id").isNotNull().cast("int").alias("known"),
                       F.coalesce("doc_id", F.lit(0)).cast("bigint").alias("id"), F.xxhash64("text").alias("hash"))


def _bounds(rows: DataFrame) -> list[tuple[int, int, int]]:
    """The first row's values of each range, ascending by minus the order:
    a row for each shuffle partition at most."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.select(*_ORDER).repartitionByRange(n, *[F.desc(c) for c in _ORDER])
    firsts = ranged.groupBy(F.spark_partition_id()).agg(F.max(F.struct(*_ORDER)).alias("x")).select("x.*").collect()
    return sorted(tuple(-v for v in r) for r in firsts)


def neighbours(docs: DataFrame) -> DataFrame:
    """Every document row in its range, ordered: part, guest, the order's
    values, doc_id, text (compressed), fingerprint. A range's last row is a
    guest, the first of the next range (the first range follows the last)."""
    rows = _ordered(docs)
    shared = docs.sparkSession.sparkContext.broadcast(_bounds(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        bounds, pack = shared.value, zstandard.ZstdCompressor(3).compress
        for batch in slices(batches, "text", 4 << 20):
            found = fingerprints([t or "" for t in batch.column("text").to_pylist()])
            packed = [pack(t or b"") for t in utf8_list(batch.column("text"))]
            at, part, guest = [], [], []
            for i, order in enumerate(zip(*(batch.column(c).to_pylist() for c in _ORDER), strict=True)):
                key = tuple(-v for v in order)
                p = max(0, bisect_right(bounds, key) - 1)
                at.append(i), part.append(p), guest.append(0)
                if bounds[bisect_left(bounds, key) % len(bounds)] == key:  # it opens a range
                    at.append(i), part.append((p - 1) % len(bounds)), guest.append(1)
            whole = pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", *_ORDER)), pa.array(packed, pa.binary()), pa.array(found, pa.string())],
                names=["doc_id", *_ORDER, "packed", "fingerprint"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(guest, pa.int32()), *whole.columns],
                names=["part", "guest", *whole.schema.names])

    dealt = rows.mapInArrow(run, "part int, guest int, doc_id bigint, known int, id bigint, hash bigint, packed binary, "
                                 "fingerprint string")
    return dealt.repartition("part").sortWithinPartitions("part", "guest", *[F.desc(c) for c in _ORDER])


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by the beginning of another."""
    third = len(text) // 3
    return text[:len(text) - third] + following[:third]


def compare(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next."""
    schema = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("part", "guest", "doc_id", "fingerprint"))
            for (*row, mark), packed in zip(zip(*columns, strict=True), batch.column("packed"), strict=True):
                yield *row, mark, unpack(packed.as_py()).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, held, last = [], 0, None
        for row in rows_of(batches):
            if last is not None and last[0] == row[0] and not last[1]:
                pairs.append((last, row))
                held += len(last[4])
                if held > 4 << 20:
                    yield results(pairs)
                    pairs, held = [], 0
            last = row
        if pairs:
            yield results(pairs)

    def results(pairs: list) -> pa.RecordBatch:
        changed = [edited(a[4], b[4]) for a, b in pairs]
        own, following = (read([pair[k][3] for pair in pairs]) for k in (0, 1))
        other = sketches(changed)
        return pa.RecordBatch.from_arrays(
            [pa.array([a[2] for a, _ in pairs], pa.int64()), pa.array([len(a[4]) for a, _ in pairs], pa.int64()),
             pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
             pa.array([a[3] for a, _ in pairs], pa.string()), pa.array(written(other), pa.string()),
             pa.array(likeness(own, other)), pa.array(likeness(own, following))],
            names=[c.split()[0] for c in schema.split(", ")])

    return neighbours(docs).mapInArrow(run, schema)
