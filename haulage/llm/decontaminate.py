"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the benchmark's windows: every ``window`` consecutive words
of an item, or the whole item when it has fewer (but some) words. Patterns of
one length share a matcher. A matcher looks at the block (two words) that
ends at the current position: its shift table says how far the next possible
end of a pattern is, so most positions are never looked at; where the shift
is zero, the bucket of that suffix block, keyed by the pattern's first block,
gives the candidates, and each candidate is compared word by word.

The benchmark is a stated query set, taken in blocks of bounded bytes: each
block becomes one matcher that is sent to the tasks. Documents stream past
it; they are neither shuffled nor collected.

Defined results: a null text has no words, so it is never contaminated and
n_hit is 0; a null ``item_id`` counts as an item named ''; repeated
benchmark rows count once; a repeated document row gets a row of its own;
an empty benchmark finds nothing, and an empty documents table gives no rows;
a word inside several windows (ties) is hit once; very long texts are searched
whole, one at a time; other columns, whatever their names, are
ignored by ``scan`` and passed through by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulage.llm.common import shared_write, slices, utf8_list

WINDOW = 10
#: Bytes of benchmark text that one matcher holds.
BLOCK_BYTES = 2 << 20

#: After lower-casing A-Z, a word is a run of 0-9, a-z and non-ASCII bytes.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class Matcher:
    """Wu-Manber tables for patterns of one length, in words."""

    def __init__(self, length: int):
        self.length = length
        self.width = min(2, length)
        self.jump = length - self.width + 1
        self.shift: dict = {}
        self.buckets: dict = {}

    def _block(self, words, end: int):
        return words[end] if self.width == 1 else (words[end - 1], words[end])

    def add(self, pattern: tuple[bytes, ...], item: str) -> None:
        last = self.length - 1
        for end in range(self.width - 1, self.length):
            block = self._block(pattern, end)
            self.shift[block] = min(self.shift.get(block, self.jump), last - end)
        bucket = self.buckets.setdefault(self._block(pattern, last), {})
        same_start = bucket.setdefault(self._block(pattern, self.width - 1), {})
        same_start.setdefault(pattern, set()).add(item)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int, set[str]]]:
        """(start, end exclusive, items) of every occurrence."""
        length, jump, shift, buckets = self.length, self.jump, self.shift, self.buckets
        pos, n, pair = length - 1, len(words), self.width == 2
        while pos < n:
            block = (words[pos - 1], words[pos]) if pair else words[pos]
            step = shift.get(block, jump)
            if step:
                pos += step
                continue
            start = pos - length + 1
            first = (words[start], words[start + 1]) if pair else words[start]
            candidates = buckets[block].get(first)
            if candidates:
                found = candidates.get(tuple(words[start:pos + 1]))  # equality of all words confirms
                if found:
                    yield start, pos + 1, found
            pos += 1


def build_matchers(items: list[tuple[str, str]], window: int = WINDOW) -> list[Matcher]:
    """items: (id, text) pairs of one benchmark block."""
    by_length: dict[int, Matcher] = {}
    for item, text in items:
        words = words_of(text.encode())
        length = min(window, len(words))
        if not length:
            continue
        matcher = by_length.setdefault(length, Matcher(length))
        for start in range(len(words) - length + 1):
            matcher.add(tuple(words[start:start + length]), item)
    return list(by_length.values())


def find(words: list[bytes], matchers: list[Matcher]) -> tuple[list[tuple[int, int]], set[str]]:
    """Occurrences merged to disjoint word ranges, and the items found."""
    spans, items = [], set()
    for matcher in matchers:
        for start, end, found in matcher.search(words):
            spans.append((start, end))
            items |= found
    return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str]]]:
    """The benchmark's (id, text) pairs in blocks of about ``block_bytes``,
    one on the driver at a time."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text",
    ).where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    placed = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    for block in range(blocks):
        yield [(r["item"], r["text"]) for r in placed.where(F.col("block") == block).collect()]


_FOUND = "__llm_found struct<n_words:bigint,starts:array<int>,ends:array<int>,items:array<string>>"


def _search_block(docs: DataFrame, items: list[tuple[str, str]], window: int) -> DataFrame:
    """``docs`` with __llm_found extended by what one benchmark block finds."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    kind = docs.schema["__llm_found"].dataType
    assert kind.simpleString() == _FOUND.split(" ", 1)[1]
    names = docs.columns
    at = names.index("__llm_found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = build_matchers(shared.value, window)
        for batch in slices(batches, "text"):
            out = []
            for text, before in zip(utf8_list(batch.column("text")), batch.column(at).to_pylist(), strict=True):
                words = words_of(text) if text else []
                spans, found = find(words, matchers)
                if before["starts"]:
                    spans = merged(spans + list(zip(before["starts"], before["ends"], strict=True)))
                out.append({"n_words": len(words), "starts": [s for s, _ in spans], "ends": [e for _, e in spans],
                            "items": sorted(found.union(before["items"]))})
            kind = pa.struct([("n_words", pa.int64()), ("starts", pa.list_(pa.int32())),
                              ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])
            columns = list(batch.columns)
            columns[at] = pa.array(out, kind)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with the column __llm_found: n_words, the disjoint word
    ranges hit (starts, ends exclusive) and the items, sorted as strings."""
    out = docs.withColumn("__llm_found", F.expr(
        "named_struct('n_words', 0L, 'starts', cast(array() as array<int>), 'ends', cast(array() as array<int>), "
        "'items', cast(array() as array<string>))"))
    for number, items in enumerate(benchmark_blocks(benchmark, block_bytes)):
        if number:
            out = shared_write(out, "decontaminate")
        out = _search_block(out, items, window)
    return out


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit (words inside an occurrence),
    n_items, items_sha256 (of the comma-joined item ids), contaminated."""
    found = search(docs.select("doc_id", "text"), benchmark, window, block_bytes)
    f = F.col("__llm_found")
    n_hit = F.aggregate(F.arrays_zip(f["starts"].alias("s"), f["ends"].alias("e")), F.lit(0).cast("bigint"),
                        lambda total, span: total + span["e"] - span["s"])
    return found.select("doc_id", f.alias("f"), n_hit.alias("n_hit")).select(
        "doc_id", F.col("f.n_words").alias("n_words"), "n_hit",
        F.size("f.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("f.items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
          block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs, all
    columns as they were."""
    return (search(docs, benchmark, window, block_bytes)
            .where(F.size("__llm_found.starts") == 0).drop("__llm_found"))
