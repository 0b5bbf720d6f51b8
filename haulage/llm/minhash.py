"""Near-duplicate documents by one-permutation MinHash.

A document's set is its distinct word shingles, each a 64-bit hash. One hash
gives the whole signature: its leading bits choose one of ``BINS`` bins, and a
bin keeps the smallest hash that falls into it. Empty bins are filled by
optimal densification: bin b looks at bins drawn by hashes of (b, attempt),
then at all bins in an order of its own, until it meets one that is not empty,
so two sets fill a bin alike as often as they are alike, however small they are.
``ROWS`` bins make a band; documents that share a band meet in its bucket. With
42 bands of 6 a pair of similarity 0.8 meets nowhere once in 350,000 times, and
nearer pairs much less often (sets of a few shingles: about that, as two of
their shingles may fall into one bin).

Equal sets are collapsed first (by a 128-bit digest), so a group of copies is
one node. A bucket gives star-shaped candidates: its smallest node with each
other member, not all pairs. Candidates are confirmed on the full sets. Where
the links so far leave a bucket's members in several components, the star
around one centre may have missed links between others. The members of such
open buckets are compared with each other, but for pairs of one component, in
blocks of bounded size. Each shingle flips one of a set's ``PARITY_BITS`` bits,
so two sets differ by at least as many shingles as bits; pairs that differ by too
many bits are set aside, which is never a link, and the others are confirmed on
their full sets on the spot. So no candidate that could join two components is
left out, and only links are written.

Defined results: a null or empty text, or one without words, has the empty
set and is linked with nothing; fewer words than a shingle are one shingle;
rows that share a doc_id are one document, linked by any of their texts; a
null doc_id is linked with nothing, has a null component and stays; very
long texts are read whole, one at a time; an empty table gives no rows; other
columns are ignored by ``decide`` and kept by ``dedup``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulage.llm.common import LOWER, Bloom, WordHashes, mix64, shared_write, slices, utf8_list

SHINGLE = 2
SIMILARITY = 80  # per cent
BINS = 256
ROWS = 6
BANDS = BINS // ROWS
#: Bits that open buckets compare before sets, a power of two.
PARITY_BITS = 4096
#: Shingles, over its members, that a block of an open bucket holds.
BLOCK_SHINGLES = 500_000


def shingle_set(text: bytes, hashes: WordHashes, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text given as UTF-8."""
    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = hashes.of(words)
    n = len(h) - shingle + 1
    if n < 1:
        shingle, n = len(h), 1
    key = np.full(n, np.uint64(shingle), np.uint64)
    for j in range(shingle):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + h[j:j + n])
    return np.unique(key)


@cache
def _probes(bins: int, attempts: int = 64) -> np.ndarray:
    """[attempt, bin]: the bin that an empty bin looks at."""
    grid = np.arange(attempts * bins, dtype=np.uint64).reshape(attempts, bins)
    return (mix64((grid + np.uint64(1)) << np.uint64(8)) % np.uint64(bins)).astype(np.int64)


_SEEDS = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))


def signature(shingles: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One-permutation MinHash with optimal densification; not for the empty
    set. ``bins`` is a power of two. The set is sorted, so a bin's first entry
    is its smallest."""
    at_bin = (shingles >> np.uint64(65 - bins.bit_length())).astype(np.int64)
    first = np.flatnonzero(np.diff(at_bin, prepend=-1))
    out, filled = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    out[at_bin[first]], filled[at_bin[first]] = shingles[first], True
    probes, empty, attempt = _probes(bins), np.flatnonzero(~filled), 0
    while len(empty):
        if attempt < len(probes):
            probe = probes[attempt][empty]
        else:  # few filled bins: the first of them in the empty bin's own order of all bins
            at = np.flatnonzero(filled)
            order = mix64(((empty[:, None] + 1) * bins + at[None, :] + 1).astype(np.uint64) << np.uint64(24))
            probe = at[order.argmin(1)]
        hit = filled[probe]
        # the borrowing bin is mixed in, so that a value lent twice counts twice
        out[empty[hit]] = out[probe[hit]] + (empty[hit].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        empty = empty[~hit]
        attempt += 1
    return out


def parity(shingles: np.ndarray) -> np.ndarray:
    """PARITY_BITS bits, each the parity of the number of shingles on it."""
    odd = np.bincount((shingles & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def bands(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, different for different bands."""
    rows = sig[:BANDS * ROWS].reshape(BANDS, ROWS)
    key = _SEEDS.copy()
    for j in range(ROWS):
        key = mix64(key + rows[:, j])
    return key.view(np.int64)


def sketches(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null for the empty set) and its
    band keys, written and read back. The sets themselves are not kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, "text"):
            sizes, digests, keys = [], [], []
            for text in utf8_list(batch.column("text")):
                s = shingle_set(text or b"", hashes, shingle)
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                keys.append(bands(signature(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "bands"])

    return shared_write(docs.select("doc_id", "text").mapInArrow(
        run, "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>"), "sketches")


def alike(x: np.ndarray, y: np.ndarray, similarity: int) -> bool:
    """Whether two sorted sets are similar enough, in per cent of the union."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")  # two sorted runs
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= similarity * (len(both) - common)


def confirmed(pairs: DataFrame, texts: DataFrame, similarity: int = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    both = (pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
            .select("a", "b", "text_a", "text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in (y for x in slices(batches, "text_a") for y in slices(iter([x]), "text_b")):
            sets: dict[bytes, np.ndarray] = {}  # a centre's text comes many times
            keep = []
            for a, b in zip(utf8_list(batch.column("text_a")), utf8_list(batch.column("text_b")), strict=True):
                for t in (a, b):
                    if t not in sets:
                        sets[t] = shingle_set(t, hashes, shingle)
                keep.append(alike(sets[a], sets[b], similarity))
            chosen = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            if chosen.num_rows:
                yield chosen

    return both.mapInArrow(run, "a bigint, b bigint").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that a link (a, b) names; a component
    is known by its smallest node. Alternating large and small stars: each
    round is joins and minima over links, and the links shrink to stars."""
    edges = links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u < v").distinct()
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select("v", F.col("m").alias("u")).distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v")
        edges = shared_write(
            small.where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
            .unionByName(low.select("v", F.col("m").alias("u"))).distinct(), "links")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("component"))
        before = now


def candidate_buckets(nodes: DataFrame) -> DataFrame:
    """(key, node, n) of the members of every bucket with two nodes or more,
    written and read back. nodes: node, n (size of its set), bands. Few keys
    have two members, so the rows are cut by a Bloom filter of those keys before
    they are shuffled to meet them."""
    rows = nodes.select("node", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b")
    shared = shared_write(shared.select("key", F.col("a").alias("centre")), "keys")
    bloom = Bloom(shared.select("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("bands").flatten().to_numpy()
            of = np.repeat(np.arange(batch.num_rows), BANDS)
            held = np.flatnonzero(bloom.may_hold(keys))
            if len(held):
                at = pa.array(of[held])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").take(at), batch.column("n").take(at), pa.array(keys[held])], names=["node", "n", "key"])

    likely = nodes.select("node", "n", "bands").mapInArrow(run, "node bigint, n bigint, key bigint")
    return shared_write(likely.join(shared, "key"), "buckets")


def _possible(n: str, m: str, similarity: int):
    """Sets of these sizes can be similar enough."""
    return 100 * F.least(n, m) >= similarity * F.greatest(n, m)


def links_of(nodes: DataFrame, docs: DataFrame, similarity: int = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """(node, component) of the nodes that have links."""
    members = candidate_buckets(nodes)
    sizes = nodes.select(F.col("node").alias("centre"), F.col("n").alias("m"))
    first = (members.where("node <> centre").select("node", "n", "centre").distinct().join(sizes, "centre")
             .where(_possible("n", "m", similarity)).select(F.col("centre").alias("a"), F.col("node").alias("b")))
    checked = shared_write(first, "pairs")
    # few documents have candidates: a Bloom filter keeps the others' texts from being shuffled
    involved = shared_write(members.select(F.col("node").alias("doc_id")).distinct(), "involved")
    texts = Bloom(involved).cut(docs.select("doc_id", "text").where("text is not null"), "doc_id")
    texts = shared_write(texts.join(involved, "doc_id", "left_semi"), "candidate-texts")
    label = components(shared_write(confirmed(checked, texts, similarity, shingle), "links"))

    more = open_links(open_members(members, label), texts, similarity, shingle)
    if more.isEmpty():
        return label
    # the components so far are stars: few links stand for all before
    return components(more.unionByName(label.select(F.col("component").alias("a"), F.col("node").alias("b"))))


def open_members(members: DataFrame, label: DataFrame) -> DataFrame:
    """key, node, n, component and blocks (that the bucket is cut into) of
    the buckets whose members are in several components. Near documents meet in
    many buckets: of those with the same members one is enough."""
    rows = members.join(label.withColumnRenamed("component", "c"), "node", "left").select(
        "key", "node", "n", F.coalesce("c", "node").alias("component"))
    several = rows.groupBy("key").agg(
        F.min("component").alias("x"), F.max("component").alias("y"),
        F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"), F.count("*").alias("size"),
        F.bit_xor(F.xxhash64("node")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("h2")).where("x < y")
    several = several.groupBy("size", "h1", "h2", "blocks").agg(F.min("key").alias("key"))
    return shared_write(rows.join(several.select("key", "blocks"), "key"), "open")


def open_links(members: DataFrame, texts: DataFrame, similarity: int = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """The links (a, b) between members of a bucket that are in different
    components, written and read back. Each two blocks of a bucket meet in a
    group of their own."""
    wanted = texts.join(members.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, "text", 2 << 20):
            sets = [shingle_set(t, hashes, shingle) for t in utf8_list(batch.column("text"))]
            sketches = [parity(s).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sketches, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["node", "sketch", "shingles"])

    drawn = wanted.mapInArrow(draw, "node bigint, sketch binary, shingles binary")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = members.withColumns({"block": mine, "other": others}).join(drawn, "node").select(
        "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        "block", "node", "component", "sketch", "shingles")

    def meet(table: pa.Table) -> pa.Table:
        node, component, block = (table.column(c).to_numpy() for c in ("node", "component", "block"))
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(-1, PARITY_BITS // 64)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        n = np.array([len(x) for x in sets])
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        found: list[tuple[int, int]] = []
        for x in left:
            y = right[(component[right] != component[x]) & ((node[right] > node[x]) | (i != j))]
            y = y[100 * np.minimum(n[y], n[x]) >= similarity * np.maximum(n[y], n[x])]
            if len(y):
                differ = np.bitwise_count(sketch[y] ^ sketch[x]).sum(1, dtype=np.int64)
                y = y[(100 + similarity) * differ <= (100 - similarity) * (n[y] + n[x])]
            found += [(int(min(node[x], node[k])), int(max(node[x], node[k]))) for k in y if alike(sets[x], sets[k], similarity)]
        return pa.table({"a": pa.array([p[0] for p in found], pa.int64()), "b": pa.array([p[1] for p in found], pa.int64())})

    links = rows.groupBy("key", "i", "j").applyInArrow(meet, "a bigint, b bigint")
    return shared_write(links.distinct(), "links")


def decide(docs: DataFrame, similarity: int = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id (smallest doc_id
    reachable), kept (doc_id is that one)."""
    rows = sketches(docs, shingle)
    known = rows.where("digest is not null and doc_id is not null")
    copies = known.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"),
                                         F.first("bands").alias("bands"))
    classes = shared_write(copies, "classes")
    label = links_of(classes.select("node", "n", "bands"), docs, similarity, shingle)
    # rows of one doc_id are one document: their classes belong together
    same = known.select("doc_id", "digest").join(classes.select("digest", "node"), "digest")
    label = _joined(same, label)
    out = rows.drop("bands").join(classes.select("digest", "node"), "digest", "left").join(label, "node", "left")
    component = F.coalesce("component", "node", "doc_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
                      F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _joined(same: DataFrame, label: DataFrame) -> DataFrame:
    """``label`` with the classes joined that texts of one doc_id are in."""
    mixed = same.groupBy("doc_id").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x < y").select("doc_id")
    ties = same.join(mixed, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    if ties.isEmpty():
        return label
    return components(ties.unionByName(label.select(F.col("component").alias("a"), F.col("node").alias("b"))))


def dedup(docs: DataFrame, similarity: int = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that are kept; of rows that share a kept doc_id
    one stays."""
    decisions = shared_write(decide(docs, similarity, shingle), "decisions")
    # written, so that its size is known before the join is planned: texts are shuffled for many ids alone
    gone = shared_write(decisions.where(~F.col("kept")).select("doc_id").distinct(), "gone")
    rows = docs.join(gone, "doc_id", "left_anti")
    again = decisions.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return rows
    return rows.join(again, "doc_id", "left_anti").unionByName(
        rows.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
