r"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

A text, with a space before it, is encoded by a byte-level tokenizer of the
library tokenizers (A) and a sentencepiece model (B, which adds that space
itself). Byte offsets where a token of both ends cut the tokens into groups;
tokens whose byte ranges overlap are linked. A pair of ids counts as often as
it is linked in the whole corpus.

Where tokens end: the character offsets of A and the spans of B's proto give
coarse cuts, wherever one token's span ends where the next one's begins. Between
two such cuts (a character split over tokens, byte fallback, the space that B
adds) the tokens' decoded bytes say where each ends.

Words repeat, so what is encoded is a text's chunks: white space and the
other characters up to the next space or line break. No token of A holds
white space after another character, by its pattern, and none of B, by its
vocabulary; so a text's tokens are its chunks' tokens one after another, and
groups end at chunks' ends. Both are checked when the tokenizers are read; files
that differ have their texts encoded whole. Chunks are found and numbered by
Arrow and numpy, new ones are encoded together, and a bounded memory keeps
what is known of a chunk as numbers.

The corpus-wide counts come back without a row for each token or document: each
task writes slices of documents (some MB), a slice as one row that lists its
distinct pairs and, compressed, how often each document has which. The pairs of
a slice, not of a document, meet the counts; a pair that all text has is one row
for each slice.

Defined results: a null or empty text has no tokens, and neither has one whose
tokens do not give its bytes back (U+2581 in a text, say): zeros and an empty
digest; very long texts are encoded whole, a text of its own if it is longer than
a slice; of equal counts all are best; repeated rows, and rows of one doc_id or
a null one, are documents of their own and all count; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulage.llm.common import shared_write, slices, utf8_list

#: Chunks that a worker remembers, bytes of text in a slice, and bytes of
#: chunks that are encoded together.
MOST_CHUNKS = 600_000
SLICE_BYTES = 8 << 20
JOINED_BYTES = 16 << 10

_SPACE = "▁".encode()


def _byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for:
    printable Latin-1 itself, the other bytes from U+0100 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class A:
    """The byte-level tokenizer; token bytes by id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        alphabet, vocabulary = _byte_level(), self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes: list[bytes] = [b""] * self.tokenizer.get_vocab_size()
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(alphabet[c] for c in token)
        facts = json.loads(self.tokenizer.to_str())
        split = facts["pre_tokenizer"] or {}
        self.by_chunk = (facts["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True)
                         and not split.get("add_prefix_space"))

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where each token's span begins and ends, in bytes."""
        found = self.tokenizer.encode(text, add_special_tokens=False)
        spans = np.fromiter(chain.from_iterable(found.offsets), np.int64).reshape(-1, 2)
        if not text.isascii():
            code = np.frombuffer(text.encode("utf-32-le"), "<u4")
            width = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
            spans = np.concatenate([[0], np.cumsum(width)])[spans]
        return np.array(found.ids, np.int64), spans[:, 0], spans[:, 1]


class B:
    """The sentencepiece model; piece bytes by id."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes: list[bytes] = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i)
                              else piece.encode().replace(_SPACE, b" "))
        pieces = [self.model.id_to_piece(i).replace("▁", " ") for i in range(len(self.bytes))]
        self.by_chunk = not any(re.search(r"\S[ \n]", p) for p in pieces)
        # spans are bytes of the given text in some versions of the library, characters in others
        self.in_bytes = self.model.encode("é", return_type="proto").pieces[-1].end == 2

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``text`` begins with the space that the model adds itself. Ids, and
        where each piece's span begins and ends, in bytes of ``text``."""
        proto = self.model.encode(text[1:], return_type="proto")
        pieces = list(proto.pieces)
        ids = np.array([p.id for p in pieces], np.int64)
        spans = np.array([[p.begin for p in pieces], [p.end for p in pieces]], np.int64)
        if not self.in_bytes and not text.isascii():
            spans = np.concatenate([[0], np.cumsum([len(c.encode()) for c in text[1:]])])[spans]
        begin, end = spans + 1
        begin[:1] = 0
        return ids, begin, end


def token_ends(begin: np.ndarray, end: np.ndarray, size: np.ndarray, total: int) -> np.ndarray:
    """Where each token ends, in bytes: at the coarse cut where its span ends
    as the next one begins and the decoded bytes (``size``) since the last cut
    reach it, else by the decoded bytes."""
    if not len(end):
        return end
    by_bytes = np.cumsum(size)
    following = np.append(begin[1:], total)
    clean = (end == following) & (end > begin)
    # bytes by which the spans and the decoded bytes differ at the last clean cut before each token
    last = np.maximum.accumulate(np.where(clean, np.arange(len(end)), -1))
    before = np.concatenate([[-1], last[:-1]])
    offset = np.where(before >= 0, end[before] - by_bytes[before], 0)
    return np.where(clean, end, by_bytes + offset)


def overlaps(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (a, b) of the tokens whose byte ranges overlap. Both cover the
    same bytes from 0 on; empty tokens overlap nothing."""
    a_begin, b_begin = (np.concatenate([[0], x[:-1]]) if len(x) else x for x in (a_end, b_end))
    low = np.searchsorted(b_end, a_begin, side="right")
    n = np.where(a_end > a_begin, np.searchsorted(b_begin, a_end, side="left") - low, 0)
    a = np.repeat(np.arange(len(a_end)), n)
    b = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else low, n) + np.arange(len(a))
    some = (b_end > b_begin)[b]
    return a[some], b[some]


class Aligner:
    """Both tokenizers, and a memory of chunks: a chunk's number selects its
    row in arrays (n_a, n_b, n_groups, where its links begin) and its groups."""

    def __init__(self, a_path: str, b_path: str, most: int = MOST_CHUNKS):
        self.a, self.b, self.most = A(a_path), B(b_path), most
        self.by_chunk = self.a.by_chunk and self.b.by_chunk
        self.a_size = np.array([len(x) for x in self.a.bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b.bytes], np.int64)
        # an id as it is written in a group: before another one, and at the end of its side
        self.written = [np.array([[b"%d%b" % (i, mark) for i in range(len(t.bytes))] for mark in (b",", last)], object)
                        for t, last in ((self.a, b"|"), (self.b, b";"))]
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.groups: list[bytes] = []
        self.facts = np.empty((0, 4), np.int64)  # n_a, n_b, n_groups, n_links; n_a is -1 where bytes differ
        self.links = np.empty(0, np.int64)

    def _align(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Facts, links and groups of chunks that may be encoded as one text,
        which begins with a space."""
        raw = b"".join(chunks)
        text = raw.decode()
        (a, *a_span), (b, *b_span) = self.a.encode(text), self.b.encode(text)
        cut = np.cumsum([len(c) for c in chunks])
        a_end = token_ends(*a_span, self.a_size[a], len(raw))
        b_end = token_ends(*b_span, self.b_size[b], len(raw))
        same = [b"".join(map(t.bytes.__getitem__, i.tolist())) == raw for t, i in ((self.a, a), (self.b, b))]
        if not all(same):
            if len(chunks) > 1:  # find the chunk: each by itself
                parts = [self._alone(c) for c in chunks]
                return (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]),
                        [g for p in parts for g in p[2]])
            return np.array([[-1, 0, 0, 0]]), np.empty(0, np.int64), [b""]
        common = a_end[np.isin(a_end, b_end, kind="table")]  # both ascend, without repeats
        x, y = overlaps(a_end, b_end)
        links = a[x] << 32 | b[y]
        of = [np.searchsorted(cut, e, side="left") for e in (a_end, b_end, common, a_end[x])]
        facts = np.stack([np.bincount(k, minlength=len(chunks)) for k in of], axis=1)
        # tokens in the order in which groups are written
        group = [np.searchsorted(common, ends, side="left") for ends in (a_end, b_end)]
        words = [w[(np.diff(g, append=-1) != 0).astype(int), i] for w, g, i in zip(self.written, group, (a, b), strict=True)]
        order = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
        words = np.concatenate(words)[order].tolist()
        at = np.concatenate([[0], np.cumsum(list(map(len, words)))])[np.cumsum(facts[:, 0] + facts[:, 1])].tolist()
        joined = b"".join(words)
        return facts, links, [joined[s:e - 1] for s, e in zip([0, *at[:-1]], at)]

    def _alone(self, chunk: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """A chunk by itself, after a space and a letter, a chunk of its own;
        what that adds is taken off. A whole text needs none."""
        if not self.by_chunk:
            return self._align([chunk])
        raw = b" a" + chunk
        (a, *_), (b, *_) = self.a.encode(raw.decode()), self.b.encode(raw.decode())
        if (b"".join(self.a.bytes[i] for i in a) != raw) or (b"".join(self.b.bytes[i] for i in b) != raw):
            return np.array([[-1, 0, 0, 0]]), np.empty(0, np.int64), [b""]
        facts, links, groups = self._align([b" a", chunk])
        return facts[1:], links[facts[0, 3]:], groups[1:]

    def learn(self, chunks: list[bytes]) -> None:
        """Encode new chunks; those that end in white space by themselves."""
        facts, links, groups = [self.facts], [self.links], [self.groups]
        joined, held = [], 0

        def done(found):
            facts.append(found[0]), links.append(found[1]), groups.append(found[2])

        def flush():
            nonlocal joined, held
            if joined:
                # the text needs a space in front: a chunk of its own, taken off again
                f, k, g = self._align([b" a", *joined])
                done((f[1:], k[f[0, 3]:], g[1:]))
                joined, held = [], 0

        for chunk in chunks:
            self.numbers[chunk] = len(self.numbers)
            if not self.by_chunk or chunk[-1] < 33 or chunk[-1] >= 128 and chunk.decode()[-1].isspace():
                flush()
                done(self._alone(chunk))
                continue
            joined.append(chunk)
            held += len(chunk)
            if held > JOINED_BYTES:
                flush()
        flush()
        self.facts, self.links = np.concatenate(facts), np.concatenate(links)
        self.groups = [x for g in groups for x in g]
        self.start = np.concatenate([[0], np.cumsum(self.facts[:, 3])])

    def numbers_of(self, chunks: pa.Array) -> np.ndarray:
        """The chunks' numbers; new ones are learnt."""
        coded = chunks.dictionary_encode()
        unique = coded.dictionary.to_pylist()
        new = [c for c in unique if c not in self.numbers]
        if len(self.numbers) + len(new) > self.most and self.numbers:
            self.forget()
            new = unique
        if new:
            self.learn(new)
        number = np.fromiter(map(self.numbers.__getitem__, unique), np.int64, len(unique))
        return number[coded.indices.to_numpy()]


@cache
def _aligner(a_path: str, b_path: str) -> Aligner:
    """A worker's own, kept from task to task."""
    return Aligner(a_path, b_path)


def _is_space(data: np.ndarray) -> np.ndarray:
    """Bytes that end a character of white space, or that might: control
    characters count, which only leaves chunks longer."""
    one, two = np.roll(data, 1), np.roll(data, 2)
    out = data <= 32
    out |= (one == 0xC2) & ((data == 0x85) | (data == 0xA0))
    out |= (two == 0xE1) & (one == 0x9A) & (data == 0x80)
    out |= (two == 0xE2) & (one == 0x80) & ((data >= 0x80) & (data <= 0x8A) | (data == 0xA8) | (data == 0xA9) | (data == 0xAF))
    out |= (two == 0xE2) & (one == 0x81) & (data == 0x9F)
    return out | (two == 0xE3) & (one == 0x80) & (data == 0x80)


def chunks_of(texts: list[bytes], by_chunk: bool = True) -> tuple[pa.Array, np.ndarray]:
    """The chunks of all texts, each with a space before it, and how many each
    text has. A chunk begins at a space or line break after another character
    than white space, and at a text's beginning."""
    whole = [b" " + t for t in texts]
    begin = np.concatenate([[0], np.cumsum([len(t) for t in whole])]).astype(np.int64)
    joined = b"".join(whole)
    cut = np.zeros(len(joined) + 1, bool)
    if by_chunk and len(joined):
        data = np.frombuffer(joined, np.uint8)
        space = _is_space(data)
        cut[1:-1] = ((data[1:] == 32) | (data[1:] == 10)) & ~space[:-1]
    cut[begin] = True
    at = np.flatnonzero(cut)
    if not len(texts):
        return pa.array([], pa.binary()), np.empty(0, np.int64)
    chunks = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(joined)])
    return chunks, np.diff(np.searchsorted(at, begin))


# --- the corpus ----------------------------------------------------------

_TOTALS = ("n_a", "n_b", "n_groups", "n_links")


def aligned(docs: DataFrame, a_path: str, b_path: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Slices of documents, written and read back: slice, the documents'
    doc_id, totals and groups_sha256 (arrays), pairs (the slice's distinct
    pairs, with their number of links) and entries (compressed: documents,
    places in pairs, links)."""
    schema = ("slice bigint, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, "
              "n_links array<bigint>, groups_sha256 array<string>, pairs array<struct<pair: bigint, links: bigint>>, entries binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = _aligner(a_path, b_path), TaskContext.get().partitionId() << 33
        for batch in slices(batches, "text", slice_bytes):
            yield one(aligner, batch, number)
            number += 1

    def one(aligner: Aligner, batch: pa.RecordBatch, number: int) -> pa.RecordBatch:
        texts = utf8_list(batch.column("text"))
        filled = np.array([bool(t) for t in texts])
        chunks, n_chunks = chunks_of([t for t in texts if t], aligner.by_chunk)
        code = aligner.numbers_of(chunks)
        doc = np.repeat(np.flatnonzero(filled), n_chunks)
        differs = np.zeros(len(texts), bool)
        differs[doc[aligner.facts[code, 0] < 0]] = True
        kept = ~differs[doc]
        code, doc = code[kept], doc[kept]
        totals = [np.bincount(doc, aligner.facts[code, k], len(texts)).astype(np.int64) for k in range(4)]
        at = np.searchsorted(doc, np.arange(len(texts) + 1))
        listed, digests = code.tolist(), []
        for k in range(len(texts)):
            groups = b";".join(map(aligner.groups.__getitem__, listed[at[k]:at[k + 1]]))
            digests.append(hashlib.sha256(groups).hexdigest() if at[k + 1] > at[k] else "")
        # links: of each document and chunk once, with how often
        places, times = np.unique(doc << 32 | code, return_counts=True)
        doc, code = places >> 32, places & (2**32 - 1)
        n = aligner.facts[code, 3]
        k = np.repeat(aligner.start[code] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        pairs, place = np.unique(aligner.links[k], return_inverse=True)
        cells, at = np.unique(np.repeat(doc, n) * max(1, len(pairs)) + place, return_inverse=True)
        links = np.bincount(at, np.repeat(times, n), len(cells)).astype(np.int64)
        place = cells % max(1, len(pairs))
        listed = pa.array(zip(pairs.tolist(), np.bincount(place, links, len(pairs)).astype(np.int64).tolist()),
                          pa.struct([("pair", pa.int64()), ("links", pa.int64())])) if len(pairs) else pa.array(
                              [], pa.struct([("pair", pa.int64()), ("links", pa.int64())]))
        arrays = [batch.column("doc_id"), *(pa.array(t) for t in totals), pa.array(digests, pa.string()), listed]
        row = [pa.array([number]), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in arrays),
               pa.array([pack(cells // max(1, len(pairs)), place, links)], pa.binary())]
        return pa.RecordBatch.from_arrays(row, names=["slice", "doc_id", *_TOTALS, "groups_sha256", "pairs", "entries"])

    return shared_write(docs.select("doc_id", "text").mapInArrow(run, schema), "aligned")


def pack(doc: np.ndarray, place: np.ndarray, links: np.ndarray) -> bytes:
    """Entries in order of document and place, as differences, compressed."""
    import zstandard

    columns = [np.diff(doc, prepend=0), place - np.where(np.diff(doc, prepend=-1) == 0, np.concatenate([[0], place[:-1]])[:len(place)], 0),
               links]
    small = [c.astype("<u2") if not len(c) or c.max() < 1 << 16 else c.astype("<u8") for c in columns]
    head = np.array([len(doc), *(c.itemsize for c in small)], "<u8").tobytes()
    return zstandard.ZstdCompressor(3).compress(head + b"".join(c.tobytes() for c in small))


def unpack(entries: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(entries)
    n, *sizes = np.frombuffer(raw, "<u8", 4).astype(int).tolist()
    columns, at = [], 32
    for size in sizes:
        columns.append(np.frombuffer(raw, f"<u{size}", n, at).astype(np.int64))
        at += n * size
    step, place, links = columns
    doc = np.cumsum(step)
    total = np.cumsum(place)
    first = np.diff(doc, prepend=-1) != 0
    base = np.maximum.accumulate(np.where(first, np.arange(n), 0)) if n else np.empty(0, int)
    return doc, total - (total - place)[base], links


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, count, and best: whether no pair of the same B id has a larger
    count. Written and read back."""
    pairs = found.select(F.explode("pairs").alias("x")).groupBy("x.pair").agg(F.sum("x.links").alias("count"))
    pairs = shared_write(pairs, "pairs")
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    highest = pairs.groupBy(b.alias("b")).agg(F.max("count").alias("highest"))
    rows = pairs.withColumn("b", b).join(highest, "b")
    return shared_write(rows.select("pair", "count", (F.col("count") == F.col("highest")).alias("best")), "pair-counts")


def digests(found: DataFrame) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256."""
    asked = found.select("slice", F.posexplode("pairs").alias("place", "x")).select("slice", "place", "x.pair")
    told = asked.join(pair_counts(found), "pair").groupBy("slice").agg(
        F.sort_array(F.collect_list(F.struct("place", "count", "best"))).alias("x"))  # a slice's pairs, bounded by its bytes
    told = told.select("slice", F.col("x.count").alias("counts"), F.col("x.best").alias("best"))
    rows = found.drop("pairs").join(told, "slice", "left")
    names = ["doc_id", *_TOTALS, "n_best", "count_sum", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                held = {c: batch.column(c)[k].values for c in ("doc_id", *_TOTALS, "groups_sha256")}
                doc, place, links = unpack(batch.column("entries")[k].as_py())
                n, sums = len(held["doc_id"]), []
                for c in ("best", "counts"):
                    told = batch.column(c)[k].values
                    value = np.asarray(told.to_numpy(zero_copy_only=False)).astype(np.int64) if told is not None else np.empty(0, np.int64)
                    sums.append(exact_sums(doc, links * value[place], n))
                yield pa.RecordBatch.from_arrays(
                    [held["doc_id"], *(held[c] for c in _TOTALS), *(pa.array(s) for s in sums), held["groups_sha256"]], names=names)

    return rows.mapInArrow(run, ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'bigint'}" for c in names))


def exact_sums(doc: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """The sum of the values of each document, in 64 bits; documents come in
    order."""
    total = np.concatenate([[0], np.cumsum(value)])
    at = np.searchsorted(doc, np.arange(n + 1))
    return total[at[1:]] - total[at[:-1]]


def align(docs: DataFrame, a_path: str, b_path: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``digests`` of the documents; ``pair_counts`` gives the table of pairs."""
    return digests(aligned(docs, a_path, b_path, slice_bytes))
