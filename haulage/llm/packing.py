"""Packing documents into sequences by minimum bin slack.

A document is its token ids and one end id. It is cut into pieces of
``capacity`` ids; a full piece is a sequence of its own, the shorter rest is
packed with others. Which rests go together is decided on lengths alone: the
counts of the ``capacity - 1`` possible lengths are a bounded table, whatever
the number of documents. For each window (sequence) a subset-sum dynamic
program over the remaining multiset of lengths, held as a bitset of reachable
sums, finds the fill closest to capacity; backtracking gives how many pieces
of each length it takes. The same fill is used for as many sequences as the
remaining counts allow, so the plan has a few thousand entries at most.

Spark then deals the pieces out: a piece's rank among those of its length
(numbered inside each task, plus the counts of the tasks before) selects its
plan entry, sequence and offset. Nothing but the table of lengths and the
plan passes through the driver, and a length shared by a third of all pieces
is ranked by all tasks together.

Defined results: a null text is an empty one, a single end id; repeated rows
are packed as documents of their own; pieces of equal length (ties) are
interchangeable and dealt out by task and place; very long texts are encoded
whole and cut into pieces; other columns are ignored; an empty table gives no
pieces.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haulage.llm.common import give_back, shared_write, slices, utf8_list

CAPACITY = 2048
END_ID = 1
#: Chunks, and parts of chunks, whose ids a worker remembers, and bytes of text that
#: it encodes at once: they cost memory and save time, and change no result.
REMEMBERED = 200_000
SLICE_BYTES = 4 << 20

# --- tokens --------------------------------------------------------------

#: Parts of a chunk whose ASCII letters are lower case: letters (all
#: non-ASCII characters count as such), one digit, or other characters.
_PARTS = re.compile(rb"[a-z\x80-\xff]+|[0-9]|[^a-z0-9\x80-\xff]+")


def _letters(part: str) -> bool:
    """Letters only, and in lower case too."""
    return part.isalpha() and part.lower().isalpha()


def _byte_level() -> dict[int, str]:
    """The byte-level alphabet of byte-pair encodings: printable Latin-1 bytes
    are their own character, the others follow from U+0100 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


# The steps before the model that ``Encoder`` does for chunks by itself.
_KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "behavior": "Removed", "invert": True, "pattern": {
            "Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


class Memory(dict):
    """What a function of many keys gave, for the keys used lately: when ``most``
    would be passed, those held become the old ones, and old ones not used since are dropped."""

    def __init__(self, function, most: int):
        super().__init__()
        self.function, self.most, self.old = function, most, {}

    def of(self, keys: list) -> list:
        found = list(map(self.get, keys))
        for step in (lambda new: list(map(self.old.get, new)), self.function):
            at = [i for i, value in enumerate(found) if value is None]
            if not at:
                break
            new = [keys[i] for i in at]
            values = step(new)
            for i, value in zip(at, values, strict=True):
                found[i] = value
            self._keep([(k, v) for k, v in zip(new, values, strict=True) if v is not None])
        return found

    def _keep(self, items: list) -> None:
        if len(self) + len(items) > self.most:
            self.old = dict(self)
            self.clear()
        self.update(items[:self.most])


class Encoder:
    """Token ids by ``tokenizers``, remembering what parts of texts encode to.

    The tokenizer never joins text across ASCII white space, so a text's ids
    are those of its chunks, one after another. A chunk is cut into parts
    where the tokenizer itself cuts, and a part goes to the tokenizer's model,
    normalised as the tokenizer would; numpy cuts the chunks whose characters are
    all listed in ``_CLASS`` and ``_LETTERS``, ``_split`` the others. Anything out of
    the ordinary is left to the whole tokenizer. The memories are bounded. Texts that hold a
    special token's string are encoded whole, as those strings may span white
    space; so are all texts if the file's normalizer or pre-tokenizer is another
    one than that which this class knows.
    """

    def __init__(self, path: str, most: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.alphabet = _byte_level()
        steps = {k: getattr(self.tokenizer, k) for k in _KNOWN}
        self.whole_texts = any(x is None or json.loads(x.__getstate__()) != _KNOWN[k] for k, x in steps.items())
        self.chunks, self.parts = Memory(self._chunks, most), Memory(self._parts, most)

    def _whole(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def _parts(self, parts: list[bytes]) -> list[bytes]:
        """What parts encode to, made ready for the model together, as lines of one text."""
        text = unicodedata.normalize("NFC", b"\n".join(parts).decode())
        # letters of the old alphabets, whose case and composition are settled; others are left to the tokenizer
        far = {i for i, p in enumerate(text.split("\n")) if _FAR.search(p)} if _FAR.search(text) else ()
        lowered = text.replace("\u03a3", "\u03c3").lower()  # a sigma is the same at a word's end
        mapped = lowered.encode().decode("latin-1").translate(self.alphabet).split(self.alphabet[10])
        tokenize, ids, ends = self.model.tokenize, [], [0]
        for i, (part, ready) in enumerate(zip(parts, mapped, strict=True)):
            if i in far:
                ids += self.tokenizer.encode(part.decode(), add_special_tokens=False).ids
            else:
                ids += [t.id for t in tokenize(ready)]
            ends.append(4 * len(ids))
        held = self._bytes(ids)
        return [held[s:e] for s, e in pairwise(ends)]

    @staticmethod
    def _split(chunk: bytes) -> list[bytes] | None:
        """A chunk's parts; None if it is out of the ordinary."""
        lowered = chunk.lower()  # ASCII letters only
        if b"'" not in lowered and lowered.decode().isprintable():
            parts = _PARTS.findall(lowered)
            if all(p.isascii() or _letters(p.decode()) for p in parts):
                return parts
        return None

    def _chunks(self, chunks: list[bytes]) -> list[bytes]:
        split = [self._split(c) for c in chunks]
        parts = list({p: None for found in split for p in found or ()})
        known = dict(zip(parts, self.parts.of(parts), strict=True))
        return [self._whole(c.decode()) if found is None else b"".join(map(known.__getitem__, found))
                for c, found in zip(chunks, split, strict=True)]

    def encode_all(self, texts: list[bytes]) -> list[np.ndarray]:
        """Parts are cut by numpy and numbered by Arrow; each different one is looked up
        once, and numpy gathers the ids of all."""
        if not texts:
            return []
        alone = [self.whole_texts or any(s in t for s in self.special) for t in texts]
        joined = b"\n".join(b"" if a else t for t, a in zip(texts, alone, strict=True)) + b"\n"
        kind = np.int32 if len(joined) < 1 << 29 else np.int64  # of places in the text and in its ids
        place, cut, text, odd = _cut(np.frombuffer(joined, np.uint8), kind)
        parts = pa.Array.from_buffers(pa.binary() if kind is np.int32 else pa.large_binary(), len(place),
                                      [None, pa.py_buffer(cut), pa.py_buffer(text)]).dictionary_encode()
        code, found = parts.indices.to_numpy(), parts.dictionary.to_numpy(zero_copy_only=False)
        del cut, text
        whole = np.zeros(len(found), bool)  # a chunk that was not cut equals no part
        whole[code[odd]] = True
        for memory, which in ((self.parts, ~whole), (self.chunks, whole)):
            found[which] = memory.of(found[which].tolist())
        flat = np.frombuffer(b"".join(found.tolist()), "<u4")
        size = np.fromiter(map(len, found), kind, len(found)) // 4
        n, first = size[code], (np.cumsum(size, dtype=kind) - size)[code]
        upto = np.zeros(len(n) + 1, kind)
        np.cumsum(n, dtype=kind, out=upto[1:])
        first -= upto[:-1]
        where = np.repeat(first, n)
        where += np.arange(len(where), dtype=kind)
        ids = flat[where]
        ends = np.cumsum([0 if a else len(t) for t, a in zip(texts, alone, strict=True)]) + np.arange(len(texts))
        at = np.concatenate([[0], upto[np.searchsorted(place, ends.astype(kind))]])  # by parts before each text's end
        return [np.frombuffer(self._whole(t.decode()), "<u4") if a else ids[s:e]
                for t, a, s, e in zip(texts, alone, at[:-1], at[1:], strict=True)]


#: A byte by itself: a letter, a digit, another printable one, white space, or one that needs a closer look.
_LETTER, _DIGIT, _OTHER, _SPACE, _ODD = range(5)
_CLASS = np.array([_SPACE if b in b" \t\n\r\x0b\x0c" else _ODD if not 32 < b < 127 or b == ord("'") else
                   _LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _OTHER for b in range(256)], np.uint8)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Whether a code point of two UTF-8 bytes is a letter, in lower case too, and composed.
_LETTERS = np.array([128 <= c < 0x530 and _letters(chr(c)) and unicodedata.is_normalized("NFC", chr(c)) for c in range(0x800)])
_FAR = re.compile("[\u0530-\U0010ffff]")


def _cut(raw: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The parts of a text that ends with white space: places in the text, offsets in the
    bytes that follow, those bytes (no white space, ASCII in lower case), and which
    parts are chunks that were not cut and are as they were."""
    of = _CLASS[raw]
    lead = np.flatnonzero((raw >= 0xC2) & (raw < 0xE0))
    lead = lead[_LETTERS[(raw[lead] & 31).astype(np.int16) << 6 | raw[lead + 1] & 63]]
    of[lead] = of[lead + 1] = _LETTER
    text, is_space = _LOWER[raw], of == _SPACE
    starts = of == _DIGIT
    starts[0] = True
    starts[1:] |= of[1:] != of[:-1]
    odd = np.flatnonzero(starts & (of == _ODD))
    uncut = np.zeros(len(raw), bool)
    if len(odd):
        space = np.flatnonzero(is_space)
        chunk = np.searchsorted(space, odd)  # spaces before
        chunk = chunk[np.flatnonzero(np.diff(chunk, prepend=-1))]
        first = np.where(chunk > 0, space[chunk - 1] + 1, 0)
        step = np.zeros(len(raw), np.int8)
        step[first], step[space[chunk]] = 1, -1
        uncut = np.cumsum(step, dtype=np.int8).view(bool)
        starts &= ~uncut
        starts[first] = True
        text[uncut] = raw[uncut]
    edge = np.flatnonzero(starts).astype(kind)
    size, word = np.diff(edge, append=kind(len(raw))), ~is_space[edge]
    place = edge[word]
    cut = np.zeros(len(place) + 1, kind)
    np.cumsum(size[word], dtype=kind, out=cut[1:])
    return place, cut, text[~is_space], uncut[place]


@cache
def _encoder(path: str, most: int) -> Encoder:
    """A worker's own, kept from task to task."""
    return Encoder(path, most)


# --- pieces --------------------------------------------------------------

_PIECES = ("doc_id bigint, start bigint, length int, ids_crc32 bigint, doc_tokens bigint, task int, nth bigint")


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
           with_ids: bool = False, remembered: int = REMEMBERED, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The pieces of every document, written and read back: doc_id, start,
    length, ids_crc32, doc_tokens; (ids, if asked for); task and nth number
    the pieces of one length: nth counts those before it in the same task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = _encoder(tokenizer_path, remembered), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)  # by length: capacity entries at most
        end = np.array([end_id], "<u4")
        for batch in slices(batches, "text", slice_bytes):
            rows, ids_of = [], []
            found = encoder.encode_all([t or b"" for t in utf8_list(batch.column("text"))])
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), found, strict=True):
                ids = np.concatenate([ids, end])
                for start in range(0, len(ids), capacity):
                    piece = ids[start:start + capacity]
                    rows.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), task, seen[len(piece)]))
                    seen[len(piece)] += 1
                    if with_ids:
                        ids_of.append(piece.astype(np.int32))
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            if with_ids:
                columns.append(pa.array(ids_of, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])
            found = ids_of = rows = columns = None
            give_back()

    schema = _PIECES + (", ids array<int>" if with_ids else "")
    return shared_write(docs.select("doc_id", "text").mapInArrow(run, schema), "pieces")


# --- plan ----------------------------------------------------------------

def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Length -> pieces of it: the sub-multiset of ``counts`` whose sum is
    closest to ``capacity`` from below and that holds a piece of the largest
    length. Bit s of a reachable set says that sum s can be filled."""
    first = max(counts)
    left = capacity - first
    mask, reachable = (1 << (left + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []  # (length, pieces taken together, sums reachable before)
    for length in sorted(counts, reverse=True):
        n = min(counts[length] - (length == first), left // length)
        together = 1
        while n > 0:  # 1, 2, 4, ... and the rest: every number up to n
            k = min(together, n)
            steps.append((length, k, reachable))
            reachable |= (reachable << (length * k)) & mask
            n -= k
            together *= 2
        if reachable >> left & 1:
            break
    total = reachable.bit_length() - 1
    fill = {first: 1}
    for length, k, before in reversed(steps):
        if not before >> total & 1:  # the sum needs this step
            fill[length] = fill.get(length, 0) + k
            total -= length * k
    return fill


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Entries (length, first rank, pieces a sequence, first sequence, number
    of sequences, offset of the first piece), by length and rank. A full
    piece is a sequence of its own."""
    remaining = {length: n for length, n in counts.items() if n > 0}
    used: dict[int, int] = defaultdict(int)
    sequence, entries = 0, []
    while remaining:
        fill = {capacity: 1} if capacity in remaining else best_fill(remaining, capacity)
        times = min(remaining[length] // k for length, k in fill.items())
        offset = 0
        for length in sorted(fill, reverse=True):
            k = fill[length]
            entries.append((length, used[length], k, sequence, times, offset))
            used[length] += k * times
            offset += k * length
            remaining[length] -= k * times
            if not remaining[length]:
                del remaining[length]
        sequence += times
    return sorted(entries)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
         with_ids: bool = False, remembered: int = REMEMBERED, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset (and ids, if asked for)."""
    rows = pieces(docs, tokenizer_path, capacity, end_id, with_ids, remembered, slice_bytes)
    by_task = rows.groupBy("task", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    by_task = by_task.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # capacity rows at most
    entries = np.array(plan(counts, capacity), np.int64).reshape(-1, 6)
    shared = docs.sparkSession.sparkContext.broadcast(entries)
    ranked = rows.join(by_task, ["task", "length"]).select(
        "doc_id", "start", F.col("length").cast("bigint").alias("length"), "ids_crc32", "doc_tokens",
        (F.col("nth") + F.col("before")).alias("rank"), *(["ids"] if with_ids else []))
    names = [c for c in ranked.columns if c != "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        wide = int(table[:, 1].max(initial=0)) + 1
        keys = table[:, 0].astype(object) * wide + table[:, 1]  # exact at any size
        keys = keys.astype(np.int64) if len(keys) and keys.max() < 2**62 else keys
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            at = np.searchsorted(keys, length * wide + np.minimum(rank, wide - 1), side="right") - 1
            _, first, k, sequence, _, offset = table[at].T
            nth = rank - first
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(sequence + nth // k),
                 pa.array(offset + nth % k * length)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {t}" for c, t in ranked.dtypes if c != "rank")
    return ranked.mapInArrow(run, schema + ", sequence_id bigint, offset bigint")
