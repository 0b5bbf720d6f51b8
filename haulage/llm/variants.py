r"""Spelling variants: words that differ by one code point, grouped under the
most frequent spelling.

Words are the runs of Latin letters in whole texts, counted over all documents.
Two words are near if one inserted, deleted or replaced code point makes them
equal. Candidates come from blocked Gram matrices: a word is the vector of its
letters' counts, a block's words give a matrix X, and |x|^2 + |y|^2 - 2 X X^T has
all squared distances in it at once. Near words have a distance of two at most and
lengths that are equal or adjacent; such pairs are verified on the words, by the
lengths of their common beginning and common end.

Blocks hold the words of two adjacent lengths that share two thirds: one edit
leaves at least two thirds of the shorter word as they are, so each near pair
meets in a block, and counts in the first of its blocks only, while words that
share less are never compared. Small blocks next to each other share a matrix
of ``MATRIX_WORDS`` words. A block of more words is dealt into parts, and each two
parts meet in a matrix of their own. From a matrix only sums leave, one row for
each word with a near one.

Defined results: a null text has no words, and neither has an empty one; very
long texts are read whole, and a run of any length is a word; a null doc_id is
hashed as if it were written as nothing; repeated rows are documents of their
own and count; ties go to the spelling that is first in code-point order; an
empty table gives no words; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulage.llm.common import shared_write

LEAST_CHARS = 7
LEAST_COUNT = 2
#: A form is so many times as frequent as its variant, at least.
TIMES = 10
#: One run in so many loses a code point.
DROP = 31
MATRIX_WORDS = 512
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# --- words ---------------------------------------------------------------

def runs(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """doc_id and run: every maximal run of at least ``least`` letters, A-Z in
    lower case."""
    pattern = F.lit(f"[A-Za-zÀ-ÿ]{{{least},}}")
    return docs.select("doc_id", F.explode(F.regexp_extract_all("text", pattern, F.lit(0))).alias("run")).select(
        "doc_id", F.translate("run", _UPPER, _LOWER).alias("run"))


def misspelt(doc_id: Column, run: Column, drop: int = DROP) -> Column:
    """The run without one code point where ``drop`` divides its hash."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % drop == 0, cut).otherwise(run)


def words(docs: DataFrame, drop: int = DROP, least: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n of the words that occur often enough, written and read back."""
    found = runs(docs, least).select(misspelt(F.col("doc_id"), F.col("run"), drop).alias("word"))
    counts = found.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n"))
    return shared_write(counts.where(F.col("n") >= least_count), "words")


# --- near words ----------------------------------------------------------

_BLOCK = ["short", "away", "rest"]


def blocks(words: DataFrame, matrix_words: int = MATRIX_WORDS) -> DataFrame:
    """word, n and block: short (the shorter length of two adjacent ones),
    away (the third that may differ) and rest (the two others); i, j: the two
    parts of a large block that meet, and part: the word's own."""
    length = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("short"))
    third, first = F.expr("short div 3"), F.lit(1)
    upto, since = F.col("short") - third, length - F.col("short") + third + 1
    kept = {3: F.substring("word", first, upto), 1: F.substring("word", since, length),
            2: F.concat_ws(" ", F.substring("word", first, third), F.substring("word", length - third + 1, length))}
    rows = rows.select("*", F.explode(F.array(*[
        F.struct(F.lit(k).alias("away"), rest.alias("rest")) for k, rest in kept.items()])).alias("x"))
    rows = rows.select("word", "n", "short", "x.away", "x.rest")
    large = rows.groupBy(*_BLOCK).agg(F.count("*").alias("size")).where(F.col("size") > matrix_words).select(
        *_BLOCK, F.ceil(F.col("size") * 2 / matrix_words).cast("int").alias("parts"))
    dealt = rows.join(shared_write(large, "large-blocks"), _BLOCK, "left")
    mine = F.coalesce(F.pmod(F.xxhash64("word"), "parts"), F.lit(0)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    return dealt.withColumn("part", mine).withColumn("other", other).select(
        *_BLOCK, F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "word", "n")


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of each word from its beginning, and from its end, padded with
    0 (all letters are Latin-1), and the lengths."""
    raw = [w.encode("latin-1") for w in words]
    size = np.array([len(w) for w in raw])
    wide = int(size.max())
    left = np.frombuffer(b"".join(w.ljust(wide, b"\0") for w in raw), np.uint8).reshape(-1, wide)
    right = np.frombuffer(b"".join(w[::-1].ljust(wide, b"\0") for w in raw), np.uint8).reshape(-1, wide)
    return left, right, size


def letter_counts(left: np.ndarray) -> np.ndarray:
    """[word, letter]: how often each letter that occurs is in each word.
    Squares are exact in the type chosen."""
    used, at = np.unique(left, return_inverse=True)
    n = len(left)
    cells = np.repeat(np.arange(n), left.shape[1]) * len(used) + at.reshape(-1)
    counts = np.bincount(cells, minlength=n * len(used)).reshape(n, -1)
    return counts[:, used > 0].astype(np.float32 if left.shape[1] <= 2048 else np.float64)


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, the number of equal letters before the first unequal ones."""
    differ = x != y
    return np.where(differ.any(1), differ.argmax(1), x.shape[1])


def near_pairs(words: list[str], block: np.ndarray, short: np.ndarray, away: np.ndarray,
               part: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (a, b) of the near words of the same block that count there;
    words come by block, all arrays are by word."""
    left, right, size = _letters(words)
    x = letter_counts(left)
    square = (x * x).sum(1)
    distance = square[:, None] + square[None, :] - 2 * (x @ x.T)
    a, b = np.nonzero(distance <= 2)
    ok = (a < b) & (block[a] == block[b]) & (np.minimum(size[a], size[b]) == short[a])
    # two parts meet: a pair inside one part belongs to that part's own matrix
    ok &= (part[a] != part[b]) | (i[a] == j[a])
    a, b = a[ok], b[ok]
    keep = np.zeros(len(a), bool)
    step = max(1, (4 << 20) // left.shape[1])
    for s in range(0, len(a), step):
        p, q = a[s:s + step], b[s:s + step]
        low, high = np.minimum(size[p], size[q]), np.maximum(size[p], size[q])
        begin = np.minimum(_common(left[p], left[q]), low)
        end = np.minimum(_common(right[p], right[q]), low)
        # of the blocks that a pair shares, it counts in the first of 3, 1, 2
        counts = (away[p] == 3) | (begin < low - low // 3) & ((away[p] == 1) | (end < low - low // 3))
        keep[s:s + step] = (begin + end >= high - 1) & counts
    return a[keep], b[keep]


def near_sums(blocks: DataFrame, matrix_words: int = MATRIX_WORDS) -> DataFrame:
    """word, n_near, best_n and best (its most frequent near word) of each
    word with near words, per matrix."""
    key = [*_BLOCK, "i", "j"]
    schema = "word string, n_near bigint, best_n bigint, best string"

    def results(table: pa.Table) -> pa.RecordBatch:
        names = table.column("word").to_pylist()
        n, *facts = (table.column(c).to_numpy() for c in ("n", "block", "short", "away", "part", "i", "j"))
        a, b = near_pairs(names, *facts)
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
        rank = np.empty(len(names), np.int64)  # by n, the largest first, then by word
        rank[sorted(range(len(names)), key=lambda k: (-n[k], names[k]))] = np.arange(len(names))
        order = np.lexsort((rank[b], a))
        a, b = a[order], b[order]
        at = np.flatnonzero(np.diff(a, prepend=-1))
        return pa.RecordBatch.from_arrays(
            [pa.array([names[k] for k in a[at]], pa.string()), pa.array(np.diff(at, append=len(a)), pa.int64()),
             pa.array(n[b[at]], pa.int64()), pa.array([names[k] for k in b[at]], pa.string())],
            names=["word", "n_near", "best_n", "best"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0  # whole blocks, and the last one so far
        last, number = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(c).to_pylist() for c in key), strict=True))
            numbers = np.empty(len(keys), np.int64)
            for k, x in enumerate(keys):
                number, last = number + (x != last), x
                numbers[k] = number
            held.append(batch.append_column("block", pa.array(numbers)))
            count += len(keys)
            if count >= 8 * matrix_words:
                table = pa.Table.from_batches(held)
                upto = int(np.searchsorted(table.column("block").to_numpy(), number))
                yield from matrices(table.slice(0, upto))
                held, count = table.slice(upto).combine_chunks().to_batches(), table.num_rows - upto
        if held:
            yield from matrices(pa.Table.from_batches(held))

    def matrices(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Blocks together up to a matrix's size, each whole in one."""
        block = table.column("block").to_numpy()
        start = 0
        while start < len(block):
            stop = int(np.searchsorted(block, block[min(start + matrix_words, len(block) - 1)]))
            if start + matrix_words >= len(block):
                stop = len(block)
            elif stop <= start:  # one block fills it
                stop = int(np.searchsorted(block, block[start], side="right"))
            yield results(table.slice(start, stop - start))
            start = stop

    dealt = blocks.repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(run, schema)


def forms(words: DataFrame, matrix_words: int = MATRIX_WORDS, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form and form_n, written and read back. ``words``:
    word (distinct), n."""
    sums = near_sums(blocks(words, matrix_words), matrix_words)
    best = sums.groupBy("word").agg(F.sum("n_near").alias("n_near"),
                                    F.min(F.struct((-F.col("best_n")).alias("minus"), "best")).alias("x"))
    rows = words.join(best, "word", "left")
    is_form = -F.col("x.minus") >= times * F.col("n")
    return shared_write(rows.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("x.best")).alias("form"),
        F.when(is_form, -F.col("x.minus")).alias("form_n")), "forms")


def roots(rows: DataFrame) -> DataFrame:
    """word and root of the words that have a form: forms followed to the
    last one. Each round doubles the steps that a row has taken."""
    steps = rows.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = shared_write(steps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                                      F.col("next").isNotNull().alias("moved")), "roots")
        if steps.where("moved").isEmpty():
            return steps.select("word", "root")
        steps = steps.drop("moved")


def group(docs: DataFrame, drop: int = DROP, matrix_words: int = MATRIX_WORDS, times: int = TIMES) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n."""
    rows = forms(words(docs, drop), matrix_words, times)
    return rows.join(roots(rows), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
