"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper-case ASCII to lower case, every other byte as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_U64 = np.uint64


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8_list(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column; None for null."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a piece holds about ``most_bytes`` of text at most
    (or one row), which bounds a task's memory whatever the batch size."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = np.array([0 if x is None else x for x in pc.binary_length(batch.column(text)).to_pylist()])
        ends = np.cumsum(sizes)
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        give_back()


def give_back() -> None:
    """Return freed memory to the system. Spark keeps Python workers for later
    tasks, and what their allocators hold on to counts against the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_libc(), "malloc_trim", None)
    if trim:
        trim(0)


@cache
def _libc():
    import ctypes

    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library: nothing to trim
        return None


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), elementwise."""
    x = x.astype(_U64, copy=True)
    x ^= x >> _U64(30)
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembered up to a bounded number of words."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: Sequence[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=_U64, count=len(words))


#: Bits of a Bloom filter: 8 MB, whatever it is asked to hold.
BLOOM_BITS = 1 << 26


def _bloom_places(keys: np.ndarray) -> np.ndarray:
    """[2, key]: the two bits that stand for each 64-bit key."""
    h = mix64(keys.astype(np.int64).view(_U64))
    return np.stack([h, h >> _U64(32)]) & _U64(BLOOM_BITS - 1)


class Bloom:
    """A Bloom filter of the values of a bigint column, built by Spark as the
    words that have bits; at most BLOOM_BITS / 64 rows reach the driver. It
    drops rows below an exchange that a join would drop after it: with more keys
    than it has room for it lets more rows pass, and no result changes."""

    def __init__(self, keys: DataFrame):
        def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = _bloom_places(batch.column(0).drop_null().to_numpy()).reshape(-1)
                word, place = np.unique(at >> _U64(6), return_inverse=True)
                bits = np.zeros(len(word), _U64)
                np.bitwise_or.at(bits, place, _U64(1) << (at & _U64(63)))
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(bits.view(np.int64))],
                                                 names=["word", "bits"])

        found = keys.mapInArrow(words, "word int, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        table = np.zeros(BLOOM_BITS // 64, np.int64)
        table[found.column("word").to_numpy()] = found.column("bits").to_numpy()
        self.shared = keys.sparkSession.sparkContext.broadcast(table)

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key may be one of the filter's: never no for one that is."""
        table, at = self.shared.value.view(_U64), _bloom_places(keys)
        return ((table[(at >> _U64(6)).astype(np.int64)] >> (at & _U64(63))) & _U64(1)).all(0)

    def cut(self, df: DataFrame, column: str) -> DataFrame:
        """The rows of ``df`` whose key the filter may hold."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                key = batch.column(column)
                held = self.may_hold(key.fill_null(0).to_numpy())
                chosen = batch.filter(pc.and_(pa.array(held), key.is_valid()))
                if chosen.num_rows:
                    yield chosen

        return df.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes))


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi join on ``keys`` in which null equals null; the right side's keys
    are dropped."""
    renamed = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    cond = None
    for k in keys:
        one = left[k].eqNullSafe(renamed[f"__right_{k}"])
        cond = one if cond is None else cond & one
    out = left.join(renamed, cond, how)
    return out.drop(*[f"__right_{k}" for k in keys]) if how not in ("left_semi", "left_anti") else out


def shared_write(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written once to the cluster's shared folder and read back: the
    lineage ends there, so a lost executor costs no recomputation."""
    from haulage.session import materialize

    return materialize(df, f"llm-{purpose}")


def empty_strings(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.coalesce(F.col(n), F.lit("")) for n in names})
