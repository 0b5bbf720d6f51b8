"""The corpus pipeline: documents in, packed training sequences out.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir)
and returns a DataFrame, which ``run`` writes as Parquet and reads again as
the next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from haulage.llm import decontaminate, language, line_dedup, minhash, packing
from haulage.llm.common import read_table, shared_write
from haulage.llm.queries import tokenizer_path

#: The packing stage's Python workers share their executors with what the stages
#: before have left there, so they get less memory than ``op7`` takes.
REMEMBERED, SLICE_BYTES = 50_000, 1 << 20
#: Words a shingle of the near dedup; op2's contract has two.
NEAR_SHINGLE = 5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go, and those where no language holds
    half of the letters."""
    found = language.identify(docs, language.train(docs))
    return found.where("__llm_lang.lang <> 'und' and __llm_lang.score >= 0.5").drop("__llm_lang")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat elsewhere are cut; emptied documents go."""
    return line_dedup.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return minhash.dedup(docs, shingle=NEAR_SHINGLE)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, dealt out to sequences, with their ids."""
    return packing.pack(docs, tokenizer_path(), with_ids=True, remembered=REMEMBERED, slice_bytes=SLICE_BYTES)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("minhash_dedup", near_dedup),
    ("decontaminate", decontaminate_benchmark),
    ("packing", pack_sequences),
]

#: Learned language scores and a tokenizer are not expressible in SQL; the
#: tests hold run() against the stages' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared_write(stage(spark, docs, sf_dir), name)
    return docs
