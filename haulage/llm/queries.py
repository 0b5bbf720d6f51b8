"""The registered queries of this folder: each applies an operator, with its
production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from haulage.llm import (alignment, chat, decontaminate, fingerprints, language, licenses, line_dedup, minhash, packing,
                         quality, secrets, variants, warc)
from haulage.llm.common import read_table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.decide(read_table(spark, sf_dir, "documents"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.decide(read_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict(read_table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haulage.session import scratch_path

    folder = scratch_path(spark, "llm-warc")
    files = warc.write_warc(read_table(spark, sf_dir, "pages"), folder)
    return warc.read_warc(files, folder).drop("url")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = chat.write_formatted(chat.with_probe(spark, read_table(spark, sf_dir, "conversations")))
    return chat.digests(pieces, chat.write_examples(pieces))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(read_table(spark, sf_dir, "documents"))


def op12_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"),
                           tokenizer_path("piece_bpe_32k.model"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(read_table(spark, sf_dir, "documents"))


def build() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_line_dedup, op2_minhash_dedup, op3_quality_rules, op4_language_id, op5_secret_scan, op6_decontaminate,
        op7_packing, op8_warc, op9_chat_format, op10_license_scan, op11_spelling_variants,
        op12_cross_tokenizer, op13_fingerprints)}
