"""Language identification of mixed-language text.

A word (a run of letters) is scored per language by the log-likelihood of its
letter trigrams, word ends included. The word's script, from code point
ranges, narrows the candidates: languages that training hardly saw in that
script drop out for the word (all stay if none remains). Viterbi over a document's words, with a penalty
for every change of language, labels the words; equal labels in a row are a
span. A document's language is the one whose spans hold most letters, and its
score is that share.

The model is trained here, on at most ``PER_LANGUAGE`` labelled documents (whole
texts, chosen by a hash of doc_id) of each of the ``MOST_LANGUAGES`` languages with
most of them: the bound of what is learned, collected and sent to the tasks, also
if a dirty ``lang`` column holds millions of values. Everything else covers all
documents.

Defined results: ``und`` with score 0 and no spans if the text is null, has no
letter, or nothing was learned; a null doc_id is neither held out nor learned
from; ties go to the language first by name; a repeated row gets a row of its
own; very long texts are read whole, one at a time; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulage.llm.common import slices

#: Bound of the training sample, in documents a language.
PER_LANGUAGE = 600
#: Bound of the languages learned; a language costs 256 KB of the model.
MOST_LANGUAGES = 256
#: Nats that a change of language costs.
PENALTY = 9.0
BUCKETS = 1 << 16

#: Script ranges: first and last code point (fixed values).
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x06FF), ("arabic", 0x0750, 0x077F), ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF), ("hangul", 0xAC00, 0xD7AF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF),
    ("han", 0x4E00, 0x9FFF),
]
SCRIPT_NAMES = sorted({name for name, _, _ in SCRIPTS}) + ["other"]


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it is a letter; its script's number."""
    letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    script = np.full(0x110000, len(SCRIPT_NAMES) - 1, np.uint8)
    for name, first, last in SCRIPTS:
        script[first:last + 1] = SCRIPT_NAMES.index(name)
    return letters, script


class Words:
    """The words of some texts, all texts at once: for each letter its
    trigram's bucket, for each word its first letter and script, for each
    text its number of words."""

    def __init__(self, texts: list[str]):
        letters, scripts = _tables()
        lowered = [t.lower() for t in texts]
        code = np.frombuffer(("\n" + "\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letters[code]
        at = np.flatnonzero(is_letter)
        near = np.where(is_letter, code, np.uint32(0))
        h = near[at - 1] * np.uint32(0x9E3779B1) + code[at] * np.uint32(0x85EBCA77) + near[at + 1] * np.uint32(0xC2B2AE3D)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        self.bucket = (h >> np.uint32(16)).astype(np.uint16)
        starts = at[~is_letter[at - 1]]
        self.first = np.searchsorted(at, starts)
        self.letters = np.diff(np.append(self.first, len(at)))
        self.script = scripts[code[starts]]
        ends = np.cumsum([len(t) + 1 for t in lowered])
        self.counts = np.diff(np.append(0, np.searchsorted(starts, ends)))  # a text's words start before its end


class Model:
    """Log-likelihood by trigram bucket and language; candidates by script."""

    def __init__(self, langs: list[str], trigrams: np.ndarray, scripts: np.ndarray):
        """trigrams: counts [BUCKETS, lang]; scripts: words [script, lang]."""
        self.langs = langs
        smooth = trigrams + 0.1
        self.log = np.log(smooth / smooth.sum(0)).astype(np.float32)
        candidate = scripts > 0.001 * scripts.sum(0)
        self.mask = np.where(candidate | ~candidate.any(1, keepdims=True), 0, -np.inf).astype(np.float32)

    def word_scores(self, words: Words) -> np.ndarray:
        out = np.empty((len(words.first), len(self.langs)), np.float32)
        step = max(1, (1 << 20) // max(1, len(self.langs)))  # words at a time, to bound memory
        for a in range(0, len(out), step):
            b = min(a + step, len(out))
            low, high = words.first[a], words.first[b] if b < len(out) else len(words.bucket)
            out[a:b] = np.add.reduceat(self.log[words.bucket[low:high]], words.first[a:b] - low, axis=0)
        return out + self.mask[words.script]


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of every word. scores: [word, lang], texts one after
    another; counts: words of each text. All texts advance together, a word a
    step, the longest first so that the running ones are a prefix."""
    order = np.argsort(-counts, kind="stable")
    counts = counts[order]
    offset = (np.cumsum(np.append(0, counts_in := _unsort(counts, order)))[:-1])[order]
    running = np.searchsorted(-counts, -np.arange(counts[0] if len(counts) else 0), side="left")
    n_words = int(counts_in.sum())
    label = np.zeros(n_words, np.int16)
    if not n_words:
        return label
    stay = np.ones(scores.shape, bool)
    best_before = np.zeros(n_words, np.int16)
    value = scores[offset[:running[0]]].astype(np.float64)
    for t in range(1, counts[0]):
        k = running[t]
        rows, v = offset[:k] + t, value[:k]
        top = v.argmax(1)
        other = v[np.arange(k), top] - penalty
        keep = v >= other[:, None]
        stay[rows] = keep
        best_before[rows] = top
        value[:k] = np.where(keep, v, other[:, None]) + scores[rows]
    state = value.argmax(1)
    for t in range(counts[0] - 1, -1, -1):
        k = running[t]
        rows, s = offset[:k] + t, state[:k]
        label[rows] = s
        if t:
            state[:k] = np.where(stay[rows, s], s, best_before[rows])
    return label


def _unsort(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    out = np.empty_like(values)
    out[order] = values
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE, most_languages: int = MOST_LANGUAGES) -> DataFrame:
    """(lang, text) of at most ``per_language`` labelled, not held-out
    documents of each of the ``most_languages`` most frequent languages (ties:
    first by name)."""
    rows = docs.select("doc_id", "text", "lang").where(
        "doc_id is not null and text is not null and lang is not null").where(~held_out(F.col("doc_id")))
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages)  # so it may be broadcast
    # first thin out each language to twice the bound, so that only that much text moves
    hash_ = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    thin = rows.join(F.broadcast(sizes), "lang").where(
        hash_ <= F.least(F.lit(1.0), F.lit(2.0 * per_language) / F.col("count")) * (1 << 30))
    return (thin.withColumn("rank", F.expr("row_number() over (partition by lang order by xxhash64(doc_id), text)"))
            .where(F.col("rank") <= per_language).select("lang", "text"))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, most_languages: int = MOST_LANGUAGES) -> Model:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            langs = batch.column("lang").to_pylist()
            for lang in sorted(set(langs)):
                words = Words([t for t, x in zip(batch.column("text").to_pylist(), langs, strict=True) if x == lang])
                for kind, seen in (("trigram", words.bucket), ("script", words.script)):
                    value, count = np.unique(seen, return_counts=True)  # at most BUCKETS of them
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(value), pa.string()), pa.array([kind] * len(value)),
                         pa.array(value.astype(np.int64)), pa.array(count.astype(np.int64))],
                        names=["lang", "kind", "value", "n"])

    counts = training_sample(docs, per_language, most_languages).mapInArrow(run, "lang string, kind string, value bigint, n bigint")
    rows = counts.groupBy("lang", "kind", "value").agg(F.sum("n").alias("n")).collect()  # at most BUCKETS a language
    langs = sorted({r["lang"] for r in rows})
    number = {lang: i for i, lang in enumerate(langs)}
    trigrams, scripts = np.zeros((BUCKETS, len(langs))), np.zeros((len(SCRIPT_NAMES), len(langs)))
    for r in rows:
        (trigrams if r["kind"] == "trigram" else scripts)[r["value"], number[r["lang"]]] = r["n"]
    return Model(langs, trigrams, scripts)


def label_texts(texts: list[str], model: Model, penalty: float = PENALTY) -> list[tuple[str, float, str]]:
    """(language, score, spans) of each text; spans are lang:first:end in
    words, comma-joined."""
    if not model.langs:
        return [("und", 0.0, "")] * len(texts)
    words = Words(texts)
    label = viterbi(model.word_scores(words), words.counts, penalty)
    out, a = [], 0
    for n in words.counts:
        if not n:
            out.append(("und", 0.0, ""))
            continue
        mine = label[a:a + n]
        letters = np.bincount(mine, weights=words.letters[a:a + n], minlength=len(model.langs))
        best = int(letters.argmax())
        cuts = np.flatnonzero(np.diff(mine)) + 1
        bounds = zip([0, *cuts], [*cuts, n], strict=True)
        out.append((model.langs[best], float(letters[best] / letters.sum()),
                    ",".join(f"{model.langs[mine[i]]}:{i}:{j}" for i, j in bounds)))
        a += n
    return out


def identify(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """``docs`` with __llm_lang: struct of lang, score and spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1 << 16, (2 << 20) // max(1, len(shared.value.langs) // 4))
        for batch in slices(batches, "text", most):
            found = label_texts([t or "" for t in batch.column("text").to_pylist()], shared.value, penalty)
            rows = [dict(zip(("lang", "score", "spans"), x, strict=True)) for x in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=[*names, "__llm_lang"])

    schema = docs.select("*", F.expr("named_struct('lang', '', 'score', 0D, 'spans', '') as __llm_lang")).schema
    return docs.mapInArrow(run, schema)


def predict(docs: DataFrame, per_language: int = PER_LANGUAGE, penalty: float = PENALTY) -> DataFrame:
    """Per document row: doc_id, held_out, lang_pred, score, spans."""
    found = identify(docs.select("doc_id", "text"), train(docs, per_language), penalty)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__llm_lang.lang").alias("lang_pred"),
                        F.col("__llm_lang.score").alias("score"), F.col("__llm_lang.spans").alias("spans"))
