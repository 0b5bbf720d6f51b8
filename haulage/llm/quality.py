"""Quality rules by weak supervision.

Rules look at counts of a document and vote good (+), bad (-) or abstain (0).
Bad documents come in kinds, and most break few rules: there is one class of
good documents and one bad class for each rule, which starts from the belief
that its rule mostly votes bad there. Expectation-maximisation estimates,
without labels, how often each rule votes good in each class (its accuracies)
and how common the classes are; a document's verdict is the posterior
probability that it is good, given its votes and those accuracies.

The estimate needs only how many documents cast each vote pattern. With R
rules there are at most 3**R patterns, whatever the number of documents, so
the counts are one small aggregation over all documents and the fixpoint runs
on that bounded table.

Defined results: a null or empty text has zero words and fails the base rule;
a repeated row gets a row of its own (and counts in the estimate as often as
it occurs); a posterior equal to the bound (a tie) keeps the document; very long
texts are read whole, one at a time; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulage.llm.common import WordHashes, mix64, shared_write, slices, utf8_list

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\v\f\r"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct",
          "n_upper", "n_lower", "n_exclaims", "n_ends"]

#: The rules in order: (name, SQL for the measure, bad from, good up to); a
#: null measure abstains, as does one between the two limits. A rule with bad
#: below its good limit reads downwards.
RULES = [
    ("symbols", "n_symbols / word_chars", 0.03, 0.002),
    ("capitals", "n_upper / if(n_upper + n_lower > 0, n_upper + n_lower, null)", 0.5, 0.2),
    ("exclaims", "n_exclaims / n_words", 0.3, 0.05),
    ("repeated_lines", "if(n_lines > 1, n_dup_lines / n_lines, null)", 0.34, 0.05),
    ("repeated_windows", "n_repeat_words / n_words", 0.3, 0.02),
    ("vocabulary", "if(n_words >= 30, n_distinct / n_words, null)", 0.3, 0.45),
    ("sentence_ends", "if(n_words >= 30, n_ends / n_words, null)", 0.01, 0.04),
    ("word_length", "abs(ln(word_chars / n_words / 5))", 0.8, 0.3),
]
#: Posterior probability from which a document is kept.
THRESHOLD = 0.5


def counts_of(text: bytes, chars: int, hashes: WordHashes) -> list[int]:
    """COUNTS of one whole text given as UTF-8; chars: its code points."""
    words = text.split()  # ASCII white space, as bytes.split() takes it
    n = len(words)
    if not n:
        return [0] * len(COUNTS)
    h = hashes.of(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    array = np.frombuffer(text, np.uint8)
    by_byte = np.bincount(array, minlength=256)
    spaces = int(by_byte[list(_SPACES)].sum())
    ends = sum(map(text.count, (b". ", b".\n", b"? ", b"?\n", b"! ", b"!\n"))) + text.rstrip().endswith((b".", b"?", b"!"))
    return [n, chars - spaces, int(by_byte[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), repeated(h), len(lines),
            len(np.unique(h)), int(by_byte[65:91].sum()), int(by_byte[97:123].sum()), int(by_byte[33]), ends]


def repeated(h: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows whose word sequence occurs twice or more."""
    n = len(h) - window + 1
    if n < 2:
        return 0
    key = np.zeros(n, np.uint64)
    for j in range(window):
        key = mix64(key + h[j:j + n] + np.uint64(j + 1))
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[inverse] > 1)
    if not len(starts):
        return 0
    edges = np.zeros(len(h) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, "text"):
            chars = pc.utf8_length(batch.column("text")).to_pylist()
            rows = np.array([counts_of(t or b"", c or 0, hashes)
                             for t, c in zip(utf8_list(batch.column("text")), chars, strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(rows[:, i]) for i in range(len(COUNTS)))],
                names=["doc_id", *COUNTS])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS))


def vote_column():
    """The votes as one string, a character a rule: + good, - bad, 0 abstain."""
    votes = []
    for _, sql, bad, good in RULES:
        x = F.when(F.col("n_words") > 0, F.expr(sql))
        is_bad, is_good = (x >= bad, x <= good) if bad > good else (x <= bad, x >= good)
        votes.append(F.when(is_bad, "-").when(is_good, "+").otherwise("0"))
    return F.concat(*votes)


def estimate(patterns: dict[str, int], rounds: int = 200) -> tuple[dict[str, float], np.ndarray, np.ndarray]:
    """EM over vote patterns: (posterior of good by pattern, P(+ | class) as
    [rule, class], share of each class); class 0 is good, class k + 1 the bad
    one of rule k. Abstentions say nothing.
    """
    names, rules = sorted(patterns), len(RULES)
    weight = np.array([patterns[p] for p in names], float)
    votes = np.array([[{"+": 1.0, "-": 0.0, "0": np.nan}[v] for v in p] for p in names]).reshape(len(names), rules)
    cast = ~np.isnan(votes)
    plus, minus = np.where(cast, votes, 0.0), np.where(cast, 1 - votes, 0.0)
    start = np.full((rules, rules + 1), 0.95)
    start[:, 0] = 0.995
    np.fill_diagonal(start[:, 1:], 0.1)
    accuracy, share = start, np.array([0.8] + [0.2 / rules] * rules)
    posterior = np.zeros((len(names), rules + 1))
    for _ in range(rounds):
        log = plus @ np.log(accuracy) + minus @ np.log1p(-accuracy) + np.log(share)
        new = np.exp(log - log.max(1, keepdims=True, initial=-np.inf))
        new /= new.sum(1, keepdims=True)
        mass = weight[:, None] * new
        share = (mass.sum(0) + 1e-3) / (mass.sum() + 1e-3 * (rules + 1))
        # one document's weight of the starting belief smooths each accuracy
        accuracy = (plus.T @ mass + start) / (cast.T @ mass + 1)
        if np.abs(new - posterior).max(initial=0) < 1e-9:
            break
        posterior = new
    return dict(zip(names, map(float, new[:, 0]), strict=True)), accuracy, share


def judge(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document row: doc_id, the counts, votes, quality (posterior
    probability of good), base_failed, kept."""
    rows = shared_write(measure(docs).withColumn("votes", vote_column()), "quality")
    patterns = {r["votes"]: r["count"] for r in rows.groupBy("votes").count().collect()}  # at most 3**len(RULES)
    posterior, _, _ = estimate(patterns)
    table = docs.sparkSession.createDataFrame(list(posterior.items()), "votes string, quality double")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rows.join(F.broadcast(table), "votes").select(
        "doc_id", *COUNTS, "votes", "quality", failed.alias("base_failed"),
        (~failed & (F.col("quality") >= threshold)).alias("kept"))
