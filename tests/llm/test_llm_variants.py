import random
import re
import zlib
from collections import Counter

import numpy as np
from llm_cases import HARD, make_docs  # noqa: F401
from haulage.llm import variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(u, v):
    """Exactly one inserted, deleted or replaced code point."""
    if len(u) > len(v):
        u, v = v, u
    if u == v or len(v) - len(u) > 1:
        return False
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    return any(v[:i] + v[i + 1:] == u for i in range(len(v)))


def count(rows, drop=variants.DROP):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            k = h % len(run)
            n[run[:k] + run[k + 1:] if h % drop == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def brute(rows, drop=variants.DROP):
    n = count(rows, drop)
    by = {w: [v for v in n if near(w, v)] for w in n}
    best = {w: min(x, key=lambda v: (-n[v], v)) for w, x in by.items() if x}
    form = {w: v for w, v in best.items() if n[v] >= 10 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], len(by[w]), n[form[w]] if w in form else None) for w in n}


def result(df):
    rows = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def corpus(seed, words=60, occurrences=4000):
    """A few stems of repetitive letters, changed by one or two edits, most of
    them often, so that chains of forms arise."""
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abàÿ") for _ in range(rng.choice([7, 8, 9, 12]))) for _ in range(words // 4)]
    pool = list(stems)
    while len(pool) < words:
        w = rng.choice(pool)
        k = rng.randrange(len(w))
        pool.append(rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice("abÀ") + w[k:], w[:k] + rng.choice("abc") + w[k + 1:]]))
    weight = [rng.choice([1, 3, 40, 500, 6000]) for _ in pool]
    picks = rng.choices(pool, weight, k=occurrences)
    picks += ["qqqqqqq"] * 3 + ["qqqqqqr"] * 50 + ["qqqqqrr"] * 900
    rng.shuffle(picks)
    occurrences = len(picks) // 20 * 20
    return [(i, " 1-".join(picks[i * 20:i * 20 + 20]).replace("a", "A" if i % 5 == 0 else "a")) for i in range(occurrences // 20)]


def test_groups_equal_brute_force(make_docs):
    chained = False
    for seed in (1, 2):
        rows = corpus(seed)
        want = brute(rows)
        for matrix_words in (4, 512):  # most blocks are dealt into parts, or none
            assert result(variants.group(make_docs(rows), matrix_words=matrix_words)) == want
        chained |= any(f and r != f for _, f, r, *_ in want)
    assert chained


def test_pairs_of_random_words_equal_brute_force(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("ab") for _ in range(rng.randrange(7, 12))) for _ in range(900)}
    words |= {"z" * n for n in range(7, 40)} | {"q" * 3000, "q" * 3001, "q" * 1500 + "r" + "q" * 1500,
              "p" * 30_000, "p" * 30_001, "p" * 15_000 + "r" + "p" * 15_000, "p" * 15_000 + "rr" + "p" * 15_000}
    df = spark.createDataFrame([(w, 5 + i % 3) for i, w in enumerate(sorted(words))], "word string, n bigint")
    for matrix_words in (16, 512):
        got = {r["word"]: r["n_near"] for r in variants.forms(df, matrix_words).collect()}
        assert got == {w: sum(near(w, v) for v in words) for w in words}


def test_words_and_deleted_letters(make_docs):
    rows = [(i, "Straßenbahn ÉCOLES×÷ école ecoles' abcdefgh_abcdefgh Āabcdefg") for i in range(200)]
    for drop in (variants.DROP, 2):
        got = {r["word"]: r["n"] for r in variants.words(make_docs(rows), drop).collect()}
        assert got == count(rows, drop) and len(got) > 3


def test_hard_rows(make_docs):
    rows = [*HARD, (11, "abcdefghij " * 300), (12, "y" * 40_000), (None, "y" * 40_000), (13, "ABCDEFGHIJ"), (13, "ABCDEFGHIJ")]
    assert result(variants.group(make_docs(rows))) == brute(rows)
    assert variants.group(make_docs([])).collect() == []
    assert variants.group(make_docs([(1, None), (2, "short words only")])).collect() == []


def test_letter_counts():
    left, right, size = variants._letters(["abba", "ÿa"])
    assert size.tolist() == [4, 2] and variants.letter_counts(left).tolist() == [[2, 2, 0], [1, 0, 1]]
    assert right[0].tolist() == left[0].tolist() and np.array_equal(right[1, :2], left[1, 1::-1])
