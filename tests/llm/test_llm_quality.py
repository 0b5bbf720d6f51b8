import re
from collections import Counter

from llm_cases import HARD, make_docs, rows_of  # noqa: F401
from haulage.llm import quality
from haulage.llm.common import read_table

SF = "/root/testdata/sf0.01"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    many = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if many[w] > 1 for j in range(8)}
    n, repeat = len(words), len(covered)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")) if n else 0, dup, repeat,
            n < 20 or 100 * repeat > 30 * n)


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_counts_equal_brute_force(spark):
    docs = read_table(spark, SF, "documents")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = quality.judge(docs).collect()
    assert len(out) == len(text)
    for r in out:
        assert tuple(r[c] for c in BASE) == brute(text[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])


def test_verdicts_agree_with_labels_never_seen(spark):
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    rows = quality.judge(docs).join(labels, "doc_id").where("not base_failed").collect()
    assert sum(r["kept"] == (r["quality"] >= 0.5) for r in rows) == len(rows)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    right = [r["kept"] == (truth[r["doc_id"]] == 1) for r in rows]
    assert sum(right) >= 0.97 * len(right)


def test_symbols_of_a_text_without_words(make_docs):
    out = {r["doc_id"]: tuple(r[c] for c in BASE) for r in quality.judge(make_docs(HARD)).collect() if r["doc_id"]}
    assert out == {i: brute(t) for i, t in HARD if i}
    assert quality.judge(make_docs([])).count() == 0


def test_estimate_learns_which_rules_are_right():
    n = len(quality.RULES)
    good, noisy = "+" * n, "+" * (n - 1) + "-"
    patterns = {good: 8000, noisy: 500, "-" + "+" * (n - 1): 700, "--" + "+" * (n - 2): 900, "0" * n: 50}
    posterior, accuracy, share = quality.estimate(patterns)
    assert posterior[good] > 0.95 > 0.05 > posterior["--" + "+" * (n - 2)]
    assert (accuracy[:2, 0] > 0.95).all() and accuracy[0, 1] < 0.5 and 0.7 < share[0] < 0.99
    assert quality.estimate({})[0] == {}
