import hashlib
import random
import re

from llm_cases import HARD, make_docs, rows_of  # noqa: F401
from haulage.llm import decontaminate


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            p = words(t)
            m = min(10, len(p))
            for j in range(len(p) - m + 1 if m else 0):
                for i in range(len(w) - m + 1):
                    if w[i:i + m] == p[j:j + m]:
                        hit |= set(range(i, i + m))
                        found.add("" if item is None else str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def corpus(rng):
    vocabulary = [f"w{i}" for i in range(30)] + ["Ünï", "ß1", "X", "of"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 9, 10, 11, 25])))) for i in range(40)]
    items = [x for x in items if len(x[1].split()) != 1] + [(90, "onlyone"), (91, ""), (92, None), (None, "w1 no id w2 w3")]
    docs = []
    for i in range(60):
        w = rng.choices(vocabulary, k=rng.randrange(0, 120))
        for _ in range(rng.randrange(3)):
            t = (rng.choice(items)[1] or "").split()
            at = rng.randrange(len(w) + 1)
            w[at:at] = t[rng.randrange(len(t) or 1):]
        docs.append((i, rng.choice([" ", "\n", "-", ", "]).join(w).replace("w1 ", "W1 ")))
    return docs, items


def test_scan_equals_brute_force(spark, make_docs):
    docs, items = corpus(random.Random(4))
    want = brute(docs, items)
    assert sum(r[5] for r in want) > 10
    assert rows_of(decontaminate.scan(make_docs(docs), table(spark, items)), *COLUMNS) == want


def test_blocks_of_the_benchmark_give_the_same(spark, make_docs):
    docs, items = corpus(random.Random(5))
    got = decontaminate.scan(make_docs(docs), table(spark, items + items[:7]), block_bytes=800)
    assert rows_of(got, *COLUMNS) == brute(docs, items)


def test_hard_rows(spark, make_docs):
    items = [(1, "word " * 15), (2, "no id but words enough"), (3, "ß")]
    assert rows_of(decontaminate.scan(make_docs(HARD), table(spark, items)), *COLUMNS) == brute(HARD, items)
    assert decontaminate.scan(make_docs([]), table(spark, items)).count() == 0
    assert rows_of(decontaminate.scan(make_docs(HARD), table(spark, [])), "contaminated") == [(False,)] * len(HARD)


def test_clean_keeps_clean_rows_whole(spark, make_docs):
    passage = " ".join(f"p{i}" for i in range(14))
    docs = make_docs([(1, f"before {passage} after"), (2, "clean"), (3, None), (4, passage.upper()[:20])])
    out = decontaminate.clean(docs, table(spark, [(1, passage)]))
    assert out.columns == docs.columns and rows_of(out, "doc_id", "text") == rows_of(docs.where("doc_id > 1"), "doc_id", "text")


def test_shift_tables_skip_positions():
    m = decontaminate.Matcher(10)
    m.add(tuple(b"p%d" % i for i in range(10)), "1")
    looked = []
    m.shift = type("Counted", (dict,), {"get": lambda s, k, d: looked.append(k) or dict.get(s, k, d)})(m.shift)
    assert list(m.search([b"w%d" % i for i in range(900)])) == []
    assert len(looked) <= 100
