import hashlib
import random

import numpy as np
from llm_cases import HARD, make_docs  # noqa: F401
from haulage.llm import fingerprints as fp
from haulage.llm.common import mix64, read_table

SF = "/root/testdata/sf0.01"


def phrases(text, level):
    """(name, first code point, end) of a text's phrases, name by name."""
    one = lambda x: int(mix64(np.array([x], np.uint64))[0])
    wrap = lambda x: x & (2**64 - 1)
    names = [(ord(c) + 1, i, i + 1) for i, c in enumerate(text)]
    for k in range(1, level + 1):
        runs = []
        for name, a, b in names:
            if runs and runs[-1][0] == name:
                runs[-1][2], runs[-1][3] = b, runs[-1][3] + 1
            else:
                runs.append([name, a, b, 1])
        items = [(one(wrap(x + n * int(fp._ODD))) if n > 1 else x, a, b) for x, a, b, n in runs]
        label = [x for x, _, _ in items]
        for _ in range(fp.ROUNDS):
            new = []
            for i, x in enumerate(label):
                differ = x ^ label[i - 1] if i else 1
                place = (differ & -differ).bit_length() - 1
                new.append(2 * place + (x >> place & 1))
            label = new
        assert all(x != y and x < 6 for x, y in zip(label, label[1:]))
        start = [i for i in range(len(items)) if i == 0 or (i + 1 < len(items) and label[i] > label[i - 1] and label[i] > label[i + 1])]
        names = []
        for s, e in zip(start, [*start[1:], len(items)]):
            spread = [wrap((items[i][0] + (i - s + k) * int(fp._ODD)) * int(fp._FACTOR)) for i in range(s, e)]
            names.append((one(wrap(sum(x ^ x >> 32 for x in spread) + k)), items[s][1], items[e - 1][2]))
            assert e - s <= 13
    return names


def sample(rng, n):
    return "".join(rng.choice("abcdefghij é\n") for _ in range(n))


def test_levels_equal_the_plain_parse_of_each_text():
    rng = random.Random(1)
    texts = [sample(rng, n) for n in (1, 2, 3, 7, 0, 50, 400, 1000)] + ["a" * 90 + "b" * 3, "\U0001F600ab" * 40]
    names = np.array([ord(c) + 1 for c in "".join(texts)], np.uint64)
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    for level in (1, 2, 3):
        names, text, _ = fp.next_level(names, text, level)
        for i, t in enumerate(texts):
            assert names[text == i].tolist() == [x for x, _, _ in phrases(t, level)]


def test_equal_substrings_share_their_interior_phrases():
    rng = random.Random(2)
    for _ in range(25):
        passage = sample(rng, rng.randrange(300, 900))
        for level in (1, 2, 3):
            inside = []
            for _ in range(2):
                before, after = sample(rng, rng.randrange(0, 60)), sample(rng, rng.randrange(0, 60))
                a, b = len(before), len(before) + len(passage)
                found = phrases(before + passage + after, level)
                inside.append({(x, s - a) for x, s, e in found if s >= a and e <= b})
            spots = sorted(s for _, s in inside[0])
            m = fp.margin(level)
            if len(spots) > 2 * m:
                core = [{x for x in found if spots[m] <= x[1] <= spots[-m - 1]} for found in inside]
                assert core[0] == core[1] and core[0], level


def test_likeness_follows_the_share_of_common_text():
    rng = random.Random(3)
    texts = [sample(rng, 3000) for _ in range(200)]
    a = fp.sketches(texts)
    for share, low, high in ((0, 0, 0.1), (1 / 3, 0.2, 0.5), (2 / 3, 0.52, 0.8), (1, 1, 1)):
        mixed = [t[:int(len(t) * share)] + sample(rng, len(t) - int(len(t) * share)) for t in texts]
        found = fp.likeness(a, fp.sketches(mixed))
        assert low <= found.mean() <= high, (share, found.mean())
    shifted = fp.likeness(a, fp.sketches(["xyz" + t for t in texts]))
    assert shifted.mean() > 0.9 and np.array_equal(fp.read(fp.written(a)), a)


def brute(rows, order=None):
    """The digests of ``compare``, by one sorted list."""
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), order(r) if order else 0))
    out = []
    for i, (doc_id, text) in enumerate(rows):
        t, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(t) // 3
        new = t[:len(t) - k] + following[:k]
        a, b, c = fp.fingerprints([t, new, following])
        like = [float(fp.likeness(*(fp.read([x]) for x in pair))[0]) for pair in ((a, b), (a, c))]
        out.append((doc_id, len(t), hashlib.sha256(new.encode()).hexdigest(), a, b, *like))
    return out


def test_whole_table_equals_brute_force(spark):
    docs = read_table(spark, SF, "documents")
    rows = [tuple(r) for r in fp.compare(docs.select("*", docs.n_chars.alias("part"))).collect()]
    assert sorted(rows) == sorted(brute([tuple(r) for r in docs.select("doc_id", "text").collect()]))
    near = [(r[5], r[6]) for r in rows if r[1] > 300]
    assert sum(a > b for a, b in near) > 0.97 * len(near)


def test_hard_rows_and_ranges(make_docs, spark):
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "2", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            got = fp.compare(make_docs(HARD)).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", parts)
        assert sorted(map(tuple, got), key=repr) == sorted(brute(HARD), key=repr)
    assert fp.compare(make_docs([])).collect() == []
    one = fp.compare(make_docs([(3, "abcdef")])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and one["near_next"] == 1
    empty = fp.compare(make_docs([(1, None), (2, ""), (3, "text")])).collect()
    assert {r["doc_id"]: (r["fingerprint"] == "", r["near_next"]) for r in empty} == {3: (False, 0), 2: (True, 1), 1: (True, 0)}


def test_equal_texts_have_equal_fingerprints(make_docs):
    rows = fp.fingerprint(make_docs([(1, "same text here"), (2, "same text here"), (3, None)])).collect()
    by = {r["doc_id"]: r["__fingerprint"] for r in rows}
    assert by[1] == by[2] != by[3] == "" and rows[0]["n_words"] == "x"
