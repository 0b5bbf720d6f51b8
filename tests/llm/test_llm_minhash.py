import random
import re

import numpy as np
from llm_cases import HARD, make_docs, rows_of  # noqa: F401
from haulage.llm import minhash
from haulage.llm.common import Bloom, WordHashes, read_table


def brute(rows, size=2):
    """Components by comparing all pairs of sets."""
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}

    nodes = sorted({i for i, _ in rows if i is not None})
    up = {i: i for i in nodes}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    for k, (i, s) in enumerate(sets):
        for j, t in sets[:k]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i in nodes}, [(i, len(shingles(t))) for i, t in rows]


def edited(words, rng, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


def corpus(seed=3):
    """Groups of near copies, chains whose ends are not alike, small sets."""
    rng = random.Random(seed)
    rows = []
    for group in range(25):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([5, 6, 12, 40, 150, 400]))]
        for _ in range(rng.choice([1, 2, 6, 12])):
            words = edited(words, rng, max(0, len(words) * rng.choice([0, 2, 4, 6]) // 100)) if rng.random() < 0.8 else words
            rows.append(" ".join(words))
    base = [f"hot{i}" for i in range(120)]
    rows += [" ".join(edited(base, rng, rng.randrange(0, 12))) for _ in range(60)]
    ids = rng.sample(range(10_000), len(rows))
    return list(zip(ids, rows, strict=True))


def test_components_equal_brute_force(make_docs):
    rows = corpus()
    component, sizes = brute(rows)
    out = minhash.decide(make_docs(rows)).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == component
    assert sorted((r["doc_id"], r["n_shingles"]) for r in out) == sorted(sizes)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)
    assert len(set(component.values())) < len(rows)


def test_similarity_at_the_threshold(make_docs):
    # 8 of 10 shingles in common is a link, 7 of 9 isn't
    a = "a b c d e f g h i j"
    rows = [(1, a), (2, a + " k"), (3, "x1 x2 x3 x4 x5 x6 x7 x8 x9"), (4, "x1 x2 x3 x4 x5 x6 x7 x8 y9"), (5, "x1 x2 x3 x4 x5 x6 x7 y8 y9")]
    component, _ = brute(rows)
    assert {r["doc_id"]: r["component_id"] for r in minhash.decide(make_docs(rows)).collect()} == component


def test_hard_rows(make_docs):
    out = rows_of(minhash.decide(make_docs(HARD)), "doc_id", "n_shingles", "component_id", "kept")
    component, sizes = brute(HARD)
    assert out == sorted(((i, n, component.get(i), True) for i, n in sizes), key=repr)
    assert minhash.decide(make_docs([])).count() == 0


def test_dedup_keeps_one_of_each_group_and_all_columns(make_docs):
    rows = corpus(5) + [(20_000, None), (20_001, ""), (20_001, "")]
    docs = make_docs(rows)
    component, _ = brute(rows)
    out = minhash.dedup(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted({i for i in component if component[i] == i})


def test_rows_of_one_doc_id_are_one_document(make_docs):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (2, a), (2, b), (3, b), (4, "else where")]
    assert {r["doc_id"]: r["component_id"] for r in minhash.decide(make_docs(rows)).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_densified_signatures_agree_as_often_as_sets(spark):
    hashes, rng = WordHashes(), random.Random(1)
    for n in (5, 20, 200, 2000):
        agree, truth = [], []
        for _ in range(30):
            base = [b"%d" % rng.randrange(10**9) for _ in range(n)]
            other = base[:n - n // 5] + [b"%d" % rng.randrange(10**9) for _ in range(n // 5)]
            x, y = (np.unique(hashes.of(s)) for s in (base, other))
            agree.append(np.mean(minhash.signature(x) == minhash.signature(y)))
            truth.append(len(np.intersect1d(x, y)) / len(np.union1d(x, y)))
        assert abs(np.mean(agree) - np.mean(truth)) < 0.05


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a long, b long")
    out = {r["node"]: r["component"] for r in minhash.components(links).collect()}
    assert out == {i: 0 for i in range(1, 201)} | {1001: 1000}


def test_families_of_short_documents_equal_brute_force(make_docs):
    rng, rows = random.Random(11), []
    for family in range(60):
        base = [f"f{family}w{i}" for i in range(rng.randrange(5, 16))]
        for _ in range(25):
            words = list(base)
            for _ in range(rng.randrange(3)):
                if rng.random() < 0.5:
                    words = words[1:] if rng.random() < 0.5 else words[:-1]
                else:
                    words = words + [f"x{rng.randrange(4)}"]
            rows.append(" ".join(words))
    ids = rng.sample(range(10**6), len(rows))
    rows = list(zip(ids, rows, strict=True))
    component, _ = brute(rows)
    assert {r["doc_id"]: r["component_id"] for r in minhash.decide(make_docs(rows)).collect()} == component


def test_open_buckets_lose_no_link_of_small_sets(spark):
    # pairs of 4 of 5 shingles, each in a bucket of its own, in different components
    rows = [(2 * i + k, " ".join(f"p{i}w{j}" for j in range(6 - k))) for i in range(500) for k in (0, 1)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    members = spark.createDataFrame([(i // 2, i, 5 - i % 2, i, 1) for i, _ in rows],
                                    "key long, node long, n long, component long, blocks int")
    assert minhash.open_links(members, texts).count() == 500


def test_bands_of_tiny_sets_meet(spark):
    rng = np.random.default_rng(7)
    lost = 0
    for _ in range(4000):
        x = np.sort(rng.integers(0, 2**64, 5, dtype=np.uint64, endpoint=False))
        y = np.delete(x, rng.integers(5))
        lost += not (minhash.bands(minhash.signature(x)) == minhash.bands(minhash.signature(y))).any()
    assert lost <= 1


def test_five_word_links_of_a_whole_table_equal_brute_force(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    component, sizes = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], 5)
    out = minhash.decide(docs, shingle=5).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == component
    assert sorted((r["doc_id"], r["n_shingles"]) for r in out) == sorted(sizes)
    assert len(set(component.values())) < len(component)


def test_bloom_filter_holds_all_its_keys(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *range(5, 4000, 7)]
    df = spark.createDataFrame([(k,) for k in [*keys, None]], "k long")
    bloom = Bloom(df)
    assert bloom.may_hold(np.array(keys)).all()
    assert bloom.may_hold(np.arange(10**6, 10**6 + 100_000)).mean() < 0.001
    kept = bloom.cut(spark.range(-5, 4000).selectExpr("id as k", "'x' as other"), "k").collect()
    assert {0, 1, -1, *range(5, 4000, 7)} <= {r["k"] for r in kept} and len(kept) < 700
    assert Bloom(df.limit(0)).cut(df, "k").count() == 0


def test_texts_are_not_shuffled_to_drop_a_few(make_docs):
    text = " ".join(f"w{i}" for i in range(40))
    out = minhash.dedup(make_docs([(1, text), (2, text), (3, "other words")]))
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan and "SortMergeJoin" not in plan
    assert {r["doc_id"] for r in out.collect()} == {1, 3}
