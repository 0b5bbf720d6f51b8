import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from llm_cases import HARD, make_docs, rows_of  # noqa: F401
from haulage.llm import packing
from haulage.llm.common import read_table
from haulage.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


ODD = ["", "Don't WE'LL 'sup ''s it's", "a b c d", "ΣΑΣ ὈΔΥΣΣΕΎΣ", "İstanbul K Å ﬁ ½ ²x x²", "éá ñ", "日本語 テキスト 한국어",
       "x1y2  z3\t\n 44", "…—“quoted”.!? -- ''", "<|endoftext|> and <|startoftext|>x", "İ.İ x! ŉ. ΐ-", "naïve café-crème l'été", "\x1c a\x85b \x0b c",
       "🙂🙃 text🙂", "ABCdef123.456e-7", "पत्र हिन्दी", "a" * 300, "ǅ ǆ ß ẞ ſ"]


def test_encoder_equals_the_tokenizer(plain, spark):
    texts = ODD + [r["text"] for r in read_table(spark, SF, "documents").limit(150).collect()]
    for most in (500_000, 50):  # a tiny memory is emptied again and again
        encoder = packing.Encoder(tokenizer_path(), most)
        for a in range(0, len(texts), 20):
            part = texts[a:a + 20]
            for text, ids in zip(part, encoder.encode_all([t.encode() for t in part]), strict=True):
                assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_other_files_encode_whole_texts():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    plain, encoder = Tokenizer.from_file(path), packing.Encoder(path)
    assert encoder.whole_texts and not packing.Encoder(tokenizer_path()).whole_texts
    for text, ids in zip(ODD, encoder.encode_all([t.encode() for t in ODD]), strict=True):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, text
    assert encoder.encode_all([]) == []


def test_words_of_any_case_and_mark_are_looked_up_once(plain):
    words = ["caf\u00e9", "word", "stra\u00dfe", "\u0441\u043b\u043e\u0432\u043e"]
    text = " ".join(a + w + b for w in words for a in ("", "(", "x2") for b in ("", ".", "?!", "7")) + " WORD"
    encoder = packing.Encoder(tokenizer_path())
    assert encoder.encode_all([text.encode()])[0].tolist() == plain.encode(text, add_special_tokens=False).ids
    assert {k.decode() for k in encoder.parts} == {*words, "x", "2", "7", "(", ".", "?!"} and not encoder.chunks


def test_characters_of_all_kinds_mixed(plain):
    rng, pool = random.Random(5), [*"aZsT'\u2019.,?-<|9 \t\n\x0b\x00\x1c\x85\xa0\xd7\xe9\xc9\xdf\xaa\xb2", *"".join(ODD)]
    texts = ["".join(rng.choices(rng.sample(pool, rng.randrange(2, 14)), k=rng.randrange(40))) for _ in range(4000)]
    texts += [x for c in range(1, 0x800) for x in (chr(c), f"a{chr(c)}b", f"{chr(c)}{chr(c)}\u03a3 ")]
    for encoder in (packing.Encoder(tokenizer_path()), packing.Encoder(tokenizer_path(), 9)):
        for a in range(0, len(texts), 500):
            part = texts[a:a + 500]
            for text, ids in zip(part, encoder.encode_all([t.encode() for t in part]), strict=True):
                assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, text


def check(rows, ids_of, capacity):
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(docs) == set(ids_of)
    for doc_id, pieces in docs.items():
        at, ids = 0, ids_of[doc_id]
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at:at + r["length"]], "<u4").tobytes())
            if "ids" in r:
                assert r["ids"] == ids[at:at + r["length"]]
            at += r["length"]
        assert at == len(ids)
    used = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
        used += at
    return 1 - used / (capacity * len(sequences))


def test_query_packs_every_id_once(plain, spark):
    docs = read_table(spark, SF, "documents")
    ids_of = {r["doc_id"]: plain.encode(r["text"] or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    rows = [r.asDict() for r in packing.pack(docs.repartition(5), tokenizer_path(), with_ids=True).collect()]
    assert check(rows, ids_of, packing.CAPACITY) < 0.01


def test_small_capacity_and_hard_rows(plain, make_docs):
    rows = [(i, t) for i, (_, t) in enumerate(HARD)] + [(100 + i, "word " * (i % 7)) for i in range(200)]
    ids_of = {i: plain.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows}
    out = [r.asDict() for r in packing.pack(make_docs(rows), tokenizer_path(), capacity=16).collect()]
    check(out, ids_of, 16)
    assert packing.pack(make_docs([]), tokenizer_path()).count() == 0
    twice = packing.pack(make_docs([(1, "a b"), (1, "a b")]), tokenizer_path()).collect()
    assert len(twice) == 2 and len({(r["sequence_id"], r["offset"]) for r in twice}) == 2


def brute_fill(counts, capacity):
    best = {0}
    first = max(counts)
    for length, n in counts.items():
        for _ in range(n - (length == first)):
            best |= {s + length for s in best if s + length <= capacity - first}
    return first + max(best)


def test_fill_is_the_closest_to_capacity():
    rng = random.Random(2)
    for _ in range(300):
        counts = {rng.randrange(1, 60): rng.randrange(1, 5) for _ in range(rng.randrange(1, 8))}
        fill = packing.best_fill(counts, 60)
        assert all(0 < k <= counts[length] for length, k in fill.items()) and max(counts) in fill
        assert sum(length * k for length, k in fill.items()) == brute_fill(counts, 60)


def test_plan_uses_every_piece_once_whatever_their_number():
    rng = random.Random(3)
    counts = {rng.randrange(1, 2049): rng.randrange(1, 10**9) for _ in range(900)} | {2048: 10**12}
    entries = packing.plan(counts)
    used = defaultdict(int)
    for length, first, k, _, times, _ in entries:
        assert first == used[length]
        used[length] += k * times
    assert used == counts and len(entries) < 50_000


def test_memory_bounds_change_no_result(spark):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    want = rows_of(packing.pack(docs, tokenizer_path()), *names)
    assert rows_of(packing.pack(docs, tokenizer_path(), remembered=7, slice_bytes=3000), *names) == want
