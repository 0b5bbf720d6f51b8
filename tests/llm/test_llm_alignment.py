import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from llm_cases import HARD, make_docs  # noqa: F401
from haulage.llm import alignment as al
from haulage.llm.common import read_table
from haulage.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.01"
A_PATH, B_PATH = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def plain():
    """(A's id and bytes, B's id and bytes) of a whole text, token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    byte = {chr(x if x in plain else next(others)): x for x in range(256)}

    def tokens(text):
        e = a.encode(" " + text, add_special_tokens=False)
        left = [(i, bytes(byte[c] for c in t)) for i, t in zip(e.ids, e.tokens)]
        right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())
                 for i in b.encode(text)]
        return left, right
    return tokens


def brute(rows, tokens):
    """Byte by byte: no offsets, spans, chunks or slices."""
    docs, count = [], Counter()
    for doc_id, text in rows:
        a, b = tokens(text) if text else ([], [])
        raw = (" " + (text or "")).encode()
        if not text or any(b"".join(t for _, t in x) != raw for x in (a, b)):
            docs.append((doc_id, 0, 0, 0, [], ""))
            continue
        owner = [[k for k, (_, t) in enumerate(x) for _ in t] for x in (a, b)]
        links = [(a[i][0], b[j][0]) for i, j in sorted(set(zip(*owner)))]
        ends = [set(np.cumsum([len(t) for _, t in x]).tolist()) for x in (a, b)]
        groups, at = [], 0
        for cut in sorted(ends[0] & ends[1]):
            groups.append("|".join(",".join(str(x[k][0]) for k in sorted(set(o[at:cut]))) for x, o in zip((a, b), owner)))
            at = cut
        count.update(links)
        docs.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    highest = {}
    for (_, j), n in count.items():
        highest[j] = max(n, highest.get(j, 0))
    return sorted(((i, n_a, n_b, g, len(k), sum(count[p] == highest[p[1]] for p in k), sum(count[p] for p in k), sha)
                   for i, n_a, n_b, g, k, sha in docs), key=repr)


ODD = ["", " ", "\n", "  a  b ", "a\n\nb\n", "\nstart", "tab\tand\r\nline \r\n next", "café naïve", "\U0001F600\U0001F601 x\U0001F9D1‍\U0001F680",
       "<s> </s> <|endoftext|><unk> <0x0A>", "a▁b", "▁", " ▁ x", "ﬁ é 　 x　 y", "nb  nb   thin  x", "x\x85 y\x1c z\x0b w",
       "日本語のテキスト 한국어 텍스트 हिन्दी", "word" * 200, "don't we'll ''s 'tis", "1234567890 12 3.14e-5", "\x00 \x01a", "﻿bom ﻿ x", "é ́ x",
       "tail   \n", "((){};\r\n}\r", "𐍈𐌰 x", "a \n b\n \nc", "x   ", "<0x41>"]


def result(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_odd_texts_equal_brute_force(make_docs, plain):
    rng = random.Random(4)
    marks = ["a", "the", " ", "  ", "\n", "\t", "é", " ", "　", "▁", "😀", "<s>", "{", "\r", "'s", "\x1c", "."]
    often = [1 if m == "▁" else 25 for m in marks]
    texts = ODD + ["".join(rng.choices(marks, often, k=rng.randrange(1, 40))) for _ in range(300)]
    rows = [(i // 2, t) for i, t in enumerate(texts)]
    want = brute(rows, plain)
    for slice_bytes in (40, 8 << 20):
        assert result(al.align(make_docs(rows), A_PATH, B_PATH, slice_bytes)) == want
    assert sum(r[1] == 0 for r in want) < len(rows) // 2


def test_whole_table_equals_brute_force(spark, plain):
    docs = read_table(spark, SF, "documents")
    found = result(al.align(docs.select("*", docs.lang.alias("pairs"), docs.lang.alias("slice")), A_PATH, B_PATH))
    assert found == brute([tuple(r) for r in docs.select("doc_id", "text").collect()], plain)


def test_hard_rows(make_docs, plain):
    assert result(al.align(make_docs(HARD), A_PATH, B_PATH)) == brute(HARD, plain)
    assert al.align(make_docs([]), A_PATH, B_PATH).collect() == []
    empty = [(1, None), (2, ""), (2, "")]
    assert result(al.align(make_docs(empty), A_PATH, B_PATH)) == brute(empty, plain)


def test_memory_is_bounded_and_whole_texts_give_the_same(spark):
    texts = [r["text"].encode() for r in read_table(spark, SF, "documents").limit(40).collect()]

    def facts(aligner):
        out = []
        for t in texts:
            chunks, n = al.chunks_of([t], aligner.by_chunk)
            code = aligner.numbers_of(chunks)
            assert n.sum() == len(code) and len(aligner.numbers) <= max(aligner.most, len(set(code.tolist())))
            links = np.concatenate([aligner.links[aligner.start[c]:aligner.start[c + 1]] for c in code])
            out.append((aligner.facts[code].sum(0).tolist(), links.tolist(), b";".join(aligner.groups[c] for c in code)))
        return out

    usual, small, whole = (al.Aligner(A_PATH, B_PATH, most) for most in (500_000, 50, 500_000))
    whole.by_chunk = False
    assert facts(usual) == facts(small) == facts(whole)


def test_pair_table_counts_all_links(make_docs, plain):
    rows = [(i, "the same words and other words") for i in range(9)]
    found = al.aligned(make_docs(rows), A_PATH, B_PATH, 64)
    table = {r["pair"]: r["count"] for r in al.pair_counts(found).collect()}
    per = brute(rows[:1], plain)[0][4]
    assert sum(table.values()) == 9 * per


def test_ends_where_spans_and_bytes_differ():
    # é split over two tokens whose spans are both the whole character
    assert al.token_ends(np.array([0, 1, 1, 3]), np.array([1, 3, 3, 4]), np.array([1, 1, 1, 1]), 4).tolist() == [1, 2, 3, 4]
    doc, place, links = np.array([0, 0, 2, 2, 2]), np.array([3, 70_000, 0, 1, 9]), np.array([1, 2, 3, 4, 70_000])
    assert all(np.array_equal(x, y) for x, y in zip(al.unpack(al.pack(doc, place, links)), (doc, place, links)))
    none = np.empty(0, np.int64)
    assert all(len(x) == 0 for x in al.unpack(al.pack(none, none, none)))
