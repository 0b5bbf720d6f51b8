import numpy as np
import pytest
from llm_cases import HARD, make_docs, rows_of  # noqa: F401
from haulage.llm import language
from haulage.llm.common import read_table
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return language.train(read_table(spark, SF, "documents"))


def test_held_out_accuracy(spark):
    docs = read_table(spark, SF, "documents")
    out = language.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 200
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.98 * len(out)
    assert all(0 <= r["score"] <= 1 for r in out)


def test_held_out_is_crc32_of_the_id_as_text(spark):
    import zlib

    out = spark.range(50).select("id", language.held_out(F.col("id")).alias("h")).collect()
    assert [r["h"] for r in out] == [zlib.crc32(str(r["id"]).encode()) % 4 == 2 for r in out]


def test_sample_is_bounded_and_leaves_out_held_out(spark):
    docs = read_table(spark, SF, "documents")
    sizes = {r["lang"]: r["count"] for r in language.training_sample(docs, 20).groupBy("lang").count().collect()}
    assert set(sizes.values()) == {20}
    held = {r["text"] for r in docs.where(language.held_out(F.col("doc_id"))).collect()}
    free = {r["text"] for r in docs.where(~language.held_out(F.col("doc_id"))).collect()}
    assert {r["text"] for r in language.training_sample(docs).collect()} <= free
    assert held - free


def brute_viterbi(scores, penalty):
    value, back = scores[0].astype(float), []
    for s in scores[1:]:
        move = value[:, None] - penalty * (1 - np.eye(len(s)))
        back.append(move.argmax(0))
        value = move.max(0) + s
    path = [int(value.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(0)
    counts = np.array([3, 0, 40, 1, 17, 40])
    scores = rng.normal(size=(counts.sum(), 4)).astype(np.float32) * 3
    label, a = language.viterbi(scores, counts, 2.0), 0
    for n in counts:
        if n:
            assert label[a:a + n].tolist() == brute_viterbi(scores[a:a + n], 2.0)
        a += n


def test_spans_of_mixed_text(spark, model):
    docs = read_table(spark, SF, "documents")
    part = {}
    for lang in ("en", "de", "fr"):
        text = docs.where((F.col("lang") == lang) & language.held_out(F.col("doc_id"))).orderBy(
            F.length("text").desc()).first()["text"]
        part[lang] = " ".join(w for w in text.split() if w.isalpha())
    cut = {k: " ".join(v.split()[:120]) for k, v in part.items()}
    (_, _, spans), = language.label_texts([" ".join(cut.values())], model)
    spans = [s.split(":") for s in spans.split(",")]
    assert [s[0] for s in spans] == ["en", "de", "fr"]
    assert abs(int(spans[0][2]) - 120) <= 3 and abs(int(spans[1][2]) - 240) <= 3


def test_scripts_narrow_candidates(make_docs):
    docs = [(i, "the cat and the dog are here", "en") for i in range(40)] + [
        (100 + i, "кот и собака здесь рядом", "ru") for i in range(40)]
    model = language.train(make_docs(docs))
    (lang, score, spans), = language.label_texts(["zzzz qqqq собака the"], model)
    assert spans == "en:0:2,ru:2:3,en:3:4" and lang == "en" and score == 11 / 17


def test_a_dirty_lang_column_is_bounded(make_docs):
    docs = make_docs([(i, f"the cat and dog number{i}", "en") for i in range(40)] + [
        (100 + i, f"der hund und die katze{i}", "de") for i in range(30)] + [
        (1000 + i, "lorem ipsum", f"junk{i:03}") for i in range(600)])  # a quarter is held out
    model = language.train(docs, most_languages=3)
    assert len(model.langs) == 3 and {"en", "de"} < set(model.langs)
    assert len(language.train(docs).langs) == language.MOST_LANGUAGES
    out = rows_of(language.predict(docs), "doc_id", "lang_pred")
    assert len(out) == 670 and {lang for _, lang in out} <= set(language.train(docs).langs)


def test_languages_of_other_scripts_are_excluded():
    trigrams = np.ones((language.BUCKETS, 2))
    scripts = np.zeros((len(language.SCRIPT_NAMES), 2))
    latin, cyrillic, thai = map(language.SCRIPT_NAMES.index, ("latin", "cyrillic", "thai"))
    scripts[latin, 0] = scripts[cyrillic, 1] = 100
    model = language.Model(["en", "ru"], trigrams, scripts)
    scores = model.word_scores(language.Words(["word слово ไทย " + "б" * 500]))
    assert np.isneginf(scores).tolist() == [[False, True], [True, False], [False, False], [True, False]]
    assert model.mask[thai].tolist() == [0, 0]
    (lang, score, spans), = language.label_texts(["word слово word"], model, penalty=1e6)
    assert spans == "en:0:1,ru:1:2,en:2:3" and lang == "en" and score == 8 / 13


def test_hard_rows(make_docs):
    out = rows_of(language.predict(make_docs(HARD)), "doc_id", "held_out", "lang_pred", "score")
    assert {r[0]: r[2] for r in out} == {r[0]: "en" if r[1] and any(map(str.isalpha, r[1])) else "und" for r in HARD}
    assert (None, False, "en", 1.0) in out and len(out) == len(HARD)
    assert language.predict(make_docs([])).count() == 0
