import corpus_pipeline
from llm_cases import HARD, make_docs, rows_of  # noqa: F401
from haulage.llm.common import read_table, shared_write

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_each_stage_on_its_own_input(spark):
    docs = read_table(spark, SF, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = shared_write(stage(spark, docs, SF), name)
        assert out.columns == COLUMNS
        before = {r["doc_id"]: r.asDict() for r in docs.collect()}
        after = {r["doc_id"]: r.asDict() for r in out.collect()}
        assert out.count() == len(after) and set(after) <= set(before)
        changed = [i for i in after if after[i] != before[i]]
        assert not changed or name == "line_dedup"
        seen[name], docs = (len(before), len(after)), out
    assert seen["line_dedup"][1] < seen["line_dedup"][0] and seen["decontaminate"][1] < seen["decontaminate"][0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == set(after)
    whole = corpus_pipeline.run(spark, SF)
    assert rows_of(whole, "doc_id", "start", "ids_crc32") == rows_of(packed, "doc_id", "start", "ids_crc32")


def test_hard_rows_and_empty_tables_pass_all_stages(spark, make_docs, tmp_path):
    for rows in (HARD, []):
        folder = str(tmp_path / str(len(rows)))
        make_docs(rows).select(*COLUMNS).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, "some benchmark passage")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert (out.count() > 0) == bool(rows)


def test_documents_alike_at_two_words_only_both_stay(spark, make_docs):
    words = [f"w{i}" for i in range(200)]
    other = [f"new{i}" if i % 20 == 10 else w for i, w in enumerate(words)]  # at 2 words 0.82, at 5 0.59
    docs = make_docs([(1, " ".join(words)), (2, " ".join(other)), (3, " ".join([*words[:-2], "x", "y"]))])
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == {1, 2}
