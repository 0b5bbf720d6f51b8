import hashlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import rows_of  # noqa: F401
from haulage.llm import chat

SAID = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "<", "[", "/s>", " ok ", "<\\/s>", "[\\\\INST]", "[ROLE]", "é\n", "[TEXT] ", "]"]
TEXTS = st.lists(st.sampled_from(SAID), max_size=12).map("".join)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, piece string, seq int").repartition(3)


def brute(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
ROWS = [(1, 0, "system", "be <s> kind"), (1, 1, "user", "hi [INST]"), (1, 2, "assistant", "yo</s>"), (1, 3, "user", None), (1, 4, "assistant", ""),
        (2, 0, "assistant", "<\\/s>"), (2, None, "assistant", "first"), (2, 0, "assistant", "<\\/s>"), (None, 0, "user", "who"),
        (None, 1, "assistant", "me"), (3, 5, None, "no role"), (3, 6, "tool [TEXT] ", "x [TEXT] y [/ROLE]"), (4, 9000, "user", "far"),
        (4, -9000, "assistant", "near"), (4, 0, "assistant", "mid" * 3000)]


def test_read_back_equals_the_turns(spark):
    assert rows_of(chat.digests(chat.write_formatted(table(spark, ROWS))), *COLUMNS) == brute(ROWS)
    probe = chat.with_probe(spark, table(spark, []))
    said = "</s>[INST] ok [/INST]"
    assert rows_of(chat.digests(chat.write_formatted(probe)), *COLUMNS) == brute([(-7, 0, "user", said), (-7, 1, "assistant", said)])
    assert chat.digests(chat.write_formatted(table(spark, []))).count() == 0


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "[ROLE]", "a [TEXT] b"]), TEXTS), min_size=1, max_size=30))
@settings(max_examples=8, deadline=None)
def test_any_text_comes_back(spark, turns):
    rows = [(1, i, r, t) for i, (r, t) in enumerate(turns)]
    assert rows_of(chat.digests(chat.write_formatted(table(spark, rows))), *COLUMNS) == brute(rows)


def test_no_control_string_is_left_in_a_text(spark):
    rows = [(i, 0, "user", a + b) for i, (a, b) in enumerate((a, b) for a in SAID for b in SAID)]
    for r in chat.render(table(spark, rows)).collect():
        inner = r["piece"].removeprefix("[INST] ").removesuffix(" [/INST]")
        assert not any(c in inner for c in chat.CONTROL)


def test_every_reply_is_an_example_with_all_before_as_context(spark):
    pieces = chat.write_formatted(table(spark, ROWS))
    whole = defaultdict(str)
    for r in sorted(pieces.collect(), key=lambda r: (str(r["conv_id"]), r["seq"])):
        assert r["start"] == len(whole[r["conv_id"]])
        whole[r["conv_id"]] += r["piece"]
    examples = chat.examples(pieces)
    texts = {(r["conv_id"], r["target_seq"]): r for r in chat.example_texts(pieces, examples).collect()}
    rows = examples.collect()
    assert len(rows) == len(texts) == sum(r[2] == "assistant" for r in ROWS)
    for r in rows:
        text = texts[r["conv_id"], r["target_seq"]]["text"]
        assert text == whole[r["conv_id"]][:r["example_chars"]] and r["context_chars"] < r["loss_start"] <= r["loss_end"] < len(text) + 1
        assert text[r["context_chars"]:r["loss_start"]] == "<s> " and text[r["loss_end"]:] == " </s>"
    one = [r for r in rows if r["conv_id"] == 1]
    assert sorted(r["loss_end"] - r["loss_start"] for r in one) == [0, len("yo<\\/s>")]


def test_loss_and_examples_come_from_the_stored_masks(spark):
    pieces = chat.write_formatted(table(spark, ROWS))
    masks = chat.write_examples(pieces)
    columns = ("conv_id", "loss_chars", "loss_sha256", "n_examples", "example_chars")
    right = rows_of(chat.digests(pieces, masks), *columns)
    per = defaultdict(list)
    for r in masks.collect():
        per[r["conv_id"]].append(r["example_chars"])
    assert {r[0]: (r[3], r[4]) for r in right} == {c: (len(per[c]), sum(per[c])) for c in {r[0] for r in ROWS}}
    wrong = {r["conv_id"]: r for r in chat.digests(pieces, masks.withColumn("loss_end", masks["loss_end"] - 1)).collect()}
    assert wrong[4]["loss_chars"] == len("near") + len("mid" * 3000) - 2
    fewer = {r["conv_id"]: r for r in chat.digests(pieces, masks.where("conv_id <> 4")).collect()}
    assert (fewer[4]["n_examples"], fewer[4]["example_chars"], fewer[4]["loss_chars"], fewer[4]["n_turns"]) == (0, 0, 0, 3)


def test_the_query_stores_its_examples(spark, monkeypatch):
    from haulage.llm import queries

    stored = {}

    def keep(df, purpose, write=chat.shared_write):
        stored[purpose] = write(df, purpose)
        return stored[purpose]

    monkeypatch.setattr(chat, "shared_write", keep)
    out = queries.op9_chat_format(spark, "/root/testdata/sf0.001").agg({"n_examples": "sum"}).first()[0]
    assert stored["chat-examples"].count() == out > 0
