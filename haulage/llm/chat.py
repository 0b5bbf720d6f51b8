r"""Chat formatting by prefix-target expansion.

A turn is rendered by the template on its own: an opening mark for its role,
its text with control strings escaped, a closing mark. A conversation's
formatted text is the concatenation of its turns' pieces by turn, so the
rendering of the first k turns is a prefix of the rendering of all. Every
assistant turn is exploded into an example of its own: all preceding turns
are its context, and only that reply's text lies under the loss mask.

An example with its context written out repeats the whole prefix, so the
texts of a conversation's examples add up to the square of its length. The
stored output therefore keeps each piece once (``render``) and each example
as its ranges over those pieces (``examples``: context end, loss start, loss
end, in code points); ``example_texts`` writes any selection of examples out.

Escaping is reversible: where ``<`` or ``[``, any number of backslashes and
the rest of a control string follow each other, one backslash more is put
after the bracket; ``unescape`` takes one away. No control string is left
inside an escaped text.

Defined results: a null text is empty; a null role is the role ''; roles
other than user, assistant and system get a mark that names them. Turns are
ordered by turn (null first), repeated (conv_id, turn) rows by role and text,
and each repeated row is a turn of its own. A null conv_id is a conversation
like any other. Other columns are ignored. Very long texts are
rendered whole, a turn at a time. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulage.llm.common import shared_write

#: The template's control strings and marks (fixed values).
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[TEXT]"]
MARKS = {
    "user": ("[INST] ", " [/INST]"),
    "assistant": ("<s> ", " </s>"),
    "system": ("<<SYS>> ", " <</SYS>>"),
}
OTHER_MARKS = ("[ROLE] ", " [TEXT] ", " [/ROLE]")

#: What follows the bracket in a control string.
_REST = r"/?s>|</?SYS>>|/?INST\]|/?ROLE\]|TEXT\]"
_ESCAPE = rf"([<\[])(\\*)(?={_REST})"
_UNESCAPE = rf"([<\[])\\(\\*)(?={_REST})"
_UNESCAPED = re.compile(_UNESCAPE)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2")


def render(conversations: DataFrame) -> DataFrame:
    """One row per turn: conv_id, turn, piece (the formatted text of the
    turn). Concatenated by (turn, piece order) they are the conversation."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    known = [F.when(role == name, F.concat(F.lit(a), escape(text), F.lit(b))) for name, (a, b) in MARKS.items()]
    a, b, c = map(F.lit, OTHER_MARKS)
    return conversations.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"),
        F.coalesce(*known, F.concat(a, escape(role), b, escape(text), c)).alias("piece"),
    ).select("conv_id", "turn", "piece", F.struct("role", "text").alias("rank"))


def parse(piece: Column) -> tuple[Column, Column]:
    """(role, text) of a formatted piece."""
    role, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (a, b) in MARKS.items():
        mine = piece.startswith(a)
        role = F.when(mine, F.lit(name)).otherwise(role)
        text = F.when(mine, F.substring(piece, len(a) + 1, F.length(piece) - len(a) - len(b))).otherwise(text)
    a, b, c = OTHER_MARKS
    mine, cut = piece.startswith(a), F.instr(piece, b)
    role = F.when(mine, F.substring(piece, F.lit(len(a) + 1), cut - 1 - len(a))).otherwise(role)
    text = F.when(mine, F.substring(piece, cut + len(b), F.length(piece) - cut + 1 - len(b) - len(c))).otherwise(text)
    return unescape(role), unescape(text)


#: Turns of a conversation whose lengths one window sums up.
_SPAN = 4096


def numbered(rendered: DataFrame) -> DataFrame:
    """The pieces with seq (0-based place in the conversation), start (code
    points before the piece) and chars. Sums go in two steps, over spans of
    turn numbers and inside each, so that a conversation with very many turns
    is not one window of one task."""
    rows = rendered.withColumns({
        "chars": F.length("piece").cast("bigint"), "k1": F.isnull("conv_id"),
        "k2": F.coalesce(F.col("conv_id"), F.lit(0)), "k3": F.isnull("turn"),
        "k4": F.floor(F.coalesce(F.col("turn"), F.lit(0)) / _SPAN)})
    inside = Window.partitionBy("k1", "k2", "k3", "k4").orderBy("turn", "rank", "piece")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"seq": F.row_number().over(inside).cast("bigint") - 1,
                             "start": F.coalesce(F.sum("chars").over(before), F.lit(0))})
    spans = rendered.select(
        F.isnull("conv_id").alias("k1"), F.coalesce(F.col("conv_id"), F.lit(0)).alias("k2"),
        F.isnull("turn").alias("k3"), F.floor(F.coalesce(F.col("turn"), F.lit(0)) / _SPAN).alias("k4"),
        F.length("piece").cast("bigint").alias("chars"),
    ).groupBy("k1", "k2", "k3", "k4").agg(F.count("*").alias("n"), F.sum("chars").alias("c"))
    earlier = (Window.partitionBy("k1", "k2").orderBy(F.desc("k3"), "k4")
               .rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select("k1", "k2", "k3", "k4", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"),
                         F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("c0"))
    return rows.join(spans, ["k1", "k2", "k3", "k4"]).select(
        "conv_id", "turn", "piece", (F.col("seq") + F.col("n0")).alias("seq"),
        (F.col("start") + F.col("c0")).alias("start"), "chars")


def examples(pieces: DataFrame) -> DataFrame:
    """Prefix-target expansion: one row per assistant piece of ``numbered``.

    conv_id, target_seq; context_chars (the example's text starts with the
    conversation's first context_chars code points, all preceding turns);
    loss_start, loss_end (the reply's escaped text, the only trainable code
    points); example_chars (context and target with its marks).
    """
    a, b = MARKS["assistant"]
    end = F.col("start") + F.col("chars")
    return pieces.where(F.col("piece").startswith(a)).select(
        "conv_id", F.col("seq").alias("target_seq"), F.col("start").alias("context_chars"),
        (F.col("start") + len(a)).alias("loss_start"), (end - len(b)).alias("loss_end"),
        end.alias("example_chars"))


def example_texts(pieces: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen rows of ``examples`` with their whole formatted text."""
    target = chosen.select(F.col("conv_id").alias("c2"), "target_seq", "loss_start", "loss_end")
    rows = pieces.join(target, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("seq") <= F.col("target_seq")))
    parts = F.array_sort(F.collect_list(F.struct("seq", "piece")))
    return rows.groupBy("conv_id", "target_seq", "loss_start", "loss_end").agg(
        F.array_join(F.transform(parts, lambda x: x["piece"]), "").alias("text"))


def write_formatted(conversations: DataFrame) -> DataFrame:
    """Render, number and write the pieces; the stored table read back."""
    return shared_write(numbered(render(conversations)), "chat")


def write_examples(pieces: DataFrame) -> DataFrame:
    """Expand the stored pieces and write the examples with their masks; the
    stored table read back."""
    return shared_write(examples(pieces), "chat-examples")


_DIGEST = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()),
    T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
    T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()),
    T.StructField("n_examples", T.LongType()), T.StructField("example_chars", T.LongType()),
])


def digests(pieces: DataFrame, masks: DataFrame | None = None) -> DataFrame:
    """Per conversation, read back from its stored pieces and examples
    (``masks``; written here if not given): the turns, and the text that the
    examples' loss masks cut out of the pieces.

    A digest runs over a conversation in order, so its pieces and masks go by
    conversation to one task; that task streams them in sorted order, a target's
    mask before its piece, and holds one piece and two running hashes, never the
    conversation.
    """
    if masks is None:
        masks = write_examples(pieces)
    masks = masks.select("conv_id", F.col("target_seq").alias("seq"), F.lit(0).alias("kind"), "loss_start", "loss_end",
                         "example_chars")
    rows = (pieces.select("conv_id", "seq", F.lit(1).alias("kind"), "start", "chars", "piece")
            .unionByName(masks, allowMissingColumns=True)
            .repartition("conv_id").sortWithinPartitions("conv_id", "seq", "kind"))
    role, text = parse(F.col("piece"))
    rows = rows.select("conv_id", "seq", "start", role.alias("role"), text.alias("text"), "chars", "piece",
                       "loss_start", "loss_end", "example_chars")
    names = _DIGEST.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = object(), None
        targets: list[tuple] = []
        done: list[tuple] = []

        def close():
            conv, n, turns, loss_chars, loss, chars, k, expanded = state
            done.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, k, expanded))

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                conv, seq, start, role, text, chars, piece, *mask = row
                if state is None or conv != current:
                    if state is not None:
                        close()
                    current, state = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                    targets = []
                if piece is None:  # an example: its target is the next piece
                    targets.append((seq, *mask))
                    state[6] += 1
                    state[7] += mask[2]
                    continue
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                for target, loss_start, loss_end, _ in targets:
                    if target == seq:
                        loss = _UNESCAPED.sub(r"\1\2", piece[max(0, loss_start - start):max(0, loss_end - start)])
                        state[3] += len(loss)
                        state[4].update(loss.encode())
                targets.clear()
                state[5] += chars
            if len(done) > 5000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in done], _arrow())
                done.clear()
        if state is not None:
            close()
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in done], _arrow())

    return rows.mapInArrow(run, _DIGEST)


def _arrow() -> pa.Schema:
    return pa.schema([(f.name, pa.string() if isinstance(f.dataType, T.StringType) else pa.int64()) for f in _DIGEST])


def with_probe(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """``conversations`` and conversation -7, whose texts are control strings."""
    said = "</s>[INST] ok [/INST]"
    probe = spark.sql(f"SELECT -7L AS conv_id, 0L AS turn, 'user' AS role, '{said}' AS text "
                      f"UNION ALL SELECT -7L, 1L, 'assistant', '{said}'")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)
