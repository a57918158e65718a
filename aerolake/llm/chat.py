r"""Chat formatting from event logs.

A log row is (conv_id, message, seq, kind, role, text). Events of a message, in the order of ``seq``, are folded into its
final state: ``start`` opens it with a role and no text, ``delta`` appends, ``edit`` puts another text in place of what is
there, ``regenerate`` throws the text away (deltas of the new answer follow), ``delete`` withdraws the message. Messages
are rendered on their own into pieces; the formatted conversation is its pieces in the order of ``message``.

Template: ``[INST] user [/INST]``, ``<s>assistant</s>``, ``<<SYS>>system<</SYS>>``, and ``<role>name</role><turn>text</turn>``
for any other role. A backslash or a control string inside a text gets a backslash in front, so an unescaped control
string is always one of the template, and removing one backslash of each pair restores the text. The loss mask is the
inside of every ``<s>...</s>``.

Folding and rendering need one shuffle by (conv_id, message); a long conversation is spread over tasks. Digests of whole
conversations are sequential: ``digests`` reads sorted pieces as a stream and holds one hash state at a time.

Defined results: NULL texts are empty, a NULL role is the role with the empty name, a NULL conv_id is a conversation of its
own; an event that was logged twice (all fields equal) counts once; among events with equal ``seq`` the order is kind,
role, text; a message without a start has the empty role. An empty log gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTROL = r"\[/?INST\]|</?s>|<</?SYS>>|</?role>|</?turn>"
_OPEN = {"[INST]": "user", "<s>": "assistant", "<<SYS>>": "system"}


def events_of_turns(turns: DataFrame, step: int = 200) -> DataFrame:
    """The log that streaming finished turns (conv_id, turn, role, text) would have left: a start, and deltas of ``step``
    characters. Equal turns of a conversation are ordered by role and digest; repeated rows are turns of their own."""
    text = F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), F.md5(text).alias("digest"))
    rows = rows.groupBy("conv_id", "turn", "role", "digest").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    message = F.struct("turn", "role", "digest", "copy").alias("message")
    parts = F.sequence(F.lit(0), F.ceil(F.length("text") / step).cast("int"))
    rows = rows.select("conv_id", message, "role", "text", F.explode(parts).alias("seq"))
    opens = F.col("seq") == 0
    return rows.select(
        "conv_id", "message", "seq", F.when(opens, "start").otherwise("delta").alias("kind"), F.when(opens, F.col("role")).alias("role"),
        F.when(~opens, F.substring("text", (F.col("seq") - 1) * step + 1, F.lit(step))).alias("text"))


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): the final state of every message that is not withdrawn."""
    rows = events.groupBy("conv_id", "message").agg(F.collect_set(F.struct("seq", "kind", "role", "text")).alias("log"))
    rows = rows.withColumn("log", F.array_sort("log"))
    resets = F.filter(F.transform("log", lambda e, i: F.when(e["kind"].isin("start", "edit", "regenerate"), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("from", F.coalesce(F.array_max(resets), F.lit(0)))
    said = F.filter("log", lambda e, i: (i >= F.col("from")) & e["kind"].isin("delta", "edit"))
    roles = F.transform(F.filter("log", lambda e: e["kind"] == "start"), lambda e: e["role"])
    last = F.element_at("log", -1)["kind"]
    rows = rows.where(F.coalesce(last, F.lit("")) != "delete")
    return rows.select("conv_id", "message", F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"),
                       F.array_join(F.transform(said, lambda e: F.coalesce(e["text"], F.lit(""))), "").alias("text"))


def escape(text: str | Column) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(c, rf"(\\|{CONTROL})", r"\\$1")


def unescape(text: str) -> str:
    return re.sub(rf"\\(\\|{CONTROL})", r"\1", text)


def render(messages: DataFrame) -> DataFrame:
    """``messages`` with ``piece`` and the loss span ``loss_from``, ``loss_to`` in code points of the piece (NULL: none)."""
    text, role = escape(F.coalesce("text", F.lit(""))), F.coalesce("role", F.lit(""))
    piece = (F.when(role == "user", F.concat(F.lit("[INST] "), text, F.lit(" [/INST]")))
             .when(role == "assistant", F.concat(F.lit("<s>"), text, F.lit("</s>")))
             .when(role == "system", F.concat(F.lit("<<SYS>>"), text, F.lit("<</SYS>>")))
             .otherwise(F.concat(F.lit("<role>"), escape(role), F.lit("</role><turn>"), text, F.lit("</turn>"))))
    rows = messages.withColumn("piece", piece)
    loss = F.col("role") == "assistant"
    return rows.withColumn("loss_from", F.when(loss, F.lit(3))).withColumn("loss_to", F.when(loss, F.length("piece") - 4))


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns of formatted text, from the text alone."""
    role, name, part, at = "", None, [], 0
    for m in re.finditer(rf"\\(?:\\|{CONTROL})|{CONTROL}", formatted):
        part.append(formatted[at : m.start()])
        at, mark = m.end(), m[0]
        if mark[0] == "\\":
            part.append(mark[1:])
        elif mark in _OPEN:
            role, part = _OPEN[mark], []
        elif mark == "<role>":
            part = []
        elif mark == "</role>":
            name = "".join(part)
        elif mark == "<turn>":
            role, part = name or "", []
        else:
            text = "".join(part)
            yield role, text[1:-1] if mark == "[/INST]" else text


def format_log(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text, piece, loss_from, loss_to): the formatted conversations of a log, a row per message."""
    return render(fold(events))


def digests(pieces: DataFrame) -> DataFrame:
    """Per conversation, read back from the pieces: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    rows = pieces.select("conv_id", "message", "piece", "loss_from", "loss_to")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "message").select("conv_id", "piece", "loss_from", "loss_to")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = T.StructType([pieces.schema["conv_id"], *[
        T.StructField(n, T.StringType() if "sha" in n else T.LongType()) for n in names[1:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None
        kind = None

        def done(finished: list[list]) -> pa.RecordBatch:
            rows = [[s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]] for s in finished]
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            kind, finished = batch.schema.field("conv_id").type, []
            for conv, piece, a, b in zip(*[c.to_pylist() for c in batch.columns]):
                if state is None or state[0] != conv:
                    if state is not None:
                        finished.append(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[5] += len(piece)
                for role, text in parse(piece):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                if a is not None:
                    learnt = unescape(piece[a:b])
                    state[3] += len(learnt)
                    state[4].update(learnt.encode())
            if finished:
                yield done(finished)
        if state is not None:
            yield done([state])

    return rows.mapInArrow(run, schema)
