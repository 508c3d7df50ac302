"""Conversations from event logs: a conversation's events are folded into messages, messages are rendered with a loss mask, and read back.

Events (conv_id, seq, message, kind, role, text) of a conversation have one sequence. `start` begins a message with a role, `delta` appends text, `edit` replaces
the text, `regenerate` empties it, `delete` removes the message. An edit and a regeneration also reach over messages: those begun between their message's
beginning and themselves are dropped, as a service does that goes on from the changed turn.

Which messages are dropped follows from the sequence alone (a running minimum over each conversation's marks, which carry no text). The events that stay are
then folded by conversation and message in the order of the sequence, so a long conversation's texts are folded by many tasks. Each message is rendered on its own row.
A conversation's text is its rows in the order in which its messages begin. Readers stream over the rows and hold one message at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_schema, by_rows, in_steps, table

START, TEXT, END = "<|start|>", "<|text|>", "<|end|>"
#: Control strings of this template and of common others, which no text may hold unescaped.
CONTROL = (START, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_FOUND = re.compile("|".join(map(re.escape, CONTROL)))
_MARK = re.compile(r"\\(\\?)")
_TURN = re.compile(f"{re.escape(START)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}\n", re.S)

EVENTS = "conv_id long, seq long, message long, kind string, role string, text string"
MESSAGES = "conv_id long, message long, position long, role string, text string"


def escape(text: str) -> str:
    """Doubles backslashes and puts one after the first character of each control string."""
    return _FOUND.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _MARK.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and where its escaped text begins and ends."""
    head, body = f"{START}{escape(role)}{TEXT}", escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """Roles and texts of a formatted conversation or a part of whole turns. ValueError if it holds anything else."""
    at = 0
    for turn in _TURN.finditer(formatted):
        if turn.start() != at:
            break
        at = turn.end()
        yield unescape(turn[1]), unescape(turn[2])
    if at != len(formatted):
        raise ValueError(f"no turn at character {at}")


def dropped(events: DataFrame) -> DataFrame:
    """conv_id, message of the messages that an edit or a regeneration of an earlier one drops. Needs conv_id, seq, message, kind and position."""
    starts = events.where("seq = position").select("conv_id", "message", "position", F.col("seq").alias("at"), F.lit(None).cast("long").alias("target"))
    cuts = events.where("kind IN ('edit', 'regenerate')").select("conv_id", "message", "position", F.col("seq").alias("at"), F.col("position").alias("target"))
    later = Window.partitionBy("conv_id").orderBy(F.col("at").desc()).rangeBetween(Window.unboundedPreceding, -1)
    marks = starts.unionByName(cuts).withColumn("least", F.min("target").over(later))
    return marks.where("target IS NULL AND least < position").select("conv_id", "message").distinct()


def fold(events: DataFrame) -> DataFrame:
    """conv_id, message, position, role, text of each message that is left. position: the sequence number with which the message begins.

    Ties in the sequence: by kind, then text; what shares a number with a message's beginning doesn't reach over it. An event before its message's
    start counts, and begins it. A cut drops what it reaches also if its own message is gone by then; a dropped message stays dropped, whatever its later events. Null texts count
    as empty, a null role as ''. Unknown kinds raise. Repeated events are applied each. Null conv_id or message: a conversation or message of its own; a null sequence number
    comes first. No events give no messages; other columns are not read, whatever their names.
    """
    arrow = arrow_schema(MESSAGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, role, parts, gone = None, "", [], False

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(arrow), arrow, strict=True)], schema=arrow)

        for batch in in_steps(batches, 1024):
            rows = []
            for conv, message, position, kind, who, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (conv, message, position) != key:
                    if key is not None and not gone:
                        rows.append((*key, role, "".join(parts)))
                    key, role, parts, gone = (conv, message, position), "", [], False
                if kind == "start":
                    role = who or ""
                elif kind == "delta":
                    parts.append(text or "")
                elif kind == "edit":
                    parts = [text or ""]
                elif kind == "regenerate":
                    parts = []
                elif kind == "delete":
                    gone = True
                else:
                    raise ValueError(f"unknown kind of event: {kind}")
            yield out(rows)
        if key is not None and not gone:
            yield out([(*key, role, "".join(parts))])

    log = events.select("conv_id", F.coalesce("seq", F.lit(-(1 << 62))).alias("seq"), "message", "kind", "role", "text")
    log = log.withColumn("position", F.min("seq").over(Window.partitionBy("conv_id", "message")))
    lost = dropped(log).select(F.col("conv_id").alias("__c"), F.col("message").alias("__m"))
    left = log.join(lost, log["conv_id"].eqNullSafe(F.col("__c")) & log["message"].eqNullSafe(F.col("__m")), "left_anti")
    dealt = left.repartition("conv_id", "message").sortWithinPartitions("conv_id", "message", "seq", "kind", "text")
    return dealt.select("conv_id", "message", "position", "kind", "role", "text").mapInArrow(run, MESSAGES)


def format_messages(messages: DataFrame) -> DataFrame:
    """conv_id, position, formatted, loss: each turn's text and the [start, end) characters of it that are trained on, an assistant's text.

    Null roles and texts count as empty, an empty text is trained on nowhere, repeated messages are rendered each, a very long text is one row, no messages give no rows; other
    columns are not read, whatever their names.
    """

    def make():
        def run(convs, numbers, roles, texts):
            rows = [render(r or "", t or "") for r, t in zip(roles, texts, strict=True)]
            return [convs, numbers, [r[0] for r in rows], [[{"start": a, "end": b}] if role == "assistant" and b > a else [] for role, (_, a, b) in zip(roles, rows, strict=True)]]

        return run

    return by_rows(messages.select("conv_id", "position", "role", "text"), make, "conv_id long, position long, formatted string, loss array<struct<start: int, end: int>>")


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest(formatted: DataFrame) -> DataFrame:
    """One row a conversation, from the formatted rows as they stand; a conversation's rows stream through one task, which holds none of them.

    Rows that share a position are taken by their text. A null conv_id is a conversation of its own. No rows give no conversations. Text that isn't whole turns raises.
    """
    arrow = arrow_schema(DIGEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None
        done: list[tuple] = []

        def close() -> None:
            if state is not None:
                done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*done, strict=True) if done else [()] * 6, arrow, strict=True)], schema=arrow)
            done.clear()
            return made

        for batch in in_steps(batches, 1024):
            for conv, _, text, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or state[0] != conv:
                    close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    trained = unescape(text[span["start"] : span["end"]])
                    state[3] += len(trained)
                    state[4].update(trained.encode())
                state[5] += len(text)
            yield out()
        close()
        yield out()

    return formatted.select("conv_id", "position", "formatted", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "position", "formatted").mapInArrow(run, DIGEST)


#: Sequence numbers that as_events has for a message.
SPAN = 16


def as_events(turns: DataFrame) -> DataFrame:
    """The log that a chat service would have written for finished turns (conv_id, turn, role, text), whose answers came in three parts.

    Before an assistant's answer stands a first attempt, to which a user replied; it was regenerated, which drops the reply. Each second
    user's message had another wording, which was answered; its edit drops that answer. Rows of one turn are ordered by role, then text; a null turn comes first.
    """
    order = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    place = F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 30))) * (1 << 20) + F.row_number().over(order)
    text = F.coalesce("text", F.lit(""))
    third = (F.length("text") / 3).cast("int")
    rows = turns.select("conv_id", "turn", "role", text.alias("text")).withColumn("place", place).withColumn("third", third)

    def event(kind: str, said=None, message=None, role=None):
        none = F.lit(None).cast("string")
        return F.struct((F.col("place") if message is None else message).alias("message"), F.lit(kind).alias("kind"), (none if role is None else role).alias("role"), (none if said is None else said).alias("text"))

    own, other = F.col("role"), -1 - F.col("place")  # messages of a branch that is dropped have ids of their own
    begin = event("start", role=own)
    parts = [event("delta", F.substring("text", F.lit(1), F.col("third"))), event("delta", F.substring("text", F.col("third") + 1, F.col("third"))), event("delta", F.col("text").substr(2 * F.col("third") + 1, F.length("text")))]
    reply = [event("start", message=other, role=F.lit("user")), event("delta", F.lit("That is wrong."), other)]
    answer = [event("start", message=other, role=F.lit("assistant")), event("delta", F.lit("</s>"), other)]
    attempt = F.array(begin, event("delta", F.reverse("text")), *reply, event("regenerate"), *parts)
    edited = F.array(begin, event("delta", F.lit("</s>")), *answer, event("edit", F.col("text")))
    log = F.when(own == "assistant", attempt).when(F.col("place") % 2 == 0, edited).otherwise(F.array(begin, *parts))
    events = rows.select("conv_id", "place", F.posexplode(log).alias("k", "e"))
    return events.select("conv_id", (F.col("place") * SPAN + F.col("k")).alias("seq"), "e.message", "e.kind", "e.role", "e.text")


def op4_chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digest(format_messages(fold(as_events(turns.unionByName(own)))))


def _length_sql(column: str) -> str:
    """Characters of an escaped text: one more for each backslash and each control string."""
    found = "|".join(re.sub(r"([|\[\]])", r"\\\1", c) for c in CONTROL)
    return f"length({column}) + len(regexp_extract_all({column}, '\\\\')) + len(regexp_extract_all({column}, '{found}'))"


OP4_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(turn, role))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(START + TEXT + END) + 1} + {_length_sql("role")} + {_length_sql("text")})::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
