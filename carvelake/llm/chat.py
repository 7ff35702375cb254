"""Chat formatting by event-sourced reconstruction.

A log of events is partitioned by conversation, sorted by sequence number, and folded in one pass into final messages,
which are rendered with a template that marks turns. Events: ``message`` (a whole message), ``start`` (an empty message
of a role), ``delta`` (text added to the last message), ``edit`` (new text for message number ``target``, from 0) and
``regenerate`` (the last message, if of the same role, is dropped and an empty one begun). A task
holds one conversation, which is one row of the result, so a conversation is not split, however long.

Template: ``### role: text </turn>`` and a line feed for each turn. In texts and roles a backslash, ``###`` and ``</turn>``
get a backslash before them (in roles, colons and line feeds too), so an unescaped mark is always the template's and
`parse` gives back roles and texts. The loss mask lists spans of code points: the assistant texts, without marks.

Defined cases: null texts and roles are empty; null sequence numbers come first; equal sequence numbers go by kind,
role and text; repeated events are all applied; a delta before any message begins one without a role; an edit of no
message, and unknown kinds, do nothing; a null conv_id is a conversation of its own; an empty log gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

OPEN, CLOSE = "### ", " </turn>\n"
_CONTROL = re.compile(r"\\|###|</turn>")
_ROLE_CONTROL = re.compile(r"\\|###|</turn>|:|\n")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:|\n)")
#: Characters of one delta of a streamed message.
DELTA = 4096


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans of its assistant texts."""
    parts, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{OPEN}{_ROLE_CONTROL.sub(r'\\\g<0>', role)}: ", escape(text)
        parts += [head, body, CLOSE]
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def _role_end(formatted: str, at: int) -> int:
    """The first colon from ``at`` on that no backslash escapes, or -1."""
    while (at := formatted.find(":", at)) >= 0:
        before = at
        while formatted[before - 1] == "\\":
            before -= 1
        if (at - before) % 2 == 0:
            return at
        at += 1
    return -1


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns of a formatted conversation; raises if it isn't one. In a text the end mark has a backslash before it, never a space."""
    turns, at = [], 0
    while at < len(formatted):
        colon = _role_end(formatted, at + len(OPEN)) if formatted.startswith(OPEN, at) else -1
        end = formatted.find(CLOSE, colon + 2) if colon >= 0 and formatted.startswith(" ", colon + 1) else -1
        if end < 0:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(formatted[at + len(OPEN) : colon]), unescape(formatted[colon + 2 : end])))
        at = end + len(CLOSE)
    return turns


def fold(events: Iterator[tuple[str, str, str, int | None]]) -> list[tuple[str, str]]:
    messages: list[tuple[str, list[str]]] = []
    for kind, role, text, target in events:
        if kind == "message":
            messages.append((role, [text]))
        elif kind == "start":
            messages.append((role, []))
        elif kind == "delta":
            if not messages:
                messages.append((role, []))
            messages[-1][1].append(text)
        elif kind == "edit" and target is not None and 0 <= target < len(messages):
            messages[target] = (messages[target][0], [text])
        elif kind == "regenerate":
            if messages and messages[-1][0] == role:
                messages.pop()
            messages.append((role, []))
    return [(role, "".join(parts)) for role, parts in messages]


OUTPUT = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, held, begun = None, [], False
    out: list[dict] = []

    def done() -> None:
        text, spans = render(fold(iter(held)))
        out.append({"conv_id": key, "formatted": text, "loss_spans": [{"start": a, "end": b} for a, b in spans]})

    for batch in batches:
        for conv, kind, role, text, target in zip(*(c.to_pylist() for c in batch.columns)):
            if not begun or conv != key:
                if begun:
                    done()
                key, held, begun = conv, [], True
            held.append((kind, role, text, target))
        if out:
            yield pa.RecordBatch.from_pylist(out, OUTPUT)
            out.clear()
    if begun:
        done()
        yield pa.RecordBatch.from_pylist(out, OUTPUT)


def format_conversations(events: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans from events (conv_id long, seq long, kind, role, text, target int)."""
    e = events.select(F.col("conv_id").cast("long"), F.col("seq").cast("long"), F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("target").cast("int"))
    # a sort that a conversation's rows need anyway; ties fall by kind, role and text
    dealt = e.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "kind", "role", "text")
    return dealt.select("conv_id", "kind", "role", "text", "target").mapInArrow(_formatted, "conv_id long, formatted string, loss_spans array<struct<start:bigint,end:bigint>>")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for conv, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
            turns = parse(text)
            every = hashlib.sha256()
            for role, said in turns:
                every.update(f"{role}\n{said}\n".encode())
            under = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
            out.append((conv, len(turns), every.hexdigest(), len(under), hashlib.sha256(under.encode()).hexdigest(), len(text)))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, kinds)], names)


def read_back(formatted: DataFrame) -> DataFrame:
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def turn_events(conversations: DataFrame, delta: int = DELTA) -> DataFrame:
    """A table of turns as a log: assistant texts as streams of deltas, others as whole messages. Equal turns go by role and text."""
    said = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / delta).cast("int")), lambda k: F.struct(F.lit("delta").alias("kind"), F.substring("text", k * delta + 1, F.lit(delta)).alias("text")))
    event = lambda kind, text: F.array(F.struct(F.lit(kind).alias("kind"), text.alias("text")))
    events = F.when(F.col("role") == "assistant", F.concat(event("start", F.lit("")), parts)).otherwise(event("message", F.col("text")))
    rows = said.withColumn("nth", nth.cast("long")).select("conv_id", "nth", "role", F.posexplode(events).alias("part", "event"))
    return rows.select("conv_id", (F.shiftleft("nth", 32) + F.col("part")).alias("seq"), "event.kind", "role", "event.text", F.lit(None).cast("int").alias("target"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = r"\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    return read_back(format_conversations(turn_events(rows.unionByName(extra))))


_DIGEST = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(text, '\\', '\\\\'), '###', '\\###'), '</turn>', '\\</turn>') AS esc FROM c
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(4 + length(role) + 2 + length(esc) + 9) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
#: Lengths of roles count as they are: no role of the table holds a control string.
OP7_SQL = _DIGEST
