"""Chat formatting by event-sourced reconstruction (operator 10)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_type, batch
from .exact_dedup import _ddl


@dataclass(frozen=True)
class Template:
    """A turn is ``open + role + mid + text + close``. ``controls`` are the strings that must not
    appear inside a role or text; each is at least two characters long."""

    open: str = "<s>[ROLE]"
    mid: str = "[/ROLE]"
    close: str = "</s>"
    # The control strings of common chat templates.
    controls: tuple[str, ...] = ("<s>", "</s>", "[ROLE]", "[/ROLE]", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")

    def pattern(self, slashes: str) -> re.Pattern:
        return re.compile("|".join(re.escape(c[0]) + rf"\\{slashes}" + re.escape(c[1:]) for c in self.controls))

    def escape(self, text: str) -> str:
        """Put a backslash behind the first character of each control string, also where backslashes
        stand there already: ``unescape`` takes exactly one away again."""
        return self.pattern("*").sub(lambda m: m[0][0] + "\\" + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return self.pattern("+").sub(lambda m: m[0][0] + m[0][2:], text)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def fold_log(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conversation, role, text) of the final messages from (conversation, turn, seq, kind, role, text)
    events in that order. ``message`` opens a message; ``delta`` appends to it; ``edit`` replaces its
    text; ``regenerate`` empties it for the deltas that follow; ``delete`` drops it. An event of a turn
    without a message opens one. A null kind is ``message``, a null text is empty. Two ``message``
    events of one turn are two messages."""
    at: object = _rows
    role, parts, live = "", [], False
    for conv, turn, _, kind, who, text in rows:
        kind, text = kind or "message", text or ""
        if (conv, turn) != at or kind == "message":
            if live:
                yield at[0], role, "".join(parts)
            live, parts, role = kind != "delete", [], who or ""
            at = (conv, turn)
        if kind == "delete":
            live = False
        elif kind in ("edit", "regenerate"):
            live, parts = True, [text]
        else:
            live = True
            parts.append(text)
    if live:
        yield at[0], role, "".join(parts)


def render_log(events: DataFrame, conv_col: str = "conv_id", template: Template | None = None, loss_roles: tuple[str, ...] = ("assistant",), part_chars: int = 1 << 20) -> DataFrame:
    """Fold an event log and render it: (conv, part_no, n_turns, formatted, loss array of (start, stop)).

    ``events`` has ``conv_col, turn, seq, kind, role, text``. Logs are partitioned by conversation and
    sorted by turn and sequence (ties: role, then text; nulls first), and folded as a stream: a task
    holds one message and one part at a time, however long the conversation is. A conversation longer
    than ``part_chars`` goes on in further parts, always between turns. Loss spans count code points
    within their part. Events with a null conversation form one conversation of their own; one whose
    messages are all deleted has no row.
    """
    t = template or Template()
    ids = arrow_type(events, conv_col)
    schema = pa.schema([("conv", ids), ("part_no", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple]:
            at: object = run
            no, turns, out, size, spans = 0, 0, [], 0, []
            for conv, role, text in fold_log(_rows(batches)):
                if out and (conv != at or size > part_chars):
                    yield at, no, turns, "".join(out), spans
                    no, turns, out, size, spans = no + 1, 0, [], 0, []
                no = 0 if conv != at else no
                at = conv
                head, body = t.open + t.escape(role) + t.mid, t.escape(text)
                if role in loss_roles:
                    spans.append({"start": size + len(head), "stop": size + len(head) + len(body)})
                out.append(head + body + t.close)
                size, turns = size + len(out[-1]), turns + 1
            if out:
                yield at, no, turns, "".join(out), spans

        yield from _grouped(parts(), schema)

    keyed = events.select(F.col(conv_col).alias("conv"), F.col("turn").alias("turn"), "seq", "kind", "role", "text")
    return keyed.repartition("conv").sortWithinPartitions("conv", "turn", "seq", "role", "text").mapInArrow(run, "conv " + events.schema[conv_col].dataType.simpleString() + ", part_no bigint, n_turns bigint, formatted string, loss array<struct<start:bigint,stop:bigint>>")


def _grouped(rows: Iterator[tuple], schema: pa.Schema, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``most`` characters."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, str)) + 64
        if size >= most:
            yield batch(schema, *zip(*held, strict=True))
            held, size = [], 0
    if held:
        yield batch(schema, *zip(*held, strict=True))


def read_back(parts: DataFrame, template: Template | None = None) -> DataFrame:
    """Digests per conversation, read from formatted parts alone: turns are found by the template's
    marks and unescaped; the text under the loss mask is cut out by its spans and unescaped."""
    t = template or Template()
    schema = pa.schema([("conv", arrow_type(parts, "conv")), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = re.compile(f"{re.escape(t.open)}(.*?){re.escape(t.mid)}(.*?){re.escape(t.close)}", re.DOTALL)

        def digests() -> Iterator[tuple]:
            at: object = run
            state = None
            for conv, _, text, loss in _rows(batches):
                if state is None or conv != at:
                    if state:
                        yield at, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]
                    at, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                end = 0
                for m in turn.finditer(text):
                    if m.start() != end:
                        raise ValueError(f"conversation {conv}: text between turns")
                    end = m.end()
                    state[0] += 1
                    state[1].update(f"{t.unescape(m[1])}\n{t.unescape(m[2])}\n".encode())
                if end != len(text):
                    raise ValueError(f"conversation {conv}: an unfinished turn")
                for span in loss:
                    said = t.unescape(text[span["start"] : span["stop"]])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
            if state:
                yield at, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        yield from _grouped(digests(), schema)

    sorted_parts = parts.select("conv", "part_no", "formatted", "loss").repartition("conv").sortWithinPartitions("conv", "part_no")
    return sorted_parts.mapInArrow(run, _ddl(schema))


def events_of(conversations: DataFrame) -> DataFrame:
    """A table of turns as an event log: each row opens a message with its text. Where the log streams
    answers, deltas and edits follow with the same turn. A turn that stands twice is two messages."""
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.lit(0).cast("long").alias("seq"), F.lit("message").alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))


def streamed_log(conversations: DataFrame) -> DataFrame:
    """A table of turns as the log of how they came about, whose fold gives the turns: an answer begins with a
    draft, is regenerated, and streams in two deltas; another message is sent short and then edited. ``seq``
    counts the events of a conversation, turns that stand twice one after the other by role and text."""
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long") * 4
    half, none = F.floor(F.length("text") / 2).cast("int"), F.lit(None).cast("string")
    event = lambda k, kind, text: F.struct((F.col("at") + k).alias("seq"), F.lit(kind).alias("kind"), (F.col("role") if kind == "message" else none).alias("role"), text.alias("text"))
    first, last = F.substring("text", F.lit(1), half), F.substring(F.col("text"), half + 1, F.length("text"))
    answer = F.array(event(0, "message", F.reverse(first)), event(1, "regenerate", F.lit("")), event(2, "delta", first), event(3, "delta", last))
    other = F.array(event(0, "message", first), event(1, "edit", F.col("text")))
    made = F.explode(F.when(F.col("role") == "assistant", answer).otherwise(other)).alias("e")
    return rows.withColumn("at", at).select("conv_id", "turn", made).select("conv_id", "turn", "e.*")


#: The text of both rows of the added conversation (a fixed value of the query).
MARKED = "</s>[INST] ok [/INST]"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation of ``conversations`` and for the added one, read back from what was formatted of
    the folded log: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", MARKED), (-7, 1, "assistant", MARKED)], "conv_id long, turn long, role string, text string")
    return read_back(render_log(streamed_log(rows.unionByName(more)))).withColumnRenamed("conv", "conv_id")


_ESCAPED = r"regexp_replace({}, '(<|\[)(\\*(?:s>|/s>|<SYS>>|</SYS>>|\|im_start\|>|\|im_end\|>|\|endoftext\|>|ROLE\]|/ROLE\]|INST\]|/INST\]))', '\1\\\2', 'g')"
ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{MARKED}'), (-7, 1, 'assistant', '{MARKED}'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(20 + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
