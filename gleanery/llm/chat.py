"""Chat formatting with a grammar round trip.

Every turn is rendered as an opening mark, its text and a closing mark:

    system      <<SYS>> text<</SYS>>          user    [INST] text[/INST]
    assistant   <s> text</s>                  others  [TURN role]] text[/TURN]

The parser is deterministic: at a position exactly one kind of turn can open, it ends at the first closing mark of that
kind, and a text that holds the control string of any mark is an error. A rendered turn is parsed back and compared with its source; while they differ, its text is escaped one level
further: as it is, then the first characters of control strings, then every bracket. ``␛0``, ``␛1`` and ``␛2`` stand
for the escape character, ``[`` and ``<``, and the parser always undoes them. Because a turn is consumed as a whole
wherever it stands, turns that survive the round trip alone survive it in a conversation.

Nulls and ties: null text and null roles are empty; turns are ordered by turn (null first), role and text; repeated rows
are turns of their own; rows with a null conv_id form one conversation. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ESCAPE = "␛"
PLAIN = {ESCAPE + "0": ESCAPE, ESCAPE + "1": "[", ESCAPE + "2": "<"}
CODES = {c: e for e, c in PLAIN.items()}
MARKS = {"system": ("<<SYS>> ", "<</SYS>>\n"), "user": ("[INST] ", "[/INST]\n"), "assistant": ("<s> ", "</s>\n")}
OTHER = ("[TURN ", "]] ", "[/TURN]\n")
LOSS_ROLES = ("assistant",)
CONTROL = re.compile(r"[\[<](?=/?INST\]|</?SYS>>|/?s>|/?TURN)")
ENCODED = re.compile(ESCAPE + "[012]")
LEVELS = 3


def escape(text: str, level: int) -> str:
    """The text at an escape level: 0 as it is, 1 without control strings, 2 without any bracket."""
    if level == 0:
        return text
    text = text.replace(ESCAPE, CODES[ESCAPE])
    pattern = CONTROL if level == 1 else re.compile(r"[\[<]")
    return pattern.sub(lambda m: CODES[m[0]], text)


def unescape(text: str) -> str:
    return ENCODED.sub(lambda m: PLAIN[m[0]], text) if ESCAPE in text else text


def escape_role(role: str) -> str:
    """A role inside its mark: also free of ``]``, so that the mark ends where it should."""
    return escape(role, 2).replace("]", ESCAPE + "3")


def render_turn(role: str, text: str, level: int) -> str:
    if role in MARKS:
        opening, closing = MARKS[role]
        return opening + escape(text, level) + closing
    return OTHER[0] + escape_role(role) + OTHER[1] + escape(text, level) + OTHER[2]


def parse(rendered: str, at: int = 0):
    """Turns (role, start and end of the body, end of the turn) from ``at`` on; ValueError where the grammar fails."""
    while at < len(rendered):
        for role, (opening, closing) in MARKS.items():
            if rendered.startswith(opening, at):
                start = at + len(opening)
                break
        else:
            if not rendered.startswith(OTHER[0], at):
                raise ValueError(f"no turn opens at {at}")
            end_role = rendered.index(OTHER[1], at)
            role = unescape(rendered[at + len(OTHER[0]):end_role].replace(ESCAPE + "3", "]"))
            start, closing = end_role + len(OTHER[1]), OTHER[2]
        end = rendered.index(closing, start)
        if found := CONTROL.search(rendered, start, end):
            raise ValueError(f"a mark inside a text at {found.start()}")
        at = end + len(closing)
        yield role, start, end, at


def recovered(rendered: str) -> list[tuple[str, str]] | None:
    try:
        return [(role, unescape(rendered[start:end])) for role, start, end, _ in parse(rendered)]
    except ValueError:
        return None


def round_trip(role: str, text: str) -> tuple[str, int]:
    """The rendered turn and the lowest escape level at which parsing it gives the source back."""
    for level in range(LEVELS):
        rendered = render_turn(role, text, level)
        if recovered(rendered) == [(role, text)]:
            return rendered, level
    raise ValueError("a turn does not survive the round trip")  # not reached: level 2 leaves no bracket


def formatted_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the source with ``rendered`` and the escape ``level``, turn by turn, where they lie."""
    source = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                                  F.coalesce("text", F.lit("")).alias("text"))
    schema = T.StructType([*source.schema.fields, T.StructField("rendered", T.StringType()), T.StructField("level", T.IntegerType())])

    def render(batches):
        for batch in batches:
            out = [round_trip(r, t) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in out], pa.string()),
                                              pa.array([n for _, n in out], pa.int32())], names=schema.names)

    return source.mapInArrow(render, schema)


def ordered_turns(formatted: DataFrame) -> DataFrame:
    """Turns with each conversation in one partition, in order; concatenated, ``rendered`` is the formatted conversation."""
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of every conversation, read back from its rendered turns alone.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, escaped_turns. Turns stream through a
    running digest, so a conversation of any length needs the memory of one turn.
    """
    kind = formatted.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
                           T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()),
                           T.StructField("formatted_chars", T.LongType()), T.StructField("escaped_turns", T.LongType())])

    def digest(batches):
        none = object()
        current = none
        done: list[tuple] = []

        def close():
            done.append((current, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, escaped))

        def flush():
            batch = pa.RecordBatch.from_pylist([dict(zip(schema.names, row)) for row in done], schema=arrow)
            done.clear()
            return batch

        arrow = pa.schema([("conv_id", id_type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                           ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("escaped_turns", pa.int64())])
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "rendered", "level"))
            for conv, rendered, level in zip(*columns):
                if current is none or conv != current:
                    if current is not none:
                        close()
                    current, n, loss_chars, chars, escaped = conv, 0, 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                for role, start, end, _ in parse(rendered):
                    text = unescape(rendered[start:end])
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                    if role in LOSS_ROLES:
                        loss.update(text.encode())
                        loss_chars += len(text)
                chars += len(rendered)
                escaped += level > 0
            if len(done) >= 10_000:
                yield flush()
        if current is not none:
            close()
        if done:
            yield flush()

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(kind)
    return ordered_turns(formatted).select("conv_id", "rendered", "level").mapInArrow(digest, schema)


def loss_spans(rendered: str) -> list[tuple[int, int]]:
    """Character spans of a formatted conversation that are under the loss mask."""
    return [(start, end) for role, start, end, _ in parse(rendered) if role in LOSS_ROLES]
