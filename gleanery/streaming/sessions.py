"""Dialogue memory and page intake over streams."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gleanery import constants as K
from gleanery.config import DEFAULTS, Settings
from gleanery.functions import text as T
from gleanery.operators.dialogue import SESSION_ROW, memory_machine


def _named(text: str) -> tuple[list[str], list[str]]:
    """Codes and names in a text, as ``functions.text.extract_codes`` and the name pattern give them."""
    return sorted({f"{K.CODE_PREFIX} {n.upper()}" for _, n in re.findall(K.CODE_STRICT, text)}), re.findall(K.PERSON_NAME, text)


def _taken_in(text: str, last: dict) -> str:
    """A user's text with pronouns replaced by the last course and person, each only if the text names none."""
    for own, pattern, entity in zip(_named(text), (K.COURSE_PRONOUN, K.PERSON_PRONOUN), (last["course"], last["person"])):
        text = text if own or not entity else re.sub(pattern, lambda _: entity, text, flags=re.I)
    return text


def _summary(facts: list) -> str:
    """Same text as ``operators.dialogue.summary_text``."""
    code = [f"discussed course {c[-1]}" for c, _ in facts if c][-1:]
    name = [f"discussed faculty member {n[-1]}" for _, n in facts if n][-1:]
    labels = [label for c, n in facts for label, there in (
        (f"courses ({', '.join(c[:3])})", c), (f"faculty ({''.join(n[:1])})", n)) if there]
    topics = "; ".join(list(dict.fromkeys(labels))[:4])
    return f"User and assistant {', '.join([*code, *name, *(['topics: ' + topics] if topics else [])])}."


def session_stream(turns: DataFrame, settings: Settings = DEFAULTS, idle: str | None = None) -> DataFrame:
    """Session state after every turn of a stream (conv_id, turn, role, text), the rows of ``dialogue.session_states``.

    The state of a session is one small JSON value: the state number of the memory machine, the facts of the turns held, the
    summary and the last entities. A session that stays ``idle`` (milliseconds) is dropped. Turns of one micro-batch are
    taken in turn order; later batches are expected to hold later turns.
    """
    columns = [c.split()[0] for c in SESSION_ROW.split(", ")]
    machine, held, taken = memory_machine(settings)
    fresh = {"at": 0, "facts": [], "summary": "", "course": "", "person": "", "program": ""}

    def advance(s: dict, role: str, text: str) -> str:
        text = _taken_in(text, s) if role == "user" else text
        codes, names = _named(text)
        people = [n for n in names if n.lower() not in K.DIALOG_NAME_STOPLIST]
        program = re.search(K.PROGRAM_MENTION, text, re.I)
        s["course"], s["person"] = (codes or [s["course"]])[-1], (people or [s["person"]])[-1]
        s["program"] = program.group(0).strip() if program else s["program"]
        spoken = int(role == "assistant")
        goes = taken[s["at"]] if spoken else 0
        facts, s["at"] = [*s["facts"], (codes, names)], machine.tables[spoken][s["at"]]
        if goes:
            window = facts[-(goes + held[s["at"]]):]
            s["summary"] = _summary(window[:goes])
        s["facts"] = facts[-held[s["at"]]:]
        return text

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        session = json.loads(state.get[0]) if state.exists else {**fresh}
        rows = []
        for r in pd.concat(list(batches)).sort_values("turn").itertuples(index=False):
            told = advance(session, r.role, r.text or "")
            rows.append((key[0], r.turn, r.role, told, held[session["at"]], *[session[c] for c in ("summary", "course", "person", "program")]))
        state.update((json.dumps(session),))
        if idle:
            state.setTimeoutDuration(int(idle))
        yield pd.DataFrame(rows, columns=columns)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return turns.select("conv_id", "turn", "role", "text").groupBy("conv_id").applyInPandasWithState(
        step, SESSION_ROW, "session string", "append", timeout)


def distinct_page_stream(pages: DataFrame, time_col: str, delay: str = "1 hour", text_col: str = "content") -> DataFrame:
    """First page of every content hash seen within the watermark delay; state older than the watermark is dropped."""
    hashed = pages.withColumn("content_hash", T.content_hash(F.col(text_col)))
    return hashed.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["content_hash"])


def late_header_stream(pages: DataFrame, headers: DataFrame, time_col: str, delay: str = "10 minutes") -> DataFrame:
    """Pages joined with Last-Modified headers that arrive up to ``delay`` later; pages without one keep their value."""
    p = pages.withWatermark(time_col, delay).alias("p")
    h = headers.select(F.col("url").alias("h_url"), F.col("last_modified").alias("late"), F.col(time_col).alias("h_time")).withWatermark("h_time", delay)
    near = (F.col("h_url") == F.col("p.url")) & (F.col("h_time") >= F.col(f"p.{time_col}")) & (
        F.col("h_time") <= F.col(f"p.{time_col}") + F.expr(f"interval {delay}"))
    joined = p.join(h, near, "left_outer")
    return joined.withColumn("last_modified", F.coalesce(F.nullif("last_modified", F.lit("")), "late", F.lit(""))).drop("h_url", "late", "h_time")
