"""State machines over ordered rows, run as a parallel prefix over transition functions.

The letters of a run of rows compose to one table (state before -> state after). Runs of at most ``fan`` rows are composed
where they lie, then runs of ``fan`` runs, and so on up to one table a key; the states before each run are handed down
again. No task ever holds more than ``fan`` entries of a key, so one key with any number of rows spreads over all tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN = 256


@dataclass(frozen=True)
class Machine:
    """``tables[letter][state]`` is the next state; state 0 is the first."""

    tables: tuple[tuple[int, ...], ...]

    @property
    def size(self) -> int:
        return len(self.tables[0])


def _ints(values) -> Column:
    return F.array(*[F.lit(int(v)) for v in values])


def look_up(values, index: Column) -> Column:
    """Entry of a small fixed list."""
    return F.get(_ints(values), index)


def _compose(machine: Machine, table_of) -> Column:
    return F.aggregate("items", _ints(range(machine.size)), lambda done, x: F.transform(done, lambda s: F.get(table_of(x), s)))


def _levels(rows: DataFrame, machine: Machine, key: str, order: str, letter: str, fan: int) -> list[DataFrame]:
    """Levels of the tree, leaves first: (key, run, items, table, n), where an item is a row or a run of the level below."""
    low, high = rows.agg(F.min(order), F.max(order)).first()
    low, high = low or 0, high or 0
    fixed = F.array(*[_ints(t) for t in machine.tables])
    leaf = rows.select(key, F.floor((F.col(order) - low) / fan).alias("run"), F.struct(
        F.col(order).cast("bigint").alias("at"), F.col(letter).cast("int").alias("letter")).alias("item"))
    grouped = leaf.groupBy(key, "run").agg(F.array_sort(F.collect_list("item")).alias("items"))
    levels = [grouped.withColumns({"table": _compose(machine, lambda x: F.get(fixed, x["letter"])), "n": F.size("items").cast("bigint")})]
    while fan ** len(levels) <= high - low:
        below = levels[-1].select(key, F.floor(F.col("run") / fan).alias("up"), F.struct(
            F.col("run").alias("at"), "table", "n").alias("item"))
        grouped = below.groupBy(key, F.col("up").alias("run")).agg(F.array_sort(F.collect_list("item")).alias("items"))
        levels.append(grouped.withColumns({"table": _compose(machine, lambda x: x["table"]), "n": F.aggregate(
            "items", F.lit(0).cast("bigint"), lambda a, x: a + x["n"])}))
    return levels


def final_states(rows: DataFrame, machine: Machine, letter: str = "letter", key: str = "conv_id", order: str = "turn", fan: int = FAN) -> DataFrame:
    """(key, state, n): the state after the last row and the number of rows of every key."""
    return _levels(rows, machine, key, order, letter, fan)[-1].select(key, F.get("table", F.lit(0)).alias("state"), "n")


def states(rows: DataFrame, machine: Machine, letter: str = "letter", key: str = "conv_id", order: str = "turn", fan: int = FAN) -> DataFrame:
    """(key, order, letter, state, pos): the state before every row and the number of rows before it.

    ``order`` is an integer that identifies a row of its key; rows of equal order are taken in the order of their letters.
    """
    levels = _levels(rows, machine, key, order, letter, fan)
    fixed = F.array(*[_ints(t) for t in machine.tables])
    start = levels[-1].select(key, "run", "items", F.lit(0).alias("state"), F.lit(0).cast("bigint").alias("pos"))
    for depth in range(len(levels) - 1, -1, -1):
        leaf = depth == 0
        begun = lambda x, state, pos: F.struct(x["at"].alias("at"), (x["letter"] if leaf else F.lit(0)).alias("letter"),
                                               state.alias("state"), pos.alias("pos"))
        kind = "array<struct<at:bigint,letter:int,state:int,pos:bigint>>"
        after = lambda x, state: F.get(F.get(fixed, x["letter"]) if leaf else x["table"], state)
        walked = F.aggregate(
            "items", F.struct(F.col("state").alias("state"), F.col("pos").alias("pos"), F.array().cast(kind).alias("out")),
            lambda a, x: F.struct(after(x, a["state"]).alias("state"), (a["pos"] + (F.lit(1) if leaf else x["n"])).alias("pos"),
                                  F.concat(a["out"], F.array(begun(x, a["state"], a["pos"]))).alias("out")))
        handed = start.select(key, F.explode(walked["out"]).alias("x")).select(key, "x.*")
        if not leaf:
            start = levels[depth - 1].select(key, "run", "items").join(handed.select(key, F.col("at").alias("run"), "state", "pos"), [key, "run"])
    return handed.withColumnRenamed("at", order)
