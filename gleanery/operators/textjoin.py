"""Exact substring join: which of many patterns occur in which texts.

Patterns of bounded total length become one automaton that is shipped to the texts: every text is read once, whatever the
number and the length of the patterns, and nothing but the hits leaves a task. Beyond that bound each pattern is
looked up by the rarest of its grams; the candidates are verified against the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions.text import unnest

AUTOMATON_CHARS = 1 << 20  # characters of all patterns together that one automaton may hold (some 50 MB in a worker)
GRAM = 6
SALTS = 16  # parts into which the texts that share a gram are dealt
HITS = 100_000  # rows of a record batch


def contains_pairs(texts: DataFrame, patterns: DataFrame, automaton_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """Distinct (id, pattern) with ``contains(text, pattern)``; ``texts`` is (id, text), ``patterns`` is (pattern).

    Null texts, null patterns and empty patterns take no part.
    """
    wanted = patterns.where(F.length("pattern") > 0).select("pattern").distinct()
    size = wanted.agg(F.sum(F.length("pattern"))).first()[0]
    held = texts.where(F.length("text") > 0).select("id", "text")
    if size is None:
        return held.select("id", F.lit("").alias("pattern")).where(F.lit(False))
    found = _by_automaton(held, wanted) if size <= automaton_chars else _by_grams(held, wanted)
    return found.distinct()


def _by_automaton(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    shipped = texts.sparkSession.sparkContext.broadcast([r[0] for r in wanted.collect()])  # bounded by the caller
    schema = T.StructType([texts.schema["id"], T.StructField("pattern", T.StringType())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for pattern in shipped.value:
            automaton.add_word(pattern, pattern)
        automaton.make_automaton()
        for batch in batches:
            ids, column = batch.column("id"), batch.column("text")
            rows, hits = [], []
            for i in range(batch.num_rows):
                found = {pattern for _, pattern in automaton.iter(column[i].as_py())}
                rows += [i] * len(found)
                hits += found
                if len(hits) >= HITS or (hits and i + 1 == batch.num_rows):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(hits, pa.string())], names=schema.names)
                    rows, hits = [], []

    return texts.mapInArrow(search, schema)


def _grams(text: Column, length: int) -> Column:
    """Different substrings of a length; the look-ahead lets one pass find those that overlap."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{length}}}))"), F.lit(1)))


def _by_grams(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Each pattern meets the texts that hold the rarest of its grams; a pattern below the gram length is its own gram."""
    size = F.least(F.length("pattern"), F.lit(GRAM))
    lengths = range(1, GRAM + 1)
    of_size = F.array(*[F.when(size == n, _grams(F.col("pattern"), n)).otherwise(F.array().cast("array<string>")) for n in lengths])
    own = unnest(wanted, F.flatten(of_size), "gram", "pattern").select("pattern", "gram")
    used = [r[0] for r in wanted.select(size.alias("n")).distinct().collect()]  # at most GRAM values
    each = unnest(texts, F.flatten(F.array(*[_grams(F.col("text"), n) for n in sorted(used)])), "gram", "id").select("id", "gram")
    met = each.join(own.select("gram").distinct(), "gram", "left_semi")
    often = met.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # a gram that no text holds rules its pattern out
    known = own.join(often, "gram", "left").select("pattern", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram").alias("g"))
    rarest = known.groupBy("pattern").agg(F.min("g").alias("g")).where("g.n > 0").select("pattern", "g.gram")
    dealt = rarest.withColumn("salt", F.explode(F.array(*[F.lit(n) for n in range(SALTS)])))
    candidates = each.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(dealt, ["gram", "salt"]).select(
        F.col("id").alias("at"), "pattern").distinct()
    return texts.join(candidates, F.col("id").eqNullSafe(F.col("at"))).where(F.contains("text", "pattern")).select("id", "pattern")
