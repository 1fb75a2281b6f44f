"""Documents to chunks: routing by page type and the five strategies, plus the older character splitter."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery import constants as K
from gleanery.config import DEFAULTS, Settings
from gleanery.functions import text as T
from gleanery.models import Embedder
from gleanery.operators.pages import course_records

_PIECES = "array<struct<i:int,text:string>>"
SENTENCE = r"[^.!?\n]+[.!?]*\s*|[.!?]+\s*|\s+"
WORD = r"\w+|[^\w\s]"


def count_tokens(text: str) -> int:
    """Words and punctuation marks; stands in for a model tokenizer."""
    return len(re.findall(WORD, text))


# --- packing helpers (plain functions on one text) -------------------------------------------------
def split_sentences(text: str, budget: int, counter: Callable[[str], int]) -> list[tuple[str, int]]:
    """Paragraph and sentence pieces with their token counts; a piece over the budget is cut into words."""
    out = []
    for paragraph in re.split(r"(?<=\n\n)", text):
        for piece in re.findall(SENTENCE, paragraph):
            n = counter(piece)
            if n <= budget:
                out.append((piece, n))
            else:
                out.extend((w, counter(w)) for w in re.findall(r"\S+\s*|\s+", piece))
    return out


def pack(pieces: list[tuple[str, int]], budget: int, overlap: int) -> list[str]:
    """Greedy packing: fill up to the budget, then restart with the trailing pieces that fit into the overlap."""
    chunks, current, fresh = [], [], 0
    total = 0
    for text, n in pieces:
        if fresh and total + n > budget:
            chunks.append("".join(t for t, _ in current))
            keep, total = [], 0
            for piece in reversed(current):
                if total + piece[1] > overlap:
                    break
                keep.insert(0, piece)
                total += piece[1]
            current, fresh = keep, 0
        current.append((text, n))
        total += n
        fresh += 1
    if fresh:
        chunks.append("".join(t for t, _ in current))
    return [c.strip() for c in chunks if c.strip()]


def split_recursive(text: str, size: int, overlap: int, separators=("\n\n", "\n", ". ", " ", "")) -> list[str]:
    """Split at the coarsest separator that occurs, recursing into parts that stay too long, then merge with overlap."""
    separator, finer = next(((s, separators[i + 1:]) for i, s in enumerate(separators) if s == "" or s in text), ("", ()))
    if separator:
        # each part after the first keeps the separator in front of it
        head, *tail = text.split(separator)
        parts = [p for p in [head, *(separator + t for t in tail)] if p]
    else:
        parts = list(text)
    out, good = [], []
    for part in parts:
        if len(part) < size:
            good.append(part)
            continue
        out += _merge(good, size, overlap)
        good = []
        out += split_recursive(part, size, overlap, finer) if finer else [part]
    return out + _merge(good, size, overlap)


def _merge(parts: list[str], size: int, overlap: int) -> list[str]:
    out, window, total = [], [], 0
    for part in parts:
        if window and total + len(part) > size:
            out.append("".join(window).strip())
            while window and (total > overlap or total + len(part) > size):
                total -= len(window.pop(0))
        window.append(part)
        total += len(part)
    if window:
        out.append("".join(window).strip())
    return [x for x in out if x]


# --- piece columns --------------------------------------------------------------------------------
SLICE_CHARS = 1 << 20  # characters of text whose pieces a task holds at a time


def text_slices(texts: pa.Array, limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of texts with at most ``limit`` bytes, or one text, each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, "right")))
        yield start, stop
        start = stop


def _piece_lists(rows: list[list[str]]) -> pa.Array:
    sizes = [len(r) for r in rows]
    pieces = pa.StructArray.from_arrays([pa.array([i for n in sizes for i in range(n)], pa.int32()),
                                         pa.array([t for r in rows for t in r], pa.string())], ["i", "text"])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pieces)


def _pieces(cut: Callable[[str], list[str]], text: Column) -> Column:
    """Array of (i, text) chunks that ``cut`` makes of a text; rows leave slice by slice, so that a full batch costs no more memory."""
    @F.arrow_udf(_PIECES)
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for a, b in text_slices(texts):
                yield _piece_lists([cut(t or "") for t in texts.slice(a, b - a).to_pylist()])

    return split(text)


def sentence_pieces(text: Column, reserved: Column, settings: Settings = DEFAULTS,
                    counter: Callable[[str], int] = count_tokens) -> Column:
    """Array of (i, text) chunks; ``reserved`` texts (title, url, type) count against the token budget."""
    size, overlap = settings.chunk_size, settings.chunk_overlap

    def cut(text_: str, meta: str) -> list[str]:
        budget = max(size - counter(meta), overlap + 1)
        return pack(split_sentences(text_, budget, counter), budget, overlap)

    @F.arrow_udf(_PIECES)
    def split(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, metas in batches:
            for a, b in text_slices(texts):
                yield _piece_lists([cut(t or "", m or "") for t, m in zip(texts.slice(a, b - a).to_pylist(), metas.slice(a, b - a).to_pylist())])

    return split(text, reserved)


def recursive_pieces(text: Column, settings: Settings = DEFAULTS) -> Column:
    size, overlap = settings.legacy_chunk_chars, settings.legacy_chunk_overlap
    return _pieces(lambda t: split_recursive(t, size, overlap), text)


def semantic_pieces(text: Column, embedder: Embedder, settings: Settings = DEFAULTS) -> Column:
    """Cut where neighbouring sentence groups differ most: above the given quantile of the document's distances."""
    buffer, quantile = settings.semantic_buffer, settings.semantic_percentile

    def cut(text_: str) -> list[str]:
        sentences = re.findall(SENTENCE, text_)
        groups = ["".join(sentences[max(0, i - buffer):i + buffer + 1]) for i in range(len(sentences))]
        if len(sentences) < 2:
            return [text_.strip()] if text_.strip() else []
        v = embedder.encode(groups)
        distances = 1.0 - np.sum(v[:-1] * v[1:], axis=1)
        ends = np.flatnonzero(distances > np.quantile(distances, quantile)) + 1
        bounds = [0, *ends.tolist(), len(sentences)]
        chunks = ("".join(sentences[a:b]).strip() for a, b in zip(bounds, bounds[1:]))
        return [c for c in chunks if c]

    return _pieces(cut, text)


# --- strategies -----------------------------------------------------------------------------------
def route(page_type: Column) -> Column:
    return (F.when(page_type.isin(*K.ATOMIC_TYPES), "faculty_atomic")
            .when(page_type.isin(*K.COURSE_TYPES), "course_atomic")
            .when(page_type.isin(*K.SECTION_TYPES), "section")
            .when(page_type.isin(*K.SEMANTIC_TYPES), "semantic")
            .otherwise("sentence"))


def _finish(df: DataFrame, settings: Settings) -> DataFrame:
    """Trim, drop short chunks, add word counts, course codes and a reproducible id."""
    out = df.withColumn("text", T.strip(F.col("text"))).withColumn("chunk_words", T.word_count(F.col("text")))
    return out.where(F.col("chunk_words") >= settings.min_chunk_words).withColumns({
        "courses_in_chunk": T.extract_codes(F.col("text")),
        "chunk_id": F.md5(F.concat_ws("\u001f", F.col("id").cast("string"), "chunk_strategy",
                                      F.col("chunk_index").cast("string"), "text"))})


def _nth_heading(i: Column) -> Column:
    last = F.size("heading_path") - 1
    return F.coalesce(F.get("heading_path", F.least(i, last)), F.lit(""))


_META = ("id", "url", "title", "page_type", "source", "heading_path")


def _reserved() -> Column:
    return F.concat_ws(" ", "url", "title", "page_type")


def chunk_atomic(docs: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    return _finish(docs.select(*_META, "text", F.lit(0).alias("chunk_index"), F.col("title").alias("heading"),
                               F.lit("faculty_atomic").alias("chunk_strategy")), settings)


def chunk_courses(docs: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One chunk per course record found in the text."""
    found = T.pos_unnest(docs, course_records(F.col("text"), K.COURSE_BLOCK_80, 500), "chunk_index", "c", *_META)
    listed = F.when(F.size("c.prereqs") > 0, F.concat(F.lit("Prerequisites: "), F.array_join("c.prereqs", ", "), F.lit("\n"))).otherwise("")
    body = F.when(F.col("c.description") != "", F.concat(F.lit("\n"), "c.description")).otherwise("")
    text = F.concat("c.code", F.lit(" — "), "c.title", F.lit("\nCredits: "), "c.credits", F.lit("\n"), listed, body)
    return _finish(found.select(
        *_META, text.alias("text"), "chunk_index", F.concat("c.code", F.lit(": "), "c.title").alias("heading"),
        F.lit("course_atomic").alias("chunk_strategy")), settings)


def sections(docs: DataFrame) -> DataFrame:
    """(section_no, heading, text, words) of every ``## `` section; section 0 takes the title and loses its first line.

    Sections are built inside the row before they are unnested, so later filters cannot evaluate the steps again.
    """
    def build(part, i):
        def of_lines(part_, lines):
            heading = F.when(i > 0, T.strip(F.get(lines, 0))).otherwise(F.col("title"))
            body = F.when(F.size(lines) > 1, T.strip(F.get(lines, 1))).otherwise(part_)
            return T.let(heading, lambda h: T.let(
                F.when(h != "", F.concat(F.lit("## "), h, F.lit("\n\n"), body)).otherwise(body),
                lambda t: F.struct(i.alias("section_no"), h.alias("heading"), t.alias("text"), T.word_count(t).alias("words"))))

        return T.let(T.strip(part), lambda p: F.when(p != "", T.let(F.split(p, "\n", 2), lambda ls: of_lines(p, ls))))

    built = F.array_compact(F.transform(F.split("text", r"(?U)\n##\s+"), build))
    return T.unnest(docs, built, "s", *_META).select(*_META, "s.section_no", "s.heading", "s.text", "s.words")


def chunk_sections(docs: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Short sections whole, long ones packed by sentence under index ``section * 100 + part``."""
    parts = sections(docs)
    short = F.col("words") <= settings.chunk_size
    whole = parts.where(short).select(*_META, "text", F.col("section_no").alias("chunk_index"), "heading",
                                      F.lit("section").alias("chunk_strategy"))
    pieces = T.unnest(parts.where(~short), sentence_pieces(F.col("text"), _reserved(), settings), "p", *_META, "section_no", "heading")
    split = pieces.select(*_META, F.col("p.text").alias("text"), (F.col("section_no") * 100 + F.col("p.i")).alias("chunk_index"),
                          "heading", F.lit("section_split").alias("chunk_strategy"))
    return _finish(whole.unionByName(split), settings)


def chunk_sentences(docs: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    pieces = T.unnest(docs, sentence_pieces(F.col("text"), _reserved(), settings), "p", *_META)
    return _finish(pieces.select(*_META, F.col("p.text").alias("text"), F.col("p.i").alias("chunk_index"),
                                 _nth_heading(F.col("p.i")).alias("heading"), F.lit("sentence").alias("chunk_strategy")), settings)


def chunk_semantic(docs: DataFrame, embedder: Embedder, settings: Settings = DEFAULTS) -> DataFrame:
    long = docs.where(T.word_count(F.col("text")) >= settings.semantic_min_words)
    pieces = T.unnest(long, semantic_pieces(F.col("text"), embedder, settings), "p", *_META)
    return _finish(pieces.select(*_META, F.col("p.text").alias("text"), F.col("p.i").alias("chunk_index"),
                                 _nth_heading(F.col("p.i")).alias("heading"), F.lit("semantic").alias("chunk_strategy")), settings)


def chunk_documents(docs: DataFrame, embedder: Embedder, settings: Settings = DEFAULTS) -> DataFrame:
    """Route every document to its strategy; documents whose strategy leaves nothing are packed by sentence."""
    strategy = route(F.col("page_type"))
    of = lambda name: docs.where(strategy == name)
    first = (chunk_courses(of("course_atomic"), settings)
             .unionByName(chunk_sections(of("section"), settings))
             .unionByName(chunk_semantic(of("semantic"), embedder, settings)))
    left_over = docs.where(strategy != "faculty_atomic").join(first.select("id").distinct(), "id", "left_anti")
    return (chunk_atomic(of("faculty_atomic"), settings).unionByName(first)
            .unionByName(chunk_sentences(left_over, settings)))


def chunk_legacy(docs: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Older splitter: title in front, recursive character windows, parts under the minimum length dropped."""
    text = F.when(F.col("title") != "", F.concat("title", F.lit("\n\n"), "content")).otherwise(F.col("content"))
    pieces = T.unnest(docs, recursive_pieces(text, settings), "p", "url", "title", "page_type", "source", "filename")
    return pieces.where(F.length("p.text") >= settings.legacy_min_chars).select(
        "url", "title", "page_type", "source", "filename", F.col("p.text").alias("text"), F.col("p.i").alias("chunk_idx"))


def legacy_id(url: Column, chunk_idx: Column, row: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("_", url, chunk_idx.cast("string"), row.cast("string"))), 1, 16)
