"""Raw web pages to page records: text extraction, typing, structured fields, gates, duplicates and boilerplate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery import constants as K
from gleanery.config import DEFAULTS
from gleanery.functions import html as H
from gleanery.functions import text as T
from gleanery.functions import urls as U
from gleanery.functions.text import free_name
from gleanery.plans.sizing import fits
from gleanery.session import ensure_checkpoint_dir

SHIPPED_BLOCKS = 500_000  # digests of frequent blocks that may be sent to every task (8 MB)
COURSE_STRUCT = "array<struct<code:string,title:string,credits:string,description:string,prereqs:array<string>>>"


def render_blocks(blocks: Column) -> Column:
    """Text of (kind, text) blocks that keeps headings, paragraphs, tables and list items on lines of their own."""
    def line(b: Column) -> Column:
        kind, text = b["kind"], b["text"]
        return (F.when(kind == "heading", F.concat(F.lit("\n## "), text, F.lit("\n")))
                .when(kind.isin("paragraph", "table"), F.concat(F.lit("\n"), text, F.lit("\n")))
                .when(kind == "item", F.concat(F.lit("• "), text)).otherwise(text))

    return F.array_join(F.transform(blocks, line), "\n")


def extract_html(pages: DataFrame, html_col: str = "html", closed_references: bool = False) -> DataFrame:
    """Append ``title``, cleaned ``content`` and the anchors of every page. Null is an empty page.

    Every page is parsed once. ``closed_references`` leaves references without a semicolon in titles as written, as HTML
    does not; pages that hold one are then parsed again for their title.
    """
    schema = "title string, blocks array<struct<kind:string,text:string>>, anchors array<struct<href:string,text:string>>"

    @F.pandas_udf(schema)
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for htmls in batches:
            read = [H.Page(x) for x in htmls]
            titles = [H.written_title(x, p) if closed_references else p.title() for x, p in zip(htmls, read)]
            yield pd.DataFrame({"title": titles,
                                "blocks": [[{"kind": k, "text": t} for k, t in p.content()] for p in read],
                                "anchors": [[{"href": h, "text": t} for h, t in p.links()] for p in read]})

    # not to be evaluated again for filters and projections above
    out = pages.withColumn("parsed", parse.asNondeterministic()(F.col(html_col)))
    return out.select(*pages.columns, F.col("parsed.title").alias("title"),
                      T.clean_lines(render_blocks(F.col("parsed.blocks"))).alias("content"), F.col("parsed.anchors").alias("anchors"))


def page_records(pages: DataFrame, source: Column | None = None) -> DataFrame:
    """Page records from (url, title, content, anchors[, html]) with the crawl's word gate applied."""
    content, url = F.col("content"), F.col("url")
    links = F.transform(F.col("anchors"), lambda a: U.resolve(url, a["href"]))
    is_pdf = lambda u: F.lower(u).endswith(".pdf")
    catalog = F.contains(url, F.lit(K.CATALOG_HOST))
    return pages.withColumns({
        "page_type": U.page_type(url),
        "content_hash": T.content_hash(content),
        "word_count": T.word_count(content),
        "source": source if source is not None else F.when(catalog, "catalog").otherwise("department"),
        "heading_path": T.headings(content),
        "courses_mentioned": T.loose_codes(content),
        "links": links,
    }).withColumns({
        "pdf_links": F.filter("links", lambda u: is_pdf(u) & U.is_kept_pdf(u)),
        "child_urls": F.transform(F.filter("links", lambda u: U.is_allowed(u) & ~is_pdf(u)), lambda u: U.canonical_url(u)),
    }).withColumn("outgoing_links", F.slice("child_urls", 1, 50)).where(
        F.col("word_count") >= DEFAULTS.crawl_min_words)


def faculty_fields(pages: DataFrame, text_col: str = "content") -> DataFrame:
    """Struct ``faculty`` with contact fields of a profile page; absent fields are null."""
    text = F.col(text_col)
    low = F.lower(text)
    mails = F.filter(F.transform(
        F.filter("anchors", lambda a: a["href"].startswith("mailto:")),
        lambda a: T.strip(F.replace(a["href"], F.lit("mailto:"), F.lit("")))),
        lambda m: F.contains(m, F.lit(K.MAIL_DOMAIN)))
    sites = F.array_sort(F.array_distinct(F.transform(F.filter(
        "anchors",
        lambda a: a["href"].startswith("http") & U.is_external_site(a["href"])
        & F.exists(F.array(*[F.lit(k) for k in K.SITE_KEYWORDS]), lambda k: F.contains(F.lower(a["text"]), k))),
        lambda a: a["href"])))
    none_if_empty = lambda c: F.nullif(c, F.lit(""))
    return pages.withColumn("faculty", F.struct(
        F.get(mails, 0).alias("email"),
        academic_rank(low).alias("rank"),
        none_if_empty(T.first_match(text, K.OFFICE, 0)).alias("office"),
        none_if_empty(T.first_match(text, K.PHONE, 0)).alias("phone"),
        research_areas(text).alias("research_areas"),
        sites.alias("personal_websites")))


def academic_rank(low: Column, faithful: bool = True) -> Column:
    """First rank, in the listed order, that occurs in the lower-cased text; ``faithful=False`` tests longer names first."""
    names = K.RANKS if faithful else tuple(sorted(K.RANKS, key=len, reverse=True))
    out = F.lit(None).cast("string")
    for name in reversed(names):
        out = F.when(F.contains(low, F.lit(name.lower())), F.lit(name)).otherwise(out)
    return out


def research_areas(text: Column, limit: int = 8) -> Column:
    line = T.first_match(text, K.RESEARCH_LINE, 1, ignore_case=True)
    parts = F.transform(F.split(line, "[;,]"), T.strip)
    return F.slice(F.filter(parts, lambda p: p != ""), 1, limit)


def course_records(text: Column, block: str = K.COURSE_BLOCK, tail: int = 600) -> Column:
    """Array of course structs found in a text, first occurrence of each code.

    The text is cut at the block matches: occurrence i's description runs from the end of its match to the next course
    code, or ``tail`` characters when no code follows.
    """
    # positions are found left to right; each search starts behind the previous match
    ends = lambda whole: F.aggregate(
        whole, F.struct(F.lit(1).alias("pos"), F.array().cast("array<int>").alias("ends")),
        lambda acc, m: F.struct(
            (F.position(m, text, acc["pos"]) + F.length(m)).alias("pos"),
            F.concat(acc["ends"], F.array(F.position(m, text, acc["pos"]) + F.length(m))).alias("ends")))["ends"]

    def record(m, end):
        code, title, credits = (F.regexp_extract(m, T.rx(f"^{block}\\z"), g) for g in (1, 2, 3))
        rest = F.substring(text, end, F.length(text))
        before_next = F.get(F.split(rest, T.rx(K.CODE_LOOSE, ignore_case=True), 2), 0)
        has_next = T.matches(rest, K.CODE_LOOSE, ignore_case=True)
        described = F.when(has_next, before_next).otherwise(F.substring(rest, 1, tail))
        return T.let(F.substring(T.collapse(T.strip(described)), 1, 400), lambda description: F.struct(
            T.normalize_code(code).alias("code"),
            F.regexp_replace(T.strip(title), r"[,;:.]+\z", "").alias("title"),
            F.coalesce(F.nullif(credits, F.lit("")), F.lit("3")).alias("credits"),
            description.alias("description"),
            F.transform(T.find_all(T.first_match(description, K.COURSE_PREREQ_LINE, 1, ignore_case=True), K.CODE_LOOSE, 1,
                                   ignore_case=True), lambda c: T.normalize_code(c)).alias("prereqs")))

    records = T.let(T.find_all(text, block, 0), lambda whole: F.zip_with(whole, ends(whole), record))
    return T.let(records, lambda rs: F.filter(rs, lambda r, i: (
        F.array_position(F.transform(rs, lambda x: x["code"]), r["code"]) == i + 1)))


def distinct_pages(pages: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First row of every key by the given order.

    The winner of each key is found by a map-side combined minimum over the order columns, so a key that holds a large
    share of the rows costs one row per task, not one sort; a semi join then keeps the winning rows whole.
    """
    first = pages.groupBy(key).agg(F.min(F.struct(*order)).alias("first")).select(
        *[F.col(f"first.{c}").alias(c) for c in order])
    return pages.join(first, order, "left_semi")


# --- boilerplate ----------------------------------------------------------------------------------
def block_keys(text: Column, separator: str = "\n{2,}") -> Column:
    """Normalized blocks of a text, in order."""
    return F.transform(F.split(text, separator), T.fingerprint_text)


def block_counts(docs: DataFrame, text_col: str, separator: str = "\n{2,}", min_chars: int = 20) -> DataFrame:
    """(block, n): occurrences of every block of at least ``min_chars`` characters."""
    return (T.unnest(docs, block_keys(F.col(text_col), separator), "block")
            .where(F.length("block") >= min_chars).groupBy("block").agg(F.count("*").alias("n")))


def _block_digests(text: Column, separator: str, min_chars: int) -> Column:
    """128-bit digests (a, b) of the blocks of a text, in order; null for a block that is too short to count."""
    return F.transform(block_keys(text, separator), lambda k: F.when(F.length(k) >= min_chars, F.struct(
        F.xxhash64(k).alias("a"), F.xxhash64(F.lit(1), k).alias("b"))))


def strip_boilerplate(
    docs: DataFrame, id_col: str, text_col: str, separator: str = "\n{2,}", joiner: str = "\n\n",
    threshold: int = DEFAULTS.bp_threshold, min_chars: int = 20, shipped: int = SHIPPED_BLOCKS,
) -> DataFrame:
    """Remove blocks that occur at least ``threshold`` times in the corpus and rebuild every text.

    One scan counts block digests, combined before their exchange. If at most ``shipped`` of them are frequent they are sent
    to the tasks, and a second scan filters every text where it lies. More of them meet the documents' own digests in a join,
    and a document learns which of its blocks to drop. ``id_col`` identifies a document.
    """
    own = _block_digests(F.col(text_col), separator, min_chars)
    ensure_checkpoint_dir(docs.sparkSession)
    frequent = (T.unnest(docs, F.array_compact(own), "d").groupBy("d").agg(F.count("*").alias("n"))
                .where(F.col("n") >= threshold).select("d").checkpoint())
    flags = free_name(docs, "_drop")
    if fits(frequent, shipped):
        flagged = docs.withColumn(flags, _in_digests(frequent.select("d.a", "d.b"))(F.transform(own, lambda d: d["a"]), F.transform(own, lambda d: d["b"])))
        wanted = lambda i: ~F.get(flags, i)
    else:
        listed = T.unnest(docs, F.array_distinct(F.array_compact(own)), "d", id_col).join(frequent, "d", "left_semi")
        drop = listed.groupBy(id_col).agg(F.collect_set("d").alias(flags))
        flagged = docs.join(drop, id_col, "left")
        wanted = lambda i: ~F.coalesce(F.array_contains(flags, F.get(own, i)), F.lit(False))
    kept = F.filter(F.split(text_col, separator), lambda _, i: wanted(i))
    return flagged.withColumn(text_col, T.strip(F.array_join(kept, joiner))).drop(flags)


def _in_digests(digests: DataFrame):
    """Column function of two long arrays: which places hold a pair of ``digests`` (a, b), whose number is bounded by the caller."""
    pairs = np.array([tuple(r) for r in digests.collect()], np.int64).reshape(-1, 2)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    starts = np.flatnonzero(np.append(True, pairs[1:, 0] != pairs[:-1, 0]))[:len(pairs)]
    most = int(np.diff(np.append(starts, len(pairs))).max(initial=0))  # pairs that share a first half
    held = digests.sparkSession.sparkContext.broadcast(pairs)

    @F.arrow_udf("array<boolean>")
    def check(first: pa.Array, second: pa.Array) -> pa.Array:
        known = held.value
        sizes = pc.fill_null(pc.list_value_length(first), 0).to_numpy(zero_copy_only=False)
        valid = first.flatten().is_valid().to_numpy(zero_copy_only=False)
        a, b = (pc.fill_null(x.flatten(), 0).to_numpy(zero_copy_only=False) for x in (first, second))
        hit, at = np.zeros(len(a), bool), np.searchsorted(known[:, 0], a)
        for j in range(most):
            place = np.minimum(at + j, len(known) - 1)
            hit |= (known[place, 0] == a) & (known[place, 1] == b)
        offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(hit & valid))

    return check.asNondeterministic()


def quality_gate(docs: DataFrame, text_col: str, min_words: int = DEFAULTS.crawl_min_words,
                 min_alpha: float = DEFAULTS.crawl_min_alpha) -> DataFrame:
    return docs.where((T.word_count(F.col(text_col)) >= min_words) & (T.alpha_ratio(F.col(text_col)) >= min_alpha))


def merge_last_modified(pages: DataFrame, headers: DataFrame) -> DataFrame:
    """Fill an empty ``last_modified`` from a (url, last_modified) table that arrived later."""
    late = headers.groupBy("url").agg(F.max("last_modified").alias("late"))
    return pages.join(late, "url", "left").withColumn(
        "last_modified", F.coalesce(F.nullif("last_modified", F.lit("")), "late", F.lit(""))).drop("late")


def attach_pdf_paths(pages: DataFrame, downloaded: DataFrame) -> DataFrame:
    """``pdf_paths``: local paths of the downloaded links of a page, in link order. ``downloaded`` is (link, path)."""
    listed = pages.select("url", F.posexplode("pdf_links").alias("pos", "link")).join(downloaded, "link")
    paths = listed.groupBy("url").agg(F.array_sort(F.collect_list(F.struct("pos", "path"))).alias("p"))
    return pages.join(paths, "url", "left").withColumn(
        "pdf_paths", F.coalesce(F.transform("p", lambda x: x["path"]), F.array().cast("array<string>"))).drop("p")


def directory_records(pages: DataFrame, html_col: str = "html", topics: int = 5) -> DataFrame:
    """People of directory pages: list items with a bold name of two words or more and an in-house mail address.

    The last entry of a name wins. ``pages`` needs an ordering column ``page_no``; ``topics`` bounds the topics of a person.
    """
    @F.pandas_udf("array<struct<bold:string,links:array<string>,text:string>>")
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for htmls in batches:
            yield pd.Series([[{"bold": b, "links": t, "text": x} for b, t, x in H.Page(h).items()] for h in htmls])

    items = pages.select("page_no", F.posexplode(parse.asNondeterministic()(F.col(html_col))).alias("pos", "i")).select("page_no", "pos", "i.*")
    text, first = F.col("text"), lambda found: F.coalesce(F.get(found, 0), F.lit(""))
    mails = F.transform(F.filter("links", lambda h: F.startswith(h, F.lit("mailto:"))), lambda h: T.strip(F.replace(h, F.lit("mailto:"), F.lit(""))))
    ranks = F.filter(F.array(*[F.lit(r) for r in K.DIRECTORY_RANKS]), lambda r: F.contains(text, r))
    listed = F.filter(F.transform(F.split(T.first_match(text, K.DIRECTORY_TOPICS), "[;,]"), T.strip), lambda t: t != "")
    people = items.select(
        "page_no", "pos", T.strip(T.replace_all(F.col("bold"), K.DEGREE_SUFFIX, "")).alias("name"),
        first(F.filter(mails, lambda m: F.contains(m, F.lit(K.MAIL_DOMAIN)))).alias("email"),
        T.first_match(text, K.DIRECTORY_OFFICE, 0).alias("office"), T.first_match(text, K.PHONE, 0).alias("phone"),
        F.coalesce(F.get(ranks, 0), F.lit("Faculty")).alias("rank"), F.slice(listed, 1, topics).alias("research_topics"),
        first(F.filter("links", lambda h: F.contains(h, F.lit("detail.html")))).alias("profile_url"))
    kept = people.where((T.word_count(F.col("name")) >= 2) & (F.col("email") != ""))
    fields = [c for c in people.columns if c not in ("page_no", "pos")]
    return kept.groupBy(F.col("name").alias("person")).agg(
        F.max_by(F.struct(*fields), F.struct("page_no", "pos")).alias("r")).select("r.*")
