"""Property graph from typed documents: mentions are extracted as rows, then merged into nodes and edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery import constants as K
from gleanery.functions import text as T

PROPERTIES = ("name", "title", "credits", "description", "prereqs", "url", "email", "rank", "office", "phone", "level")
# Course and Faculty nodes collect the first non-empty value of every field; the others keep their first mention whole.
MERGED_LABELS = ("Course", "Faculty")
_SLOTS = 1 << 20  # mention order is doc_no * _SLOTS + position in the document, so doc_no stays below 2**43
_LAST = _SLOTS - 1


def topic_terms(df: DataFrame, keys: list[str], text_col: str = "text", k: int = 6) -> DataFrame:
    """(keys, topic, n, rank): the k most frequent content words of every text; counted in place, without a shuffle."""
    return T.pos_unnest(df, T.topics(F.col(text_col), k), "pos", "t", *keys).select(
        *keys, "t.topic", F.col("t.n").cast("bigint").alias("n"), (F.col("pos") + 1).cast("bigint").alias("rank"))


def _mention(label: str, id_: Column, at: Column, **props: Column) -> Column:
    fields = [(props[p].cast("string") if p in props else F.lit(None).cast("string")).alias(p) for p in PROPERTIES]
    return F.struct(F.lit(label).alias("label"), id_.alias("id"), at.cast("int").alias("at"), *fields)


def _edge(src: Column, rel: str, dst: Column) -> Column:
    return F.struct(src.alias("src"), F.lit(rel).alias("rel"), dst.alias("dst"))


def course_blocks(text: Column) -> Column:
    """Array of course blocks: a code, the rest of its line and up to 15 following lines."""
    def fields(block):
        code = T.first_match(block, K.GRAPH_COURSE_BLOCK.split("[^", 1)[0], 1)
        first_line = F.get(F.split(block, "\n", 2), 0)
        return F.struct(
            F.upper(T.normalize_code(code)).alias("code"),
            T.strip(T.first_match(first_line, K.GRAPH_TITLE, 1, ignore_case=True)).alias("title"),
            F.nullif(T.first_match(block, K.GRAPH_CREDITS, 1, ignore_case=True), F.lit("")).alias("credits"),
            F.substring(T.strip(block), 1, 600).alias("description"), T.prerequisite_codes(block).alias("prereqs"),
            F.transform(T.topics(block), lambda t: t["topic"]).alias("topics"))

    return F.transform(T.find_all(text, K.GRAPH_COURSE_BLOCK, 0), fields)


# Every extractor appends ``mentions`` (in the order the entities are met, ``at``) and ``links``.
def extract_course_docs(docs: DataFrame) -> DataFrame:
    found = F.transform("blocks", lambda b: b["code"])
    codes = F.array_distinct(F.concat("courses_mentioned", T.extract_codes(F.col("text"))))
    url, empty = F.col("url"), F.lit("")
    of_block = lambda b, i: F.concat(
        F.array(_mention("Course", b["code"], i, title=b["title"], credits=b["credits"], description=b["description"],
                         prereqs=F.to_json(b["prereqs"]), url=url)),
        F.transform(b["prereqs"], lambda p: _mention("Course", F.upper(p), i, url=empty)),
        F.transform(b["topics"], lambda t: _mention("Topic", F.lower(t), i, name=t)))
    stubs = F.transform(F.array_except(codes, found), lambda c: _mention(
        "Course", F.upper(c), F.lit(_LAST), url=url, title=empty, description=empty))
    links = F.flatten(F.transform("blocks", lambda b: F.concat(
        F.transform(b["prereqs"], lambda p: _edge(b["code"], "REQUIRES", p)),
        F.transform(b["topics"], lambda t: _edge(b["code"], "COVERS", F.lower(t))))))
    return docs.withColumn("blocks", course_blocks(F.col("text"))).select(
        "doc_no", F.concat(F.flatten(F.transform("blocks", of_block)), stubs).alias("mentions"), links.alias("links"))


def extract_faculty_docs(docs: DataFrame) -> DataFrame:
    title = T.strip(F.coalesce("title", F.lit("")))
    fallback = T.strip(F.coalesce(F.get("faculty_names", 0), F.lit("")))
    codes = F.array_sort(F.array_distinct(F.concat("courses_mentioned", T.extract_codes(F.col("text")))))
    people = docs.withColumns({
        "person": F.when(F.length(title) < 3, fallback).otherwise(title), "codes": codes,
        "areas": F.transform("research_areas", T.normalize_area)}).withColumn("key", F.lower("person"))
    key, zero = F.col("key"), F.lit(0)
    person = _mention("Faculty", key, zero, name=F.col("person"), url=F.col("url"),
                      **{p: F.col(f"faculty_{p}") for p in ("email", "rank", "office", "phone")})
    # a nameless profile gives nothing; as a filter of rows, the test of names would be pushed into whatever the rows are joined from
    mentions = F.concat(F.array(person), F.transform("areas", lambda a: _mention("ResearchArea", F.lower(a), zero, name=a)),
                        F.transform("codes", lambda c: _mention("Course", F.upper(c), zero, url=F.lit(""))))
    links = F.concat(F.transform("areas", lambda a: _edge(key, "RESEARCHES", F.lower(a))),
                     F.transform("areas", lambda a: _edge(key, "AFFILIATED_WITH", F.lower(a))),
                     F.transform("codes", lambda c: _edge(key, "TEACHES", c)))
    named = F.col("person") != ""
    return people.select("doc_no", F.when(named, mentions).otherwise(F.slice(mentions, 1, 0)).alias("mentions"),
                         F.when(named, links).otherwise(F.array().cast(_NO_LINKS)).alias("links"))


_NO_LINKS = "array<struct<src:string,rel:string,dst:string>>"


def extract_research_docs(docs: DataFrame) -> DataFrame:
    heads = F.transform("heading_path", lambda h: T.strip(h))
    kept = F.filter(heads, lambda h: (F.length(h) > 3) & ~F.lower(h).startswith("cse") & ~F.lower(h).startswith("computer science"))
    labs = F.filter(
        F.transform(T.find_all(F.col("text"), K.LAB_NAME, 1, ignore_case=True, multiline=True), lambda x: T.strip(x)),
        lambda x: (F.length(x) >= 8) & ~F.lower(x).startswith("skip") & ~F.lower(x).startswith("search"))
    named = F.filter(F.transform("faculty_names", lambda n: T.strip(n)), lambda n: n != "")
    return docs.select(
        "doc_no",
        F.concat(F.transform(F.transform(kept, T.normalize_area), lambda a, i: _mention("ResearchArea", F.lower(a), i, name=a)),
                 F.transform(labs, lambda x, i: _mention("Lab", F.lower(x), i, name=x, url=F.col("url"))),
                 F.transform(named, lambda n, i: _mention("Faculty", F.lower(n), i, name=n, url=F.lit("")))).alias("mentions"),
        F.array().cast(_NO_LINKS).alias("links"))


def program_level(url: Column, title: Column, faithful: bool = True) -> Column:
    """Level of a program page. ``faithful=False`` needs "ms" and "bs" to be whole words of the URL."""
    u, t = F.lower(url), F.lower(title)
    word = (lambda w: F.contains(u, F.lit(w))) if faithful else (lambda w: T.matches(u, rf"(?<![a-z]){w}(?![a-z])"))
    return (F.when(F.contains(u, F.lit("phd")) | F.contains(t, F.lit("doctoral")), "phd")
            .when(word("ms") | F.contains(t, F.lit("master")), "ms")
            .when(F.contains(u, F.lit("undergraduate")) | word("bs") | F.contains(t, F.lit("bachelor")), "bs")
            .when(F.contains(u, F.lit("minor")) | F.contains(t, F.lit("minor")), "minor")
            .otherwise("unknown"))


def extract_program_docs(docs: DataFrame, faithful: bool = True) -> DataFrame:
    titled = docs.withColumns({"program": T.strip(F.coalesce("title", F.lit(""))), "codes": T.extract_codes(F.col("text"))})
    program, zero = F.col("program"), F.lit(0)
    node = _mention("Program", F.lower(program), zero, name=program, url=F.col("url"),
                    level=program_level(F.col("url"), F.col("title"), faithful))
    return titled.select(
        "doc_no",
        F.concat(F.filter(F.array(node), lambda m: m["id"] != ""),
                 F.transform("codes", lambda c: _mention("Course", F.upper(c), zero, url=F.lit("")))).alias("mentions"),
        F.filter(F.transform("codes", lambda c: _edge(c, "PART_OF", F.lower(program))), lambda e: e["dst"] != "").alias("links"))


def extract_other_docs(docs: DataFrame) -> DataFrame:
    codes = T.extract_codes(F.col("text"))
    return docs.select("doc_no", F.transform(codes, lambda c: _mention("Course", F.upper(c), F.lit(0), url=F.col("url"))).alias("mentions"),
                       F.array().cast(_NO_LINKS).alias("links"))


def extract_rows(docs: DataFrame, faithful_levels: bool = True) -> DataFrame:
    """(doc_no, mentions, links) of typed documents, built inside each document's row.

    ``docs``: doc_no (total order), url, title, page_type, text, courses_mentioned, faculty_names, heading_path,
    research_areas (arrays) and faculty_email/rank/office/phone. Store the rows where both nodes and edges are wanted.
    """
    kind = F.col("page_type")
    known = (*K.COURSE_TYPES, *K.GRAPH_FACULTY_TYPES, *K.GRAPH_RESEARCH_TYPES, *K.GRAPH_PROGRAM_TYPES)
    parts = [
        extract_course_docs(docs.where(kind.isin(*K.COURSE_TYPES))),
        extract_faculty_docs(docs.where(kind.isin(*K.GRAPH_FACULTY_TYPES))),
        extract_research_docs(docs.where(kind.isin(*K.GRAPH_RESEARCH_TYPES))),
        extract_program_docs(docs.where(kind.isin(*K.GRAPH_PROGRAM_TYPES)), faithful_levels),
        extract_other_docs(docs.where(~kind.isin(*known)))]
    return reduce(DataFrame.unionByName, parts)


def graph_of(rows: DataFrame, properties: tuple[str, ...] = PROPERTIES) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of extracted rows; nodes have the given properties only, and none of the others is exchanged."""
    mentions = T.unnest(rows, F.col("mentions"), "m", "doc_no").select(
        "m.label", "m.id", (F.col("doc_no") * _SLOTS + F.col("m.at")).alias("seq"), *[f"m.{p}" for p in properties])
    edges = T.unnest(rows, F.col("links"), "e").select("e.*").distinct()
    return merge_mentions(mentions, properties), edges


def extract_graph(docs: DataFrame, faithful_levels: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of typed documents.

    The only exchanges are the final aggregations, all combined map-side. Edges are distinct; ids are lower-case names,
    except for course codes.
    """
    return graph_of(extract_rows(docs, faithful_levels))


def merge_mentions(mentions: DataFrame, properties: tuple[str, ...] = PROPERTIES) -> DataFrame:
    """One row per (label, id), however often an entity is mentioned.

    Equal mentions collapse first, in a hash aggregation that keeps their earliest position; what is left per entity is
    merged. Merged labels take the first non-empty value of each field by mention order, the others the first mention.
    """
    if not properties:
        return mentions.select("label", "id").distinct()
    mentions = mentions.groupBy("label", "id", *properties).agg(F.min("seq").alias("seq"))
    first = lambda p: F.min_by(F.coalesce(p, F.lit("")), "seq")
    filled = lambda p: F.min_by(p, F.when(F.col(p) != "", F.col("seq")))
    value = lambda p: filled(p) if p == "credits" else F.when(
        F.col("label").isin(*MERGED_LABELS), F.coalesce(filled(p), F.lit(""))).otherwise(first(p))
    return mentions.groupBy("label", "id").agg(*[value(p).alias(p) for p in properties]).select("label", "id", *properties)


def resolve_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges whose ends exist with the labels their relation requires."""
    ends = F.create_map(*[x for rel, (a, b) in K.RELATION_ENDS.items()
                          for x in (F.lit(rel), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")))])
    typed = edges.select("src", "rel", "dst").distinct().withColumn("ends", F.try_element_at(ends, F.col("rel"))).select(
        "src", F.col("ends.a").alias("src_label"), "rel", "dst", F.col("ends.b").alias("dst_label"))
    ids = nodes.select("label", "id")
    kept = typed.join(ids.select(F.col("label").alias("src_label"), F.col("id").alias("src")), ["src_label", "src"], "left_semi")
    return kept.join(ids.select(F.col("label").alias("dst_label"), F.col("id").alias("dst")), ["dst_label", "dst"], "left_semi"
                     ).select("src", "src_label", "rel", "dst", "dst_label")


def merge_nodes(stored: DataFrame, incoming: DataFrame, keys: list[str], fields: list[str], default: str = "") -> DataFrame:
    """Upsert: every field takes the incoming value, else the stored one, else the default (an empty string counts)."""
    old = stored.select(*keys, *[F.col(f).alias(f"old_{f}") for f in fields])
    return incoming.join(old, keys, "full_outer").select(
        *keys, *[F.coalesce(f, f"old_{f}", F.lit(default)).alias(f) for f in fields])


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node counts per label followed by edge counts per relation."""
    return nodes.groupBy("label").agg(F.count("*").alias("n")).unionAll(
        edges.groupBy(F.col("rel").alias("label")).agg(F.count("*").alias("n")))
