"""Question understanding, subgraph expansion, evidence text and graph-guided chunks, for a batch of queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery import constants as K
from gleanery.config import DEFAULTS
from gleanery.functions import text as T
from gleanery.operators.ranking import top_k
from gleanery.operators.textjoin import contains_pairs
from gleanery.session import ensure_checkpoint_dir


def understand(queries: DataFrame, text_col: str = "query_text") -> DataFrame:
    """Append intents, course_codes, faculty_names, research_areas and program_level."""
    q = F.col(text_col)
    low = F.lower(q)
    intents = F.array_compact(F.array(*[F.when(T.matches(q, p, ignore_case=True), F.lit(n)) for n, p in K.INTENTS]))
    stop = F.array(*[F.lit(w) for w in K.NAME_STOPWORDS])
    names = F.filter(T.find_all(q, K.PERSON_NAME, 1), lambda n: ~F.arrays_overlap(F.split(n, r"(?U)\s+"), stop))
    areas = F.array_distinct(F.array_compact(F.array(*[
        F.when(F.contains(low, F.lit(phrase)), F.lit(name)) for phrase, name in K.AREA_VOCABULARY.items()])))
    word = F.lower(T.first_match(q, K.PROGRAM_WORD, 1, ignore_case=True))
    level = F.lit("")
    for name, spellings in reversed(K.PROGRAM_LEVELS):
        level = F.when(word.isin(*spellings), name).otherwise(level)
    return queries.withColumns({"intents": intents, "course_codes": T.extract_codes(q), "faculty_names": names,
                                "research_areas": areas, "program_level": level})


def seeds(understood: DataFrame) -> DataFrame:
    """(query_id, label, seed): entities to look up in the graph."""
    of = lambda label, c, f: F.transform(c, lambda x: F.struct(F.lit(label).alias("label"), f(x).alias("seed")))
    listed = F.concat(
        of("Course", F.col("course_codes"), F.upper), of("Faculty", F.col("faculty_names"), F.lower),
        of("ResearchArea", F.col("research_areas"), F.lower),
        F.filter(F.array(F.struct(F.lit("Program").alias("label"), F.col("program_level").alias("seed"))),
                 lambda s: s["seed"] != ""))
    return understood.select("query_id", F.explode(listed).alias("s")).select("query_id", "s.label", "s.seed").distinct()


def path_weights(understood: DataFrame) -> DataFrame:
    """(query_id, rel, weight): mean relation weight over the query's intents; 1 without intents."""
    table = F.create_map(*[x for i, ws in K.PATH_WEIGHTS.items() for r, w in ws.items()
                           for x in (F.lit(f"{i}|{r}"), F.lit(w))])
    expanded = understood.select("query_id", "intents", F.explode(F.array(*[F.lit(r) for r in K.RELATION_ENDS])).alias("rel"))
    total = F.aggregate("intents", F.lit(0.0), lambda s, i: s + F.coalesce(
        F.try_element_at(table, F.concat(i, F.lit("|"), F.col("rel"))), F.lit(K.DEFAULT_PATH_WEIGHT)))
    return expanded.select("query_id", "rel", F.when(F.size("intents") == 0, 1.0).otherwise(
        total / F.size("intents")).alias("weight"))


def find_seeds(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, label, id): exact codes, names that contain the seed (a few, by id) and programs of a level."""
    exact = wanted.where("label = 'Course'").join(nodes.select("label", F.col("id").alias("seed")), ["label", "seed"], "left_semi"
                                                  ).select("query_id", "label", F.col("seed").alias("id"))
    fuzzy = wanted.where(F.col("label").isin("Faculty", "ResearchArea"))
    named = nodes.where(F.col("label").isin("Faculty", "ResearchArea"))
    pairs = contains_pairs(
        named.select(F.struct("label", "id").alias("id"), F.col("id").alias("text")),
        fuzzy.select(F.col("seed").alias("pattern"))).select("id.label", "id.id", F.col("pattern").alias("seed"))
    by_name = fuzzy.join(pairs, ["label", "seed"])
    by_level = wanted.where("label = 'Program'").join(
        nodes.where("label = 'Program'").select("id", F.lower("level").alias("seed")), "seed")
    limit = F.create_map(*[x for k, n in K.SEED_LIMITS.items() for x in (F.lit(k), F.lit(n))])
    columns = ["query_id", "label", "seed", "id"]
    found = top_k(by_name.select(*columns).unionByName(by_level.select(*columns)), ["query_id", "label", "seed"],
                  [F.col("id")], max(K.SEED_LIMITS.values()), "n").where(F.col("n") <= F.try_element_at(limit, F.col("label")))
    return exact.unionByName(found.select("query_id", "label", "id")).distinct()


def _steps(edges: DataFrame) -> DataFrame:
    """Adjacency rows allowed by the expansion table: (label, id, rel, to_label, to_id, src, dst)."""
    out = [edges.select(F.col("src_label").alias("label"), F.col("src").alias("id"), "rel",
                        F.col("dst_label").alias("to_label"), F.col("dst").alias("to_id"), "src", "dst"),
           edges.select(F.col("dst_label").alias("label"), F.col("dst").alias("id"), "rel",
                        F.col("src_label").alias("to_label"), F.col("src").alias("to_id"), "src", "dst")]
    allowed = [F.lit(False), F.lit(False)]
    for label, rel, direction in K.EXPANSION_STEPS:
        side = 0 if direction == "out" else 1
        allowed[side] = allowed[side] | ((F.col("label") == label) & (F.col("rel") == rel))
    return out[0].where(allowed[0]).unionByName(out[1].where(allowed[1]))


def expand(understood: DataFrame, nodes: DataFrame, edges: DataFrame, hops: int = DEFAULTS.graph_hops
           ) -> tuple[DataFrame, DataFrame]:
    """(subgraph nodes with first hop, subgraph edges) per query, following the relations its intents admit.

    Each hop is checkpointed: the next one starts from a stored frontier, whatever the depth. Pass stored (or
    checkpointed) nodes and edges, which every hop joins again.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    start = find_seeds(seeds(understood), nodes).checkpoint()
    admitted = path_weights(understood).where(F.col("weight") >= K.PATH_GATE).select("query_id", "rel")
    steps = _steps(edges)
    reached = start.withColumn("hop", F.lit(0))
    frontier, travelled = start, []
    for hop in range(1, hops + 1):
        moves = frontier.join(steps, ["label", "id"]).join(admitted, ["query_id", "rel"], "left_semi").select(
            "query_id", "src", "rel", "dst", "to_label", "to_id")
        moves = (moves.unionByName(_area_moves(frontier, nodes, edges))
                 .unionByName(_program_moves(frontier, nodes, edges)).distinct().checkpoint())
        travelled.append(moves.select("query_id", "src", "rel", "dst"))
        frontier = (moves.select("query_id", F.col("to_label").alias("label"), F.col("to_id").alias("id")).distinct()
                    .join(reached.select("query_id", "label", "id"), ["query_id", "label", "id"], "left_anti"))
        reached = reached.unionByName(frontier.withColumn("hop", F.lit(hop)))
    return reached, reduce(DataFrame.unionByName, travelled).distinct()


def _area_moves(frontier: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """From an area to (a few) courses covering a topic whose name contains the area's name, and to that topic."""
    areas = frontier.where("label = 'ResearchArea'")
    topics = nodes.where("label = 'Topic'").select("id", F.col("id").alias("text"))
    pairs = contains_pairs(topics, areas.select(F.col("id").alias("pattern")))
    covers = edges.where("rel = 'COVERS'").select("src", "dst")
    hits = areas.join(pairs.select(F.col("id").alias("dst"), F.col("pattern").alias("id")), "id").join(covers, "dst")
    few = top_k(hits, ["query_id", "id"], [F.col("src"), F.col("dst")], K.AREA_TOPIC_LIMIT)
    ends = F.explode(F.array(F.struct(F.lit("Course").alias("l"), F.col("src").alias("i")),
                             F.struct(F.lit("Topic").alias("l"), F.col("dst").alias("i"))))
    return few.select("query_id", "src", F.lit("COVERS").alias("rel"), "dst", ends.alias("e")).select(
        "query_id", "src", "rel", "dst", F.col("e.l").alias("to_label"), F.col("e.i").alias("to_id"))


def _program_moves(frontier: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """From a program to (a few) courses of programs whose level is, or whose name contains, its id."""
    wanted = frontier.where("label = 'Program'")
    programs = nodes.where("label = 'Program'")
    by_name = contains_pairs(programs.select("id", F.col("id").alias("text")), wanted.select(F.col("id").alias("pattern")))
    by_level = programs.select("id", F.lower("level").alias("pattern"))
    pairs = by_name.unionByName(by_level).distinct().select(F.col("id").alias("dst"), F.col("pattern").alias("id"))
    part_of = edges.where("rel = 'PART_OF'").select("src", "dst")
    courses = wanted.join(pairs, "id").join(part_of, "dst").select("query_id", "id", "src").distinct()
    few = top_k(courses, ["query_id", "id"], [F.col("src")], K.PROGRAM_COURSE_LIMIT)
    return few.select("query_id", "src", F.lit("PART_OF").alias("rel"), F.col("id").alias("dst"),
                      F.lit("Course").alias("to_label"), F.col("src").alias("to_id"))


# --- evidence -------------------------------------------------------------------------------------
def evidence(understood: DataFrame, sub_nodes: DataFrame, sub_edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, id, text, score, n_nodes, n_edges): the subgraph as a block of text.

    Node order is (hop, id), edge order (rel, src, dst). Every list is cut to its display limit before it is
    collected, so the text of a query is built from a bounded number of rows.
    """
    limits = {"Course": 5, "Faculty": 4, "ResearchArea": 3, "Program": 2}
    shown = sub_nodes.where(F.col("label").isin(*limits)).join(nodes, ["label", "id"])
    shown = top_k(shown, ["query_id", "label"], [F.col("hop"), F.col("id")], max(limits.values()), "place")
    limit = F.create_map(*[x for k, n in limits.items() for x in (F.lit(k), F.lit(n))])
    shown = shown.where(F.col("place") <= F.try_element_at(limit, F.col("label")))
    names = nodes.select(F.col("id").alias("other"), F.col("label").alias("other_label"), F.col("name").alias("other_name"),
                         F.col("title").alias("other_title"), F.col("email").alias("other_email"))

    def opt(before: str, c: str, after: str = "") -> Column:
        v = F.coalesce(F.col(c), F.lit(""))
        return F.when(v != "", F.concat(F.lit(before), v, F.lit(after)))

    display = F.when(F.col("name") != "", F.col("name")).otherwise(F.col("id"))
    heads = shown.select("query_id", "label", "place", "id", F.when(
        F.col("label") == "Course", F.array(
            F.concat(F.lit("Course: "), "id", F.coalesce(opt(" — ", "title"), F.lit("")), F.coalesce(opt(" (", "credits", " credits)"), F.lit(""))),
            F.when(F.col("description") != "", F.concat(F.lit("  Description: "), F.substring("description", 1, 200))),
            opt("  Source: ", "url"))).when(
        F.col("label") == "Faculty", F.array(
            F.concat(F.lit("Faculty: "), display, F.coalesce(opt(" (", "rank", ")"), F.lit(""))),
            opt("  Email: ", "email"), opt("  Office: ", "office"), opt("  Profile: ", "url"))).when(
        F.col("label") == "ResearchArea", F.array(F.concat(F.lit("Research Area: "), T.title_case(display)))).otherwise(
        F.array(F.concat(F.lit("Program: "), display, F.lit(" (level: "), F.coalesce("level", F.lit("")), F.lit(")")))).alias("lines"))
    heads = heads.select("query_id", "label", "place", F.lit(0).alias("part"), F.posexplode(F.array_compact("lines")).alias("line_no", "line"))

    of = lambda label: shown.where(F.col("label") == label).select("query_id", "label", "place", "id")
    touching = sub_edges.select("query_id", F.col("src").alias("id"), "src", "rel", "dst").unionByName(
        sub_edges.where("src <> dst").select("query_id", F.col("dst").alias("id"), "src", "rel", "dst"))
    edge_order = [F.col("rel"), F.col("src"), F.col("dst")]
    course_edges = top_k(of("Course").join(touching, ["query_id", "id"]), ["query_id", "id"], edge_order, 8, "edge_no")
    course_edges = course_edges.withColumns({
        "other": F.when(F.col("id") == F.col("src"), F.col("dst")).otherwise(F.col("src")),
        "other_label": F.when(F.col("rel") == "REQUIRES", "Course").when(F.col("rel") == "TEACHES", "Faculty")
        .when(F.col("rel") == "PART_OF", "Program").otherwise("Topic")}).join(names, ["other", "other_label"], "left")
    out_edge = F.col("id") == F.col("src")
    course_lines = course_edges.select("query_id", "label", "place", F.lit(1).alias("part"), F.col("edge_no").alias("line_no"), F.when(
        (F.col("rel") == "REQUIRES") & out_edge, F.concat(F.lit("  Prerequisite: "), "dst", F.coalesce(opt(" (", "other_title", ")"), F.lit("")))).when(
        (F.col("rel") == "TEACHES") & ~out_edge, F.concat(F.lit("  Taught by: "), F.coalesce("other_name", "src"), F.coalesce(opt(" <", "other_email", ">"), F.lit("")))).when(
        (F.col("rel") == "COVERS") & out_edge, F.concat(F.lit("  Covers topic: "), T.title_case(F.col("dst")))).when(
        (F.col("rel") == "PART_OF") & out_edge, F.concat(F.lit("  Part of program: "), F.coalesce("other_name", "dst"))).alias("line")).where("line is not null")

    def listing(label: str, near: str, far: str, rels: tuple[str, ...], n: int, prefix: str, part: int, show) -> DataFrame:
        near_edges = sub_edges.where(F.col("rel").isin(*rels)).select("query_id", F.col(near).alias("id"), "rel", F.col(far).alias("other"))
        few = top_k(of(label).join(near_edges, ["query_id", "id"]), ["query_id", "id"], [F.col("rel"), F.col("other")], n, "n")
        few = show(few)
        return few.groupBy("query_id", "label", "place").agg(F.array_sort(F.collect_list(F.struct("n", "shown"))).alias("xs")).select(
            "query_id", "label", "place", F.lit(part).alias("part"), F.lit(0).alias("line_no"),
            F.concat(F.lit(prefix), F.array_join(F.transform("xs", lambda x: x["shown"]), ", ")).alias("line"))

    as_title = lambda df: df.withColumn("shown", T.title_case(F.col("other")))
    as_is = lambda df: df.withColumn("shown", F.col("other"))
    as_name = lambda df: df.join(names.where("other_label = 'Faculty'"), "other", "left").withColumn(
        "shown", F.coalesce(F.nullif("other_name", F.lit("")), "other"))
    lines = reduce(DataFrame.unionByName, [
        heads, course_lines,
        listing("Faculty", "src", "dst", ("RESEARCHES", "AFFILIATED_WITH"), 4, "  Research areas: ", 1, as_title),
        listing("Faculty", "src", "dst", ("TEACHES",), 5, "  Teaches: ", 2, as_is),
        listing("ResearchArea", "dst", "src", ("RESEARCHES",), 5, "  Faculty: ", 1, as_name),
        listing("Program", "dst", "src", ("PART_OF",), 8, "  Courses: ", 1, as_is)])
    group = F.create_map(*[x for i, k in enumerate(limits) for x in (F.lit(k), F.lit(i))])
    joined = lines.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(
        F.try_element_at(group, F.col("label")).alias("g"), "place", "part", "line_no", "line"))).alias("ls"))
    sizes = sub_nodes.groupBy("query_id").agg(F.count("*").alias("n_nodes")).join(
        sub_edges.groupBy("query_id").agg(F.count("*").alias("n_edges")), "query_id", "left")
    text = F.concat(F.lit("[GRAPH EVIDENCE]\n"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), F.lit("\n[/GRAPH EVIDENCE]"))
    return (sizes.join(joined, "query_id").join(understood.select("query_id", "query_text"), "query_id")
            .select("query_id", F.concat(F.lit("graph:subgraph:"), F.md5("query_text")).alias("id"), text.alias("text"),
                    F.lit(K.GRAPH_SCORE).alias("score"), "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges")))


# --- graph-guided chunks --------------------------------------------------------------------------
def guided_chunks(sub_nodes: DataFrame, chunks: DataFrame, k: int = 8, area_k: int = 8, pages: int | None = None) -> DataFrame:
    """(query_id, id, score, rank): chunks naming the subgraph's courses, then its people, then research pages on its areas.

    ``chunks``: id, text, title, page_type, courses_in_chunk. Each branch takes a query's first chunks in id order, out of
    all that name the surname or the area. With ``pages``, as in the reference, only the first ``pages`` profiles and
    research chunks of all are looked at, and research chunks need not name an area. A chunk keeps the first branch that
    found it.
    """
    first = lambda label, n: top_k(sub_nodes.where(F.col("label") == label).withColumnRenamed("id", "node"), ["query_id"],
                                   [F.col("hop"), F.col("node")], n, "n").select("query_id", "node")
    by_course = chunks.select("id", F.explode("courses_in_chunk").alias("node"))
    courses = top_k(first("Course", 6).join(by_course, "node").select("query_id", "id").distinct(), ["query_id"], [F.col("id")], k, "at")
    surname = first("Faculty", 4).select("query_id", F.element_at(F.split("node", r"(?U)\s+"), -1).alias("pattern")).distinct()
    area = sub_nodes.where("label = 'ResearchArea'").select("query_id", F.col("id").alias("pattern")).distinct()
    low = lambda kind: chunks.where(F.col("page_type") == kind).select("id", F.lower(F.concat(F.coalesce("text", F.lit("")), F.coalesce("title", F.lit("")))).alias("text"))
    naming = lambda kind, names, n: top_k(contains_pairs(low(kind), names.select(F.lower("pattern").alias("pattern"))).join(
        names.withColumn("pattern", F.lower("pattern")), "pattern").select("query_id", "id").distinct(), ["query_id"], [F.col("id")], n, "at")
    if pages is None:
        people, areas = naming("faculty_profile", surname, k), naming("research", area, area_k)
    else:
        head = lambda kind: chunks.where(F.col("page_type") == kind).orderBy("id").limit(pages).withColumn(
            "at", F.row_number().over(Window.partitionBy("page_type").orderBy("id")))
        profiles = head("faculty_profile").select("id", "at", F.lower(F.concat("text", "title")).alias("low"))
        people = surname.join(F.broadcast(profiles), F.contains("low", "pattern")).select("query_id", "id", "at").distinct()
        research = head("research").select("id", "at", F.lit(1).alias("one"))
        areas = area.select("query_id", F.lit(1).alias("one")).distinct().join(F.broadcast(research), "one").select("query_id", "id", "at")
    branches = [df.select("query_id", "id", F.lit(i).alias("branch"), "at", F.lit(K.GUIDED_SCORES[name]).alias("score"))
                for i, (name, df) in enumerate((("course", courses), ("faculty", people), ("research", areas)))]
    merged = reduce(DataFrame.unionByName, branches).groupBy("query_id", "id").agg(
        F.min(F.struct("branch", "at", "score")).alias("b")).select("query_id", "id", "b.branch", "b.at", "b.score")
    return top_k(merged, ["query_id"], [F.col("branch"), F.col("at"), F.col("id")], k).select(
        "query_id", "id", "score", F.col("rank").cast("bigint").alias("rank"))


def graph_retrieve(queries: DataFrame, nodes: DataFrame, edges: DataFrame, chunks: DataFrame, hops: int = DEFAULTS.graph_hops,
                   k: int = 8) -> DataFrame:
    """(query_id, id, text, score, source, rank): one evidence row, then the guided chunks."""
    ensure_checkpoint_dir(nodes.sparkSession)
    understood = understand(queries).checkpoint()
    sub_nodes, sub_edges = (df.checkpoint() for df in expand(understood, nodes, edges, hops))
    facts = evidence(understood, sub_nodes, sub_edges, nodes).select(
        "query_id", "id", "text", "score", F.lit("graph").alias("source"), F.lit(1).cast("bigint").alias("rank"))
    guided = guided_chunks(sub_nodes, chunks, k).join(chunks.select("id", "text"), "id").select(
        "query_id", "id", "text", "score", F.lit("graph_chunk").alias("source"), (F.col("rank") + 1).alias("rank"))
    return facts.unionByName(guided)


# --- lookups --------------------------------------------------------------------------------------
def taught_by(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(code, name, email) of the people who teach each course."""
    people = nodes.where("label = 'Faculty'").select(F.col("id").alias("src"), "name", "email")
    return edges.where("rel = 'TEACHES'").join(people, "src").select(F.col("dst").alias("code"), "name", "email")


def prerequisites(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(code, prerequisite, title) of every course."""
    titles = nodes.where("label = 'Course'").select(F.col("id").alias("dst"), "title")
    return edges.where("rel = 'REQUIRES'").join(titles, "dst").select(F.col("src").alias("code"), F.col("dst").alias("prerequisite"), "title")


def related_people(edges: DataFrame, k: int = 5) -> DataFrame:
    """(code, person): the first k people, by name, whose research names a topic that the course covers.

    Only the first k people of a topic can be among the first k of a course, so no topic meets more of them.
    """
    covers = edges.where("rel = 'COVERS'").select(F.col("src").alias("code"), F.col("dst").alias("topic"))
    research = edges.where("rel = 'RESEARCHES'").select(F.col("src").alias("person"), F.col("dst").alias("topic")).distinct()
    few = top_k(research, ["topic"], [F.col("person")], k).drop("rank")
    return top_k(covers.join(few, "topic").select("code", "person").distinct(), ["code"], [F.col("person")], k).drop("rank")


def find_people(fragments: DataFrame, nodes: DataFrame, k: int = 5) -> DataFrame:
    """(fragment, id, name): a few people whose name contains the fragment."""
    people = nodes.where("label = 'Faculty'").select("id", F.col("id").alias("text"))
    pairs = contains_pairs(people, fragments.select(F.lower("fragment").alias("pattern")))
    hits = pairs.join(nodes.where("label = 'Faculty'").select("id", "name"), "id")
    return top_k(hits, ["pattern"], [F.col("id")], k).select(F.col("pattern").alias("fragment"), "id", "name")
