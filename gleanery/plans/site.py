"""A small university site derived from the star-schema tables, as typed documents and questions about them.

Course pages come from ``part``, profiles from ``supplier`` (with the courses of its lineitems), program pages from
``part``, research pages from ``nation`` and general pages from ``customer``; the expressions below are written in the
SQL that Spark and DuckDB share, so that the oracle statements see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery import constants as K
from gleanery.functions import text as T
from gleanery.operators.pages import academic_rank, research_areas
from gleanery.sources.tables import dealt, table

AREAS = ("nlp", "machine learning", "databases", "security", "robotics", "data mining", "hci", "compiler design")


def code(k: str) -> str:
    """Course code of an integer expression: CSE 100 .. CSE 999, then with suffix letters."""
    return (f"concat('CSE ', cast(100 + ({k}) % 900 as string), "
            f"CASE WHEN ({k}) >= 900 THEN chr(cast(65 + floor(({k}) / 900) % 26 as int)) ELSE '' END)")


def person(k: str) -> str:
    letters = f"translate(lpad(cast({k} as string), 5, '0'), '0123456789', 'abcdefghij')"
    return f"concat('Ada ', upper(substr({letters}, 1, 1)), substr({letters}, 2))"


def area(k: str) -> str:
    return "CASE ({}) % 8 {} END".format(k, " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(AREAS)))


_NL = "chr(10)"
_RANK = "CASE s_suppkey % 3 WHEN 0 THEN 'Associate Professor' WHEN 1 THEN 'Lecturer' ELSE 'Professor' END"
_PROGRAM = ("CASE p_size % 4 WHEN 0 THEN 'Master of ' WHEN 1 THEN 'Bachelor of ' WHEN 2 THEN 'Doctoral Study of ' ELSE "
            "'Minor in ' END")

# kind -> (source relation, doc_no, url, title, page_type, text, headings)
KINDS = {
    "course": (
        "part", "p_partkey * 8", "concat('https://catalog.example.edu/preview_course.php?id=', cast(p_partkey as string))",
        code("p_partkey"), "'catalog_course'",
        f"concat({code('p_partkey')}, ' - Studies of ', p_name, ' (', cast(p_size % 4 + 1 as string), ' credits)', {_NL}, "
        f"'Prerequisites: ', {code('p_partkey * 7 + 3')}, ' or ', {code('p_partkey * 11 + 5')}, '.', {_NL}, "
        f"'This course on ', p_name, ' covers ', lower(p_type), ' methods and ', p_name, ' practice in the field of ', "
        f"{area('p_size')}, ' with weekly reading, one written report, two graded projects and a final oral presentation "
        f"before the whole class', {_NL})", "''"),
    "faculty": (
        "people", "s_suppkey * 8 + 1", "concat('https://people.example.edu/profiles/', cast(s_suppkey as string), '.detail.html')",
        person("s_suppkey"), "'faculty_profile'",
        f"concat({person('s_suppkey')}, ' is ', {_RANK}, ' in room ', cast(100 + s_suppkey as string), ' Davis Hall, phone "
        f"(716) 645-', lpad(cast(s_suppkey % 10000 as string), 4, '0'), '.', {_NL}, 'Research Topics: ', {area('s_nationkey')}, '; ', "
        f"{area('s_suppkey')}, ', theory', {_NL}, 'Teaches ', {code('first_part')}, ' and ', {code('last_part')}, ' every year and "
        f"advises students on projects, theses and reading groups in the department.')", "''"),
    "program": (
        "part", "p_partkey * 8 + 2", "concat('https://catalog.example.edu/preview_program.php?catoid=1&id=', cast(p_partkey as string))",
        f"concat({_PROGRAM}, p_brand)", "'catalog_program'",
        f"concat('The program ', p_brand, ' lists ', {code('p_partkey')}, ' among its courses and asks for thirty credits, four breadth courses, three focus courses, three electives and a "
        f"capstone project that every student presents at the end of the second year.', {_NL}, '## Admission', {_NL}, 'Applicants send "
        f"transcripts, three letters of recommendation and a statement of purpose by the end of the year, and may ask the office for help with "
        f"any part of the application before the deadline passes.')", "''"),
    "research": (
        "nation", "n_nationkey * 8 + 3", "concat('https://www.example.edu/research/', cast(n_nationkey as string))",
        "n_name", "'research'",
        f"concat('The ', n_name, ' Systems Laboratory opened last year', {_NL}, 'skip to the Lab', {_NL}, 'Funding comes from the "
        f"Center', {_NL}, 'A group of people')",
        f"concat({area('n_nationkey')}, ';Topic Area ', cast(n_nationkey % 5 as string), ';CSE news')"),
    "general": (
        "customer", "c_custkey * 8 + 4", "concat('https://www.example.edu/page/', cast(c_custkey as string))",
        "c_name", "'general'",
        f"concat('A note by ', c_name, ' on ', {code('c_custkey * 13')}, ' for the ', lower(c_mktsegment), ' segment.')", "''"),
}
_PEOPLE = ("SELECT s_suppkey, s_nationkey, coalesce(first_part, 0) AS first_part, coalesce(last_part, 0) AS last_part FROM supplier "
           "LEFT JOIN (SELECT l_suppkey, min(l_partkey) AS first_part, max(l_partkey) AS last_part FROM lineitem GROUP BY l_suppkey) "
           "ON l_suppkey = s_suppkey")
QUESTIONS = (
    f"SELECT cast(n_nationkey as bigint) AS query_id, CASE n_nationkey % 3 "
    f"WHEN 0 THEN concat('Who teaches ', {code('n_nationkey * 37')}, ' and what is required before ', {code('n_nationkey * 5')}, '?') "
    f"WHEN 1 THEN concat('What are the research interests of ', {person('n_nationkey')}, '?') "
    f"ELSE 'Which core course is in the MS program?' END AS query_text FROM nation "
    f"UNION ALL SELECT cast(100 + r_regionkey as bigint), concat('Which professor works on ', {area('r_regionkey')}, ' here?') FROM region")


_KEYS = {"part": "p_partkey", "people": "s_suppkey", "nation": "n_nationkey", "customer": "c_custkey"}
_STORED = {"people": "supplier"}


def _select(kind: str, relation: str | None = None) -> str:
    source, no, url, title, page_type, text, headings = KINDS[kind]
    return (f"SELECT cast({no} as bigint) AS doc_no, {url} AS url, {title} AS title, {page_type} AS page_type, {text} AS text, "
            f"{headings} AS headings FROM {relation or source}")


def site_sql() -> str:
    """CTEs ``people``, ``site`` and ``questions`` for the oracle statements."""
    union = " UNION ALL ".join(_select(k) for k in KINDS)
    return f"people AS ({_PEOPLE}), site AS MATERIALIZED ({union}), questions AS ({QUESTIONS})"


def _sql(spark: SparkSession, d: str, statement: str) -> DataFrame:
    for name in ("part", "supplier", "nation", "region", "customer", "lineitem"):
        if name in statement:
            table(spark, d, name).createOrReplaceTempView(f"site_{name}")
    text = statement
    for name in ("part", "supplier", "nation", "region", "customer", "lineitem"):
        text = text.replace(f"FROM {name}", f"FROM site_{name}")
    return spark.sql(text)


def site_documents(spark: SparkSession, d: str, *kinds: str) -> DataFrame:
    """Documents of the given kinds (all by default) in the shape that graph extraction and chunking read.

    The source rows are dealt to tasks before the texts are built from them, so that the one scan of a table stored as one file
    passes on its few columns only.
    """
    kinds, views = kinds or tuple(KINDS), {}
    counts = {s: table(spark, d, _STORED.get(s, s)).count() for s in dict.fromkeys(KINDS[k][0] for k in kinds)}  # from the file footers
    for source, count in counts.items():
        rows = _sql(spark, d, _PEOPLE) if source == "people" else table(spark, d, source)
        views[source] = f"site_{source}"
        dealt(rows, _KEYS[source], count).createOrReplaceTempView(views[source])
    built = spark.sql(" UNION ALL ".join(_select(k, views[KINDS[k][0]]) for k in kinds))
    # beyond an exchange no expression over a text builds the text again
    docs = dealt(built, "doc_no", sum(counts[KINDS[k][0]] for k in kinds))
    text, empty = F.col("text"), F.array().cast("array<string>")
    is_profile = F.col("page_type") == "faculty_profile"
    return docs.withColumns({
        "id": F.col("doc_no"), "source": F.lit("department"),
        "heading_path": F.when(F.col("headings") == "", empty).otherwise(F.split("headings", ";")),
        "courses_mentioned": T.loose_codes(text), "faculty_names": empty,
        "research_areas": F.when(is_profile, research_areas(text)).otherwise(empty),
        "faculty_email": F.lit(""), "faculty_rank": F.when(is_profile, academic_rank(F.lower(text))),
        "faculty_office": F.when(is_profile, T.first_match(text, K.OFFICE, 0)),
        "faculty_phone": F.when(is_profile, T.first_match(text, K.PHONE, 0))}).drop("headings")


def site_questions(spark: SparkSession, d: str) -> DataFrame:
    return _sql(spark, d, QUESTIONS)
