"""SQL fragments shared by the oracle statements (DuckDB dialect)."""

from __future__ import annotations

from gleanery import constants as K


def sql_list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(expr: str) -> str:
    return rf"regexp_replace({expr}, '^\s+|\s+$', '', 'g')"


def collapse(expr: str) -> str:
    return rf"regexp_replace({expr}, '\s+', ' ', 'g')"


def fingerprint(expr: str) -> str:
    return collapse(strip(f"lower({expr})"))


def words(expr: str) -> str:
    return rf"len(regexp_extract_all({expr}, '\S+'))"


def tokens(expr: str) -> str:
    """Tokens of a text; course codes keep an upper-case "CSE 574A" spelling."""
    marked = rf"regexp_replace(lower({expr}), '\b(cse)\s*(\d{{3}}[a-z]?)\b', chr(1) || '\1 ' || chr(1) || '\2', 'g')"
    return (
        f"list_filter(list_transform(regexp_extract_all({marked}, chr(1) || '?[a-z0-9]+'), "
        f"lambda t: CASE WHEN starts_with(t, chr(1)) THEN upper(substr(t, 2)) ELSE t END), "
        f"lambda t: length(t) > 1 AND t NOT IN {sql_list(K.STOPWORDS)})")


def codes(expr: str) -> str:
    return (rf"list_sort(list_distinct(list_transform(regexp_extract_all({expr}, '\b(CSE|cse)\s*(\d{{3}}[A-Za-z]?)\b', 2), "
            f"lambda n: 'CSE ' || upper(n))))")


def boost_terms(expr: str) -> str:
    code_list = f"list_transform({codes(expr)}, lambda c: lower(c))"
    names = (rf"list_filter(flatten(list_transform(regexp_extract_all({expr}, '\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b', 1), "
             rf"lambda n: regexp_split_to_array(lower(n), '\s+'))), lambda w: length(w) > 2)")
    return f"list_distinct({code_list} || list_transform({code_list}, lambda c: replace(c, ' ', '')) || {names})"


def case_chain(expr: str, table, default: str) -> str:
    arms = " ".join(f"WHEN contains({expr}, {lit(a)}) THEN {lit(b)}" for a, b in table)
    return f"CASE {arms} ELSE {lit(default)} END"


def title(expr: str) -> str:
    return (rf"array_to_string(list_transform(regexp_extract_all(lower({expr}), '\p{{L}}+|[^\p{{L}}]+'), "
            f"lambda r: upper(substr(r, 1, 1)) || substr(r, 2)), '')")


def bm25_ctes(docs: str, queries: str, boost: bool, k1=1.5, b=0.75, eps=0.25, mult=2.5, doc_text="text",
              query_text="query_text", boost_text="query_text") -> str:
    """CTEs ending in ``bm25(query_id, doc_id, raw)`` with positive scores."""
    boosted = (
        f"""qb AS MATERIALIZED (SELECT query_id, unnest({boost_terms(boost_text)}) AS t FROM {queries}),
        hit AS MATERIALIZED (SELECT DISTINCT query_id, doc_id FROM qb JOIN {docs} ON contains(lower({doc_text}), t)),"""
        if boost else "hit AS (SELECT NULL::BIGINT AS query_id, NULL::BIGINT AS doc_id WHERE false),")
    return f"""
        tk AS MATERIALIZED (SELECT doc_id, {tokens(doc_text)} AS tok FROM {docs}),
        dl AS (SELECT doc_id, len(tok) AS dl FROM tk),
        st AS (SELECT count(*) AS n, coalesce(avg(dl), 0) AS avgdl FROM dl),
        post AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tok) AS term FROM tk)
                              GROUP BY ALL),
        raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS r
                FROM post, st GROUP BY term),
        idf AS MATERIALIZED (SELECT term, CASE WHEN r < 0 THEN {eps} * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
        qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tokens(query_text)}) AS term
               FROM {queries}) GROUP BY ALL),
        part AS (SELECT query_id, doc_id, sum(qtf * idf * (tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl)))) AS s
                 FROM qt JOIN idf USING (term) JOIN post USING (term) JOIN dl USING (doc_id), st GROUP BY ALL),
        {boosted}
        bm25 AS MATERIALIZED (SELECT part.query_id, part.doc_id,
                 s * CASE WHEN hit.doc_id IS NULL THEN 1.0 ELSE {mult} END AS raw
                 FROM part LEFT JOIN hit ON hit.query_id = part.query_id AND hit.doc_id = part.doc_id
                 WHERE s > 0)"""


def ranked(source: str, score: str, k: int, id_col: str = "doc_id") -> str:
    return (f"SELECT query_id, {id_col}, round({score}, 4) AS score, rank FROM (SELECT *, row_number() OVER "
            f"(PARTITION BY query_id ORDER BY round({score}, 6) DESC, {id_col}) AS rank FROM {source}) WHERE rank <= {k}")


def hash_vectors(source: str, id_col: str, text: str, dim: int = 64) -> str:
    """(id, d, x): coordinates of signed feature-hash vectors, unit length."""
    return f"""SELECT {id_col}, d, x / sqrt(sum(x * x) OVER (PARTITION BY {id_col})) AS x FROM (
        SELECT {id_col}, ('0x' || substr(md5(t), 1, 8))::BIGINT % {dim} AS d,
               sum(CASE WHEN ('0x' || substr(md5(t), 9, 1))::BIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE AS x
        FROM (SELECT {id_col}, unnest(regexp_extract_all(lower({text}), '[a-z0-9]{{2,}}')) AS t FROM {source})
        GROUP BY ALL)"""
