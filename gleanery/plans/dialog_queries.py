"""Registered question-screening, dialogue and prompt queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery import constants as K
from gleanery.operators import bm25, dialogue, evaluation, prompts, rules
from gleanery.plans import oracle_macros as M
from gleanery.plans.site import person, site_questions, site_sql
from gleanery.sources.tables import table

# Every turn gets an opening that mentions courses, people or programs, or refers back to them.
_OPENING = (
    "CASE turn % 4 WHEN 0 THEN concat('Who teaches CSE ', cast(100 + (conv_id * 7 + turn) % 900 as string), ' this year? ') "
    f"WHEN 1 THEN concat('It is taught by ', {person('conv_id')}, '. ') "
    "WHEN 2 THEN 'What are its hours and does she reply? I am interested in data mining. My name is Grace Hopper, in the MS program. ' "
    "ELSE 'The class meets weekly, and they help. ' END")


def _turns(spark, d):
    return table(spark, d, "conversations").selectExpr("conv_id", "turn", "role", f"concat({_OPENING}, text) AS text")


_TURNS = f"t AS MATERIALIZED (SELECT conv_id, turn, role, concat({_OPENING}, text) AS text FROM conversations)"


# --- screening ------------------------------------------------------------------------------------
_ASKED = ("CASE turn % 7 WHEN 0 THEN 'Hello!' WHEN 1 THEN concat('Do my homework for me: ', text) WHEN 2 THEN concat('Is it illegal? ', text) "
          "WHEN 3 THEN concat('What GPA do I need? ', text) WHEN 4 THEN '   ' WHEN 5 THEN concat('The weather: ', text) ELSE text END")


def question_screening(spark, d):
    asked = table(spark, d, "conversations").selectExpr("conv_id", "turn", f"{_ASKED} AS text")
    return rules.check(asked).select("conv_id", "turn", "allowed", "reason", "small_talk", F.md5("redirect_msg").alias("redirect_md5"), F.md5("canned_reply").alias("reply_md5"))


def screening_pass_rate(spark, d):
    """Decisions against the expectation that everything but homework, weather, crime and blank questions passes."""
    asked = table(spark, d, "conversations").selectExpr("turn", f"{_ASKED} AS text")
    checked = rules.check(asked).withColumns({"got": F.col("allowed"), "expected": ~(F.col("turn") % 7).isin(1, 2, 4, 5)})
    return evaluation.pass_rate(checked)


def consent_reading(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", rules.consent(F.col("text")).alias("answer"))


# --- memory ---------------------------------------------------------------------------------------
def dialog_entities(spark, d):
    m = dialogue.mentions(_turns(spark, d))
    return m.select("conv_id", "turn", F.array_join("courses", "|").alias("courses"), F.array_join("names", "|").alias("names"), "course", "person", "program")


def dialog_last_entities(spark, d):
    out = dialogue.carry_forward(dialogue.mentions(_turns(spark, d)), ["course", "person", "program"], inclusive=True)
    return out.select("conv_id", "turn", "last_course", "last_person", "last_program")


def dialog_resolved(spark, d):
    return dialogue.resolve(_turns(spark, d)).select("conv_id", "turn", "resolved")


def dialog_history(spark, d):
    return dialogue.history(_turns(spark, d))


def dialog_recent_turns(spark, d):
    return dialogue.recent_turns(_turns(spark, d)).select("conv_id", "turn", F.col("back").cast("bigint").alias("back"))


def dialog_profile(spark, d):
    return dialogue.profile(_turns(spark, d))


def dialog_state(spark, d):
    return dialogue.state_summary(_turns(spark, d))


def dialog_session_states(spark, d):
    """State after every turn, with summaries."""
    return dialogue.session_states(_turns(spark, d))


def dialog_memory_context(spark, d):
    """What the memory hands to a prompt at the end of every conversation."""
    return dialogue.memory_context(_turns(spark, d))


# The question is put by assistant turns of some conversations; users answer yes, no or with a question of their own.
_ASKS = "role = 'assistant' AND (conv_id + turn) % 3 = 0"
_ANSWER = "CASE WHEN role = 'user' THEN CASE conv_id % 4 WHEN 0 THEN 'Yes, do it.' WHEN 1 THEN 'Nope.' WHEN 2 THEN 'Who gives CSE 574?' ELSE '' END ELSE text END"


def dialog_consent_states(spark, d):
    """Consent to personalization after every turn."""
    told = table(spark, d, "conversations").selectExpr("conv_id", "turn", "role", f"{_ANSWER} AS text")
    return dialogue.consent_states(told, F.expr(_ASKS))


def dialog_memory_after_reset(spark, d):
    """Turns held and last entities where the memory is cleared by the third turn of every other conversation."""
    return dialogue.state_summary(dialogue.since_reset(_turns(spark, d), F.expr("turn = 2 AND conv_id % 2 = 0")))


# --- prompts --------------------------------------------------------------------------------------
def _results(spark, d):
    docs = table(spark, d, "documents")
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    hits = bm25.search(docs, items, k=8, boost=False)
    info = docs.select("doc_id", "text", F.when(F.col("lang") == "fr", "").otherwise(F.concat(F.lit("https://docs.example.org/"), "source")).alias("url"),
                       F.when(F.col("doc_id") % 9 == 0, "graph").otherwise("bm25").alias("source"))
    return hits.join(info, "doc_id"), items


def context_blocks(spark, d):
    results, _ = _results(spark, d)
    return prompts.context_blocks(results).select("query_id", F.md5("context").alias("context_md5"), "n_chunks")


def cited_sources(spark, d):
    return prompts.source_urls(_results(spark, d)[0])


def citation_footers(spark, d):
    urls = prompts.source_urls(_results(spark, d)[0]).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", "url"))).alias("u"))
    return urls.select("query_id", prompts.citations(F.transform("u", lambda x: x["url"])).alias("footer"))


def answer_prompts(spark, d):
    results, items = _results(spark, d)
    both = items.join(prompts.context_blocks(results), "query_id", "left")
    context = F.coalesce("context", F.lit(""))
    told = F.concat(F.lit("User: hi\nAssistant: yes?\nnoise\nUser: "), F.substring("query_text", 1, 20))
    return both.select("query_id", F.md5(prompts.prompt(F.col("query_text"), context, told)).alias("chat_md5"),
                       F.md5(prompts.prompt(F.col("query_text"), context, told, chat_markup=False)).alias("header_md5"))


def debug_payloads(spark, d):
    out = prompts.debug_payload(_results(spark, d)[0])
    return out.select("query_id", F.size("chunks").cast("bigint").alias("n_chunks"), F.size("graph").cast("bigint").alias("n_graph"),
                      F.md5(F.array_join(F.transform("chunks", lambda c: c["text"]), "|")).alias("texts_md5"))


QUERIES = {f.__name__: f for f in (
    question_screening, screening_pass_rate, consent_reading, dialog_entities, dialog_last_entities, dialog_resolved, dialog_history,
    dialog_recent_turns, dialog_profile, dialog_state, dialog_session_states, dialog_memory_context, dialog_consent_states,
    dialog_memory_after_reset, context_blocks, cited_sources, citation_footers,
    answer_prompts, debug_payloads)}

# --- oracle statements ----------------------------------------------------------------------------
_Q = M.strip("text")
# RE2 sees a word boundary next to an accented letter; an underscore in its place behaves like a letter
_WORDS = r"regexp_replace(" + _Q + r", '[\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]', '_', 'g')"


def _rules() -> str:
    arm = lambda p, ci, reason, allowed, talk, redirect, reply: (
        f"WHEN regexp_matches(q, {M.lit(('(?i)' if ci else '') + p)}) THEN {{'allowed': {allowed}, 'reason': '{reason}', 'small_talk': {talk}, "
        f"'redirect': {M.lit(redirect)}, 'reply': {M.lit(reply)}}}")
    arms = ["WHEN q = '' THEN {'allowed': false, 'reason': 'empty_query', 'small_talk': false, 'redirect': " + M.lit(K.EMPTY_REPLY) + ", 'reply': ''}"]
    arms += [arm(p, True, "small_talk", "true", "true", "", r) for p, r in K.SMALL_TALK]
    arms += [arm(p, True, "rule_block", "false", "false", r, "") for p, r in K.BLOCK_RULES]
    arms += [arm(p, True, "sensitive_flag", "false", "false", K.SENSITIVE_REPLY, "") for p in K.SENSITIVE_RULES]
    arms += [arm(p, ci, "rule_allow", "true", "false", "", "") for p, ci in K.ALLOW_RULES]
    other = "{'allowed': true, 'reason': 'classifier_fallback_allow', 'small_talk': false, 'redirect': '', 'reply': ''}"
    return f"CASE {' '.join(arms)} ELSE {other} END"


_SCREENED = f"""a AS (SELECT conv_id, turn, {_ASKED} AS text FROM conversations), b AS (SELECT *, {_WORDS} AS q FROM a), c AS (SELECT *, {_rules()} AS r FROM b)"""
_ANY = lambda words: "(" + " OR ".join(f"contains(low, {M.lit(w)})" for w in words) + ")"
_NAMES = f"regexp_extract_all(text, {M.lit(K.PERSON_NAME)}, 1)"
_MENTIONS = f"""{_TURNS}, m AS MATERIALIZED (SELECT *, {M.codes('text')} AS courses, {_NAMES} AS names, {M.codes('text')}[-1] AS course,
    list_filter({_NAMES}, lambda n: lower(n) NOT IN {M.sql_list(K.DIALOG_NAME_STOPLIST)})[-1] AS person,
    nullif({M.strip("regexp_extract(text, " + M.lit('(?i)' + K.PROGRAM_MENTION) + ")")}, '') AS program FROM t)"""
_LAST = lambda c, frame: f"last_value({c} IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND {frame})"
_LINE = """CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || CASE WHEN role = 'assistant' AND length({0}) > 250 THEN substr({0}, 1, 250) || '…' ELSE {0} END""".format(M.strip("text"))
_RES = f"""items AS (SELECT item_id AS query_id, text AS query_text FROM benchmark), {M.bm25_ctes('documents', 'items', False)},
    b AS ({M.ranked('bm25', 'raw', 8)}),
    res AS (SELECT b.query_id, b.rank, {M.strip('d.text')} AS text, CASE WHEN lang = 'fr' THEN '' ELSE 'https://docs.example.org/' || d.source END AS url,
            CASE WHEN doc_id % 9 = 0 THEN 'graph' ELSE 'bm25' END AS source FROM b JOIN documents d USING (doc_id)),
    txt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM res WHERE source <> 'graph'),
    ln AS (SELECT query_id, 0 AS part, rank AS n, text AS line FROM res WHERE source = 'graph' UNION ALL
           SELECT query_id, 1, n, '[' || n || '] ' || text || CASE WHEN url <> '' THEN chr(10) || '(Source: ' || url || ')' ELSE '' END FROM txt WHERE n <= 5),
    ctx AS (SELECT query_id, string_agg(line, chr(10) || chr(10) ORDER BY part, n) AS context, count(*) FILTER (part = 1) AS n_chunks FROM ln GROUP BY 1),
    best AS (SELECT query_id, url, min(rank) AS r FROM res WHERE url <> '' GROUP BY ALL),
    src AS (SELECT query_id, url, row_number() OVER (PARTITION BY query_id ORDER BY r, url) AS position FROM best QUALIFY position <= 5)"""
_SYS = M.lit(K.SYSTEM_PROMPT)
_BLOCK_SQL = "CASE WHEN coalesce(context, '') <> '' THEN chr(10) || chr(10) || '[Context from UB CSE website:]' || chr(10) || context ELSE '' END"
_TOLD = "'User: hi' || chr(10) || 'Assistant: yes?' || chr(10) || 'noise' || chr(10) || 'User: ' || substr(query_text, 1, 20)"

# The memory turn by turn: the held turns as a list, the summary written as they are dropped.
_PERSON_OF = lambda names: f"list_filter({names}, lambda n: lower(n) NOT IN {M.sql_list(K.DIALOG_NAME_STOPLIST)})[-1]"
_NAMES_IN = lambda c: f"regexp_extract_all({c}, {M.lit(K.PERSON_NAME)}, 1)"
_LABELS = """list_transform(list_filter(flatten(list_transform(old, lambda t: [
    CASE WHEN len(t.c) > 0 THEN 'courses (' || array_to_string(t.c[1:3], ', ') || ')' END, CASE WHEN len(t.n) > 0 THEN 'faculty (' || t.n[1] || ')' END])), lambda x: x IS NOT NULL), lambda x: x)"""
_FIRST_OF = "list_filter(l, lambda x, i: list_position(l, x) = i)[1:4]"
_MEMORY = f"""{_TURNS}, o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM t),
    s AS (SELECT DISTINCT conv_id, 0::BIGINT AS pos, NULL::BIGINT AS turn, '' AS role, '' AS resolved, []::STRUCT(c VARCHAR[], n VARCHAR[])[] AS held, 0::BIGINT AS mark,
              '' AS summary, '' AS course, '' AS person, '' AS program FROM o
        UNION ALL SELECT conv_id, pos, turn, role, r, CASE WHEN due THEN now[-3:] ELSE now END, CASE WHEN due THEN len(now) ELSE mark END,
              CASE WHEN due THEN 'User and assistant ' || concat_ws(', ', 'discussed course ' || list_filter(old, lambda t: len(t.c) > 0)[-1].c[-1],
                  'discussed faculty member ' || list_filter(old, lambda t: len(t.n) > 0)[-1].n[-1], CASE WHEN len(l) > 0 THEN 'topics: ' || array_to_string({_FIRST_OF}, '; ') END) || '.'
              ELSE summary END, coalesce(c[-1], course), coalesce({_PERSON_OF('n')}, person),
              coalesce(nullif({M.strip("regexp_extract(r, " + M.lit('(?i)' + K.PROGRAM_MENTION) + ")")}, ''), program)
        FROM (SELECT *, {_LABELS} AS l FROM (SELECT *, now[:len(now) - 3] AS old, role = 'assistant' AND len(now) >= 6 AND len(now) - mark >= 6 AS due
        FROM (SELECT *, (held || [{{'c': c, 'n': n}}])[-8:] AS now FROM (SELECT *, {M.codes('r')} AS c, {_NAMES_IN('r')} AS n
        FROM (SELECT *, CASE WHEN role = 'user' AND person <> '' AND len({_NAMES_IN('text')}) = 0 THEN regexp_replace(q, {M.lit(K.PERSON_PRONOUN)}, person, 'gi') ELSE q END AS r
        FROM (SELECT o.conv_id, o.pos, o.turn, o.role, o.text, held, mark, summary, course, person, program,
              CASE WHEN o.role = 'user' AND course <> '' AND len({M.codes('o.text')}) = 0 THEN regexp_replace(o.text, {M.lit(K.COURSE_PRONOUN)}, course, 'gi') ELSE o.text END AS q
              FROM s JOIN o ON o.conv_id = s.conv_id AND o.pos = s.pos + 1))))))),
    m AS MATERIALIZED (SELECT * FROM s WHERE pos > 0)"""

ORACLES = {
    "question_screening": f"""WITH {_SCREENED} SELECT conv_id, turn, r.allowed AS allowed, r.reason AS reason, r.small_talk AS small_talk,
        md5(r.redirect) AS redirect_md5, md5(r.reply) AS reply_md5 FROM c""",
    "screening_pass_rate": f"""WITH {_SCREENED} SELECT count(*) AS n, count(*) FILTER (r.allowed = (turn % 7 NOT IN (1, 2, 4, 5))) AS passed,
        count(*) FILTER (r.allowed <> (turn % 7 NOT IN (1, 2, 4, 5))) AS failed FROM c""",
    "consent_reading": f"""SELECT conv_id, turn, CASE WHEN {_ANY(K.CONSENT_YES)} THEN 'yes' WHEN {_ANY(K.CONSENT_QUESTION)} AND NOT {_ANY(K.CONSENT_NO)} THEN 'question' ELSE 'no' END AS answer
        FROM (SELECT conv_id, turn, lower({_Q}) AS low FROM conversations)""",
    "dialog_entities": f"WITH {_MENTIONS} SELECT conv_id, turn, array_to_string(courses, '|') AS courses, array_to_string(names, '|') AS names, course, person, program FROM m",
    "dialog_last_entities": f"WITH {_MENTIONS} SELECT conv_id, turn, {_LAST('course', 'CURRENT ROW')} AS last_course, {_LAST('person', 'CURRENT ROW')} AS last_person, {_LAST('program', 'CURRENT ROW')} AS last_program FROM m",
    "dialog_resolved": f"""WITH {_MENTIONS}, s AS (SELECT *, {_LAST('course', '1 PRECEDING')} AS lc, {_LAST('person', '1 PRECEDING')} AS lp FROM m),
        c AS (SELECT *, CASE WHEN role = 'user' AND len(courses) = 0 AND lc IS NOT NULL THEN regexp_replace(text, {M.lit(K.COURSE_PRONOUN)}, lc, 'gi') ELSE text END AS r FROM s)
        SELECT conv_id, turn, CASE WHEN role = 'user' AND len(names) = 0 AND lp IS NOT NULL THEN regexp_replace(r, {M.lit(K.PERSON_PRONOUN)}, lp, 'gi') ELSE r END AS resolved FROM c""",
    "dialog_history": f"""WITH {_TURNS}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM t QUALIFY back <= 4)
        SELECT conv_id, string_agg({_LINE}, chr(10) ORDER BY turn) AS history FROM r GROUP BY 1""",
    "dialog_recent_turns": "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations QUALIFY back <= 8",
    "dialog_profile": f"""WITH {_TURNS}, u AS MATERIALIZED (SELECT * FROM t WHERE role = 'user'),
        f AS (SELECT conv_id, nullif({M.strip("regexp_extract(text, " + M.lit('(?i)' + K.PROFILE_NAME) + ", 1)")}, '') AS n, nullif(upper(regexp_extract(text, {M.lit('(?i)' + K.PROFILE_PROGRAM)}, 1)), '') AS p, turn FROM u),
        g AS (SELECT conv_id, first(n ORDER BY turn) FILTER (n IS NOT NULL) AS name, first(p ORDER BY turn) FILTER (p IS NOT NULL) AS program FROM f GROUP BY 1),
        i AS (SELECT conv_id, v, min(turn * 10000 + pos) AS seen_at FROM (SELECT conv_id, turn, unnest(xs) AS v, generate_subscripts(xs, 1) AS pos FROM (SELECT conv_id, turn,
              list_filter(list_transform(regexp_extract_all(text, {M.lit('(?i)' + K.PROFILE_INTEREST)}, 1), lambda x: lower({M.strip('x')})), lambda x: length(x) > 3) AS xs FROM u)) GROUP BY ALL),
        i4 AS (SELECT conv_id, string_agg(v, ', ' ORDER BY seen_at) AS interests FROM (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY seen_at) <= 4) GROUP BY 1),
        k AS (SELECT conv_id, v, min(turn * 10000 + pos) AS seen_at FROM (SELECT conv_id, turn, unnest({M.codes('text')}) AS v, generate_subscripts({M.codes('text')}, 1) AS pos FROM u) GROUP BY ALL),
        k6 AS (SELECT conv_id, string_agg(v, ', ' ORDER BY seen_at) AS known_courses FROM (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY seen_at) <= 6) GROUP BY 1),
        j AS (SELECT conv_id, name, program, interests, known_courses, concat_ws(' | ', 'User''s name: ' || name, 'Program: ' || program, 'Interests: ' || interests, 'Courses taken/mentioned: ' || known_courses) AS parts
              FROM g LEFT JOIN i4 USING (conv_id) LEFT JOIN k6 USING (conv_id))
        SELECT conv_id, name, program, interests, known_courses, CASE WHEN parts <> '' THEN '[User profile: ' || parts || ']' ELSE '' END AS context FROM j""",
    "dialog_state": f"""WITH {_MENTIONS}, o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM m),
        k AS (SELECT conv_id, count(*) AS n, min(pos) FILTER (role = 'assistant' AND pos >= 6) AS s FROM o GROUP BY 1)
        SELECT conv_id, any_value(least(8, CASE WHEN s IS NULL THEN n ELSE 3 + n - s END)) AS turns, coalesce(last(course ORDER BY turn) FILTER (course IS NOT NULL), '') AS last_course,
        coalesce(last(person ORDER BY turn) FILTER (person IS NOT NULL), '') AS last_person, coalesce(last(program ORDER BY turn) FILTER (program IS NOT NULL), '') AS last_program FROM m JOIN k USING (conv_id) GROUP BY 1""",
    "dialog_session_states": f"""WITH RECURSIVE {_MEMORY} SELECT conv_id, turn, role, resolved, len(held)::INTEGER AS kept_turns, summary, course AS last_course,
        person AS last_person, program AS last_program FROM m""",
    "dialog_memory_context": f"""WITH RECURSIVE {_MEMORY}, z AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1),
        h AS (SELECT m.conv_id, string_agg({_LINE.replace("text", "m.resolved").replace("role", "m.role")}, chr(10) ORDER BY m.pos) AS lines
              FROM m JOIN z ON m.conv_id = z.conv_id AND m.pos > z.pos - least(4, len(z.held)) GROUP BY 1)
        SELECT conv_id, len(held)::BIGINT AS turns, summary <> '' AS has_summary, course AS last_course, person AS last_person, program AS last_program,
        CASE WHEN summary <> '' THEN '[Earlier: ' || summary || ']' || chr(10) ELSE '' END || lines AS history FROM z JOIN h USING (conv_id)""",
    "dialog_consent_states": f"""WITH RECURSIVE o AS MATERIALIZED (SELECT conv_id, turn, role = 'user' AS u, {_ASKS} AS asks, lower({M.strip(_ANSWER)}) AS low,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations),
        w AS MATERIALIZED (SELECT *, {_ANY(K.CONSENT_YES)} AS yes, {_ANY(K.CONSENT_QUESTION)} AND NOT {_ANY(K.CONSENT_NO)} AS aside FROM o),
        s AS (SELECT DISTINCT conv_id, 0::BIGINT AS pos, NULL::BIGINT AS turn, 'never asked' AS consent, false AS intercepted FROM w
            UNION ALL SELECT w.conv_id, w.pos, w.turn, CASE WHEN asks THEN 'pending' WHEN u AND consent = 'pending' THEN CASE WHEN yes THEN 'on' ELSE 'off' END ELSE consent END,
            u AND consent = 'pending' AND (yes OR NOT aside) FROM s JOIN w ON w.conv_id = s.conv_id AND w.pos = s.pos + 1)
        SELECT conv_id, turn, consent, intercepted FROM s WHERE pos > 0""",
    "dialog_memory_after_reset": f"""WITH {_MENTIONS}, a AS (SELECT m.* FROM m LEFT JOIN (SELECT conv_id, turn AS cleared FROM m WHERE turn = 2 AND conv_id % 2 = 0) USING (conv_id)
            WHERE turn > coalesce(cleared, -1)), p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM a),
        k AS (SELECT conv_id, count(*) AS n, min(pos) FILTER (role = 'assistant' AND pos >= 6) AS s FROM p GROUP BY 1)
        SELECT conv_id, any_value(least(8, CASE WHEN s IS NULL THEN n ELSE 3 + n - s END)) AS turns, coalesce(last(course ORDER BY turn) FILTER (course IS NOT NULL), '') AS last_course,
        coalesce(last(person ORDER BY turn) FILTER (person IS NOT NULL), '') AS last_person, coalesce(last(program ORDER BY turn) FILTER (program IS NOT NULL), '') AS last_program
        FROM a JOIN k USING (conv_id) GROUP BY 1""",
    "context_blocks": f"WITH {_RES} SELECT query_id, md5(context) AS context_md5, n_chunks FROM ctx",
    "cited_sources": f"WITH {_RES} SELECT * FROM src",
    "citation_footers": f"WITH {_RES} SELECT query_id, string_agg('[' || position || '] ' || url, chr(10) ORDER BY position) AS footer FROM src GROUP BY 1",
    "answer_prompts": f"""WITH {_RES} SELECT query_id, md5('<|im_start|>system' || chr(10) || {_SYS} || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || 'hi<|im_end|>' || chr(10)
          || '<|im_start|>assistant' || chr(10) || 'yes?<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || {M.strip("split_part(substr(query_text, 1, 20), chr(10), 1)")} || '<|im_end|>' || chr(10)
          || '<|im_start|>user' || chr(10) || {M.strip(f"query_text || {_BLOCK_SQL}")} || '<|im_end|>' || chr(10) || '<|im_start|>assistant') AS chat_md5,
        md5('<|begin_of_text|><|start_header_id|>system<|end_header_id|>' || chr(10) || {_SYS} || '<|eot_id|><|start_header_id|>user<|end_header_id|>' || chr(10)
          || {M.strip(f"'[Conversation so far:]' || chr(10) || {_TOLD} || {_BLOCK_SQL} || chr(10) || chr(10) || query_text")} || '<|eot_id|><|start_header_id|>assistant<|end_header_id|>' || chr(10)) AS header_md5
        FROM items LEFT JOIN ctx USING (query_id)""",
    "debug_payloads": f"""WITH {_RES}, d8 AS (SELECT query_id, b.rank, d.text, doc_id % 9 = 0 AS g FROM b JOIN documents d USING (doc_id)),
        c AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n, substr(text, 1, 800) AS t FROM d8 WHERE NOT g QUALIFY n <= 5),
        k AS (SELECT query_id, count(*) AS n_chunks, md5(string_agg(t, '|' ORDER BY n)) AS texts_md5 FROM c GROUP BY 1)
        SELECT query_id, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_graph, 0) AS n_graph, coalesce(texts_md5, md5('')) AS texts_md5
        FROM (SELECT query_id, count(*) FILTER (g) AS n_graph FROM d8 GROUP BY 1) LEFT JOIN k USING (query_id)""",
}
