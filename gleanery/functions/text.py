"""Text expressions. All are JVM-side column expressions with Python-like Unicode semantics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery import constants as K


def rx(pattern: str, ignore_case: bool = False, multiline: bool = False) -> str:
    """Java pattern whose ``\\s \\w \\d \\b`` are Unicode-aware and whose only line break is ``\\n``."""
    return f"(?dU{'i' if ignore_case else ''}{'m' if multiline else ''}){pattern}"


def matches(c: Column, pattern: str, ignore_case: bool = False, multiline: bool = False) -> Column:
    return F.regexp_like(c, F.lit(rx(pattern, ignore_case, multiline)))


def find_all(c: Column, pattern: str, group: int = 1, ignore_case: bool = False, multiline: bool = False) -> Column:
    return F.regexp_extract_all(c, F.lit(rx(pattern, ignore_case, multiline)), F.lit(group))


def first_match(c: Column, pattern: str, group: int = 1, ignore_case: bool = False, multiline: bool = False) -> Column:
    """The group's text, or an empty string when the pattern does not occur."""
    return F.regexp_extract(c, rx(pattern, ignore_case, multiline), group)


def replace_all(c: Column, pattern: str, replacement, ignore_case: bool = False) -> Column:
    return F.regexp_replace(c, F.lit(rx(pattern, ignore_case)), replacement if isinstance(replacement, Column)
                            else F.lit(replacement))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row.

    An expression that a lambda merely mentions is evaluated again for every element; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), 0)


def unnest(df: DataFrame, array: Column, name: str, *keep) -> DataFrame:
    """One row per array element, next to the kept columns; elements must not be null.

    A plain ``explode`` makes the optimizer add a "not empty" filter below it, which evaluates a computed array again.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def pos_unnest(df: DataFrame, array: Column, pos: str, name: str, *keep) -> DataFrame:
    """``unnest`` with the element's position."""
    return df.select(*keep, F.posexplode_outer(array).alias(pos, name)).where(F.col(pos).isNotNull())


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def fingerprint_text(c: Column) -> Column:
    return collapse(strip(F.lower(c)))


def content_hash(c: Column) -> Column:
    return F.md5(fingerprint_text(c))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?U)\S+"))


def alpha_ratio(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}]+", "")) / F.greatest(F.length(c), F.lit(1))


def truncate(c: Column, max_chars: int = 300) -> Column:
    return F.when(F.length(c) > max_chars, F.concat(F.substring(c, 1, max_chars), F.lit("…"))).otherwise(c)


def quote_literal(c: Column) -> Column:
    """Escape ``$`` and backslash so that the value can serve as a regex replacement."""
    return F.regexp_replace(c, r"([\\$])", r"\\$1")


def any_contains(haystack: Column, needles: Column) -> Column:
    return F.exists(needles, lambda t: F.contains(haystack, t))


def title_case(c: Column) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the others ("o'neil-smith" -> "O'Neil-Smith").

    Splits into runs of letters and runs of other characters, so that ``initcap`` sees one word at a time.
    """
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.initcap(r)), "")


def _no_strings() -> Column:
    return F.array().cast("array<string>")


# --- course codes ---------------------------------------------------------------------------------
def extract_codes(c: Column) -> Column:
    """Sorted distinct normalized codes ("cse 474a" -> "CSE 474A") found by the case-sensitive pattern."""
    numbers = find_all(c, K.CODE_STRICT, 2)
    codes = F.array_sort(F.array_distinct(
        F.transform(numbers, lambda n: F.concat(F.lit(K.CODE_PREFIX + " "), F.upper(n)))))
    # most texts name no course: a plain substring test spares them the pattern
    return F.when(F.contains(c, F.lit("CSE")) | F.contains(c, F.lit("cse")), codes).otherwise(_no_strings())


def normalize_code(c: Column) -> Column:
    """Any spelling that the loose pattern accepts to "CSE nnn"; upper-cases the suffix letter."""
    return F.concat(F.lit(K.CODE_PREFIX + " "), F.upper(F.regexp_replace(F.substring(c, 4, 64), r"(?U)\s+", "")))


def loose_codes(c: Column) -> Column:
    """Codes as the page extractor records them: a spelling the strict pattern rejects stays as written."""
    def fix(raw):
        number = first_match(raw, K.CODE_STRICT, 2)
        return F.when(number != "", F.concat(F.lit(K.CODE_PREFIX + " "), F.upper(number))).otherwise(raw)

    codes = F.array_sort(F.array_distinct(F.transform(find_all(c, K.CODE_LOOSE, 1, ignore_case=True), fix)))
    return F.when(F.contains(F.lower(c), F.lit("cse")), codes).otherwise(_no_strings())


# --- tokens ---------------------------------------------------------------------------------------
_MARK = "\u0001"


def tokens(c: Column) -> Column:
    """Lower-cased alphanumeric runs longer than one character and not stop words; codes keep "CSE 574A" spelling. Null has none."""
    low = F.lower(F.coalesce(c, F.lit("")))
    marked = replace_all(low, r"\b(cse)\s*(\d{3}[a-z]?)\b", f"{_MARK}$1 {_MARK}$2")
    plain = F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))
    special = F.transform(
        F.regexp_extract_all(marked, F.lit(f"{_MARK}?[a-z0-9]+"), F.lit(0)),
        lambda t: F.when(t.startswith(_MARK), F.upper(F.substring(t, 2, 64))).otherwise(t))
    raw = F.when(F.contains(low, F.lit("cse")), special).otherwise(plain)
    return F.filter(raw, lambda t: (F.length(t) > 1) & ~t.isin(K.STOPWORDS))


def boost_terms(c: Column) -> Column:
    """Distinct lower-case terms worth an exact-match boost: codes (with and without space) and name words."""
    codes = F.transform(extract_codes(c), F.lower)
    joined = F.transform(codes, lambda t: F.replace(t, F.lit(" "), F.lit("")))
    names = F.flatten(F.transform(find_all(c, K.TITLE_NAME, 1), lambda n: F.split(F.lower(n), r"(?U)\s+")))
    return F.array_distinct(F.concat(codes, joined, F.filter(names, lambda w: F.length(w) > 2)))


def expand_query(c: Column, expansions=K.EXPANSIONS, anchored: bool = False) -> Column:
    """Append the words of every expansion whose pattern occurs; each step sees what earlier steps appended."""
    rules = F.array(*[
        F.struct(F.lit(rx(rf"\b(?:{p})\b" if anchored else p, ignore_case=True)).alias("p"), F.lit(" " + w).alias("w"))
        for p, w in expansions])
    return strip(F.aggregate(
        rules, c, lambda q, r: F.when(F.regexp_like(q, r["p"]), F.concat(q, r["w"])).otherwise(q)))


def normalize_area(c: Column) -> Column:
    """Canonical research-area name: alias table, else title case."""
    aliases = F.create_map(*[F.lit(x) for kv in K.AREA_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(aliases, F.lower(strip(c))), title_case(strip(c)))


def prerequisite_codes(c: Column, pattern: str = K.GRAPH_PREREQ) -> Column:
    spans = find_all(c, pattern, 1, ignore_case=True)
    return F.array_sort(F.array_distinct(F.flatten(F.transform(spans, extract_codes))))


def headings(c: Column) -> Column:
    return find_all(c, K.HEADING_LINE, 1, multiline=True)


def clean_lines(c: Column) -> Column:
    """Drop JSON blobs, noise lines, lines with few letters (unless they name a course) and repeated lines."""
    text = F.regexp_replace(c, rx(K.JSON_BLOB), "")
    lines = F.transform(F.split(text, "\n"), strip)
    keep = F.filter(lines, lambda s: (
        (F.length(s) >= 2)
        & ~matches(s, K.NOISE_LINE, ignore_case=True)
        & ((F.length(s) <= 5) | (alpha_ratio(s) >= 0.40) | matches(s, K.CODE_LOOSE, ignore_case=True))))
    return keep_first_lines(keep)


def keep_first_lines(lines: Column) -> Column:
    """Join the lines, keeping the first of those equal up to case and white space.

    The lines are sorted with their positions, the first of every run of equal keys is kept, and the rest is put back
    into the order of the text.
    """
    tagged = F.transform(lines, lambda s, i: F.struct(collapse(F.lower(s)).alias("k"), i.alias("i"), s.alias("s")))
    # equal keys become neighbours, smallest position first
    firsts = let(F.array_sort(tagged), lambda o: F.filter(o, lambda x, i: (i == 0) | (F.get(o, i - 1)["k"] != x["k"])))
    back = F.array_sort(F.transform(firsts, lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s"))))
    return strip(F.array_join(F.transform(back, lambda x: x["s"]), "\n"))


# --- counting inside a row ------------------------------------------------------------------------
def value_counts(values: Column) -> Column:
    """Array of (v, n, first) for the distinct values of an array, in value order.

    The values are sorted with their positions, so equal ones form a run; a run's length is the distance to the next
    run's start. One row costs a sort, and nothing is shuffled.
    """
    tagged = F.array_sort(F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    starts = let(tagged, lambda o: F.filter(
        F.transform(o, lambda x, j: F.struct(
            x["v"].alias("v"), x["i"].alias("i"), j.alias("j"), ((j == 0) | (F.get(o, j - 1)["v"] != x["v"])).alias("head"),
            F.size(o).alias("total"))),
        lambda x: x["head"]))
    return let(starts, lambda o: F.transform(o, lambda x, r: F.struct(
        x["v"].alias("v"), (F.coalesce(F.get(o, r + 1)["j"], x["total"]) - x["j"]).alias("n"), x["i"].alias("first"))))


def topics(c: Column, k: int = 6) -> Column:
    """Array of (topic, n): the k most frequent content words in Title Case, ties by first appearance."""
    words = F.filter(
        F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)),
        lambda w: F.regexp_like(w, F.lit(r"\A[a-z]{4,}\z")) & ~w.isin(K.TOPIC_STOPWORDS))
    ranked = F.array_sort(F.transform(value_counts(words), lambda x: F.struct(
        (-x["n"]).alias("minus_n"), x["first"].alias("first"), x["v"].alias("v"))))
    return F.transform(F.slice(ranked, 1, k), lambda x: F.struct(F.initcap(x["v"]).alias("topic"), (-x["minus_n"]).alias("n")))
