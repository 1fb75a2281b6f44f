"""URL expressions built from ``parse_url`` and array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery import constants as K
from gleanery.functions.text import let, matches, strip

# scheme, authority, path, query, fragment (RFC 3986, appendix B)
_URL = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _URL, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def host(url: Column) -> Column:
    return _part(url, 2)


def path(url: Column) -> Column:
    return _part(url, 3)


def query(url: Column) -> Column:
    return _part(url, 4)


def _assemble(scheme_: Column, host_: Column, path_: Column, query_: Column) -> Column:
    return F.concat(
        F.when(scheme_ != "", F.concat(scheme_, F.lit(":"))).otherwise(""),
        F.when(host_ != "", F.concat(F.lit("//"), host_)).otherwise(""),
        path_,
        F.when(query_ != "", F.concat(F.lit("?"), query_)).otherwise(""))


def _no_trailing_slash(p: Column) -> Column:
    return F.regexp_replace(p, r"/+\z", "")


def canonical_url(url: Column, catalog_host: str = K.CATALOG_HOST, keys=K.CATALOG_KEYS) -> Column:
    """Identity of a page: catalog pages keep the named query keys in sorted order, others lose query and fragment."""
    u = strip(url)
    pairs = F.filter(F.split(query(u), "&"), lambda p: F.contains(p, F.lit("=")))
    # the last value of a repeated key wins
    last = F.map_from_entries(F.array_sort(F.map_entries(F.aggregate(
        pairs, F.create_map().cast("map<string,string>"),
        lambda acc, p: F.map_concat(
            F.map_filter(acc, lambda k, v: k != F.substring_index(p, "=", 1)),
            F.create_map(F.substring_index(p, "=", 1), F.substring(p, F.instr(p, "=") + 1, F.length(p)))),
    ))))
    kept = F.map_filter(last, lambda k, v: k.isin(*keys))
    catalog_query = F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "&")
    return F.when(host(u) == catalog_host, _assemble(scheme(u), host(u), path(u), catalog_query)).otherwise(
        _assemble(scheme(u), host(u), _no_trailing_slash(path(u)), F.lit("")))


def _decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def _encode(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def without_tracking(url: Column, drop=K.TRACKING_PARAMETERS) -> Column:
    """Strip the fragment, trailing slashes and tracking parameters; keeps the first value of a repeated parameter."""
    u = strip(url)
    pairs = F.transform(
        F.filter(F.split(query(u), "&"), lambda p: (F.instr(p, "=") > 0) & (F.instr(p, "=") < F.length(p))),
        lambda p: F.struct(_decode(F.substring_index(p, "=", 1)).alias("k"),
                           _decode(F.substring(p, F.instr(p, "=") + 1, F.length(p))).alias("v")))
    first = let(pairs, lambda ps: F.filter(ps, lambda p, i: (
        F.array_position(F.transform(ps, lambda x: x["k"]), p["k"]) == i + 1) & ~p["k"].isin(*drop)))
    kept = F.array_join(F.transform(first, lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&")
    return _assemble(scheme(u), host(u), _no_trailing_slash(path(u)), kept)


def page_type(url: Column, table=K.PAGE_TYPES, default: str = "general") -> Column:
    out = F.lit(default)
    for fragment, label in reversed(tuple(table)):
        out = F.when(F.contains(url, F.lit(fragment)), F.lit(label)).otherwise(out)
    return out


def _by_name(name: Column, table, default: str) -> Column:
    out = F.lit(default)
    for words, label in reversed(tuple(table)):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(name, F.lit(w))
        out = F.when(hit, F.lit(label)).otherwise(out)
    return out


def pdf_type(file_name: Column) -> Column:
    return _by_name(F.lower(file_name), K.PDF_TYPES_BY_NAME, "pdf")


def legacy_pdf_type(file_stem: Column) -> Column:
    return _by_name(F.lower(file_stem), K.LEGACY_PDF_TYPES_BY_NAME, "pdf_document")


def is_allowed(
    url: Column,
    department_host: str = K.DEPARTMENT_HOST,
    department_path: str = K.DEPARTMENT_PATH,
    catalog_host: str = K.CATALOG_HOST,
    catalog_patterns=K.CATALOG_ALLOWED,
    extra_hosts=K.EXTRA_HOSTS,
) -> Column:
    h, p = host(url), path(url)
    name = F.regexp_extract(p, r"([^/]*)/*\z", 1)
    extension = F.lower(F.regexp_extract(name, r"[^.].*\.([^.]+)\z", 1))
    catalog = F.lit(False)
    for pattern in catalog_patterns:
        catalog = catalog | matches(url, pattern)
    skipped = F.lit(False)
    for subtree in K.SKIPPED_SUBTREES:
        skipped = skipped | F.contains(p, F.lit(subtree))
    in_scope = (
        F.when(h == department_host, p.startswith(department_path))
        .when(h == catalog_host, catalog)
        .when(h.isin(*extra_hosts), ~skipped)
        .otherwise(F.lit(False)))
    return scheme(url).isin("http", "https") & ~extension.isin(*K.SKIPPED_EXTENSIONS) & in_scope


def is_external_site(url: Column, home: str = "buffalo.edu") -> Column:
    return scheme(url).isin("http", "https") & ~F.contains(url, F.lit(home))


def is_kept_pdf(url: Column) -> Column:
    name = F.lower(F.regexp_extract(url, r"([^/]*)\z", 1))
    return ~matches(name, "|".join(K.PDF_SKIP)) & matches(name, "|".join(K.PDF_KEEP))


def pdf_file_name(url: Column) -> Column:
    name = F.regexp_replace(F.regexp_extract(url, r"([^/]*)\z", 1), r"(?U)[^\w\-.]", "_")
    return F.when(F.lower(name).endswith(".pdf"), name).otherwise(F.concat(name, F.lit(".pdf")))


def resolve(base: Column, ref: Column) -> Column:
    """Absolute URL of a link: absolute, scheme-relative, fragment, query, rooted and relative references."""
    base_s, base_h, base_p, base_q = scheme(base), host(base), path(base), query(base)
    has_query = F.contains(ref, F.lit("?"))
    ref_tail = F.concat(F.when(has_query, F.concat(F.lit("?"), query(ref))).otherwise(""),
                        F.when(F.contains(ref, F.lit("#")), F.concat(F.lit("#"), _part(ref, 5))).otherwise(""))
    folder = F.regexp_replace(F.when(base_p == "", F.lit("/")).otherwise(base_p), r"[^/]*\z", "")
    site = F.concat(base_s, F.lit("://"), base_h)
    joined = remove_dot_segments(F.concat(folder, path(ref)))
    return (
        F.when(F.regexp_like(ref, F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*:")), ref)
        .when(ref.startswith("//"), F.concat(base_s, F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(site, remove_dot_segments(path(ref)), ref_tail))
        .when(path(ref) == "", F.concat(
            site, base_p,
            F.when(has_query, ref_tail).otherwise(
                F.concat(F.when(base_q != "", F.concat(F.lit("?"), base_q)).otherwise(""), ref_tail))))
        .otherwise(F.concat(site, joined, ref_tail)))


def remove_dot_segments(p: Column) -> Column:
    """Fold ``.`` and ``..`` segments of an absolute path."""
    segments = F.slice(F.split(p, "/"), 2, 1_000_000)
    folded = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc).otherwise(F.concat(acc, F.array(s))))
    trailing = F.when(F.regexp_like(p, F.lit(r"/\.\.?\z")) , F.lit("/")).otherwise(F.lit(""))
    rebuilt = F.concat(F.lit("/"), F.array_join(folded, "/"), trailing)
    return F.when(F.contains(p, F.lit("/.")), F.regexp_replace(rebuilt, r"/+\z", "/")).otherwise(p)
