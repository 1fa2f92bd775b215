"""The text functions and tables of the queries, as DuckDB's SQL."""

from __future__ import annotations

from quillstone.functions import words as W
from quillstone.functions.text import LOWER, UPPER

#: One row for each drawer id.
DRAWERS = "d AS (SELECT * FROM drawers WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY filed_at NULLS LAST, content) = 1)"
CORPUS = "c AS (SELECT * FROM multi_domain_queries WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY filed_at NULLS LAST, content) = 1)"
FACTS = """
    t AS (SELECT DISTINCT id, replace(replace(lower(subject), ' ', '_'), '''', '') AS subject, replace(lower(predicate), ' ', '_') AS predicate,
            replace(replace(lower(object), ' ', '_'), '''', '') AS object, valid_from, valid_to, confidence, source_closet, source_file, extracted_at
          FROM triples WHERE subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL),
    names AS (SELECT replace(replace(lower(name), ' ', '_'), '''', '') AS id, name, extracted_at FROM
            (SELECT subject AS name, extracted_at FROM triples UNION ALL SELECT object, extracted_at FROM triples) WHERE name IS NOT NULL),
    e AS (SELECT id, name FROM names QUALIFY row_number() OVER (PARTITION BY id ORDER BY extracted_at NULLS LAST, name) = 1)
"""
ROOMS = f"""
    {DRAWERS},
    rooms AS (SELECT room, list_sort(list(DISTINCT wing) FILTER (wing IS NOT NULL)) AS wings, list_sort(list(DISTINCT left(filed_at, 10)) FILTER (filed_at IS NOT NULL)) AS dates, count(*) AS count
              FROM d WHERE room <> '' AND room <> 'general' GROUP BY room)
"""


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def ascii_lower(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


def tokens(x: str) -> str:
    cut = f"regexp_replace({x}, '([a-z]|[^\\x00-\\x7F])([A-Z])', '\\1 \\2', 'g')"
    parts = f"string_split(regexp_replace({ascii_lower(cut)}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ')"
    return f"list_filter({parts}, lambda t: strlen(t) > 1 AND NOT list_contains({listed(W.STOPWORDS)}, t))"


def lexical(x: str) -> str:
    return f"regexp_extract_all(lower(strip_accents(coalesce({x}, ''))), '[\\p{{L}}\\p{{N}}]+')"


def memory_date(x: str) -> str:
    iso = f"CASE WHEN regexp_matches(left({x}, 10), '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN try_cast(left({x}, 10) AS DATE) END"
    return f"coalesce({iso}, CASE WHEN regexp_matches({x}, '^\\d{{4}}/\\d{{2}}/\\d{{2}} \\(') THEN try_cast(replace(left({x}, 10), '/', '-') AS DATE) END)"


def cosine(a: str, b: str) -> str:
    """Of two DOUBLE[] of one length."""
    return f"CASE WHEN list_dot_product({a}, {a}) * list_dot_product({b}, {b}) = 0 THEN 0.0 ELSE greatest(-1.0, least(1.0, list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))))) END"


def usable(v: str, dim: int) -> str:
    return f"len({v}) = {dim} AND len(list_filter({v}, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"


def excerpt(x: str, n: int) -> str:
    s = f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
    return f"CASE WHEN length({s}) > {n} THEN left({s}, {n}) || '...' ELSE {s} END"


def kind(path: str, wing: str, room: str, missing: str) -> str:
    p = f"replace({ascii_lower(f"coalesce({path}, '')")}, '\\', '/')"
    ext, name = f"regexp_extract({p}, '[^/]\\.([^./]+)$', 1)", f"regexp_extract({p}, '([^/]*)$', 1)"
    marked = " OR ".join(f"coalesce(contains({x}, '{m}'), false)" for m in W.CHAT_MARKERS for x in (ascii_lower(wing), ascii_lower(room), p))
    doc = " OR ".join(f"starts_with({name}, '{d}')" for d in W.DOC_PREFIXES)
    return f"""CASE WHEN {ascii_lower(room)} = 'diary' OR list_contains(string_split({p}, '/'), 'diary') THEN 'diary'
        WHEN list_contains({listed(W.CODE_EXTENSIONS)}, {ext}) THEN 'code' WHEN {marked} THEN 'conversation'
        WHEN list_contains({listed(W.DOC_EXTENSIONS)}, {ext}) OR {doc} THEN 'documentation' WHEN {path} IS NOT NULL THEN 'prose' ELSE '{missing}' END"""


def term_count(term: str, w: str = "w") -> str:
    if term.endswith("*"):
        return f"len(list_filter({w}, lambda x: starts_with(x, {quoted(term[:-1])})))"
    a, b = term.split(" ")
    return f"len(list_filter(range(1, len({w})), lambda i: {w}[i] = {quoted(a)} AND {w}[i + 1] = {quoted(b)}))"


def bm25(terms: list[str], k1: float, b: float) -> str:
    """CTEs ``counted`` (id, content_kind, wing, room, length, tf) and ``stats`` (mean, idf), over ``d``."""
    tf = ", ".join(term_count(t) for t in terms)
    idf = ", ".join(f"greatest(ln((count(*) - count(*) FILTER (tf[{i + 1}] > 0) + 0.5) / (count(*) FILTER (tf[{i + 1}] > 0) + 0.5)), 1e-6)" for i in range(len(terms)))
    return f"""
        counted AS (SELECT id, content_kind, wing, room, len(w) AS length, [{tf}] AS tf FROM (SELECT *, {lexical('content')} AS w FROM d)),
        stats AS (SELECT avg(length) AS mean, [{idf}] AS idf FROM counted)"""


def bm25_score(indices, k1: float, b: float) -> str:
    return " + ".join(f"idf[{i + 1}] * tf[{i + 1}] * {k1 + 1} / (tf[{i + 1}] + {k1} * ({1 - b} + {b} * length / mean))" for i in indices)
