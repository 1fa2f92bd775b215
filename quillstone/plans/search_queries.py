"""Retrieval: vectors, words, fusion, reranking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.functions import words as W
from quillstone.functions.vectors import PRIME, SEED, cosine, hash_embed_text
from quillstone.operators import search
from quillstone.plans import prepared
from quillstone.plans import sqltext as S
from quillstone.plans.catalogue import query
from quillstone.plans.sqltext import DRAWERS
from quillstone.plans.tables import corpus, drawers, table

DIM = prepared.DIM
ASK = "Can you remind me how we update the frozen tokenizer config after the login error 10 days ago"
AS_OF, WING = "2026-04-10T09:00:00+02:00", "larkspur"
TERMS = ["frozen*", "tokenizer*", "fetch*", "cursor*"]


def _asked(spark, folder) -> list[float]:
    """The vector of the first drawer that has a usable one."""
    rows = table(spark, folder, "drawers").where((F.size("embedding") == DIM) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return rows.agg(F.min_by("embedding", "id")).first()[0]


_V = f"""{DRAWERS}, v AS (SELECT *, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM d WHERE {S.usable('embedding', DIM)}),
    q AS (SELECT e AS qe FROM v WHERE id = (SELECT min(id) FROM v))"""
_SIM = S.cosine("e", "qe")


@query(f"WITH {_V} SELECT id, round({_SIM}, 6) AS similarity FROM v, q ORDER BY {_SIM} DESC, id DESC LIMIT 50")
def cosine_topk(spark, folder):
    return search.cosine_topk(drawers(spark, folder), _asked(spark, folder), 50).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {_V} SELECT content_kind, id, row_number() OVER (PARTITION BY content_kind ORDER BY {_SIM} DESC, id DESC) AS rank FROM v, q QUALIFY rank <= 10")
def cosine_topk_per_kind(spark, folder):
    vector = F.array(*[F.lit(float(x)) for x in _asked(spark, folder)])
    rows = drawers(spark, folder).where((F.size("embedding") == DIM) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    order = Window.partitionBy("content_kind").orderBy(F.desc("s"), F.desc("id"))
    return rows.select("content_kind", "id", cosine(F.col("embedding"), vector).alias("s")).withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 10").drop("s")


@query(f"WITH {_V} SELECT id, round({_SIM}, 6) AS similarity FROM v, q WHERE {_SIM} >= 0.5")
def cosine_min_score(spark, folder):
    vector = F.array(*[F.lit(float(x)) for x in _asked(spark, folder)])
    rows = drawers(spark, folder).where((F.size("embedding") == DIM) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return rows.select("id", cosine(F.col("embedding"), vector).alias("similarity")).where("similarity >= 0.5").withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {DRAWERS} SELECT id, array_to_string({S.tokens('content')}, ' ') AS tokens FROM d")
def tokenize(spark, folder):
    return drawers(spark, folder).select("id", F.array_join(T.identifier_tokens(F.col("content")), " ").alias("tokens"))


@query(f"WITH {DRAWERS} SELECT id, len({S.tokens('content')})::INT AS n, len(list_distinct({S.tokens('content')}))::INT AS n_distinct FROM d")
def tokenize_counts(spark, folder):
    t = T.identifier_tokens(F.col("content"))
    return drawers(spark, folder).select("id", F.size(t).alias("n"), F.size(F.array_distinct(t)).alias("n_distinct"))


@query(f"WITH {DRAWERS} SELECT term, count(*) AS tf, count(DISTINCT id) AS df FROM (SELECT id, unnest({S.lexical('content')}) AS term FROM d) GROUP BY term")
def term_frequency(spark, folder):
    rows = drawers(spark, folder).select("id", F.explode(T.lexical_words(F.col("content"))).alias("term")).groupBy("term", "id").agg(F.count("*").alias("n"))
    return rows.groupBy("term").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))


@query(f"WITH {DRAWERS} SELECT term, id, count(*) AS tf, min(pos)::INT AS first_position FROM (SELECT id, unnest({S.lexical('content')}) AS term, unnest(range(0, len({S.lexical('content')}))) AS pos FROM d) GROUP BY term, id")
def postings(spark, folder):
    rows = prepared.store(spark, folder).inverted().postings
    return rows.select("term", "id", F.col("tf").cast("long").alias("tf"), F.col("places")[0].alias("first_position"))


_TOP = S.bm25_score(range(len(TERMS)), search.K1, search.B)


@query(f"WITH {DRAWERS}, {S.bm25(TERMS, search.K1, search.B)} SELECT id, round({_TOP}, 6) AS score FROM counted, stats WHERE list_max(tf) > 0 ORDER BY {_TOP} DESC, id LIMIT 50")
def bm25_topk(spark, folder):
    return search.bm25_topk(prepared.store(spark, folder).inverted(), TERMS, 50).withColumn("score", F.round("score", 6))


@query(f"WITH {DRAWERS}, {S.bm25(TERMS, search.K1, search.B)} SELECT id, round({_TOP}, 6) AS score FROM counted, stats WHERE list_max(tf) > 0 AND wing = '{WING}' ORDER BY {_TOP} DESC, id LIMIT 50")
def bm25_filtered_global_stats(spark, folder):
    return search.bm25_topk(prepared.store(spark, folder).inverted(), TERMS, 50, scope=F.col("wing") == WING).withColumn("score", F.round("score", 6))


@query(f"WITH {DRAWERS} SELECT id, {S.term_count('next step')}::INT AS n FROM (SELECT id, {S.lexical('content')} AS w FROM d) WHERE n > 0")
def phrase_match(spark, folder):
    return drawers(spark, folder).select("id", search.term_count(T.lexical_fold(F.coalesce("content", F.lit(""))), "next step").alias("n")).where("n > 0")


# --- hybrid search: the same views in SQL, whose texts and weights are fixed by the query ---

_DENSE, _LEXICAL = search.dense_views(ASK), search.lexical_views(ASK)
_K = search.depth(20)  # that of any limit up to 128
_ALL_TERMS = list(dict.fromkeys(t for v in _LEXICAL for t in v.terms))


def _doubles(values) -> str:
    return "[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in values) + "]"


def _applies(target: str) -> str:
    return {"all": "true", "code": "content_kind = 'code'", "general": "coalesce(content_kind <> 'code', false)"}[target]


_WORDS = f"regexp_extract_all({S.ascii_lower('body')}, '[\\p{{L}}\\p{{N}}]+')"
_IDENT = S.tokens("coalesce(source_file, '')")
_SOURCE = "array_to_string(list_slice(list_filter(string_split(replace(source_file, '\\', '/'), '/'), lambda p: p <> ''), -6, -1), '/')"
#: Drawers with the vectors of the hash encoder.
_ENCODED = f"""{DRAWERS},
    b AS (SELECT *, coalesce(retrieval_text, content) AS raw, coalesce({_SOURCE}, '') AS src FROM d),
    i AS (SELECT *, list_concat({S.tokens("coalesce(source_file, '')")}, {S.tokens("coalesce(raw, '')")}) AS idents FROM b),
    u AS (SELECT *, list_filter(idents, lambda x, k: list_position(idents, x) = k)[1:48] AS names FROM i),
    x AS (SELECT *, coalesce(CASE WHEN content_kind = 'code' THEN CASE WHEN src <> '' THEN 'source: ' || src || chr(10) ELSE '' END
            || CASE WHEN len(names) > 0 THEN 'identifiers: ' || array_to_string(names, ' ') || chr(10) ELSE '' END || raw ELSE raw END, '') AS body FROM u),
    w AS (SELECT id, unnest({_WORDS}) AS word FROM x),
    vocabulary AS (SELECT word, list_reduce(list_transform(range(0, strlen(word)), lambda i: ('0x' || substr(hex(encode(word)), (2 * i + 1)::INT, 2))::INT::HUGEINT),
            lambda s, c: (xor(s, c) * {PRIME}) % 18446744073709551616, {SEED}::HUGEINT) % {DIM} AS place FROM (SELECT DISTINCT word FROM w)),
    counts AS (SELECT id, place, count(*) AS n FROM w JOIN vocabulary USING (word) GROUP BY ALL),
    dense AS (SELECT id, list_transform(range(0, {DIM}), lambda p: coalesce(m[p::HUGEINT], 0)::DOUBLE) AS raw_e, sqrt(s) AS norm FROM (SELECT id, map_from_entries(list((place, n))) AS m, sum(n * n) AS s FROM counts GROUP BY id)),
    encoded AS (SELECT x.id, list_transform(coalesce(raw_e, list_transform(range(0, {DIM}), lambda p: 0.0)), lambda z: (z / coalesce(norm, 1))::FLOAT::DOUBLE) AS e FROM x LEFT JOIN dense USING (id))"""


def _with_vectors(spark, folder):
    return prepared.store(spark, folder).drawers()


def _search(spark, folder, asked: search.Query):
    made = prepared.store(spark, folder)
    return search.hybrid(made.drawers(), asked, _encode, made.inverted())


def _encode(text: str) -> list[float]:
    return hash_embed_text(text, DIM)


@query(f"WITH {_ENCODED} SELECT id, round(list_sum(list_transform(e, lambda z, i: z * i)), 4) AS checksum, len(e)::INT AS n FROM encoded")
def hash_embed_drawers(spark, folder):
    rows = _with_vectors(spark, folder)
    indexed = F.transform("embedding", lambda z, i: z.cast("double") * (i + 1))
    return rows.select("id", F.round(F.aggregate(indexed, F.lit(0.0), lambda s, z: s + z), 4).alias("checksum"), F.size("embedding").alias("n"))


def _dense_sql(scope: str = "true", views=None) -> str:
    parts = [
        f"SELECT id, {i} AS view, {v.weight} AS weight, row_number() OVER (ORDER BY round({S.cosine('e', _doubles(_encode(v.text)))}, 12) DESC, id DESC) AS rank FROM encoded JOIN d USING (id) WHERE {_applies(v.target)} AND {scope} QUALIFY rank <= {_K}"
        for i, v in enumerate(views or _DENSE)
    ]
    return " UNION ALL ".join(parts)


def _lexical_sql(scope: str = "true", views=None) -> str:
    parts = []
    views = views or _LEXICAL
    every = list(dict.fromkeys(t for v in views for t in v.terms))
    for i, v in enumerate(views):
        mine = [every.index(t) for t in v.terms]
        hit = "(" + " OR ".join(f"tf[{j + 1}] > 0" for j in mine) + ")"
        parts.append(f"SELECT id, {i} AS view, {v.weight} AS weight, row_number() OVER (ORDER BY {S.bm25_score(mine, search.K1, search.B)} DESC, id) AS rank FROM counted, stats WHERE {hit} AND {_applies(v.target)} AND {scope} QUALIFY rank <= {_K}")
    return " UNION ALL ".join(parts)


_COUNTS = S.bm25(_ALL_TERMS, search.K1, search.B)


@query(f"WITH {_ENCODED} SELECT id, view::INT AS view, rank::INT AS rank FROM ({_dense_sql()})")
def multi_view_dense(spark, folder):
    rows = search.dense_ranks(_with_vectors(spark, folder), [(v, _encode(v.text)) for v in _DENSE], _K)
    return rows.select("id", "view", "rank")


@query(f"WITH {DRAWERS}, {_COUNTS} SELECT id, view::INT AS view, rank::INT AS rank FROM ({_lexical_sql()})")
def multi_view_lexical(spark, folder):
    return search.lexical_ranks(prepared.store(spark, folder).inverted(), _LEXICAL, _K).select("id", "view", "rank")


_FUSED = f"fused AS (SELECT id, sum(weight / (60 + rank)) AS fused FROM ({_dense_sql()} UNION ALL {_lexical_sql()}) GROUP BY id)"


@query(f"WITH {_ENCODED}, {_COUNTS}, {_FUSED} SELECT id, round(fused, 9) AS fused FROM fused")
def rrf_fuse(spark, folder):
    rows = _with_vectors(spark, folder)
    dense = search.dense_ranks(rows, [(v, _encode(v.text)) for v in _DENSE], _K)
    return search.fuse(dense, search.lexical_ranks(prepared.store(spark, folder).inverted(), _LEXICAL, _K)).withColumn("fused", F.round("fused", 9))


@query(f"WITH {_ENCODED}, {_COUNTS}, {_FUSED} SELECT id, round(fused / (SELECT max(fused) FROM fused), 6) AS relevance FROM fused")
def relevance_normalise(spark, folder):
    rows = rrf_fuse_raw(spark, folder)
    return search.scaled(rows.withColumnRenamed("fused", "relevance"), "relevance").withColumn("relevance", F.round("relevance", 6))


def rrf_fuse_raw(spark, folder):
    rows = _with_vectors(spark, folder)
    dense = search.dense_ranks(rows, [(v, _encode(v.text)) for v in _DENSE], _K)
    return search.fuse(dense, search.lexical_ranks(prepared.store(spark, folder).inverted(), _LEXICAL, _K))


def _any(values, x: str) -> str:
    return "(" + (" OR ".join(f"contains({x}, {S.quoted(v)})" for v in values) or "false") + ")"


def _hits(tokens, there: str) -> str:
    return "(" + (" + ".join(f"list_contains({there}, {S.quoted(t)})::INT" for t in tokens) or "0") + ")"


def _code_sql(ask: str = ASK) -> str:
    own = T.tokens_of(ask)
    found = T.concepts(own)
    tokens = [*own, *(c for c in found if c not in own)]
    compounds = list(dict.fromkeys([*T.variants(own), *T.variants(found)]))
    compact = [v for v in compounds if not set(v) & set(" _-") and len(v.encode()) >= 6]
    n = _hits(tokens, "ctok")
    return f"""(CASE WHEN {_any(compounds, 'fname')} THEN 0.9 WHEN {_any(compounds, 'lsource')} THEN 0.6 ELSE 0.0 END + CASE WHEN {_any(compounds, 'lcontent')} THEN 0.45 ELSE 0.0 END
        + CASE WHEN {_any(compact, 'lcontent')} THEN 0.2 ELSE 0.0 END + 0.04 * least({n}, 6) + 0.05 * least({_hits(tokens, 'ptok')}, 4) + CASE WHEN {n} >= 2 THEN 0.1 * {n} / {len(tokens)} ELSE 0.0 END
        - CASE WHEN {_any([chr(92) + 'generated' + chr(92), '/generated/', chr(92) + 'target' + chr(92), '/target/'], 'lsource')} THEN 0.15 ELSE 0.0 END)"""


def _temporal_sql(ask: str = ASK) -> str:
    target = T.relative_date(ask, AS_OF)
    if target is None:
        return "0.0"
    days = f"abs(datediff('day', DATE '{target}', {S.memory_date('filed_at')}))"
    return f"coalesce(CASE WHEN {days} = 0 THEN 0.45 WHEN {days} = 1 THEN 0.35 WHEN {days} <= 3 THEN 0.2 WHEN {days} <= 7 THEN 0.1 WHEN {days} <= 14 THEN 0.04 END, 0.0)"


def _general_sql(ask: str = ASK) -> str:
    own = T.tokens_of(ask)
    core = T.core_tokens(own)
    n = _hits(core, "btok")
    phrases = [f"{a}{sep}{b}" for a, b in zip(core, core[1:]) for sep in " -"]
    likes = f"CASE WHEN {n} > 0 AND {_any(W.PREFERENCE_SPANS, 'lbody')} THEN 0.18 ELSE 0.0 END" if set(own) & set(W.PREFERENCE_WORDS) else "0.0"
    return f"""(0.035 * least({n}, 8) + CASE WHEN {n} >= 2 THEN 0.12 * least(1.0, {n} / {len(core)}) ELSE 0.0 END + CASE WHEN {_any(phrases, 'lbody')} THEN 0.08 ELSE 0.0 END
        + CASE WHEN content_kind = 'documentation' THEN 0.04 * least({_hits(core, 'ptok')}, 3) ELSE 0.0 END + {likes} + {_temporal_sql(ask)})"""


_PARTS = f"""parts AS (SELECT id, content_kind, filed_at, {S.ascii_lower("coalesce(content, '')")} AS lcontent, {S.ascii_lower("coalesce(source_file, '')")} AS lsource,
        {S.ascii_lower("coalesce(retrieval_text, content, '')")} AS lbody, {S.tokens("coalesce(content, '')")} AS ctok, {S.tokens("coalesce(retrieval_text, content, '')")} AS btok FROM d),
    named AS (SELECT *, regexp_extract(lsource, '([^/\\\\]*)$', 1) AS fname, {S.tokens('lsource')} AS ptok FROM parts)"""


@query(f"WITH {DRAWERS}, {_PARTS} SELECT id, round({_code_sql()}, 6) AS boost FROM named WHERE content_kind = 'code'")
def rerank_code(spark, folder):
    return drawers(spark, folder, F.col("content_kind") == "code").transform(search.boosted, ASK, AS_OF).select("id", F.round("boost", 6).alias("boost"))


@query(f"WITH {DRAWERS}, {_PARTS} SELECT id, round({_general_sql()}, 6) AS boost FROM named WHERE content_kind <> 'code'")
def rerank_general(spark, folder):
    return drawers(spark, folder, F.col("content_kind") != "code").transform(search.boosted, ASK, AS_OF).select("id", F.round("boost", 6).alias("boost"))


@query(f"WITH {DRAWERS} SELECT id, {_temporal_sql()} AS boost FROM d")
def temporal_boost(spark, folder):
    return drawers(spark, folder).select("id", search.temporal_boost(F.col("filed_at"), T.relative_date(ASK, AS_OF)).alias("boost"))


_HITS = f"""{_ENCODED}, {_COUNTS}, {_FUSED}, {_PARTS},
    boosted AS (SELECT id, fused / (SELECT max(fused) FROM fused) + CASE WHEN content_kind = 'code' THEN {_code_sql()} ELSE {_general_sql()} END AS b FROM fused JOIN named USING (id)),
    hits AS (SELECT id, greatest(0.0, least(1.0, b / (SELECT max(b) FROM boosted))) AS relevance, {S.cosine('e', _doubles(_encode(ASK)))} AS score FROM boosted JOIN encoded USING (id))"""


@query(f"WITH {_HITS} SELECT id, round(relevance, 6) AS relevance, round(score, 6) AS score FROM hits ORDER BY hits.relevance DESC, hits.score DESC, id LIMIT 20")
def hybrid_search(spark, folder):
    hits = _search(spark, folder, search.Query(ASK, limit=20, as_of=AS_OF))
    return hits.select("id", F.round("relevance", 6).alias("relevance"), F.round("score", 6).alias("score"))


@query(f"WITH {_HITS} SELECT id, round(relevance, 6) AS relevance FROM hits WHERE score >= 0.3 ORDER BY hits.relevance DESC, score DESC, id LIMIT 20")
def hybrid_min_score(spark, folder):
    hits = _search(spark, folder, search.Query(ASK, limit=20, as_of=AS_OF, min_score=0.3))
    return hits.select("id", F.round("relevance", 6).alias("relevance"))


_WING = f"wing = '{WING}'"
_FUSED_WING = f"fused AS (SELECT id, sum(weight / (60 + rank)) AS fused FROM ({_dense_sql(_WING)} UNION ALL {_lexical_sql(_WING)}) GROUP BY id)"


@query(f"""WITH {_HITS.replace(_FUSED, _FUSED_WING)} SELECT content AS text, wing, room, content_kind, coalesce(regexp_extract(source_file, '([^/\\\\]*)$', 1), '?') AS source_file, round(relevance, 3) AS relevance, round(score, 3) AS similarity
    FROM hits JOIN d USING (id) ORDER BY hits.relevance DESC, score DESC, id LIMIT 10""")
def hybrid_wing(spark, folder):
    return search.shown(_search(spark, folder, search.Query(ASK, limit=10, as_of=AS_OF, wing=WING)))


#: A text to file, and how alike what is there may be.
NEW, ALIKE = "Keep the frozen tokenizer config as it was before the login error", 0.3
_NEW_LEXICAL = search.lexical_views(NEW)


@query(f"""WITH {_ENCODED}, {S.bm25(list(dict.fromkeys(t for v in _NEW_LEXICAL for t in v.terms)), search.K1, search.B)},
    fused AS (SELECT id, sum(weight / (60 + rank)) AS fused FROM ({_dense_sql(views=search.dense_views(NEW))} UNION ALL {_lexical_sql(views=_NEW_LEXICAL)}) GROUP BY id), {_PARTS},
    boosted AS (SELECT id, fused / (SELECT max(fused) FROM fused) + CASE WHEN content_kind = 'code' THEN {_code_sql(NEW)} ELSE {_general_sql(NEW)} END AS b FROM fused JOIN named USING (id)),
    hits AS (SELECT id, greatest(0.0, least(1.0, b / (SELECT max(b) FROM boosted))) AS relevance, {S.cosine('e', _doubles(_encode(NEW)))} AS score FROM boosted JOIN encoded USING (id)),
    best AS (SELECT * FROM hits ORDER BY relevance DESC, score DESC, id LIMIT 5)
    SELECT id, round(score, 6) AS score FROM best WHERE score >= {ALIKE}""")
def duplicate_check(spark, folder):
    made = prepared.store(spark, folder)
    return search.duplicates(made.drawers(), NEW, _encode, ALIKE, made.inverted()).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {DRAWERS} SELECT min(id) AS id, count(*) AS copies FROM d WHERE content IS NOT NULL GROUP BY content HAVING count(*) > 1")
def duplicate_exact(spark, folder):
    rows = drawers(spark, folder).where("content is not null").groupBy(F.sha2("content", 256).alias("h"))
    return rows.agg(F.min("id").alias("id"), F.count("*").alias("copies")).where("copies > 1").drop("h")


_CORPUS_Q = "q AS (SELECT DISTINCT u.id AS query_id, u.text AS text, coalesce(u.as_of, '2026-07-15T18:00:00+08:00') AS as_of FROM (SELECT unnest(queries) AS u FROM multi_domain_queries) WHERE u.id IS NOT NULL)"


def _queries(spark, folder):
    rows = table(spark, folder, "multi_domain_queries").select(F.explode("queries").alias("u"))
    return rows.select(F.col("u.id").alias("query_id"), F.col("u.text").alias("text"), F.coalesce("u.as_of", F.lit("2026-07-15T18:00:00+08:00")).alias("as_of")).where("query_id is not null").distinct()


_PHRASES = ["yesterday", "last friday", "3 weeks ago", "twelve days ago", "one month ago", "2 years ago", "soon"]


@query(f"""WITH {_CORPUS_Q}, p AS (SELECT query_id, as_of, text, p FROM q, (SELECT unnest({S.listed(_PHRASES)}) AS p)), t AS (SELECT *, {S.memory_date('as_of')} AS day FROM p)
    SELECT query_id, p AS phrase, strftime(CASE p WHEN 'yesterday' THEN day - 1 WHEN 'last friday' THEN day - (CASE WHEN (isodow(day) - 5 + 7) % 7 = 0 THEN 7 ELSE (isodow(day) - 5 + 7) % 7 END)::INT
        WHEN '3 weeks ago' THEN day - 21 WHEN 'twelve days ago' THEN day - 12 WHEN 'one month ago' THEN day - 30 WHEN '2 years ago' THEN day - 730 END, '%Y-%m-%d') AS day FROM t""")
def relative_date(spark, folder):
    rows = _queries(spark, folder).select("query_id", "as_of", F.explode(F.array(*[F.lit(p) for p in _PHRASES])).alias("phrase"))
    return rows.select("query_id", "phrase", T.relative_day(F.concat(F.lit("what changed "), F.col("phrase"), F.lit("?")), F.col("as_of")).cast("string").alias("day"))


@query(f"WITH {_CORPUS_Q}, w AS (SELECT query_id, text, unnest({S.tokens('text')}) AS t FROM q) SELECT t AS token, count(*) AS n FROM w GROUP BY ALL")
def query_tokens(spark, folder):
    return _queries(spark, folder).select("query_id", F.explode(T.identifier_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query(f"WITH {S.CORPUS} SELECT id, len(queries)::INT AS n FROM c WHERE content_kind = 'code'")
def corpus_code(spark, folder):
    return corpus(spark, folder).where("content_kind = 'code'").select("id", F.size("queries").alias("n"))
