"""Hybrid retrieval: exact vector similarity and BM25, fused by rank, then reranked by kind of content.

The query is expanded on the driver into at most four dense and three lexical views. The
scan of vectors and the scan of words each pass the rows once for all views. Per view a
bounded top list is kept (a partial one per task, before any shuffle); lists are fused
by reciprocal rank; texts are fetched for the survivors only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.functions import words as W
from quillstone.functions.vectors import cosine, cosines
from quillstone.operators.index import Index, counted

RRF, K1, B = 60, 1.2, 0.75
LIMIT, LIMIT_CAP = 5, 1024
_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


@dataclass(frozen=True)
class View:
    text: str
    target: str
    weight: float
    terms: tuple[str, ...] = ()


@dataclass(frozen=True)
class Query:
    query: str
    limit: int = LIMIT
    wing: str | None = None
    room: str | None = None
    min_score: float | None = None
    as_of: str | None = None


def depth(limit: int) -> int:
    """How many candidates each view keeps."""
    return max(1024, min(8192, 8 * min(limit, LIMIT_CAP)))


def dense_views(query: str) -> list[View]:
    tokens = T.tokens_of(query)
    views = [View(query, "all", 1.0)]
    if len(tokens) < 2:
        return views
    found = T.concepts(tokens)
    more = [View(" ".join(W.CANONICAL.get(t, t) for t in tokens), "code", 0.65)]
    if found:
        more.append(View(" ".join([*found, *(a + b for a, b in zip(found, found[1:]))]), "code", 0.8))
    more.append(View(" ".join(T.core_tokens(tokens)), "general", 0.8))
    for v in more:
        if v.text.strip() and all((v.text, v.target) != (o.text, o.target) for o in views):
            views.append(v)
    return views


def lexical_views(query: str) -> list[View]:
    """Terms end in ``*`` (prefix) or are two words in a row."""
    tokens = [T.lexical_folded(t) for t in T.tokens_of(query)]
    views = [View("", "all", 0.9, tuple(f"{t}*" for t in tokens))] if tokens else []
    if len(tokens) < 2:
        return views
    found = T.concepts(tokens)
    if found:
        terms = [f"{c}*" for c in found]
        for a, b in zip(found, found[1:]):
            terms += [f"{a}{b}*", f"{a} {b}"]
        views.append(View("", "code", 1.2, tuple(terms)))
    core = T.core_tokens(tokens)
    if len(core) >= 2 and core != tokens:
        views.append(View("", "general", 1.1, tuple(f"{t}*" for t in core)))
    return views


def applies(target: str | Column, kind: Column) -> Column:
    """All, code only, or everything but code."""
    t = F.lit(target) if isinstance(target, str) else target
    return (t == "all") | ((t == "code") == (kind == "code"))


def held(rows: DataFrame, **columns: Column) -> DataFrame:
    """The rows with columns that are computed once, however often later expressions use them.

    A plain projection would be merged into the next one and its expressions repeated at every use; what a generator
    puts out is not.
    """
    packed = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return rows.select(*rows.columns, F.inline(packed))


def scoped(drawers: DataFrame, wing: str | None, room: str | None) -> DataFrame:
    if wing is not None:
        drawers = drawers.where(F.col("wing") == wing)
    return drawers if room is None else drawers.where(F.col("room") == room)


def _vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def cosine_topk(rows: DataFrame, vector: list[float], k: int, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """``id, similarity``: the k rows closest to a vector; of equal ones the larger id first. Null, non-finite and other-sized vectors take no part."""
    v = F.col(vec_col)
    rows = rows.where((F.size(v) == len(vector)) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return rows.select(id_col, cosine(v, _vector(vector)).alias("similarity")).orderBy(F.desc("similarity"), F.desc(id_col)).limit(k)


def _ranked(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each view, ranked from 1.

    Every task cuts its own rows to ``k`` a view before they are shuffled. Spark does so for ranks up to a limit of the
    session that is below the depth of a view; it is raised to that depth.
    """
    conf = rows.sparkSession.conf
    if int(conf.get(_LIMIT)) < k:
        conf.set(_LIMIT, k)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("view").orderBy(*order))).where(F.col("rank") <= k).select("id", "view", "weight", "rank")


def dense_ranks(drawers: DataFrame, views: list[tuple[View, list[float]]], k: int) -> DataFrame:
    """``id, view, weight, rank``: for each view the k closest rows of its target, ranked from 1."""
    v = F.col("embedding")
    size = len(views[0][1])
    usable = (F.size(v) == size) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    meta = F.array(*[F.struct(F.lit(i).alias("view"), F.lit(w.target).alias("target"), F.lit(w.weight).alias("weight")) for i, (w, _) in enumerate(views)])
    rows = drawers.where(usable).select("id", "content_kind", cosines(v, [q for _, q in views]).alias("c"))
    rows = rows.select("id", "content_kind", F.inline(F.arrays_zip(meta.alias("s"), F.col("c").alias("similarity")))).where(applies(F.col("s.target"), F.col("content_kind")))
    return _ranked(rows.select("id", "s.view", "s.weight", "similarity"), k, F.desc("similarity"), F.desc("id"))


def _begun(text: Column, terms: list[str]) -> Column:
    """The words of a lower-cased text that begin with one of the prefix terms, found in one pass."""
    heads = "|".join(f"\\Q{t[:-1]}\\E" for t in terms if t.endswith("*"))
    if not heads:
        return F.array().cast("array<string>")
    return F.regexp_extract_all(text, F.lit(rf"(?<![\p{{L}}\p{{N}}])(?:{heads})[\p{{L}}\p{{N}}]*"), F.lit(0))


def _count(text: Column, begun: Column, term: str) -> Column:
    if term.endswith("*"):
        return F.size(F.filter(begun, lambda w: F.startswith(w, F.lit(term[:-1]))))
    a, b = term.split(" ")
    return F.regexp_count(text, F.lit(rf"(?<![\p{{L}}\p{{N}}])\Q{a}\E(?=[^\p{{L}}\p{{N}}]+\Q{b}\E(?![\p{{L}}\p{{N}}]))"))


def term_count(text: Column, term: str) -> Column:
    """How often a term occurs in a lower-cased text: words that begin with it, or its two words in a row."""
    return _count(text, _begun(text, [term]), term)


def bm25(drawers: DataFrame, terms: list[str], *, scope: Column | None = None) -> DataFrame:
    """``id, content_kind, length, tf, score``-ready rows with all statistics of the whole collection, from the texts; where there is an index, ``index.counted`` gives the same.

    ``tf`` holds the count of each term; ``idf`` its weight and ``mean`` the average length, over all rows, whatever
    ``scope`` leaves of them. One scan makes the statistics (a single row), one the counts; nothing is exploded.
    """
    rows = held(drawers, _low=T.lexical_fold(F.coalesce("content", F.lit(""))))
    rows = held(rows, length=F.size(F.regexp_extract_all("_low", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))), _begun=_begun(F.col("_low"), terms))
    rows = held(rows, tf=F.array(*[_count(F.col("_low"), F.col("_begun"), t) for t in terms])).drop("_low", "_begun")
    holds = [F.count_if(F.col("tf")[i] > 0).alias(f"n{i}") for i in range(len(terms))]
    stats = rows.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *holds)
    idf = F.array(*[F.greatest(F.log((F.col("n") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5)), F.lit(1e-6)) for i in range(len(terms))])
    stats = stats.select("mean", idf.alias("idf"))
    rows = rows if scope is None else rows.where(scope)
    return rows.crossJoin(F.broadcast(stats))


def bm25_score(indices: list[int]) -> Column:
    norm = K1 * (1 - B + B * F.col("length") / F.col("mean"))
    parts = [F.col("idf")[i] * F.col("tf")[i] * (K1 + 1) / (F.col("tf")[i] + norm) for i in indices]
    return sum(parts[1:], parts[0])


def bm25_topk(drawers: DataFrame | Index, terms: list[str], k: int, *, scope: Column | None = None) -> DataFrame:
    """``id, score``: the k rows of a table or an index that score best for the terms; equal scores by id."""
    rows = counted(drawers, terms, scope) if isinstance(drawers, Index) else bm25(drawers.select("id", "content", "wing", "room"), terms, scope=scope)
    score = bm25_score(list(range(len(terms))))
    return rows.where(F.exists("tf", lambda x: x > 0)).select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def lexical_ranks(drawers: DataFrame | Index, views: list[View], k: int, wing: str | None = None, room: str | None = None) -> DataFrame:
    """``id, view, weight, rank`` by BM25; scope and target are applied before ranks are counted, statistics stay global."""
    terms = list(dict.fromkeys(t for v in views for t in v.terms))
    scope = F.lit(True)
    if wing is not None:
        scope = scope & (F.col("wing") == wing)
    if room is not None:
        scope = scope & (F.col("room") == room)
    rows = counted(drawers, terms, scope) if isinstance(drawers, Index) else bm25(drawers.select("id", "content", "content_kind", "wing", "room"), terms, scope=scope)
    each = []
    for i, v in enumerate(views):
        mine = [terms.index(t) for t in v.terms]
        hit = F.greatest(*[F.col("tf")[j] for j in mine], F.lit(0)) > 0
        each.append(F.struct(F.lit(i).alias("view"), F.lit(v.weight).alias("weight"), F.when(hit & applies(v.target, F.col("content_kind")), bm25_score(mine)).alias("score")))
    rows = rows.select("id", F.explode(F.array(*each)).alias("s")).select("id", "s.view", "s.weight", "s.score").where("score is not null")
    return _ranked(rows, k, F.desc("score"), F.col("id"))


def fuse(*ranks: DataFrame) -> DataFrame:
    """``id, fused``: the sum of weight / (60 + rank) over all lists a row is in."""
    every = ranks[0]
    for r in ranks[1:]:
        every = every.unionByName(r)
    return every.groupBy("id").agg(F.sum(F.col("weight") / (RRF + F.col("rank"))).alias("fused"))


def scaled(rows: DataFrame, column: str) -> DataFrame:
    """A column divided by its largest finite value, within 0 and 1; unchanged where that isn't positive.

    For the fused candidates of one query: at most one row for each view and rank, 57,344 in all, so that one window
    may hold them.
    """
    finite = F.when(~F.isnan(column) & (F.abs(column) != float("inf")), F.col(column))
    top = F.greatest(F.coalesce(F.max(finite).over(Window.partitionBy()), F.lit(0.0)), F.lit(0.0))
    value = F.when(F.col("_top") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(column) / F.col("_top")))).otherwise(F.col(column))
    return rows.withColumn("_top", top).withColumn(column, value).drop("_top")


def _any(values: list[str], x: Column) -> Column:
    """Whether a text holds one of the values: one pass of one pattern."""
    return x.rlike("|".join(f"\\Q{v}\\E" for v in values)) if values else F.lit(False)


def _hits(tokens: list[str], there: Column) -> Column:
    """How many of the tokens, repeats counted, are in an array."""
    return F.size(F.filter(F.array(*[F.lit(t) for t in tokens]), lambda t: F.array_contains(there, t))) if tokens else F.lit(0)


def rerank_parts(rows: DataFrame) -> DataFrame:
    """The rows with what both boosts look at: lower-cased texts and the words of content, body and path."""
    source = T.ascii_lower(F.coalesce("source_file", F.lit("")))
    text = F.coalesce("retrieval_text", "content", F.lit(""))
    return held(
        rows,
        _content=T.ascii_lower(F.coalesce("content", F.lit(""))),
        _body=T.ascii_lower(text),
        _source=source,
        _content_tokens=T.identifier_tokens(F.coalesce("content", F.lit(""))),
        _body_tokens=T.identifier_tokens(text),
        _path_tokens=T.identifier_tokens(source),
    )


PARTS = ("_content", "_body", "_source", "_content_tokens", "_body_tokens", "_path_tokens", "_in_content", "_in_path", "_overlap", "_path_overlap")


def _counted(rows: DataFrame, query: str) -> DataFrame:
    own = T.tokens_of(query)
    found = T.concepts(own) if len(own) >= 2 else []
    tokens, core = [*own, *(c for c in found if c not in own)], T.core_tokens(own)
    return held(rows, _in_content=_hits(tokens, F.col("_content_tokens")), _in_path=_hits(tokens, F.col("_path_tokens")), _overlap=_hits(core, F.col("_body_tokens")), _path_overlap=_hits(core, F.col("_path_tokens")))


def code_boost(query: str) -> Column:
    """What the rerank of code adds: names of files and paths, words and their compounds, less for generated files."""
    own = T.tokens_of(query)
    found = T.concepts(own) if len(own) >= 2 else []
    tokens = [*own, *(c for c in found if c not in own)]
    compounds = list(dict.fromkeys([*T.variants(own), *T.variants(found)]))
    body, source = F.col("_content"), F.col("_source")
    name = F.regexp_extract(source, r"([^/\\]*)$", 1)
    compact = [v for v in compounds if not set(v) & set(" _-") and len(v.encode()) >= 6]
    in_body, in_path = F.col("_in_content"), F.col("_in_path")
    out = F.when(_any(compounds, name), 0.9).when(_any(compounds, source), 0.6).otherwise(0.0)
    out = out + F.when(_any(compounds, body), 0.45).otherwise(0.0) + F.when(_any(compact, body), 0.2).otherwise(0.0)
    if tokens:
        out = out + 0.04 * F.least(in_body, F.lit(6)) + 0.05 * F.least(in_path, F.lit(4))
        out = out + F.when(in_body >= 2, 0.1 * in_body / len(tokens)).otherwise(0.0)
    return out - F.when(_any(["\\generated\\", "/generated/", "\\target\\", "/target/"], source), 0.15).otherwise(0.0)


def temporal_boost(filed_at: Column, target) -> Column:
    days = F.abs(F.datediff(T.memory_date(filed_at), F.lit(target)))
    return F.coalesce(F.when(days == 0, 0.45).when(days == 1, 0.35).when(days <= 3, 0.2).when(days <= 7, 0.1).when(days <= 14, 0.04), F.lit(0.0))


def general_boost(query: str, as_of: str | None = None) -> Column:
    """What the rerank of everything else adds: shared words, phrases, titles of documentation, preferences, and closeness in time."""
    own = T.tokens_of(query)
    core = T.core_tokens(own)
    low, overlap = F.col("_body"), F.col("_overlap")
    out = F.lit(0.0)
    if core:
        out = 0.035 * F.least(overlap, F.lit(8)) + F.when(overlap >= 2, 0.12 * F.least(F.lit(1.0), overlap / len(core))).otherwise(0.0)
    phrases = [f"{a}{sep}{b}" for a, b in zip(core, core[1:]) for sep in " -"]
    out = out + F.when(_any(phrases, low), 0.08).otherwise(0.0)
    out = out + F.when(F.col("content_kind") == "documentation", 0.04 * F.least(F.col("_path_overlap"), F.lit(3))).otherwise(0.0)
    if set(own) & set(W.PREFERENCE_WORDS):
        out = out + F.when((overlap > 0) & _any(list(W.PREFERENCE_SPANS), low), 0.18).otherwise(0.0)
    target = T.relative_date(query, as_of)
    return out if target is None else out + temporal_boost(F.col("filed_at"), target)


def boosted(rows: DataFrame, query: str, as_of: str | None = None) -> DataFrame:
    """The rows with ``boost``: the rule for code or the one for everything else."""
    parts = _counted(rerank_parts(rows), query)
    boost = F.when(F.col("content_kind") == "code", code_boost(query)).otherwise(general_boost(query, as_of))
    return parts.withColumn("boost", boost).drop(*PARTS)


def reranked(hits: DataFrame, query: str, as_of: str | None = None) -> DataFrame:
    rows = boosted(hits, query, as_of)
    return scaled(rows.withColumn("relevance", F.col("relevance") + F.col("boost")).drop("boost"), "relevance")


def hybrid(drawers: DataFrame, q: Query, encode: Callable[[str], list[float]], inverted: Index | None = None) -> DataFrame:
    """All columns of the best drawers with ``score`` (cosine with the query) and ``relevance``, best first.

    Takes one row per id with ``embedding``; with the index of the same rows no text is read to rank by words. A limit of 0 gives no rows; limits end at 1024. Rows without a usable
    vector can still be found by their words; their score is null and counts as failing ``min_score``.
    """
    if q.limit <= 0:
        return drawers.limit(0).withColumns({"score": F.lit(None).cast("double"), "relevance": F.lit(None).cast("double")})
    limit, k = min(q.limit, LIMIT_CAP), depth(q.limit)
    dense, lexical = dense_views(q.query), lexical_views(q.query)
    encoded = [(v, encode(v.text)) for v in dense]
    ranks = [dense_ranks(scoped(drawers, q.wing, q.room), encoded, k)]
    if lexical:
        ranks.append(lexical_ranks(drawers if inverted is None else inverted, lexical, k, q.wing, q.room))
    fused = scaled(fuse(*ranks).withColumnRenamed("fused", "relevance"), "relevance")
    # at most one row for each view and rank: seven views of at most 8,192 rows
    hits = drawers.join(F.broadcast(fused), "id")
    first = encoded[0][1]
    fine = (F.size("embedding") == len(first)) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    hits = hits.withColumn("score", F.when(fine, cosine(F.when(fine, F.col("embedding")), _vector(first))))
    hits = reranked(hits, q.query, q.as_of)
    if q.min_score is not None:
        hits = hits.where(F.col("score") >= q.min_score)
    return hits.orderBy(F.desc("relevance"), F.desc_nulls_last("score"), "id").limit(limit)


def shown(hits: DataFrame) -> DataFrame:
    """What a search shows: text, place, file name, relevance and similarity to three places."""
    return hits.select(
        F.col("content").alias("text"), "wing", "room", "content_kind", T.base_name(F.col("source_file")).alias("source_file"), F.round("relevance", 3).alias("relevance"), F.round("score", 3).alias("similarity")
    )


def duplicates(drawers: DataFrame, content: str, encode: Callable[[str], list[float]], threshold: float = 0.9, inverted: Index | None = None) -> DataFrame:
    """Of the five best hits for a text, those at least ``threshold`` similar to it."""
    return hybrid(drawers, Query(content), encode, inverted).where(F.col("score") >= threshold)


__all__ = ["Query", "View", "bm25_topk", "cosine_topk", "dense_ranks", "duplicates", "fuse", "hybrid", "lexical_ranks", "reranked", "scaled", "shown"]
