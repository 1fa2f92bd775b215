"""Retrieval quality over the evaluation corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import evaluate, ranking
from quillstone.plans import sqltext as S
from quillstone.plans.catalogue import query
from quillstone.plans.sqltext import CORPUS
from quillstone.plans.tables import corpus

MOST = 50


def _asked(spark, folder):
    c = corpus(spark, folder).select("id", "domain", F.explode("queries").alias("q"))
    return c.select(F.col("q.id").alias("question_id"), "id", "domain", F.col("q.text").alias("text"), "q.also_relevant", F.lower(F.btrim("q.split")).alias("split")).where("question_id is not null").dropDuplicates(["question_id"])


_ASKED = "a AS (SELECT DISTINCT ON (question_id) * FROM (SELECT u.id AS question_id, id, domain, u.text AS text, u.also_relevant AS also_relevant, lower(trim(u.split)) AS split FROM (SELECT id, domain, unnest(queries) AS u FROM c)) WHERE question_id IS NOT NULL)"
_RANKED = f"""{CORPUS}, {_ASKED},
    w AS (SELECT DISTINCT id AS item_id, unnest({S.tokens('content')}) AS t FROM c), n AS (SELECT t, count(*) AS df FROM w GROUP BY t), nn AS (SELECT count(*) AS docs FROM c),
    qw AS (SELECT DISTINCT question_id, unnest({S.tokens('text')}) AS t FROM a),
    s AS (SELECT question_id, item_id, round(sum(ln(docs / df)), 9) AS score FROM qw JOIN w USING (t) JOIN n USING (t), nn GROUP BY ALL),
    ranked AS (SELECT question_id, item_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, item_id) AS rank FROM s QUALIFY rank <= {MOST}),
    relevant AS (SELECT DISTINCT question_id, item_id FROM (SELECT question_id, id AS item_id FROM a UNION ALL SELECT question_id, unnest(also_relevant) FROM a) WHERE item_id IS NOT NULL)"""


def _ranked(spark, folder):
    """Every document of the store by the weight of the words it shares with a question; no domain and no word is left out."""
    c, a = corpus(spark, folder), _asked(spark, folder)
    tokens = lambda x: F.array_distinct(T.identifier_tokens(F.col(x)))
    items = c.select(F.col("id").alias("item_id"), tokens("content").alias("words"))
    n = c.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.size("queries")), F.lit(0)).alias("asked")).first()
    df = items.select(F.explode("words").alias("t")).groupBy("t").agg(F.log(F.lit(float(n.docs)) / F.count("*")).alias("w"))
    q = a.select("question_id", F.explode(tokens("text")).alias("t")).join(df, "t").groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("t", "w"))).alias("words"))
    q = q.select("question_id", F.col("words.t").alias("words"), F.col("words.w").alias("weights"))
    return a, ranking.best_shared(q, items, MOST, n.asked, n.docs)


def _relevant(a):
    both = a.select("question_id", F.col("id").alias("item_id")).unionByName(a.select("question_id", F.explode("also_relevant").alias("item_id")))
    return both.where("item_id is not null").distinct()


_K = "(SELECT unnest([1, 3, 5, 10, 30, 50]) AS k)"
_METRICS = f"""{_RANKED},
    h AS (SELECT r.question_id, k, count(*) AS wanted, count(rank) FILTER (rank <= k) AS got, coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= k), 0) AS gain, min(rank) FILTER (rank <= k) AS first
          FROM relevant r LEFT JOIN ranked USING (question_id, item_id), {_K} GROUP BY ALL),
    metrics AS (SELECT question_id, k, (got > 0)::INT::DOUBLE AS recall_any, (got = wanted)::INT::DOUBLE AS recall_all, gain / list_sum(list_transform(range(1, least(k, wanted) + 1), lambda i: 1 / log2(i + 1))) AS ndcg, coalesce(1.0 / first, 0.0) AS reciprocal_rank FROM h)"""


@query(f"WITH {_METRICS} SELECT question_id, k::INT AS k, recall_any, recall_all, round(ndcg, 6) AS ndcg, round(reciprocal_rank, 6) AS reciprocal_rank FROM metrics")
def ir_metrics(spark, folder):
    return _ir_metrics(*_ranked(spark, folder))


def _ir_metrics(a, ranked):
    rows = evaluate.metrics(ranked, _relevant(a))
    return rows.withColumns({"ndcg": F.round("ndcg", 6), "reciprocal_rank": F.round("reciprocal_rank", 6)})


@query(f"WITH {_METRICS} SELECT split, k::INT AS k, count(*) AS questions, round(avg(recall_any), 6) AS recall_any, round(avg(recall_all), 6) AS recall_all, round(avg(ndcg), 6) AS ndcg, round(avg(reciprocal_rank), 6) AS reciprocal_rank FROM metrics JOIN a USING (question_id) WHERE split IN ('dev', 'held_out') GROUP BY ALL")
def split_means(spark, folder):
    return _split_means(*_ranked(spark, folder))


def _split_means(a, ranked):
    own = a.where(F.col("split").isin("dev", "held_out"))
    rows = evaluate.means(evaluate.metrics(ranked, _relevant(own)).join(own.select("question_id", "split"), "question_id"), "split")
    return rows.withColumns({c: F.round(c, 6) for c in ("recall_any", "recall_all", "ndcg", "reciprocal_rank")})


@query(f"WITH {CORPUS} SELECT domain, quantile_disc(length(content), 0.5)::DOUBLE AS p50, quantile_disc(length(content), 0.95)::DOUBLE AS p95 FROM c WHERE content IS NOT NULL GROUP BY domain")
def nearest_rank_percentile(spark, folder):
    rows = corpus(spark, folder).where("content is not null").select("domain", F.length("content").alias("n"))
    return rows.groupBy("domain").agg(evaluate.nearest_rank("n", 0.5).cast("double").alias("p50"), evaluate.nearest_rank("n", 0.95).cast("double").alias("p95"))


_Z = evaluate.Z


@query(f"""WITH {_METRICS}, g AS (SELECT domain, sum(recall_any) AS s, count(*)::DOUBLE AS n FROM metrics JOIN a USING (question_id) WHERE k = 5 GROUP BY domain)
    SELECT domain, round(greatest(0, (s / n + {_Z} * {_Z} / (2 * n)) / (1 + {_Z} * {_Z} / n) - {_Z} * sqrt(s / n * (1 - s / n) / n + {_Z} * {_Z} / (4 * n * n)) / (1 + {_Z} * {_Z} / n)), 6) AS low,
        round(least(1, (s / n + {_Z} * {_Z} / (2 * n)) / (1 + {_Z} * {_Z} / n) + {_Z} * sqrt(s / n * (1 - s / n) / n + {_Z} * {_Z} / (4 * n * n)) / (1 + {_Z} * {_Z} / n)), 6) AS high FROM g""")
def wilson_interval(spark, folder):
    return _wilson_interval(*_ranked(spark, folder))


def _wilson_interval(a, ranked):
    rows = evaluate.metrics(ranked, _relevant(a), (5,)).join(a.select("question_id", "domain"), "question_id").groupBy("domain").agg(F.sum("recall_any").alias("s"), F.count("*").alias("n"))
    low, high = evaluate.wilson(F.col("s"), F.col("n"))
    return rows.select("domain", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(f"""WITH {_METRICS}, g AS (SELECT domain, avg(recall_any) AS recall FROM metrics JOIN a USING (question_id) WHERE k = 5 GROUP BY domain), b AS (SELECT domain, 0.9 AS baseline FROM g WHERE domain LIKE 'c%')
    SELECT domain, round(recall, 6) AS recall, baseline::DOUBLE AS baseline, round(recall - baseline, 6) AS delta, coalesce(recall - baseline >= -0.02, false) AS passed FROM g LEFT JOIN b USING (domain)""")
def domain_gate(spark, folder):
    return _domain_gate(*_ranked(spark, folder))


def _domain_gate(a, ranked):
    rows = evaluate.metrics(ranked, _relevant(a), (5,)).join(a.select("question_id", "domain"), "question_id").groupBy("domain").agg(F.avg("recall_any").alias("recall"))
    base = rows.where("domain like 'c%'").select("domain", F.lit(0.9).alias("baseline"))
    return evaluate.gate(rows, base).withColumns({"recall": F.round("recall", 6), "delta": F.round("delta", 6)})


@query(f"""WITH {CORPUS} SELECT id, (SELECT coalesce(bool_and(contains(content, n)), true) FROM (SELECT unnest(target_matcher.content_contains) AS n))
        AND (target_matcher.drawer_id IS NULL OR target_matcher.drawer_id = id) AND (target_matcher.relative_path IS NULL OR coalesce(ends_with(replace(source_file, '\\', '/'), target_matcher.relative_path), false)) AS matches
    FROM c WHERE target_matcher IS NOT NULL AND content IS NOT NULL""")
def target_matches(spark, folder):
    c = corpus(spark, folder).where("target_matcher is not null and content is not null")
    return c.select("id", evaluate.matches(F.col("content"), F.col("id"), F.col("source_file"), F.col("target_matcher")).alias("matches"))


FLOORS = {"code": 30, "conversation": 25, "documentation": 20, "prose": 15, "diary": 10}


@query(f"""WITH {CORPUS}, refs AS (SELECT DISTINCT unnest(u.also_relevant) AS id FROM (SELECT unnest(queries) AS u FROM c)),
    floors AS (SELECT unnest({S.listed(FLOORS)}) AS content_kind, unnest({list(FLOORS.values())}) AS floor)
    SELECT 'unknown reference' AS problem, id AS detail FROM refs WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM c)
    UNION ALL SELECT 'too few documents', content_kind FROM floors WHERE (SELECT count(*) FROM c WHERE c.content_kind = floors.content_kind) < floor""")
def corpus_problems(spark, folder):
    return evaluate.corpus_problems(corpus(spark, folder), FLOORS).where("detail is not null")
