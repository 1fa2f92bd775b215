"""Retrieval quality: metrics per question, means, percentiles, intervals and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KS = (1, 3, 5, 10, 30, 50)
Z = 1.959963984540054


def metrics(ranked: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """``question_id, k, recall_any, recall_all, ndcg, reciprocal_rank`` for every question with relevant items.

    ``ranked`` has ``question_id, item_id, rank`` (from 1), ``relevant`` has ``question_id, item_id``; repeated rows of
    either count once, an item at its best rank. A question without hits scores 0.
    """
    wanted = relevant.select("question_id", "item_id").where("question_id is not null and item_id is not null").distinct()
    hits = ranked.groupBy("question_id", "item_id").agg(F.min("rank").alias("rank"))
    rows = wanted.join(hits, ["question_id", "item_id"], "left").groupBy("question_id").agg(F.count("*").alias("n"), F.collect_list("rank").alias("ranks"))
    rows = rows.select("question_id", "n", "ranks", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    top = F.filter("ranks", lambda r: r <= F.col("k"))
    gain = F.aggregate(top, F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("k", F.col("n").cast("int"))), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))
    return rows.select(
        "question_id",
        "k",
        F.when(F.size(top) > 0, 1.0).otherwise(0.0).alias("recall_any"),
        F.when(F.size(top) == F.col("n"), 1.0).otherwise(0.0).alias("recall_all"),
        (gain / ideal).alias("ndcg"),
        F.coalesce(1.0 / F.array_min(top), F.lit(0.0)).alias("reciprocal_rank"),
    )


def means(scores: DataFrame, *by: str) -> DataFrame:
    names = ["recall_any", "recall_all", "ndcg", "reciprocal_rank"]
    return scores.groupBy(*by, "k").agg(F.count("*").alias("questions"), *[F.avg(n).alias(n) for n in names])


def nearest_rank(column: str, p: float) -> Column:
    """The smallest value with at least a share ``p`` of all values at or below it."""
    return F.expr(f"percentile_disc({min(max(p, 0.0), 1.0)}) WITHIN GROUP (ORDER BY {column})")


def wilson(successes: Column, n: Column) -> tuple[Column, Column]:
    """The 95 % interval of a share, within 0 and 1; 0 and 0 without trials."""
    p = successes / n
    mid = (p + Z * Z / (2 * n)) / (1 + Z * Z / n)
    half = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n)) / (1 + Z * Z / n)
    zero = F.lit(0.0)
    return F.when(n > 0, F.greatest(zero, mid - half)).otherwise(zero), F.when(n > 0, F.least(F.lit(1.0), mid + half)).otherwise(zero)


def gate(measured: DataFrame, baseline: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """``domain, recall, baseline, delta, passed``: each domain against its frozen value. A domain without one fails."""
    rows = measured.select("domain", "recall").join(baseline.select("domain", "baseline"), "domain", "left")
    delta = F.col("recall") - F.col("baseline")
    return rows.select("domain", "recall", "baseline", delta.alias("delta"), F.coalesce(delta >= -tolerance, F.lit(False)).alias("passed"))


def matches(content: Column, item: Column, path: Column, matcher: Column) -> Column:
    """Whether a drawer is what a target matcher asks for: id, path and every needle in the content, each where given."""
    needles = F.coalesce(F.forall(matcher["content_contains"], lambda n: F.contains(content, n)), F.lit(True))
    same_id = matcher["drawer_id"].isNull() | (matcher["drawer_id"] == item)
    same_path = matcher["relative_path"].isNull() | F.coalesce(F.endswith(F.replace(path, F.lit("\\"), F.lit("/")), matcher["relative_path"]), F.lit(False))
    return matcher.isNotNull() & same_id & same_path & needles


def corpus_problems(corpus: DataFrame, floors: dict[str, int]) -> DataFrame:
    """``problem, detail``: repeated ids, unknown references and kinds with fewer documents than their floor. No rows: the corpus is fine."""
    twice = corpus.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated id").alias("problem"), F.col("id").alias("detail"))
    refs = corpus.select(F.explode("queries").alias("q")).select(F.explode("q.also_relevant").alias("id")).distinct()
    lost = refs.join(corpus.select("id").distinct(), "id", "left_anti").select(F.lit("unknown reference").alias("problem"), F.col("id").alias("detail"))
    floor = corpus.sparkSession.createDataFrame(list(floors.items()), "content_kind string, floor int")
    kinds = corpus.select("id", "content_kind").distinct().groupBy("content_kind").agg(F.count("*").alias("n"))
    few = floor.join(kinds, "content_kind", "left").where(F.coalesce("n", F.lit(0)) < F.col("floor")).select(F.lit("too few documents").alias("problem"), F.col("content_kind").alias("detail"))
    return twice.unionByName(lost).unionByName(few)


def summary(scores: DataFrame, seconds: float | None = None) -> str:
    """The printed result of an evaluation: questions, time, latencies, metrics with their interval, recall by type.

    ``scores`` has ``question_id, question_type, k``, the four metrics and, on every row of a question, ``latency_ms``
    and ``indexing_ms``. All sums are made in the cluster; what is fetched is a row for each ``k`` and type.
    """
    each = scores.groupBy("question_id").agg(F.max("latency_ms").alias("latency_ms"), F.max("indexing_ms").alias("indexing_ms"))
    t = each.agg(F.count("*").alias("n"), nearest_rank("latency_ms", 0.5).alias("p50"), nearest_rank("latency_ms", 0.95).alias("p95"), F.max("latency_ms").alias("most"), F.sum("indexing_ms").alias("indexing")).first()
    if not t.n:
        return "Questions: 0"
    lines = [f"Questions: {t.n}"] + ([f"Time: {seconds:.1f} s ({seconds / t.n:.3f} s a question)"] if seconds is not None else [])
    lines += [f"Latency: p50={t.p50:.0f} ms p95={t.p95:.0f} ms most={t.most:.0f} ms", f"Indexing: {t.indexing:.0f} ms ({t.indexing / t.n:.2f} ms a question)"]
    low, high = wilson(F.sum("recall_any"), F.count("*"))
    rows = {r.k: r for r in scores.groupBy("k").agg(F.avg("recall_any").alias("any"), F.avg("recall_all").alias("all"), F.avg("ndcg").alias("ndcg"), F.avg("reciprocal_rank").alias("rr"), low.alias("low"), high.alias("high")).collect()}
    for k, r in sorted(rows.items()):
        lines.append(f"Recall@{k}: {r['any']:.3f}  Recall-all@{k}: {r['all']:.3f}  NDCG@{k}: {r.ndcg:.3f}")
    if 5 in rows:
        lines.append(f"Recall@5, 95 % of cases: {rows[5].low:.3f} to {rows[5].high:.3f} (Wilson)")
    if 10 in rows:
        lines.append(f"MRR@10: {rows[10].rr:.3f}")
        kinds = scores.where("k = 10").groupBy("question_type").agg(F.avg("recall_any").alias("r"), F.count("*").alias("n")).orderBy("question_type").collect()
        lines += ["Recall@10 by type:", *(f"  {r.question_type}: {r.r:.3f} (n={r.n})" for r in kinds)]
    return "\n".join(lines)
