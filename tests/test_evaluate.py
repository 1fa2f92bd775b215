import pytest
from pyspark.sql import functions as F

from quillstone.operators import evaluate


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("q", "b", 9), ("p", "x", 1)], "question_id string, item_id string, rank int")
    relevant = spark.createDataFrame([("q", "b"), ("q", "z"), ("q", "b"), ("p", "y"), (None, "a")], "question_id string, item_id string")
    got = {(r.question_id, r.k): r for r in evaluate.metrics(ranked, relevant).collect()}
    q3, q1, p3 = got["q", 3], got["q", 1], got["p", 3]
    assert (q1.recall_any, q3.recall_any, q3.recall_all, q3.reciprocal_rank) == (0, 1, 0, 0.5)
    assert q3.ndcg == pytest.approx((1 / 1.5849625) / (1 + 1 / 1.5849625)) and (p3.recall_any, p3.ndcg, p3.reciprocal_rank) == (0, 0, 0)
    assert evaluate.means(evaluate.metrics(ranked, relevant)).where("k = 3").first().recall_any == 0.5


def test_intervals_and_percentiles(spark):
    df = spark.createDataFrame([(430.0, 450.0), (0.0, 0.0)], "s double, n double")
    low, high = evaluate.wilson(F.col("s"), F.col("n"))
    a, b = df.select(F.round(low, 3), F.round(high, 3)).collect()
    assert tuple(a) == (0.932, 0.971) and tuple(b) == (0, 0)
    nums = spark.range(1, 101)
    assert nums.agg(evaluate.nearest_rank("id", 0.95), evaluate.nearest_rank("id", 0.0), evaluate.nearest_rank("id", 1.5)).first() == (95, 1, 100)


def test_gate(spark):
    m = spark.createDataFrame([("a", 0.9), ("b", 0.87), ("c", 1.0)], "domain string, recall double")
    base = spark.createDataFrame([("a", 0.91), ("b", 0.9)], "domain string, baseline double")
    assert {r.domain: r.passed for r in evaluate.gate(m, base).collect()} == {"a": True, "b": False, "c": False}


def test_questions_rank_against_the_whole_store(spark, tmp_path):
    """Against SQL without a domain and without a limit on a word's frequency; blocks of a few rows each."""
    import duckdb
    import oracle

    from quillstone.operators import ranking
    from quillstone.plans import evaluation_queries as E
    from quillstone.plans import sqltext as S

    query = "struct<id: string, text: string, split: string, also_relevant: array<string>, as_of: string>"
    rows = [(f"d{i:02d}", "ab"[i % 2], f"common word{i % 7} word{i % 5} only{i}", "2024", [(f"q{i}", f"common word{(i + 1) % 7} word{i % 5}", "dev", [f"d{(i + 1) % 40:02d}"], None)]) for i in range(40)]
    spark.createDataFrame(rows, f"id string, domain string, content string, filed_at string, queries array<{query}>").write.parquet(f"{tmp_path}/multi_domain_queries.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW multi_domain_queries AS FROM '{tmp_path}/multi_domain_queries.parquet/*.parquet'")
    sql = f"""WITH {S.CORPUS}, {E._ASKED}, w AS (SELECT DISTINCT id AS item_id, unnest({S.tokens('content')}) AS t FROM c), n AS (SELECT t, count(*) AS df FROM w GROUP BY t), nn AS (SELECT count(*) AS docs FROM c),
        qw AS (SELECT DISTINCT question_id, unnest({S.tokens('text')}) AS t FROM a),
        s AS (SELECT question_id, item_id, round(sum(ln(docs / df)), 9) AS score FROM qw JOIN w USING (t) JOIN n USING (t), nn GROUP BY ALL)
        SELECT question_id, item_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, item_id) AS rank FROM s QUALIFY rank <= {E.MOST}"""
    for sizes in ((ranking.QUESTIONS, ranking.ITEMS), (7, 11)):
        old = ranking.QUESTIONS, ranking.ITEMS
        ranking.QUESTIONS, ranking.ITEMS = sizes
        try:
            got = E._ranked(spark, str(tmp_path))[1].select("question_id", "item_id", "rank").toPandas()
        finally:
            ranking.QUESTIONS, ranking.ITEMS = old
        assert oracle.rows(got) == oracle.rows(con.execute(sql).df())
    scores = {(r.question_id, r.k): r for r in E.ir_metrics(spark, str(tmp_path)).collect()}
    assert len(got) == 1600 and all(scores[f"q{i}", 50].recall_all == 1 for i in range(40))
