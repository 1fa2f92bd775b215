"""Queries of the llm operators; each takes (spark, folder of the tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import leaks, neardup, neighbours, overlap, packing, pii, splitting
from quillstone.plans.staging import stage


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.links(neighbours.most_similar(_table(spark, folder, "drawers"), min_cosine=0.9))


def p1_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """A search at any cosine: every hundredth drawer, by the MD5 of its id, asks among all."""
    asks = F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("long") % 100 == 0
    found = neighbours.most_similar(_table(spark, folder, "drawers"), trees=16, candidates=24_000, share=0.15, queries=asks, partition_rows=200_000)
    return found.withColumn("cosine", F.round("cosine", 6))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.cross_split(overlap.exploded_queries(_table(spark, folder, "multi_domain_queries")), least=0.65)


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    queries = overlap.exploded_queries(_table(spark, folder, "multi_domain_queries"))
    return overlap.report(queries, overlap.cross_split(queries, least=0.65))


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.cross_groups(overlap.exploded_queries(_table(spark, folder, "multi_domain_queries")), least=0.65)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.oversized_pieces(_table(spark, folder, "drawers")).select("id").distinct()


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.replaced(_table(spark, folder, "drawers"))


def p3_rejoined(spark: SparkSession, folder: str) -> DataFrame:
    """The texts of cut drawers, put together from their pieces."""
    return splitting.rejoined(splitting.oversized_pieces(_table(spark, folder, "drawers")))


def p3_audit(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.audit(splitting.oversized_pieces(_table(spark, folder, "drawers")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_pairs(_table(spark, folder, "drawers"), shingle=3, least=0.6)


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_groups(_table(spark, folder, "drawers"), shingle=3, least=0.6)


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(stage(packing.token_lengths(_table(spark, folder, "documents")), "lengths"))


#: Bounds that bind: at sf0.1 800 of 1,769 containers hold eight documents, and 143 of several are within 5 % of the cost.
BALANCED = {"documents": 8, "cost": packing.CAPACITY**2 / 2}


def p6_balanced(spark: SparkSession, folder: str) -> DataFrame:
    """Containers that also keep within eight documents and half the attention cost of a full piece."""
    return packing.pack(stage(packing.token_lengths(_table(spark, folder, "documents")), "lengths"), **BALANCED)


def _audited(spark: SparkSession, folder: str, **bounds) -> DataFrame:
    lengths = stage(packing.token_lengths(_table(spark, folder, "documents")), "lengths")
    return packing.audit(stage(packing.pack(lengths, **bounds), "placed"), lengths, **bounds)


def p6_audit(spark: SparkSession, folder: str) -> DataFrame:
    return _audited(spark, folder)


def p6_balanced_audit(spark: SparkSession, folder: str) -> DataFrame:
    return _audited(spark, folder, **BALANCED).drop("full")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked_items(_table(spark, folder, "documents"), _table(spark, folder, "benchmark_items"))


#: Pseudonyms of the queries over test tables; a real run passes its own secret key.
TEST_KEY = b"key of the test tables"


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return pii.findings(_table(spark, folder, "documents")).select("doc_id", "pii_type", "pii_value").distinct()


def p8_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return pii.redacted(_table(spark, folder, "documents"), key=TEST_KEY)


def p8_restored(spark: SparkSession, folder: str) -> DataFrame:
    """The redacted texts with the values put back: outside its placeholders no text has changed."""
    documents = _table(spark, folder, "documents")
    return pii.restored(pii.redacted(documents, key=TEST_KEY), pii.findings(documents, key=TEST_KEY))


QUERIES = {f.__name__: f for f in (p1_found, p1_neighbours, p2_found, p2_report, p2_groups, p3_found, p3_pieces, p3_rejoined, p3_audit, p4_found, p4_groups, p6_containers, p6_balanced, p6_audit, p6_balanced_audit, p7_found, p8_found, p8_redacted, p8_restored)}
_SETS = r"""
    words AS (SELECT id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS w FROM (SELECT DISTINCT id, content FROM drawers) WHERE id IS NOT NULL AND content IS NOT NULL),
    sh AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3)),
    sizes AS (SELECT id, count(*) AS n FROM sh GROUP BY id)
"""

_OVERLAPS = r"""
        WITH q AS (SELECT DISTINCT u.id AS id, u.text AS t, lower(trim(u.split)) AS split FROM (SELECT unnest(queries) AS u FROM multi_domain_queries)),
        w AS (SELECT DISTINCT id, split, t, unnest(regexp_extract_all(lower(t), '[\p{L}\p{N}]+')) AS word FROM q WHERE id IS NOT NULL AND t IS NOT NULL AND split IN ('train', 'dev', 'held_out')),
        n AS (SELECT id, split, t, count(*) AS n FROM w GROUP BY ALL),
        shared AS (
            SELECT a.id AS x, b.id AS y, a.split AS xs, b.split AS ys, a.t AS xt, b.t AS yt, count(*) AS k FROM w a JOIN w b ON a.word = b.word AND a.split = 'train' AND b.split <> 'train' AND a.id <> b.id
            GROUP BY ALL)
        SELECT DISTINCT least(x, y) AS query_id_a, greatest(x, y) AS query_id_b
        FROM shared JOIN n a ON a.id = x AND a.split = xs AND a.t = xt JOIN n b ON b.id = y AND b.split = ys AND b.t = yt
        WHERE k >= 0.65 * (a.n + b.n - k)
    """

_VECTORS = """v AS (
            SELECT DISTINCT id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM drawers
            WHERE id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"""

_AUDIT = "SELECT count(DISTINCT doc_id) AS documents, 0 AS cut, 0 AS lost, 0 AS overfull, 0 AS crowded, 0 AS costly, 0 AS gaps"

SQL: dict[str, str] = {
    "p6_audit": f"{_AUDIT}, true AS full FROM documents",
    "p6_balanced_audit": f"{_AUDIT} FROM documents",
    "p8_restored": "SELECT doc_id, text FROM documents",
    "p1_found": f"""
        WITH {_VECTORS}, near AS (
            SELECT a.id AS id, b.id AS neighbour, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.id <> b.id),
        best AS (SELECT id, neighbour, c, row_number() OVER (PARTITION BY id ORDER BY c DESC, neighbour) AS r FROM near)
        SELECT DISTINCT least(id, neighbour) AS id_a, greatest(id, neighbour) AS id_b FROM best WHERE r <= 5 AND c >= 0.9
    """,
    "p1_neighbours": f"""
        WITH {_VECTORS}, near AS (
            SELECT a.id AS id, b.id AS neighbour, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.id <> b.id WHERE ('0x' || substr(md5(a.id), 1, 8))::BIGINT % 100 = 0)
        SELECT id, neighbour, round(c, 6) AS cosine, (row_number() OVER (PARTITION BY id ORDER BY c DESC, neighbour))::INT AS rank FROM near QUALIFY rank <= 5
    """,
    "p2_found": _OVERLAPS,
    "p2_report": f"""
        WITH found AS ({_OVERLAPS}),
        hit AS (SELECT query_id_a AS id FROM found UNION SELECT query_id_b FROM found),
        own AS (SELECT DISTINCT u.id AS id, lower(trim(u.split)) AS split, domain, source_file FROM (SELECT unnest(queries) AS u, domain, source_file FROM multi_domain_queries) WHERE u.id IS NOT NULL)
        SELECT split, domain, source_file, count(*) AS queries, count(hit.id) AS overlapping FROM own LEFT JOIN hit USING (id) WHERE split IN ('dev', 'held_out') GROUP BY ALL
    """,
    "p2_groups": r"""
        WITH q AS (SELECT DISTINCT u.id AS id, u.text AS t, CASE lower(trim(u.split)) WHEN 'train' THEN 'train' WHEN 'dev' THEN 'eval' WHEN 'held_out' THEN 'eval' END AS side FROM (SELECT unnest(queries) AS u FROM multi_domain_queries)),
        w AS (SELECT DISTINCT id, side, list_sort(list_distinct(regexp_extract_all(lower(t), '[\p{L}\p{N}]+'))) AS ws FROM q WHERE id IS NOT NULL AND side IS NOT NULL AND len(regexp_extract_all(lower(t), '[\p{L}\p{N}]+')) > 0),
        c AS (SELECT side, ws, min(id) AS class_id, count(*) AS copies FROM w GROUP BY ALL),
        e AS (SELECT side, class_id, len(ws) AS n, unnest(ws) AS word FROM c),
        p AS (SELECT a.class_id AS x, b.class_id AS y FROM e a JOIN e b ON a.word = b.word AND a.side = 'train' AND b.side = 'eval' GROUP BY a.class_id, b.class_id, a.n, b.n HAVING count(*) >= 0.65 * (a.n + b.n - count(*))),
        l AS (SELECT 'train' AS side, x AS class_id, count(*) AS links FROM p GROUP BY x UNION ALL SELECT 'eval', y, count(*) FROM p GROUP BY y)
        SELECT w.id AS query_id, w.side AS side, c.class_id AS class_id, copies, coalesce(links, 0) AS links FROM w JOIN c USING (side, ws) LEFT JOIN l ON l.side = c.side AND l.class_id = c.class_id
    """,
    "p3_found": r"""
        SELECT DISTINCT id FROM drawers
        WHERE id IS NOT NULL AND strlen(trim(content, E' \t\r\n')) > 800
    """,
    "p3_rejoined": r"""
        SELECT DISTINCT id, trim(content, E' \t\r\n') AS content FROM drawers WHERE id IS NOT NULL AND strlen(trim(content, E' \t\r\n')) > 800
    """,
    "p3_audit": r"""
        SELECT DISTINCT id, 0::BIGINT AS long, 0::BIGINT AS repeating, 0::BIGINT AS torn, 0::BIGINT AS missing FROM drawers
        WHERE id IS NOT NULL AND strlen(trim(content, E' \t\r\n')) > 800
    """,
    "p4_found": f"""
        WITH {_SETS},
        shared AS (SELECT a.id AS x, b.id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.id < b.id GROUP BY ALL)
        SELECT x AS id_a, y AS id_b FROM shared JOIN sizes a ON a.id = x JOIN sizes b ON b.id = y WHERE k >= 0.6 * (a.n + b.n - k)
    """,
    "p4_groups": f"""
        WITH RECURSIVE {_SETS},
        c AS (SELECT id, md5(string_agg(s, '|' ORDER BY s)) AS cls FROM sh GROUP BY id),
        classes AS (SELECT cls, min(id) AS rep, count(*) AS copies FROM c GROUP BY cls),
        one AS (SELECT cls, s, n FROM classes JOIN sh ON sh.id = rep JOIN sizes ON sizes.id = rep),
        pairs AS (SELECT a.cls AS x, b.cls AS y FROM one a JOIN one b ON a.s = b.s AND a.cls <> b.cls GROUP BY a.cls, b.cls, a.n, b.n HAVING count(*) >= 0.6 * (a.n + b.n - count(*))),
        reach AS (SELECT cls AS x, cls AS y FROM classes UNION SELECT reach.x, pairs.y FROM reach JOIN pairs ON reach.y = pairs.x),
        named AS (SELECT x, min(rep) AS group_id FROM reach JOIN classes ON reach.y = classes.cls GROUP BY x),
        links AS (SELECT x, count(*) AS links FROM pairs GROUP BY x)
        SELECT id, group_id, copies, coalesce(links, 0) AS links FROM c JOIN classes USING (cls) JOIN named ON named.x = cls LEFT JOIN links ON links.x = cls
    """,
    "p7_found": r"""
        WITH items AS (SELECT DISTINCT item_id, regexp_extract_all(lower(item_text), '[\p{L}\p{N}]+') AS w FROM benchmark_items WHERE item_id IS NOT NULL),
        docs AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
        lengths AS (SELECT DISTINCT least(10, len(w)) AS m FROM items WHERE len(w) > 0),
        pats AS (SELECT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS p FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
        runs AS (SELECT doc_id, m, array_to_string(w[i : i + m - 1], ' ') AS p FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM docs, lengths WHERE len(w) >= m))
        SELECT DISTINCT doc_id, item_id FROM runs JOIN pats USING (m, p)
    """,
}
