"""Chunking, dialect, entities and session logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.functions.words import LANGUAGES
from quillstone.operators import chunking, dialect, entities
from quillstone.plans import sqltext as S
from quillstone.plans.catalogue import query
from quillstone.plans.sqltext import DRAWERS
from quillstone.plans.tables import drawers, table
from quillstone.sources import files
from quillstone.streaming import assembly, incremental


#: White space as ``str.strip`` takes it.
_SPACE = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || ' ' || chr(133) || chr(160) || chr(5760) || " + " || ".join(f"chr({c})" for c in (*range(8192, 8203), 8232, 8233, 8239, 8287, 12288))
_CUT = f"CASE WHEN pos + {chunking.SIZE} >= n THEN n ELSE list_max(list_filter(begins, lambda i: i <= pos + {chunking.SIZE})) END"
_LAST = lambda marks, width: f"list_max(list_filter({marks}, lambda i: i >= pos AND i + {width} <= cut))"
_STOP_AT = f"CASE WHEN cut = n THEN n WHEN {_LAST('blank', 2)} - pos > {chunking.SIZE // 2} THEN {_LAST('blank', 2)} WHEN {_LAST('ends', 1)} - pos > {chunking.SIZE // 2} THEN {_LAST('ends', 1)} ELSE cut END"


@query(f"""WITH RECURSIVE s AS (SELECT doc_id, trim(text, {_SPACE}) AS t FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)),
    b AS (SELECT row_number() OVER () AS r, doc_id, t, strlen(t) AS n, regexp_extract_all(hex(encode(t)), '..') AS x FROM s WHERE t <> ''),
    l AS MATERIALIZED (SELECT r, doc_id, t, n, list_filter(range(0, n), lambda i: x[i + 1] = '0A') AS ends, list_filter(range(0, n - 1), lambda i: x[i + 1] = '0A' AND x[i + 2] = '0A') AS blank,
            list_filter(range(0, n), lambda i: x[i + 1] < '80' OR x[i + 1] >= 'C0') AS begins FROM b),
    w AS (SELECT r, pos, {_STOP_AT} AS stop FROM (SELECT *, {_CUT} AS cut FROM (SELECT *, 0::BIGINT AS pos FROM l))
        UNION ALL SELECT r, pos, {_STOP_AT} AS stop FROM (SELECT *, {_CUT} AS cut FROM (SELECT l.*, list_max(list_filter(begins, lambda i: i <= stop - {chunking.OVERLAP})) AS pos FROM w JOIN l USING (r) WHERE stop < n))),
    c AS (SELECT r, pos, doc_id, trim(substr(t, list_position(begins, pos), CASE WHEN stop = n THEN length(t) + 1 ELSE list_position(begins, stop) END - list_position(begins, pos)), {_SPACE}) AS chunk FROM w JOIN l USING (r))
    SELECT doc_id, (row_number() OVER (PARTITION BY r ORDER BY pos) - 1)::INT AS chunk_index, chunk FROM c WHERE strlen(chunk) >= {chunking.LEAST}""")
def chunk_text(spark, folder):
    rows = table(spark, folder, "documents").where("doc_id is not null and text is not null").select("doc_id", "text").distinct()
    return rows.select("doc_id", F.posexplode(chunking.chunks(F.col("text"), F.lit(None).cast("string"))).alias("chunk_index", "c")).select("doc_id", "chunk_index", F.col("c.chunk").alias("chunk"))


@query()
def chunk_code(spark, folder):
    return chunking.chunked(drawers(spark, folder, F.col("content_kind") == "code").select("id", "source_file", "content")).select("id", "chunk_index_new", "chunk", "symbol", "enclosing")


@query(f"""WITH {DRAWERS} SELECT id, CASE WHEN source_file IS NULL THEN NULL ELSE coalesce(list_filter([{', '.join(f"CASE WHEN list_contains({S.listed(e.split())}, ext) THEN '{n}' END" for n, e in LANGUAGES.items())}], lambda x: x IS NOT NULL)[1], NULL) END AS language,
    CASE WHEN contains(replace(source_file, '\\', '/'), '/') THEN replace(lower(trim(string_split(replace(source_file, '\\', '/'), '/')[1])), ' ', '_') ELSE 'general' END AS room
    FROM (SELECT *, lower(regexp_extract(source_file, '[^/\\\\]\\.([^./\\\\]+)$', 1)) AS ext FROM d)""")
def file_routing(spark, folder):
    return drawers(spark, folder).select("id", T.language(F.col("source_file")).alias("language"), T.room_of_path(F.col("source_file")).alias("room"))


@query(f"""WITH {DRAWERS}, p AS (SELECT id, string_split(replace(source_file, '\\', '/'), '/') AS parts, lower(regexp_extract(source_file, '[^/\\\\](\\.[^./\\\\]+)$', 1)) AS ext FROM d WHERE source_file IS NOT NULL)
    SELECT id, len(list_filter(parts[1:len(parts) - 1], lambda x: list_contains({S.listed(files.SKIPPED_FOLDERS)}, x) OR ends_with(x, '.egg-info'))) > 0 AS pruned,
        list_contains({S.listed([f'.{e}' for e in files.BINARY])}, ext) OR list_contains({S.listed(files.SKIPPED_NAMES)}, parts[-1]) AS skipped,
        list_contains({S.listed([f'.{e}' for e in files.DATA])}, ext) AND len(list_filter(parts, lambda x: list_contains({S.listed(files.DATA_FOLDERS)}, lower(x)))) > 0 AS noisy FROM p""")
def file_filters(spark, folder):
    rows = drawers(spark, folder).where("source_file is not null").withColumn("p", F.replace("source_file", F.lit("\\"), F.lit("/")))
    return rows.select("id", files.in_skipped_folder(F.col("p")).alias("pruned"), files.skipped_name(F.col("p")).alias("skipped"), files.noisy_data(F.col("p"), F.lit(0)).alias("noisy"))


_DIARY_DAY = "CASE WHEN try_cast(left(filed_at, 10) AS DATE) IS NOT NULL AND regexp_matches(left(filed_at, 10), '^\\d{4}-\\d{2}-\\d{2}$') THEN left(filed_at, 10) WHEN try_cast(in_path AS DATE) IS NOT NULL THEN in_path ELSE 'unknown' END"
_LANGUAGE = f"list_filter([{', '.join(f"CASE WHEN list_contains({S.listed(e.split())}, ext) THEN '{n}' END" for n, e in LANGUAGES.items())}], lambda x: x IS NOT NULL)[1]"


@query(f"""WITH {DRAWERS}, x AS (SELECT *, lower(regexp_extract(source_file, '[^/\\\\]\\.([^./\\\\]+)$', 1)) AS ext, regexp_extract(source_file, '(?:^|[/_])(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1) AS in_path FROM d WHERE content IS NOT NULL AND content_kind NOT IN ('conversation', 'documentation'))
    SELECT id, CASE content_kind WHEN 'code' THEN 'path: ' || source_file || chr(10) || 'language: ' || {_LANGUAGE} || chr(10) || 'enclosing: file' || chr(10) || 'symbol: file' || chr(10) || 'identifier words: file file' || chr(10) || 'code:' || chr(10) || content
        WHEN 'diary' THEN 'kind: diary' || chr(10) || 'date: ' || {_DIARY_DAY} || chr(10) || 'agent: ' || coalesce(added_by, 'unknown') || chr(10) || 'topic: ' || room || coalesce(chr(10) || 'source: ' || source_file, '') || chr(10) || 'verbatim:' || chr(10) || content
        ELSE coalesce('kind: prose' || chr(10) || 'source: ' || source_file || chr(10) || 'verbatim:' || chr(10) || content, content) END AS retrieval_text FROM x""")
def retrieval_texts(spark, folder):
    return _retrieval_texts(drawers(spark, folder).where("content is not null and content_kind not in ('conversation', 'documentation')"))


@query()
def retrieval_texts_parsed(spark, folder):
    """Those for which the text is parsed: roles of conversations, titles and headings of documentation."""
    return _retrieval_texts(drawers(spark, folder).where("content is not null and content_kind in ('conversation', 'documentation')"))


def _retrieval_texts(d):
    kind, path = F.col("content_kind"), F.col("source_file")
    code = T.code_retrieval_text(path, T.language(path), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("content"))
    diary = T.diary_retrieval_text(path, F.col("room"), F.coalesce("added_by", F.lit("unknown")), F.col("filed_at"), F.col("content"))
    text = F.when(kind == "code", code).when(kind == "diary", diary).when(kind == "conversation", T.conversation_retrieval_text(path, F.col("wing"), F.col("room"), F.col("content")))
    text = text.when(kind == "documentation", T.documentation_retrieval_text(path, F.col("content"), F.col("content"))).otherwise(T.prose_retrieval_text(path, F.col("content")))
    return d.select("id", text.alias("retrieval_text"))


@query(r"WITH docs AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL) SELECT doc_id, nullif(trim(text, E' \t\r\n'), '') AS text FROM docs")
def normalised_texts(spark, folder):
    rows = table(spark, folder, "documents").where("doc_id is not null").select("doc_id", "text").distinct()
    return rows.select("doc_id", T.normalised(F.col("text")).alias("text"))


@query("""WITH docs AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
    f AS (SELECT doc_id, e, '---' || e || 'key: v' || e || '---' || e || text AS text FROM docs, (SELECT unnest([chr(10), chr(13) || chr(10)]) AS e))
    SELECT doc_id, e = chr(10) AS unix, regexp_replace(text, CASE WHEN e = chr(10) THEN '\\A---\\n(?s:.*?)\\n---\\n' ELSE '\\A---\\r\\n(?s:.*?)\\r\\n---\\r\\n' END, '') AS text FROM f""")
def front_matter(spark, folder):
    rows = table(spark, folder, "documents").where("doc_id is not null and text is not null").select("doc_id", "text").distinct()
    rows = rows.select("doc_id", "text", F.explode(F.array(F.lit("\n"), F.lit("\r\n"))).alias("e"))
    fenced = F.concat(F.lit("---"), "e", F.lit("key: v"), "e", F.lit("---"), "e", "text")
    return rows.select("doc_id", (F.col("e") == "\n").alias("unix"), T.without_front_matter(fenced).alias("text"))


def _signal_sql(hints) -> str:
    cases = ", ".join(f"CASE WHEN contains(lower(text), {S.quoted(h)}) THEN '{c}' END" for h, c in hints)
    return f"array_to_string((SELECT list(c ORDER BY i) FROM (SELECT c, min(i) AS i FROM (SELECT unnest([{cases}]) AS c, unnest(range(0, {len(hints)})) AS i) WHERE c IS NOT NULL GROUP BY c))[1:3], '+')"


_DOCS = "docs AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL)"


def _docs(spark, folder):
    return table(spark, folder, "documents").where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).distinct()


@query(f"WITH {_DOCS} SELECT doc_id, coalesce({_signal_sql(dialect.MOOD_HINTS)}, '') AS moods, coalesce({_signal_sql(dialect.FLAG_HINTS)}, '') AS flags FROM docs")
def signals(spark, folder):
    return _docs(spark, folder).select("doc_id", F.array_join(dialect.signals(F.col("text"), dialect.MOOD_HINTS), "+").alias("moods"), F.array_join(dialect.signals(F.col("text"), dialect.FLAG_HINTS), "+").alias("flags"))


_POINTS = " + ".join(f"CASE WHEN contains(lower(s), '{w}') THEN 2 ELSE 0 END" for w in dialect.DECISION_WORDS)


@query(f"""WITH {_DOCS}, s AS (SELECT doc_id, trim(unnest(regexp_split_to_array(text, '[.!?\\n]')), E' \\t\\r\\n') AS s, unnest(range(0, len(regexp_split_to_array(text, '[.!?\\n]')))) AS i FROM docs),
    p AS (SELECT doc_id, s, i, {_POINTS} + CASE WHEN strlen(s) < 80 THEN 1 ELSE 0 END + CASE WHEN strlen(s) < 40 THEN 1 ELSE 0 END - CASE WHEN strlen(s) > 150 THEN 2 ELSE 0 END AS points FROM s WHERE strlen(s) > 10),
    b AS (SELECT doc_id, s FROM p QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY points DESC, i) = 1)
    SELECT doc_id, CASE WHEN length(coalesce(s, '')) > 55 THEN left(s, 52) || '...' ELSE coalesce(s, '') END AS sentence FROM docs LEFT JOIN b USING (doc_id)""")
def key_sentence(spark, folder):
    return _docs(spark, folder).select("doc_id", dialect.key_sentence(F.col("text")).alias("sentence"))


@query(f"""WITH {_DOCS}, w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_-]+')) AS w FROM docs),
    c AS (SELECT doc_id, lower(w) AS topic, sum(CASE WHEN length(w) >= 3 THEN 1 ELSE 0 END + CASE WHEN regexp_matches(w, '^[A-Z]') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(w, '[_-]|^.+[A-Z]') THEN 2 ELSE 0 END) AS weight
          FROM w WHERE regexp_matches(w, '^[A-Za-z]') AND NOT list_contains({S.listed(dialect.STOPWORDS)}, lower(w)) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, topic) AS n FROM c WHERE weight > 0)
    SELECT doc_id, string_agg(topic, '_' ORDER BY n) AS topics FROM r WHERE n <= 3 GROUP BY doc_id""")
def topics(spark, folder):
    return dialect.topics(_docs(spark, folder), "doc_id", "text").withColumnRenamed("id", "doc_id")


@query(f"WITH {_DOCS} SELECT doc_id, greatest(floor(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) * 1.3), 1)::INT AS tokens, strlen(text)::INT AS bytes FROM docs")
def token_stats(spark, folder):
    return _docs(spark, folder).select("doc_id", dialect.token_estimate(F.col("text")).alias("tokens"), F.octet_length("text").alias("bytes"))


def _hint_sql(hints) -> str:
    cases = ", ".join(f"CASE WHEN contains(lower(text), {S.quoted(h)}) THEN '{c}' END" for h, c in hints)
    return f"list_filter([{cases}], lambda c: c IS NOT NULL)"


_FIRST = "lambda c, k: list_position({0}, c) = k"
_COMPRESSED = f"""{DRAWERS}, docs AS (SELECT id AS doc_id, coalesce(content, '') AS text, * FROM d),
    s AS (SELECT doc_id, trim(unnest(regexp_split_to_array(text, '[.!?\\n]')), E' \\t\\r\\n') AS s, unnest(range(0, len(regexp_split_to_array(text, '[.!?\\n]')))) AS i FROM docs),
    p AS (SELECT doc_id, s, i, {_POINTS} + CASE WHEN strlen(s) < 80 THEN 1 ELSE 0 END + CASE WHEN strlen(s) < 40 THEN 1 ELSE 0 END - CASE WHEN strlen(s) > 150 THEN 2 ELSE 0 END AS points FROM s WHERE strlen(s) > 10),
    b AS (SELECT doc_id, CASE WHEN length(s) > 55 THEN left(s, 52) || '...' ELSE s END AS quote FROM p QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY points DESC, i) = 1),
    w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_-]+')) AS w FROM docs),
    c AS (SELECT doc_id, lower(w) AS topic, sum(CASE WHEN length(w) >= 3 THEN 1 ELSE 0 END + CASE WHEN regexp_matches(w, '^[A-Z]') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(w, '[_-]|^.+[A-Z]') THEN 2 ELSE 0 END) AS weight
          FROM w WHERE regexp_matches(w, '^[A-Za-z]') AND NOT list_contains({S.listed(dialect.STOPWORDS)}, lower(w)) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, topic) AS n FROM c WHERE weight > 0),
    t AS (SELECT doc_id, string_agg(topic, '_' ORDER BY n) AS topics FROM r WHERE n <= 3 GROUP BY doc_id),
    e AS (SELECT doc_id, list_transform(list_filter(list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')[2:], lambda x: regexp_replace(x, '[^A-Za-z]', '', 'g')),
            lambda x: regexp_full_match(x, '[A-Z][a-z]+') AND NOT list_contains({S.listed(dialect.STOPWORDS)}, lower(x))), lambda x: upper(left(x, 3))) AS codes, {_hint_sql(dialect.MOOD_HINTS)} AS moods, {_hint_sql(dialect.FLAG_HINTS)} AS flags FROM docs),
    parts AS (SELECT docs.doc_id, text, coalesce(wing, '') || '|' || coalesce(room, '') || '|' || coalesce(left(filed_at, 10), '?') || '|' || coalesce(regexp_replace(regexp_extract(source_file, '([^/]*)$', 1), '^(.+)\\.[^.]*$', '\\1'), '?') AS header,
            coalesce(nullif(array_to_string(list_filter(codes, {_FIRST.format('codes')})[1:3], '+'), ''), '???') AS who, coalesce(topics, 'misc') AS topics, quote,
            nullif(array_to_string(list_filter(moods, {_FIRST.format('moods')})[1:3], '+'), '') AS mood, nullif(array_to_string(list_filter(flags, {_FIRST.format('flags')})[1:3], '+'), '') AS flag
          FROM docs JOIN e USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN b USING (doc_id)),
    lines AS (SELECT doc_id AS id, text, header, header || chr(10) || concat_ws('|', '0:' || who, topics, '"' || quote || '"', mood, flag) AS dialect FROM parts),
    compressed AS (SELECT id, header, dialect, greatest(floor(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) * 1.3), 1)::INT AS original_tokens,
            greatest(floor(len(list_filter(regexp_split_to_array(dialect, '\\s+'), lambda x: x <> '')) * 1.3), 1)::INT AS summary_tokens, strlen(text)::INT AS original_chars, strlen(dialect)::INT AS summary_chars FROM lines)"""


@query(f"WITH {_COMPRESSED} SELECT * EXCLUDE (header) FROM compressed")
def compress(spark, folder):
    return dialect.compressed(drawers(spark, folder))


@query(f"""WITH {_COMPRESSED} SELECT sum(original_tokens)::BIGINT AS original_tokens, sum(summary_tokens)::BIGINT AS summary_tokens, sum(original_chars)::BIGINT AS original_chars, sum(summary_chars)::BIGINT AS summary_chars,
    sum(original_tokens) / greatest(sum(summary_tokens), 1) AS ratio FROM compressed""")
def compress_totals(spark, folder):
    return dialect.totals(dialect.compressed(drawers(spark, folder)))


@query(f"WITH {_COMPRESSED} SELECT id, header, 1 AS entries, 0 AS tunnels, NULL::VARCHAR AS arc FROM compressed")
def dialect_decode(spark, folder):
    rows = dialect.compressed(drawers(spark, folder)).select("id", dialect.decoded(F.col("dialect")).alias("d"))
    return rows.select("id", F.col("d.header").alias("header"), F.size("d.entries").alias("entries"), F.size("d.tunnels").alias("tunnels"), F.col("d.arc").alias("arc"))


#: Word boundaries are ASCII's in DuckDB: letters beyond it become ``_``, other signs beyond it ``.``.
_PLAIN = "regexp_replace(regexp_replace(text, '[^\\x00-\\x7F\\p{L}\\p{N}]', '.', 'g'), '[^\\x00-\\x7F]', '_', 'g')"
_RUNS = f"regexp_extract_all({_PLAIN}, '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+\\b')"
_STOP = S.listed(entities.STOPWORDS)


@query(f"""WITH {_DOCS}, n AS (SELECT unnest(list_concat(list_filter(regexp_extract_all({_PLAIN}, '\\b[A-Z][a-z]{{1,19}}\\b'), lambda w: NOT list_contains({_STOP}, lower(w))),
        list_filter({_RUNS}, lambda r: NOT list_has_any(regexp_split_to_array(lower(r), '\\s+'), {_STOP})))) AS name FROM docs)
    SELECT name, count(*) AS frequency FROM n GROUP BY name HAVING count(*) >= 3""")
def entity_candidates(spark, folder):
    return entities.candidates(_docs(spark, folder).select(F.col("doc_id").alias("id"), F.col("text").alias("content")))


@query()
def entity_classify(spark, folder):
    return entities.detected(_docs(spark, folder).select(F.col("doc_id").alias("id"), F.col("text").alias("content")))


@query(f"""WITH {_DOCS}, l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\r?\\n')) AS line, unnest(range(0, len(regexp_split_to_array(text, '\\r?\\n')))) AS no FROM docs),
    w AS (SELECT doc_id, no, max(regexp_matches(line, '(?i)\\b(?:she|hers?|he|him|his|they|them|their)\\b')::INT) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM l)
    SELECT doc_id, sum(near)::BIGINT AS near_lines, count(*) AS lines FROM w GROUP BY doc_id""")
def pronoun_window(spark, folder):
    from pyspark.sql import Window

    rows = _docs(spark, folder).select("doc_id", F.posexplode(F.split("text", r"\r?\n")).alias("no", "line"))
    near = F.max(F.col("line").rlike(entities.PRONOUNS).cast("int")).over(Window.partitionBy("doc_id").orderBy("no").rowsBetween(-2, 2))
    return rows.select("doc_id", near.alias("near")).groupBy("doc_id").agg(F.sum("near").alias("near_lines"), F.count("*").alias("lines"))


def _lines(spark, folder):
    records = incremental.latest_records(table(spark, folder, "session_records")).where("has_newline")
    files_ = incremental.listed_files(table(spark, folder, "session_files"))
    return records.join(files_.select("adapter", "source_key", "source_path"), ["adapter", "source_key"])


@query()
def session_exchanges(spark, folder):
    return assembly.exchanges(_lines(spark, folder))


_J = "CASE WHEN json_valid(raw_line) AND json_type(raw_line) = 'OBJECT' THEN raw_line::JSON END"


_TURNS = f"""r AS (SELECT * FROM session_records WHERE adapter = 'log_a' QUALIFY row_number() OVER (PARTITION BY source_key, start_byte ORDER BY read_at DESC) = 1),
    j AS (SELECT source_key, start_byte, {_J} AS j FROM r JOIN (SELECT DISTINCT adapter, source_key FROM session_files) USING (adapter, source_key) WHERE has_newline),
    ev AS (SELECT source_key, start_byte, j ->> '$.type' AS kind, j ->> '$.timestamp' AS stamp, j ->> '$.payload.id' AS session, j ->> '$.payload.cwd' AS project, coalesce(CASE WHEN json_type(j, '$.payload.client_id') = 'VARCHAR' THEN j ->> '$.payload.client_id' END, start_byte::VARCHAR) AS anchor,
            coalesce(j ->> '$.payload.thread_source', '') = 'subagent' OR coalesce(j -> '$.payload.source.subagent', 'null')::VARCHAR <> 'null' AS sub,
            CASE WHEN j ->> '$.type' = 'event_msg' AND j ->> '$.payload.type' = 'user_message' THEN nullif(trim(j ->> '$.payload.message', E' \\t\\r\\n'), '') END AS asked,
            CASE WHEN j ->> '$.type' = 'response_item' AND j ->> '$.payload.type' = 'message' AND j ->> '$.payload.role' = 'assistant' AND j ->> '$.payload.phase' = 'final_answer' THEN nullif(array_to_string(
                list_filter(list_transform(list_filter((j -> '$.payload.content')::JSON[], lambda p: (p ->> '$.type') = 'output_text'), lambda p: trim(p ->> '$.text', E' \\t\\r\\n')), lambda x: x <> ''), chr(10)), '') END AS answer
          FROM j WHERE j IS NOT NULL),
    meta AS (SELECT source_key, arg_min(session, start_byte) AS session, arg_min(sub, start_byte) AS sub, arg_min(project, start_byte) AS project FROM ev WHERE kind = 'session_meta' GROUP BY source_key),
    n AS (SELECT *, count(answer) OVER (PARTITION BY source_key ORDER BY start_byte ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM ev WHERE asked IS NOT NULL OR answer IS NOT NULL),
    turns AS (SELECT source_key, string_agg(asked, chr(10) ORDER BY start_byte) AS users, string_agg('user: ' || asked, chr(10) ORDER BY start_byte) AS said, max(answer) AS assistant, coalesce(arg_max(stamp, start_byte), arg_min(stamp, start_byte)) AS timestamp,
            any_value(meta.session) AS session_id, any_value(meta.project) AS project, arg_min(n.anchor, start_byte) FILTER (asked IS NOT NULL) AS anchor
        FROM n LEFT JOIN meta USING (source_key) WHERE NOT coalesce(meta.sub, false) GROUP BY source_key, g HAVING count(asked) > 0 AND count(answer) > 0)"""


@query(f"WITH {_TURNS} SELECT source_key, users, assistant, timestamp, session_id FROM turns")
def session_turns(spark, folder):
    rows = assembly.exchanges(_lines(spark, folder).where("adapter = 'log_a'"))
    return rows.select("source_key", F.array_join("users", "\n").alias("users"), "assistant", "timestamp", "session_id")


#: The fifth kind of UUID: SHA-1 of the name space of URLs and the name, with its version and variant.
_UUID = "substr(h, 1, 12) || '5' || substr(h, 14, 3) || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 15)"


@query(f"""WITH {_TURNS}, p AS (SELECT source_key, arg_max(source_path, modified_ns) AS source_path FROM session_files WHERE adapter = 'log_a' GROUP BY source_key),
    x AS (SELECT turns.*, coalesce(source_path, source_key) AS source_file, coalesce(session_id, 'unknown-session') AS session, said || chr(10) || 'assistant: ' || assistant AS content, list_filter(regexp_split_to_array(project, '[/\\\\]'), lambda q: q <> '')[-1] AS last FROM turns JOIN p USING (source_key)),
    u AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('log_a:' || source_file || ':' || session || ':' || anchor)) AS h FROM x)
    SELECT 'drawer_session_' || {_UUID} AS id, content, concat_ws(chr(10), 'kind: conversation', 'agent: log_a', 'session: ' || session, 'project: ' || project, CASE WHEN length(timestamp) >= 10 THEN 'date: ' || left(timestamp, 10) END, content) AS retrieval_text,
        'conversation' AS content_kind, 'sessions' AS wing, coalesce(nullif(trim(regexp_replace(lower(last), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'general') AS room, source_file, 0::BIGINT AS chunk_index, 'log_a' AS added_by, timestamp AS filed_at FROM u""")
def session_turn_drawers(spark, folder):
    return assembly.as_drawers(assembly.exchanges(_lines(spark, folder).where("adapter = 'log_a'")), "sessions")


@query()
def session_drawers(spark, folder):
    return assembly.as_drawers(assembly.exchanges(_lines(spark, folder)), "sessions")


@query("""WITH r AS (SELECT * FROM session_records QUALIFY row_number() OVER (PARTITION BY adapter, source_key, start_byte ORDER BY read_at DESC) = 1),
    f AS (SELECT DISTINCT adapter, source_key FROM session_files)
    SELECT adapter, count(*) AS files, sum(lines)::BIGINT AS lines, sum(held)::BIGINT AS held_back, sum(blank)::BIGINT AS blank FROM (
        SELECT adapter, source_key, count(*) AS lines, count(*) FILTER (NOT has_newline) AS held, count(*) FILTER (has_newline AND trim(raw_line, E' \\t\\r\\n') = '') AS blank FROM r JOIN f USING (adapter, source_key) GROUP BY ALL) GROUP BY adapter""")
def sync_report(spark, folder):
    records = incremental.latest_records(table(spark, folder, "session_records"))
    files_ = incremental.listed_files(table(spark, folder, "session_files")).select("adapter", "source_key")
    per_file = records.join(files_, ["adapter", "source_key"]).groupBy("adapter", "source_key").agg(
        F.count("*").alias("lines"), F.count_if(~F.col("has_newline")).alias("held"), F.count_if(F.col("has_newline") & (F.btrim("raw_line", F.lit(" \t\r\n")) == "")).alias("blank")
    )
    return per_file.groupBy("adapter").agg(F.count("*").alias("files"), F.sum("lines").alias("lines"), F.sum("held").alias("held_back"), F.sum("blank").alias("blank"))
