"""Incremental processing of session logs."""

from __future__ import annotations

from quillstone.plans.catalogue import query
from quillstone.plans.tables import table
from quillstone.streaming import incremental


def _sync(spark, folder):
    return (
        incremental.listed_files(table(spark, folder, "session_files")),
        incremental.latest_records(table(spark, folder, "session_records")),
        incremental.latest_checkpoints(table(spark, folder, "agent_session_sync_state")),
    )


_LATEST = """
    r AS (SELECT * FROM session_records QUALIFY row_number() OVER (PARTITION BY adapter, source_key, start_byte ORDER BY read_at DESC) = 1),
    f AS (SELECT DISTINCT adapter, source_key, file_size FROM session_files),
    c AS (SELECT * FROM agent_session_sync_state QUALIFY row_number() OVER (PARTITION BY adapter, source_key ORDER BY updated_at::TIMESTAMPTZ DESC) = 1),
    whole AS (SELECT adapter, source_key, string_agg(raw_line || CASE WHEN has_newline THEN chr(10) ELSE '' END, '' ORDER BY start_byte) AS body FROM r GROUP BY ALL),
    tail AS (SELECT c.adapter, c.source_key, byte_offset, fingerprint, hex(encode(body)) AS h, greatest(byte_offset - 4096, 0) AS a FROM c JOIN f USING (adapter, source_key) JOIN whole USING (adapter, source_key)
             WHERE byte_offset BETWEEN 0 AND f.file_size),
    hashed AS (SELECT adapter, source_key, byte_offset, fingerprint,
        list_reduce(list_transform(range(a, byte_offset), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::INT::HUGEINT), lambda s, x: (xor(s, x) * 1099511628211) % 18446744073709551616, 14695981039346656037::HUGEINT) AS v FROM tail),
    good AS (SELECT adapter, source_key, byte_offset FROM hashed WHERE lpad(lower(to_hex(v::UBIGINT)), 16, '0') = fingerprint)
"""


@query(f"""WITH {_LATEST} SELECT r.adapter, r.source_key, r.start_byte FROM r JOIN f USING (adapter, source_key) LEFT JOIN good USING (adapter, source_key)
    WHERE r.start_byte >= coalesce(good.byte_offset, 0) AND has_newline AND regexp_matches(raw_line, '\\S')""")
def p5_found(spark, folder):
    return incremental.pending(*_sync(spark, folder)).select("adapter", "source_key", "start_byte")


@query("""WITH r AS (SELECT * FROM session_records QUALIFY row_number() OVER (PARTITION BY adapter, source_key, start_byte ORDER BY read_at DESC) = 1),
    f AS (SELECT DISTINCT adapter, source_key, source_path, file_size, modified_ns FROM session_files),
    ends AS (SELECT adapter, source_key, max(start_byte + strlen(raw_line) + 1) AS byte_offset FROM r WHERE has_newline GROUP BY ALL),
    c AS (SELECT f.*, least(coalesce(byte_offset, 0), file_size) AS byte_offset FROM f LEFT JOIN ends USING (adapter, source_key)),
    whole AS (SELECT adapter, source_key, hex(encode(string_agg(raw_line || CASE WHEN has_newline THEN chr(10) ELSE '' END, '' ORDER BY start_byte))) AS h FROM r GROUP BY ALL)
    SELECT c.adapter, c.source_key, source_path, file_size, modified_ns, byte_offset, lpad(lower(to_hex(coalesce(list_reduce(list_transform(range(greatest(byte_offset - 4096, 0), byte_offset),
        lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::INT::HUGEINT), lambda s, x: (xor(s, x) * 1099511628211) % 18446744073709551616, 14695981039346656037::HUGEINT), 14695981039346656037)::UBIGINT)), 16, '0') AS fingerprint
    FROM c LEFT JOIN whole USING (adapter, source_key)""")
def p5_checkpoints(spark, folder):
    files, records, _ = _sync(spark, folder)
    return incremental.new_checkpoints(files, records)
