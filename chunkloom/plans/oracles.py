"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from chunkloom.config import ChunkerConfig, default_table

SIZE = 256
BITS, LOW, HIGH, WINDOW = 8, 64, 2048, 32
MASK = (1 << BITS) - 1

FIXED = f"""
d AS (SELECT coalesce(source, '') AS archive_id, doc_id AS file_id, encode(coalesce(text, '')) AS b, lang FROM documents),
c AS (SELECT archive_id, file_id, lang, (o // {SIZE})::BIGINT AS seq, o::BIGINT AS "offset", least({SIZE}, octet_length(b) - o)::BIGINT AS length, sha256(b[o + 1:o + {SIZE}]) AS hash
  FROM (SELECT *, unnest(range(0, octet_length(b), {SIZE})) AS o FROM d)),
dict AS (SELECT archive_id, (row_number() OVER (PARTITION BY archive_id ORDER BY first) - 1)::BIGINT AS idx, hash, source_size, occurrences
  FROM (SELECT archive_id, hash, min((file_id, seq)) AS first, any_value(length) AS source_size, count(*) AS occurrences FROM c GROUP BY ALL)),
placed AS (SELECT c.archive_id, (row_number() OVER w - 1)::BIGINT AS pos, idx, coalesce(sum(length) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", length, c.hash
  FROM c JOIN dict USING (archive_id, hash) WINDOW w AS (PARTITION BY c.archive_id ORDER BY file_id, seq))"""

SEEDS = """,
has AS (SELECT DISTINCT archive_id AS provider, hash FROM c),
given AS (SELECT p.*, coalesce((SELECT min(provider) FROM has h WHERE h.hash = p.hash AND h.provider <> p.archive_id), 'archive') AS provider FROM placed p)"""

VERSIONS = """,
n AS (SELECT file_id, octet_length(b) AS n FROM d),
cur AS (SELECT archive_id, hash, length, coalesce(sum(length) OVER (PARTITION BY archive_id ORDER BY file_id, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM c),
tgt AS (SELECT archive_id, hash, length, coalesce(sum(length) OVER (PARTITION BY archive_id ORDER BY n, file_id, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM c JOIN n USING (file_id))"""


def _bytes(table: str, key: str, text: str) -> str:
    """Places and values of all bytes."""
    return f"""
s AS (SELECT {key} AS k, encode(coalesce({text}, '')) AS b FROM {table}),
x AS (SELECT k, i, ('0x' || substr(h, 2 * i + 1, 2))::BIGINT AS v FROM (SELECT k, hex(b) AS h, unnest(range(octet_length(b)))::BIGINT AS i FROM s))"""


def _rollsums() -> str:
    w = WINDOW
    return f""",
r AS (SELECT k, i, (31 * {w} + t) AS s1, (31 * {w} * ({w} - 1) + (i + 1) * t - q) AS s2 FROM (
  SELECT k, i, (sum(v) OVER w)::BIGINT AS t, (sum(i * v) OVER w)::BIGINT AS q FROM x WINDOW w AS (PARTITION BY k ORDER BY i ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW))),
hit AS (SELECT k, i, (((s1 << 16) & 4294967295) | (s2 & 65535))::BIGINT AS sum FROM r WHERE (s2 & {MASK}) = {MASK})"""


def _buzsums() -> str:
    w = WINDOW
    seeded = ChunkerConfig("buzhash", table=default_table()).seeded_table
    values = ",".join(map(str, seeded))
    turn = lambda v, by: f"((({v} << ({by})) | ({v} >> (32 - ({by})))) & 4294967295)"
    return f""",
y AS (SELECT k, i, {turn("u", "(32 - i % 32) % 32")} AS y FROM (SELECT k, i, ([{values}]::BIGINT[])[v + 1] AS u FROM x)),
r AS (SELECT k, i, {turn("o", "i % 32")} AS sum FROM (SELECT k, i, bit_xor(y) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS o FROM y)),
hit AS (SELECT k, i, sum FROM r WHERE i >= {w} AND (sum & {MASK}) = {MASK})"""


def _chosen(first: int) -> str:
    """Chunks by recursion: the next hit far enough from the start, or the largest size, or the end."""
    return f""",
l AS (SELECT s.k, octet_length(b) AS n, b, coalesce(list(i ORDER BY i) FILTER (i IS NOT NULL), []) AS hits FROM s LEFT JOIN hit ON s.k = hit.k GROUP BY ALL),
e AS (SELECT k, 0::BIGINT AS seq, 0::BIGINT AS a, least(coalesce(list_filter(hits, lambda p: p >= {first})[1] + 1, n), {HIGH}, n)::BIGINT AS z FROM l WHERE n > 0
  UNION ALL SELECT e.k, seq + 1, z, least(coalesce(list_filter(hits, lambda p: p >= z + {LOW - 1})[1] + 1, n), z + {HIGH}, n)::BIGINT FROM e JOIN l ON e.k = l.k WHERE z < n),
o AS (SELECT e.k, seq, a AS "offset", z - a AS length, sha256(b[a + 1:z]) AS hash FROM e JOIN l ON e.k = l.k)"""


def _rolled(table: str, key: str, text: str, select: str, sums: str | None = None, first: int = LOW - 1) -> str:
    return f"WITH RECURSIVE {_bytes(table, key, text)}{sums or _rollsums()}{_chosen(first)} {select}"


ROLLED = 'SELECT k AS {0}, seq, "offset", length, hash FROM o'
SUMMARY = 'SELECT archive_id, sum(n)::BIGINT AS chunks, count(*) AS unique_chunks, sum(n * length)::BIGINT AS bytes, sum(length)::BIGINT AS unique_bytes, (sum(length) // count(*))::BIGINT AS average_size{0} FROM (SELECT archive_id, hash, count(*) AS n, any_value(length) AS length FROM {1} GROUP BY ALL) GROUP BY archive_id'
SIDES = ", q AS (SELECT hash, length, coalesce(lang, '') = 'en' AS en FROM c), k AS (SELECT hash, any_value(length) AS size, count(*) FILTER (en) AS occurrences_a, count(*) FILTER (NOT en) AS occurrences_b FROM q GROUP BY hash), z AS (SELECT *, CASE WHEN occurrences_b = 0 THEN 'a' WHEN occurrences_a = 0 THEN 'b' ELSE 'both' END AS class FROM k)"


def _human(n: str) -> str:
    return f"CASE WHEN {n} > 1048576 THEN printf('%.1f MiB (%d bytes)', {n} / 1048576, {n}) WHEN {n} > 1024 THEN printf('%.1f KiB (%d bytes)', {n} / 1024, {n}) ELSE printf('%d bytes', {n}) END"


ORACLES = {
    "fixed_chunks": f'WITH {FIXED} SELECT file_id AS doc_id, seq, "offset", length, hash FROM c',
    "rollsum_candidates": f"WITH {_bytes('documents', 'doc_id', 'text')}{_rollsums()} SELECT k AS doc_id, i AS place, sum FROM hit",
    "rollsum_chunks": _rolled("documents", "doc_id", "text", ROLLED.format("doc_id")),
    "split_chunks": _rolled("documents", "doc_id", "text", ROLLED.format("doc_id")),
    "page_chunks": _rolled("pages", "page_id", "html", ROLLED.format("page_id")),
    "buzhash_chunks": _rolled("documents", "doc_id", "text", ROLLED.format("doc_id"), _buzsums(), max(LOW - 1, WINDOW)),
    "chunk_size_stats": _rolled("documents", "doc_id", "text", "SELECT k AS doc_id, count(*) AS chunks, sum(length)::BIGINT AS bytes, min(length) AS smallest, max(length) AS largest, (sum(length) // count(*))::BIGINT AS average FROM o GROUP BY k"),
    "dedup_summary": _rolled("documents", "doc_id", "text", SUMMARY.format("", "(SELECT coalesce(source, '') AS archive_id, hash, length FROM o JOIN documents ON k = doc_id)")),
    "dedup_dictionary": f"WITH {FIXED} SELECT * FROM dict",
    "unique_chunks": f"""WITH {FIXED} SELECT archive_id, file_id, seq, "offset", length, hash FROM c QUALIFY row_number() OVER (PARTITION BY archive_id, hash ORDER BY file_id, seq) = 1""",
    "rebuild_order": f"WITH {FIXED} SELECT archive_id, pos, idx FROM placed",
    "source_layout": f"WITH {FIXED} SELECT * FROM placed",
    "archive_layout": f"WITH {FIXED}, a AS (SELECT archive_id, idx, hash, source_size AS archive_size, coalesce(sum(source_size) OVER (PARTITION BY archive_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS archive_offset FROM dict) SELECT *, archive_offset + archive_size AS archive_end FROM a",
    "chunk_index": f"""WITH {FIXED} SELECT archive_id, hash, any_value(length) AS size, array_to_string(list_sort(list(DISTINCT "offset")), ',') AS offsets FROM placed GROUP BY ALL""",
    "truncated_identity": f"WITH {FIXED} SELECT hash[1:8] AS hash, count(*) AS chunks, max(length) AS largest FROM c GROUP BY 1",
    "truncation_collisions": f"WITH {FIXED} SELECT hash[1:4] AS prefix, count(DISTINCT hash) AS hashes FROM c GROUP BY 1 HAVING hashes > 1",
    "prefix_equality": "SELECT doc_id, sha256(coalesce(text, ''))[1:8] = sha256(rtrim(coalesce(text, ''), ' '))[1:8] AS same, true AS \"empty\" FROM documents",
    "reassemble_verify": "SELECT doc_id, octet_length(encode(text))::BIGINT AS size, true AS whole, sha256(text) AS hash FROM documents WHERE text <> ''",
    "provider_precedence": f'WITH {FIXED}{SEEDS} SELECT archive_id, hash, length, "offset", provider FROM given',
    "seed_matches": f"WITH {FIXED}{SEEDS} SELECT archive_id, count(*) AS places, sum(length)::BIGINT AS bytes FROM given WHERE provider <> 'archive' GROUP BY 1",
    "missing_chunks": f"WITH {FIXED}{SEEDS} SELECT DISTINCT archive_id, hash, length FROM given WHERE provider = 'archive'",
    "clone_counters": f"WITH {FIXED}{SEEDS} SELECT archive_id, provider, count(*) AS chunks, sum(n)::BIGINT AS places, sum(length)::BIGINT AS bytes_fed, sum(n * length)::BIGINT AS bytes_written FROM (SELECT archive_id, provider, hash, any_value(length) AS length, count(*) AS n FROM given GROUP BY ALL) GROUP BY 1, 2",
    "in_place": f"""WITH {FIXED}{VERSIONS} SELECT archive_id, count(*) AS places, sum(length)::BIGINT AS bytes FROM tgt SEMI JOIN cur USING (archive_id, hash, "offset") GROUP BY 1""",
    "remaining_offsets": f"""WITH {FIXED}{VERSIONS} SELECT DISTINCT archive_id, hash, length, "offset" FROM tgt ANTI JOIN cur USING (archive_id, hash, "offset")""",
    "overlap_pairs": f"""WITH {FIXED}{VERSIONS} SELECT t.archive_id, t."offset" AS target_offset, t.hash AS target_hash, u."offset", u.length, u.hash FROM tgt t JOIN cur u
      ON t.archive_id = u.archive_id AND u."offset" < t."offset" + t.length AND t."offset" < u."offset" + u.length AND t.hash <> u.hash""",
    "range_requests": f"""WITH {FIXED}{SEEDS}, a AS (SELECT archive_id, idx, hash, source_size AS size, coalesce(sum(source_size) OVER (PARTITION BY archive_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM dict),
      m AS (SELECT * FROM a SEMI JOIN (SELECT archive_id, hash FROM given WHERE provider = 'archive') USING (archive_id, hash)),
      g AS (SELECT *, sum(new) OVER (PARTITION BY archive_id ORDER BY idx) AS island FROM (SELECT *, (coalesce(lag("offset" + size) OVER (PARTITION BY archive_id ORDER BY idx) <> "offset", true))::INT AS new FROM m))
      SELECT archive_id, min(idx) AS first_idx, count(*) AS ranges, min("offset") AS "offset", sum(size)::BIGINT AS size FROM g GROUP BY archive_id, island""",
    "diff_classes": f"WITH {FIXED}{SIDES} SELECT * FROM z",
    "diff_summary": f"WITH {FIXED}{SIDES} SELECT class, count(*) AS chunks, sum(t)::BIGINT AS occurrences, sum(size * t)::BIGINT AS bytes, sum(size * t)::BIGINT AS stored_bytes FROM (SELECT class, size, occurrences_a + occurrences_b AS t FROM z UNION ALL SELECT 'either', size, occurrences_a + occurrences_b FROM z) GROUP BY class",
    "set_operations": f"WITH {FIXED}{SIDES} SELECT * FROM (VALUES ('union', (SELECT count(*) FROM z)), ('intersection', (SELECT count(*) FROM z WHERE class = 'both')), ('a_minus_b', (SELECT count(*) FROM z WHERE class = 'a')), ('b_minus_a', (SELECT count(*) FROM z WHERE class = 'b'))) v(operation, chunks)",
    "info_report": f"WITH {FIXED}, i AS ({SUMMARY.format('', 'c')}) SELECT *, {_human('bytes')} AS size_text FROM i",
    "human_size": f"WITH h AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n, n * 1000 AS m FROM documents) SELECT doc_id, {_human('n')} AS small, {_human('m')} AS large FROM h",
    "parse_size": "WITH h AS (SELECT doc_id, length(text) AS n, (doc_id % 6)::INT AS u FROM documents) SELECT doc_id, n || ['', 'B', 'KiB', 'MiB', 'GiB', 'kB'][u + 1] AS size_text, (n * [1, 1, 1024, 1048576, 1073741824, NULL][u + 1])::BIGINT AS bytes FROM h",
    "hex_roundtrip": "SELECT doc_id, sha256(coalesce(text, '')) AS even, '0' || sha256(coalesce(text, ''))[2:] AS odd FROM documents",
    "metadata_lookup": "WITH m AS (SELECT coalesce(source, '') AS archive_id, coalesce(lang, '') AS key, count(*)::VARCHAR AS v FROM documents GROUP BY ALL) SELECT archive_id, max(v) FILTER (key = 'en') AS english, string_agg(key || '(' || length(v) || ')', ', ' ORDER BY key) AS listing FROM m GROUP BY 1",
    "codec_marker": _rolled("documents", "doc_id", "text", "SELECT k AS doc_id, seq, length, true AS not_larger, true AS marked, hash FROM o"),
    "blake2_identity": _rolled("documents", "doc_id", "text", """SELECT k AS doc_id, seq, "offset", length, 32::BIGINT AS hash_bytes, first(k) OVER w AS first_doc, first(seq) OVER w AS first_seq FROM o WINDOW w AS (PARTITION BY hash ORDER BY k, seq)"""),
    "reorder_ops": "SELECT coalesce(source, '') AS archive_id, sum(octet_length(encode(text)))::BIGINT AS size, sha256(string_agg(text, '' ORDER BY octet_length(encode(text)), doc_id)) AS hash FROM documents WHERE text <> '' GROUP BY 1",
    "archive_roundtrip": "SELECT way, size, hash FROM (SELECT sum(octet_length(encode(text)))::BIGINT AS size, sha256(string_agg(text, '' ORDER BY doc_id)) AS hash FROM documents), (VALUES ('files'), ('cloned'), ('in_place'), ('source'), ('fetched')) v(way)",
    "header_roundtrip": f"""WITH {FIXED}, a AS (SELECT archive_id, idx, hash, source_size, occurrences, coalesce(sum(source_size) OVER (PARTITION BY archive_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS archive_offset, (sum(source_size * occurrences) OVER (PARTITION BY archive_id))::BIGINT AS total FROM dict)
      SELECT archive_id, 0::BIGINT AS header_excess, 0::BIGINT AS payload_excess, total, true AS checked, idx, hash, archive_offset, source_size AS archive_size, source_size, occurrences AS places FROM a""",
    "range_reads": """SELECT doc_id, coalesce(sum(octet_length(encode(text))) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", octet_length(encode(text))::BIGINT AS size, sha256(text) AS hash FROM documents WHERE text <> ''""",
    "chunker_params": """SELECT average::BIGINT AS average, algorithm, CASE WHEN fixed THEN 0 ELSE floor(log2(average)) - 1 END::BIGINT AS filter_bits, CASE WHEN fixed THEN 0 ELSE average // 4 END::BIGINT AS min_size,
      CASE WHEN fixed THEN average ELSE average * 256 END::BIGINT AS max_size, CASE algorithm WHEN 'fixed' THEN 0 WHEN 'rollsum' THEN 64 ELSE 16 END::BIGINT AS window_size, CASE WHEN fixed THEN 64 ELSE 4 + k END::BIGINT AS hash_length,
      CASE WHEN NOT fixed THEN pow(2, floor(log2(average)))::BIGINT END AS target_average, true AS same
      FROM (SELECT *, algorithm = 'fixed' AS fixed FROM (VALUES (0, 4), (1, 255), (2, 256), (3, 1000), (4, 65536), (5, 1048576)) a(k, average), (VALUES ('rollsum'), ('buzhash'), ('fixed')) b(algorithm))""",
    "codec_levels": "SELECT codec, level::BIGINT AS level, level BETWEEN 1 AND highest AS accepted FROM (VALUES ('brotli', 11), ('lzma', 9), ('zstd', 22), ('gzip', 0)) c(codec, highest), range(-1, 25) r(level)",
    "compress_roundtrip": "SELECT doc_id, codec, sha256(coalesce(text, '')) AS hash FROM documents, (VALUES ('none'), ('brotli'), ('zstd'), ('lzma')) v(codec)",
    "streaming_dedup": _rolled("documents", "doc_id", "text", "SELECT DISTINCT hash, length FROM o"),
    "streaming_segments": f"""WITH t AS (SELECT conv_id, encode(string_agg(coalesce(text, ''), '' ORDER BY turn)) AS b FROM conversations GROUP BY 1)
      SELECT conv_id, (o // {SIZE})::BIGINT AS seq, o::BIGINT AS "offset", least({SIZE}, octet_length(b) - o)::BIGINT AS length, sha256(b[o + 1:o + {SIZE}]) AS hash FROM (SELECT *, unnest(range(0, octet_length(b), {SIZE})) AS o FROM t)""",
}
