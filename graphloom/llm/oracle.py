"""DuckDB SQL for the queries that SQL can express. It says what the results are, by plain joins and counts over whole tables."""

from __future__ import annotations

#: Labels of the least id reachable over the links (a, b), both ways; a node without links is its own.
REACH = "reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a), least_of AS (SELECT a, min(b) AS m FROM reach GROUP BY a)"

SHINGLED = r"""words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
 shingles AS (SELECT DISTINCT doc_id, z[1] || chr(32) || z[2] AS x FROM (SELECT doc_id, unnest(list_zip(w[1:len(w) - 1], w[2:len(w)])) AS z FROM words WHERE len(w) >= 2) UNION ALL SELECT doc_id, w[1] FROM words WHERE len(w) = 1),
 sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
 both_ AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM shingles p JOIN shingles q ON p.x = q.x AND p.doc_id <> q.doc_id GROUP BY ALL),
 links AS (SELECT a, b FROM both_ JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * c >= 80 * (s.n + t.n - c))"""

OP4 = f"""WITH RECURSIVE {SHINGLED}, {REACH}
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN least_of ON least_of.a = d.doc_id"""

OP6 = f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
 good AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
 links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM good p JOIN good q ON p.vec_id <> q.vec_id AND len(p.e) = len(q.e) WHERE list_cosine_similarity(p.e, q.e) >= 0.95),
 counted AS (SELECT a, count(*) AS n FROM links GROUP BY a), {REACH}
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(m, v.vec_id)) AS component_id, v.vec_id = least(v.vec_id, coalesce(m, v.vec_id)) AS kept
FROM v LEFT JOIN counted ON counted.a = v.vec_id LEFT JOIN least_of ON least_of.a = v.vec_id"""

CONTROL = r"<s>|</s>|\[INST\]|\[/INST\]|\[ROLE |\[/ROLE\]"
#: Conversations whose roles hold no brackets or backslashes, as in the tables.
OP5 = rf"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS x(turn, role)),
 l AS (SELECT *, len(regexp_extract_all(text, '{CONTROL}')) AS controls, length(text) - length(replace(text, '\', '')) AS slashes, regexp_matches(text, '(?s)\\.') AS escaped FROM t),
 g AS (SELECT *, CASE WHEN escaped THEN 2 WHEN controls > 0 THEN 1 ELSE 0 END AS level FROM l)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 (3 + sum(length(text) + CASE level WHEN 0 THEN 0 WHEN 1 THEN controls ELSE controls + slashes END + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 5 ELSE 16 + length(role) END))::BIGINT AS formatted_chars, true AS identical, max(level)::INT AS max_level
FROM g GROUP BY conv_id"""

OP8 = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), k AS (SELECT html, max(page_id) AS keeper FROM p GROUP BY html), h AS (SELECT page_id, keeper, strlen(p.html) AS n, sha1(p.html) AS x FROM p JOIN k ON p.html = k.html)
SELECT page_id, n::BIGINT AS payload_bytes, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, 5 * (i // 4) + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), 'string_agg', '') AS payload_digest,
 CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM h"""


def crc_table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
        out.append(i)
    return out


#: A byte is two digits of the text in hexadecimal; the checksum folds them in order.
CRC = f"""bytes AS (SELECT doc_id, list(instr('0123456789ABCDEF', d) - 1 ORDER BY i) AS nibbles FROM (SELECT doc_id, unnest(string_split(hex(encode(text)), '')) AS d, generate_subscripts(string_split(hex(encode(text)), ''), 1) AS i FROM documents WHERE text <> '') GROUP BY doc_id),
 pairs AS (SELECT doc_id, list_transform(list_zip(list_filter(nibbles, lambda x, i: i % 2 = 1), list_filter(nibbles, lambda x, i: i % 2 = 0)), lambda z: (16 * z[1] + z[2])::BIGINT) AS b FROM bytes),
 crc AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, ({crc_table()}::BIGINT[])[xor(c & 255, x) + 1])), 4294967295::BIGINT) AS crc FROM pairs)"""
SHARDS, SEED = 24, 17
OP2 = f"""WITH {CRC},
 d AS (SELECT documents.doc_id, source, coalesce('=' || source, '') AS s, (coalesce(strlen(text), 0) + 8)::BIGINT AS size, coalesce(crc, 0)::BIGINT AS text_crc32, ('0x' || substr(md5('{SEED}|' || coalesce(documents.doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents LEFT JOIN crc ON crc.doc_id = documents.doc_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY h, doc_id, text_crc32, size) - 1 AS r, count(*) OVER (PARTITION BY s) AS n FROM d),
 p AS (SELECT *, row_number() OVER (ORDER BY (2 * r + 1)::DOUBLE / (2 * n)::DOUBLE, s, r, doc_id) - 1 AS position, count(*) OVER () AS total FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, (position * {SHARDS} // total)::INT AS shard, (position - ((position * {SHARDS} // total) * total + {SHARDS} - 1) // {SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard, source FROM p"""

TERM_RUNS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"
SPREAD = "(p - q) * (p - q) // (p + q)"
OP11 = f"""WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {TERM_RUNS} AS ts FROM documents),
 t AS (SELECT i, lang, source, unnest(ts) AS term FROM d), kept AS (SELECT lang, term, count(*) AS m FROM t GROUP BY ALL HAVING count(DISTINCT i) >= 10),
 g AS (SELECT DISTINCT lang, source FROM d), v AS (SELECT lang, count(*) AS v, sum(m)::BIGINT AS total FROM kept GROUP BY lang),
 c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL), n AS (SELECT g.lang, g.source, kept.term, m, coalesce(n, 0)::BIGINT AS n FROM g JOIN kept ON kept.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
 p AS (SELECT n.*, 1 + 1000000000 * (n + 2) // (sum(n) OVER (PARTITION BY n.lang, source)::BIGINT + 2 * v) AS p, 1 + 1000000000 * (m + 2) // (total + 2 * v) AS own FROM n JOIN v ON v.lang = n.lang),
 pair AS (SELECT lang, source, item, sum({SPREAD})::BIGINT AS value FROM (SELECT a.lang, a.source, b.source AS item, a.p AS p, b.p AS q FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source) GROUP BY ALL),
 pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
 terms AS (SELECT lang, source, 'term' AS part, term AS item, ({SPREAD})::BIGINT AS value FROM (SELECT lang, source, term, n, p, own AS q FROM p) WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)) WHERE part = 'pair' OR rank <= 10"""

WORD_RUNS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13 = f"""WITH d AS (SELECT row_number() OVER () AS i, doc_id, {WORD_RUNS} AS ts FROM documents), q AS (SELECT DISTINCT item_id, unnest({WORD_RUNS}) AS term FROM benchmark),
 s AS (SELECT count(*) AS nn, sum(len(ts))::BIGINT AS l FROM d WHERE len(ts) > 0), p AS (SELECT i, doc_id, n, term, count(*) AS tf FROM (SELECT i, doc_id, len(ts) AS n, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
 w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
 r AS (SELECT item_id, i, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // l))))::BIGINT AS score FROM q JOIN p ON p.term = q.term JOIN w ON w.term = q.term, s GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM r WHERE score > 0) WHERE rank <= 50"""

ORACLE = {"op2_stratified_shards": OP2, "op4_bottom_k_dedup": OP4, "op5_chat_grammar": OP5, "op6_grid_order_join": OP6, "op8_zip_warc": OP8, "op11_term_blocks": OP11, "op13_inverted_treaps": OP13}
