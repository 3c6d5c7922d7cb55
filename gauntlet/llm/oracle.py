"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

from gauntlet.llm.warc_derivatives import BASE32, BREAKS, ENTITIES, HIDDEN

WORDS = r"'[^\x20\x09-\x0D]+'"
UPPER, LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"


def _uuid(value: str) -> str:
    h = f"md5({value})"
    parts = ", ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"'<urn:uuid:' || concat_ws('-', {parts}) || '>'"


def _digest(value: str) -> str:
    letter = f"substr('{BASE32}', 1 + ((('0x' || substr(sha1({value}), 1 + (i // 4) * 5, 5))::INT >> (15 - 5 * (i % 4))) & 31), 1)"
    return f"'sha1:' || array_to_string(list_transform(range(0, 32), lambda i: {letter}), '')"


def _plain(value: str) -> str:
    text = rf"regexp_replace(regexp_replace(regexp_replace({value}, '{HIDDEN}', ' ', 'g'), '{BREAKS}', chr(10), 'g'), '<[^>]*>', '', 'g')"
    for entity, character in ENTITIES:
        quoted = [x.replace("'", "''") for x in (entity, character)]
        text = f"replace({text}, '{quoted[0]}', '{quoted[1]}')"
    text = rf"regexp_replace({text}, '[ \t\r\f]+', ' ', 'g')"
    return rf"trim(regexp_replace({text}, '[ \n]*\n[ \n]*', chr(10), 'g'), ' ' || chr(10))"


_CRLF = "chr(13) || chr(10)"
_FIELDS = (("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "'2024-01-01T00:00:00Z'"),
           ("WARC-Target-URI", "target_uri"), ("WARC-Refers-To", "refers_to"), ("WARC-Concurrent-To", "concurrent_to"),
           ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Payload-Digest", "source_digest"),
           ("Content-Type", "content_type"), ("Content-Length", "content_length"))

OP3 = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload FROM pages),
r AS (SELECT *, {_uuid("concat_ws('|', page_id::VARCHAR, target_uri, " + _digest("payload") + ")")} AS refers_to, strlen(payload) AS size FROM p),
b AS (SELECT page_id, target_uri, refers_to,
        {_uuid("concat_ws('|', refers_to, 'metadata')")} AS metadata_id,
        {_uuid("concat_ws('|', refers_to, 'conversion')")} AS conversion_id,
        {_digest("payload")} AS source_digest,
        ['HTTP/1.1 200 OK', 'Content-Type: text/html; charset=utf-8', 'Content-Length: ' || size] AS http_head,
        regexp_extract(payload, '(?is)<title[^>]*>(.*?)</title', 1) AS title,
        regexp_extract_all(payload, '(?i)<a\\s[^>]*href\\s*=\\s*"([^"]*)"', 1) AS links,
        {_plain("payload")} AS text FROM r),
m AS (SELECT page_id, 'metadata' AS warc_type, metadata_id AS record_id, refers_to, conversion_id AS concurrent_to, target_uri,
        'application/json' AS content_type, source_digest,
        json_object('target_uri', target_uri, 'refers_to', refers_to, 'conversion', conversion_id, 'http_head', http_head,
                    'payload_digest', source_digest, 'text_length', strlen(text), 'title', title, 'links', links)::VARCHAR AS block FROM b
      UNION ALL
      SELECT page_id, 'conversion', conversion_id, refers_to, metadata_id, target_uri, 'text/plain; charset=utf-8', source_digest, text FROM b),
d AS (SELECT *, strlen(block)::BIGINT AS content_length, {_digest("block")} AS block_digest FROM m)
SELECT page_id, warc_type, record_id, refers_to, concurrent_to, target_uri, content_type, content_length, block_digest,
       source_digest, 'WARC/1.1' || {" || ".join(f"{_CRLF} || '{n}: ' || {c}" for n, c in _FIELDS)} AS header, block
FROM d"""

OP4 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
c AS (SELECT r, doc_id, text, crc32 % 10 = 0 AS held_out FROM d JOIN crc USING (doc_id)),
t AS (SELECT r, held_out, unnest(list_append(regexp_extract_all(translate(text, {UPPER}, {LOWER}), {WORDS}), ' ')) AS w,
             generate_subscripts(list_append(regexp_extract_all(translate(text, {UPPER}, {LOWER}), {WORDS}), ' '), 1) AS i FROM c),
s AS (SELECT *, coalesce(lag(w) OVER (PARTITION BY r ORDER BY i), '  ') AS p FROM t),
u AS (SELECT w, count(*) AS n FROM s WHERE NOT held_out GROUP BY w),
b AS (SELECT p, w, count(*) AS n FROM s WHERE NOT held_out GROUP BY p, w),
h AS (SELECT p, sum(n) AS n FROM b GROUP BY p),
g AS (SELECT coalesce(sum(n), 0)::BIGINT AS n, count(*) AS v FROM u),
q AS (SELECT s.r, u.n IS NOT NULL AS known, g.n AS total, (coalesce(u.n, 0) + 0.1::DOUBLE) / (g.n + 0.1::DOUBLE * (g.v + 1)) AS base,
             coalesce(b.n, 0) AS bn, coalesce(h.n, 0) AS hn
      FROM s CROSS JOIN g LEFT JOIN u USING (w) LEFT JOIN b ON s.p = b.p AND s.w = b.w LEFT JOIN h ON s.p = h.p)
SELECT c.doc_id, c.held_out, x.* EXCLUDE (r)
FROM c JOIN (SELECT r, count(*) AS n_tokens, count(*) FILTER (known) AS n_known, any_value(total) AS train_tokens,
                    sum(log10(base)) AS base_score, sum(log10((bn + 5 * base) / (hn + 5))) AS score FROM q GROUP BY r) x ON c.r = x.r"""

#: DuckDB has no crc32; a table of 256 entries, made by the polynomial's rule, gives it byte by byte.
_CRC = """
WITH RECURSIVE bits AS (
  SELECT range::BIGINT AS i, range::BIGINT AS v, 0 AS k FROM range(256)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
entries AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
crc AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                 lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS crc32
        FROM (SELECT DISTINCT doc_id FROM documents) CROSS JOIN entries),
"""
OP4 = _CRC + OP4.strip().removeprefix("WITH ")

OP5 = rf"""
WITH rules(rule, host, path, verdict) AS (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
u AS (SELECT row_number() OVER () AS r, page_id,
        coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), {UPPER}, {LOWER}), '') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
f AS (SELECT u.r, rules.rule, rules.verdict,
        row_number() OVER (PARTITION BY u.r ORDER BY length(rules.host) DESC, length(rules.path) DESC) AS k
      FROM u JOIN rules ON (u.host = rules.host OR ends_with(u.host, '.' || rules.host)) AND starts_with(u.path, rules.path))
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM u LEFT JOIN f ON u.r = f.r AND f.k = 1"""

OP9 = f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id,
                            regexp_extract_all(translate(coalesce(text, ''), {UPPER}, {LOWER}), {WORDS}) AS words FROM documents),
s AS (SELECT DISTINCT r, unnest(list_transform(range(1, 1 + greatest(least(len(words), 1), len(words) - 4)),
                                               lambda i: array_to_string(words[i:i + 4], ' '))) AS g FROM w),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
o AS (SELECT a.r AS a, b.r AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
l AS (SELECT a, b FROM o JOIN n x ON o.a = x.r JOIN n y ON o.b = y.r WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
reach(r, other) AS (SELECT r, r FROM w UNION SELECT reach.r, l.b FROM reach JOIN l ON reach.other = l.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM w LEFT JOIN n ON w.r = n.r
JOIN (SELECT reach.r, min(x.doc_id) AS component_id FROM reach JOIN w x ON reach.other = x.r GROUP BY reach.r) c ON w.r = c.r"""



def _leaf(n_chars: str) -> str:
    parts = (f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", n_chars, "text"))
    return f"sha256({' || '.join(parts)})"


_PAIRS = "list_transform(range(0, (len(h) + 1) // 2), lambda i: sha256(h[2 * i + 1] || coalesce(h[2 * i + 2], '')))"
#: A sibling with its side in front; a node without one has 'N'.
_SIDE = "CASE WHEN (pos >> lvl) & 1 = 1 THEN 'L' || h[pos >> lvl] ELSE coalesce('R' || h[(pos >> lvl) + 2], 'N') END"

OP11 = _CRC + f"""
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM (
        SELECT row_number() OVER () AS r, doc_id, lang, {_leaf('n_chars')} AS leaf,
               {_leaf('(n_chars + CASE WHEN coalesce(crc32 % 7 = 0, false) THEN 1 ELSE 0 END)')} AS checked
        FROM documents LEFT JOIN crc USING (doc_id))),
t(lang, lvl, h) AS (SELECT lang, 0, list(leaf ORDER BY pos) FROM l GROUP BY lang
  UNION ALL SELECT lang, lvl + 1, {_PAIRS} FROM t WHERE len(h) > 1),
s AS (SELECT lang, h[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM t WHERE len(h) = 1),
u(lvl, h) AS (SELECT 0, list(subroot ORDER BY pos) FROM s UNION ALL SELECT lvl + 1, {_PAIRS} FROM u WHERE len(h) > 1),
p AS (SELECT r, 0 AS part, lvl, {_SIDE} AS sibling FROM l JOIN t ON l.lang IS NOT DISTINCT FROM t.lang AND len(h) > 1
      UNION ALL
      SELECT r, 1, lvl, {_SIDE.replace('pos', 's.pos')} FROM l JOIN s ON l.lang IS NOT DISTINCT FROM s.lang JOIN u ON len(h) > 1),
w AS (SELECT r, list(sibling ORDER BY part, lvl) AS path FROM p GROUP BY r)
SELECT l.doc_id, l.leaf, s.subroot, z.root, sha256(array_to_string(list_transform(coalesce(path, []), lambda x: x[2:]), '')) AS proof_sha256,
       list_reduce(list_prepend(checked, coalesce(path, [])), lambda a, b: CASE b[1] WHEN 'L' THEN sha256(b[2:] || a)
                   WHEN 'R' THEN sha256(a || b[2:]) ELSE sha256(a) END) AS folded_root,
       folded_root = z.root AS verified
FROM l JOIN s ON l.lang IS NOT DISTINCT FROM s.lang JOIN (SELECT h[1] AS root FROM u WHERE len(h) = 1) z ON true LEFT JOIN w ON l.r = w.r"""

OP13 = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score
      FROM e a JOIN e r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 5"""

ORACLE_SQL = {"op3_warc_derivatives": OP3, "op4_lm_scoring": OP4, "op5_url_filter": OP5, "op9_ngram_join": OP9,
              "op11_merkle_manifest": OP11, "op13_hard_negatives": OP13}
