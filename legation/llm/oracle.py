"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_EXACT = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id,
       min(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept,
       sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""

_URLS = r"""
WITH p AS (
  SELECT page_id, url, regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages
), h AS (
  SELECT *, regexp_replace(lower(regexp_replace(regexp_extract(rest, '^[^/?#]*'), '^.*@', '')), '(:[0-9]*)?$|\.(:[0-9]*)?$', '') AS host,
         regexp_extract(rest, '^[^/?#]*/([^/?#]*)', 1) AS segment,
         1704067200 + ('0x' || substr(md5(page_id::VARCHAR), 1, 8))::BIGINT % 31536000 AS fetched_at
  FROM p
), l AS (
  SELECT DISTINCT page_id, url, fetched_at, unnest(
    [array_to_string(string_split(host, '.')[i:], '.') FOR i IN range(1, len(string_split(host, '.')) + 1)]
    || CASE WHEN segment <> '' THEN [host || '/' || segment] ELSE [] END) AS key
  FROM h WHERE host <> '' AND length(host) <= 253
), d AS (
  SELECT key, ('0x' || substr(md5(key), 1, 8))::BIGINT AS h, ('0x' || substr(md5('at:' || key), 1, 8))::BIGINT AS t
  FROM (SELECT DISTINCT key FROM l)
), e AS (
  SELECT key, CASE WHEN h % 7 < 5 THEN 'block' ELSE 'allow' END AS verdict, 'list' || (h % 3) AS category,
         1704067200 + (t * s.step + s.step * 12345678) % 31536000 AS moment, s.action
  FROM d, (VALUES (1, 'add'), (3, 'remove'), (7, 'add')) s(step, action) WHERE h % 5 < 2
), c AS (
  SELECT key, verdict, category, moment, NOT bool_or(action = 'remove') AS active FROM e GROUP BY ALL
), i AS (
  SELECT *, lead(moment) OVER (PARTITION BY key, verdict, category ORDER BY moment) AS until FROM c
), m AS (
  SELECT l.page_id, l.url, l.fetched_at, i.*,
         row_number() OVER (PARTITION BY l.page_id, l.url ORDER BY -length(i.key), i.verdict <> 'block', i.category) AS n,
         count(*) OVER (PARTITION BY l.page_id, l.url) AS n_active
  FROM l JOIN i ON l.key = i.key AND i.active AND l.fetched_at >= i.moment AND (i.until IS NULL OR l.fetched_at < i.until)
)
SELECT h.page_id, h.url, h.fetched_at, coalesce(m.verdict, 'none') AS verdict, m.key AS entry, m.category,
       m.moment AS valid_from, m.until AS valid_to, coalesce(m.n_active, 0) AS n_active
FROM h LEFT JOIN m ON m.n = 1 AND m.page_id IS NOT DISTINCT FROM h.page_id AND m.url IS NOT DISTINCT FROM h.url
"""

_KINDS = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 28),
    ("private", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]*", 0, 27),
)


def _secrets() -> str:
    found = " UNION ALL ".join(
        f"""
  SELECT doc_id, source, lang, '{kind}' AS kind, {rank} AS rank,
         unnest(string_split_regex(t, '{p}')[:len(regexp_extract_all(t, '{p}'))]) AS gap,
         unnest(regexp_extract_all(t, '{p}')) AS hit, unnest(regexp_extract_all(t, '{p}', {group})) AS secret,
         unnest(range(len(regexp_extract_all(t, '{p}')))) AS pos, {least} AS least
  FROM t WHERE regexp_matches(t, '{p}')"""
        for rank, (kind, pattern, group, least) in enumerate(_KINDS)
        for p in [pattern.replace("'", "''")]
    )
    return f"""
WITH t AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents),
f AS ({found}),
s AS (
  SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY pos) AS stop FROM f
), g AS (
  SELECT doc_id, source, concat_ws('/', source, lang) AS repo, kind, rank, (stop - length(hit))::BIGINT AS start, stop::BIGINT AS stop, secret,
         len(list_distinct(string_split(secret, ''))) AS variety
  FROM s WHERE length(secret) >= least
), o AS (
  SELECT secret, count(DISTINCT coalesce(source, chr(0))) AS owners FROM g GROUP BY secret
), r AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans,
         count(*) FILTER (owners = 1 AND variety >= 6) AS n_live,
         count(*) FILTER (owners = 2 AND variety >= 6) AS n_shared,
         count(*) FILTER (owners >= 3 OR variety < 6) AS n_example, max(owners) AS max_owners
  FROM g JOIN o USING (secret) GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
       coalesce(n_shared, 0) AS n_shared, coalesce(n_example, 0) AS n_example, coalesce(max_owners, 0) AS max_owners
FROM t LEFT JOIN r ON t.doc_id = r.doc_id
"""


# Base 32 of a SHA-1: eight groups of five digest hex digits (20 bits), four letters each.
_ARCHIVE = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p
)
SELECT page_id, payload_bytes,
       array_to_string(flatten([[substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(hex, g * 5 + 1, 5))::BIGINT >> (15 - 5 * j)) & 31)::INT + 1, 1)
         FOR j IN range(4)] FOR g IN range(8)]), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
"""

# Every phrase of one to five words is counted; the first of equal cuts is the
# one with the fewest words.
_PHRASES = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), p AS (
  SELECT lang, regexp_extract_all(unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d
), g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p CROSS JOIN range(1, 6) AS ks(k) WHERE len(w) >= k)
), f AS (
  SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY lang, k, phrase
), n AS (
  SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE a >= 100
), x AS (
  SELECT lang, array_to_string(w[s:s + k - 2], ' ') AS phrase, max(a) AS longer FROM c CROSS JOIN (VALUES (1), (2)) AS e(s) WHERE k > 2 GROUP BY ALL
), o AS (
  SELECT c.* FROM c LEFT JOIN x ON x.lang = c.lang AND x.phrase = c.phrase WHERE c.k > 1 AND (x.longer IS NULL OR x.longer < c.a)
), h AS (
  SELECT o.lang, o.phrase, o.a, j, l.a AS l, r.a AS r, n.n, ((1000::HUGEINT * o.a * n.n) // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM o CROSS JOIN range(1, 5) AS js(j)
  JOIN c l ON l.lang = o.lang AND l.phrase = array_to_string(o.w[:j], ' ')
  JOIN c r ON r.lang = o.lang AND r.phrase = array_to_string(o.w[j + 1:], ' ')
  JOIN n ON n.lang = o.lang
  WHERE j < o.k
), b AS (
  SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
)
SELECT lang, row_number() OVER w AS rank, phrase, a, l, r, n, score FROM b
WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER w <= 2000
"""

# CRC-32 bit by bit: the reflected polynomial is a fixed value. A prefix of
# turns is named by the digest of its turns' digests.
_TRIE = r"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, turn,
         sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id
  FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT c, id, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words,
         row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, substr(id, 1, 32)) AS p
  FROM t
), v AS (
  SELECT c, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(c::VARCHAR) + 1),
           lambda i: ascii(substr(c::VARCHAR, i::INT, 1))::BIGINT)),
           lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)),
             lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::BIGINT) ELSE y >> 1 END)), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT c FROM o)
), b AS (
  SELECT v.c, 0 AS part, o.p, o.id, o.words FROM v JOIN o ON o.c = v.c - v.c % 20 AND o.p <= v.h
  UNION ALL
  SELECT v.c, 1, o.p, o.id, o.words FROM v JOIN o ON o.c = v.c AND o.p > v.h
), q AS (
  SELECT c, words, row_number() OVER w AS depth, sha256(string_agg(id, '') OVER w) AS k FROM b WINDOW w AS (PARTITION BY c ORDER BY part, p)
), a AS (
  SELECT c, words, depth, k, coalesce(lag(k) OVER (PARTITION BY c ORDER BY depth), '') AS up FROM q
  UNION ALL
  SELECT c, 0, 0, '', NULL FROM v
), m AS (
  SELECT *, depth = max(depth) OVER (PARTITION BY c) AS ends FROM a
), n AS (
  SELECT k, any_value(up) AS up, any_value(depth) AS depth, any_value(words) AS words, min(c) AS conv, count(*) AS n,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends
  FROM m GROUP BY k
), kids AS (
  SELECT up AS k, count(*) AS kids FROM n WHERE up IS NOT NULL GROUP BY up
), s AS (
  SELECT m.k, sum((kids.k IS NULL)::INT)::BIGINT AS leaves, sum((n.n - 1) * n.words)::BIGINT AS saved
  FROM n LEFT JOIN kids ON kids.k = n.k JOIN m ON m.c = n.conv AND m.depth <= n.depth GROUP BY m.k
)
SELECT n.conv AS conv_id, n.depth, up.conv AS parent_conv_id, n.n AS n_convs, coalesce(kids.kids, 0) AS n_children,
       s.leaves AS n_leaves, s.saved AS saved_tokens, n.ends AS ends_sha256
FROM n LEFT JOIN n up ON up.k = n.up LEFT JOIN kids ON kids.k = n.k JOIN s ON s.k = n.k
"""

ORACLE = {
    "op5_url_verdicts": _URLS,
    "op6_secret_scan": _secrets(),
    "op8_archive": _ARCHIVE,
    "op9_exact_duplicates": _EXACT,
    "op11_collocations": _PHRASES,
    "op13_prefix_trie": _TRIE,
}
