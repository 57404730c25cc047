"""DuckDB SQL of the queries that SQL can state, written independently of the operators."""

from __future__ import annotations

from voltatlas.llm import mixing, quality

EXACT_DEDUP = r"""
WITH hashed AS (
  SELECT doc_id,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h
  FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, h AS text_sha256
FROM hashed WINDOW same AS (PARTITION BY h)
"""

# Every quotient of every shard is listed and the highest are taken, one for each block.
MIXING = rf"""
WITH sized AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('{mixing.SEED}:' || doc_id), 1, 13))::BIGINT AS draw
  FROM documents),
sums AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) AS source_no
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, [3, 1, 2][((source_no - 1) % 3 + 1)::INT] AS weight,
         2 * source_size AS limit_words FROM sums),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(limit_words) OVER before, 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed
  WINDOW before AS (ORDER BY limit_words / weight, source_no
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_no, source_size, least(limit_words::DOUBLE, coalesce(
    (SELECT level FROM levels WHERE level <= limit_words / weight
     ORDER BY limit_words / weight, source_no LIMIT 1) * weight,
    limit_words::DOUBLE)) AS target
  FROM levels),
shards AS (SELECT greatest(1, ceil(sum(size) / {mixing.SHARD_WORDS}))::BIGINT AS n FROM sized),
dealt AS (
  SELECT s.doc_id, s.size, s.draw, t.source_no, t.source_size, t.target, s.draw % n AS shard
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source, shards),
cells AS (
  SELECT shard, source_no, sum(size)::BIGINT AS cell_size,
         CASE WHEN any_value(source_size) > 0 THEN floor(
           any_value(target) * ceil(sum(size) / {mixing.BLOCK_WORDS}) / any_value(source_size)
           * {mixing.VOTE_UNITS})
         ELSE 0 END::BIGINT AS votes
  FROM dealt GROUP BY shard, source_no),
house AS (
  SELECT shard, floor(sum(votes) / {mixing.VOTE_UNITS}::DOUBLE + 0.5) AS seats
  FROM cells GROUP BY shard),
quotients AS (
  SELECT shard, source_no, row_number() OVER (
    PARTITION BY shard ORDER BY votes / (2 * seat + 1)::DOUBLE DESC, source_no, seat) AS place
  FROM cells, unnest(range(0, 3 * (cell_size // {mixing.BLOCK_WORDS} + 30))) AS q(seat)
  WHERE votes > 0),
won AS (
  SELECT shard, source_no, count(*) AS seats
  FROM quotients JOIN house USING (shard) WHERE place <= house.seats
  GROUP BY shard, source_no),
quotas AS (
  SELECT c.shard, c.source_no, greatest(ceil(cell_size / {mixing.BLOCK_WORDS}), 1)::BIGINT AS n,
         least(coalesce(seats, 0), 2 * ceil(cell_size / {mixing.BLOCK_WORDS}))::BIGINT AS quota,
         ('0x' || substr(md5('{mixing.SEED}:' || c.shard || '/' || c.source_no), 1, 13))::BIGINT AS d
  FROM cells c LEFT JOIN won USING (shard, source_no)),
placed AS (
  SELECT *, sum(size) OVER (
    PARTITION BY shard, source_no ORDER BY draw, doc_id, size
    ROWS UNBOUNDED PRECEDING)::BIGINT AS ends
  FROM dealt),
spread AS (
  SELECT p.*, q.n, q.quota // q.n AS whole, q.quota % q.n AS once, q.d % q.n AS start
  FROM placed p JOIN quotas q USING (shard, source_no)),
edges AS (
  SELECT *, ends // {mixing.BLOCK_WORDS} AS j1, (ends - size) // {mixing.BLOCK_WORDS} AS j0
  FROM spread)
SELECT doc_id, size, source_size, target, (whole * size
  + ((j1 + start) * once // n - (j0 + start) * once // n) * {mixing.BLOCK_WORDS}
  + ends % {mixing.BLOCK_WORDS} * ((j1 + 1 + start) * once // n - (j1 + start) * once // n)
  - (ends - size) % {mixing.BLOCK_WORDS} * ((j0 + 1 + start) * once // n - (j0 + start) * once // n)
  )::BIGINT AS taken
FROM edges
"""


URLS = r"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN host = 'www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN ends_with(host, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/')
      THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/'
  END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block'
  WHEN host <> '' AND host IN (
    SELECT host FROM ruled WHERE rule IN ('example.com/en/', 'net/es/', 'net/fr/')) THEN 'block'
  ELSE 'allow' END AS verdict
FROM ruled
"""


LINES = r"""
WITH split AS (
  SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT row_id, doc_id, place, lines[place] AS line,
         translate(trim(lines[place], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM split, unnest(range(1, len(lines) + 1)) AS r(place)),
shared AS (
  SELECT key, max(doc_id) AS top FROM lines WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (doc_id <> top) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (top IS NULL OR doc_id = top), ''))
         AS kept_sha256
FROM lines LEFT JOIN shared USING (key) GROUP BY row_id, doc_id
"""


# CRC-32 in SQL: the register after each byte value, and the steps of a text's bytes.
_CRC_TABLE = """(SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x:
  xor(c >> 1, 3988292384 * (c & 1))) ORDER BY n) FROM range(256) AS r(n))"""


def _crc(text: str, table: str) -> str:
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(
      range(1, strlen({text}) + 1), lambda i: ('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::BIGINT)),
      lambda c, b: xor({table}[xor(c & 255, b) + 1], c >> 8)))"""


# Every feature as a string; its bucket is computed once for each distinct string.
RESAMPLE = rf"""
WITH crc AS (SELECT {_CRC_TABLE} AS steps),
texts AS (
  SELECT 'd' AS side, row_number() OVER () AS row_id, doc_id, text FROM documents
  UNION ALL SELECT 't', row_number() OVER (), NULL, text FROM benchmark),
worded AS (
  SELECT side, row_id, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts),
features AS (
  SELECT side, row_id, array_to_string(list_slice(words, place, place + more), ' ') AS feature
  FROM worded, unnest(range(1, len(words) + 1)) AS p(place), range(3) AS m(more)
  WHERE place + more <= len(words)),
counted AS (
  SELECT feature, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 't') AS t
  FROM features GROUP BY feature),
hashed AS (SELECT feature, s, t, {_crc('feature', 'steps')} % 10000 AS bucket FROM counted, crc),
sums AS (SELECT bucket, sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM hashed GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM sums) + 10000)
                       / ((s + 1) * ((SELECT sum(t) FROM sums) + 10000))))::BIGINT AS gain FROM sums),
weights AS (
  SELECT row_id, sum(gain)::BIGINT AS weight
  FROM features JOIN hashed USING (feature) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY row_id),
scored AS (
  SELECT doc_id, len(words) AS n, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
    (('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
    / 4294967296::DOUBLE)))::BIGINT AS score
  FROM worded LEFT JOIN weights USING (row_id) WHERE side = 'd'),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place,
         count(*) OVER (PARTITION BY n >= 20) AS eligible FROM scored)
SELECT doc_id, (n + greatest(n - 1, 0) + greatest(n - 2, 0))::BIGINT AS n_features, weight, score,
       CASE WHEN n >= 20 AND place <= 5 * eligible // 100 THEN place END AS rank
FROM ranked
"""


# Each prefix is a node; every node adds its part to all prefixes of its own.
TRIE = rf"""
WITH crc AS (SELECT {_CRC_TABLE} AS steps),
turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list(md5(length(role) || ':' || role || text) ORDER BY turn NULLS FIRST,
           md5(length(role) || ':' || role || text)) AS ids,
         list(strlen(text) ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS sizes
  FROM turns GROUP BY conv_id),
heads AS (
  SELECT conv_id, ids, sizes, {_crc('conv_id::VARCHAR', 'steps')} % 9 AS h FROM own, crc),
paths AS (
  SELECT o.conv_id, coalesce(list_slice(b.ids, 1, h), []) || list_slice(o.ids, h + 1, len(o.ids)) AS ids,
         coalesce(list_slice(b.sizes, 1, h), []) || list_slice(o.sizes, h + 1, len(o.ids)) AS sizes
  FROM heads o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5),
prefixes AS (
  SELECT conv_id, d, list_slice(ids, 1, d) AS prefix, d = len(ids) AS ended,
         CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size
  FROM paths, unnest(range(0, len(ids) + 1)) AS r(d)),
nodes AS (
  SELECT prefix, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS own_saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256
  FROM prefixes GROUP BY prefix, d),
kids AS (
  SELECT list_slice(prefix, 1, d - 1) AS prefix, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
counted AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (prefix)),
sums AS (
  SELECT list_slice(prefix, 1, up) AS prefix, sum(own_saved)::BIGINT AS saved_tokens,
         count(*) FILTER (n_children = 0) AS n_leaves
  FROM counted, unnest(range(0, d + 1)) AS r(up) GROUP BY 1)
SELECT c.conv_id, c.d AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves, saved_tokens,
       c.ends_sha256
FROM counted c JOIN sums s ON s.prefix = c.prefix
LEFT JOIN nodes p ON c.d > 0 AND p.prefix = list_slice(c.prefix, 1, c.d - 1)
"""


def _listed(words) -> str:
    return "[" + ", ".join("'" + w + "'" for w in words) + "]"


def _quality() -> str:
    limits = quality.Limits()
    lists = " UNION ALL ".join(
        f"SELECT '{lang}' AS ref, {_listed(ws)} AS ws" for lang, ws in quality.COMMON_WORDS.items())
    return rf"""
WITH texts AS (
  SELECT doc_id, lang, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
classes AS (
  SELECT doc_id, lang, words, lines, len(words) AS n, length(t) AS chars,
         length(regexp_replace(t, '[^\x20\x09-\x0D]+', '', 'g')) AS space,
         length(regexp_replace(t, '[^\p{{Ll}}]+', '', 'g')) AS lower_case,
         length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS upper_case,
         length(regexp_replace(t, '[^0-9]+', '', 'g')) AS digit,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS symbol
  FROM texts),
windows AS (
  SELECT doc_id, i, list_slice(words, i, i + {limits.window - 1}) AS w
  FROM classes, unnest(range(1, n - {limits.window} + 2)) AS r(i)),
covered AS (
  SELECT DISTINCT doc_id, i + k AS at
  FROM (SELECT doc_id, i FROM windows
        QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1), range({limits.window}) AS o(k)),
repeats AS (SELECT doc_id, count(*) AS n_repeat FROM covered GROUP BY doc_id),
shares AS (
  SELECT c.*, coalesce(n_repeat, 0) AS n_repeat,
         [lower_case, upper_case, digit, space, symbol,
          chars - space - lower_case - upper_case - digit - symbol] AS counts
  FROM classes c LEFT JOIN repeats USING (doc_id)),
lists AS ({lists}),
common AS (
  SELECT doc_id, lang, n, ref, list_transform(ws, lambda w: len(list_filter(words, lambda x:
           x = w OR x = upper(w[1]) || w[2:]))) AS hits
  FROM shares, lists),
sums AS (
  SELECT ref, k, sum(hits[k]) / sum(n) AS share
  FROM common, range(1, 11) AS r(k) WHERE lang = ref AND n > 0 GROUP BY ref, k),
word_refs AS (
  SELECT ref, list(share ORDER BY k) || [1 - sum(share)] AS q FROM sums GROUP BY ref),
medians AS (
  SELECT lang AS ref, k, quantile_disc(floor(counts[k] * 1000 / chars + 0.5), 0.5) AS m
  FROM shares, range(1, 7) AS r(k)
  WHERE n > 0 AND lang IN (SELECT ref FROM lists) GROUP BY lang, k),
class_refs AS (SELECT ref, list(m / total ORDER BY k) AS q FROM (
  SELECT *, sum(m) OVER (PARTITION BY ref) AS total FROM medians) GROUP BY ref),
own AS (
  SELECT s.doc_id, w.ref,
         list_transform(c.hits, lambda x: x / s.n) || [(s.n - list_sum(c.hits)) / s.n] AS wp, w.q AS wq,
         list_transform(s.counts, lambda x: x / s.chars) AS cp, k.q AS cq
  FROM shares s JOIN common c USING (doc_id) JOIN word_refs w ON w.ref = c.ref
  JOIN class_refs k ON k.ref = c.ref WHERE s.n > 0),
distances AS (
  SELECT doc_id, ref, sqrt(greatest(list_sum(list_transform(list_zip(wp, wq), lambda z:
      CASE WHEN z[1] > 0 THEN z[1] * log2(z[1] / ((z[1] + z[2]) / 2)) ELSE 0 END
      + CASE WHEN z[2] > 0 THEN z[2] * log2(z[2] / ((z[1] + z[2]) / 2)) ELSE 0 END)) / 2, 0)) AS wd,
    sqrt(greatest(list_sum(list_transform(list_zip(cp, cq), lambda z:
      CASE WHEN z[1] > 0 THEN z[1] * log2(z[1] / ((z[1] + z[2]) / 2)) ELSE 0 END
      + CASE WHEN z[2] > 0 THEN z[2] * log2(z[2] / ((z[1] + z[2]) / 2)) ELSE 0 END)) / 2, 0)) AS cd
  FROM own),
nearest AS (
  SELECT doc_id, min(wd) AS wd, arg_min(cd, (round(wd, 12), ref)) AS cd
  FROM distances GROUP BY doc_id)
SELECT s.doc_id, n::BIGINT AS n_words, (chars - space)::BIGINT AS word_chars,
       symbol::BIGINT AS n_symbols,
       (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
       n_repeat::BIGINT AS n_repeat_words,
       n < {limits.min_words} OR 100 * n_repeat > {limits.repeat_percent} * n AS base_failed,
       NOT (n < {limits.min_words} OR 100 * n_repeat > {limits.repeat_percent} * n
            OR (chars >= {limits.class_min_chars} AND coalesce(cd > {limits.class_distance}, false))
            OR (n >= {limits.word_min_words} AND coalesce(wd > {limits.word_distance}, false))) AS kept
FROM shares s LEFT JOIN nearest USING (doc_id)
"""


QUALITY = _quality()
