"""DuckDB SQL for the queries that SQL can express, written apart from the Spark plans."""

from __future__ import annotations

_SECRETS = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS (
  SELECT doc_id, 0 AS nth, 'assign' AS kind, 6 AS least,
    regexp_extract_all(text, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS hits,
    regexp_extract_all(text, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS parts,
    string_split_regex(text, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS gaps FROM texts
  UNION ALL SELECT doc_id, 1, 'access', 20, regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+'), string_split_regex(text, 'AKIA[A-Z0-9]+') FROM texts
  UNION ALL SELECT doc_id, 2, 'hex', 24, regexp_extract_all(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+'), string_split_regex(text, '[0-9a-f]+') FROM texts
  UNION ALL SELECT doc_id, 3, 'pem', 1, regexp_extract_all(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----'), regexp_extract_all(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----'), string_split_regex(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----') FROM texts
  UNION ALL SELECT doc_id, 4, 'forge', 1, regexp_extract_all(text, 'gh[opusr]_[A-Za-z0-9]{36,}'), regexp_extract_all(text, 'gh[opusr]_[A-Za-z0-9]{36,}'), string_split_regex(text, 'gh[opusr]_[A-Za-z0-9]{36,}') FROM texts
  UNION ALL SELECT doc_id, 5, 'jwt', 1, regexp_extract_all(text, 'eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}'), regexp_extract_all(text, 'eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}'), string_split_regex(text, 'eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}') FROM texts),
each AS (
  SELECT doc_id, nth, kind, least, unnest(hits) AS hit, unnest(parts) AS part, unnest(gaps[1:len(hits)]) AS gap,
    unnest(range(len(hits))) AS i FROM found),
placed AS (
  SELECT doc_id, nth, kind, least, part,
    sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, nth ORDER BY i) AS stop, length(hit) AS n FROM each),
spans AS (SELECT doc_id, nth, kind, (stop - n)::BIGINT AS s, stop::BIGINT AS e FROM placed WHERE length(part) >= least)
SELECT t.doc_id,
  count(*) FILTER (nth = 0) AS n_assign,
  count(*) FILTER (nth = 1) AS n_access,
  count(*) FILTER (nth = 2) AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, nth) FILTER (nth < 3), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, nth), '') AS spans
FROM texts t LEFT JOIN spans USING (doc_id) GROUP BY t.doc_id
"""

_URLS = r"""
WITH RECURSIVE
parts AS (
  SELECT page_id, url, html,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
    coalesce(regexp_extract(url, '^[^?#]*\?([^#]*)', 1, 's'), '') AS query FROM pages),
cleaned AS (
  SELECT *, CASE WHEN host = '' THEN NULL ELSE host || rtrim(path, '/') || CASE WHEN q = '' THEN '' ELSE '?' || q END END AS node
  FROM (SELECT *, array_to_string(list_filter(string_split(query, '&'),
    lambda x: NOT regexp_full_match(x, '(utm_[a-z]+|ref|gclid|fbclid)=.*')), '&') AS q FROM parts)),
rules(rule, decision) AS (VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')),
ruled AS (
  SELECT page_id, url, arg_max(rule, length(rule)) AS rule, arg_max(decision, length(rule)) AS decision
  FROM cleaned, rules
  WHERE (host = string_split(rule, '/')[1] OR ends_with(host, '.' || string_split(rule, '/')[1]))
    AND starts_with(path, substr(rule, instr(rule, '/'))) GROUP BY page_id, url),
declared AS (
  SELECT url, node, unnest([
    regexp_extract(regexp_extract(html, '<link\s[^>]*?rel\s*=\s*["'']?canonical["'']?[^>]*>', 0, 'i'), 'href\s*=\s*["'']?([^"''\s>]+)', 1, 'i'),
    regexp_extract(regexp_extract(html, '<meta\s[^>]*?http-equiv\s*=\s*["'']?refresh["'']?[^>]*>', 0, 'i'), 'url\s*=\s*["'']?([^"''\s>]+)', 1, 'i')]) AS t
  FROM cleaned),
targets AS (
  SELECT node, CASE WHEN contains(t, '://') THEN t
    WHEN starts_with(t, '//') THEN regexp_extract(url, '^(.*?:)//', 1) || t
    WHEN starts_with(t, '/') THEN regexp_extract(url, '^(.*?://[^/?#]*)', 1) || t END AS t FROM declared WHERE t <> ''),
split AS (
  SELECT node,
    translate(coalesce(regexp_extract(t, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(t, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
    array_to_string(list_filter(string_split(coalesce(regexp_extract(t, '^[^?#]*\?([^#]*)', 1, 's'), ''), '&'),
      lambda x: NOT regexp_full_match(x, '(utm_[a-z]+|ref|gclid|fbclid)=.*')), '&') AS q FROM targets WHERE t IS NOT NULL),
edges AS (
  SELECT node AS a, host || rtrim(path, '/') || CASE WHEN q = '' THEN '' ELSE '?' || q END AS b FROM split WHERE host <> '' AND node IS NOT NULL),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(a, b) AS (
  SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
roots AS (SELECT a AS node, least(a, min(b)) AS root FROM reach GROUP BY a),
classes AS (SELECT c.*, coalesce(root, node) AS class FROM cleaned c LEFT JOIN roots USING (node)),
told AS (
  SELECT class, min(decision) AS inherited FROM classes JOIN ruled USING (page_id, url) WHERE class IS NOT NULL GROUP BY class)
SELECT c.page_id, c.host, c.path, r.rule, coalesce(r.decision, t.inherited, 'allow') AS verdict
FROM classes c LEFT JOIN ruled r USING (page_id, url) LEFT JOIN told t USING (class)
"""

_CHATS = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(text) + length(text) - length(replace(text, chr(27), ''))
    + 2 * len(regexp_extract_all(text, '\[/?(SYS|INST|ROLE)\]|</?s>'))
    + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7
      ELSE 16 + length(role) + length(role) - length(replace(role, chr(27), ''))
        + 2 * len(regexp_extract_all(role, '\[/?(SYS|INST|ROLE)\]|</?s>')) + length(role) - length(replace(role, chr(10), '')) END AS size
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars,
  CASE WHEN regexp_full_match(r, 's') THEN 'told' WHEN regexp_full_match(r, 's?(ua)*u') THEN 'asked'
    WHEN regexp_full_match(r, 's?(ua)+') THEN 'answered' ELSE 'wrong' END AS state, state = 'answered' AS valid
FROM sized JOIN (
  SELECT conv_id AS c, string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END,
    '' ORDER BY turn, role, text) AS r FROM turns GROUP BY conv_id) ON c IS NOT DISTINCT FROM conv_id
GROUP BY conv_id, r
"""

_CONTAMINATION = r"""
WITH item_words AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS phrase
  FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM item_words WHERE len(w) > 0)),
doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM windows),
hits AS (
  SELECT doc_id, item, i, d.n FROM (
    SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS phrase
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, sizes WHERE len(w) >= n)) d
  JOIN windows v ON v.phrase = d.phrase AND v.n = d.n),
covered AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_COLLOCATIONS = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS pid, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
    FROM documents)),
places AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, range(1, 6) sizes(k) WHERE len(w) >= k),
counts AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM places GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
frequent AS (SELECT * FROM counts WHERE f >= 100),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM frequent WHERE k > 1),
cuts AS (SELECT *, unnest(range(1, k)) AS j FROM candidates),
scored AS (
  SELECT c.lang, c.k, c.phrase, a, n, j, l.f AS l, r.f AS r, ((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts c JOIN totals t ON t.lang = c.lang
  JOIN frequent l ON l.lang = c.lang AND l.phrase = array_to_string(w[:j], ' ')
  JOIN frequent r ON r.lang = c.lang AND r.phrase = array_to_string(w[j + 1:], ' ')),
best AS (SELECT lang, k, phrase, a, n, m.l, m.r, m.score FROM (
  SELECT lang, k, phrase, a, n, arg_min({'l': l, 'r': r, 'score': score}, (score, j)) AS m FROM scored GROUP BY ALL)),
kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM candidates t WHERE t.lang = b.lang AND t.k > b.k AND 100 * t.a >= 100 * b.a
      AND contains(' ' || t.phrase || ' ', ' ' || b.phrase || ' '))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""

ORACLE_SQL = {
    "op1_secrets": _SECRETS,
    "op4_url_filters": _URLS,
    "op6_chat_formatting": _CHATS,
    "op10_decontamination": _CONTAMINATION,
    "op11_collocations": _COLLOCATIONS,
}
