"""SQL counterparts of the registered queries, where SQL can say the same over whole tables."""

from __future__ import annotations

STATEMENTS: dict[str, str] = {}

STATEMENTS["op8_url_rules"] = r"""
WITH rules(rule_host, rule_path, verdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rest AS (SELECT page_id, row_number() OVER () AS n,
  CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, n,
  translate(regexp_extract(r, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM rest),
fits AS (SELECT p.n, max_by(rule_host || rule_path, length(rule_host) * 1000 + length(rule_path)) AS rule,
  max_by(verdict, length(rule_host) * 1000 + length(rule_path)) AS verdict
  FROM parts p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY p.n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (n)
"""

STATEMENTS["op9_perspectives"] = r"""
WITH told AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS said FROM conversations),
parts AS (SELECT DISTINCT conv_id AS c, speaker AS participant FROM told WHERE speaker <> 'system'),
seen AS (SELECT conv_id, participant, turn, speaker, said,
  CASE WHEN speaker = participant THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS role,
  CASE WHEN speaker <> participant AND speaker <> 'system' THEN speaker END AS name
  FROM told JOIN parts ON conv_id IS NOT DISTINCT FROM c),
built AS (SELECT *, '<|im_start|>' || role
    || coalesce(' name=' || regexp_replace(replace(name, '<|', '< |'), '[\r\n]', ' ', 'g'), '') || chr(10) AS header,
  replace(said, '<|', '< |') || '<|im_end|>' || chr(10) AS body FROM seen),
placed AS (SELECT *, header || body AS segment, length(header || body) AS n_chars,
  row_number() OVER w - 1 AS position,
  coalesce(sum(length(header || body)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM built WINDOW w AS (PARTITION BY conv_id, participant ORDER BY turn NULLS FIRST, speaker, said))
SELECT conv_id, participant, turn, position, role, name, segment, start, n_chars::BIGINT AS n_chars,
  CASE WHEN role = 'assistant' THEN start + length(header) END AS loss_start,
  CASE WHEN role = 'assistant' THEN (n_chars - length(header) - 1)::BIGINT END AS loss_chars
FROM placed
"""

STATEMENTS["op7_decontamination"] = r"""
WITH doc AS (SELECT doc_id, [w FOR w IN regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+') IF w <> ''] AS w FROM documents),
item AS (SELECT item_id, [w FOR w IN regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+') IF w <> ''] AS w FROM benchmark),
d AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, greatest(len(w) - 3, 2))]) AS s
  FROM doc WHERE len(w) > 0),
i AS (SELECT DISTINCT item_id, unnest([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, greatest(len(w) - 3, 2))]) AS s
  FROM item WHERE len(w) > 0),
total AS (SELECT item_id, count(*) AS total FROM i GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS shared, any_value(total) AS total
FROM d JOIN i USING (s) JOIN total USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(total) - 1e-9
"""

# The steps of CRC-32 over the digits of an id: a byte goes in, then eight shifts.
STATEMENTS["op13_prefix_trie"] = r"""
WITH placed AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations),
convs AS (SELECT conv_id, count(*) AS own, conv_id - conv_id % 5 AS base, xor(list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
      lambda d: [ascii(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END),
  4294967295) % 9 AS h FROM placed GROUP BY conv_id),
known AS (SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.own, 0)) AS taken FROM convs c LEFT JOIN convs b ON c.base = b.conv_id),
rebuilt AS (
  SELECT conv_id, place - h + taken AS place, role, text FROM placed JOIN known USING (conv_id) WHERE place > h
  UNION ALL
  SELECT k.conv_id, p.place, p.role, p.text FROM known k JOIN placed p ON p.conv_id = k.base AND p.place <= k.taken),
paths AS (
  SELECT conv_id, place AS depth, strlen(text) AS bytes,
    sha256(string_agg(sha256(length(role) || ':' || role || text), ',') OVER (PARTITION BY conv_id ORDER BY place)) AS node,
    sha256(string_agg(sha256(length(role) || ':' || role || text), ',') OVER (PARTITION BY conv_id ORDER BY place
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS up,
    place = max(place) OVER (PARTITION BY conv_id) AS ends
  FROM rebuilt
  UNION ALL
  SELECT conv_id, 0, 0, '', NULL, conv_id NOT IN (SELECT conv_id FROM rebuilt) FROM convs),
members AS (SELECT node, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(bytes) AS bytes, count(*) AS n_convs,
  any_value(CASE WHEN depth = 1 THEN '' ELSE up END) AS up,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM paths GROUP BY node),
kids AS (SELECT up AS node, count(*) AS n_children FROM members WHERE depth > 0 GROUP BY up),
nodes AS (SELECT m.*, coalesce(n_children, 0) AS n_children FROM members m LEFT JOIN kids USING (node)),
sums AS (SELECT p.node, sum((y.n_children = 0)::INT)::BIGINT AS n_leaves, sum((y.n_convs - 1) * y.bytes)::BIGINT AS saved_tokens
  FROM nodes y JOIN paths p ON p.conv_id = y.conv_id AND p.depth <= y.depth GROUP BY p.node)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
FROM nodes n JOIN sums USING (node) LEFT JOIN nodes u ON n.depth > 0 AND u.node = n.up
"""
