"""DuckDB SQL for the queries that SQL can express."""

ORACLES: dict[str, str] = {}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op5_decontamination"] = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), sized AS (SELECT item_id, w, least(13, len(w)) AS n FROM i WHERE len(w) > 0),
patterns AS MATERIALIZED (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS p
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM sized)
), starts AS (
  SELECT r, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS p
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM patterns))
), found AS MATERIALIZED (SELECT r, item_id, s, n FROM starts JOIN patterns USING (n, p)),
hit AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS place FROM found) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

ORACLES["op6_url_filter"] = r"""
WITH a AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), b AS (
  SELECT page_id, regexp_extract(rest, '^([^/?#]*)', 1) AS raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a
), c AS (
  SELECT page_id, path, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM b
), rules(verdict, host, path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fits AS (
  SELECT c.page_id, r.verdict, r.host || r.path AS rule,
    row_number() OVER (PARTITION BY c.page_id ORDER BY length(r.host || r.path) DESC, r.host || r.path) AS n
  FROM c JOIN rules r ON (c.host = r.host OR ends_with(c.host, '.' || r.host)) AND starts_with(c.path, r.path)
)
SELECT c.page_id, c.host, c.path, f.rule, coalesce(f.verdict, CASE WHEN list_has_any(string_split(c.host, '.'),
  ['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN (SELECT * FROM fits WHERE n = 1) f USING (page_id)
"""

ORACLES["op8_substring_dedup"] = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS MATERIALIZED (
  SELECT r, doc_id, s, array_to_string(list_slice(w, s, s + 12), ' ') AS p
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) >= 13)
), firsts AS (SELECT p, min(doc_id) AS first_id FROM windows GROUP BY p),
gone AS MATERIALIZED (
  SELECT DISTINCT r, unnest(range(s, s + 13)) AS place FROM windows JOIN firsts USING (p) WHERE first_id < doc_id
), every AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS words FROM every ANTI JOIN gone USING (r, place) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLES["op13_ranked_search"] = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
i AS MATERIALIZED (SELECT row_number() OVER () AS q, item_id, list_distinct({_TERMS}) AS w FROM benchmark),
sizes AS MATERIALIZED (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_all FROM d WHERE len(w) > 0),
postings AS MATERIALIZED (
  SELECT r, doc_id, len(w)::BIGINT AS n, term, count(*)::BIGINT AS tf
  FROM (SELECT r, doc_id, w, unnest(w) AS term FROM d) GROUP BY ALL
), weights AS MATERIALIZED (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), sizes
), scores AS (
  SELECT q, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_all))))::BIGINT AS score
  FROM (SELECT q, item_id, unnest(w) AS term FROM i) JOIN postings USING (term) JOIN weights USING (term), sizes
  GROUP BY q, item_id, r, doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scores WHERE score > 0
)
SELECT item_id, place::INTEGER AS rank, doc_id, score FROM ranked WHERE place <= 50
"""

ORACLES["op11_run_length_index"] = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), windows AS MATERIALIZED (
  SELECT r, s, md5(substr(h, 2 * s + 1, 400)) AS m FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 199)) AS s FROM d WHERE len(h) >= 400)
), several AS (SELECT m FROM windows GROUP BY m HAVING count(*) > 1),
starts AS (SELECT r, s, lag(s) OVER (PARTITION BY r ORDER BY s) AS before FROM windows SEMI JOIN several USING (m)),
runs AS (
  SELECT r, min(s) AS a, max(s) + 200 AS b
  FROM (SELECT r, s, sum(CASE WHEN before IS NULL OR s > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY s) AS g FROM starts)
  GROUP BY r, g
), edges AS (
  SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS kept_from FROM runs
), parts AS (
  SELECT r, a, substr(h, 2 * kept_from + 1, 2 * (a - kept_from)) AS part FROM edges JOIN d USING (r)
  UNION ALL
  SELECT r, len(h), substr(h, 2 * last + 1) FROM d JOIN (SELECT r, max(b) AS last FROM runs GROUP BY r) USING (r)
), cut AS (SELECT r, string_agg(part, '' ORDER BY a) AS rest FROM parts GROUP BY r),
sums AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed FROM runs GROUP BY r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM d LEFT JOIN sums USING (r) LEFT JOIN cut USING (r)
"""
