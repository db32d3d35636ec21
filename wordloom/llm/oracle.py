"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_SQL = {}

_SQL["op1_line_dedup"] = r"""
WITH split AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
each AS (
  SELECT source, unnest(list_distinct(list_filter(list_transform(lines, lambda x: trim(x)), lambda x: x <> ''))) AS line
  FROM split),
hosts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
counted AS (SELECT source, line, count(*) AS c FROM each GROUP BY source, line HAVING count(*) >= 5),
flagged AS (
  SELECT c.source, list(c.line) AS lines FROM counted c JOIN hosts h ON c.source IS NOT DISTINCT FROM h.source
  WHERE c.c > 0.1 * h.n GROUP BY c.source)
SELECT s.doc_id,
  CASE WHEN f.lines IS NULL OR s.text IS NULL THEN s.text
       ELSE array_to_string(list_filter(s.lines, lambda x: NOT list_contains(f.lines, trim(x))), chr(10)) END AS text,
  coalesce(len(s.lines), 0)::BIGINT AS n_lines,
  CASE WHEN f.lines IS NULL OR s.text IS NULL THEN 0
       ELSE len(list_filter(s.lines, lambda x: list_contains(f.lines, trim(x)))) END::BIGINT AS n_dropped
FROM split s LEFT JOIN flagged f ON s.source IS NOT DISTINCT FROM f.source
"""

_SQL["op2_decontamination"] = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s
        FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, s, n, item_id FROM places JOIN windows USING (n, g)),
words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits)
  GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _op3() -> str:
    from wordloom.llm.quality_rules import RATES, REACH

    rates = ", ".join(
        f"coalesce(({scale} * {of}) // nullif({per}, 0), 0) AS {name}"
        for name, (scale, of, per, _, _) in RATES.items()
    )
    names = ", ".join(RATES)
    spread = " ".join(f"WHEN '{r}' THEN {least}" for r, (_, _, _, least, _) in RATES.items())
    two_sided = ", ".join(f"'{r}'" for r, x in RATES.items() if x[4])
    reason = ", ".join(
        f"CASE WHEN {r} > max(CASE WHEN f.rate = '{r}' THEN high END)"
        f" OR {r} < max(CASE WHEN f.rate = '{r}' THEN low END) THEN '{r}' END"
        for r in RATES
    )
    return rf"""
WITH base AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
triples AS (
  SELECT doc_id, s, w[s:s + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS s FROM base WHERE len(w) >= 3)),
twice AS (SELECT doc_id, g FROM triples GROUP BY doc_id, g HAVING count(*) > 1),
repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest(range(s, s + 3)) AS p FROM triples JOIN twice USING (doc_id, g)) GROUP BY doc_id),
counts AS (
  SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
    (length(t) - length(translate(t, '{UPPER}', '')))::BIGINT AS n_upper, len(l)::BIGINT AS n_lines
  FROM base LEFT JOIN repeated r USING (doc_id)),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {rates} FROM counts),
buckets AS (
  SELECT lang, source, rate, v - v % (1::BIGINT << greatest(length(bin(v)) - 7, 0)::BIGINT) AS bucket
  FROM (UNPIVOT (SELECT lang, source, {names} FROM judged WHERE NOT base_failed)
        ON {names} INTO NAME rate VALUE v)),
sketch AS (SELECT lang, source, rate, bucket, count(*) AS n FROM buckets GROUP BY ALL),
ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, source, rate ORDER BY bucket) AS rank,
    sum(n) OVER (PARTITION BY lang, source, rate) AS total FROM sketch),
quartiles AS (
  SELECT lang, source, rate, min(bucket) FILTER (4 * rank >= total) AS q1,
    min(bucket) FILTER (4 * rank >= 3 * total) AS q3 FROM ranked GROUP BY ALL),
f AS (
  SELECT lang, source, rate, CASE WHEN rate IN ({two_sided}) THEN q1 - reach END AS low, q3 + reach AS high
  FROM (SELECT *, {REACH} * greatest(q3 - q1, CASE rate {spread} END) AS reach FROM quartiles))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND reasons = '' AS kept, reasons
FROM (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    concat_ws(',', {reason}) AS reasons
  FROM judged j LEFT JOIN f ON j.lang IS NOT DISTINCT FROM f.lang AND j.source IS NOT DISTINCT FROM f.source
  GROUP BY doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, {names})
"""


_SQL["op6_chat_formatting"] = r"""
WITH rows AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
escaped AS (
  SELECT *, regexp_replace(replace(text, '\', '\\'), '([<\[])(\||/?s>|/?INST\])', '\1\\\2', 'g') AS body FROM rows),
each AS (
  SELECT *, '<|turn|>' || role || '<|body|>' || body || '</s>' AS written,
    len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS tokens FROM escaped)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, body)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, body) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(written))::BIGINT AS formatted_chars, sum(tokens)::BIGINT AS n_tokens
FROM each GROUP BY conv_id
"""

_SQL["op9_url_filters"] = rf"""
WITH RECURSIVE rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'),
         ('org', '/fr/', 'allow')),
named AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path,
    regexp_extract(url, '^[^#]*', 0, 's') AS bare,
    regexp_extract(url, '^[^/?#]*?://[^/?#]*') AS site,
    regexp_extract(html, '<link\b[^<>]*\brel\s*=\s*["'']?canonical\b[^<>]*>', 0, 'i') AS canonical,
    regexp_extract(html, '<meta\b[^<>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^<>]*>', 0, 'i') AS refresh
  FROM pages),
nodes AS (
  SELECT *, CASE WHEN site <> '' THEN translate(site, '{UPPER}', '{LOWER}') || substr(bare, length(site) + 1) END AS node,
    unnest([nullif(regexp_extract(canonical, '\bhref\s*=\s*["'']?([^"''\s<>]+)', 1, 'i'), ''),
            nullif(regexp_extract(refresh, '\burl\s*=\s*["'']?([^"''\s<>]+)', 1, 'i'), '')]) AS link
  FROM named),
targets AS (
  SELECT node AS u, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
    WHEN starts_with(link, '//') THEN regexp_extract(bare, '^([^/?#]*?:)//', 1) || link
    WHEN starts_with(link, '/') THEN site || link
    ELSE regexp_extract(bare || CASE WHEN bare = site THEN '/' ELSE '' END, '^[^/?#]*?://[^/?#]*(/([^?#]*/)?)?') || link END AS t
  FROM nodes WHERE link IS NOT NULL AND node IS NOT NULL),
edges AS (
  SELECT u, translate(regexp_extract(t, '^[^/?#]*?://[^/?#]*'), '{UPPER}', '{LOWER}')
    || substr(regexp_extract(t, '^[^#]*', 0, 's'), length(regexp_extract(t, '^[^/?#]*?://[^/?#]*')) + 1) AS v
  FROM targets WHERE t IS NOT NULL),
pairs AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
reach(u, v) AS (SELECT u, u FROM pairs UNION SELECT r.u, b.v FROM reach r JOIN pairs b ON r.v = b.u),
judged AS (
  SELECT u, host, path FROM (
    SELECT DISTINCT u, translate(regexp_extract(u, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), '{UPPER}', '{LOWER}') AS host,
      regexp_extract(u, '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path FROM pairs)
  UNION SELECT NULL, host, path FROM named),
fits AS (
  SELECT DISTINCT host, path, rule_host || rule_path AS rule, rule_verdict,
    row_number() OVER (PARTITION BY host, path ORDER BY length(rule_host || rule_path) DESC,
      length(rule_host) DESC, rule_verdict) AS no
  FROM (SELECT DISTINCT host, path FROM judged), rules
  WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
best AS (SELECT * FROM fits WHERE no = 1),
tainted AS (
  SELECT DISTINCT r.u FROM reach r JOIN judged j ON r.v = j.u JOIN best b ON j.host = b.host AND j.path = b.path
  WHERE b.rule_verdict = 'block')
SELECT page_id, host, path, rule,
  coalesce(rule_verdict, CASE WHEN t.u IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
  t.u IS NOT NULL AS blocked_alias
FROM (SELECT DISTINCT page_id, host, path, node FROM nodes) LEFT JOIN best USING (host, path)
LEFT JOIN tainted t ON node = t.u
"""


def _op11(k: int = 16, rounds: int = 3) -> str:
    def nearest(r: int) -> str:
        return f"""
a{r} AS MATERIALIZED (
  SELECT rid, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance
  FROM (SELECT rid, cluster, list_sum(list_transform(list_zip(x.v, c.v),
          lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance FROM kept x, c{r} c)
  GROUP BY rid)"""

    def means(r: int) -> str:
        return f"""
s{r} AS (
  SELECT cluster, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n
  FROM (SELECT cluster, unnest(v) AS x, unnest(range(64)) AS i FROM kept JOIN a{r} USING (rid)) GROUP BY cluster, i),
c{r + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
    SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM s{r} GROUP BY cluster) m
  USING (cluster))"""

    steps = ",".join(nearest(r) + "," + means(r) for r in range(rounds))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS cluster, v
  FROM (SELECT sha256('1:' || vec_id::VARCHAR) AS h, v FROM kept WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {k})),
{steps},{nearest(rounds)},
sums AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM a{rounds} GROUP BY cluster)
SELECT vec_id, a.cluster::INTEGER AS cluster, a.distance::BIGINT AS distance, cluster_inertia,
  (SELECT sum(distance)::BIGINT FROM a{rounds}) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN kept USING (rid) JOIN sums USING (cluster) JOIN c{rounds} c USING (cluster)
"""


_SQL["op12_exact_top_k"] = """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.rid, q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v)::BIGINT AS score
  FROM kept q JOIN kept x ON q.rid <> x.rid WHERE q.vec_id % 20 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id ASC NULLS LAST) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {**_SQL, "op3_quality_rules": _op3(), "op11_centroid_clustering": _op11()}
