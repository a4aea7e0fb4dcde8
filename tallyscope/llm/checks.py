"""DuckDB SQL for the queries that SQL can express, written apart from the Spark plans."""

from __future__ import annotations

from tallyscope.llm.license_scan import RULES, SENTENCES
from tallyscope.llm.quality_rules import STOP_WORDS, base_failed_sql, verdict_sql


def quality_ctes(source: str = "documents") -> str:
    """CTEs up to `judged`: a row of `source` by `rid`, its counts, base_failed and kept."""
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""
rows_ AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM {source}),
split_ AS (
  SELECT rid, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM rows_),
grams_ AS (
  SELECT rid, unnest(range(1, greatest(len(ws) - 3, 1))) AS p, ws FROM split_),
keyed_ AS (SELECT rid, p, array_to_string(ws[p : p + 4], ' ') AS g FROM grams_),
again_ AS (
  SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS k FROM keyed_) WHERE k > 1),
covered_ AS (
  SELECT rid, count(DISTINCT p + o) AS n_repeat_words
  FROM again_, (SELECT unnest(range(0, 5)) AS o) GROUP BY rid),
counted_ AS (
  SELECT rid, doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(length(regexp_replace(text, '[^!]+', '', 'g')) AS BIGINT) AS n_bangs,
         CAST(len(list_filter(ws, lambda w: w IN ({stops}))) AS BIGINT) AS n_stop,
         CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(len(list_filter(ls, lambda x: regexp_matches(x, '^[\\x20\\x09-\\x0D]*[-*•][\\x20\\x09-\\x0D]'))) AS BIGINT) AS n_bullets,
         CAST(len(list_filter(ls, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$'))) AS BIGINT) AS n_cut_lines
  FROM split_),
based_ AS (
  SELECT counted_.*, coalesce(n_repeat_words, 0) AS n_repeat_words FROM counted_ LEFT JOIN covered_ USING (rid)),
judged AS (
  SELECT *, {base_failed_sql()} AS base_failed, NOT {base_failed_sql()} AND {verdict_sql()} AS kept FROM based_)
"""


def quality_rules() -> str:
    return f"""WITH {quality_ctes()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"""


def license_scan() -> str:
    cases = " ".join(f"WHEN regexp_matches(',' || sentence_ids || ',', '{rule}') THEN '{name}'" for name, rule in RULES)
    keys = ", ".join(f"'{k}'" for k in SENTENCES)
    values = ", ".join(f"'{v}'" for v in SENTENCES.values())
    return f"""
WITH parts AS (
  SELECT doc_id, row_number() OVER () AS rid,
         list_transform(regexp_split_to_array(lower(coalesce(text, '')), '\\n|[.;:!?][\\x20\\x09-\\x0D]'),
                        lambda s: trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'))) AS ss
  FROM documents),
known AS (SELECT unnest([{keys}]) AS k, unnest([{values}]) AS v),
hits AS (
  SELECT rid, count(v) AS n, string_agg(v, ',' ORDER BY p) AS ids
  FROM (SELECT rid, unnest(ss) AS s, generate_subscripts(ss, 1) AS p FROM parts) JOIN known ON s = k GROUP BY rid),
found AS (
  SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_sentences, coalesce(ids, '') AS sentence_ids
  FROM parts LEFT JOIN hits USING (rid))
SELECT doc_id, n_sentences, sentence_ids, CASE {cases} END AS license FROM found"""


def lexical_search() -> str:
    terms = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (
  SELECT r, doc_id, ts, len(ts) AS n FROM (
    SELECT row_number() OVER () AS r, doc_id, {terms.format("text")} AS ts FROM documents WHERE text IS NOT NULL)
  WHERE len(ts) > 0),
b AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM d),
i AS (SELECT q, item_id, t, count(*) AS times FROM (
  SELECT row_number() OVER () AS q, item_id, unnest({terms.format("text")}) AS t FROM benchmark) GROUP BY ALL),
tf AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(ts) AS t FROM d)
       WHERE t IN (SELECT t FROM i) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
      FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), b),
s AS (SELECT q, item_id, r, doc_id,
        CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
      FROM tf JOIN i USING (t) JOIN w USING (t), b GROUP BY ALL),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10"""


def conversation_trie() -> str:
    key = "sha256(length(role) || ':' || role || text)"
    return f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0],
           lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab),
t AS (
  SELECT conv_id, {key} AS k, strlen(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {key}) AS p
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS head, xor(list_reduce(
           list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
           lambda a, b: xor(a // 256, tab[xor(a, b) % 256 + 1])), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t), crc),
heads AS (SELECT c.conv_id, c.h, count(t.p) AS n FROM c LEFT JOIN t ON t.conv_id = c.head AND t.p <= c.h GROUP BY ALL),
r AS (
  SELECT c.conv_id, t.p AS q, k, size FROM c JOIN t ON t.conv_id = c.head AND t.p <= c.h
  UNION ALL
  SELECT t.conv_id, n + p - h, k, size FROM heads JOIN t USING (conv_id) WHERE p > h),
paths AS (
  SELECT conv_id, q AS d, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY q) AS k, size FROM r
  UNION ALL SELECT conv_id, 0, '', 0 FROM c),
n AS (
  SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS own, left(k, 64 * (d - 1)) AS up
  FROM paths GROUP BY k, d),
kids AS (SELECT up AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY up),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (k)),
s AS (SELECT left(k, 64 * e) AS k, sum(own) AS saved_tokens, count_if(n_children = 0) AS n_leaves
      FROM (SELECT k, own, n_children, unnest(range(0, d + 1)) AS e FROM f) GROUP BY 1),
e AS (SELECT k, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS hash FROM (
        SELECT conv_id, arg_max(k, d) AS k FROM paths GROUP BY conv_id) GROUP BY k)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(hash, sha256('')) AS ends_sha256
FROM f JOIN s USING (k) LEFT JOIN e USING (k) LEFT JOIN n p ON f.d > 0 AND p.k = f.up"""
