"""DuckDB statements that give the rows of the queries that SQL can express."""

from __future__ import annotations

from itertools import permutations

from wattline.llm.licenses import COPYRIGHT, EQUAL, shipped


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _canonical(column: str) -> str:
    out = f"regexp_replace(lower(coalesce({column}, '')), {_text(COPYRIGHT)}, '\\1', 'g')"
    out = f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')"
    for a, b in EQUAL:
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim({out})"


_KNOWN = ", ".join(f"('{k}', {_text(t)})" for k, t in shipped())

LICENSE_SCAN = f"""
WITH given(license_id, body) AS (VALUES {_KNOWN}),
known AS (SELECT sha256({_canonical('body')}) AS digest, min(license_id) AS license_id FROM given GROUP BY 1),
whole AS (SELECT doc_id, sha256({_canonical('text')}) AS text_digest FROM documents),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
hits AS (
  SELECT doc_id, count(*) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids
  FROM (SELECT doc_id, sha256({_canonical('line')}) AS digest FROM lines) JOIN known USING (digest) GROUP BY 1)
SELECT w.doc_id, w.text_digest, k.license_id, coalesce(h.n, 0) AS n_license_lines, coalesce(h.ids, '') AS line_license_ids
FROM whole w LEFT JOIN known k ON w.text_digest = k.digest LEFT JOIN hits h ON w.doc_id = h.doc_id"""

NEAREST = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5"""

_RENDER = "'<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)"


def _written(turns: str) -> str:
    return f"coalesce(array_to_string(list_transform({turns}, lambda t: {_RENDER}), ''), '')"


def _spans(turns: str) -> str:
    sizes = f"list_transform({turns}, lambda t: length({_RENDER}))"
    at = f"CAST(coalesce(list_sum({sizes}[1:i - 1]), 0) + 13 + length({turns}[i].role) AS BIGINT)"
    end = f"CAST(list_sum({sizes}[1:i]) AS BIGINT)"
    replies = f"list_filter(range(1, len({turns}) + 1), lambda i: {turns}[i].role = 'assistant')"
    return f"coalesce(array_to_string(list_transform({replies}, lambda i: {at} || '-' || {end}), ','), '')"


PREFERENCE = f"""
WITH turns_ AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
conv AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn, role, text) AS turns FROM turns_ GROUP BY 1),
placed AS (
  SELECT *, row_number() OVER (ORDER BY conv_id) - 1 AS place, count(*) OVER () AS n,
    list_max(list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant')) AS last FROM conv),
paired AS (
  SELECT a.conv_id, b.conv_id AS partner_id, a.turns AS c, a.last,
    {{'role': 'assistant', 'text': CASE WHEN b.last IS NULL THEN '' ELSE b.turns[b.last].text END}} AS given
  FROM placed a JOIN placed b ON b.place = CASE WHEN xor(a.place, 1) < a.n THEN xor(a.place, 1) ELSE a.place - 1 END),
sides AS (
  SELECT *, CASE WHEN last IS NULL THEN list_append(c, given)
    ELSE list_concat(list_append(c[1:last - 1], given), c[last + 1:]) END AS r FROM paired),
cut AS (
  SELECT *, coalesce(list_min(list_filter(range(1, least(len(c), len(r)) + 1), lambda i: c[i] <> r[i])) - 1, least(len(c), len(r))) AS same FROM sides),
rest AS (SELECT *, c[same + 1:] AS cc, r[same + 1:] AS rr FROM cut)
SELECT conv_id, partner_id, CAST(same AS INTEGER) AS n_prompt_turns, {_written('c[1:same]')} AS prompt, {_written('cc')} AS chosen,
  {_written('rr')} AS rejected, {_spans('cc')} AS chosen_spans, {_spans('rr')} AS rejected_spans FROM rest"""

_ORDERS = ", ".join(f"('{''.join(p)}')" for p in permutations("ABCDE"))

FILTER_AUDIT = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
f AS (
  SELECT part, CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS failed,
    doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good,
    doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic FROM w),
counts AS (SELECT part, failed, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY 1, 2),
orders(filter_order) AS (VALUES {_ORDERS}),
steps AS (
  SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS bit,
    coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0)::INTEGER AS earlier
  FROM orders, (SELECT unnest(range(1, 6)) AS step)),
told AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN (failed & (earlier | bit)) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN (failed & bit) <> 0 AND (failed & earlier) = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN (failed & bit) <> 0 AND (failed & earlier) <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failed = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN (failed & bit) <> 0 AND (failed & earlier) = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN (failed & bit) <> 0 AND (failed & earlier) = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counts, steps GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM told"""

_TERMS = """regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"""

RANKED_SEARCH = f"""
WITH t AS (SELECT row_number() OVER () AS place, doc_id, {_TERMS.format('text')} AS terms FROM documents),
sizes AS (SELECT place, doc_id, len(terms) AS n FROM t WHERE len(terms) > 0),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
tf AS (SELECT place, term, count(*) AS tf FROM (SELECT place, unnest(terms) AS term FROM t) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
asked AS (SELECT row_number() OVER () AS item, item_id, {_TERMS.format('text')} AS terms FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT item, item_id, term, count(*) AS k FROM (SELECT item, item_id, unnest(terms) AS term FROM asked) GROUP BY ALL),
weighted AS (
  SELECT item, item_id, term, k * CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM q JOIN df USING (term), totals),
scored AS (
  SELECT item, item_id, doc_id, place,
    CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // totals.terms)))) AS BIGINT) AS score
  FROM weighted JOIN tf USING (term) JOIN sizes USING (place), totals GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20"""
