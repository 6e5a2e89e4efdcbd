"""SQL (DuckDB) that must give the rows of the queries."""

from __future__ import annotations

from collections.abc import Mapping

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = f"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT doc_id, len(lines) AS n_lines, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM parts),
keyed AS (SELECT *, {_LOWER.format(f"trim(line, {_BLANKS})")} AS k FROM lines),
shared AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT keyed.*, shared.k IS NULL OR keeper = doc_id AS stays FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, any_value(n_lines)::BIGINT AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def similar(words: int, percent: int) -> str:
    return f"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(list_transform(
    range(1, greatest(len(w) - {words - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {words - 1}], ' '))) AS s
  FROM split WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * k >= {percent} * (x.n + y.n - k)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT a AS doc_id, a AS other FROM edges UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON edges.a = reach.other),
roots AS (SELECT doc_id, min(other) AS component FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN roots USING (doc_id)
"""


CHAT = r"""
WITH own AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok'
  FROM range(2) r(t))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>' || role || '<|im_sep|>' || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|im_end|>' || chr(10)))::BIGINT
    AS formatted_chars
FROM own GROUP BY conv_id
"""

ARCHIVE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
o AS (SELECT payload, max(page_id) AS owner FROM p GROUP BY payload),
m AS (SELECT p.*, owner, strlen(payload) >= 1000 AND owner <> page_id AS again FROM p JOIN o USING (payload))
SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN owner END AS refers_to FROM m
"""


def mixed(shares: Mapping[str, int], rest: int, block_rows: int, seed: int) -> str:
    counts = [*shares.values(), rest]
    slots, lanes = sum(counts), f"[{', '.join(map(str, counts))}]"
    names = ", ".join(f"('{name}', {i + 1})" for i, name in enumerate(shares))
    due = f"""list_min(list_transform(range(1, {len(counts)} + 1), lambda i: CASE
        WHEN done[i] < {lanes}[i] AND done[i] * {slots} // {lanes}[i] <= t
        THEN ((done[i] + 1) * {slots} + {lanes}[i] - 1) // {lanes}[i] ELSE {slots} + 1 END * 1000 + i)) % 1000"""
    return f"""
WITH RECURSIVE sim AS (
  SELECT 0 AS t, list_transform({lanes}, lambda x: 0) AS done, 0 AS lane
  UNION ALL
  SELECT t + 1, list_transform(range(1, {len(counts)} + 1), lambda i: done[i] + CASE WHEN i = pick THEN 1 ELSE 0 END), pick
  FROM (SELECT *, {due} AS pick FROM sim WHERE t < {slots})),
plan AS (
  SELECT lane, t - 1 AS slot, row_number() OVER (PARTITION BY lane ORDER BY t) - 1 AS occurrence, {lanes}[lane] AS share
  FROM sim WHERE lane > 0),
lanes(source, lane) AS (VALUES {names}),
ranked AS (
  SELECT doc_id, d.source, coalesce(lane, {len(counts)}) AS lane, row_number() OVER (
    PARTITION BY coalesce(lane, {len(counts)}) ORDER BY md5('{seed}:' || doc_id), doc_id) - 1 AS r
  FROM documents d LEFT JOIN lanes l ON l.source = d.source),
totals AS (SELECT p.lane, any_value(share) AS share, coalesce(any_value(n), 0) // {block_rows} AS whole
  FROM plan p LEFT JOIN (SELECT lane, count(*) AS n FROM ranked GROUP BY lane) USING (lane) GROUP BY p.lane),
horizon AS (SELECT min(whole // t.share * {slots} + slot) AS h FROM totals t JOIN plan p ON p.lane = t.lane AND p.occurrence = whole % t.share)
SELECT doc_id, source, r // {block_rows} AS block, r // {block_rows} // share * {slots} + slot AS slot,
  (r // {block_rows} // share * {slots} + slot) * {block_rows} + r % {block_rows} AS position,
  r // {block_rows} // share * {slots} + slot < h AS in_mix
FROM ranked JOIN plan ON plan.lane = ranked.lane AND occurrence = r // {block_rows} % share, horizon
"""


_TERMS = f"""regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"""

LEXICAL = f"""
WITH split AS (SELECT row_number() OVER () AS d, doc_id, {_TERMS} AS w FROM documents),
docs AS (SELECT d, doc_id, w, len(w) AS n FROM split WHERE len(w) > 0),
totals AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM docs),
asked AS (SELECT item_id, t, count(*) AS q FROM (
  SELECT item_id, unnest({_TERMS}) AS t FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
postings AS (
  SELECT d, t, count(*) AS tf FROM (SELECT d, unnest(w) AS t FROM docs) WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
weights AS (SELECT t, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (
  SELECT t, count(*) AS df FROM postings GROUP BY t), totals),
worth AS (
  SELECT d, t, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)) AS v
  FROM postings JOIN docs USING (d), totals),
scored AS (SELECT item_id, d, sum(q * w * v)::BIGINT AS score FROM asked JOIN weights USING (t) JOIN worth USING (t) GROUP BY ALL),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM scored JOIN docs USING (d) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

#: One row of damage after the other; of the edits up to it, the least (cost, audit) for each last initial is kept.
_CRC_BYTE = """list_reduce(list_concat([xor(acc, b)], [0, 0, 0, 0, 0, 0, 0, 0]),
  lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"""
_FAULT = f"""xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(key, ''), lambda x: ord(x)::BIGINT)),
  lambda acc, b: (({_CRC_BYTE}))), 4294967295) % 20"""

REPAIR = f"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
hit AS (SELECT *, {_FAULT} AS fault FROM raw),
damaged AS (
  SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE fault WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hit WHERE fault <> 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
    lag(role[1]) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) || role[1] AS pair,
    trim(text, {_BLANKS}) AS seen FROM damaged),
rows AS (
  SELECT *, CASE WHEN seen = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN seen[-1] NOT IN ('.', '!', '?') THEN 'truncated' END AS fault
  FROM numbered),
edits(last, letters, after, name, price) AS (VALUES
  ('', '', '', '', 0), ('s', '', 's', '', 0), ('u', '', 'u', '', 0), ('a', '', 'a', '', 0),
  ('', 'I', 'u', 'user:', 5), ('s', 'I', 'u', 'user:', 5), ('u', 'I', 'a', 'assistant:', 5), ('a', 'I', 'u', 'user:', 5),
  ('', 'II', 'a', 'user:' || chr(10) || 'assistant:', 10), ('s', 'II', 'a', 'user:' || chr(10) || 'assistant:', 10)),
turns(last, letter, after, name) AS (VALUES
  ('', 'K', 's', NULL), ('', 'K', 'u', NULL), ('s', 'K', 'u', NULL), ('a', 'K', 'u', NULL), ('u', 'K', 'a', NULL),
  ('', 'R', 'u', 'user'), ('s', 'R', 'u', 'user'), ('a', 'R', 'u', 'user'), ('u', 'R', 'a', 'assistant'),
  ('', 'D', '', NULL), ('s', 'D', 's', NULL), ('u', 'D', 'u', NULL), ('a', 'D', 'a', NULL)),
best AS (
  SELECT conv_id, 0::BIGINT AS i, '' AS last, 0 AS cost, '' AS audit, []::VARCHAR[] AS kept FROM (SELECT DISTINCT conv_id FROM damaged)
  UNION ALL
  SELECT conv_id, i, last, cost, audit, kept FROM (
    SELECT b.conv_id, b.i + 1 AS i, t.after AS last, cost + price + CASE letter WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END
        + CASE WHEN letter <> 'D' AND fault = 'truncated' THEN 5 ELSE 0 END AS cost,
      audit || letters || letter AS audit,
      list_concat(list_concat(kept, CASE WHEN e.name = '' THEN [] ELSE [e.name] END),
        CASE letter WHEN 'D' THEN [] ELSE [coalesce(t.name, r.role) || ':' || r.text] END) AS kept,
      row_number() OVER (PARTITION BY b.conv_id, t.after ORDER BY cost + price + CASE letter WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END
        + CASE WHEN letter <> 'D' AND fault = 'truncated' THEN 5 ELSE 0 END, audit || letters || letter) AS place
    FROM best b JOIN rows r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i + 1
    JOIN edits e ON e.last = b.last JOIN turns t ON t.last = e.after
    WHERE (letter = 'D' OR fault IS NULL OR fault = 'truncated') AND (letter <> 'K' OR t.after = r.role[1])) WHERE place = 1),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id),
ends AS (
  SELECT c.*, cost + price AS cost, audit || letters AS audit, list_concat(kept, CASE WHEN e.name = '' THEN [] ELSE [e.name] END) AS kept,
    row_number() OVER (PARTITION BY c.conv_id ORDER BY cost + price, audit || letters) AS place
  FROM counts c JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.i = c.n
  JOIN edits e ON e.last = b.last AND e.after IN ('', 'a'))
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
  sha256(coalesce(array_to_string(kept, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN (SELECT * FROM ends WHERE place = 1) f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
"""
