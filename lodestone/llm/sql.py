"""DuckDB SQL for the queries of this folder that SQL can express."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP7 = rf"""
WITH cut AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
lines AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM cut) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
windows AS (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM cut)),
twice AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, a, b, c) > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
counted AS (
  SELECT doc_id, source, len(w) AS n_words, length(text) - length(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM cut LEFT JOIN lines USING (rid) LEFT JOIN covered USING (rid)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted),
failed AS (SELECT source, unnest([n_words < 50, 100 * n_repeat_words > 50 * n_words, 100 * n_symbols > 20 * n_words]) AS bad, unnest([1, 2, 3]) AS rule FROM judged),
hosts AS (SELECT source, rule, count(*) AS n, count(*) FILTER (bad) AS f FROM failed GROUP BY source, rule),
prior AS (SELECT rule, m, CASE WHEN v > 1e-12 AND m * (1 - m) > v THEN m * (1 - m) / v - 1 ELSE 10.0 END AS k FROM (SELECT rule, avg(f / n) AS m, var_pop(f / n) AS v FROM hosts GROUP BY rule)),
verdict AS (SELECT source, max((f + m * k) / (n + k)) > 0.8 AS rejected FROM hosts JOIN prior USING (rule) GROUP BY source)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM judged JOIN verdict ON judged.source IS NOT DISTINCT FROM verdict.source
"""

OP9 = rf"""
WITH d AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents)),
b AS (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark)),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM d),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM b),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM shared JOIN n USING (item_id) WHERE n_shared >= 0.75 * n_item
"""


def _draw(salt: str) -> str:
    return f"('0x' || substr(md5('17:{salt}:' || coalesce(doc_id::VARCHAR, '') || ':' || digest || ':' || copy), 1, 8))::BIGINT::DOUBLE / 4294967296.0"


OP10 = rf"""
WITH sized AS (SELECT doc_id, source, len({WORDS}) AS size, md5(coalesce(text, '')) AS digest, row_number() OVER (PARTITION BY doc_id, md5(coalesce(text, ''))) AS copy FROM documents),
per AS (SELECT source, sum(size) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
  row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM per),
levels AS (SELECT *, source_size * 2.0::DOUBLE AS cap,
  (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2.0::DOUBLE)
    / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked WINDOW o AS (ORDER BY source_size * 2.0::DOUBLE / weight, rank)),
found AS (SELECT *, (SELECT arg_min(level, struct_pack(a := cap / weight, b := rank)) FROM levels WHERE level * weight <= cap) AS water FROM levels),
targets AS (SELECT source, source_size, coalesce(least(cap, water * weight), cap) AS target FROM found)
SELECT doc_id, size::BIGINT AS size, t.source_size::BIGINT AS source_size, target,
  least(floor(CASE WHEN t.source_size > 0 THEN target / t.source_size ELSE 0 END * size + {_draw('round')}), floor(size * 2.0))::BIGINT AS taken
FROM sized JOIN targets t ON sized.source IS NOT DISTINCT FROM t.source
"""

TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {TERMS} AS w FROM documents WHERE text IS NOT NULL),
sizes AS (SELECT rid, doc_id, len(w) AS n FROM d WHERE len(w) > 0),
whole AS (SELECT count(*) AS nd, sum(n)::BIGINT AS l FROM sizes),
asked AS (SELECT DISTINCT item_id, unnest({TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL),
tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY rid, term),
weights AS (SELECT term, floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY term, nd),
scored AS (
  SELECT item_id, doc_id, rid, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // l))))::BIGINT AS score
  FROM tf JOIN weights USING (term) JOIN asked USING (term) JOIN sizes USING (rid), whole WHERE doc_id IS NOT NULL GROUP BY item_id, doc_id, rid)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY rank <= 50
"""

OP13 = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, v, sqrt(list_inner_product(v, v)) AS norm FROM (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_inner_product(a.v, b.v) / (a.norm * b.norm) >= 0.93),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a), least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, least.b) AS component_id, least(vec_id, least.b) = vec_id AS kept
FROM embeddings LEFT JOIN n ON vec_id = n.a LEFT JOIN least ON vec_id = least.a
"""

ORACLES = {"op7_quality_rules": OP7, "op9_decontamination": OP9, "op10_mixing": OP10, "op12_ranked_search": OP12, "op13_embedding_near_dedup": OP13}


def _code(x: str) -> str:
    return f"('0x' || substr(md5({x}), 1, 4))::INTEGER"


_HOST = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', '')"
_PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1)"
OP2 = rf"""
WITH p AS (SELECT page_id, url, DATE '2024-01-01' + {_code('url')} % 365 AS fetched_at, {_HOST} AS h, {_PATH} AS path FROM pages),
e AS (
  SELECT h AS pattern, 'block' AS verdict, action, DATE '2024-01-01' + ({_code('h')} % 150 + after)::INTEGER AS since
  FROM (SELECT DISTINCT h FROM p WHERE h <> '' AND {_code('h')} % 3 = 0), (VALUES ('add', 0), ('remove', 90), ('add', 200)) v(action, after)
  UNION ALL
  SELECT DISTINCT h || regexp_extract(path, '^(/[^/]+)', 1), 'allow', 'add', DATE '2024-01-01' FROM p
  WHERE h <> '' AND regexp_extract(path, '^(/[^/]+)', 1) <> '' AND {_code("h || regexp_extract(path, '^(/[^/]+)', 1)")} % 7 = 0),
spans AS (SELECT *, lead(since) OVER (PARTITION BY pattern, verdict ORDER BY since) AS valid_to FROM e),
keys AS (
  SELECT page_id, fetched_at, array_to_string(string_split(h, '.')[i:], '.') || CASE WHEN j = 0 THEN '' ELSE '/' || array_to_string(parts[1:j], '/') END AS key
  FROM (SELECT *, unnest(range(0, len(parts) + 1)) AS j FROM (SELECT *, unnest(range(1, len(string_split(h, '.')) + 1)) AS i, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM p WHERE h <> ''))),
best AS (
  SELECT page_id, arg_max(struct_pack(pattern := pattern, verdict := verdict), struct_pack(n := length(pattern), a := verdict = 'allow', p := pattern)) AS b
  FROM keys JOIN spans ON key = pattern AND action = 'add' AND fetched_at >= since AND (valid_to IS NULL OR fetched_at < valid_to) GROUP BY page_id)
SELECT p.page_id, url, fetched_at, b.pattern AS pattern, b.verdict AS verdict, coalesce(b.verdict <> 'block', true) AS kept FROM p LEFT JOIN best USING (page_id)
"""
ORACLES["op2_url_filters"] = OP2

OP6 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
r AS (SELECT *, regexp_replace(role, '[\\#<:]', '', 'g') = role AND NOT (contains(text, '\') OR contains(text, '###') OR contains(text, '</turn>')) AS plain,
  length(role) + length(text) + length('### : </turn>') + 1 AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n + CASE WHEN plain THEN 0 ELSE length(regexp_replace(role, '[^\\#<:]', '', 'g')) + length(regexp_replace(text, '[^\\]', '', 'g'))
    + (length(text) - length(replace(text, '</turn>', ''))) // 7 + coalesce(list_sum([length(x) - 2 for x in regexp_extract_all(text, '###+')]), 0) END)::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""
ORACLES["op6_chat_format"] = OP6
