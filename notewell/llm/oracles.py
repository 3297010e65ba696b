"""DuckDB SQL of the opN queries that SQL can express."""

from __future__ import annotations

OP1_WARC = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages
), m AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first_page FROM p),
framed AS (
  SELECT *, 87 + CASE WHEN payload_bytes = 0 THEN 0 ELSE
    (payload_bytes // 4096) * (4 + 4096 + 4) +
    CASE WHEN payload_bytes % 4096 = 0 THEN 0 ELSE length(printf('%x', payload_bytes % 4096)) + payload_bytes % 4096 + 4 END END + 5 AS block_bytes FROM m
)
SELECT page_id, payload_bytes,
  (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> (35 - 5 * (i % 8))) & 31 AS INTEGER) + 1, 1), '' ORDER BY i)
   FROM (SELECT i, CAST('0x' || substr(h, CAST(10 * (i // 8) + 1 AS INTEGER), 10) AS BIGINT) AS v FROM range(0, 32) AS t(i))) AS payload_digest,
  CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_page THEN NULL ELSE first_page END AS refers_to,
  CASE WHEN page_id = first_page THEN (block_bytes + 16383) // 16384 ELSE 1 END AS segments, 'ok' AS status
FROM framed
"""

OP2_REPETITION = r"""
WITH RECURSIVE dl AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), dw AS (SELECT doc_id, w, len(w) AS n, text FROM dl),
grams AS (
  SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS gram FROM dw, (VALUES (3), (8)) AS z(k), unnest(range(1, n - k + 2)) AS t(s)
), twice AS (
  SELECT doc_id, k, s, gram FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, k, gram) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) FILTER (k = 3) AS n_repeat_words, count(DISTINCT p) FILTER (k = 8) AS n_covered
  FROM twice, unnest(range(s, s + k)) AS t(p) GROUP BY doc_id
), chains AS (
  SELECT a.doc_id, a.s AS s, b.s - a.s AS gap FROM twice a JOIN twice b ON a.doc_id = b.doc_id AND a.k = 8 AND b.k = 8 AND a.gram = b.gram AND a.s < b.s
), islands AS (
  SELECT doc_id, gap, s - row_number() OVER (PARTITION BY doc_id, gap ORDER BY s) AS island FROM chains
), longest AS (
  SELECT doc_id, max(n) AS longest_repeat FROM (SELECT doc_id, count(*) + 7 AS n FROM islands GROUP BY doc_id, gap, island) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM dw)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), counted AS (
  SELECT d.doc_id, CAST(n AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_covered, 0) AS n_covered, coalesce(longest_repeat, 0) AS longest_repeat
  FROM dw d LEFT JOIN covered c USING (doc_id) LEFT JOIN lines l USING (doc_id) LEFT JOIN longest g USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_covered <= 40 * n_words AND longest_repeat <= 100 AS kept
FROM counted
"""

OP3_JACCARD = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[s:s + least(len(w), 5) - 1], ' ') AS gram FROM w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS t(s) WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
prints AS (SELECT doc_id, md5(string_agg(gram, chr(10) ORDER BY gram)) AS p FROM shingles GROUP BY doc_id),
points AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY p) AS point FROM prints),
ps AS (SELECT s.* FROM shingles s JOIN points q USING (doc_id) WHERE q.doc_id = q.point),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM ps a JOIN ps b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, seen) AS (
  SELECT a, a FROM both_ways UNION SELECT reach.node, b FROM reach JOIN both_ways ON reach.seen = a
), label AS (SELECT node, min(seen) AS label FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(l.label, q.point, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN points q USING (doc_id) LEFT JOIN label l ON l.node = q.point
"""



def _shared(level: str, family: str, name: str) -> str:
    by = f"PARTITION BY {family}" if family else ""
    joined = f"JOIN {level}_parent USING ({family})" if family else f"CROSS JOIN {level}_parent"
    keys = f"{family}, {name}" if family else name
    return f"""
{level}_nodes AS (SELECT {keys}, CAST(sum(tokens) * 4 AS BIGINT) AS capacity FROM leaves GROUP BY {keys}),
{level}_offered AS (SELECT n.*, offered, CASE {WEIGHTS[name]} ELSE 1 END AS weight FROM {level}_nodes n {joined}),
{level}_ranked AS (SELECT *, sum(weight) OVER ({by}) AS all_weight,
  coalesce(sum(weight) OVER ({by} ORDER BY CAST(capacity AS DOUBLE) / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_before,
  coalesce(sum(capacity) OVER ({by} ORDER BY CAST(capacity AS DOUBLE) / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capacity_before FROM {level}_offered),
{level}_marked AS (SELECT *, capacity * (all_weight - weight_before) <= (offered - capacity_before) * weight AS filled FROM {level}_ranked),
{level}_used AS (SELECT *, coalesce(sum(capacity) FILTER (filled) OVER ({by}), 0) AS given, coalesce(sum(weight) FILTER (filled) OVER ({by}), 0) AS weight_given FROM {level}_marked),
{level}_budget AS (SELECT {keys}, CASE WHEN filled THEN capacity ELSE ((offered - given) * weight) // (all_weight - weight_given) END AS offered FROM {level}_used)"""


WEIGHTS = {
    "domain": "domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 WHEN 'd3' THEN 1",
    "language": "language WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 1",
    "source": "WHEN false THEN 1",
}

OP4_MIXING = rf"""
WITH docs AS (
  SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS language,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents
), rows_ AS (SELECT doc_id, 'd' || CAST(CAST('0x' || substr(md5(source), 1, 1) AS INTEGER) % 4 AS VARCHAR) AS domain, language, source, n_tokens FROM docs),
leaves AS (SELECT domain, language, source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM rows_ GROUP BY ALL),
top_parent AS (SELECT least(sum(tokens), sum(tokens * 4)) AS offered FROM leaves),
{_shared("top", "", "domain")},
mid_parent AS (SELECT * FROM top_budget),
{_shared("mid", "domain", "language")},
low_parent AS (SELECT * FROM mid_budget),
{_shared("low", "domain, language", "source")},
plan AS (
  SELECT domain, language, source, CASE WHEN tokens > 0 THEN offered // tokens ELSE 0 END AS whole, CASE WHEN tokens > 0 THEN offered % tokens ELSE 0 END AS rest
  FROM leaves JOIN low_budget USING (domain, language, source)
), placed AS (
  SELECT r.*, whole, rest, sum(n_tokens) OVER (PARTITION BY domain, language, source
    ORDER BY md5('17:' || CAST(CAST(whole AS BIGINT) AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)), doc_id ROWS UNBOUNDED PRECEDING) AS reach
  FROM rows_ r JOIN plan USING (domain, language, source)
)
SELECT doc_id, domain, language, source, n_tokens, CAST(whole + CASE WHEN reach <= rest AND rest > 0 THEN 1 ELSE 0 END AS BIGINT) AS epochs
FROM placed WHERE whole + CASE WHEN reach <= rest AND rest > 0 THEN 1 ELSE 0 END > 0
"""

OP7_DECONTAMINATE = r"""
WITH dw AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)
), bw AS (
  SELECT item_id, w, least(len(w), 10) AS k, len(w) AS n FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
  WHERE len(w) > 0
), windows AS (
  SELECT item_id, k, s AS item_start, array_to_string(w[s:s + k - 1], ' ') AS gram FROM bw, unnest(range(1, n - k + 2)) AS t(s)
), dl AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), sizes AS (SELECT DISTINCT k FROM windows),
grams AS (
  SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS gram FROM dl, sizes, unnest(range(1, len(w) - k + 2)) AS t(s)
), hits AS (
  SELECT g.doc_id, g.s, g.k, x.item_id, x.item_start FROM grams g JOIN windows x ON g.k = x.k AND g.gram = x.gram
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(s, s + k)) AS t(p) GROUP BY doc_id
), runs AS (
  SELECT doc_id, item_id, k, item_start - s AS diagonal, s - row_number() OVER (PARTITION BY doc_id, item_id, k, item_start - s ORDER BY s) AS island
  FROM (SELECT DISTINCT doc_id, item_id, k, item_start, s FROM hits)
), longest AS (
  SELECT doc_id, max(n) AS longest_match FROM (SELECT doc_id, count(*) + k - 1 AS n FROM runs GROUP BY doc_id, item_id, k, diagonal, island) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
  sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated, coalesce(l.longest_match, 0) AS longest_match
FROM dl d LEFT JOIN covered c USING (doc_id) LEFT JOIN items i USING (doc_id) LEFT JOIN longest l USING (doc_id)
"""

OP10_DEBRUIJN = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS gram FROM dw, unnest(range(1, len(w) - 11)) AS t(s)
), again AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY gram) AS first_doc FROM grams) WHERE first_doc < doc_id
), gone AS (
  SELECT DISTINCT doc_id, p FROM again, unnest(range(s, s + 13)) AS t(p)
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM dw
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
), removed AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM dw d LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

#: CRC-32 in SQL: the table of all byte steps, and the fold of a text's bytes over it.
_CRC_STEPS = """crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i:
  list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps)"""


def _crc32(text: str) -> str:
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)"


OP12_PERIODIC_RUNS = rf"""
WITH {_CRC_STEPS},
dw AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_crc32("CAST(doc_id AS VARCHAR)")} AS h FROM documents, crc
), cut AS (
  SELECT *, CAST(len(w) AS BIGINT) AS n, h % 10 = 0 AND len(w) > 0 AS planted, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) ELSE 0 END AS a FROM dw
), turned AS (
  SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM cut
), words AS MATERIALIZED (
  SELECT doc_id, n, i, w[1 + CASE WHEN planted AND i >= a THEN a + (i - a) % p ELSE i END] AS word FROM turned, unnest(range(0, n)) AS t(i)
), same AS (
  SELECT x.doc_id, y.i - x.i AS p, x.i AS i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i AND 3 * (y.i - x.i) <= x.n
), islands AS (
  SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM same
), stretches AS (
  SELECT doc_id, min(i) AS start, count(*) + p AS length, p AS period FROM islands GROUP BY doc_id, p, island HAVING count(*) + p >= greatest(24, 3 * p)
), runs AS MATERIALIZED (
  SELECT doc_id, start, length, min(period) AS period FROM stretches GROUP BY doc_id, start, length
), listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id
), best AS (
  SELECT * FROM runs r WHERE NOT EXISTS (SELECT 1 FROM runs o WHERE o.doc_id = r.doc_id AND (o.length * r.period > r.length * o.period
    OR o.length * r.period = r.length * o.period AND (o.start < r.start OR o.start = r.start AND o.period < r.period)))
), gone AS (
  SELECT DISTINCT doc_id, i FROM runs, unnest(range(start + period, start + length)) AS t(i)
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM dw d LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP13_SPELLING = rf"""
WITH RECURSIVE {_CRC_STEPS},
found AS (
  SELECT doc_id, w, count(*) AS n, CAST(doc_id AS VARCHAR) || ':' || w AS keyed FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS w FROM documents) WHERE length(w) >= 7 GROUP BY ALL
), hashed AS (SELECT *, {_crc32("keyed")} AS h FROM found, crc),
spelled AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelled WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) AS t(i)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), told AS (
  SELECT word, count(*) AS n_near, max(other_n) AS best_n FROM near GROUP BY word
), chosen AS (
  SELECT t.word, n_near, best_n, min(other) AS best FROM told t JOIN near e ON t.word = e.word AND e.other_n = best_n GROUP BY ALL
), judged AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * w.n THEN best END AS form, CASE WHEN best_n >= 10 * w.n THEN best_n END AS form_n FROM words w LEFT JOIN chosen c ON c.word = w.word
), ways(word, reached, steps) AS (
  SELECT word, word, 0 FROM judged UNION ALL SELECT ways.word, form, steps + 1 FROM ways JOIN judged ON judged.word = ways.reached WHERE form IS NOT NULL
), ends AS (SELECT word, arg_max(reached, steps) AS root FROM ways GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM judged JOIN ends USING (word)
"""
