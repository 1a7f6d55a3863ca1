"""SQL that gives the same rows as queries of this subpackage, over the same tables."""

from __future__ import annotations

from glyphloom.llm.measures import COMMON_WORDS, CONSONANTS

# Fixed values, as in ``measures``: white space, consonants, and what stands at the end of sentences and lines.
_W = r"\s\x0b\p{Z}"
_CLOSE = """["'”’»)\\]]*"""
_COMMON = ", ".join(f"'{w}'" for w in dict.fromkeys(COMMON_WORDS))
_GRAM = "CASE WHEN n_words >= {n} THEN least(1.0::DOUBLE, coalesce((SELECT max(c * length(g)) FROM r WHERE r.k = b.k AND r.n = {n}), 0) / length(array_to_string(w, ' '))) END"

ORACLES: dict[str, str] = {
    "p3_statistics": f"""
WITH x AS (SELECT 'document' AS record_kind, doc_id AS record_id, coalesce(text, '') AS t FROM documents UNION ALL SELECT 'promotion', promotion_id, coalesce(text, '') FROM (SELECT DISTINCT promotion_id, text FROM promotion_records)),
a AS (SELECT *, row_number() OVER () AS k, list_filter(regexp_split_to_array(lower(t), '[{_W}]+'), lambda v: v <> '') AS w, list_filter(string_split(t, chr(10)), lambda v: regexp_matches(v, '[^{_W}]')) AS l,
 list_filter(regexp_split_to_array(t, '\\n[{_W}]*\\n'), lambda v: regexp_matches(v, '[^{_W}]')) AS p FROM x),
b AS (SELECT *, length(t) AS n_characters, len(w) AS n_words, length(regexp_replace(t, '[{_W}]+', '', 'g')) AS n_visible, length(regexp_replace(t, '[{_W}\\p{{L}}\\p{{N}}]+', '', 'g')) AS n_symbols, len(l) AS n_lines,
 len(list_filter(l, lambda v: regexp_matches(v, '[.!?…:;]{_CLOSE.replace("'", "''")}[{_W}]*$'))) AS n_ended_lines,
 len(list_filter(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}\\p{{S}}]+'), lambda v: regexp_full_match(v, '\\p{{L}}{{2,}}') AND NOT regexp_full_match(v, '[{CONSONANTS}]+'))) AS n_readable,
 len(list_filter(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}]+'), lambda v: lower(v) IN ({_COMMON}))) AS n_common,
 len(regexp_extract_all(t, '[^{_W}.!?…][.!?…]+{_CLOSE.replace("'", "''")}(?:[{_W}]|$)')) AS n_sentence_ends,
 len(list_filter(regexp_split_to_array(t, '[{_W}|;,]+'), lambda v: v <> '')) AS n_tokens,
 len(list_filter(regexp_split_to_array(t, '[{_W}|;,()]+'), lambda v: regexp_full_match(v, '[0-9][0-9.:/%-]*'))) AS n_numbers, len(p) AS n_paragraphs FROM a),
g AS (SELECT k, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM a, (SELECT unnest([2, 3, 4]) AS n))),
r AS (SELECT k, n, g, count(*) AS c FROM g GROUP BY k, n, g HAVING count(*) > 1)
SELECT record_kind, record_id, n_characters, n_words, n_visible, n_symbols, n_lines, n_ended_lines, n_readable, n_common, n_sentence_ends, n_tokens, n_numbers, n_paragraphs, n_visible / nullif(n_words, 0) AS mean_word_length, n_symbols / nullif(n_visible, 0) AS symbol_share,
 n_ended_lines / nullif(n_lines, 0) AS ended_line_share, least(n_common, n_words) / nullif(n_words, 0) AS common_word_share, least(n_readable, n_words) / nullif(n_words, 0) AS readable_share, (n_readable + n_numbers) / nullif(n_tokens, 0) AS sound_share,
 (n_lines - len(list_distinct(list_transform(l, lambda v: regexp_replace(lower(v), '^[{_W}]+|[{_W}]+$', '', 'g'))))) / nullif(n_lines, 0) AS duplicate_line_share,
 (n_paragraphs - len(list_distinct(list_transform(p, lambda v: regexp_replace(lower(v), '^[{_W}]+|[{_W}]+$', '', 'g'))))) / nullif(n_paragraphs, 0) AS duplicate_paragraph_share,
 {_GRAM.format(n=2)} AS dominant_bigram_share, {_GRAM.format(n=3)} AS dominant_trigram_share, {_GRAM.format(n=4)} AS dominant_4gram_share FROM b
""".replace("\\\\", "\\"),
    "p4_found": r"""
WITH f AS (SELECT DISTINCT frame_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(combined_text), '[\s\p{Z}]+'), lambda x: x <> ''))) AS w FROM frames WHERE combined_text IS NOT NULL),
g AS (SELECT frame_id, w, len(w) AS n FROM f WHERE len(w) >= 25),
t AS (SELECT frame_id, n, unnest(w) AS x FROM g),
p AS (SELECT a.frame_id AS frame_id_a, b.frame_id AS frame_id_b, count(*) AS c, a.n + b.n AS total FROM t a JOIN t b ON a.x = b.x AND a.frame_id < b.frame_id GROUP BY a.frame_id, b.frame_id, a.n, b.n)
SELECT frame_id_a, frame_id_b FROM p WHERE c * 5 >= (total - c) * 4
""",
    "p4_groups": r"""
WITH RECURSIVE f AS (SELECT DISTINCT frame_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(combined_text), '[\s\p{Z}]+'), lambda x: x <> ''))) AS w FROM frames WHERE combined_text IS NOT NULL AND frame_id IS NOT NULL),
g AS (SELECT frame_id, w FROM f WHERE len(w) >= 25), c AS (SELECT w, min(frame_id) AS class_id, count(*) AS copies FROM g GROUP BY w),
t AS (SELECT class_id, len(w) AS n, unnest(w) AS x FROM c),
p AS (SELECT a.class_id AS a, b.class_id AS b, count(*) AS k, a.n + b.n AS total FROM t a JOIN t b ON a.x = b.x AND a.class_id <> b.class_id GROUP BY a.class_id, b.class_id, a.n, b.n),
l AS (SELECT a, b FROM p WHERE k * 5 >= (total - k) * 4), r AS (SELECT class_id AS node, class_id AS root FROM c UNION SELECT l.b, r.root FROM r JOIN l ON r.node = l.a),
q AS (SELECT node, min(root) AS group_id FROM r GROUP BY node), m AS (SELECT a, count(*) AS links FROM l GROUP BY a)
SELECT frame_id, c.class_id, group_id, copies, coalesce(links, 0) AS links FROM g JOIN c USING (w) JOIN q ON q.node = c.class_id LEFT JOIN m ON m.a = c.class_id
""",
    "p5_found": """
WITH r AS (SELECT region_id, max_by(struct_pack(v := video_id, u := run_id, c := confidence), ingested_at) AS k FROM regions WHERE region_id IS NOT NULL GROUP BY region_id),
m AS (SELECT k.v AS video_id, k.u AS run_id, median(k.c) AS exact FROM r WHERE k.c BETWEEN 0 AND 1 AND NOT isnan(k.c) GROUP BY 1, 2)
SELECT DISTINCT s.stats_id FROM confidence_stats s JOIN m USING (video_id, run_id)
WHERE s.median IS NULL OR isnan(s.median) OR abs(s.median - m.exact) > 0.01 + 1e-9
""",
    "p7_found": r"""
WITH d AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_number
 FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
dl AS (SELECT source, doc_id, line_number, regexp_replace(lower(line), '[^\p{L}]+', '', 'g') AS k FROM d),
dk AS (SELECT * FROM dl WHERE length(k) BETWEEN 4 AND 120),
dt AS (SELECT source, count(*) AS total FROM documents WHERE source IS NOT NULL AND text <> '' GROUP BY 1),
ds AS (SELECT source, k FROM dk JOIN dt USING (source) GROUP BY source, k, total HAVING count(DISTINCT doc_id) >= 4 AND count(DISTINCT doc_id) >= total * 0.2::DOUBLE),
t AS (SELECT DISTINCT line_id, video_id, frame_id, regexp_replace(lower(text), '[^\p{L}]+', '', 'g') AS k FROM text_lines WHERE video_id IS NOT NULL AND frame_id IS NOT NULL),
tk AS (SELECT * FROM t WHERE length(k) >= 4),
tt AS (SELECT video_id, count(DISTINCT frame_id) AS total FROM tk GROUP BY 1),
ts AS (SELECT video_id, k FROM tk JOIN tt USING (video_id) GROUP BY video_id, k, total HAVING count(DISTINCT frame_id) >= 4 AND count(DISTINCT frame_id) >= total * 0.2::DOUBLE)
SELECT 'document' AS record_kind, doc_id AS record_id, line_number::INT AS line_number FROM dk JOIN ds USING (source, k)
UNION ALL
SELECT 'text_line', line_id, 0 FROM tk JOIN ts USING (video_id, k)
""",
    "p8_found": """
SELECT spec_id, doc_id FROM documents, container_specs WHERE purpose = 'pack' AND strlen(text) > capacity_tokens
""",
    "p7_cleaned": r"""
WITH d AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL),
k AS (SELECT *, regexp_replace(lower(line), '[^\p{L}]+', '', 'g') AS k FROM d), dt AS (SELECT source, count(*) AS total FROM documents WHERE source IS NOT NULL AND text <> '' GROUP BY 1),
s AS (SELECT source, k FROM k JOIN dt USING (source) WHERE length(k) BETWEEN 4 AND 120 GROUP BY source, k, total HAVING count(DISTINCT doc_id) >= 4 AND count(DISTINCT doc_id) >= total * 0.2::DOUBLE),
x AS (SELECT k.doc_id, k.line, k.n, s.k IS NOT NULL AS gone FROM k LEFT JOIN s ON k.source = s.source AND k.k = s.k),
y AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '') AS cleaned, count(*) FILTER (WHERE gone) AS removed FROM x GROUP BY doc_id)
SELECT doc_id, source, CASE WHEN text IS NOT NULL THEN coalesce(cleaned, '') END AS text, coalesce(removed, 0)::INT AS removed_lines FROM documents LEFT JOIN y USING (doc_id)
""",
    "p8_bounds": """
SELECT spec_id, sum(coalesce(strlen(text), 0))::BIGINT AS bytes, count(*) AS documents, 0::BIGINT AS overfull, true AS near_least FROM documents, container_specs WHERE purpose = 'pack' GROUP BY spec_id
""",
    "p9_targets": """
WITH s AS (SELECT source, sum(coalesce(strlen(text), 0)) AS b FROM documents WHERE source IS NOT NULL GROUP BY 1),
t AS (SELECT m.*, coalesce(b, 0) AS b, max(budget_fraction) OVER (PARTITION BY mix_id) * sum(coalesce(b, 0)) OVER (PARTITION BY mix_id) AS budget FROM mix_targets m LEFT JOIN s USING (source))
SELECT mix_id, source, repeat_cap * b >= target_share * budget AS met FROM t
""",
    "p9_found": """
WITH s AS (SELECT source, sum(coalesce(strlen(text), 0)) AS b FROM documents WHERE source IS NOT NULL GROUP BY 1),
t AS (SELECT m.*, coalesce(b, 0) AS b, max(budget_fraction) OVER (PARTITION BY mix_id) * sum(coalesce(b, 0)) OVER (PARTITION BY mix_id) AS budget FROM mix_targets m LEFT JOIN s USING (source))
SELECT mix_id, source FROM t WHERE repeat_cap * b < target_share * budget
""",
    "p10_found": """
SELECT spec_id, doc_id FROM documents, container_specs WHERE purpose = 'split' AND strlen(text) > capacity_tokens
""",
}
