"""Descriptive statistics, filters with reason codes, windows, set operations and splits."""

ELIGIBLE = "paragraph AND excluded = 0 AND NOT coalesce(interrupted, false) AND nw >= 3"

BODIES: dict[str, str] = {}

BODIES["inventory"] = """
SELECT count(DISTINCT r.locus_id) AS records, count(DISTINCT r.folio) AS folios, max(t.tokens) AS tokens, max(t.types) AS types,
       cast(sum(r.excluded) AS BIGINT) AS excluded, max(t.chars) AS chars, round(max(t.mean_length), 6) AS mean_length, max(t.hapax) AS hapax
FROM {recs} r CROSS JOIN (
  SELECT cast(sum(c) AS BIGINT) AS tokens, count(*) AS types, cast(sum(c * length(w)) AS BIGINT) AS chars,
         sum(c * length(w)) / nullif(cast(sum(c) AS DOUBLE), 0) AS mean_length, count(*) FILTER (WHERE c = 1) AS hapax
  FROM (SELECT w, count(*) AS c FROM {tok} GROUP BY w)) t"""

BODIES["inventory_by"] = """
SELECT CASE WHEN gi = 0 THEN 'I' WHEN gl = 0 THEN 'L' ELSE 'Q' END AS label, coalesce(il, ll, ql) AS value, records, tokens, excluded, folios
FROM (SELECT il, ll, ql, grouping(il) AS gi, grouping(ll) AS gl, count(*) AS records, cast(sum(nw) AS BIGINT) AS tokens, cast(sum(excluded) AS BIGINT) AS excluded, count(DISTINCT folio) AS folios
      FROM (SELECT coalesce(il, '?') AS il, coalesce(ll, '?') AS ll, coalesce(ql, '?') AS ql, nw, excluded, folio FROM {recs})
      GROUP BY GROUPING SETS ((il), (ll), (ql)))"""

BODIES["length_histogram"] = """
SELECT len, cast(sum(n) AS BIGINT) AS n FROM {types} GROUP BY len"""

BODIES["top_tokens"] = """
SELECT w, c FROM (SELECT w, count(*) AS c, min(source_order * 100000 + wp) AS first_at FROM {tok} GROUP BY w) ORDER BY c DESC, first_at LIMIT 25"""

BODIES["rank_types"] = """
SELECT w, c, cast(row_number() OVER (ORDER BY c DESC, w) AS BIGINT) AS rnk FROM (SELECT w, cast(sum(n) AS BIGINT) AS c FROM {types} GROUP BY w ORDER BY c DESC, w LIMIT 200)"""

BODIES["entropy_h1"] = """
SELECT round(-sum(n / t * log2(n / t)), 6) AS h1 FROM (SELECT n, cast(sum(n) OVER () AS DOUBLE) AS t FROM (SELECT ch, sum(n) AS n FROM {tchars} GROUP BY ch))"""

BODIES["entropy_h2"] = """
SELECT round(-sum(n * log2(n / ta)) / sum(n), 6) AS h2
FROM (SELECT a, b, n, cast(sum(n) OVER (PARTITION BY a) AS DOUBLE) AS ta
      FROM (SELECT ch AS a, nxt AS b, sum(n) AS n
            FROM (SELECT n, ch, lead(ch) OVER (PARTITION BY split, w ORDER BY cp) AS nxt FROM {tchars}) WHERE nxt IS NOT NULL GROUP BY ch, nxt))"""

BODIES["invariants"] = """
WITH u AS (SELECT split, u, sum(n) AS n FROM {tunits} WHERE split IS NOT NULL GROUP BY split, u),
w AS (SELECT split, w, n FROM {types} WHERE split IS NOT NULL),
ue AS (SELECT split, count(*) AS alphabet, cast(sum(n) AS BIGINT) AS units, round(-sum(n / t * log2(n / t)), 6) AS unit_entropy
       FROM (SELECT split, n, cast(sum(n) OVER (PARTITION BY split) AS DOUBLE) AS t FROM u) GROUP BY split),
we AS (SELECT split, count(*) AS types, cast(sum(n) AS BIGINT) AS tokens, round(-sum(n / t * log2(n / t)), 6) AS word_entropy
       FROM (SELECT split, n, cast(sum(n) OVER (PARTITION BY split) AS DOUBLE) AS t FROM w) GROUP BY split)
SELECT ue.split, alphabet, units, unit_entropy, types, tokens, word_entropy FROM ue JOIN we ON ue.split = we.split"""

BODIES["freq_ranks"] = """
SELECT c AS frequency, count(*) AS n_types FROM (SELECT w, cast(sum(n) AS BIGINT) AS c FROM {types} GROUP BY w) GROUP BY c"""

BODIES["unitize_raw"] = """
SELECT ch AS u, cast(sum(n) AS BIGINT) AS n, count(DISTINCT w) AS types FROM {tchars} GROUP BY ch"""
BODIES["unitize_grouped"] = """
SELECT u, cast(sum(n) AS BIGINT) AS n, count(DISTINCT w) AS types FROM {tunits} GROUP BY u"""
BODIES["unitize_visual6"] = """
SELECT u, cast(sum(n) AS BIGINT) AS n, count(DISTINCT w) AS types FROM {tvisual} GROUP BY u"""

BODIES["unit_inventory"] = """
SELECT 'raw' AS unitization, count(DISTINCT ch) AS alphabet, count(DISTINCT ch) <= 26 AS feasible FROM {tchars}
UNION ALL SELECT 'grouped', count(DISTINCT u), count(DISTINCT u) <= 26 FROM {tunits}
UNION ALL SELECT 'visual6', count(DISTINCT u), count(DISTINCT u) <= 26 FROM {tvisual}"""

BODIES["unit_spans"] = """
SELECT u, span_start, cast(sum(n) AS BIGINT) AS n
FROM (SELECT u, n, cast(sum(length(u)) OVER (PARTITION BY split, w ORDER BY up) - length(u) AS BIGINT) AS span_start FROM {tvisual}) GROUP BY u, span_start"""

# The units that both ways of transcribing share, in their order.
COMMON_UNITS = "o y a e ch sh k t f p ckh cth cfh cph d s r l i n m g q".split()
_COMMON = "(VALUES " + ", ".join(f"('{u}', {i})" for i, u in enumerate(COMMON_UNITS)) + ") AS k(u, i)"

BODIES["common_index"] = f"""
SELECT coalesce(k.i, -1) AS idx, cast(sum(v.n) AS BIGINT) AS n FROM {{tvisual}} v LEFT JOIN {_COMMON} ON v.u = k.u GROUP BY coalesce(k.i, -1)"""

BODIES["word_pattern"] = """
SELECT len, pattern, count(DISTINCT w) AS types, cast(sum(n) AS BIGINT) AS tokens FROM {types} GROUP BY len, pattern"""

BODIES["compare_invariants"] = """
WITH side AS (SELECT split, len, pattern, count(*) AS types, sum(n) AS tokens FROM {types} WHERE split IS NOT NULL GROUP BY split, len, pattern),
sup AS (SELECT a.split, cast(sum(a.types) AS BIGINT) AS types, cast(sum(CASE WHEN b.pattern IS NOT NULL THEN a.types ELSE 0 END) AS BIGINT) AS supported
  FROM side a LEFT JOIN side b ON b.split = 'train' AND a.pattern = b.pattern WHERE a.split <> 'train' GROUP BY a.split),
dist AS (SELECT 'length' AS what, split, cast(len AS STRING) AS k, sum(tokens) AS n FROM side GROUP BY split, len UNION ALL SELECT 'pattern', split, pattern, sum(tokens) FROM side GROUP BY split, pattern),
p AS (SELECT what, split, k, n / cast(sum(n) OVER (PARTITION BY what, split) AS DOUBLE) AS p FROM dist),
both_ AS (SELECT a.what, a.split, a.p, coalesce(b.p, 0e0) AS q FROM p a LEFT JOIN p b ON a.what = b.what AND a.k = b.k AND b.split = 'train' WHERE a.split <> 'train'
  UNION ALL SELECT b.what, s.split, 0e0, b.p FROM p b CROSS JOIN (SELECT DISTINCT split FROM side WHERE split <> 'train') s LEFT JOIN p a ON a.what = b.what AND a.k = b.k AND a.split = s.split WHERE b.split = 'train' AND a.k IS NULL),
js AS (SELECT what, split, round(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0e0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0e0 END) / 2, 6) AS js FROM both_ GROUP BY what, split)
SELECT sup.split, sup.types, sup.supported, round(sup.supported / cast(sup.types AS DOUBLE), 6) AS support_rate, l.js AS length_js, q.js AS pattern_js
FROM sup JOIN js l ON sup.split = l.split AND l.what = 'length' JOIN js q ON sup.split = q.split AND q.what = 'pattern'"""

BODIES["js_divergence"] = """
WITH c AS (SELECT ll, length(w) AS k, cast(count(*) AS DOUBLE) AS n FROM {tok} WHERE ll IN ('A', 'B') GROUP BY ll, length(w)),
p AS (SELECT k, n / sum(n) OVER () AS p FROM c WHERE ll = 'A'), q AS (SELECT k, n / sum(n) OVER () AS q FROM c WHERE ll = 'B'),
j AS (SELECT coalesce(p, 0e0) AS p, coalesce(q, 0e0) AS q FROM p FULL OUTER JOIN q ON p.k = q.k)
SELECT round(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0e0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0e0 END) / 2, 6) AS js FROM j"""

BODIES["summary_stats"] = """
WITH h AS (SELECT coalesce(ll, '?') AS ll, nw, count(*) AS n FROM {recs} GROUP BY coalesce(ll, '?'), nw),
r AS (SELECT ll, nw, n, sum(n) OVER (PARTITION BY ll ORDER BY nw) AS upto, sum(n) OVER (PARTITION BY ll) AS t FROM h),
m AS (SELECT ll, sum(n * nw) / cast(sum(n) AS DOUBLE) AS mean, sum(n * nw * nw) / cast(sum(n) AS DOUBLE) AS square FROM h GROUP BY ll)
SELECT r.ll, round(max(m.mean), 6) AS mean, round(sqrt(max(m.square) - max(m.mean) * max(m.mean)), 6) AS sd,
  min(CASE WHEN upto > floor(25e-3 * (t - 1)) THEN nw END) AS low, min(CASE WHEN upto > floor(975e-3 * (t - 1)) THEN nw END) AS high FROM r JOIN m ON r.ll = m.ll GROUP BY r.ll"""

BODIES["elig_structure"] = f"""
SELECT ll, count(*) AS lines, cast(sum(nw) AS BIGINT) AS words FROM {{recs}} WHERE {ELIGIBLE} GROUP BY ll"""

BODIES["elig_context"] = """
SELECT reason, count(*) AS records, cast(sum(nw) AS BIGINT) AS words FROM (
  SELECT nw, CASE WHEN NOT coalesce(paragraph, false) THEN 'not_paragraph' WHEN excluded > 0 THEN 'excluded_tokens' WHEN interrupted THEN 'interrupted_line'
         WHEN nw < 3 THEN 'fewer_than_three_words' ELSE 'eligible' END AS reason FROM {recs}) GROUP BY reason"""

BODIES["elig_complete"] = """
SELECT reason, count(*) AS records, cast(sum(nw) AS BIGINT) AS words FROM (
  SELECT nw, CASE WHEN NOT coalesce(paragraph, false) THEN 'not_paragraph' WHEN nw = 0 THEN 'no_accepted_tokens' WHEN excluded > 0 THEN 'excluded_tokens'
         WHEN interrupted THEN 'diagram_interruption' ELSE 'eligible' END AS reason FROM {recs}) GROUP BY reason"""

BODIES["elig_agreement"] = """
WITH x AS (SELECT CASE transcriber WHEN 'QX' THEN 'left' ELSE 'right' END AS side, interrupted, nw, doubt FROM {recs} WHERE transcriber IN ('QX', 'MR'))
SELECT side, reason, count(*) AS records FROM (
  SELECT side, 'uncertain_or_rare_tokens' AS reason FROM x WHERE doubt UNION ALL SELECT side, 'interrupted' FROM x WHERE interrupted
  UNION ALL SELECT side, 'empty_tokens' FROM x WHERE nw = 0) GROUP BY side, reason"""

BODIES["elig_line_phase"] = """
SELECT reason, count(*) AS records FROM (
  SELECT CASE WHEN NOT coalesce(paragraph, false) THEN 'not_paragraph' WHEN ll IS NULL THEN 'missing_language' WHEN split IS NULL THEN 'no_split' WHEN split <> 'train' THEN 'held_out'
    WHEN excluded > 0 THEN 'excluded_tokens' WHEN interrupted THEN 'interrupted' WHEN nw < 2 THEN 'short' WHEN nxt IS NULL THEN 'last_record'
    WHEN nxt <> folio THEN 'folio_end' ELSE 'kept' END AS reason
  FROM (SELECT paragraph, ll, split, excluded, interrupted, nw, folio, lead(folio) OVER (PARTITION BY volume_id ORDER BY source_order) AS nxt FROM {recs})) GROUP BY reason"""

BODIES["vocab_min_count"] = """
SELECT t.split, count(*) AS tokens, count(v.w) AS known, count(*) - count(v.w) AS unknown FROM {tok} t
LEFT JOIN (SELECT w FROM {tok} WHERE split = 'train' GROUP BY w HAVING count(*) >= 2) v ON t.w = v.w WHERE t.split IS NOT NULL GROUP BY t.split"""

BODIES["split_hash"] = "SELECT grp, split, count(*) AS records FROM {recs} GROUP BY grp, split"

BODIES["split_manifest"] = """
SELECT split, count(DISTINCT grp) AS groups, count(DISTINCT folio) AS folios, count(*) AS records, cast(sum(nw) AS BIGINT) AS tokens, min(locus_id) AS first_id, max(locus_id) AS last_id
FROM {recs} GROUP BY split"""

BODIES["group_lookup"] = "SELECT folio_no, count(DISTINCT volume_id) AS volumes, count(DISTINCT folio) AS pages, count(*) AS records FROM {recs} GROUP BY folio_no"

BODIES["split_chapter"] = """
WITH c AS (SELECT book_id, chapter_key, min(paragraph_id) AS first_at, count(*) AS paragraphs FROM {paras} WHERE book_id IS NOT NULL AND chapter_key IS NOT NULL GROUP BY book_id, chapter_key),
n AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY first_at) - 1 AS i, count(*) OVER (PARTITION BY book_id) AS k FROM c)
SELECT chapter_key, paragraphs, CASE WHEN i < floor(k * 6 / 10) THEN 'train' WHEN i < floor(k * 6 / 10) + floor(k * 2 / 10) THEN 'validation' ELSE 'test' END AS split FROM n"""

BODIES["paragraph_ordinal"] = """
SELECT book_id, count(*) AS paragraphs, count(*) FILTER (WHERE local_paragraph_ordinal = rn) AS contiguous
FROM (SELECT book_id, local_paragraph_ordinal, row_number() OVER (PARTITION BY chapter_key ORDER BY local_paragraph_ordinal, paragraph_id) AS rn FROM {paras} WHERE chapter_key IS NOT NULL) GROUP BY book_id"""

BODIES["dedup_cross_split"] = """
WITH s AS (SELECT locus_id, split, array_to_string_(words) AS seq, CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END AS rnk FROM {recs} WHERE split IS NOT NULL),
m AS (SELECT seq, min(rnk) AS first_rank FROM s GROUP BY seq)
SELECT s.split, count(*) AS records, count(*) FILTER (WHERE s.seq = '') AS empties, count(*) FILTER (WHERE s.seq <> '' AND s.rnk > m.first_rank) AS duplicates,
       count(*) FILTER (WHERE s.seq <> '' AND s.rnk = m.first_rank) AS kept FROM s JOIN m ON s.seq = m.seq GROUP BY s.split"""

BODIES["adjacent_pairs"] = """
SELECT prev, w, count(*) AS n FROM (SELECT w, lag(w) OVER (PARTITION BY locus_id ORDER BY wp) AS prev FROM {tok}) WHERE prev IS NOT NULL GROUP BY prev, w"""

BODIES["within_word_bigrams"] = """
SELECT prev, ch, cast(sum(n) AS BIGINT) AS n FROM (SELECT ch, n, lag(ch) OVER (PARTITION BY split, w ORDER BY cp) AS prev FROM {tchars}) WHERE prev IS NOT NULL GROUP BY prev, ch"""

BODIES["first_vs_rest"] = f"""
SELECT count(*) AS lines, round(avg(first_len - (total - first_len) / cast(n - 1 AS DOUBLE)), 6) AS difference
FROM (SELECT locus_id, max(CASE WHEN wp = 0 THEN length(w) END) AS first_len, sum(length(w)) AS total, count(*) AS n FROM {{tok}} WHERE {ELIGIBLE} GROUP BY locus_id)"""

BODIES["position_role"] = """
SELECT role, count(*) AS n, round(avg(length(w)), 6) AS mean_length FROM (
  SELECT w, CASE WHEN wp = 1 THEN 'second' WHEN wp = nw - 1 THEN 'last' ELSE 'interior' END AS role FROM {tok} WHERE wp > 0) GROUP BY role"""

BODIES["history_window"] = """
SELECT c1, c2, ch, cast(sum(n) AS BIGINT) AS n FROM (
  SELECT ch, n, coalesce(lag(ch, 2) OVER (PARTITION BY split, w ORDER BY cp), '^') AS c1, coalesce(lag(ch, 1) OVER (PARTITION BY split, w ORDER BY cp), '^') AS c2 FROM {tchars})
GROUP BY c1, c2, ch"""

# Positions in one stream per split. A running sum over a whole split would be one task; so ranges of ids are summed
# first, their few totals run up in front, and the running sum inside a range is added.
STREAM_BLOCKS = """tot AS (SELECT split, floor(locus_id / 65536) AS blk, sum(length(w)) AS n FROM {tok} WHERE split IS NOT NULL GROUP BY split, floor(locus_id / 65536)),
base AS (SELECT split, blk, sum(n) OVER (PARTITION BY split ORDER BY blk) - n AS base FROM tot)"""

BODIES["stream_offsets"] = f"""
WITH {STREAM_BLOCKS}, o AS (SELECT split, floor(locus_id / 65536) AS blk, sum(length(w)) OVER (PARTITION BY split, floor(locus_id / 65536) ORDER BY locus_id, wp) - length(w) AS inside FROM {{tok}} WHERE split IS NOT NULL)
SELECT o.split, cast(max(base + inside) AS BIGINT) AS last_offset, cast(sum((base + inside) % 97) AS BIGINT) AS checksum FROM o JOIN base b ON o.split = b.split AND o.blk = b.blk GROUP BY o.split"""

BODIES["stream_concat"] = f"""
WITH {STREAM_BLOCKS}, r AS (SELECT split, locus_id, floor(locus_id / 65536) AS blk, sum(length(w)) AS n, count(*) AS words FROM {{tok}} WHERE split IS NOT NULL GROUP BY split, locus_id),
o AS (SELECT split, locus_id, blk, n, words, sum(n) OVER (PARTITION BY split, blk ORDER BY locus_id) - n AS inside FROM r)
SELECT o.split, o.locus_id, cast(base + inside AS BIGINT) AS starts, cast(base + inside + o.n AS BIGINT) AS ends, o.words FROM o JOIN base b ON o.split = b.split AND o.blk = b.blk"""

STREAM_POSITIONS = STREAM_BLOCKS + """,
inner_ AS (SELECT split, ch, floor(locus_id / 65536) AS blk, row_number() OVER (PARTITION BY split, floor(locus_id / 65536) ORDER BY locus_id, wp, cp) - 1 AS k FROM {chars} WHERE split IS NOT NULL),
pos AS (SELECT i.split, i.ch, cast(b.base + i.k AS BIGINT) AS pos FROM inner_ i JOIN base b ON i.split = b.split AND i.blk = b.blk)"""

BODIES["fixed_blocks"] = f"""
WITH {STREAM_POSITIONS} SELECT split, count(*) AS blocks, count(*) FILTER (WHERE n = 64) AS full_blocks, max(n) AS largest FROM (
  SELECT split, floor(pos / 64) AS block, count(*) AS n FROM pos GROUP BY split, floor(pos / 64)) GROUP BY split"""

BODIES["cum_width"] = """
SELECT width, count(*) AS n FROM (SELECT cast(sum(length(w) + 1) OVER (PARTITION BY locus_id ORDER BY wp) AS BIGINT) AS width FROM {tok}) GROUP BY width"""

BODIES["sequence_match"] = """
SELECT a, b, c, d, e, count(*) AS n FROM (SELECT w AS a, lead(w) OVER x AS b, lead(w, 2) OVER x AS c, lead(w, 3) OVER x AS d, lead(w, 4) OVER x AS e FROM {tok} WINDOW x AS (PARTITION BY locus_id ORDER BY wp))
WHERE e IS NOT NULL GROUP BY a, b, c, d, e"""

BODIES["periodicity"] = """
WITH known AS (SELECT ch FROM (SELECT ch, sum(n) AS n FROM {tchars} WHERE split = 'train' GROUP BY ch) WHERE n > 1),
s AS (SELECT l.w, l.cp, k.ch FROM {letters} l LEFT JOIN known k ON l.ch = k.ch),
per AS (SELECT DISTINCT s.w, p.cp AS k FROM {letters} s JOIN {letters} p ON s.w = p.w AND p.cp >= 1),
phase AS (SELECT s.w, per.k, s.cp % per.k AS ph, count(DISTINCT s.ch) AS n FROM s JOIN per ON s.w = per.w GROUP BY s.w, per.k, s.cp % per.k)
SELECT k, count(*) AS words, count(*) FILTER (WHERE worst = 1) AS fully_known FROM (SELECT w, k, max(n) AS worst FROM phase GROUP BY w, k) WHERE worst <= 1 GROUP BY k"""

BODIES["adjacent_repeat"] = """
WITH v AS (SELECT locus_id, wp, u, lag(u) OVER (PARTITION BY locus_id, wp ORDER BY up) AS prev FROM {visual})
SELECT count(DISTINCT locus_id * 1000 + wp) AS words, count(*) AS n_units, count(prev) AS adjacent, count(*) FILTER (WHERE u = prev) AS certificates,
       count(DISTINCT CASE WHEN u = prev THEN locus_id * 1000 + wp END) AS affected FROM v"""

BODIES["natural_sort"] = """
SELECT folio, cast(row_number() OVER (ORDER BY coalesce(folio_no, 1000000), folio) AS BIGINT) AS place, n FROM (SELECT folio, min(folio_no) AS folio_no, count(*) AS n FROM {recs} WHERE folio IS NOT NULL GROUP BY folio)"""

BODIES["mismatch_limit"] = """
SELECT volume_id, folio, idx, locus_id FROM {recs} WHERE excluded > 0 AND folio_no IS NOT NULL ORDER BY folio_no, folio, idx, locus_id LIMIT 20"""

BODIES["seeded_sample"] = "SELECT locus_id FROM {recs} ORDER BY md5('408:' || locus_id), locus_id LIMIT 50"

BODIES["region_intersect"] = """
SELECT w FROM {tok} WHERE il = 'A' INTERSECT SELECT w FROM {tok} WHERE il = 'C' INTERSECT SELECT w FROM {tok} WHERE il = 'S'"""

BODIES["type_set_diff"] = "SELECT w FROM {tok} WHERE split = 'test' EXCEPT SELECT w FROM {tok} WHERE split = 'train'"

BODIES["key_union"] = """
SELECT folio FROM {recs} WHERE transcriber = 'QX' AND folio IS NOT NULL UNION SELECT folio FROM {recs} WHERE transcriber = 'MR' AND folio IS NOT NULL"""

BODIES["multiset_equal"] = """
WITH a AS (SELECT w, count(*) AS n FROM {tok} GROUP BY w), b AS (SELECT w, count(*) AS n FROM (SELECT w, row_number() OVER (PARTITION BY locus_id ORDER BY md5('1:' || locus_id || ':' || wp)) AS k FROM {tok}) GROUP BY w)
SELECT count(*) AS different FROM (SELECT * FROM a EXCEPT SELECT * FROM b UNION ALL SELECT * FROM b EXCEPT SELECT * FROM a)"""

BODIES["category_counts"] = """
SELECT coalesce(il, '?') AS category, count(DISTINCT folio) AS folios, count(DISTINCT grp) AS groups, cast(sum(nw) AS BIGINT) AS tokens,
       cast(sum(hits) AS BIGINT) AS hits FROM (SELECT r.*, coalesce(h.hits, 0) AS hits FROM {recs} r LEFT JOIN (SELECT locus_id, count(*) AS hits FROM {tok} WHERE w LIKE '%dy' GROUP BY locus_id) h ON r.locus_id = h.locus_id) GROUP BY coalesce(il, '?')"""

BODIES["line_phase_rows_mod3"] = """
SELECT cast(r0 AS BIGINT) AS r0, cast(r1 AS BIGINT) AS r1, cast(r2 AS BIGINT) AS r2, count(*) AS lines FROM (
  SELECT locus_id, sum(CASE WHEN cp % 3 = 0 THEN 1 ELSE 0 END) % 3 AS r0, sum(CASE WHEN cp % 3 = 1 THEN 1 ELSE 0 END) % 3 AS r1, sum(CASE WHEN cp % 3 = 2 THEN 1 ELSE 0 END) % 3 AS r2 FROM {chars} GROUP BY locus_id) GROUP BY r0, r1, r2"""

# what a report says must add up: of every pair of figures, whether they are equal
BODIES["summary_validate"] = """
WITH i AS (SELECT count(*) AS records, cast(sum(nw) AS BIGINT) AS tokens, cast(sum(excluded) AS BIGINT) AS excluded FROM {recs}), t AS (SELECT cast(sum(n) AS BIGINT) AS tokens, cast(sum(n * len) AS BIGINT) AS letters FROM {types}),
b AS (SELECT cast(sum(n) AS BIGINT) AS tokens, cast(sum(r) AS BIGINT) AS records FROM (SELECT coalesce(il, '?') AS il, sum(nw) AS n, count(*) AS r FROM {recs} GROUP BY coalesce(il, '?'))),
s AS (SELECT cast(sum(n) AS BIGINT) AS tokens, count(*) AS groups, count(DISTINCT grp) AS distinct_groups FROM (SELECT grp, split, sum(nw) AS n FROM {recs} GROUP BY grp, split)), c AS (SELECT cast(sum(n) AS BIGINT) AS letters FROM {tchars}),
u AS (SELECT cast(sum(n * length(u)) AS BIGINT) AS letters FROM {tvisual}), e AS (SELECT count(*) AS records FROM {recs} WHERE coalesce(paragraph, false) OR NOT coalesce(paragraph, false))
SELECT 'tokens of records and types' AS rule, i.tokens = t.tokens AS holds FROM i CROSS JOIN t UNION ALL SELECT 'tokens by illustration', i.tokens = b.tokens AND i.records = b.records FROM i CROSS JOIN b
UNION ALL SELECT 'tokens by split', i.tokens = s.tokens FROM i CROSS JOIN s UNION ALL SELECT 'a group has one split', s.groups - s.distinct_groups <= 1 FROM s UNION ALL SELECT 'letters of types and of positions', t.letters = c.letters FROM t CROSS JOIN c
UNION ALL SELECT 'letters of units', t.letters = u.letters FROM t CROSS JOIN u UNION ALL SELECT 'reasons cover all records', i.records = e.records FROM i CROSS JOIN e"""
