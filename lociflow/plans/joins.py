"""Alignments, pattern and edit-distance joins, lexicon joins, bounds and the table cipher."""

BODIES: dict[str, str] = {}

_SIDES = """l AS (SELECT volume_id, folio, idx, min(locus_id) AS id FROM {recs} WHERE transcriber = 'QX' AND idx IS NOT NULL AND folio IS NOT NULL GROUP BY volume_id, folio, idx),
r AS (SELECT volume_id, folio, idx, min(locus_id) AS id FROM {recs} WHERE transcriber = 'MR' AND idx IS NOT NULL AND folio IS NOT NULL GROUP BY volume_id, folio, idx)"""

BODIES["align_full_outer"] = f"""
WITH {_SIDES} SELECT CASE WHEN r.id IS NULL THEN 'left_only' WHEN l.id IS NULL THEN 'right_only' ELSE 'aligned' END AS side, count(*) AS n
FROM l FULL OUTER JOIN r ON l.volume_id = r.volume_id AND l.folio = r.folio AND l.idx = r.idx
GROUP BY CASE WHEN r.id IS NULL THEN 'left_only' WHEN l.id IS NULL THEN 'right_only' ELSE 'aligned' END"""

BODIES["align_left_anti"] = f"""
WITH {_SIDES} SELECT l.volume_id, l.folio, l.idx, l.id FROM l LEFT JOIN r ON r.volume_id = l.volume_id AND r.folio = l.folio AND r.idx = l.idx WHERE r.id IS NULL"""
BODIES["align_right_anti"] = f"""
WITH {_SIDES} SELECT r.volume_id, r.folio, r.idx, r.id FROM r LEFT JOIN l ON r.volume_id = l.volume_id AND r.folio = l.folio AND r.idx = l.idx WHERE l.id IS NULL"""

BODIES["key_unique"] = """
SELECT volume_id, folio, idx, count(*) AS n FROM {recs} WHERE idx IS NOT NULL AND folio IS NOT NULL GROUP BY volume_id, folio, idx HAVING count(*) > 1"""

BODIES["next_record"] = """
SELECT locus_id, nxt FROM (SELECT locus_id, folio, idx, lead(locus_id) OVER (PARTITION BY volume_id ORDER BY source_order) AS nxt, lead(folio) OVER (PARTITION BY volume_id ORDER BY source_order) AS nf,
  lead(idx) OVER (PARTITION BY volume_id ORDER BY source_order) AS ni FROM {recs}) WHERE nf = folio AND ni = idx + 1"""

BODIES["asof_prev_line"] = """
SELECT locus_id, prev FROM (SELECT locus_id, lag(locus_id) OVER (PARTITION BY volume_id, folio ORDER BY source_order) AS prev FROM {recs}
  WHERE paragraph AND excluded = 0 AND nw >= 3 AND folio IS NOT NULL AND volume_id IS NOT NULL) WHERE prev IS NOT NULL"""

# the word above a word: the first of the line before that ends at its column or later; controls are as long as that one
COLUMN_ASOF = """
WITH sel AS (SELECT locus_id, lag(locus_id) OVER (PARTITION BY volume_id, folio ORDER BY source_order, locus_id) AS prev FROM {recs}
  WHERE paragraph AND excluded = 0 AND NOT coalesce(interrupted, false) AND nw >= 3 AND ll = 'B' AND split = 'test' AND folio IS NOT NULL AND volume_id IS NOT NULL),
wd AS (SELECT locus_id, wp, w, sum(length(w) + 1) OVER (PARTITION BY locus_id ORDER BY wp) AS upto FROM {tok}),
pick AS (SELECT s.locus_id, s.prev, t.wp, t.w, coalesce(min(CASE WHEN p.upto >= t.upto - length(t.w) - 1 THEN p.wp END), least(max(p.wp), t.wp)) AS k FROM sel s JOIN wd t ON s.locus_id = t.locus_id JOIN wd p ON s.prev = p.locus_id GROUP BY s.locus_id, s.prev, t.wp, t.w, t.upto),
above AS (SELECT q.locus_id, q.prev, q.wp, q.w, q.k, y.w AS y FROM pick q JOIN wd y ON q.prev = y.locus_id AND q.k = y.wp),
ctl AS (SELECT a.locus_id, a.wp, max(1 - levenshtein(a.w, a.y) / cast(greatest(length(a.w), length(a.y)) AS DOUBLE)) AS own, avg(1 - levenshtein(a.w, c.w) / cast(greatest(length(a.w), length(c.w)) AS DOUBLE)) AS control
  FROM above a JOIN wd c ON a.prev = c.locus_id AND c.wp <> a.k AND length(c.w) = length(a.y) GROUP BY a.locus_id, a.wp)
SELECT (SELECT count(*) FROM above) AS candidates, (SELECT count(*) FROM above WHERE w = y) AS equal, count(*) AS targets, round(avg(own - control), 6) AS excess FROM ctl"""

BODIES["discovery_anti"] = """
SELECT r.folio, count(*) AS records FROM {recs} r WHERE r.grp IS NOT NULL AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT grp FROM {tok} WHERE w = 'ytaiyteeg') d WHERE d.grp = r.grp) GROUP BY r.folio"""

BODIES["near_line_join"] = """
SELECT count(*) AS pairs, count(*) FILTER (WHERE a.w = b.w) AS equal, count(*) FILTER (WHERE levenshtein(a.w, b.w) <= 1) AS near
FROM (SELECT * FROM {tok} WHERE paragraph AND excluded = 0 AND nw >= 3) a JOIN {tok} b ON a.locus_id = b.locus_id AND a.wp < b.wp"""

# words within one edit share a word with one letter deleted, or one is the other with one deleted
BODIES["edit1_vocab"] = """
WITH v AS (SELECT DISTINCT w FROM {types}), k AS (SELECT w, w AS k FROM v UNION SELECT w, substr(w, 1, cast(cp AS INT)) || substr(w, cast(cp AS INT) + 2) FROM {letters})
SELECT DISTINCT a.w AS a, b.w AS b FROM k a JOIN k b ON a.k = b.k AND a.w < b.w WHERE levenshtein(a.w, b.w) = 1"""

# cipher types are the validation words, the lexicon the train words; candidates of a type have its pattern of repeats
_SAMPLES = """lex AS (SELECT w, n AS c, pattern FROM {types} WHERE split = 'train'), cip AS (SELECT w, n AS c, pattern FROM {types} WHERE split = 'validation'),
n AS (SELECT count(*) AS t, cast(sum(c) AS BIGINT) AS k FROM cip)"""

BODIES["pattern_join"] = f"""
WITH {_SAMPLES}
SELECT c.w, c.c, coalesce(l.n, 0) AS candidates FROM cip c LEFT JOIN (SELECT pattern, count(*) AS n FROM lex GROUP BY pattern) l ON c.pattern = l.pattern"""

BODIES["bound_independent"] = f"""
WITH {_SAMPLES} SELECT count(*) AS types, cast(sum(c * t + k) AS BIGINT) AS total, cast(sum(CASE WHEN l.pattern IS NOT NULL THEN c * t + k ELSE 0 END) AS BIGINT) AS bound
FROM cip CROSS JOIN n LEFT JOIN (SELECT DISTINCT pattern FROM lex) l ON cip.pattern = l.pattern"""

BODIES["objective_weights"] = f"""
WITH {_SAMPLES} SELECT w, c, cast(c * t + k AS BIGINT) AS weight, cast(2 * t * k AS BIGINT) AS denominator FROM cip CROSS JOIN n"""

BODIES["symbol_order"] = f"""
WITH {_SAMPLES}, u AS (SELECT DISTINCT w, ch FROM {{letters}})
SELECT ch, weight, cast(row_number() OVER (ORDER BY weight DESC, ch) AS BIGINT) AS place FROM (SELECT u.ch, cast(sum(c.c * n.t + n.k) AS BIGINT) AS weight FROM cip c JOIN u ON c.w = u.w CROSS JOIN n GROUP BY u.ch)"""

BODIES["bound_pivot"] = f"""
WITH {_SAMPLES}, first_of AS (SELECT w, ch, min(cp) AS cp FROM {{letters}} GROUP BY w, ch),
piv AS (SELECT w, ch AS p, cp FROM (SELECT w, ch, cp, row_number() OVER (PARTITION BY w ORDER BY ch) AS r FROM first_of) WHERE r = 1),
val AS (SELECT DISTINCT x.pattern, l.cp, l.ch AS v FROM lex x JOIN {{letters}} l ON x.w = l.w),
cand AS (SELECT piv.p, val.v, c.c * n.t + n.k AS weight FROM cip c CROSS JOIN n JOIN piv ON c.w = piv.w JOIN val ON c.pattern = val.pattern AND piv.cp = val.cp)
SELECT p AS pivot_unit, cast(max(s) AS BIGINT) AS bound FROM (SELECT p, v, sum(weight) AS s FROM cand GROUP BY p, v) GROUP BY p"""

_KEY = """freq AS (SELECT split, ch, sum(n) AS n FROM {tchars} WHERE split IN ('train', 'validation') GROUP BY split, ch),
rk AS (SELECT split, ch, row_number() OVER (PARTITION BY split ORDER BY n DESC, ch) AS k FROM freq),
key AS (SELECT a.ch AS u, b.ch AS letter FROM rk a JOIN rk b ON a.k = b.k WHERE a.split = 'validation' AND b.split = 'train')"""

BODIES["frequency_key"] = f"WITH {_KEY} SELECT u, letter FROM key"

BODIES["key_validate"] = f"WITH {_KEY} SELECT letter, count(*) AS n FROM key GROUP BY letter HAVING count(*) > 1"

BODIES["recovery_metrics"] = f"""
WITH {_KEY}, fit AS (SELECT DISTINCT ch FROM {{tchars}} WHERE split = 'validation'),
c AS (SELECT t.w, t.n, CASE WHEN k.letter = t.ch THEN 1 ELSE 0 END AS good, CASE WHEN k.letter IS NULL THEN 0 ELSE 1 END AS mapped, CASE WHEN fit.ch IS NULL THEN 0 ELSE 1 END AS seen
  FROM {{tchars}} t LEFT JOIN key k ON t.ch = k.u LEFT JOIN fit ON t.ch = fit.ch WHERE t.split = 'test'),
w AS (SELECT w, max(n) AS n, min(good) AS good, min(seen) AS seen FROM c GROUP BY w)
SELECT cast(sum(n) AS BIGINT) AS positions, cast(sum(n * mapped) AS BIGINT) AS mapped, cast(sum(n * good) AS BIGINT) AS correct, round(sum(n * good) / nullif(cast(sum(n * mapped) AS DOUBLE), 0), 6) AS accuracy,
  max(words.t) AS words, max(words.g) AS words_correct, round(max(words.g) / nullif(cast(max(words.t) AS DOUBLE), 0), 6) AS word_accuracy, (SELECT count(*) FROM key WHERE u = letter) AS correct_keys
FROM c CROSS JOIN (SELECT cast(sum(n) AS BIGINT) AS t, cast(sum(n * good) AS BIGINT) AS g FROM w) words"""

# what the key makes of the units that the validation words show, on the test words: all positions, and those it could know
_OBSERVED = """fit AS (SELECT DISTINCT ch FROM {tchars} WHERE split = 'validation'), eff AS (SELECT key.u, key.letter FROM key JOIN fit ON key.u = fit.ch),
c AS (SELECT t.w, t.n, CASE WHEN k.letter = t.ch THEN 1 ELSE 0 END AS good, CASE WHEN fit.ch IS NULL THEN 0 ELSE 1 END AS seen FROM {tchars} t LEFT JOIN eff k ON t.ch = k.u LEFT JOIN fit ON t.ch = fit.ch WHERE t.split = 'test'),
w AS (SELECT w, max(n) AS n, min(good) AS good, min(seen) AS seen FROM c GROUP BY w),
m AS (SELECT p.*, q.* FROM (SELECT coalesce(cast(sum(n) AS BIGINT), 0) AS chars, coalesce(cast(sum(n * good) AS BIGINT), 0) AS chars_correct, coalesce(cast(sum(n * seen) AS BIGINT), 0) AS observed, coalesce(cast(sum(n * seen * good) AS BIGINT), 0) AS observed_correct FROM c) p
  CROSS JOIN (SELECT coalesce(cast(sum(n) AS BIGINT), 0) AS tokens, coalesce(cast(sum(n * good) AS BIGINT), 0) AS tokens_correct, coalesce(cast(sum(n * seen) AS BIGINT), 0) AS whole, coalesce(cast(sum(n * seen * good) AS BIGINT), 0) AS whole_correct FROM w) q)"""

BODIES["recovery_fit_observed"] = f"""
WITH {_KEY}, {_OBSERVED} SELECT *, chars - observed AS unobserved, round(observed_correct / nullif(cast(observed AS DOUBLE), 0), 6) AS observed_accuracy, round(whole_correct / nullif(cast(whole AS DOUBLE), 0), 6) AS whole_accuracy FROM m"""

BODIES["accuracy_gate"] = f"""
WITH {_KEY}, {_OBSERVED} SELECT CASE WHEN observed > 0 THEN observed_correct = observed END AS observed_positions_pass, CASE WHEN whole > 0 THEN whole_correct = whole END AS fully_observed_tokens_pass,
  CASE WHEN chars > 0 AND tokens > 0 THEN chars_correct = chars AND tokens_correct = tokens END AS full_decoding_pass FROM m"""

_DECODED = """plain AS (SELECT l.w, spell_(coalesce(k.letter, '?') BY l.cp)_ AS x, min(CASE WHEN k.letter IS NULL THEN 0 ELSE 1 END) AS mapped FROM {letters} l LEFT JOIN key k ON l.ch = k.u GROUP BY l.w),
hit AS (SELECT c.w, c.n, p.x, p.mapped, CASE WHEN l.w IS NULL THEN 0 ELSE 1 END AS hit FROM {types} c JOIN plain p ON c.w = p.w LEFT JOIN (SELECT w FROM {types} WHERE split = 'train') l ON p.x = l.w WHERE c.split = 'validation')"""

BODIES["lexicon_hits"] = f"""
WITH {_KEY}, {_DECODED}, miss AS (SELECT cast(sum(t.n) AS BIGINT) AS missing FROM {{tchars}} t LEFT JOIN key k ON t.ch = k.u WHERE t.split = 'validation' AND k.u IS NULL)
SELECT count(*) AS types, cast(sum(mapped) AS BIGINT) AS mapped_types, cast(sum(hit) AS BIGINT) AS type_hits, cast(sum(n) AS BIGINT) AS tokens, cast(sum(n * mapped) AS BIGINT) AS mapped_tokens, cast(sum(n * hit) AS BIGINT) AS token_hits,
  coalesce(max(miss.missing), 0) AS missing_occurrences FROM hit CROSS JOIN miss"""

BODIES["lexical_coverage"] = f"""
WITH {_KEY}, {_DECODED} SELECT cast(sum(n) AS BIGINT) AS tokens, cast(sum(n * mapped) AS BIGINT) AS fully_mapped, cast(sum(n * hit) AS BIGINT) AS hits, round(sum(n * hit) / nullif(cast(sum(n) AS DOUBLE), 0), 6) AS rate FROM hit"""

BODIES["semi_lexicon"] = f"WITH {_KEY}, {_DECODED} SELECT w, x FROM hit WHERE hit = 1"

BODIES["apply_key"] = f"""
WITH {_KEY} SELECT coalesce(k.letter, '?') AS letter, cast(sum(c.n) AS BIGINT) AS n FROM (SELECT * FROM {{tchars}} WHERE split = 'validation') c LEFT JOIN key k ON c.ch = k.u GROUP BY coalesce(k.letter, '?')"""

BODIES["encode_injective"] = """
SELECT translate(w, 'abcdefghijklmnopqrstuvwxyz', 'qwertyuiopasdfghjklzxcvbnm') AS x, cast(sum(n) AS BIGINT) AS n FROM {types} GROUP BY translate(w, 'abcdefghijklmnopqrstuvwxyz', 'qwertyuiopasdfghjklzxcvbnm')"""

BODIES["encode_homophonic"] = """
WITH one AS (SELECT split, ch, floor(locus_id / 65536) AS blk, row_number() OVER (PARTITION BY split, ch, floor(locus_id / 65536) ORDER BY locus_id, wp, cp) - 1 AS k FROM {chars} WHERE split IS NOT NULL),
tot AS (SELECT split, ch, blk, count(*) AS n FROM one GROUP BY split, ch, blk), base AS (SELECT split, ch, blk, sum(n) OVER (PARTITION BY split, ch ORDER BY blk) - n AS base FROM tot)
SELECT o.ch, o.ch || cast(cast((b.base + o.k) % (1 + ascii(o.ch) % 3) AS INT) AS STRING) AS emitted, count(*) AS n FROM one o JOIN base b ON o.split = b.split AND o.ch = b.ch AND o.blk = b.blk
GROUP BY o.ch, o.ch || cast(cast((b.base + o.k) % (1 + ascii(o.ch) % 3) AS INT) AS STRING)"""

BODIES["quotient_map"] = """
SELECT q, cast(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN u IN ('cth', 'ckh', 'cph', 'cfh') THEN 'G' WHEN u IN ('ch', 'sh') THEN 'C' ELSE u END AS q FROM {tvisual}) GROUP BY q"""

# candidates under capacity are told by patterns: of each pattern one word stands for all
CAPACITY_JOIN = f"""
WITH {_SAMPLES}, cp_ AS (SELECT pattern, min(w) AS w, count(*) AS n FROM cip GROUP BY pattern), lp AS (SELECT pattern, min(w) AS w, count(*) AS n FROM lex GROUP BY pattern),
dl AS (SELECT w, count(DISTINCT ch) AS d FROM {{letters}} GROUP BY w),
pairs AS (SELECT c.w, l.w AS x FROM cp_ c JOIN dl a ON c.w = a.w JOIN lp l ON length(c.w) = length(l.w) JOIN dl b ON l.w = b.w WHERE b.d <= a.d AND 2 * b.d >= a.d),
m AS (SELECT DISTINCT p.w, p.x, a.ch AS u, b.ch AS v FROM pairs p JOIN {{letters}} a ON p.w = a.w JOIN {{letters}} b ON p.x = b.w AND a.cp = b.cp),
bad AS (SELECT w, x FROM (SELECT w, x, u FROM m GROUP BY w, x, u HAVING count(*) > 1) UNION SELECT w, x FROM (SELECT w, x, v FROM m GROUP BY w, x, v HAVING count(*) > 2)),
ok AS (SELECT p.w, p.x FROM pairs p LEFT JOIN bad b ON p.w = b.w AND p.x = b.x WHERE b.w IS NULL),
k AS (SELECT c.pattern, cast(sum(l.n) AS BIGINT) AS n FROM ok JOIN cp_ c ON ok.w = c.w JOIN lp l ON ok.x = l.w GROUP BY c.pattern)
SELECT cip.w, coalesce(k.n, 0) AS candidates FROM cip LEFT JOIN k ON cip.pattern = k.pattern"""

BODIES["candidate_compat"] = f"""
WITH {_SAMPLES}, {_KEY}, part AS (SELECT u, letter FROM key WHERE u IN ('a', 'o', 'y')),
mc AS (SELECT l.w, spell_(coalesce(p.u, '-') BY l.cp)_ AS mask FROM {{letters}} l LEFT JOIN part p ON l.ch = p.u GROUP BY l.w),
ml AS (SELECT l.w, spell_(coalesce(p.u, '-') BY l.cp)_ AS mask FROM {{letters}} l LEFT JOIN part p ON l.ch = p.letter GROUP BY l.w),
every AS (SELECT pattern, count(*) AS n FROM lex GROUP BY pattern), fit AS (SELECT lex.pattern, ml.mask, count(*) AS n FROM lex JOIN ml ON lex.w = ml.w GROUP BY lex.pattern, ml.mask)
SELECT cast(sum(e.n) AS BIGINT) AS candidates, cast(sum(coalesce(f.n, 0)) AS BIGINT) AS compatible FROM cip c JOIN mc ON c.w = mc.w JOIN every e ON c.pattern = e.pattern LEFT JOIN fit f ON c.pattern = f.pattern AND mc.mask = f.mask"""

#: Rows of each state of the code book: six tables of 23 letters.
CODES = 138
# A code book by rule: the most frequent beginnings, ends and whole words of the corpus stand for the letters of six tables.
# Numbers of a word's readings: codes of one word, and every cut into a prefix and a suffix code.
DERIVED: dict[str, str] = {}
DERIVED["book"] = f"""
WITH part AS (SELECT 'prefix' AS state, substr(w, 1, k) AS glyphs, sum(n) AS n FROM {{types}} CROSS JOIN (VALUES (1), (2), (3)) AS x(k) WHERE k < len GROUP BY substr(w, 1, k)
  UNION ALL SELECT 'suffix', substr(w, cast(len AS INT) - k + 1, k), sum(n) FROM {{types}} CROSS JOIN (VALUES (1), (2), (3)) AS x(k) WHERE k < len GROUP BY substr(w, cast(len AS INT) - k + 1, k)
  UNION ALL SELECT 'unigram', w, sum(n) FROM {{types}} GROUP BY w),
r AS (SELECT state, glyphs, row_number() OVER (PARTITION BY state ORDER BY n DESC, glyphs) - 1 AS r FROM part)
SELECT state, glyphs, cast(floor(r / 23) AS INT) AS tbl, substr('abcdefghilmnopqrstuvxyz', cast(r % 23 AS INT) + 1, 1) AS letter FROM r WHERE r < {CODES}"""
DERIVED["reads"] = """
WITH t AS (SELECT w, cast(sum(n) AS BIGINT) AS n FROM {types} GROUP BY w), at_ AS (SELECT DISTINCT w, cast(cp AS INT) AS k FROM {letters} WHERE cp > 0)
SELECT t.w, t.n, b.letter AS plain, b.tbl AS table_a, -1 AS table_b FROM t JOIN {book} b ON b.state = 'unigram' AND t.w = b.glyphs
UNION ALL SELECT t.w, t.n, p.letter || s.letter, p.tbl, s.tbl FROM t JOIN at_ ON t.w = at_.w JOIN {book} p ON p.state = 'prefix' AND substr(t.w, 1, at_.k) = p.glyphs JOIN {book} s ON s.state = 'suffix' AND substr(t.w, at_.k + 1) = s.glyphs"""

BODIES["split_join"] = "SELECT w, n, plain, table_a, table_b, count(*) AS cuts FROM {reads} GROUP BY w, n, plain, table_a, table_b"

BODIES["collision_catalog"] = """
SELECT p.glyphs || s.glyphs AS token, count(*) AS readings, count(DISTINCT p.letter || s.letter) AS plaintexts FROM (SELECT * FROM {book} WHERE state = 'prefix') p CROSS JOIN (SELECT * FROM {book} WHERE state = 'suffix') s GROUP BY p.glyphs || s.glyphs"""

BODIES["ambiguity_flags"] = """
SELECT w, count(*) AS readings, count(DISTINCT plain) AS plaintexts, count(DISTINCT plain) > 1 AS plaintext_ambiguous, count(*) > count(DISTINCT plain) AS table_ambiguous FROM {reads} GROUP BY w"""

BODIES["compat_agg"] = """
WITH t AS (SELECT w, cast(sum(n) AS BIGINT) AS n FROM {types} GROUP BY w), r AS (SELECT w, count(*) AS k, count(DISTINCT plain) AS p FROM {reads} GROUP BY w),
x AS (SELECT t.w, t.n, coalesce(r.k, 0) AS k, coalesce(r.p, 0) AS p FROM t LEFT JOIN r ON t.w = r.w)
SELECT cast(sum(n) AS BIGINT) AS tokens, count(*) AS types, cast(sum(CASE WHEN k > 0 THEN n ELSE 0 END) AS BIGINT) AS parseable_tokens, count(*) FILTER (WHERE k > 0) AS parseable_types,
  cast(sum(CASE WHEN k = 0 THEN n ELSE 0 END) AS BIGINT) AS no_parse_tokens, count(*) FILTER (WHERE k = 0) AS no_parse_types, cast(sum(CASE WHEN k > 1 THEN n ELSE 0 END) AS BIGINT) AS ambiguous_tokens,
  count(*) FILTER (WHERE k > 1) AS ambiguous_types, cast(sum(CASE WHEN p > 1 THEN n ELSE 0 END) AS BIGINT) AS plaintext_ambiguous_tokens, cast(sum(CASE WHEN k > p THEN n ELSE 0 END) AS BIGINT) AS table_ambiguous_tokens,
  round(sum(n * k) / cast(sum(n) AS DOUBLE), 6) AS mean_candidates, cast(max(k) AS BIGINT) AS max_candidates FROM x"""

# runs of words with one plain text each, within a line; a word with none or with several ends a run
BODIES["runs_islands"] = """
WITH r AS (SELECT w, count(DISTINCT plain) AS p, min(length(plain)) AS m FROM {reads} GROUP BY w),
t AS (SELECT t.locus_id, t.wp, coalesce(r.p, 0) AS p, coalesce(r.m, 0) AS m FROM {tok} t LEFT JOIN r ON t.w = r.w),
i AS (SELECT locus_id, p, m, sum(CASE WHEN p = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY locus_id ORDER BY wp) AS island FROM t),
run AS (SELECT locus_id, island, sum(m) AS chars FROM i WHERE p = 1 GROUP BY locus_id, island)
SELECT count(*) FILTER (WHERE chars >= 8) AS runs, coalesce(cast(sum(CASE WHEN chars >= 8 THEN chars END) AS BIGINT), 0) AS kept_characters, count(*) FILTER (WHERE chars < 8) AS short_runs,
  (SELECT count(*) FROM t WHERE p > 1) AS ambiguous, (SELECT count(*) FROM t WHERE p = 0) AS no_parse FROM run"""

BODIES["focus_rows"] = f"""
WITH {_SIDES}, page AS (SELECT folio, volume_id FROM l GROUP BY folio, volume_id ORDER BY count(*) DESC, volume_id, folio LIMIT 1)
SELECT k.idx, max(k.lid) AS left_id, max(k.rid) AS right_id FROM (SELECT l.volume_id, l.folio, l.idx, l.id AS lid, NULL AS rid FROM l UNION ALL SELECT r.volume_id, r.folio, r.idx, NULL, r.id FROM r) k
JOIN page p ON k.volume_id = p.volume_id AND k.folio = p.folio GROUP BY k.idx"""

# words outside of the groups in which they were found; first reason that applies
_OUTSIDE = """f AS (SELECT folio, grp, max(il) AS il, max(ql) AS ql, cast(sum(nw) AS BIGINT) AS nw FROM {recs} WHERE folio IS NOT NULL AND grp IS NOT NULL GROUP BY folio, grp),
disc AS (SELECT DISTINCT grp FROM {tok} WHERE w = 'ytaiyteeg' AND grp IS NOT NULL), hit AS (SELECT r.folio, r.grp, count(*) AS n FROM {tok} t JOIN {recs} r ON t.locus_id = r.locus_id WHERE t.w = 'maidy' GROUP BY r.folio, r.grp),
r AS (SELECT f.*, CASE WHEN disc.grp IS NOT NULL THEN 'discovery_group' WHEN f.il IS NULL THEN 'missing_metadata' WHEN f.il <> 'H' THEN 'nonherbal' WHEN f.nw = 0 THEN 'missing_text' ELSE 'kept' END AS reason FROM f LEFT JOIN disc ON f.grp = disc.grp)"""

BODIES["elig_blue"] = f"WITH {_OUTSIDE} SELECT reason, count(*) AS folios, count(DISTINCT grp) AS groups, cast(sum(nw) AS BIGINT) AS tokens FROM r GROUP BY reason"

BODIES["blue_words"] = f"""
WITH {_OUTSIDE} SELECT CASE WHEN r.ql IS NULL THEN 'no_tag' ELSE 'tag' END AS category, count(*) AS folios, count(DISTINCT r.grp) AS groups, cast(sum(r.nw) AS BIGINT) AS tokens, cast(sum(coalesce(hit.n, 0)) AS BIGINT) AS hits,
  count(hit.n) AS folios_with_hits FROM r LEFT JOIN hit ON r.folio = hit.folio AND r.grp = hit.grp WHERE r.reason = 'kept' GROUP BY CASE WHEN r.ql IS NULL THEN 'no_tag' ELSE 'tag' END"""

BODIES["key_intersect"] = f"WITH {_SIDES} SELECT volume_id, folio, idx FROM l INTERSECT SELECT volume_id, folio, idx FROM r"
BODIES["key_except"] = f"WITH {_SIDES} SELECT 'left' AS side, volume_id, folio, idx FROM (SELECT volume_id, folio, idx FROM l EXCEPT SELECT volume_id, folio, idx FROM r) UNION ALL SELECT 'right', volume_id, folio, idx FROM (SELECT volume_id, folio, idx FROM r EXCEPT SELECT volume_id, folio, idx FROM l)"

BODIES["union_sources"] = """
SELECT transcriber, count(*) AS records, cast(sum(nw) AS BIGINT) AS tokens FROM (SELECT transcriber, nw FROM {recs} WHERE transcriber = 'QX' UNION ALL SELECT transcriber, nw FROM {recs} WHERE transcriber = 'MR') GROUP BY transcriber"""

# the nearest words of a lexicon, all that tie
BODIES["nearest_key"] = """
WITH q AS (SELECT w FROM (SELECT w, sum(n) AS n FROM {types} WHERE split = 'test' GROUP BY w ORDER BY n DESC, w LIMIT 200)), k AS (SELECT w, n FROM (SELECT w, sum(n) AS n FROM {types} WHERE split = 'train' GROUP BY w ORDER BY n DESC, w LIMIT 1000)),
x AS (SELECT q.w, k.w AS near, levenshtein(q.w, k.w) AS d FROM q CROSS JOIN k), m AS (SELECT w, min(d) AS d FROM x GROUP BY w)
SELECT x.w, cast(m.d AS BIGINT) AS distance, count(*) AS ties, min(x.near) AS first_tie FROM x JOIN m ON x.w = m.w AND x.d = m.d GROUP BY x.w, m.d"""

# shifts of cyclic positions: a letter's place plus one shift modulo the alphabet, for each split's most frequent letters
BODIES["shift_counts"] = """
WITH l AS (SELECT split, ch, row_number() OVER (PARTITION BY split ORDER BY sum(n) DESC, ch) AS k FROM {tchars} WHERE split IN ('train', 'test') GROUP BY split, ch)
SELECT (ascii(b.ch) - ascii(a.ch) + 26) % 26 AS shift, count(*) AS n FROM l a JOIN l b ON a.k = b.k WHERE a.split = 'train' AND b.split = 'test' GROUP BY (ascii(b.ch) - ascii(a.ch) + 26) % 26"""
