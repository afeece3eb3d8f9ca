"""Conditional models: character n-grams, word bigrams, boundaries, local memory; and inference on them.

Add-alpha estimates come from grouped counts joined on the left, so a context never seen keeps the uniform value.
Randomised nulls order rows by integer or md5 keys of (seed, replicate, row), the same in any engine and partitioning.
"""

from lociflow.operators.resample import sql_key

BODIES: dict[str, str] = {}

#: Relations that a study reads several times; Spark writes them once to the shared folder.
DERIVED: dict[str, str] = {}

#: Replicates of the reference: permutations of words in lines, bootstrap draws, nulls of word ends, and keys at random.
PERMUTATIONS, DRAWS, NULLS, KEYS = 499, 499, 99, 32


def _replicates(n: int) -> str:
    """The numbers 0 to n - 1 as relation r(r)."""
    return f"(SELECT i - 1 AS r FROM (SELECT explode_({n}) AS i FROM (VALUES (0)) AS z(z)) AS x) AS r"


# symbols of a word with its end; unknown ones (not in train) become '?' before contexts are built
# Events come from distinct words with their counts, so histories are read off a few types, not off all tokens.
DERIVED["ngram_events"] = """
WITH ty AS (SELECT split, w, n FROM {types} WHERE split IS NOT NULL),
pos AS (SELECT split, w, n, explode_(length(w) + 1) AS i FROM ty),
raw AS (SELECT split, w, n, i, CASE WHEN i > length(w) THEN '$' ELSE substr(w, cast(i AS INT), 1) END AS ch FROM pos),
known AS (SELECT DISTINCT ch FROM raw WHERE split = 'train'),
sym AS (SELECT r.split, r.w, r.n, r.i, CASE WHEN k.ch IS NULL THEN '?' ELSE r.ch END AS s FROM raw r LEFT JOIN known k ON r.ch = k.ch),
ev AS (SELECT split, n, s, coalesce(lag(s, 1) OVER w, '^') AS h1, coalesce(lag(s, 2) OVER w, '^') AS h2, coalesce(lag(s, 3) OVER w, '^') AS h3 FROM sym WINDOW w AS (PARTITION BY split, w ORDER BY i))
SELECT split, h3, h2, h1, s, cast(sum(n) AS BIGINT) AS n FROM ev GROUP BY split, h3, h2, h1, s"""

_SYMBOLS = """oev AS (SELECT split, 0 AS k, '' AS h, s, sum(n) AS n FROM {ngram_events} GROUP BY split, s UNION ALL SELECT split, 1, h1, s, sum(n) FROM {ngram_events} GROUP BY split, h1, s
        UNION ALL SELECT split, 2, h2 || h1, s, sum(n) FROM {ngram_events} GROUP BY split, h2, h1, s UNION ALL SELECT split, 3, h3 || h2 || h1, s, n FROM {ngram_events}),
fit AS (SELECT k, h, s, n FROM oev WHERE split = 'train'), tot AS (SELECT k, h, cast(sum(n) AS DOUBLE) AS t FROM fit GROUP BY k, h), v AS (SELECT count(DISTINCT s) + 1 AS v FROM {ngram_events} WHERE split = 'train')"""

BODIES["ngram_fit"] = f"""
WITH {_SYMBOLS} SELECT cast(k AS BIGINT) AS k, h, s, cast(n AS BIGINT) AS n FROM fit"""

BODIES["ngram_score"] = f"""
WITH {_SYMBOLS}, sc AS (SELECT e.split, e.k, e.n, e.s, -log2((coalesce(f.n, 0) + 1e-1) / (coalesce(t.t, 0e0) + 1e-1 * v.v)) AS bits
  FROM oev e LEFT JOIN fit f ON e.k = f.k AND e.h = f.h AND e.s = f.s LEFT JOIN tot t ON e.k = t.k AND e.h = t.h CROSS JOIN v WHERE e.split <> 'train')
SELECT split, cast(k AS BIGINT) AS k, cast(sum(n) AS BIGINT) AS predicted, round(sum(n * bits) / sum(n), 6) AS bits_per_symbol, round(power(2, sum(n * bits) / sum(n)), 5) AS perplexity,
  cast(sum(CASE WHEN s = '$' THEN n ELSE 0 END) AS BIGINT) AS ends, cast(sum(CASE WHEN s = '?' THEN n ELSE 0 END) AS BIGINT) AS unknown FROM sc GROUP BY split, k"""

# Windows of four over each split's stream. Records, not letters, are numbered and ordered: a record's letters with the
# first three that follow it, from the next three records at most, hold all windows that begin in it. Numbers run in
# ranges of ids with their totals in front; each part of 65,536 records also holds the first three of the next.
DERIVED["stream4"] = """
WITH nz AS (SELECT split, locus_id, floor(locus_id / 65536) AS b, replace(array_to_string_(words), ' ', '') AS s FROM {recs} WHERE split IS NOT NULL AND nw > 0),
tot AS (SELECT split, b, count(*) AS n FROM nz GROUP BY split, b), base AS (SELECT split, b, sum(n) OVER (PARTITION BY split ORDER BY b) - n AS base FROM tot),
inside AS (SELECT split, b, s, row_number() OVER (PARTITION BY split, b ORDER BY locus_id) - 1 AS k FROM nz),
num AS (SELECT i.split, i.s, cast(t.base + i.k AS BIGINT) AS k FROM inside i JOIN base t ON i.split = t.split AND i.b = t.b),
part AS (SELECT split, s, k, floor(k / 65536) AS p, 0 AS halo FROM num UNION ALL SELECT split, s, k, floor(k / 65536) - 1, 1 FROM num WHERE k % 65536 < 3 AND k >= 65536),
nxt AS (SELECT split, s, halo, coalesce(lead(s, 1) OVER w, '') || coalesce(lead(s, 2) OVER w, '') || coalesce(lead(s, 3) OVER w, '') AS rest FROM part WINDOW w AS (PARTITION BY split, p ORDER BY k)),
ext AS (SELECT split, s || substr(rest, 1, 3) AS t, length(s) AS m FROM nxt WHERE halo = 0),
win AS (SELECT split, t, explode_(least(m, length(t) - 3)) AS i FROM ext WHERE length(t) > 3),
g AS (SELECT split, substr(t, cast(i AS INT), 4) AS x FROM win)
SELECT split, substr(x, 1, 1) AS a, substr(x, 2, 1) AS b, substr(x, 3, 1) AS c, substr(x, 4, 1) AS d, n FROM (SELECT split, x, count(*) AS n FROM g GROUP BY split, x)"""

_STREAM = """f4 AS (SELECT a, b, c, d, n FROM {stream4} WHERE split = 'train'), f3 AS (SELECT b, c, d, sum(n) AS n FROM f4 GROUP BY b, c, d),
f2 AS (SELECT c, d, sum(n) AS n FROM f4 GROUP BY c, d), f1 AS (SELECT d, sum(n) AS n FROM f4 GROUP BY d),
t1 AS (SELECT cast(sum(n) AS DOUBLE) AS t FROM f1), t2 AS (SELECT c, sum(n) AS t FROM f2 GROUP BY c), t3 AS (SELECT b, c, sum(n) AS t FROM f3 GROUP BY b, c), t4 AS (SELECT a, b, c, sum(n) AS t FROM f4 GROUP BY a, b, c)"""

BODIES["sliding_4gram"] = f"""
WITH {_STREAM}, ev AS (SELECT * FROM {{stream4}} WHERE split <> 'train'),
p AS (SELECT ev.split, ev.n, 1e-1 * (coalesce(f1.n, 0) + 1e-1) / (t1.t + 26e-1) + 2e-1 * (coalesce(f2.n, 0) + 1e-1) / (coalesce(t2.t, 0) + 26e-1)
   + 3e-1 * (coalesce(f3.n, 0) + 1e-1) / (coalesce(t3.t, 0) + 26e-1) + 4e-1 * (coalesce(f4.n, 0) + 1e-1) / (coalesce(t4.t, 0) + 26e-1) AS p
 FROM ev CROSS JOIN t1 LEFT JOIN f1 ON ev.d = f1.d LEFT JOIN f2 ON ev.c = f2.c AND ev.d = f2.d LEFT JOIN t2 ON ev.c = t2.c LEFT JOIN f3 ON ev.b = f3.b AND ev.c = f3.c AND ev.d = f3.d
 LEFT JOIN t3 ON ev.b = t3.b AND ev.c = t3.c LEFT JOIN f4 ON ev.a = f4.a AND ev.b = f4.b AND ev.c = f4.c AND ev.d = f4.d LEFT JOIN t4 ON ev.a = t4.a AND ev.b = t4.b AND ev.c = t4.c)
SELECT split, cast(sum(n) AS BIGINT) AS windows, round(-sum(n * log2(p)) / sum(n), 6) AS bits FROM p GROUP BY split"""

#: The declared letters; a window with any other costs log2(26) and stays in the denominator. Fixed value.
DECLARED = "abcdefghiklmnopqrsty"

BODIES["window_model"] = f"""
WITH {_STREAM} SELECT f4.a, f4.b, f4.c, f4.d, round(-log2(1e-1 * (f1.n + 1e-1) / (t1.t + 26e-1) + 2e-1 * (f2.n + 1e-1) / (t2.t + 26e-1) + 3e-1 * (f3.n + 1e-1) / (t3.t + 26e-1) + 4e-1 * (f4.n + 1e-1) / (t4.t + 26e-1)), 6) AS cost
FROM f4 CROSS JOIN t1 JOIN f1 ON f4.d = f1.d JOIN f2 ON f4.c = f2.c AND f4.d = f2.d JOIN t2 ON f4.c = t2.c JOIN f3 ON f4.b = f3.b AND f4.c = f3.c AND f4.d = f3.d
JOIN t3 ON f4.b = t3.b AND f4.c = t3.c JOIN t4 ON f4.a = t4.a AND f4.b = t4.b AND f4.c = t4.c"""

BODIES["unknown_window"] = f"""
WITH {_STREAM}, u AS (SELECT split, n, CASE WHEN instr('{DECLARED}', a) = 0 OR instr('{DECLARED}', b) = 0 OR instr('{DECLARED}', c) = 0 OR instr('{DECLARED}', d) = 0 THEN 1 ELSE 0 END AS unk, a, b, c, d FROM {{stream4}} WHERE split <> 'train'),
ev AS (SELECT * FROM u WHERE unk = 0),
p AS (SELECT ev.split, ev.n, 1e-1 * (coalesce(f1.n, 0) + 1e-1) / (t1.t + 26e-1) + 2e-1 * (coalesce(f2.n, 0) + 1e-1) / (coalesce(t2.t, 0) + 26e-1)
   + 3e-1 * (coalesce(f3.n, 0) + 1e-1) / (coalesce(t3.t, 0) + 26e-1) + 4e-1 * (coalesce(f4.n, 0) + 1e-1) / (coalesce(t4.t, 0) + 26e-1) AS p
 FROM ev CROSS JOIN t1 LEFT JOIN f1 ON ev.d = f1.d LEFT JOIN f2 ON ev.c = f2.c AND ev.d = f2.d LEFT JOIN t2 ON ev.c = t2.c LEFT JOIN f3 ON ev.b = f3.b AND ev.c = f3.c AND ev.d = f3.d
 LEFT JOIN t3 ON ev.b = t3.b AND ev.c = t3.c LEFT JOIN f4 ON ev.a = f4.a AND ev.b = f4.b AND ev.c = f4.c AND ev.d = f4.d LEFT JOIN t4 ON ev.a = t4.a AND ev.b = t4.b AND ev.c = t4.c),
k AS (SELECT split, sum(-n * log2(p)) AS bits FROM p GROUP BY split), w AS (SELECT split, sum(n) AS n, sum(n * unk) AS unk FROM u GROUP BY split)
SELECT w.split, cast(w.n AS BIGINT) AS windows, cast(w.unk AS BIGINT) AS unknown, round((coalesce(k.bits, 0) + w.unk * log2(26e0)) / w.n, 6) AS bits FROM w LEFT JOIN k ON w.split = k.split"""

DERIVED["mapped"] = """
WITH vocab AS (SELECT w FROM {tok} WHERE split = 'train' GROUP BY w HAVING count(*) >= 2), m AS (SELECT t.locus_id, t.split, t.grp, t.wp, t.w AS raw, coalesce(v.w, '?') AS w FROM {tok} t LEFT JOIN vocab v ON t.w = v.w WHERE t.split IS NOT NULL)
SELECT split, grp, w, raw, lag(w) OVER (PARTITION BY locus_id ORDER BY wp) AS prev, wp FROM m"""

_BIGRAM = """uni AS (SELECT w, count(*) AS c FROM {mapped} WHERE split = 'train' GROUP BY w), n AS (SELECT cast(sum(c) AS DOUBLE) AS n, count(*) FILTER (WHERE w <> '?') + 1 AS v FROM uni),
bi AS (SELECT prev, w, count(*) AS c FROM {mapped} WHERE split = 'train' AND prev IS NOT NULL GROUP BY prev, w), ctx AS (SELECT prev, sum(c) AS t FROM bi GROUP BY prev),
ev AS (SELECT split, grp, prev, w, count(*) AS k FROM {mapped} WHERE split <> 'train' AND wp > 0 GROUP BY split, grp, prev, w),
sc AS (SELECT p.split, p.grp, p.prev, p.w, p.k, -log2((coalesce(u.c, 0) + 1e-1) / (n.n + 1e-1 * n.v)) AS ub,
   -log2((coalesce(b.c, 0) + 10 * (coalesce(u.c, 0) + 1e-1) / (n.n + 1e-1 * n.v)) / (coalesce(x.t, 0) + 10)) AS bb
 FROM ev p CROSS JOIN n LEFT JOIN uni u ON p.w = u.w LEFT JOIN bi b ON p.prev = b.prev AND p.w = b.w LEFT JOIN ctx x ON p.prev = x.prev)"""

BODIES["bigram_fit"] = f"WITH {_BIGRAM} SELECT b.prev, b.w, b.c, round((b.c + 10 * (u.c + 1e-1) / (n.n + 1e-1 * n.v)) / (x.t + 10), 8) AS p FROM bi b JOIN uni u ON b.w = u.w JOIN ctx x ON b.prev = x.prev CROSS JOIN n"

BODIES["bigram_score"] = f"""
WITH {_BIGRAM} SELECT split, cast(sum(k) AS BIGINT) AS n, cast(sum(CASE WHEN w = '?' THEN k ELSE 0 END) AS BIGINT) AS unknown, round(sum(k * ub) / sum(k), 6) AS unigram_bits, round(sum(k * bb) / sum(k), 6) AS bigram_bits, round(sum(k * (ub - bb)) / sum(k), 6) AS gain FROM sc GROUP BY split"""

BODIES["score_difference"] = f"""
WITH {_BIGRAM}, sh AS (SELECT locus_id, w, row_number() OVER (PARTITION BY locus_id ORDER BY {sql_key(409, '0', 'locus_id', 'wp')}, wp) AS k FROM (SELECT t.locus_id, t.wp, coalesce(v.w, '?') AS w FROM {{tok}} t
    LEFT JOIN (SELECT DISTINCT w FROM {{mapped}} WHERE split = 'train') v ON t.w = v.w WHERE t.split = 'train')),
sb AS (SELECT prev, w, count(*) AS c FROM (SELECT lag(w) OVER (PARTITION BY locus_id ORDER BY k) AS prev, w FROM sh) WHERE prev IS NOT NULL GROUP BY prev, w), sx AS (SELECT prev, sum(c) AS t FROM sb GROUP BY prev),
d AS (SELECT sc.split, sc.k, sc.ub, sc.bb, -log2((coalesce(b.c, 0) + 10 * power(2e0, -sc.ub)) / (coalesce(x.t, 0) + 10)) AS sbits FROM sc LEFT JOIN sb b ON sc.prev = b.prev AND sc.w = b.w LEFT JOIN sx x ON sc.prev = x.prev)
SELECT split, cast(sum(k) AS BIGINT) AS n, round(sum(k * ub) / sum(k), 6) AS unigram_bits, round(sum(k * bb) / sum(k), 6) AS bigram_bits, round(sum(k * sbits) / sum(k), 6) AS shuffled_bits,
  round(sum(k * (ub - bb)) / sum(k), 6) AS unigram_less_bigram, round(sum(k * (sbits - bb)) / sum(k), 6) AS shuffled_less_original FROM d GROUP BY split"""

BODIES["bigram_score_groups"] = f"WITH {_BIGRAM} SELECT grp, cast(sum(k) AS BIGINT) AS n, round(sum(k * ub), 4) AS unigram_bits, round(sum(k * bb), 4) AS bigram_bits FROM sc GROUP BY grp"

BODIES["unseen_words"] = f"""
WITH tr AS (SELECT DISTINCT w FROM {{tok}} WHERE split = 'train')
SELECT m.split, count(*) AS n, count(*) FILTER (WHERE m.w = '?') AS unknown, count(*) FILTER (WHERE tr.w IS NULL) AS unseen FROM {{mapped}} m LEFT JOIN tr ON m.raw = tr.w WHERE m.split <> 'train' GROUP BY m.split"""

def bootstrap_groups(draws: int = DRAWS) -> str:
    return f"""
WITH {_BIGRAM}, gs AS (SELECT grp, sum(k * ub) AS u, sum(k * bb) AS b, sum(k) AS n FROM sc WHERE split = 'test' GROUP BY grp),
num AS (SELECT *, row_number() OVER (ORDER BY grp) - 1 AS i, count(*) OVER () AS k FROM gs),
draw AS (SELECT r.r, s.i AS slot, cast(conv_(substr(md5('9:' || r.r || ':' || s.i), 1, 8)) AS BIGINT) % s.k AS pick FROM num s CROSS JOIN {_replicates(draws)})
SELECT cast(d.r AS BIGINT) AS r, round(sum(n.u - n.b) / sum(n.n), 6) AS gain FROM draw d JOIN num n ON d.pick = n.i GROUP BY d.r"""


BODIES["bootstrap_groups"] = bootstrap_groups()

BODIES["bootstrap_interval"] = f"""
WITH b AS ({bootstrap_groups().replace("WITH ", "WITH ", 1)}), n AS (SELECT gain, row_number() OVER (ORDER BY gain) - 1 AS i, count(*) OVER () AS k FROM b)
SELECT max(k) AS draws, round(avg(gain), 6) AS mean, round(stddev_pop(gain), 6) AS sd, max(CASE WHEN i = floor(25e-3 * (k - 1)) THEN gain END) AS low, max(CASE WHEN i = floor(975e-3 * (k - 1)) THEN gain END) AS high FROM n"""

BODIES["leave_one_group_out"] = f"""
WITH {_BIGRAM}, gs AS (SELECT grp, sum(k * (ub - bb)) AS g, sum(k) AS n FROM sc WHERE split = 'test' GROUP BY grp), t AS (SELECT sum(g) AS g, sum(n) AS n FROM gs)
SELECT round(min((t.g - gs.g) / (t.n - gs.n)), 6) AS low, round(max((t.g - gs.g) / (t.n - gs.n)), 6) AS high FROM gs CROSS JOIN t WHERE t.n > gs.n"""

_BOUNDARY = """b AS (SELECT locus_id, split, grp, wp, nw, w, substr(w, 1, 1) AS ini, lag(substr(w, length(w), 1)) OVER (PARTITION BY locus_id ORDER BY wp) AS fin, length(lag(w) OVER (PARTITION BY locus_id ORDER BY wp)) AS plen,
   lag(w) OVER (PARTITION BY locus_id ORDER BY wp) AS pw FROM {tok} WHERE split IS NOT NULL),
e AS (SELECT *, CASE WHEN wp = 1 THEN 'second' WHEN wp = nw - 1 THEN 'last' ELSE 'interior' END AS role FROM b WHERE wp > 0),
c1 AS (SELECT role, ini, count(*) AS n FROM e WHERE split = 'train' GROUP BY role, ini), s1 AS (SELECT role, sum(n) AS t FROM c1 GROUP BY role),
c2 AS (SELECT role, fin, ini, count(*) AS n FROM e WHERE split = 'train' GROUP BY role, fin, ini), s2 AS (SELECT role, fin, sum(n) AS t FROM c2 GROUP BY role, fin),
bs AS (SELECT e.*, (coalesce(c1.n, 0) + 1e-1) / (coalesce(s1.t, 0) + 26e-1) AS p0, coalesce(c2.n, 0) AS n2, coalesce(s2.t, 0) AS t2 FROM e LEFT JOIN c1 ON e.role = c1.role AND e.ini = c1.ini LEFT JOIN s1 ON e.role = s1.role
   LEFT JOIN c2 ON e.role = c2.role AND e.fin = c2.fin AND e.ini = c2.ini LEFT JOIN s2 ON e.role = s2.role AND e.fin = s2.fin WHERE e.split <> 'train'),
gain AS (SELECT *, -log2(p0) AS base_bits, -log2((n2 + 10 * p0) / (t2 + 10)) AS cond_bits FROM bs)"""

BODIES["boundary_fit"] = f"WITH {_BOUNDARY} SELECT role, fin, ini, n FROM c2"
BODIES["boundary_score"] = f"WITH {_BOUNDARY} SELECT split, role, count(*) AS n, round(avg(base_bits), 6) AS baseline, round(avg(cond_bits), 6) AS conditional, round(avg(base_bits - cond_bits), 6) AS gain FROM gain GROUP BY split, role"

BODIES["novelty_scores"] = f"""
WITH {_BOUNDARY}, tr AS (SELECT DISTINCT w FROM {{tok}} WHERE split = 'train'), trp AS (SELECT DISTINCT pw, w FROM e WHERE split = 'train')
SELECT g.split, CASE WHEN a.w IS NULL THEN 1 ELSE 0 END + CASE WHEN b.w IS NULL THEN 1 ELSE 0 END AS unseen, p.w IS NOT NULL AS pair_seen, count(*) AS n, round(avg(g.base_bits - g.cond_bits), 6) AS gain
FROM gain g LEFT JOIN tr a ON g.w = a.w LEFT JOIN tr b ON g.pw = b.w LEFT JOIN trp p ON g.pw = p.pw AND g.w = p.w
GROUP BY g.split, CASE WHEN a.w IS NULL THEN 1 ELSE 0 END + CASE WHEN b.w IS NULL THEN 1 ELSE 0 END, p.w IS NOT NULL"""

BODIES["matched_cells"] = f"""
WITH {_BOUNDARY} SELECT role, cast(plen AS BIGINT) AS plen, cast(length(w) AS BIGINT) AS tlen, count(*) AS n, count(DISTINCT fin) AS finals, count(DISTINCT ini) AS initials FROM e WHERE split = 'test' GROUP BY role, plen, length(w)"""

BODIES["same_tail_components"] = f"""
WITH {_BOUNDARY}, cell AS (SELECT role, substr(w, 2) AS tail, plen, ini, fin, p0, base_bits - cond_bits AS g FROM gain WHERE split = 'test'),
ok AS (SELECT role, tail, plen, count(*) AS n, sum(g) AS observed FROM cell GROUP BY role, tail, plen HAVING count(DISTINCT ini) > 1 AND count(DISTINCT fin) > 1),
i AS (SELECT c.role, c.tail, c.plen, c.ini, max(c.p0) AS p0, count(*) AS n FROM cell c JOIN ok ON c.role = ok.role AND c.tail = ok.tail AND c.plen = ok.plen GROUP BY c.role, c.tail, c.plen, c.ini),
f AS (SELECT c.role, c.tail, c.plen, c.fin, count(*) AS n FROM cell c JOIN ok ON c.role = ok.role AND c.tail = ok.tail AND c.plen = ok.plen GROUP BY c.role, c.tail, c.plen, c.fin),
set_ AS (SELECT role, tail, plen, spell_(ini BY ini)_ AS inis FROM i GROUP BY role, tail, plen),
x AS (SELECT i.role, i.tail, i.plen, sum(i.n * f.n * (log2((coalesce(c2.n, 0) + 10 * i.p0) / (coalesce(s2.t, 0) + 10)) - log2(i.p0))) AS s FROM i JOIN f ON i.role = f.role AND i.tail = f.tail AND i.plen = f.plen
  LEFT JOIN c2 ON c2.role = i.role AND c2.fin = f.fin AND c2.ini = i.ini LEFT JOIN s2 ON s2.role = i.role AND s2.fin = f.fin GROUP BY i.role, i.tail, i.plen)
SELECT set_.inis AS initials, count(*) AS cells, cast(sum(ok.n) AS BIGINT) AS n, round(sum(ok.observed), 4) AS observed, round(sum(x.s / ok.n), 4) AS expected FROM ok JOIN x ON ok.role = x.role AND ok.tail = x.tail AND ok.plen = x.plen JOIN set_ ON ok.role = set_.role AND ok.tail = set_.tail AND ok.plen = set_.plen GROUP BY set_.inis"""

# The kernels of a context word: exact puts all on the word itself if it is in the vocabulary, edit spreads p0 over the
# vocabulary words one edit away; a context that has neither keeps p0. Targets are words after the first of a line.
_MEMORY = """voc AS (SELECT w, n AS c FROM {types} WHERE split = 'train' AND n >= 2), tn AS (SELECT cast(sum(n) AS BIGINT) AS n FROM {types} WHERE split = 'train'), vn AS (SELECT count(*) + 1 AS v, coalesce(sum(c), 0) AS c FROM voc),
pv AS (SELECT w, (voc.c + 1e-1) / (tn.n + 1e-1 * vn.v) AS p0 FROM voc CROSS JOIN tn CROSS JOIN vn), unk AS (SELECT (tn.n - vn.c + 1e-1) / (tn.n + 1e-1 * vn.v) AS p0 FROM tn CROSS JOIN vn),
seen AS (SELECT DISTINCT w FROM {types} WHERE split IN ('validation', 'test')),
kv AS (SELECT w, w AS k FROM voc UNION SELECT l.w, substr(l.w, 1, cast(l.cp AS INT)) || substr(l.w, cast(l.cp AS INT) + 2) FROM {letters} l JOIN voc ON l.w = voc.w),
ks AS (SELECT w, w AS k FROM seen UNION SELECT l.w, substr(l.w, 1, cast(l.cp AS INT)) || substr(l.w, cast(l.cp AS INT) + 2) FROM {letters} l JOIN seen ON l.w = seen.w),
norm AS (SELECT e.x AS w, sum(pv.p0) AS norm FROM (SELECT DISTINCT ks.w AS x, kv.w AS y FROM ks JOIN kv ON ks.k = kv.k WHERE ks.w <> kv.w AND levenshtein(ks.w, kv.w) = 1) e JOIN pv ON e.y = pv.w GROUP BY e.x),
t AS (SELECT k.locus_id, k.split, k.grp, k.wp, k.w, CASE WHEN pv.w IS NULL THEN 0 ELSE 1 END AS known, coalesce(pv.p0, unk.p0) AS p0, norm.norm FROM {tok} k CROSS JOIN unk LEFT JOIN pv ON k.w = pv.w LEFT JOIN norm ON k.w = norm.w WHERE k.split IN ('validation', 'test')),
pr AS (SELECT a.locus_id, a.split, a.grp, a.wp, a.p0, a.wp - b.wp AS dist, CASE WHEN b.known = 0 THEN a.p0 WHEN a.w = b.w THEN 1e0 ELSE 0e0 END AS exact_,
   CASE WHEN b.norm IS NULL THEN a.p0 WHEN a.known = 1 AND abs(length(a.w) - length(b.w)) <= 1 AND levenshtein(a.w, b.w) = 1 THEN a.p0 / b.norm ELSE 0e0 END AS edit_
 FROM t a JOIN t b ON a.locus_id = b.locus_id AND b.wp < a.wp AND b.wp >= a.wp - 16),
near AS (SELECT locus_id, split, grp, wp, p0, g.width, avg(exact_) AS exact_, avg(edit_) AS edit_ FROM pr JOIN (VALUES (1), (4), (16)) AS g(width) ON pr.dist <= g.width GROUP BY locus_id, split, grp, wp, p0, g.width),
mix AS (SELECT split, grp, width, lambda_ AS lam, family, p0, (1 - lambda_) * p0 + lambda_ * CASE WHEN family = 'exact' THEN exact_ ELSE edit_ END AS p FROM near CROSS JOIN (VALUES (0e0), (1e-1), (25e-2), (5e-1), (75e-2)) AS l(lambda_) CROSS JOIN (VALUES ('exact'), ('edit')) AS f(family)),
grid AS (SELECT split, family, width, lam, count(*) AS n, avg(-log2(p)) AS bits FROM mix GROUP BY split, family, width, lam),
choice AS (SELECT family, width, lam FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY round(bits, 9), lam, width) AS k FROM grid WHERE split = 'validation') WHERE k = 1)"""

BODIES["unigram_memory_fit"] = f"WITH {_MEMORY} SELECT split, count(*) AS n, count(*) FILTER (WHERE known = 0) AS unknown, round(avg(-log2(p0)), 6) AS bits FROM t GROUP BY split"
BODIES["memory_score"] = f"WITH {_MEMORY} SELECT split, family, width, round(lam, 2) AS lam, n, round(bits, 6) AS bits FROM grid"
BODIES["memory_grid"] = f"WITH {_MEMORY} SELECT g.family, g.width, round(g.lam, 2) AS lam, round(g.bits, 6) AS bits FROM grid g JOIN choice c ON g.family = c.family AND g.width = c.width AND g.lam = c.lam WHERE g.split = 'validation'"

# the settings that validation chose, on the test split by group
BODIES["memory_diagnostic"] = f"""
WITH {_MEMORY} SELECT m.family, m.grp, count(*) AS n, round(avg(-log2(m.p0)), 6) AS baseline_bits, round(avg(-log2(m.p)), 6) AS bits, round(avg(log2(m.p) - log2(m.p0)), 6) AS gain
FROM mix m JOIN choice c ON m.family = c.family AND m.width = c.width AND m.lam = c.lam WHERE m.split = 'test' GROUP BY m.family, m.grp"""

BODIES["perm_expectation"] = """
WITH ln AS (SELECT locus_id, wp, w, nw FROM {tok} WHERE paragraph AND excluded = 0 AND NOT coalesce(interrupted, false) AND nw >= 3),
g AS (SELECT locus_id, max(nw) AS n, count(*) FILTER (WHERE substr(w, 1, 1) IN ('t', 'k', 'p', 'f')) AS g FROM ln GROUP BY locus_id),
q AS (SELECT a.locus_id, max(a.nw) AS n, count(*) FILTER (WHERE a.w = b.w) AS same, count(*) FILTER (WHERE levenshtein(a.w, b.w) <= 1) AS near FROM ln a JOIN ln b ON a.locus_id = b.locus_id AND a.wp < b.wp GROUP BY a.locus_id)
SELECT round(sum(g.g / cast(g.n AS DOUBLE)), 5) AS gallows, round(sum(2 * q.same / cast(q.n AS DOUBLE)), 5) AS equal, round(sum(2 * q.near / cast(q.n AS DOUBLE)), 5) AS near FROM g JOIN q ON g.locus_id = q.locus_id"""

BODIES["null_within_token"] = f"""
WITH sh AS (SELECT split, locus_id, wp, ch, row_number() OVER (PARTITION BY locus_id, wp ORDER BY {sql_key(408, 'wp', 'locus_id', 'cp')}, cp) AS k FROM {{chars}} WHERE split = 'train'),
sx AS (SELECT coalesce(lag(ch) OVER (PARTITION BY locus_id, wp ORDER BY k), '^') AS h, ch AS s FROM sh UNION ALL SELECT h, '$' FROM (SELECT locus_id, wp, ch AS h, row_number() OVER (PARTITION BY locus_id, wp ORDER BY k DESC) AS z FROM sh) WHERE z = 1),
fit AS (SELECT h, s, count(*) AS n FROM sx GROUP BY h, s), tot AS (SELECT h, sum(n) AS t FROM fit GROUP BY h),
raw AS (SELECT h1 AS h, s, sum(n) AS n FROM {{ngram_events}} WHERE split = 'train' GROUP BY h1, s), rt AS (SELECT h, sum(n) AS t FROM raw GROUP BY h), v AS (SELECT count(DISTINCT s) + 1 AS v FROM raw),
ev AS (SELECT split, h1 AS h, s, sum(n) AS n FROM {{ngram_events}} WHERE split <> 'train' GROUP BY split, h1, s)
SELECT ev.split, cast(sum(ev.n) AS BIGINT) AS n, round(-sum(ev.n * log2((coalesce(raw.n, 0) + 1e-1) / (coalesce(rt.t, 0) + 1e-1 * v.v))) / sum(ev.n), 6) AS original_bits,
  round(-sum(ev.n * log2((coalesce(fit.n, 0) + 1e-1) / (coalesce(tot.t, 0) + 1e-1 * v.v))) / sum(ev.n), 6) AS shuffled_bits
FROM ev CROSS JOIN v LEFT JOIN fit ON ev.h = fit.h AND ev.s = fit.s LEFT JOIN tot ON ev.h = tot.h LEFT JOIN raw ON ev.h = raw.h AND ev.s = raw.s LEFT JOIN rt ON ev.h = rt.h GROUP BY ev.split"""

BODIES["null_train_lines"] = f"""
WITH sh AS (SELECT locus_id, w, row_number() OVER (PARTITION BY locus_id ORDER BY {sql_key(409, '0', 'locus_id', 'wp')}, wp) AS k FROM {{tok}} WHERE split = 'train')
SELECT prev, w, count(*) AS n FROM (SELECT lag(w) OVER (PARTITION BY locus_id ORDER BY k) AS prev, w FROM sh) WHERE prev IS NOT NULL GROUP BY prev, w"""

BODIES["null_word_shuffle_partition"] = f"""
WITH sh AS (SELECT split, locus_id, wp, ch, row_number() OVER (PARTITION BY locus_id, wp ORDER BY CASE split WHEN 'train' THEN {sql_key(408, 'wp', 'locus_id', 'cp')} WHEN 'validation' THEN {sql_key(409, 'wp', 'locus_id', 'cp')} ELSE {sql_key(410, 'wp', 'locus_id', 'cp')} END, cp) AS k FROM {{chars}} WHERE split IS NOT NULL),
b AS (SELECT split, coalesce(lag(ch) OVER (PARTITION BY locus_id, wp ORDER BY k), '^') AS h, ch AS s FROM sh),
f AS (SELECT split, h, s, count(*) AS n FROM b GROUP BY split, h, s), t AS (SELECT split, h, sum(n) AS t FROM f GROUP BY split, h)
SELECT f.split, cast(sum(f.n) AS BIGINT) AS n, count(*) AS pairs, round(-sum(f.n * log2((f.n + 1e-1) / (t.t + 27e-1))) / sum(f.n), 6) AS bits FROM f JOIN t ON f.split = t.split AND f.h = t.h GROUP BY f.split"""

BODIES["null_stream"] = f"""
WITH o AS (SELECT split, locus_id, wp, w, CASE split WHEN 'train' THEN {sql_key(608, 'wp', 'locus_id', 'wp')} WHEN 'validation' THEN {sql_key(609, 'wp', 'locus_id', 'wp')} ELSE {sql_key(610, 'wp', 'locus_id', 'wp')} END AS k FROM {{tok}} WHERE split IS NOT NULL),
p AS (SELECT split, w, k, locus_id, wp, floor(k / 65536) AS part FROM o),
inside AS (SELECT split, w, lag(w) OVER (PARTITION BY split, part ORDER BY k, locus_id, wp) AS prev FROM p),
ends AS (SELECT split, part, max(CASE WHEN a = 1 THEN w END) AS first_w, max(CASE WHEN z = 1 THEN w END) AS last_w FROM (SELECT split, part, w, row_number() OVER (PARTITION BY split, part ORDER BY k, locus_id, wp) AS a, row_number() OVER (PARTITION BY split, part ORDER BY k DESC, locus_id DESC, wp DESC) AS z FROM p) GROUP BY split, part),
across AS (SELECT split, first_w AS w, lag(last_w) OVER (PARTITION BY split ORDER BY part) AS prev FROM ends),
words AS (SELECT split, count(*) AS pairs, count(*) FILTER (WHERE w = prev) AS equal FROM (SELECT * FROM inside UNION ALL SELECT * FROM across) WHERE prev IS NOT NULL GROUP BY split),
sh AS (SELECT split, locus_id, wp, ch, row_number() OVER (PARTITION BY locus_id, wp ORDER BY CASE split WHEN 'train' THEN {sql_key(508, 'wp', 'locus_id', 'cp')} WHEN 'validation' THEN {sql_key(509, 'wp', 'locus_id', 'cp')} ELSE {sql_key(510, 'wp', 'locus_id', 'cp')} END, cp) AS k FROM {{chars}} WHERE split IS NOT NULL),
lg AS (SELECT split, ch, lag(ch) OVER (PARTITION BY locus_id, wp ORDER BY k) AS prev FROM sh),
letters_ AS (SELECT split, count(prev) AS letter_pairs, count(*) FILTER (WHERE ch = prev) AS letter_equal, count(*) AS n_letters FROM lg GROUP BY split)
SELECT words.split, pairs, equal, letter_pairs, letter_equal, n_letters FROM words JOIN letters_ ON words.split = letters_.split"""

# a key by frequency ranks, and keys at random by md5: both score the validation stream under the train model
_UNDER_KEY = f"""tr AS (SELECT h1, s, sum(n) AS n FROM {{ngram_events}} WHERE split = 'train' GROUP BY h1, s), tt AS (SELECT h1, cast(sum(n) AS DOUBLE) AS t FROM tr GROUP BY h1), v AS (SELECT count(DISTINCT s) AS v FROM tr),
va AS (SELECT h1, s, sum(n) AS n FROM {{ngram_events}} WHERE split = 'validation' GROUP BY h1, s),
lt AS (SELECT s, row_number() OVER (ORDER BY sum(n) DESC, s) AS k FROM tr WHERE s <> '$' GROUP BY s), lv AS (SELECT s, sum(n) AS n FROM va WHERE s <> '$' GROUP BY s),
keys AS (SELECT -1 AS r, a.s AS u, lt.s AS x FROM (SELECT s, row_number() OVER (ORDER BY n DESC, s) AS k FROM lv) a JOIN lt ON a.k = lt.k
  UNION ALL SELECT a.r, a.s, lt.s FROM (SELECT r.r, s, row_number() OVER (PARTITION BY r.r ORDER BY md5('12:' || r.r || ':' || s), s) AS k FROM lv CROSS JOIN {_replicates(KEYS)}) a JOIN lt ON a.k = lt.k
  UNION ALL SELECT r.r, e.u, e.u FROM (SELECT r.r FROM {_replicates(KEYS)} UNION ALL SELECT -1) AS r CROSS JOIN (VALUES ('^'), ('$')) AS e(u)),
de AS (SELECT a.r, va.n, a.x AS h, b.x AS s FROM va JOIN keys a ON va.h1 = a.u JOIN keys b ON va.s = b.u AND a.r = b.r),
ks AS (SELECT de.r, sum(de.n) AS n, -sum(de.n * log2((coalesce(tr.n, 0) + 1e-1) / (coalesce(tt.t, 0) + 1e-1 * v.v))) AS bits FROM de LEFT JOIN tr ON de.h = tr.h1 AND de.s = tr.s LEFT JOIN tt ON de.h = tt.h1 CROSS JOIN v GROUP BY de.r)"""

BODIES["score_key"] = f"WITH {_UNDER_KEY} SELECT cast(n AS BIGINT) AS events, round(bits / n, 6) AS bits_per_symbol FROM ks WHERE r = -1"
# scored by joins of the decoded events, and once more by the events of the decoded words: both must agree
BODIES["score_key_incremental"] = f"""
WITH {_UNDER_KEY}, x AS (SELECT u, x FROM keys WHERE r = -1), w AS (SELECT l.w, l.cp, coalesce(x.x, '?') AS s FROM {{letters}} l LEFT JOIN x ON l.ch = x.u),
ws AS (SELECT t.w, t.n, w.s, coalesce(lag(w.s) OVER (PARTITION BY t.w ORDER BY w.cp), '^') AS h, lead(w.s) OVER (PARTITION BY t.w ORDER BY w.cp) AS nx FROM {{types}} t JOIN w ON t.w = w.w WHERE t.split = 'validation'),
e AS (SELECT h, s, n FROM ws UNION ALL SELECT s, '$', n FROM ws WHERE nx IS NULL)
SELECT cast(sum(e.n) AS BIGINT) AS events, round(-sum(e.n * log2((coalesce(tr.n, 0) + 1e-1) / (coalesce(tt.t, 0) + 1e-1 * v.v))) / sum(e.n), 6) AS bits_per_symbol
FROM e LEFT JOIN tr ON e.h = tr.h1 AND e.s = tr.s LEFT JOIN tt ON e.h = tt.h1 CROSS JOIN v"""

BODIES["score_heldout"] = f"""
WITH {_UNDER_KEY}, x AS (SELECT u, x FROM keys WHERE r = -1), te AS (SELECT h1, s, sum(n) AS n FROM {{ngram_events}} WHERE split = 'test' GROUP BY h1, s),
d AS (SELECT te.n, te.s AS u, CASE WHEN te.h1 = '^' THEN '^' ELSE a.x END AS h, CASE WHEN te.s = '$' THEN '$' ELSE b.x END AS s FROM te LEFT JOIN x a ON te.h1 = a.u LEFT JOIN x b ON te.s = b.u)
SELECT cast(sum(d.n) AS BIGINT) AS events, cast(sum(CASE WHEN d.h IS NOT NULL AND d.s IS NOT NULL THEN d.n ELSE 0 END) AS BIGINT) AS covered, cast(sum(CASE WHEN d.u = d.s AND d.s <> '$' THEN d.n ELSE 0 END) AS BIGINT) AS recovered,
  round(sum(CASE WHEN d.h IS NOT NULL AND d.s IS NOT NULL THEN -d.n * log2((coalesce(tr.n, 0) + 1e-1) / (coalesce(tt.t, 0) + 1e-1 * v.v)) ELSE 0e0 END) / sum(CASE WHEN d.h IS NOT NULL AND d.s IS NOT NULL THEN d.n ELSE 0 END), 6) AS bits_per_symbol
FROM d LEFT JOIN tr ON d.h = tr.h1 AND d.s = tr.s LEFT JOIN tt ON d.h = tt.h1 CROSS JOIN v"""

# homophones: units of the quotient's classes stand for one letter each, so several units may give the same letter
BODIES["score_homophonic"] = f"""
WITH {_UNDER_KEY}, h AS (SELECT s AS u, (row_number() OVER (ORDER BY n DESC, s) - 1) AS k FROM lv), m AS (SELECT h.u, lt.s AS x FROM h JOIN lt ON floor(h.k / 2) + 1 = lt.k UNION ALL SELECT '^', '^' UNION ALL SELECT '$', '$'),
e AS (SELECT va.n, a.x AS h, b.x AS s FROM va JOIN m a ON va.h1 = a.u JOIN m b ON va.s = b.u)
SELECT (SELECT count(*) - count(DISTINCT x) FROM m) AS shared_letters, cast(sum(e.n) AS BIGINT) AS events, round(-sum(e.n * log2((coalesce(tr.n, 0) + 1e-1) / (coalesce(tt.t, 0) + 1e-1 * v.v))) / sum(e.n), 6) AS bits_per_symbol
FROM e LEFT JOIN tr ON e.h = tr.h1 AND e.s = tr.s LEFT JOIN tt ON e.h = tt.h1 CROSS JOIN v"""

BODIES["random_key_baseline"] = f"WITH {_UNDER_KEY} SELECT count(*) AS n_keys, round(min(bits / n), 6) AS low, round(max(bits / n), 6) AS high FROM ks WHERE r >= 0"

BODIES["baseline_plaintext"] = f"""
WITH {_UNDER_KEY} SELECT round(-sum(va.n * log2((coalesce(tr.n, 0) + 1e-1) / (coalesce(tt.t, 0) + 1e-1 * v.v))) / sum(va.n), 6) AS identity_bits
FROM va LEFT JOIN tr ON va.h1 = tr.h1 AND va.s = tr.s LEFT JOIN tt ON va.h1 = tt.h1 CROSS JOIN v"""

BODIES["null_same_tail"] = f"""
WITH {_BOUNDARY}, cell AS (SELECT *, substr(w, 2) AS tail FROM e WHERE split = 'test'),
ok AS (SELECT role, tail, plen FROM cell GROUP BY role, tail, plen HAVING count(DISTINCT ini) > 1 AND count(DISTINCT fin) > 1),
i AS (SELECT c.role, c.tail, c.plen, c.ini, count(*) AS n FROM cell c JOIN ok ON c.role = ok.role AND c.tail = ok.tail AND c.plen = ok.plen GROUP BY c.role, c.tail, c.plen, c.ini),
f AS (SELECT c.role, c.tail, c.plen, c.fin, count(*) AS n FROM cell c JOIN ok ON c.role = ok.role AND c.tail = ok.tail AND c.plen = ok.plen GROUP BY c.role, c.tail, c.plen, c.fin),
t AS (SELECT role, tail, plen, sum(n) AS t FROM i GROUP BY role, tail, plen)
SELECT cast(sum(CASE WHEN i.ini = f.fin THEN i.n * f.n ELSE 0 END) AS BIGINT) AS weight, round(sum(CASE WHEN i.ini = f.fin THEN i.n * f.n / cast(t.t AS DOUBLE) ELSE 0e0 END), 6) AS expected_equal
FROM i JOIN f ON i.role = f.role AND i.tail = f.tail AND i.plen = f.plen JOIN t ON i.role = t.role AND i.tail = t.tail AND i.plen = t.plen"""

BODIES["lm_fit_declared"] = f"""
SELECT h1 AS context, CASE WHEN instr('{DECLARED}$', s) = 0 THEN '?' ELSE s END AS symbol, cast(sum(n) AS BIGINT) AS n FROM {{ngram_events}} WHERE split = 'train' GROUP BY h1, CASE WHEN instr('{DECLARED}$', s) = 0 THEN '?' ELSE s END"""

BODIES["gates"] = f"""
WITH {_UNDER_KEY} SELECT k.bits / k.n < r.low AS beats_random, k.bits / k.n < log2(cast(v.v AS DOUBLE)) AS beats_uniform, k.n >= 1000 AS enough_events, k.bits / k.n < r.low AND k.bits / k.n < log2(cast(v.v AS DOUBLE)) AND k.n >= 1000 AS passed
FROM (SELECT * FROM ks WHERE r = -1) k CROSS JOIN (SELECT min(bits / n) AS low FROM ks WHERE r >= 0) r CROSS JOIN v"""
