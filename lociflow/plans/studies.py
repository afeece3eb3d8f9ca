"""Queries that need more than a shared text: comparisons by token lists, resampling, spans; with SQL of their own."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lociflow.functions import text
from lociflow.operators import graphs, resample, spans, tablecipher, views
from lociflow.operators.resample import ROLES, sql_key
from lociflow.plans import joins, models
from lociflow.plans.shared import Relations, oracle, run_body
from lociflow.plans.statistics import ELIGIBLE
from lociflow.runtime import BROADCAST_ROWS, spool

#: Permutations of the lines of a page.
LINE_ORDERS = 9_999
#: Pairs of types of which conflicts are sought: among so many types of the largest weight.
CONFLICT_TYPES = 64


def relation(spark: SparkSession, d: str, name: str) -> DataFrame:
    return Relations(spark, d, f"{{{name}}}")[name]


def _complete(recs: DataFrame) -> DataFrame:
    return recs.where(ELIGIBLE)


# two transcribers of a page, aligned by page and number of the line


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of readings of one line by two transcribers, of each the first record of the key."""
    recs = relation(spark, d, "recs").where("idx is not null and folio is not null and volume_id is not null")
    fields = [F.col(c) for c in ("locus_id", "kind", "text_raw", "words", "doubt", "interrupted", "nw")]

    def side(name: str, x: str) -> DataFrame:
        one = recs.where(F.col("transcriber") == name).groupBy("volume_id", "folio", "idx").agg(F.min_by(F.struct(*fields), "locus_id").alias(x))
        return one

    return side("QX", "l").join(side("MR", "r"), ["volume_id", "folio", "idx"])


def agreement_agg(spark: SparkSession, d: str) -> DataFrame:
    """How far two transcribers agree on the lines both have, line by line and token by token; a pair is eligible if neither
    side is in doubt, interrupted or empty."""
    sides = _aligned(spark, d)
    bad = lambda x: F.col(f"{x}.doubt") | F.coalesce(F.col(f"{x}.interrupted"), F.lit(False)) | (F.col(f"{x}.nw") == 0)
    pairs = sides.select(
        (~(bad("l") | bad("r"))).alias("ok"),
        (F.col("l.text_raw").eqNullSafe(F.col("r.text_raw"))).alias("same_raw"),
        (F.col("l.words") == F.col("r.words")).alias("same"),
        (~F.col("l.kind").eqNullSafe(F.col("r.kind"))).alias("kinds"),
        text.token_distance("l.words", "r.words").alias("distance"),
    )
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    ok = F.when(F.col("ok"), F.col("distance"))
    return pairs.agg(
        F.count("*").alias("aligned"), n(F.col("ok")).alias("eligible"), n(F.col("ok") & F.col("same_raw")).alias("raw_identical"), n(F.col("ok") & F.col("same")).alias("token_identical"),
        F.sum(ok).alias("distance_sum"), F.round(F.avg(ok), 6).alias("distance_mean"), F.max(ok).alias("distance_max"), n(F.col("kinds")).alias("kind_mismatches"),
    )


# the tokens of a pair become letters of one alphabet, so that the distance of words is one of letters
_AGREEMENT = """WITH k AS (SELECT * FROM {recs} WHERE idx IS NOT NULL AND folio IS NOT NULL AND volume_id IS NOT NULL),
l AS (SELECT DISTINCT ON (volume_id, folio, idx) * FROM k WHERE transcriber = 'QX' ORDER BY volume_id, folio, idx, locus_id),
r AS (SELECT DISTINCT ON (volume_id, folio, idx) * FROM k WHERE transcriber = 'MR' ORDER BY volume_id, folio, idx, locus_id),
p AS (SELECT l.text_raw IS NOT DISTINCT FROM r.text_raw AS same_raw, l.words = r.words AS same, l.kind IS DISTINCT FROM r.kind AS kinds, NOT (l.doubt OR r.doubt OR coalesce(l.interrupted, false) OR coalesce(r.interrupted, false) OR l.nw = 0 OR r.nw = 0) AS ok,
  l.words AS a, r.words AS b, list_distinct(list_concat(l.words, r.words)) AS u FROM l JOIN r USING (volume_id, folio, idx)),
q AS (SELECT *, levenshtein(array_to_string(list_transform(a, lambda w: chr((40 + list_position(u, w))::INT)), ''), array_to_string(list_transform(b, lambda w: chr((40 + list_position(u, w))::INT)), '')) AS distance FROM p)
SELECT count(*) AS aligned, count(*) FILTER (WHERE ok) AS eligible, count(*) FILTER (WHERE ok AND same_raw) AS raw_identical, count(*) FILTER (WHERE ok AND same) AS token_identical, (sum(distance) FILTER (WHERE ok))::BIGINT AS distance_sum,
  round(avg(distance) FILTER (WHERE ok), 6) AS distance_mean, (max(distance) FILTER (WHERE ok))::BIGINT AS distance_max, count(*) FILTER (WHERE kinds) AS kind_mismatches FROM q"""


# word order in lines


def perm_word_order(spark: SparkSession, d: str, permutations: int = models.PERMUTATIONS, seed: int = 408) -> DataFrame:
    """Rows (r, pairs, equal, near, gallows, difference): statistics of word order in the recorded lines (r = -1) and in
    each permutation of the words within lines."""
    lines = _complete(relation(spark, d, "recs")).select("locus_id", "words")
    sums = resample.replicate_sums(lines, permutations, ["pairs", "equal", "near", "gallows", "difference"], resample.word_order, seed)
    whole = [F.col(c).cast("long").alias(c) for c in ("pairs", "equal", "near", "gallows")]
    return sums.select("r", *whole, F.round("difference", 5).alias("difference"))


def _fractions(stats: DataFrame) -> DataFrame:
    """Shares of permutations at least as extreme as the recorded order; two-sided for the difference in length."""
    observed = F.broadcast(stats.where("r = -1").select([F.col(c).alias(f"o_{c}") for c in ("equal", "near", "gallows", "difference")]))
    both = stats.where("r >= 0").crossJoin(observed)  # one row
    hit = lambda c: (F.abs(F.col(c)) >= F.abs(F.col(f"o_{c}")) - 1e-9) if c == "difference" else F.col(c) >= F.col(f"o_{c}")
    p = [((1 + F.sum(F.when(hit(c), 1).otherwise(0))) / (1 + F.count("*"))).alias(f"p_{c}") for c in ("gallows", "difference", "near", "equal")]
    return both.agg(*p)


def rank_fraction(spark: SparkSession, d: str) -> DataFrame:
    """The p-values of the four statistics of word order."""
    return _fractions(perm_word_order(spark, d)).select([F.round(f"p_{c}", 6).alias(f"p_{c}") for c in ("gallows", "difference", "near", "equal")])


def holm_adjusted(p: DataFrame) -> DataFrame:
    """Rows (name, p, adjusted) of a family of tests (name, p): step-down with a running maximum, at most 1."""
    order = Window.orderBy("p", "name")  # a family of tests is a handful
    ranked = p.withColumn("i", F.row_number().over(order)).crossJoin(p.agg(F.count("*").alias("m")))
    stepped = F.max((F.col("m") - F.col("i") + 1) * F.col("p")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.select("name", F.round("p", 6).alias("p"), F.round(F.least(F.lit(1.0), stepped), 6).alias("adjusted"))


def holm(spark: SparkSession, d: str) -> DataFrame:
    """The p-values of the statistics of word order, adjusted for their number."""
    p = _fractions(perm_word_order(spark, d))
    return holm_adjusted(p.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"p_{c}").alias("p")) for c in ("gallows", "difference", "near", "equal")]))))


_ORDER = f"""ln AS (SELECT locus_id, wp, w, nw FROM {{tok}} WHERE {ELIGIBLE}), rep AS (SELECT unnest(range({models.PERMUTATIONS})) AS r),
al AS (SELECT -1 AS r, locus_id, w, nw, wp AS pos FROM ln UNION ALL SELECT r, locus_id, w, nw, row_number() OVER (PARTITION BY r, locus_id ORDER BY {sql_key(408, 'r', 'locus_id', 'wp')}, wp) - 1 FROM ln, rep),
st AS (SELECT r, nw, w, pos, lag(w) OVER (PARTITION BY r, locus_id ORDER BY pos) AS prev, sum(length(w)) OVER (PARTITION BY r, locus_id) AS total FROM al),
stat AS (SELECT r, count(prev) AS pairs, count(*) FILTER (WHERE w = prev) AS equal, count(*) FILTER (WHERE levenshtein(w, prev) <= 1) AS near, count(*) FILTER (WHERE pos = 0 AND substr(w, 1, 1) IN ('t', 'k', 'p', 'f')) AS gallows,
  round(sum(CASE WHEN pos = 0 THEN length(w) - (total - length(w)) / (nw - 1)::DOUBLE END), 5) AS difference FROM st GROUP BY r),
frac AS (SELECT x.name, (1 + count(*) FILTER (WHERE CASE x.name WHEN 'gallows' THEN s.gallows >= o.gallows WHEN 'near' THEN s.near >= o.near WHEN 'equal' THEN s.equal >= o.equal ELSE abs(s.difference) >= abs(o.difference) - 1e-9 END)) / (1 + count(*))::DOUBLE AS p
  FROM stat s, (SELECT * FROM stat WHERE r = -1) o, (VALUES ('gallows'), ('difference'), ('near'), ('equal')) x(name) WHERE s.r >= 0 GROUP BY x.name)"""


# gains at word boundaries under null models


def gain_table(spark: SparkSession, d: str):
    """table[role, last, first] of the gain in bits, from the train split; its cells are as many as letters allow."""
    import numpy as np

    body = f"WITH {models._BOUNDARY} SELECT 0 AS k, role, '' AS fin, ini, n FROM c1 UNION ALL SELECT 1, role, fin, ini, n FROM c2"
    one, two = np.zeros((3, 26)), np.zeros((3, 26, 26))
    for r in run_body(body, Relations(spark, d, body)).collect():  # 3 * 26 * 27 rows at most
        at = ROLES.index(r.role)
        if r.k:
            two[at, ord(r.fin) - 97, ord(r.ini) - 97] = r.n
        else:
            one[at, ord(r.ini) - 97] = r.n
    p0 = (one + 0.1) / (one.sum(axis=1, keepdims=True) + 2.6)
    p1 = (two + 10 * p0[:, None, :]) / (two.sum(axis=2, keepdims=True) + 10)
    return np.log2(p1) - np.log2(p0)[:, None, :]


def _boundary_null(spark: SparkSession, d: str, same_length: bool, seed: int, replicates: int = models.NULLS) -> DataFrame:
    lines = relation(spark, d, "recs").where("split = 'test' and nw >= 2").select("locus_id", "words")
    sums = resample.replicate_sums(lines, replicates, ["targets", "gain", "changed"], resample.boundary_gain(gain_table(spark, d), same_length), seed)
    return sums.select("r", F.col("targets").cast("long").alias("targets"), F.round(F.col("gain") / F.col("targets"), 6).alias("gain"), F.col("changed").cast("long").alias("changed"))


def null_tail(spark: SparkSession, d: str) -> DataFrame:
    """Gain at word boundaries of the test lines as they are (r = -1) and with the words after the first permuted."""
    return _boundary_null(spark, d, False, 408)


def null_same_length(spark: SparkSession, d: str) -> DataFrame:
    """The same with words changing places among those of equal length only."""
    return _boundary_null(spark, d, True, 409)


def _cell_null(spark: SparkSession, d: str, seed: int, replicates: int, tail: bool) -> DataFrame:
    tok = relation(spark, d, "tok").where("split = 'test' and nw >= 2")
    line = Window.partitionBy("locus_id").orderBy("wp")
    pairs = tok.withColumn("before", F.lag("w").over(line)).where("wp > 0")
    recs = relation(spark, d, "recs").where("folio is not null and volume_id is not null").select("locus_id", "volume_id", "folio")
    role = F.when(F.col("wp") == 1, "0").when(F.col("wp") == F.col("nw") - 1, "2").otherwise("1")
    code = F.concat(role, F.substring("before", -1, 1), F.substring("w", 1, 1))
    item = F.struct("locus_id", "wp", code.alias("code"))
    if tail:
        keys = [role.alias("role"), F.length("before").alias("plen"), F.expr("substr(w, 2)").alias("tail")]
        number = F.col("first") % 1_000_000_007 * 1009 + F.col("plen") * 7 + F.length("tail")
    else:
        keys = ["volume_id", "folio", "wp", (F.col("wp") == F.col("nw") - 1).alias("final"), F.length("before").alias("plen"), F.length("w").alias("tlen")]
        number = F.col("first") % 1_000_000_007 * 1009 + F.col("wp") * 31 + F.col("plen") * 7 + F.col("tlen")
        pairs = pairs.join(recs, "locus_id")
    cells = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"), F.min("locus_id").alias("first"))
    rows = cells.select(number.alias("row"), F.transform("items", lambda x: x["code"]).alias("codes"))
    if tail:  # both ends of the boundary must vary
        ends = lambda k: F.size(F.array_distinct(F.transform("codes", lambda x: F.substring(x, k, 1)))) > 1
        rows = rows.where(ends(2) & ends(3))
    sums = resample.replicate_sums(rows, replicates, ["targets", "gain"], resample.cell_gain(gain_table(spark, d)), seed)
    return sums.select("r", F.col("targets").cast("long").alias("targets"), F.round(F.col("gain") / F.col("targets"), 6).alias("gain"))


def null_matched(spark: SparkSession, d: str, replicates: int = models.NULLS) -> DataFrame:
    """The same with the last letters of the words before permuted among targets of one page, place and pair of lengths."""
    return _cell_null(spark, d, 410, replicates, False)


def null_same_tail_draws(spark: SparkSession, d: str, replicates: int = models.NULLS) -> DataFrame:
    """The same among targets alike but for their first letter, with words before of one length, where both ends vary."""
    return _cell_null(spark, d, 411, replicates, True)


def boundary_null_ranks(spark: SparkSession, d: str) -> DataFrame:
    """For each null model of word boundaries: the recorded gain, the mean of the null and the share at least as high."""
    out = None
    for name, f in (("tail", null_tail), ("same_length", null_same_length), ("matched", null_matched), ("same_tail", null_same_tail_draws)):
        rows = f(spark, d).select("r", "gain")
        seen = F.broadcast(rows.where("r = -1").select(F.col("gain").alias("observed")))
        one = rows.where("r >= 0").crossJoin(seen).agg(
            F.lit(name).alias("null"), F.max("observed").alias("observed"), F.round(F.avg("gain"), 5).alias("mean_gain"),
            F.round((1 + F.sum(F.when(F.col("gain") >= F.col("observed"), 1).otherwise(0))) / (1 + F.count("*")), 6).alias("rank_fraction"),
        )
        out = one if out is None else out.unionByName(one)
    return out


_GAIN = """, g AS (SELECT c.role, f.fin, c.ini, log2((coalesce(c2.n, 0) + 10 * (coalesce(c1.n, 0) + 0.1) / (coalesce(s1.t, 0) + 2.6)) / (coalesce(s2.t, 0) + 10)) - log2((coalesce(c1.n, 0) + 0.1) / (coalesce(s1.t, 0) + 2.6)) AS g
  FROM (SELECT role, chr((97 + i)::INT) AS ini FROM (VALUES ('second'), ('interior'), ('last')) r(role), range(26) x(i)) c, (SELECT chr((97 + i)::INT) AS fin FROM range(26) x(i)) f
  LEFT JOIN c1 ON c1.role = c.role AND c1.ini = c.ini LEFT JOIN s1 ON s1.role = c.role LEFT JOIN c2 ON c2.role = c.role AND c2.fin = f.fin AND c2.ini = c.ini LEFT JOIN s2 ON s2.role = c.role AND s2.fin = f.fin),
ln AS (SELECT locus_id, wp, w, nw FROM {tok} WHERE split = 'test' AND nw >= 2), rep AS (SELECT unnest(range(%d)) AS r)""" % models.NULLS
_SCORED = """, al AS (SELECT -1 AS r, locus_id, nw, w, wp AS pos FROM ln UNION ALL SELECT r, locus_id, nw, w, pos FROM moved UNION ALL SELECT r, locus_id, nw, w, 0 FROM ln, rep WHERE wp = 0),
st AS (SELECT r, locus_id, pos, w, substr(w, 1, 1) AS ini, right(lag(w) OVER (PARTITION BY r, locus_id ORDER BY pos), 1) AS fin, CASE WHEN pos = 1 THEN 'second' WHEN pos = nw - 1 THEN 'last' ELSE 'interior' END AS role FROM al),
ch AS (SELECT s.r, s.locus_id, bool_or(s.w <> l.w) AS moved FROM st s JOIN ln l ON s.locus_id = l.locus_id AND s.pos = l.wp GROUP BY s.r, s.locus_id)
SELECT st.r, count(*) AS targets, round(sum(g.g) / count(*), 6) AS gain, (SELECT count(*) FROM ch WHERE ch.r = st.r AND ch.moved) AS changed FROM st JOIN g ON st.role = g.role AND st.fin = g.fin AND st.ini = g.ini WHERE pos > 0 GROUP BY st.r"""
_TAIL = f"WITH {models._BOUNDARY}{_GAIN}, moved AS (SELECT r, locus_id, nw, w, row_number() OVER (PARTITION BY r, locus_id ORDER BY {sql_key(408, 'r', 'locus_id', 'wp')}, wp) AS pos FROM ln, rep WHERE wp > 0){_SCORED}"
_SAME = f"""WITH {models._BOUNDARY}{_GAIN}, slot AS (SELECT locus_id, wp, length(w) AS len, row_number() OVER (PARTITION BY locus_id, length(w) ORDER BY wp) AS k FROM ln WHERE wp > 0),
item AS (SELECT r, locus_id, nw, w, length(w) AS len, row_number() OVER (PARTITION BY r, locus_id, length(w) ORDER BY {sql_key(409, 'r', 'locus_id', 'wp')}, wp) AS k FROM ln, rep WHERE wp > 0),
moved AS (SELECT i.r, i.locus_id, i.nw, i.w, s.wp AS pos FROM item i JOIN slot s ON i.locus_id = s.locus_id AND i.len = s.len AND i.k = s.k){_SCORED}"""
_TAILS = f"""WITH {models._BOUNDARY}{_GAIN}, pr AS (SELECT locus_id, wp, w, nw, lag(w) OVER (PARTITION BY locus_id ORDER BY wp) AS before FROM ln),
ce AS (SELECT locus_id, wp, substr(w, 1, 1) AS ini, right(before, 1) AS fin, CASE WHEN wp = 1 THEN 'second' WHEN wp = nw - 1 THEN 'last' ELSE 'interior' END AS role, length(before) AS plen, substr(w, 2) AS tail FROM pr WHERE wp > 0),
ok AS (SELECT role, plen, tail, min(locus_id) AS first_id FROM ce GROUP BY role, plen, tail HAVING count(DISTINCT ini) > 1 AND count(DISTINCT fin) > 1),
nu AS (SELECT ce.*, ce.role || '/' || ce.plen || '/' || ce.tail AS cell, ok.first_id % 1000000007 * 1009 + ce.plen * 7 + length(ce.tail) AS id, row_number() OVER (PARTITION BY ce.role, ce.plen, ce.tail ORDER BY ce.locus_id, ce.wp) - 1 AS place
  FROM ce JOIN ok ON ce.role = ok.role AND ce.plen = ok.plen AND ce.tail = ok.tail),
it AS (SELECT r, cell, fin, row_number() OVER (PARTITION BY r, cell ORDER BY {sql_key(411, 'r', 'id', 'place')}, place) - 1 AS pos FROM nu, rep),
x AS (SELECT it.r, nu.role, it.fin, nu.ini FROM nu JOIN it ON nu.cell = it.cell AND nu.place = it.pos UNION ALL SELECT -1, role, fin, ini FROM nu)
SELECT x.r, count(*) AS targets, round(sum(g.g) / count(*), 6) AS gain FROM x JOIN g ON x.role = g.role AND x.fin = g.fin AND x.ini = g.ini GROUP BY x.r"""
_MATCHED = f"""WITH {models._BOUNDARY}{_GAIN}, pr AS (SELECT locus_id, wp, w, nw, lag(w) OVER (PARTITION BY locus_id ORDER BY wp) AS before FROM ln),
ce AS (SELECT p.locus_id, p.wp, substr(p.w, 1, 1) AS ini, right(p.before, 1) AS fin, CASE WHEN p.wp = 1 THEN 'second' WHEN p.wp = p.nw - 1 THEN 'last' ELSE 'interior' END AS role,
  r.volume_id || '/' || r.folio || '/' || p.wp || '/' || (p.wp = p.nw - 1) || '/' || length(p.before) || '/' || length(p.w) AS cell, p.wp * 31 + length(p.before) * 7 + length(p.w) AS more
  FROM pr p JOIN {{recs}} r ON p.locus_id = r.locus_id WHERE p.wp > 0 AND r.folio IS NOT NULL AND r.volume_id IS NOT NULL),
nu AS (SELECT *, min(locus_id) OVER (PARTITION BY cell) % 1000000007 * 1009 + more AS id, row_number() OVER (PARTITION BY cell ORDER BY locus_id, wp) - 1 AS place FROM ce),
it AS (SELECT r, cell, fin, row_number() OVER (PARTITION BY r, cell ORDER BY {sql_key(410, 'r', 'id', 'place')}, place) - 1 AS pos FROM nu, rep),
x AS (SELECT it.r, nu.role, it.fin, nu.ini FROM nu JOIN it ON nu.cell = it.cell AND nu.place = it.pos UNION ALL SELECT -1, role, fin, ini FROM nu)
SELECT x.r, count(*) AS targets, round(sum(g.g) / count(*), 6) AS gain FROM x JOIN g ON x.role = g.role AND x.fin = g.fin AND x.ini = g.ini GROUP BY x.r"""


# lines of a page


def column_asof(spark: SparkSession, d: str) -> DataFrame:
    """Words of language B in the test split and the words above them, by column: how many, how many are equal, how many
    have controls, and the mean excess of similarity over these. A line has the words of the line before by its side, so
    that pages are the only shuffle after the records."""
    lines = _complete(relation(spark, d, "recs")).where("ll = 'B' and split = 'test' and folio is not null and volume_id is not null")
    page = Window.partitionBy("volume_id", "folio").orderBy(F.asc_nulls_last("source_order"), "locus_id")
    pairs = lines.select("words", F.lag("words").over(page).alias("above")).where("above is not null")
    upto = lambda words, n: F.length(F.array_join(F.slice(words, 1, n), " ")) + F.least(n, F.lit(1))
    ends = F.transform("above", lambda _, i: upto(F.col("above"), i + 1))
    word = F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"), upto(F.col("words"), i).alias("column")))
    each = pairs.select("above", ends.alias("ends"), F.explode(word).alias("t")).select("above", "t.*", F.size(F.filter("ends", lambda e: e < F.col("t.column"))).alias("k"))
    each = each.withColumn("k", F.when(F.col("k") < F.size("above"), F.col("k")).otherwise(F.least(F.size("above") - 1, "i"))).withColumn("y", F.get("above", "k"))
    like = lambda y: 1 - F.levenshtein("w", y) / F.greatest(F.length("w"), F.length(y)).cast("double")
    controls = F.transform(F.filter("above", lambda c, i: (i != F.col("k")) & (F.length(c) == F.length("y"))), like)
    each = each.select("w", "y", like(F.col("y")).alias("own"), controls.alias("controls"))
    control = F.aggregate("controls", F.lit(0.0), lambda a, x: a + x) / F.size("controls")
    some = F.size("controls") > 0
    return each.agg(F.count("*").alias("candidates"), F.count_if(F.col("w") == F.col("y")).alias("equal"), F.count_if(some).alias("targets"), F.round(F.avg(F.when(some, F.col("own") - control)), 6).alias("excess"))


def line_order_perm(spark: SparkSession, d: str, permutations: int = LINE_ORDERS) -> DataFrame:
    """Similarity excess of words below each other on pages of language B in the test split: as recorded, and over
    permutations of the lines of each page."""
    lines = _complete(relation(spark, d, "recs")).where("ll = 'B' and split = 'test' and folio is not null and volume_id is not null")
    item = F.struct("source_order", "locus_id", F.array_join("words", " ").alias("line"))
    pages = lines.groupBy("volume_id", "folio").agg(F.array_sort(F.collect_list(item)).alias("items"), F.min("locus_id").alias("page"))
    pages = pages.where(F.size("items") > 1).select("page", F.transform("items", lambda x: x["line"]).alias("lines"))
    sums = spool(resample.column_sums(pages, permutations, 170919), "line_orders")
    score = sums.select("r", (F.col("excess") / F.nullif(F.col("targets"), F.lit(0.0))).alias("score"), F.col("targets").cast("long").alias("targets"))
    seen = F.broadcast(score.where("r = -1").select(F.col("score").alias("observed")))
    return score.where("r >= 0").crossJoin(seen).agg(
        F.count("*").alias("permutations"), F.round(F.max("observed"), 6).alias("observed"), F.round(F.avg("score"), 6).alias("mean"),
        F.round((1 + F.sum(F.when(F.col("score") >= F.col("observed") - 1e-12, 1).otherwise(0))) / (1 + F.count("*")), 6).alias("p_value"),
        F.min("targets").alias("least_targets"), F.max("targets").alias("most_targets"),
    )


def cyclic_rotation(spark: SparkSession, d: str) -> DataFrame:
    """Rows (study, panels, observed, mean, p_upper): per volume, how often a page's cycle of paragraph lines agrees with its
    cycle of lines without doubt, against all rotations of each page by itself; empty lines are unknown."""
    recs = relation(spark, d, "recs").where("folio is not null and volume_id is not null")
    item = F.struct("source_order", "locus_id", F.coalesce("paragraph", F.lit(False)).alias("p"), F.when(F.col("nw") > 0, F.col("excluded") == 0).alias("o"))
    panels = recs.groupBy(F.col("volume_id").alias("study"), "folio").agg(F.array_sort(F.collect_list(item)).alias("items"))
    panels = panels.select("study", F.transform("items", lambda x: x["p"]).alias("predicted"), F.transform("items", lambda x: x["o"]).alias("observed"))
    out = resample.rotations(panels)
    return out.select("study", "panels", "observed", F.round("mean", 6).alias("mean"), F.round("p_upper", 6).alias("p_upper"))


def likelihood_ratio_cells(spark: SparkSession, d: str) -> DataFrame:
    """Rows (cells, pairs, variable_cells, log2_ratio, open_cells): endpoints of lines that follow each other, the last letter
    of one and the first of the next, under the table of word boundaries inside lines, against all arrangements within
    cells of one page, place of the line before and lengths being alike. Every cell is summed in full; none is left open."""
    table = gain_table(spark, d)
    recs = _complete(relation(spark, d, "recs")).where("split = 'test' and folio is not null and volume_id is not null and idx is not null")
    page = Window.partitionBy("volume_id", "folio").orderBy("source_order", "locus_id")
    ends = recs.select("volume_id", "folio", "idx", "source_order", "locus_id", F.element_at("words", 1).alias("first"), F.element_at("words", -1).alias("last"))
    pairs = ends.withColumn("before", F.lag("last").over(page)).withColumn("at", F.lag("idx").over(page)).where("idx = at + 1")
    cells = pairs.groupBy("volume_id", "folio", (F.col("at") == 1).alias("opens"), F.length("before").alias("a"), F.length("first").alias("b"))
    cells = cells.agg(F.array_sort(F.collect_list(F.struct("source_order", "locus_id", F.substring("before", -1, 1).alias("x"), F.substring("first", 1, 1).alias("y")))).alias("items"))
    cells = cells.select(F.transform("items", lambda i: i["x"]).alias("x"), F.transform("items", lambda i: i["y"]).alias("y"))

    def run(frames):
        import pandas as pd

        chance = lambda x, y: 2.0 ** table[1, ord(x) - 97, ord(y) - 97]
        for f in frames:
            out = [(len(x), len(set(x)) > 1 and len(set(y)) > 1, resample.cell_log_ratio(list(x), list(y), chance)) for x, y in zip(f["x"], f["y"])]
            yield pd.DataFrame(out, columns=["pairs", "variable", "ratio"])

    done = cells.mapInPandas(run, "pairs long, variable boolean, ratio double")
    return done.agg(F.count("*").alias("cells"), F.sum("pairs").alias("pairs"), F.sum(F.col("variable").cast("long")).alias("variable_cells"), F.round(F.sum("ratio"), 4).alias("log2_ratio"), F.sum(F.col("ratio").isNull().cast("long")).alias("open_cells"))


# spans


def strict_spans(spark: SparkSession, d: str) -> DataFrame:
    return spans.strict_spans(relation(spark, d, "recs").select("locus_id", "text_raw"), "locus_id", "text_raw")


def project_source(spark: SparkSession, d: str) -> DataFrame:
    recs = relation(spark, d, "recs").where("excluded = 0 and nw > 0 and text_raw is not null").select("locus_id", "text_raw", "words")
    return spans.project_source(recs, "locus_id", "text_raw", "words")


def local_repeat_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Rows (transcriber, representation, ...): words of clean spans, their units, and neighbouring equal units, with the
    number of words that have any; words are numbered anew in each locus."""
    recs = relation(spark, d, "recs")
    clean = spool(spans.strict_spans(recs.select("locus_id", "text_raw"), "locus_id", "text_raw").where("reason is null").join(recs.select("locus_id", "transcriber"), "locus_id"), "spans")
    out = None
    for name, pattern in (("raw", "(.)"), ("visual", "(cth|ckh|cph|cfh|ch|sh|.)")):
        u = F.regexp_extract_all("surface", F.lit(pattern), F.lit(1))
        equal = F.aggregate(F.sequence(F.lit(1), F.size("u")), F.lit(0), lambda n, k: n + F.when((k > 1) & (F.element_at("u", k) == F.element_at("u", F.greatest(k - 1, F.lit(1)))), 1).otherwise(0))
        one = clean.withColumn("u", u).withColumn("same", equal).groupBy(F.coalesce("transcriber", F.lit("?")).alias("transcriber")).agg(
            F.lit(name).alias("representation"), F.count("*").alias("words"), F.sum(F.size("u")).alias("units"), F.sum(F.size("u") - 1).alias("adjacent"),
            F.sum("same").cast("long").alias("certificates"), F.sum((F.col("same") > 0).cast("long")).alias("affected"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def count_vector(spark: SparkSession, d: str) -> DataFrame:
    """Rows (locus_id, il, u, n): for each line that has words its row of a linear system, by its entries: how often each visual
    unit stands in it, ' ' the spaces between its words, which may be 0, and '|' one for the line."""
    lines, counts = views.line_vectors(relation(spark, d, "recs"))
    entries = F.filter(F.array(*[F.struct(F.lit(u).alias("u"), n.alias("n")) for u, n in counts.items()]), lambda x: (x["n"] > 0) | (x["u"] == " "))
    return lines.select("locus_id", "il", F.inline(entries))


_VECTOR = """SELECT r.locus_id, r.il, x.u, x.n FROM {recs} r JOIN (SELECT locus_id, u, count(*) AS n FROM {visual} GROUP BY locus_id, u
  UNION ALL SELECT locus_id, ' ', nw - 1 FROM {recs} WHERE nw > 0 UNION ALL SELECT locus_id, '|', 1 FROM {recs} WHERE nw > 0) x ON r.locus_id = x.locus_id"""


def alternation(spark: SparkSession, d: str) -> DataFrame:
    """Rows (a, b, n_lines, alternating): in how many lines two visual units stand, either or both, and in how many of them
    they take turns with counts that differ by one at most. Lines are read where they lie."""
    lines = relation(spark, d, "recs").where("nw > 0").select("locus_id", "words")
    return graphs.unit_turns(lines, "locus_id", "words").select("a", "b", F.col("parts").alias("n_lines"), F.col("turns").alias("alternating"))


def compat_graph(spark: SparkSession, d: str) -> DataFrame:
    """Rows (a, b, partitions, fits, openers, edge): the same for physical groups; an edge joins units that take turns in
    every group in which either stands, and of which the same one always comes first."""
    lines = relation(spark, d, "recs").where("nw > 0 and grp is not null").select("grp", "locus_id", "words")
    lines = lines.repartition("grp").sortWithinPartitions("grp", "locus_id")
    turns = graphs.unit_turns(lines, "grp", "words")
    openers = (F.col("a_first") > 0).cast("long") + (F.col("b_first") > 0).cast("long")
    return turns.select("a", "b", F.col("parts").alias("partitions"), F.col("turns").alias("fits"), openers.alias("openers"), ((F.col("turns") == F.col("parts")) & (openers == 1)).alias("edge"))


_ALTERNATION = """WITH pairs AS (SELECT a.u AS a, b.u AS b FROM (SELECT DISTINCT u FROM {visual}) a JOIN (SELECT DISTINCT u FROM {visual}) b ON a.u < b.u),
of_unit AS (SELECT a AS u, a, b FROM pairs UNION ALL SELECT b, a, b FROM pairs),
hit AS (SELECT p.a, p.b, v.locus_id, v.wp, v.up, v.u FROM {visual} v JOIN of_unit p ON v.u = p.u),
runs AS (SELECT a, b, locus_id, u, lag(u) OVER (PARTITION BY a, b, locus_id ORDER BY wp, up) AS prev FROM hit),
lines AS (SELECT a, b, locus_id, max(CASE WHEN u = prev THEN 1 ELSE 0 END) AS twice, abs(sum(CASE WHEN u = a THEN 1 ELSE -1 END)) AS off FROM runs GROUP BY a, b, locus_id)
SELECT a, b, count(*) AS n_lines, count(*) FILTER (WHERE twice = 0 AND off <= 1) AS alternating FROM lines GROUP BY a, b"""


_COMPATIBLE = """WITH pairs AS (SELECT a.u AS a, b.u AS b FROM (SELECT DISTINCT u FROM {visual}) a JOIN (SELECT DISTINCT u FROM {visual}) b ON a.u < b.u),
of_unit AS (SELECT a AS u, a, b FROM pairs UNION ALL SELECT b, a, b FROM pairs),
hit AS (SELECT p.a, p.b, v.grp, v.locus_id, v.wp, v.up, v.u FROM {visual} v JOIN of_unit p ON v.u = p.u WHERE v.grp IS NOT NULL),
runs AS (SELECT a, b, grp, u, lag(u) OVER (PARTITION BY a, b, grp ORDER BY locus_id, wp, up) AS prev FROM hit),
parts AS (SELECT a, b, grp, max(CASE WHEN u = prev THEN 1 ELSE 0 END) AS twice, abs(sum(CASE WHEN u = a THEN 1 ELSE -1 END)) AS off, min(CASE WHEN prev IS NULL THEN u END) AS opens FROM runs GROUP BY a, b, grp)
SELECT a, b, count(*) AS partitions, count(*) FILTER (WHERE twice = 0 AND off <= 1) AS fits, count(DISTINCT opens) AS openers,
       min(CASE WHEN twice = 0 AND off <= 1 THEN 1 ELSE 0 END) = 1 AND count(DISTINCT opens) = 1 AS edge FROM parts GROUP BY a, b"""


# words of paragraphs


def adapt_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Rows (split_rank, paragraphs, empties, duplicates, tokens, rejected, roman): paragraphs in words a-z by the split of
    their chapter; duplicates repeat the words of a paragraph of an earlier split."""
    paras = relation(spark, d, "paras").where("book_id is not null and chapter_key is not null").select("paragraph_id", "book_id", "chapter_key", F.posexplode_outer(text.alpha_runs(F.col("text"))).alias("at", "run"))
    word = paras.withColumn("w", text.normalize_word("run"))
    item = F.when(F.col("w").isNotNull(), F.struct("at", "w"))
    one = word.groupBy("paragraph_id", "book_id", "chapter_key").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["w"]), " ").alias("seq"), F.count("w").alias("tokens"), (F.count("run") - F.count("w")).alias("rejected"),
        F.sum(F.when(text.roman_like(F.col("w")), 1).otherwise(0)).alias("roman"),
    )
    one = spool(one, "paragraphs")
    chapters = one.groupBy("book_id", "chapter_key").agg(F.min("paragraph_id").alias("first"))
    book = Window.partitionBy("book_id")
    i, k = F.row_number().over(book.orderBy("first")) - 1, F.count("*").over(book)
    rank = F.when(F.col("i") < F.floor(F.col("k") * 6 / 10), 0).when(F.col("i") < F.floor(F.col("k") * 6 / 10) + F.floor(F.col("k") * 2 / 10), 1).otherwise(2)
    placed = one.join(chapters.withColumn("i", i).withColumn("k", k).select("book_id", "chapter_key", rank.alias("split_rank")), ["book_id", "chapter_key"])
    first = placed.groupBy("seq").agg(F.min("split_rank").alias("first_rank"))
    both = placed.join(first, "seq")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return both.groupBy("split_rank").agg(
        F.count("*").alias("paragraphs"), n(F.col("seq") == "").alias("empties"), n((F.col("seq") != "") & (F.col("split_rank") > F.col("first_rank"))).alias("duplicates"),
        F.sum("tokens").alias("tokens"), F.sum("rejected").alias("rejected"), F.sum("roman").alias("roman"),
    )


_ADAPTED = r"""WITH p AS (SELECT paragraph_id, book_id, chapter_key, regexp_extract_all(text, '\p{L}[\p{L}\p{M}]*') AS runs FROM {paras} WHERE book_id IS NOT NULL AND chapter_key IS NOT NULL),
q AS (SELECT *, list_transform(runs, lambda r: regexp_replace(lower(strip_accents(nfc_normalize(replace(r, 'ſ', 's')))), '\p{M}', '', 'g')) AS ws FROM p),
one AS (SELECT paragraph_id, book_id, chapter_key, coalesce(list_filter(ws, lambda w: regexp_full_match(w, '[a-z]+')), []::VARCHAR[]) AS ok, coalesce(len(ws), 0) AS n FROM q),
c AS (SELECT book_id, chapter_key, min(paragraph_id) AS first_at FROM one GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY first_at) - 1 AS i, count(*) OVER (PARTITION BY book_id) AS k FROM c),
s AS (SELECT o.*, array_to_string(o.ok, ' ') AS seq, CASE WHEN i < floor(k * 6 / 10) THEN 0 WHEN i < floor(k * 6 / 10) + floor(k * 2 / 10) THEN 1 ELSE 2 END AS split_rank FROM one o JOIN k USING (book_id, chapter_key)),
m AS (SELECT seq, min(split_rank) AS first_rank FROM s GROUP BY seq)
SELECT split_rank, count(*) AS paragraphs, count(*) FILTER (WHERE seq = '') AS empties, count(*) FILTER (WHERE seq <> '' AND split_rank > first_rank) AS duplicates, sum(len(ok))::BIGINT AS tokens, sum(n - len(ok))::BIGINT AS rejected,
  sum(len(list_filter(ok, lambda w: regexp_full_match(w, '[ivxlcdm]+'))))::BIGINT AS roman FROM s JOIN m USING (seq) GROUP BY split_rank"""


def _word_forms(spark: SparkSession, d: str) -> DataFrame:
    from lociflow.runtime import table

    return table(spark, d, "run_records").where("rec_id is not null").dropDuplicates(["rec_id"]).select(F.explode("tokens").alias("form")).groupBy("form").agg(F.count("*").alias("n"))


def normalize_word(spark: SparkSession, d: str) -> DataFrame:
    """Rows (form, word, n): the distinct word forms of the run records and what they are in letters a-z, null for others."""
    return _word_forms(spark, d).select("form", text.normalize_word("form").alias("word"), "n")


_FORMS = r"""WITH once AS (SELECT DISTINCT ON (rec_id) * FROM run_records WHERE rec_id IS NOT NULL), f AS (SELECT form, count(*) AS n FROM (SELECT unnest(tokens) AS form FROM once) GROUP BY form),
g AS (SELECT form, n, regexp_replace(lower(strip_accents(nfc_normalize(replace(form, 'ſ', 's')))), '\p{M}', '', 'g') AS w FROM f) SELECT form, CASE WHEN regexp_full_match(w, '[a-z]+') THEN w END AS word, n FROM g"""


@F.pandas_udf(StringType())
def _plain_letters(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else tablecipher.plain_letters(t))


@F.pandas_udf(ArrayType(StringType()))
def _respaced(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: tablecipher.respaced(t or "", random.Random(f"408:{t}")))


def normalize_plaintext(spark: SparkSession, d: str) -> DataFrame:
    """Rows (letter, n): letters of the paragraphs as the table cipher takes them."""
    letters = relation(spark, d, "paras").select(_plain_letters("text").alias("t"))
    return letters.select(F.explode(F.regexp_extract_all("t", F.lit("(.)"), F.lit(1))).alias("letter")).groupBy("letter").agg(F.count("*").alias("n"))


_PLAIN = r"""WITH t AS (SELECT regexp_replace(lower(strip_accents(nfc_normalize(text))), '\p{M}', '', 'g') AS t FROM {paras}), u AS (SELECT replace(replace(replace(replace(replace(replace(replace(t, 'æ', 'ae'), 'œ', 'oe'), 'ð', 'd'), 'þ', 'th'), 'ł', 'l'), 'ß', 'ss'), 'ø', 'o') AS t FROM t),
v AS (SELECT unnest(regexp_extract_all(replace(replace(replace(t, 'w', 'uu'), 'j', 'i'), 'k', 'c'), '\p{L}')) AS letter FROM u) SELECT letter, count(*) AS n FROM v GROUP BY letter"""


def respace(spark: SparkSession, d: str) -> DataFrame:
    """Rows (size, units, types): units of one and two letters that the paragraphs' letters are cut into by chance."""
    units = relation(spark, d, "paras").select(F.explode(_respaced(_plain_letters("text"))).alias("u"))
    return units.groupBy(F.length("u").alias("size")).agg(F.count("*").alias("units"), F.count_distinct("u").alias("types"))


def unit_masks(spark: SparkSession, d: str) -> DataFrame:
    """Rows (bits, types, masks): the visual units of each distinct word as bits, by how many are set, and how many sets there are."""
    units = F.regexp_extract_all("w", F.lit("(cth|ckh|cph|cfh|ch|sh|.)"), F.lit(1))
    words = relation(spark, d, "types").select("w").distinct().select(text.mask_of(units, graphs.UNITS).alias("mask"))
    return words.groupBy(text.set_bits(F.col("mask")).cast("long").alias("bits")).agg(F.count("*").alias("types"), F.count_distinct("mask").alias("masks"))


_MASKS = """WITH u AS (SELECT w, list_sort(list_distinct(regexp_extract_all(w, '(cth|ckh|cph|cfh|ch|sh|.)', 1))) AS s FROM (SELECT DISTINCT w FROM {types}))
SELECT len(s)::BIGINT AS bits, count(*) AS types, count(DISTINCT s) AS masks FROM u GROUP BY len(s)"""


def text_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Rows (size, blocks): paragraphs in consecutive blocks of 64 characters, the last of each being what is left."""
    blocks = relation(spark, d, "paras").select(F.explode(text.fixed_blocks(F.col("text"))).alias("b"))
    return blocks.groupBy(F.length("b").cast("long").alias("size")).agg(F.count("*").alias("blocks"))


_BLOCKS = """WITH b AS (SELECT length(text) AS n, unnest(range(0, length(text), 64)) AS at_ FROM {paras} WHERE length(text) > 0) SELECT least(64, n - at_)::BIGINT AS size, count(*) AS blocks FROM b GROUP BY least(64, n - at_)"""


def similar_lines(spark: SparkSession, d: str) -> DataFrame:
    """Rows (tenths, pairs): how alike each line is to the one before it on its page, letter by letter, in tenths."""
    page = Window.partitionBy("volume_id", "folio").orderBy("source_order", "locus_id")
    lines = relation(spark, d, "recs").where("nw > 0 and folio is not null and volume_id is not null").select("volume_id", "folio", "source_order", "locus_id", F.array_join("words", "").alias("s"))
    near = lines.withColumn("before", F.lag("s").over(page)).where("before is not null").select(text.edit_similarity(F.col("s"), F.col("before")).alias("x"))
    return near.groupBy(F.floor(F.round(F.col("x") * 10, 6)).alias("tenths")).agg(F.count("*").alias("pairs"))


_SIMILAR = """WITH l AS (SELECT volume_id, folio, source_order, locus_id, array_to_string(words, '') AS s FROM {recs} WHERE nw > 0 AND folio IS NOT NULL AND volume_id IS NOT NULL),
p AS (SELECT s, lag(s) OVER (PARTITION BY volume_id, folio ORDER BY source_order, locus_id) AS b FROM l)
SELECT floor(round((1 - levenshtein(s, b) / greatest(length(s), length(b))::DOUBLE) * 10, 6))::BIGINT AS tenths, count(*) AS pairs FROM p WHERE b IS NOT NULL GROUP BY 1"""


# conflicts of cipher types


def conflict_self_join(spark: SparkSession, d: str, top: int = CONFLICT_TYPES) -> DataFrame:
    """Rows (a, b): pairs of the `top` heaviest cipher types with candidates of which no two candidates go together under one
    injective key."""
    body = f"WITH {joins._SAMPLES} SELECT c.w, c.pattern, c.c * n.t + n.k AS weight FROM cip c CROSS JOIN n JOIN (SELECT DISTINCT pattern FROM lex) l ON c.pattern = l.pattern ORDER BY weight DESC, w LIMIT {top}"
    rel = Relations(spark, d, body)
    head = spool(run_body(body, rel), "head")
    lex = rel["types"].where("split = 'train'").select("pattern", F.col("w").alias("x"))
    lists = spool(head.join(lex, "pattern").groupBy("w").agg(F.sort_array(F.collect_list("x")).alias("xs")), "candidates")
    pairs = lists.select(F.col("w").alias("a"), F.col("xs").alias("x")).join(lists.select(F.col("w").alias("b"), F.col("xs").alias("y")), F.col("a") < F.col("b"))

    def run(frames):
        import pandas as pd

        for f in frames:
            yield pd.DataFrame([(a, b) for a, b, x, y in zip(f["a"], f["b"], f["x"], f["y"]) if not jointly(a, b, list(x), list(y))], columns=["a", "b"])

    return pairs.repartition(top, "a", "b").mapInPandas(run, "a string, b string")


def takes(cipher: tuple[int, ...], plain: tuple[int, ...], most: int) -> bool:
    """Whether a word of the pattern `plain` can stand for a cipher word of the pattern `cipher`: each unit for one letter, and
    at most `most` units for a letter."""
    key: dict[int, int] = {}
    for u, v in zip(cipher, plain):
        if key.setdefault(u, v) != v:
            return False
    used: dict[int, int] = {}
    for v in key.values():
        used[v] = used.get(v, 0) + 1
        if used[v] > most:
            return False
    return True


def capacity_join(spark: SparkSession, d: str, most: int = 2) -> DataFrame:
    """Rows (w, candidates): for each cipher type the train words that it can stand for when up to `most` units may have one
    letter. Patterns of repeats decide, so patterns meet, not words; those of the train words are sent to the tasks once
    counted to be few, else they meet in a shuffled join."""
    rel = Relations(spark, d, "{types}{types}")
    lex = rel["types"].where("split = 'train'").groupBy("pattern").agg(F.count("*").alias("n"))
    rows = lex.limit(BROADCAST_ROWS + 1).collect()
    if len(rows) > BROADCAST_ROWS:
        return run_body(joins.CAPACITY_JOIN, rel)
    shape = lambda p: tuple(map(int, p.split(".")))
    by: dict[tuple[int, int], list[tuple[tuple[int, ...], int]]] = {}
    for r in rows:
        x = shape(r.pattern)
        by.setdefault((len(x), max(x) + 1), []).append((x, r.n))
    known = spark.sparkContext.broadcast(by)

    def run(frames):
        for f in frames:
            out = []
            for p in f["pattern"]:
                x = shape(p)
                k = max(x) + 1
                out.append(sum(n for m in range(-(-k // most), k + 1) for y, n in known.value.get((len(x), m), ()) if takes(x, y, most)))
            yield pd.DataFrame({"pattern": f["pattern"], "candidates": out})

    cipher = rel["types"].where("split = 'validation'").select("w", "pattern")
    counted = cipher.select("pattern").distinct().repartition(4 * spark.sparkContext.defaultParallelism).mapInPandas(run, "pattern string, candidates long")
    return cipher.join(counted, "pattern").select("w", "candidates")


def jointly(a: str, b: str, x: list[str], y: list[str]) -> bool:
    """Whether some candidate of `a` and some of `b` agree on the units that both have and give other units other letters."""
    shared = sorted(set(a) & set(b))
    of_a, of_b = [a.index(u) for u in shared], [b.index(u) for u in shared]
    by: dict[tuple, list[set]] = {}
    for word in y:
        by.setdefault(tuple(word[k] for k in of_b), []).append(set(word))
    for word in x:
        key = tuple(word[k] for k in of_a)
        rest = set(word) - set(key)
        if any(not (letters & rest) for letters in by.get(key, ())):
            return True
    return False


QUERIES = {
    f.__name__: f
    for f in (
        agreement_agg, perm_word_order, rank_fraction, holm, null_tail, null_same_length, null_matched, null_same_tail_draws, boundary_null_ranks, column_asof, line_order_perm, cyclic_rotation, likelihood_ratio_cells,
        strict_spans, project_source, local_repeat_tracks, count_vector, alternation, compat_graph, adapt_paragraphs, normalize_word, normalize_plaintext, respace, unit_masks, text_blocks, similar_lines, conflict_self_join, capacity_join,
    )
}
SQL = {
    "agreement_agg": oracle(_AGREEMENT),
    "perm_word_order": oracle(f"WITH {_ORDER} SELECT r, pairs, equal, near, gallows, difference FROM stat"),
    "rank_fraction": oracle(f"WITH {_ORDER} SELECT " + ", ".join(f"round(max(p) FILTER (WHERE name = '{c}'), 6) AS p_{c}" for c in ("gallows", "difference", "near", "equal")) + " FROM frac"),
    "holm": oracle(f"WITH {_ORDER}, k AS (SELECT name, p, (5 - row_number() OVER (ORDER BY p, name)) * p AS x FROM frac) SELECT name, round(p, 6) AS p, round(least(1, max(x) OVER (ORDER BY p, name)), 6) AS adjusted FROM k"),
    "count_vector": oracle(_VECTOR),
    "alternation": oracle(_ALTERNATION),
    "compat_graph": oracle(_COMPATIBLE),
    "null_tail": oracle(_TAIL),
    "null_same_length": oracle(_SAME),
    "null_matched": oracle(_MATCHED),
    "null_same_tail_draws": oracle(_TAILS),
    "adapt_paragraphs": oracle(_ADAPTED),
    "unit_masks": oracle(_MASKS),
    "text_blocks": oracle(_BLOCKS),
    "similar_lines": oracle(_SIMILAR),
    "capacity_join": oracle(joins.CAPACITY_JOIN),
    "column_asof": oracle(joins.COLUMN_ASOF),
    "normalize_word": _FORMS,
    "normalize_plaintext": oracle(_PLAIN),
}
