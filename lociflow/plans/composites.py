"""Studies composed of other queries: runs with a report, comparisons of corpora, controls that gate what follows."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.operators import graphs, keysearch, resample, solvers
from lociflow.plans import joins, models, searches, statistics, studies
from lociflow.plans.shared import Relations, oracle, query, run_body
from lociflow.runtime import spool
from lociflow.sources import sinks
from lociflow.sources.freeze import fit_before_test

_STRUCTURE = ("inventory", "inventory_by", "entropy_h1", "entropy_h2", "invariants", "ngram_score", "bigram_score", "unseen_words")


def _named(spark: SparkSession, d: str, name: str) -> DataFrame:
    for module in (statistics, joins, models):
        if name in module.BODIES:
            return query(module.BODIES[name])(spark, d)
    return {**studies.QUERIES, **searches.QUERIES}[name](spark, d)


def structural_run(spark: SparkSession, d: str) -> DataFrame:
    """Rows (part, row): what a structural run reports, each result's rows as JSON: inventories, entropies, models, word order
    with adjusted p-values, and the interval of the bigram's gain over groups."""
    out = None
    for name in (*_STRUCTURE, "holm"):
        rows = _named(spark, d, name)
        part = rows.select(F.lit(name).alias("part"), F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("row"))
        out = part if out is None else out.unionByName(part)
    gains = _named(spark, d, "bootstrap_groups").orderBy("gain").select("gain")
    rank = gains.agg(F.array_sort(F.collect_list("gain")).alias("g"))  # as many as there are draws
    at = lambda q: F.element_at("g", (F.lit(q) * (F.size("g") - 1)).cast("int") + 1)
    interval = rank.select(F.lit("gain_interval").alias("part"), F.to_json(F.struct(at(0.025).alias("low"), at(0.975).alias("high"))).alias("row"))
    return out.unionByName(interval)


def write_structural_run(spark: SparkSession, d: str, path: str) -> None:
    """The same as a run's folder with its report; an existing one is refused."""
    tables = {name: _named(spark, d, name) for name in (*_STRUCTURE, "holm")}
    analysis = {name: [r.asDict() for r in df.limit(1000).collect()] for name, df in tables.items()}
    records = Relations(spark, d, "{recs}")["recs"].select("locus_id", "folio", "split", "nw", "excluded")
    sinks.write_run(records, analysis, sinks.render_report("Structural run", tables), path)


def first_stage_summary(spark: SparkSession, d: str) -> str:
    """A Markdown report of the two transcribers' agreement and the structural results."""
    parts = {name: _named(spark, d, name) for name in ("agreement_agg", "align_full_outer", "elig_agreement", "mismatch_limit", *_STRUCTURE, "holm")}
    return sinks.render_report("Summary", parts)


_CORPORA = """samples AS (SELECT 'loci' AS corpus, split, w, n FROM {types} WHERE split IS NOT NULL
  UNION ALL SELECT 'paragraphs', split, w, count(*) FROM (SELECT w, CASE WHEN h < 'a' THEN 'train' WHEN h < 'd' THEN 'validation' ELSE 'test' END AS split FROM (SELECT w, substr(md5(coalesce(chapter_key, '')), 1, 1) AS h FROM {pwords})) GROUP BY split, w),
cut AS (SELECT corpus, split, w, n, explode_(length(w)) AS i FROM samples), u AS (SELECT corpus, split, n, substr(w, cast(i AS INT), 1) AS ch FROM cut),
ue AS (SELECT corpus, split, count(*) AS alphabet, cast(sum(n) AS BIGINT) AS units, round(-sum(n / t * log2(n / t)), 6) AS unit_entropy FROM (SELECT corpus, split, n, cast(sum(n) OVER (PARTITION BY corpus, split) AS DOUBLE) AS t FROM (SELECT corpus, split, ch, sum(n) AS n FROM u GROUP BY corpus, split, ch)) GROUP BY corpus, split),
we AS (SELECT corpus, split, count(*) AS types, cast(sum(n) AS BIGINT) AS tokens, round(-sum(n / t * log2(n / t)), 6) AS word_entropy FROM (SELECT corpus, split, n, cast(sum(n) OVER (PARTITION BY corpus, split) AS DOUBLE) AS t FROM samples) GROUP BY corpus, split),
ld AS (SELECT corpus, split, length(w) AS k, sum(n) / cast(sum(sum(n)) OVER (PARTITION BY corpus, split) AS DOUBLE) AS p FROM samples GROUP BY corpus, split, length(w)),
js AS (SELECT a.split, round(sum(CASE WHEN a.p > 0 THEN a.p * log2(2 * a.p / (a.p + coalesce(b.p, 0e0))) ELSE 0e0 END) / 2, 6) AS half FROM ld a LEFT JOIN ld b ON b.corpus = 'paragraphs' AND a.split = b.split AND a.k = b.k WHERE a.corpus = 'loci' GROUP BY a.split)"""
_REFERENCE = f"WITH {_CORPORA} SELECT ue.corpus, ue.split, alphabet, units, unit_entropy, types, tokens, word_entropy, js.half AS length_divergence FROM ue JOIN we ON ue.corpus = we.corpus AND ue.split = we.split LEFT JOIN js ON ue.corpus = 'loci' AND ue.split = js.split"


def reference_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Rows (corpus, split, ...): invariants of two corpora by split (paragraphs by a hash of their chapter), with how far the lengths of words differ between them."""
    rel = Relations(spark, d, "{types}{types}")
    words = F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))
    rel.built["pwords"] = spool(rel["paras"].select("chapter_key", F.explode(words).alias("w")).select("chapter_key", F.lower("w").alias("w")), "words")
    return run_body(_REFERENCE, rel)


def memory_order_null(spark: SparkSession, d: str, replicates: int = models.NULLS) -> DataFrame:
    """Rows (mode, r, bits, changed): loss of the local memory under the edit kernel with the setting that validation chose, on
    the test lines as they are (r = -1) and with the words after the first permuted, among equal lengths or all.

    A line's loss is a sum over pairs of a word and one before it, so each line carries the matrix of its words' kernels."""
    body = f"WITH {models._MEMORY} SELECT t.locus_id, t.wp, t.w, t.known, t.p0, t.norm, c.width, c.lam FROM t CROSS JOIN choice c WHERE t.split = 'test' AND c.family = 'edit'"
    words = run_body(body, Relations(spark, d, body))
    item = F.struct("wp", "w", "known", "p0", "norm")
    lines = words.groupBy("locus_id").agg(F.array_sort(F.collect_list(item)).alias("x"), F.max("width").alias("width"), F.max("lam").alias("lam")).where(F.size("x") > 1)
    rows = spool(lines.select("locus_id", F.transform("x", lambda x: F.concat_ws("\t", x["w"], x["known"].cast("string"), x["p0"].cast("string"), F.coalesce(x["norm"].cast("string"), F.lit("")), F.lit(""))).alias("items"), "width", "lam"), "lines")
    chosen = rows.select("width", "lam").limit(1).collect()
    width, lam = (int(chosen[0].width), float(chosen[0].lam)) if chosen else (1, 0.0)
    out = None
    for mode, seed in (("tail", 408), ("same_length", 409)):
        sums = resample.replicate_sums(rows.select("locus_id", "items"), replicates, ["targets", "bits", "changed"], resample.memory_loss(width, lam, mode == "same_length"), seed)
        part = sums.select(F.lit(mode).alias("mode"), "r", F.round(F.col("bits") / F.col("targets"), 6).alias("bits"), F.col("changed").cast("long").alias("changed"))
        out = part if out is None else out.unionByName(part)
    return out


_ENDS = """b AS (SELECT split, wp, nw, w, lag(w) OVER (PARTITION BY locus_id ORDER BY wp) AS pw FROM {tok} WHERE split IS NOT NULL),
e AS (SELECT split, CASE WHEN wp = 1 THEN 'second' WHEN wp = nw - 1 THEN 'last' ELSE 'interior' END AS role, w, pw FROM b WHERE wp > 0),
v AS (SELECT w, max(CASE WHEN up = 0 THEN u END) AS ini, max(CASE WHEN up = z THEN u END) AS fin FROM (SELECT w, u, up, max(up) OVER (PARTITION BY w) AS z FROM (SELECT DISTINCT w, up, u FROM {tvisual})) GROUP BY w),
x AS (SELECT 'raw' AS rep, split, role, substr(w, 1, 1) AS ini, substr(pw, length(pw), 1) AS fin FROM e UNION ALL SELECT 'visual', e.split, e.role, a.ini, z.fin FROM e JOIN v a ON e.w = a.w JOIN v z ON e.pw = z.w),
k AS (SELECT rep, count(DISTINCT ini) + 1 AS k FROM x WHERE split = 'train' GROUP BY rep),
c1 AS (SELECT rep, role, ini, count(*) AS n FROM x WHERE split = 'train' GROUP BY rep, role, ini), s1 AS (SELECT rep, role, sum(n) AS t FROM c1 GROUP BY rep, role),
c2 AS (SELECT rep, role, fin, ini, count(*) AS n FROM x WHERE split = 'train' GROUP BY rep, role, fin, ini), s2 AS (SELECT rep, role, fin, sum(n) AS t FROM c2 GROUP BY rep, role, fin),
p AS (SELECT x.rep, x.split, (coalesce(c1.n, 0) + 1e-1) / (coalesce(s1.t, 0) + 1e-1 * k.k) AS p0, coalesce(c2.n, 0) AS n2, coalesce(s2.t, 0) AS t2, CASE WHEN c1.n IS NULL THEN 1 ELSE 0 END AS unk FROM x JOIN k ON x.rep = k.rep LEFT JOIN c1 ON x.rep = c1.rep AND x.role = c1.role AND x.ini = c1.ini
  LEFT JOIN s1 ON x.rep = s1.rep AND x.role = s1.role LEFT JOIN c2 ON x.rep = c2.rep AND x.role = c2.role AND x.fin = c2.fin AND x.ini = c2.ini LEFT JOIN s2 ON x.rep = s2.rep AND x.role = s2.role AND x.fin = s2.fin WHERE x.split <> 'train')"""
_BOUNDARY_STUDY = f"WITH {_ENDS} SELECT rep, split, count(*) AS targets, cast(sum(unk) AS BIGINT) AS unknown, round(avg(-log2(p0)), 6) AS baseline, round(avg(-log2((n2 + 10 * p0) / (t2 + 10))), 6) AS conditional, round(avg(log2((n2 + 10 * p0) / (t2 + 10)) - log2(p0)), 6) AS gain FROM p GROUP BY rep, split"


def boundary_study(spark: SparkSession, d: str) -> DataFrame:
    """Rows (rep, split, ...): the boundary model on single letters and on visual units."""
    return run_body(_BOUNDARY_STUDY, Relations(spark, d, _BOUNDARY_STUDY))


def _stream_scores(problem_of_split: dict[str, keysearch.Problem], key: dict[str, str]) -> list[tuple[str, int, float]]:
    rows = []
    for split, p in problem_of_split.items():
        import numpy as np

        full = np.array([keysearch.letter_number(key[u]) if u in key else -1 for u in p.units])
        seen = (np.concatenate([full, [0, 0]])[p.events] >= 0).all(axis=1)
        n = int(p.counts.sum())
        known = p.cost(np.maximum(full, 0), np.flatnonzero(seen))
        rows.append((split, n, (known + float(p.counts[~seen].sum()) * 4.700439718141092) / max(1, n)))  # log2(26) for a window in doubt
    return rows


def spacefree_manuscript(spark: SparkSession, d: str) -> DataFrame:
    """Rows (fit, split, windows, bits, identity_bits, gates): controls first; if each finds its planted key, keys are fitted to
    the validation stream, to its letters shuffled within words and to its words shuffled, frozen, and only then scored on
    every split; gates say whether the fit beats identity, shuffles and a uniform model. Without the controls no key is fitted."""
    controls = spool(searches.spacefree_control(spark, d), "controls")
    passed = controls.where("mapping_errors > 0").isEmpty()
    schema = "fit string, split string, windows long, bits double, identity_bits double, beats_identity boolean, beats_uniform boolean, controls_passed boolean"
    if not passed:
        return spark.createDataFrame([], schema)
    four = dict(zip(("train", "validation", "test"), searches._windows(spark, d)))
    table = keysearch.table_of(four["train"], searches._WINDOW, True)
    letters = searches._letters(four["train"], "d")
    scored = {s: keysearch.problem_of(w, searches._WINDOW, table)[0] for s, w in four.items()}
    rows = []
    for fit, events in {"original": four["validation"], **_shuffled_windows(spark, d)}.items():
        problem, _ = keysearch.problem_of(events, searches._WINDOW, table)
        best = keysearch.restarts(spark, problem, letters, reassign=0.3).orderBy("cost", "restart").limit(1).select("key")
        text = fit_before_test(best, lambda keys: keys).first()["key"]
        key = dict(x.split("=") for x in text.split(" "))
        same = {u: u for u in keysearch.ALPHABET}
        identity = {s: b for s, _, b in _stream_scores(scored, same)}
        rows += [(fit, s, n, round(b, 6), round(identity[s], 6), b < identity[s] - 1e-9, b < 4.700439718141092, True) for s, n, b in _stream_scores(scored, key)]
    return spark.createDataFrame(rows, schema)


def _shuffled_windows(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Windows of four of the validation stream with letters shuffled within words, and with words shuffled within their line."""
    tail = """x AS (SELECT locus_id, {s} AS s FROM k GROUP BY locus_id), w AS (SELECT s, explode_(length(s) - 3) AS i FROM x WHERE length(s) > 3)
SELECT substr(s, cast(i AS INT), 1) AS a, substr(s, cast(i AS INT) + 1, 1) AS b, substr(s, cast(i AS INT) + 2, 1) AS c, substr(s, cast(i AS INT) + 3, 1) AS d, count(*) AS n FROM w GROUP BY 1, 2, 3, 4"""
    inside = f"WITH k AS (SELECT locus_id, ch, wp * 2147483648 + {resample.sql_key(509, 'wp', 'locus_id', 'cp')} AS o FROM {{chars}} WHERE split = 'validation'), " + tail.replace("{s}", "spell_(ch BY o)_")
    words = f"WITH k AS (SELECT locus_id, w, {resample.sql_key(609, '0', 'locus_id', 'wp')} AS o FROM {{tok}} WHERE split = 'validation'), " + tail.replace("{s}", "spell_(w BY o)_")
    return {"within_word_shuffle": spool(query(inside)(spark, d), "inside"), "word_order_shuffle": spool(query(words)(spark, d), "words")}


def lexicon_pilot(spark: SparkSession, d: str) -> DataFrame:
    """Rows (problem, status, lower, upper, nodes, score, completions, proved): a planted problem and the validation words, by
    branch and bound; `proved` says that the score re-derived by decoding every type is the solver's."""
    weights, known = searches.lexicon_problem(spark, d)
    types, _, _ = searches._planted_words(spark, d, 408)
    rows = None
    for name, problem, nodes in (("reference", types, searches.NODES), ("manuscript", weights, 100)):
        shared = solvers._Shared(spark, (problem, known, nodes))

        def run(frames, shared=shared, name=name):
            import pandas as pd

            t, w, budget = shared.value
            for f in frames:
                out = []
                for _ in f["id"]:
                    lex = solvers._lexicon(shared.id, t, w, 1)
                    r = solvers.branch_and_bound(lex, budget)
                    again = sum(n for x, n in t.items() if "".join(r["key"].get(u, "?") for u in x) in w)
                    out.append((name, r["status"], r["lower"], r["upper"], r["nodes"], again, str(solvers.ambiguity(lex, r["key"])["completions"]), again == r["lower"]))
                yield pd.DataFrame(out, columns=["problem", "status", "lower", "upper", "nodes", "score", "completions", "proved"])

        part = spark.range(1).repartition(1).mapInPandas(run, "problem string, status string, lower long, upper long, nodes long, score long, completions string, proved boolean")
        rows = part if rows is None else rows.unionByName(part)
    return rows


def optimal_set_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Rows (place, positions, mapped, correct, words, words_correct): what each key of the optimal set makes of the train words
    in the planted cipher, against what they are. The keys are read back from where they were written before."""
    keys = spool(searches.optimal_set(spark, d), "keys")
    _, _, truth = searches._planted_words(spark, d, 408)
    plant = spark.createDataFrame([(v, u) for u, v in truth.items()], "ch string, u string")

    def score(frozen: DataFrame) -> DataFrame:
        key = F.broadcast(frozen.select("place", F.explode(F.str_to_map("key", F.lit(" "), F.lit("="))).alias("u", "x")))
        rel = Relations(spark, d, "{tchars}")
        said = rel["tchars"].where("split = 'train'").join(F.broadcast(plant), "ch", "left")
        places = frozen.select("place")
        one = said.crossJoin(F.broadcast(places)).join(key, ["place", "u"], "left")
        good = F.coalesce((F.col("x") == F.col("ch")).cast("int"), F.lit(0))
        per = one.groupBy("place", "w").agg(F.max("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("x").isNotNull().cast("int")).alias("m"), F.sum(good).alias("g"))
        s = lambda c: F.sum(c).cast("long")
        return per.groupBy("place").agg(s(F.col("n") * F.col("k")).alias("positions"), s(F.col("n") * F.col("m")).alias("mapped"), s(F.col("n") * F.col("g")).alias("correct"), s("n").alias("words"), s(F.when(F.col("g") == F.col("k"), F.col("n")).otherwise(0)).alias("words_correct"))

    return fit_before_test(keys, score)


def search_development(spark: SparkSession, d: str) -> DataFrame:
    """Rows (step, value): the root's bounds, and local search from a frequency start and from an annealed one; aggregates only."""
    weights, known = searches.lexicon_problem(spark, d)
    runs = searches.annealed_then_local(spark, weights, known).where("method = 'local'")
    local = runs.select(F.concat(F.lit("local_"), F.col("seed").cast("string")).alias("step"), F.col("lower").alias("value"))
    bounds = searches.root_study(spark, d).select(F.concat(F.lit("bound_"), "bound").alias("step"), "value")
    return bounds.unionByName(local)


def common_visual_pilot(spark: SparkSession, d: str) -> DataFrame:
    """Rows (restart, windows, unknown, coverage, bits, key): restarts of the search on windows of four visual units inside the
    lines of the validation split; a window with a unit that the two transcriptions don't share is unknown."""
    body = """WITH v AS (SELECT locus_id, wp, up, u FROM {visual} WHERE split = 'validation'),
w AS (SELECT u AS a, lead(u, 1) OVER q AS b, lead(u, 2) OVER q AS c, lead(u, 3) OVER q AS d FROM v WINDOW q AS (PARTITION BY locus_id ORDER BY wp, up)) SELECT a, b, c, d, count(*) AS n FROM w WHERE d IS NOT NULL GROUP BY a, b, c, d"""
    fit = spool(query(body)(spark, d), "windows")
    train = Relations(spark, d, "{stream4}")["stream4"].where("split = 'train'")
    table = keysearch.table_of(train, searches._WINDOW, True)
    problem, unknown = keysearch.problem_of(fit, searches._WINDOW, table, 1, set(statistics.COMMON_UNITS))
    found = keysearch.restarts(spark, problem, searches._letters(train, "d"), reassign=0.3)
    whole = F.col("events") + unknown
    return found.select("restart", whole.alias("windows"), F.lit(unknown).cast("long").alias("unknown"), F.round(F.col("events") / whole, 6).alias("coverage"), F.round((F.col("cost") + unknown * F.log2(F.lit(26.0))) / whole, 6).alias("bits"), "key")


_PLANTED_PAIRS = """WITH c AS (SELECT grp, locus_id, wp, cp, ch, row_number() OVER (PARTITION BY grp, ch ORDER BY locus_id, wp, cp) % 2 AS odd FROM {chars} WHERE grp IS NOT NULL AND ch < 'n')
SELECT grp, locus_id, wp, cp, CASE WHEN odd = 1 THEN ch ELSE translate(ch, 'abcdefghijklm', 'nopqrstuvwxyz') END AS u FROM c"""


def cyclic_pairing_control(spark: SparkSession, d: str) -> DataFrame:
    """Rows (category, edges, forced): every letter is written by two signs in turns; of the edges of the graph of signs, those
    that were planted and others, and how many of them all matchings have."""
    signs = query(_PLANTED_PAIRS)(spark, d).withColumn("words", F.array("u"))
    ordered = signs.repartition("grp").sortWithinPartitions("grp", "locus_id", "wp", "cp")
    turns = graphs.unit_turns(ordered, "grp", "words")
    edges = spool(turns.where("turns = parts and (a_first = 0 or b_first = 0)").select("a", "b"), "edges")
    found = graphs.matchings_by(graphs.components(edges), "grp").where("a is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "verdict")
    both = edges.join(found, ["a", "b"], "left").withColumn("planted", F.translate("a", "abcdefghijklm", "nopqrstuvwxyz") == F.col("b"))
    return both.groupBy(F.when(F.col("planted"), "planted").otherwise("other").alias("category")).agg(F.count("*").alias("edges"), F.sum(F.coalesce((F.col("verdict") == "forced").cast("long"), F.lit(0))).alias("forced"))


_PLANTED_SQL = "WITH s AS (" + _PLANTED_PAIRS + """), pairs AS (SELECT a.u AS a, b.u AS b FROM (SELECT DISTINCT u FROM s) a JOIN (SELECT DISTINCT u FROM s) b ON a.u < b.u),
hit AS (SELECT p.a, p.b, s.grp, s.u, lag(s.u) OVER (PARTITION BY p.a, p.b, s.grp ORDER BY s.locus_id, s.wp, s.cp) AS prev FROM s JOIN pairs p ON s.u IN (p.a, p.b)),
part AS (SELECT a, b, grp, max((u = prev)::INT) AS twice, abs(sum(CASE WHEN u = a THEN 1 ELSE -1 END)) AS off, min(CASE WHEN prev IS NULL THEN u END) AS opens FROM hit GROUP BY a, b, grp)
SELECT a, b FROM part GROUP BY a, b HAVING max(coalesce(twice, 0)) = 0 AND max(off) <= 1 AND count(DISTINCT opens) = 1"""


def cyclic_pairing_edges(spark: SparkSession, d: str) -> DataFrame:
    """Rows (a, b): the edges of the same graph."""
    signs = query(_PLANTED_PAIRS)(spark, d).withColumn("words", F.array("u"))
    turns = graphs.unit_turns(signs.repartition("grp").sortWithinPartitions("grp", "locus_id", "wp", "cp"), "grp", "words")
    return turns.where("turns = parts and (a_first = 0 or b_first = 0)").select("a", "b")


def medical_control(spark: SparkSession, d: str) -> DataFrame:
    """Rows (capacity, status, lower, upper, nodes, planted): a planted key over the most frequent words of the paragraphs,
    sought with the words of all paragraphs as lexicon, one letter for each unit and two units for a letter."""
    rel = Relations(spark, d, "{paras}")
    words = rel["paras"].select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    words = spool(words, "words")
    if words.count() > keysearch.MOST_EVENTS:
        raise ValueError("the vocabulary is larger than one search takes")
    known = {r.w for r in words.collect()}
    head = [(r.w, r.n) for r in words.where("length(w) >= 4").orderBy(F.desc("n"), "w").limit(searches.PLANTED_TYPES).collect()]
    letters = sorted({c for w, _ in head for c in w})
    to = dict(zip(letters, random.Random(408).sample(keysearch.ALPHABET, len(letters))))
    types = {"".join(to[c] for c in w): int(n) for w, n in head}
    jobs = [("bnb", 0, 1, 200), ("bnb", 0, 2, 50)]
    planted = sum(types.values())
    return solvers.solve(spark, types, known, jobs).select("capacity", "status", "lower", "upper", "nodes", F.lit(planted).cast("long").alias("planted"))


QUERIES = {
    f.__name__: f
    for f in (structural_run, reference_invariants, memory_order_null, boundary_study, spacefree_manuscript, lexicon_pilot, optimal_set_diagnostics, search_development, common_visual_pilot, cyclic_pairing_control, cyclic_pairing_edges, medical_control)
}
SQL = {
    "cyclic_pairing_edges": oracle(_PLANTED_SQL),
    "boundary_study": oracle(_BOUNDARY_STUDY),
    "reference_invariants": oracle(_REFERENCE.replace("{pwords}", "(SELECT chapter_key, lower(unnest(regexp_extract_all(text, '([A-Za-z]+)', 1))) AS w FROM {paras}) pw")),
}
