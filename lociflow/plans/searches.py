"""Studies that search for keys: likelihood, windows, lexicon; their controls with a planted key; matchings and quotients."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.operators import graphs, keysearch, solvers
from lociflow.plans import studies
from lociflow.plans.shared import Relations, query
from lociflow.runtime import spool

_EVENT = ["h3", "h2", "h1", "s"]
_WINDOW = ["a", "b", "c", "d"]
#: The declared letters of windows; fixed value.
KNOWN = "abcdefghiklmnopqrsty"
#: Seeds of planted keys: of the pilot and of the control; fixed values.
PILOT_SEEDS, CONTROL_SEEDS = list(range(408, 440)), [408, 409, 410, 411]
#: Nodes of branch and bound in a study, moves of local search, and nodes of one threshold query.
NODES, MOVES, QUERY_NODES = 1000, 8, 1000
#: Types of a problem whose optimum is planted, so that it can be certified.
PLANTED_TYPES = 40


def _events(spark: SparkSession, d: str, split: str) -> DataFrame:
    rel = Relations(spark, d, "{ngram_events}")
    return spool(rel["ngram_events"].where((F.col("split") == split) & (F.col("s") != "?") & (F.col("h1") != "?") & (F.col("h2") != "?") & (F.col("h3") != "?")), "events")


def _letters(counts: DataFrame, column: str) -> list[int]:
    """Letters by falling frequency, those that don't occur at the end."""
    rows = counts.groupBy(column).agg(F.sum("n").alias("n")).collect()  # an alphabet
    found = sorted(((-r["n"], keysearch.letter_number(r[column])) for r in rows if 0 <= keysearch.letter_number(r[column]) < 26))
    seen = [k for _, k in found]
    return seen + [k for k in range(26) if k not in seen]


def anneal_injective(spark: SparkSession, d: str) -> DataFrame:
    """Restarts of the search for a one-to-one key of the validation words under the model of the train words, order 3; the
    bits of each found key twice, by the search and by joins."""
    train, fit = _events(spark, d, "train"), _events(spark, d, "validation")
    table = keysearch.table_of(train, _EVENT, False)
    problem, _ = keysearch.problem_of(fit, _EVENT, table)
    found = spool(keysearch.restarts(spark, problem, _letters(train, "s")), "found")
    again = keysearch.rescored(found, fit, _EVENT, keysearch.cost_rows(spark, table))
    return found.join(again, "restart").select("restart", "events", F.round("bits", 6).alias("bits"), F.round("rescored", 6).alias("rescored"), "key")


def anneal_homophonic(spark: SparkSession, d: str) -> DataFrame:
    """The same for the visual units of the validation words, two of which may stand for one letter."""
    train = _events(spark, d, "train")
    body = """WITH u AS (SELECT w, n, u, up FROM {tvisual} WHERE split = 'validation'), e AS (SELECT w, n, max(up) + 1 AS up FROM u GROUP BY w, n), x AS (SELECT w, n, u, up FROM u UNION ALL SELECT w, n, '$', up FROM e),
y AS (SELECT n, u AS s, coalesce(lag(u, 1) OVER q, '^') AS h1, coalesce(lag(u, 2) OVER q, '^') AS h2, coalesce(lag(u, 3) OVER q, '^') AS h3 FROM x WINDOW q AS (PARTITION BY w ORDER BY up))
SELECT h3, h2, h1, s, cast(sum(n) AS BIGINT) AS n FROM y GROUP BY h3, h2, h1, s"""
    fit = spool(query(body)(spark, d), "units")
    table = keysearch.table_of(train, _EVENT, False)
    problem, _ = keysearch.problem_of(fit, _EVENT, table, 2)
    found = spool(keysearch.restarts(spark, problem, _letters(train, "s"), reassign=0.5), "found")
    again = keysearch.rescored(found, fit, _EVENT, keysearch.cost_rows(spark, table))
    return found.join(again, "restart").select("restart", "events", F.round("bits", 6).alias("bits"), F.round("rescored", 6).alias("rescored"), "key")


def _windows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    four = Relations(spark, d, "{stream4}")["stream4"]
    return tuple(four.where(F.col("split") == s) for s in ("train", "validation", "test"))


def _swap(spark: SparkSession, d: str, known: str | None) -> DataFrame:
    train, fit, _ = _windows(spark, d)
    table = keysearch.table_of(train, _WINDOW, True)
    problem, unknown = keysearch.problem_of(fit, _WINDOW, table, 1, known)
    found = spool(keysearch.restarts(spark, problem, _letters(train, "d"), reassign=0.3), "found")  # a letter no unit has is one to change with
    whole = F.col("events") + unknown
    return found.select("restart", whole.alias("windows"), F.lit(unknown).cast("long").alias("unknown"), F.round((F.col("cost") + unknown * F.log2(F.lit(26.0))) / whole, 6).alias("bits"), "key")


def swap_search(spark: SparkSession, d: str) -> DataFrame:
    """Restarts of the search for a permutation of letters on the windows of four of the validation stream."""
    return _swap(spark, d, None)


def swap_search_unknown(spark: SparkSession, d: str) -> DataFrame:
    """The same where windows with a letter that isn't declared cost log2(26) and don't steer the search."""
    return _swap(spark, d, KNOWN)


def planted_pilot(spark: SparkSession, d: str) -> DataFrame:
    """Rows (seed, ...): a planted key for each seed, and what the best of its restarts recovers of it."""
    train, fit = _events(spark, d, "train"), _events(spark, d, "validation")
    problem, _ = keysearch.problem_of(fit, _EVENT, keysearch.table_of(train, _EVENT, False))
    runs = keysearch.planted(spark, problem, _letters(train, "s"), PILOT_SEEDS)
    best = runs.groupBy("seed").agg(F.min_by(F.struct("bits", "known_bits", "correct_units", "correct_events"), F.struct("bits", "restart")).alias("b"), F.count("*").alias("restarts"))
    return best.select("seed", "restarts", F.round("b.bits", 6).alias("bits"), F.round("b.known_bits", 6).alias("known_bits"), "b.correct_units", F.lit(len(problem.units)).alias("units"), F.round("b.correct_events", 6).alias("correct_events"))


def spacefree_control(spark: SparkSession, d: str) -> DataFrame:
    """The same for the stream without spaces: windows of four, four seeds."""
    train, fit, _ = _windows(spark, d)
    problem, _ = keysearch.problem_of(fit, _WINDOW, keysearch.table_of(train, _WINDOW, True))
    runs = keysearch.planted(spark, problem, _letters(train, "d"), CONTROL_SEEDS)
    best = runs.groupBy("seed").agg(F.min_by(F.struct("bits", "known_bits", "correct_units", "correct_events"), F.struct("bits", "restart")).alias("b"))
    return best.select("seed", F.round("b.bits", 6).alias("bits"), F.round("b.known_bits", 6).alias("known_bits"), (F.lit(len(problem.units)) - F.col("b.correct_units")).alias("mapping_errors"), F.round(1 - F.col("b.correct_events"), 6).alias("error_rate"))


def secondary_rank(spark: SparkSession, d: str) -> DataFrame:
    """The keys that four restarts found, by exact likelihood against the first: fractions of whole numbers, as in a proof.
    The histograms of events under each key come from joins; the ranking is one task."""
    train, fit = _events(spark, d, "train"), _events(spark, d, "validation")
    problem, _ = keysearch.problem_of(fit, _EVENT, keysearch.table_of(train, _EVENT, False, 1))
    found = spool(keysearch.restarts(spark, problem, _letters(train, "s"), 4), "found")
    key = found.select("restart", F.explode(F.str_to_map("key", F.lit(" "), F.lit("="))).alias("u", "x"))
    key = F.broadcast(key.unionByName(found.select("restart").crossJoin(spark.createDataFrame([("^", "^"), ("$", "$")], "u string, x string"))))
    one = fit.groupBy("h1", "s").agg(F.sum("n").alias("n"))
    shown = one.join(key.select("restart", F.col("u").alias("h1"), F.col("x").alias("h")), "h1").join(key.select("restart", F.col("u").alias("s"), F.col("x").alias("y")), ["restart", "s"])
    hist = shown.groupBy("restart", "h", "y").agg(F.sum("n").alias("n"))
    base = train.groupBy(F.col("h1").alias("h"), F.col("s").alias("y")).agg(F.sum("n").alias("n")).withColumn("restart", F.lit(-1).cast("long"))
    rows = hist.unionByName(base).withColumn("all", F.lit(0))  # at most 28^2 rows for each key

    def run(key: tuple, pdf):
        import pandas as pd

        by = {r: {(h, y): int(n) for h, y, n in zip(g["h"], g["y"], g["n"])} for r, g in pdf.groupby("restart")}
        model = by.pop(-1)
        ranked = solvers.rank_keys(model, keysearch.SYMBOLS, {f"{r:02d}": e for r, e in by.items()})
        return pd.DataFrame([(int(name), k, num, den, bits) for k, (name, num, den, bits) in enumerate(ranked)], columns=["restart", "place", "numerator", "denominator", "log2_ratio"])

    out = rows.groupBy("all").applyInPandas(run, "restart long, place int, numerator string, denominator string, log2_ratio double")
    return out.select("restart", "place", F.length("numerator").alias("numerator_digits"), F.round("log2_ratio", 6).alias("log2_ratio"))


# lexicon problems


def lexicon_problem(spark: SparkSession, d: str) -> tuple[dict[str, int], set[str]]:
    """All validation types with their exact weights, and all train types: a vocabulary, counted before it is gathered."""
    rel = Relations(spark, d, "{types}{types}")
    types = rel["types"].where("split in ('train', 'validation')")
    if types.count() > keysearch.MOST_EVENTS:
        raise ValueError("the vocabulary is larger than one search takes")
    rows = types.select("split", "w", "n").collect()
    cipher = {r.w: r.n for r in rows if r.split == "validation"}
    t, k = len(cipher), sum(cipher.values())
    return {w: n * t + k for w, n in sorted(cipher.items())}, {r.w for r in rows if r.split == "train"}


def annealed_then_local(spark: SparkSession, weights: dict[str, int], known: set[str], more: list[tuple] = ()) -> DataFrame:
    """All restarts of annealing one-to-one keys, each a task, the first from a start by frequency; then local search from that
    start (seed 0) and from the best key that annealing found (seed 1). `more` are jobs that run beside the restarts."""
    jobs = [*more[::-1], *(("anneal", s, 1, keysearch.PROPOSALS) for s in range(keysearch.RESTARTS))]
    first = spool(solvers.solve(spark, weights, known, jobs), "annealed")
    best = first.where("method = 'anneal' and capacity = 1").orderBy(F.desc("lower"), "key").limit(1).select("key").collect()
    key = dict(x.split("=") for x in best[0].key.split(" ") if x)
    start = solvers.frequency_start(solvers.Lexicon(weights, known, 1))
    local = spool(solvers.solve(spark, weights, known, [("local", s, 1, MOVES) for s in range(2)], {0: start, 1: key}), "local")
    return first.unionByName(local)


def key_search(spark: SparkSession, d: str) -> DataFrame:
    """Restarts of annealing, local search and branch and bound on the whole vocabulary, each a row, with scores re-derived by joins."""
    weights, known = lexicon_problem(spark, d)
    found = annealed_then_local(spark, weights, known, [("anneal", s, 2, keysearch.PROPOSALS) for s in range(keysearch.RESTARTS)] + [("bnb", 0, 1, NODES)])
    scores = solvers.score_keys(found, spark.createDataFrame(sorted(weights.items()), "w string, weight long"), spark.createDataFrame(sorted((w,) for w in known), "w string"))
    return found.join(scores, ["method", "seed", "capacity"], "left").select("method", "seed", "capacity", "status", "lower", "upper", "nodes", F.coalesce("score", F.lit(0)).alias("score"))


def root_study(spark: SparkSession, d: str) -> DataFrame:
    """Bounds at the root of the whole vocabulary: by single types, by pivots, by conflicting pairs, plain and by masks."""
    weights, known = lexicon_problem(spark, d)
    shared = solvers._Shared(spark, (weights, known))

    def run(frames):
        import pandas as pd

        w, words = shared.value
        for f in frames:
            rows = []
            for name in f["name"]:
                lex = solvers._lexicon(shared.id, w, words, 1)
                value = {"independent": lambda: lex.bound({}), "independent_masks": lambda: solvers.ShapeMasks(lex).bound(), "pivot": lambda: lex.pivot_bound({}), "pivot_masks": lambda: solvers.ShapeMasks(lex).pivot(), "pair_clique": lambda: solvers.pair_bound(lex, 12)}[name]()
                rows.append((name, value, sum(w.values())))
            yield pd.DataFrame(rows, columns=["bound", "value", "total"])

    names = spark.createDataFrame([(n,) for n in ("independent", "independent_masks", "pivot", "pivot_masks", "pair_clique")], "name string").repartition(5)
    return names.mapInPandas(run, "bound string, value long, total long")


def _planted_words(spark: SparkSession, d: str, seed: int) -> tuple[dict[str, int], set[str], dict[str, str]]:
    """A lexicon problem of known optimum: the most frequent train words of four letters or more under a hidden permutation,
    with the whole vocabulary as lexicon, and the key that solves it."""
    weights, known = lexicon_problem(spark, d)
    rel = Relations(spark, d, "{types}")
    head = rel["types"].where("split = 'train' and len >= 4").orderBy(F.desc("n"), "w").limit(PLANTED_TYPES).select("w", "n").collect()
    letters = sorted({c for r in head for c in r.w})
    shown = random.Random(seed).sample(keysearch.ALPHABET, len(letters))
    to = dict(zip(letters, shown))
    types = {"".join(to[c] for c in r.w): int(r.n) for r in head}
    return types, known, {v: k for k, v in to.items()}


def solver_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """Branch and bound on problems of known key, by budget of nodes: status, bounds, and the known key's score."""
    out = None
    for seed in (408, 409):
        types, known, truth = _planted_words(spark, d, seed)
        jobs = [("bnb", budget, 1, budget) for budget in (0, 1, 10, 100, 1000)]
        part = solvers.solve(spark, types, known, jobs).select(F.lit(seed).alias("case"), F.col("seed").alias("budget"), "status", "lower", "upper", "nodes", F.lit(solvers.Lexicon(types, known, 1).score(truth)).cast("long").alias("known_score"))
        out = part if out is None else out.unionByName(part)
    return out


def key_identifiability(spark: SparkSession, d: str) -> DataFrame:
    """Which units of a certified optimum are forced: a threshold query for each unit, each a task of its own; and how many
    keys keep the optimum's hits."""
    types, known, truth = _planted_words(spark, d, 408)
    lex = solvers.Lexicon(types, known, 1)
    score = lex.score(truth)
    certified = lex.bits.bound({}) == score
    asked = [(u, {}, {(u, truth[u])}, score) for u in lex.order]
    answers = solvers.threshold_queries(spark, types, known, 1, asked, QUERY_NODES)
    verdict = F.when(F.col("status") == "infeasible", "forced_at_certified_optimum" if certified else "forced_at_score").when(F.col("status") == "feasible", "ambiguous").otherwise("unresolved")
    values = spark.createDataFrame(sorted(truth.items()), "name string, value string")
    ways = solvers.ambiguity(lex, truth)
    return answers.join(values, "name").select(F.col("name").alias("unit"), "value", verdict.alias("verdict"), "nodes", F.lit(str(ways["completions"])).alias("completions"))


def optimal_set(spark: SparkSession, d: str) -> DataFrame:
    """Rows (place, key): all keys that score the certified optimum when the units that no query forces may take any letter
    the optimum leaves free, up to a limit of completions."""
    types, known, truth = _planted_words(spark, d, 408)
    lex = solvers.Lexicon(types, known, 1)
    score = lex.score(truth)
    open_units = [r.unit for r in key_identifiability(spark, d).where("verdict <> 'forced_at_certified_optimum'").select("unit").collect()]
    free = sorted(set(keysearch.ALPHABET) - {v for u, v in truth.items() if u not in open_units})
    domains = {u: "".join(free) if u in open_units[:3] else truth[u] for u in truth}
    rows = [(k, " ".join(f"{u}={v}" for u, v in sorted(x.items()))) for k, x in enumerate(solvers.equal_optima(lex, score, domains))]
    return spark.createDataFrame(rows, "place long, `key` string")


# matchings


def _visual_edges(spark: SparkSession, d: str) -> DataFrame:
    return studies.alternation(spark, d).where("alternating * 2 > n_lines").select("a", "b")


def cyclic_matchings(spark: SparkSession, d: str) -> DataFrame:
    """Matchings and forced edges of the graph over visual units whose edges join units that alternate in most lines; its
    connected parts are the groups."""
    return graphs.matchings_by(graphs.components(_visual_edges(spark, d)), "grp")


def observed_quotient(spark: SparkSession, d: str) -> DataFrame:
    """Rows (unit, class): units joined by an edge of every matching are one class; others stay alone."""
    forced = spool(cyclic_matchings(spark, d).where("verdict = 'forced'").select("a", "b"), "forced")
    units = query("SELECT DISTINCT u FROM {tvisual}")(spark, d)
    pair = forced.select(F.col("a").alias("u"), "a").unionByName(forced.select(F.col("b").alias("u"), "a"))
    return units.join(pair, "u", "left").select(F.col("u").alias("unit"), F.coalesce("a", "u").alias("class"))


def quotient_fit(spark: SparkSession, d: str) -> DataFrame:
    """Restarts of the search for a one-to-one key of the classes that the matchings prove, on the validation words."""
    train = _events(spark, d, "train")
    classes = spool(observed_quotient(spark, d), "classes")
    rel = Relations(spark, d, "{tvisual}")
    unit = rel["tvisual"].where("split = 'validation'").join(F.broadcast(classes), F.col("u") == F.col("unit")).select("w", "n", "up", F.col("class").alias("q"))
    body = """WITH e AS (SELECT w, n, max(up) + 1 AS up FROM {u} GROUP BY w, n), x AS (SELECT w, n, q, up FROM {u} UNION ALL SELECT w, n, '$', up FROM e),
y AS (SELECT n, q AS s, coalesce(lag(q, 1) OVER o, '^') AS h1, coalesce(lag(q, 2) OVER o, '^') AS h2, coalesce(lag(q, 3) OVER o, '^') AS h3 FROM x WINDOW o AS (PARTITION BY w ORDER BY up))
SELECT h3, h2, h1, s, cast(sum(n) AS BIGINT) AS n FROM y GROUP BY h3, h2, h1, s"""
    fit = spool(spark.sql(body, u=spool(unit, "classed")), "fit")
    problem, _ = keysearch.problem_of(fit, _EVENT, keysearch.table_of(train, _EVENT, False))
    found = keysearch.restarts(spark, problem, _letters(train, "s"))
    return found.select("restart", F.lit(len(problem.units)).alias("classes"), "events", F.round("bits", 6).alias("bits"), "key")


def relabel_control(spark: SparkSession, d: str) -> DataFrame:
    """Rows (seed, ...): plain texts that the code book reads without doubt, in runs of eight letters and more, under a hidden
    permutation of letters; what the search recovers of it."""
    body = """WITH r AS (SELECT w, count(DISTINCT plain) AS p, min(plain) AS x FROM {reads} GROUP BY w),
t AS (SELECT t.locus_id, t.wp, coalesce(r.p, 0) AS p, coalesce(r.x, '') AS x FROM {tok} t LEFT JOIN r ON t.w = r.w),
i AS (SELECT locus_id, wp, p, x, sum(CASE WHEN p = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY locus_id ORDER BY wp) AS island FROM t),
run AS (SELECT spell_(x BY wp)_ AS s FROM i WHERE p = 1 GROUP BY locus_id, island), k AS (SELECT s, explode_(length(s) - 3) AS i FROM run WHERE length(s) >= 8)
SELECT substr(s, cast(i AS INT), 1) AS a, substr(s, cast(i AS INT) + 1, 1) AS b, substr(s, cast(i AS INT) + 2, 1) AS c, substr(s, cast(i AS INT) + 3, 1) AS d, count(*) AS n FROM k GROUP BY 1, 2, 3, 4"""
    four = spool(query(body)(spark, d), "runs")
    table = keysearch.table_of(four, _WINDOW, True)
    problem, _ = keysearch.problem_of(four, _WINDOW, table)
    runs = keysearch.planted(spark, problem, _letters(four, "d"), CONTROL_SEEDS)
    best = runs.groupBy("seed").agg(F.min_by(F.struct("bits", "known_bits", "correct_units"), F.struct("bits", "restart")).alias("b"))
    return best.select("seed", F.round("b.bits", 6).alias("bits"), F.round("b.known_bits", 6).alias("known_bits"), "b.correct_units", F.lit(len(problem.units)).alias("units"))


QUERIES = {
    f.__name__: f
    for f in (
        anneal_injective, anneal_homophonic, swap_search, swap_search_unknown, planted_pilot, spacefree_control, secondary_rank, key_search, root_study, solver_benchmark, key_identifiability, optimal_set,
        cyclic_matchings, observed_quotient, quotient_fit, relabel_control,
    )
}
