import random
from collections import Counter
from fractions import Fraction
from itertools import permutations, product

import numpy as np

from lociflow.operators import graphs, keysearch, solvers


def small(seed, capacity):
    rng = random.Random(seed)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))) for _ in range(8)}
    types = {"".join(rng.choice("xyz") for _ in range(rng.randrange(1, 4))): rng.randrange(1, 9) for _ in range(6)}
    return solvers.Lexicon(types, words, capacity), words


def brute(lex, words, alphabet="abcdef"):
    units = lex.order
    best = 0
    for values in product(alphabet, repeat=len(units)):
        key = dict(zip(units, values))
        if lex.allowed(key):
            best = max(best, sum(w for t, w in lex.types.items() if "".join(key[u] for u in t) in words))
    return best


def test_branch_and_bound_is_exact(monkeypatch):
    monkeypatch.setattr(solvers, "ALPHABET", "abcdef")
    for seed in range(25):
        for capacity in (1, 2, None):
            lex, words = small(seed, capacity)
            best = brute(lex, words)
            r = solvers.branch_and_bound(lex, 100_000)
            assert r["lower"] == r["upper"] == best == lex.score(r["key"])
            assert best <= lex.pivot_bound({}) <= lex.bound({})
            assert solvers.branch_and_bound(lex, 100_000, target=best + 1)["status"] == "infeasible"
            assert solvers.branch_and_bound(lex, 100_000, target=best)["status"] in ("feasible", "bound_certified")
            assert best <= solvers.pair_bound(lex, 4) <= lex.bound({})
            cut = solvers.branch_and_bound(lex, 1)
            assert cut["lower"] <= best <= cut["upper"]
            s, key = solvers.anneal_key(lex, 60, seed)
            assert s == lex.score(key) <= best and lex.allowed(key)
            s2, key2, _ = solvers.local_search(lex, key, 3)
            assert s <= s2 == lex.score(key2) <= best and lex.allowed(key2)


def test_masks_give_the_plain_bounds(monkeypatch):
    monkeypatch.setattr(solvers, "ALPHABET", "abcdef")
    rng = random.Random(9)
    for seed in range(30):
        for capacity in (1, 2, None):
            lex, _ = small(seed, capacity)
            bits = lex.bits
            key, mask = {}, bits.full
            assert bits.bound({}) == lex.bound({}) and bits.pivot(bits.full, {}) == lex.pivot_bound({})
            for u in rng.sample(lex.order, len(lex.order)):
                if not (room := lex.values(key)):
                    break
                v = rng.choice(room)
                mask, key = bits.child(mask, key, u, v), {**key, u: v}
                assert mask == bits.mask(key) and bits.value(mask) == lex.bound(key) == bits.bound(key)
                assert bits.pivot(mask, key) == lex.pivot_bound(key)
            assert bits.value(mask) >= lex.score(key)
    monkeypatch.setattr(solvers, "MASK_BYTES", -1)
    try:
        solvers.Lexicon({"xyz": 1, "xy": 2}, {"abc", "ab", "bc", "cd"}, 1).bits
        raise AssertionError("masks beyond the limit")
    except ValueError:
        pass


def test_branching_by_either_bound(monkeypatch):
    monkeypatch.setattr(solvers, "ALPHABET", "abcdef")
    for seed in range(12):
        lex, words = small(seed, 1)
        found = []
        for most in (0, 60):
            monkeypatch.setattr(solvers, "PIVOT_TYPES", most)
            r = solvers.branch_and_bound(lex, 100_000)
            found.append((r["lower"], r["upper"]))
        assert found[0] == found[1] == (brute(lex, words),) * 2


def test_completions(monkeypatch):
    monkeypatch.setattr(solvers, "ALPHABET", "abcd")
    for seed in range(10):
        for capacity in (1, 2, None):
            lex, words = small(seed, capacity)
            key = next((k for v in product("abcd", repeat=len(lex.order)) if lex.allowed(k := dict(zip(lex.order, v))) and lex.score(k)), None)
            if key is None:
                continue
            held = {u for t in lex.types if lex.decoded(t, key) in words for u in t}
            same = sum(lex.allowed(k) and all(k[u] == key[u] for u in held) for v in product("abcd", repeat=len(lex.order)) for k in [dict(zip(lex.order, v))])
            assert solvers.ambiguity(lex, key)["completions"] == same
    assert solvers.preserved_injective(2, 3) == 6 and solvers.preserved_injective(3, 2) == 0


def test_threshold_queries(spark, monkeypatch):
    types, words = {"xyx": 5, "xy": 3, "z": 2}, {"aba", "ab", "c"}
    rows = solvers.threshold_queries(spark, types, words, 1, [("all", {}, set(), 10), ("more", {}, set(), 11), ("not", {}, {("x", "a")}, 10), ("fixed", {"z": "d"}, set(), 8)], 500).collect()
    assert {r.name: r.status for r in rows} == {"all": "feasible", "more": "infeasible", "not": "infeasible", "fixed": "feasible"}


def test_key_search_by_likelihood(spark):
    rng = random.Random(3)
    events = np.array([[rng.choice([*range(5), 5]) for _ in range(3)] + [rng.choice([*range(5), 6])] for _ in range(200)])
    counts, table = np.array([rng.randrange(1, 9) for _ in range(200)]), np.random.default_rng(1).random((28,) * 4)
    for capacity, reassign in ((1, 0.25), (2, 0.5), (1, 0.0)):
        p = keysearch.Problem(list("vwxyz"), events, counts, table, capacity)
        start = p.random_start(random.Random(5))
        cost, key = keysearch.search(p, start, 400, random.Random(1), reassign)
        full = [*key.tolist(), 26, 27]
        want = sum(n * table[tuple(full[u] for u in e)] for e, n in zip(events.tolist(), counts.tolist()))
        assert abs(cost - want) < 1e-6 and cost <= p.cost(start) and max(np.bincount(key, minlength=26)) <= capacity
    # of all keys of three units over few letters the search finds the best
    small_ = keysearch.Problem(list("xyz"), events[(events < 3).all(axis=1) | True] % 3, counts, table, 1)
    best = min(small_.cost(np.array(k)) for k in permutations(range(26), 3))
    runs = [keysearch.search(small_, small_.random_start(random.Random(k)), 3000, random.Random(k), 0.5)[0] for k in range(4)]
    assert min(runs) <= best * 1.02


def test_cost_tables():
    counts = np.zeros((28,) * 4)
    counts[26, 26, 26, 0], counts[26, 26, 0, 1], counts[0, 1, 2, 3], counts[0, 1, 2, 4] = 3, 2, 5, 1
    cost = keysearch.order_costs(counts, 3)
    assert np.allclose((2.0 ** -cost[0, 1, 2]).sum(), 1) and np.isclose(2.0 ** -cost[0, 1, 2, 3], 5.1 / 8.8)
    assert np.allclose(2.0 ** -keysearch.order_costs(counts, 0)[9, 9, 9], 2.0 ** -keysearch.order_costs(counts, 0)[1, 2, 3])
    w = keysearch.window_costs(counts)
    assert np.isclose(2.0 ** -w[0, 1, 2, 3], 0.1 * 5.1 / 8.6 + 0.2 * 5.1 / 8.6 + 0.3 * 5.1 / 8.6 + 0.4 * 5.1 / 8.6) and np.allclose((2.0 ** -w[4, 5, 6, :26]).sum(), 1)


def test_identifiability(monkeypatch):
    monkeypatch.setattr(solvers, "ALPHABET", "abcd")
    for seed in range(12):
        lex, words = small(seed, 1)
        best = solvers.branch_and_bound(lex, 100_000)
        full = {**best["key"]}
        rest = [v for v in "abcd" if v not in full.values()]
        for u in lex.order:
            full.setdefault(u, rest.pop() if rest else "d")
        if not lex.allowed(full):
            continue
        keys = solvers.equal_optima(lex, best["lower"], {u: "abcd" for u in lex.order})
        for u, v, verdict in solvers.assess_optimum(lex, full, 100_000):
            others = {k[u] for k in keys} - {v}
            assert verdict == ("ambiguous" if others else "forced_at_certified_optimum")


def test_empty_and_too_many():
    assert solvers.branch_and_bound(solvers.Lexicon({}, {"a"}), 5)["status"] == "empty_input"
    wide = solvers.Lexicon({chr(200 + i): 1 for i in range(30)}, {"a"}, 1)
    assert solvers.branch_and_bound(wide, 5)["status"] == "infeasible_alphabet"
    assert solvers.preserved_completions(2, [1, 1, 1]) == 6 and solvers.preserved_completions(3, [2, 1]) == 3 and solvers.preserved_completions(0, []) == 1


def test_exact_ratio():
    train = {("a", "b"): 3, ("a", "c"): 1, ("b", "a"): 5}
    a, b = {("a", "b"): 2, ("b", "a"): 1}, {("a", "c"): 2, ("b", "a"): 1}
    want = (31 / 44) ** 2 / (11 / 44) ** 2
    assert abs(float(solvers.likelihood_ratio(train, 4, a, b)) - want) < 1e-12
    ranked = solvers.rank_keys(train, 4, {"x": b, "y": a})
    assert [r[0] for r in ranked] == ["y", "x"] and ranked[1][1:3] == ("0x1", "0x1")


def test_solved_scores_agree_with_joins(spark):
    types, words = {"xyx": 5, "xy": 3, "z": 2}, {"aba", "ab", "c"}
    found = solvers.solve(spark, types, words, [("bnb", 0, 1, 100), ("anneal", 1, 2, 50), ("local", 2, None, 2)])
    scores = {(r.method): r.score for r in solvers.score_keys(found, spark.createDataFrame(list(types.items()), "w string, weight long"), spark.createDataFrame([(w,) for w in words], "w string")).collect()}
    for r in found.collect():
        assert scores.get(r.method, 0) == r.lower
        assert r.method != "bnb" or r.lower == r.upper == 10


def matchings(edges):
    units = sorted({u for e in edges for u in e})
    out = set()
    for p in permutations(units):
        if len(p) % 2 == 0:
            m = frozenset(tuple(sorted(p[i : i + 2])) for i in range(0, len(p), 2))
            if m <= {tuple(sorted(e)) for e in edges}:
                out.add(m)
    return out


def test_matchings_and_forced_edges(spark):
    rng = random.Random(1)
    for _ in range(40):
        edges = [(a, b) for a in "abcdef" for b in "abcdef" if a < b and rng.random() < 0.35]
        every = matchings(edges) if edges else set()
        status, found, _ = graphs.perfect_matchings(edges, most=10_000)
        if edges:
            assert {frozenset(m) for m in found} == every and status == ("none", "unique", "multiple")[min(2, len(every))]
        for a, b, verdict in graphs.forced_edges(edges):
            assert (verdict == "forced") == all((a, b) in m for m in every)
    assert graphs.perfect_matchings([])[0] == "empty_scope"
    assert graphs.perfect_matchings([("a", "b"), ("c", "d")], budget=1)[0] == "unknown_budget"
    assert graphs.quotient([("a", "b"), ("c", "d")]) == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "c")]
    df = spark.createDataFrame([("g", "a", "b"), ("g", "b", "a"), ("h", "a", "b"), ("h", "b", "c")], "grp string, a string, b string")
    got = {(r.grp, r.status, r.a, r.verdict) for r in graphs.matchings_by(df, "grp").collect()}
    assert got == {("g", "unique", "a", "forced"), ("h", "none", None, None)}


def test_lattice(spark):
    rng = random.Random(2)
    certified = 0
    for _ in range(60):
        rows = [[rng.randrange(-4, 5) for _ in range(3)] for _ in range(rng.randrange(1, 7))]
        r = graphs.lattice_certificate(rows)
        if r["status"] == "certified":
            certified += 1
            assert graphs.verify_lattice(rows, r)
            assert graphs.rank_mod(rows, 3) == 3
    assert certified > 10
    assert graphs.lattice_certificate([[2, 0], [0, 1]])["reason"] == "pivot" and graphs.lattice_certificate([[1, 1]])["reason"] == "rank"
    assert graphs.lattice_certificate([])["reason"] == "empty"
    df = spark.createDataFrame([("t", "1", "a", 1), ("t", "2", "b", 1), ("t", "2", "a", 3)], "track string, line string, unit string, n long")
    row = graphs.lattice_tracks(df, "track", ["a", "b"]).first()
    assert (row.status, row["rank"], row.n_rows, row.verified) == ("certified", 2, 2, True)


def test_lattice_in_buckets(spark, monkeypatch):
    rng = random.Random(6)
    data, tracks = [], {}
    for t in "uvw":
        tracks[t] = [[rng.randrange(5) * (2 if t == "v" else 1) for _ in range(4)] for _ in range(60)]
        data += [(t, str(k), c, v) for k, r in enumerate(tracks[t]) for c, v in zip("abcd", r)]
    df = spark.createDataFrame(data, "track string, line string, unit string, n long")
    monkeypatch.setattr(graphs, "FOLDED", 15)
    got = {r.track: r for r in graphs.lattice_tracks(df, "track", list("abcd")).collect()}
    for t, rows in tracks.items():
        one = graphs.lattice_certificate(sorted(rows))
        assert (got[t].status, got[t]["rank"], got[t].rank_mod3) == (one["status"], one["rank"], graphs.rank_mod(rows, 3)) and got[t].n_rows == len({tuple(r) for r in rows})
        assert got[t].support < 30
    assert got["v"].status == "not_certified" and got["v"].gcd % 2 == 0


def test_lattice_against_determinants():
    # three columns: the lattice is whole if and only if the 3 x 3 minors have no common divisor
    from itertools import combinations
    from math import gcd

    rng = random.Random(7)
    for _ in range(200):
        rows = [[rng.randrange(-3, 4) for _ in range(3)] for _ in range(rng.randrange(3, 6))]
        det = lambda a, b, c: a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0])
        r = graphs.lattice_certificate(rows)
        assert (r["status"] == "certified") == (gcd(*[det(*x) for x in combinations(rows, 3)]) == 1)
        assert len(graphs.independent_rows(rows, 3)) == graphs.rank_mod(rows, 3) <= 3


def test_rows_of_a_lattice_are_left_out_at_once(monkeypatch):
    rng, calls = random.Random(5), []
    rows = sorted([rng.randrange(9) for _ in range(6)] + [0] for _ in range(3000))
    one = graphs.Lattice(7)
    for k, row in enumerate(rows):
        one.add(row, k)
    add = graphs.Lattice.add
    monkeypatch.setattr(graphs.Lattice, "add", lambda self, row, number: (calls.append(number), add(self, row, number)))
    many = graphs.Lattice(7)
    many.add_all(rows)
    assert many.rows == one.rows and len(calls) < 100


def _many(seed, n=90, words=300):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 6)))
    return {word(): rng.randrange(1, 50) for _ in range(n)}, {word() for _ in range(words)}


def test_classes_bound_as_masks_do(monkeypatch):
    for seed in range(4):
        types, words = _many(seed)
        lex = solvers.Lexicon(types, words, 1)
        by, key = solvers.ShapeBound(lex), {}
        assert lex.bound({}) == lex.bits.bound({}) == solvers.ShapeMasks(lex).bound()
        assert lex.pivot_bound({}) == lex.bits.pivot(lex.bits.full, {}) == solvers.ShapeMasks(lex).pivot()
        for u in lex.order[:6]:
            bounds, scores = by.children(key, u)
            for v in lex.values(key):
                child = {**key, u: v}
                assert bounds[ord(v) - 97] == lex.bits.bound(child) == lex.bound(child) and scores[ord(v) - 97] == lex.score(child)
            key[u] = lex.values(key)[seed % len(lex.values(key))]
        wanted = [solvers.branch_and_bound(lex, 40)]
        monkeypatch.setattr(solvers.ShapeBound, "possible", staticmethod(lambda lex: False))
        assert [solvers.branch_and_bound(lex, 40)] == wanted
        monkeypatch.undo()


def test_a_large_vocabulary_writes_no_pairs(monkeypatch):
    types, words = _many(9)
    monkeypatch.setattr(solvers.Lexicon, "candidates_of", lambda self, t: pytest.fail("pairs of types and words"))
    monkeypatch.setattr(solvers, "MASK_BYTES", 1)
    for capacity in (1, 2):
        lex = solvers.Lexicon(types, words, capacity)
        lex.bound({})
        solvers.anneal_key(lex, 50, 1)
    lex = solvers.Lexicon(types, words, 1)
    lex.pivot_bound({}), solvers.pair_bound(lex), solvers.branch_and_bound(lex, 20)


def test_scores_by_digits():
    types, words = _many(3)
    types["abcdefghabcdefgh"] = 7
    words.add("hgfedcbahgfedcba")
    lex = solvers.Lexicon(types, words, 1)
    key = dict(zip("abcdefgh", "abcdefgh"))
    for new in (dict(zip("abcdefgh", "hgfedcba")), {**key, "a": "b", "b": "a"}, {**key, "c": "z"}, key):
        assert lex.gain(key, new, tuple("abcdefgh")) == lex.score(new) - lex.score(key)


def test_local_search_starts(monkeypatch):
    types, words = _many(5)
    lex, asked = solvers.Lexicon(types, words, 1), []
    anneal = solvers.anneal_key
    monkeypatch.setattr(solvers, "anneal_key", lambda lex, steps, seed, start=None: (asked.append((steps, start)), anneal(lex, 30, seed, start))[1])
    assert solvers.local_start(lex, 0) == solvers.frequency_start(lex) and not asked
    solvers.local_start(lex, 1)
    assert [steps for steps, _ in asked] == [2000] * 8 and asked[0][1] == solvers.frequency_start(lex)


def test_ratio_in_lowest_terms_at_size():
    import time

    rng = random.Random(2)
    pairs = [(h, s) for h in "abcdefghijklmnopqrstuvwxyz" for s in "abcdefghijklmnopqrstuvwxyz"]
    train = {e: rng.randrange(100_000) for e in pairs}
    a, b = ({e: rng.randrange(40) for e in pairs} for _ in range(2))
    n, m = solvers.ratio_parts(train, 28, a, b)
    want, totals = Fraction(1), Counter()
    for (h, _), c in train.items():
        totals[h] += c
    for e in pairs:
        want *= Fraction(10 * train[e] + 1, 10 * totals[e[0]] + 28) ** (a[e] - b[e])
    assert Fraction(n, m) == want and (n, m) == (want.numerator, want.denominator)
    large = [{e: rng.randrange(600) for e in pairs} for _ in range(4)]
    began = time.time()
    ranked = solvers.rank_keys(train, 28, {f"{k:02d}": e for k, e in enumerate(large)})
    assert time.time() - began < 20 and [r[3] for r in ranked] == sorted((r[3] for r in ranked), reverse=True)
