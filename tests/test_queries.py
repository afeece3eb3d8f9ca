"""The shared SQL against plain Python on a small table, and both engines against each other."""

import math
import os
import random
import re
from collections import Counter

import duckdb
import pytest

from lociflow.operators import resample
from lociflow.plans import catalog, joins, models, shared, statistics, studies

SCHEMA = (
    "locus_id long, source_order long, volume_id long, line_group string, folio string, locus string, kind string, transcriber string, scribe string, "
    "text_raw string, tokens array<string>, metadata map<string,string>, excluded_tokens int, paragraph_start boolean, paragraph_end boolean, received_at timestamp_ntz"
)
WORDS = ["qokedy", "chedy", "daiin", "ol", "shey", "cthy", "oteey", "dy", "s", "ar"]


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    import datetime

    rng, rows = random.Random(7), []
    for k in range(240):
        i = k * 3001 + (k > 120) * 10**7
        folio = f"f{rng.randrange(1, 9)}{rng.choice('rv')}"
        rows.append((i, k, rng.randrange(9), None, folio, f"{folio}.{k}", rng.choice(["+P0", "@Lf"]), rng.choice(["QX", "MR", None]), None, "a.b", [rng.choice([*WORDS, *WORDS, "x?", None, ""]) for _ in range(rng.randrange(8))],
                     {"L": rng.choice("AB"), "I": rng.choice("AHSC")}, 0, False, False, datetime.datetime(2026, 1, 1)))
    rows += rows[:15]
    d = str(tmp_path_factory.mktemp("data"))
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{d}/loci.parquet")
    return d, rows


def records(rows):
    """(id, words, split) of each locus, in order."""
    import hashlib

    out = {}
    for r in rows:
        number = "".join(c for c in r[4] if c.isdigit()).lstrip("0")
        b = int.from_bytes(hashlib.sha256(f"lociflow-v1{r[2]}:{number}".encode()).digest()[:8]) % 10
        out[r[0]] = ([t for t in r[10] if t and t.isalpha()], "test" if b < 2 else "validation" if b == 2 else "train")
    return dict(sorted(out.items()))


def test_stream_windows(spark, data, monkeypatch):
    d, rows = data
    want = Counter()
    for split in ("train", "validation", "test"):
        s = "".join("".join(w) for w, x in records(rows).values() if x == split)
        want.update((split, s[i : i + 4]) for i in range(len(s) - 3))
    for step in ("65536", "7"):  # small ranges put the borders everywhere
        body = models.DERIVED["stream4"].replace("65536", step)
        got = {(r.split, r.a + r.b + r.c + r.d): r.n for r in shared.query(body)(spark, d).collect()}
        assert got == want
    offsets = shared.query(statistics.BODIES["fixed_blocks"].replace("65536", "9001"))(spark, d).collect()
    length = {s: sum(len("".join(w)) for w, x in records(rows).values() if x == s) for s in ("train", "validation", "test")}
    assert {r.split: r.blocks for r in offsets} == {s: math.ceil(n / 64) for s, n in length.items() if n}


def test_ngram_events(spark, data):
    d, rows = data
    want = Counter()
    for w, split in records(rows).values():
        for x in w:
            y = "^^^" + x + "$"
            for i in range(3, len(y)):
                want[split, y[i - 3], y[i - 2], y[i - 1], y[i]] += 1
    known = {s for (split, *_, s) in want if split == "train"}
    assert all(s in known for *_, s in want)  # no unknown letters here: no mapping to do
    got = {(r.split, r.h3, r.h2, r.h1, r.s): r.n for r in shared.query(models.DERIVED["ngram_events"])(spark, d).collect()}
    assert got == want


def test_entropy_and_pairs(spark, data):
    d, rows = data
    letters = Counter("".join("".join(w) for w, _ in records(rows).values()))
    t = sum(letters.values())
    assert shared.query(statistics.BODIES["entropy_h1"])(spark, d).first().h1 == pytest.approx(-sum(n / t * math.log2(n / t) for n in letters.values()), abs=2e-6)
    pairs = Counter(p for w, _ in records(rows).values() for p in zip(w, w[1:]))
    got = {(r.prev, r.w): r.n for r in shared.query(statistics.BODIES["adjacent_pairs"])(spark, d).collect()}
    assert got == pairs


@pytest.mark.parametrize("name", ["inventory", "inventory_by", "elig_context", "split_manifest", "align_full_outer", "agreement_agg", "ngram_score", "bigram_score", "boundary_score", "memory_grid", "perm_word_order", "bound_independent", "compat_graph", "edit1_vocab", "pattern_join", "lexicon_hits", "candidate_compat", "capacity_join", "compat_agg", "memory_score", "column_asof", "null_same_length", "holm", "alternation", "compat_graph", "boundary_study", "elig_blue", "score_difference", "stream_concat", "null_same_tail_draws", "cyclic_pairing_edges"])
def test_engines_agree(spark, data, name):
    d, _ = data
    spark_rows = catalog.QUERIES[name](spark, d)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW loci AS SELECT * FROM '{d}/loci.parquet/*.parquet'")
    other = con.sql(catalog.SQL[name])
    assert sorted(spark_rows.columns) == sorted(other.columns)
    order = [other.columns.index(c) for c in spark_rows.columns]
    norm = lambda v: round(v, 5) if isinstance(v, float) else v
    a = sorted(str([norm(v) for v in r]) for r in spark_rows.collect())
    b = sorted(str([norm(r[k]) for k in order]) for r in other.fetchall())
    assert a == b


@pytest.mark.parametrize("name,first,n", [("perm_word_order", -1, 500), ("bootstrap_groups", 0, 499), ("null_tail", -1, 100), ("null_matched", -1, 100)])
def test_replicates_of_the_reference(spark, data, name, first, n):
    d, _ = data
    con = duckdb.connect()
    con.sql(f"CREATE VIEW loci AS SELECT * FROM '{d}/loci.parquet/*.parquet'")
    rows = [tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in catalog.QUERIES[name](spark, d).collect()]
    other = [tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in con.sql(catalog.SQL[name]).fetchall()]
    assert sorted(rows) == sorted(other) and sorted(r[0] for r in rows) == list(range(first, first + n))


def test_every_query_has_one_text():
    names = [*statistics.BODIES, *joins.BODIES, *models.BODIES, *studies.QUERIES]
    assert len(names) == len(set(names)) and set(names) <= set(catalog.QUERIES) and {*statistics.BODIES, *joins.BODIES, *models.BODIES} <= set(catalog.SQL)


def split_words(rows, split):
    return [w for w, x in records(rows).values() for w in w if x == split]


def pattern(w):
    first = []
    return tuple(first.index(c) if c in first else first.append(c) or len(first) - 1 for c in w)


def test_candidates_by_brute_force(spark, data):
    d, rows = data
    lex, cip = sorted(set(split_words(rows, "train"))), sorted(set(split_words(rows, "validation")))
    got = {r.w: r.candidates for r in catalog.QUERIES["pattern_join"](spark, d).collect()}
    assert got == {w: sum(pattern(w) == pattern(x) for x in lex) for w in cip} and len(got) > 3

    def fits(w, x, most):
        key = {}
        return len(w) == len(x) and all(key.setdefault(a, b) == b for a, b in zip(w, x)) and all(list(key.values()).count(v) <= most for v in key.values())

    got = {r.w: r.candidates for r in catalog.QUERIES["capacity_join"](spark, d).collect()}
    assert got == {w: sum(fits(w, x, 2) for x in lex) for w in cip}

    def together(a, x, b, y):
        key = {}
        ok = all(key.setdefault(u, v) == v for u, v in [*zip(a, x), *zip(b, y)])
        return ok and len(set(key.values())) == len(key)

    of = {w: [x for x in lex if pattern(w) == pattern(x)] for w in cip}
    want = {(a, b) for a in cip for b in cip if a < b and of[a] and of[b] and not any(together(a, x, b, y) for x in of[a] for y in of[b])}
    assert {tuple(r) for r in studies.conflict_self_join(spark, d).collect()} == want
    for a, x, b, y in [("ab", ["xy"], "bc", ["zy"]), ("ab", ["xy", "pq"], "bc", ["yz"]), ("ab", ["xy"], "cd", ["yx"]), ("a", ["x"], "b", ["y"])]:
        assert studies.jointly(a, b, x, y) == any(together(a, p, b, q) for p in x for q in y)


def test_orders_and_keys():
    import numpy as np

    k = resample.keys(408, np.arange(50), np.array([7, 3001, 10**12]), 6)
    assert k.shape == (3, 50, 6) and len(np.unique(k)) > 850
    con = duckdb.connect()
    assert con.sql(f"SELECT {resample.sql_key(408, '17', '1000000000000', '4')}").fetchall()[0][0] == k[2, 17, 4]
    p = resample.orders(k, True, np.array([[0, 2, 3, 2, 2, 3]] * 3))
    assert (p[:, :, 0] == 0).all() and (np.sort(p, axis=2) == np.arange(6)).all() and set(p[:, :, 2].ravel()) == {2, 5}
    p = resample.orders(k)
    assert abs((p[:, :, 0] == 0).mean() - 1 / 6) < 0.1


def test_word_order_statistics():
    import numpy as np

    # four equal words: every order is alike; in the other line each word opens once in four
    order, sums = resample.word_order([["kedy"] * 4])
    k = resample.keys(1, np.arange(9), np.array([1]), 4)
    assert (sums(order(k)) == np.array([[3], [3], [3], [1], [0]])).all()
    rng = random.Random(3)
    lines = [[rng.choice(["ab", "abc", "abd", "ka", "tab", "b"]) for _ in range(5)] for _ in range(4)]
    order, sums = resample.word_order(lines)
    p = order(resample.keys(2, np.arange(7), np.arange(4), 5))
    got = sums(p)
    near = lambda a, b: a == b or any(a[:i] + a[i + 1 :] == b or b[:i] + b[i + 1 :] == a or (len(a) == len(b) and a[:i] + a[i + 1 :] == b[:i] + b[i + 1 :]) for i in range(max(len(a), len(b))))
    for r in range(7):
        shown = [[w[k] for k in p[i, r]] for i, w in enumerate(lines)]
        pairs = [(a, b) for w in shown for a, b in zip(w, w[1:])]
        assert got[:4, r].tolist() == [16, sum(a == b for a, b in pairs), sum(near(a, b) for a, b in pairs), sum(w[0][0] in "tkpf" for w in shown)]
        assert got[4, r] == pytest.approx(sum(len(w[0]) - sum(map(len, w[1:])) / 4 for w in shown))


def test_holm(spark):
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p double")
    assert {r.name: r.adjusted for r in studies.holm_adjusted(p).collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}


def test_columns_and_rotations(spark):
    # target columns 0 and 3; the line above ends its words at 3, 6 and 10
    total, n = resample.column_excess(["ab", "cd", "abc"], ["ab", "cd"])
    assert n == 2 and total == pytest.approx((1 - 0) + (0 - 1))
    rng = random.Random(8)
    pages = [[(" ".join(rng.choice(["ab", "cd", "abc", "b"]) for _ in range(4))) for _ in range(3)] for _ in range(2)]
    order, sums = resample.column_order(pages)
    import numpy as np

    p = order(resample.keys(3, np.arange(5), np.arange(2), 3))
    for r in range(5):
        parts = [resample.column_excess(g[a].split(), g[b].split()) for k, g in enumerate(pages) for a, b in zip(p[k, r], p[k, r, 1:])]
        assert sums(p)[:, r] == pytest.approx([sum(x for x, _ in parts), sum(n for _, n in parts)])
    panels = [("s", [rng.random() < 0.5 for _ in range(n)], [rng.choice([True, False, None]) for _ in range(n)]) for n in (1, 3, 4, 5)]
    scores = [[sum(o is not None and p[(i + k) % len(p)] == o for i, o in enumerate(obs)) for k in range(len(p))] for _, p, obs in panels]
    assert [sorted(resample.rotation_scores(p, o)) for _, p, o in panels] == [sorted(s) for s in scores]
    import itertools

    every = [sum(c) for c in itertools.product(*scores)]
    row = resample.rotations(spark.createDataFrame(panels, "study string, predicted array<boolean>, observed array<boolean>")).first()
    seen = sum(s[0] for s in scores)
    assert (row.panels, row.observed) == (4, seen) and row.mean == pytest.approx(sum(every) / len(every)) and row.p_upper == pytest.approx(sum(x >= seen for x in every) / len(every))


def test_cell_ratio():
    from itertools import permutations

    chance = lambda x, y: {"a": 0.6, "b": 0.3, "c": 0.1}[x] if y == "p" else 0.25
    last, first = list("aabc"), list("pqpp")
    every = set(permutations(last))
    want = math.log2(math.prod(map(chance, last, first)) / (sum(math.prod(map(chance, x, first)) for x in every) / len(every)))
    assert resample.cell_log_ratio(last, first, chance) == pytest.approx(want)
    assert resample.cell_log_ratio(last, first, chance, limit=1) is None


def test_wide_cell_is_summed():
    # a chance that is a product is the same for every arrangement, however many states there are
    cell = [c for c in "abcdefgh" for _ in range(6)]
    chance = lambda x, y: (1 + ord(x) % 5) / (2 + ord(y) % 3)
    assert resample.cell_log_ratio(cell, cell[5:] + cell[:5], chance) == pytest.approx(0, abs=1e-6)


def test_count_vector(spark, data):
    d, rows = data
    lines = {i: w for i, (w, _) in records(rows).items() if w}
    got = {}
    for r in catalog.QUERIES["count_vector"](spark, d).collect():
        got.setdefault(r.locus_id, {})[r.u] = r.n
    assert got.keys() == lines.keys()
    for i, w in lines.items():
        want = Counter(u for x in w for u in re.findall("cth|ckh|cph|cfh|ch|sh|.", x))
        assert got[i] == {**want, " ": len(w) - 1, "|": 1}


def test_memory_of_lines(spark, data):
    from lociflow.plans import composites

    import numpy as np

    d, _ = data
    # recorded lines lose what the model says they do
    chosen = {r.family: (r.width, r.lam) for r in catalog.QUERIES["memory_grid"](spark, d).collect()}
    scores = {(r.family, r.width, r.lam): r.bits for r in catalog.QUERIES["memory_score"](spark, d).where("split = 'test'").collect()}
    rows = composites.memory_order_null(spark, d, 5).collect()
    for mode in ("tail", "same_length"):
        assert {r.r: r for r in rows if r.mode == mode}[-1].bits == pytest.approx(scores["edit", *chosen["edit"]], abs=2e-6)
    # and any order of any line what adding up by hand gives
    rng = random.Random(2)
    lines = [["\t".join([rng.choice(["ab", "abc", "b", "ac"]), rng.choice("01"), str(rng.random()), rng.choice(["", "0.7"]), ""]) for _ in range(5)] for _ in range(3)]
    order, sums = resample.memory_loss(2, 0.4)(lines)
    p = order(resample.keys(1, np.arange(4), np.arange(3), 5))
    for r in range(4):
        want = 0.0
        for k, line in enumerate(lines):
            x = [line[i].split("\t") for i in p[k, r]]
            for t in range(1, 5):
                near = [(float(x[t][2]) if not c[3] else float(x[t][2]) / 0.7 if x[t][1] == "1" and c[0] != x[t][0] and resample.within_one(c[0], x[t][0]) else 0.0) for c in x[max(0, t - 2) : t]]
                want -= math.log2(0.6 * float(x[t][2]) + 0.4 * sum(near) / len(near))
        assert sums(p)[1, r] == pytest.approx(want)


def test_composites(spark, data):
    from lociflow.plans import composites

    d, _ = data
    parts = {r.part for r in composites.structural_run(spark, d).collect()}
    assert {"inventory", "holm", "gain_interval"} <= parts
    assert composites.first_stage_summary(spark, d).startswith("# Summary\n\n## agreement_agg")


def test_reports_add_up(spark, data):
    d, _ = data
    assert all(r.holds for r in catalog.QUERIES["summary_validate"](spark, d).collect())
    rows = {r.category: r for r in catalog.QUERIES["cyclic_pairing_control"](spark, d).collect()}
    assert rows["planted"].edges >= rows["planted"].forced >= 1
    for r in catalog.QUERIES["medical_control"](spark, "/root/testdata/sf0.001").collect() if os.path.exists("/root/testdata/sf0.001") else ():
        assert r.lower <= r.planted <= r.upper or r.upper >= r.lower


def test_structural_folder(spark, data, tmp_path):
    from lociflow.plans import composites

    d, _ = data
    composites.write_structural_run(spark, d, str(tmp_path / "run"))
    assert {p.name for p in (tmp_path / "run").iterdir() if not p.name.startswith(".")} == {"records", "analysis.json", "REPORT.md", "SHA256SUMS"}


def test_agreement(spark, tmp_path):
    base = {"source_order": 1, "volume_id": 1, "line_group": None, "kind": "+P0", "scribe": None, "metadata": {}, "excluded_tokens": 0, "paragraph_start": False, "paragraph_end": False, "received_at": None}
    readings = [("QX", 1, ["a", "b", "c"]), ("MR", 1, ["a", "c"]), ("QX", 2, ["d", "e"]), ("MR", 2, ["d", "x", "e"]), ("QX", 3, ["f"]), ("QX", 4, ["g"]), ("MR", 4, [])]
    rows = [{**base, "locus_id": 10 * k + (who == "MR"), "folio": "f1r", "locus": f"f1r.{k}", "transcriber": who, "text_raw": ".".join(t), "tokens": t} for who, k, t in readings]
    d = str(tmp_path)
    spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA).write.parquet(f"{d}/loci.parquet")
    r = studies.agreement_agg(spark, d).first()
    assert (r.aligned, r.eligible, r.distance_sum, r.distance_max, r.token_identical) == (3, 2, 2, 1, 0)


def test_streams(spark, data):
    d, rows = data
    got = {(r.prev, r.ch): r.n for r in catalog.QUERIES["stream_bigrams"](spark, d).collect()}
    want = Counter(p for w, _ in records(rows).values() for x in w for p in zip("^" + x, x + "$"))
    assert got == want
    assert sum(r.n for r in catalog.QUERIES["stream_windows"](spark, d).collect()) == sum(len(w) for w, _ in records(rows).values())


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    """Pages of language B, of very different numbers of lines, some lines without a place in the source."""
    rng, rows = random.Random(11), []
    for k in range(400):
        folio = f"f{min(rng.randrange(1, 40), rng.randrange(1, 40))}{rng.choice('rv')}"
        words = [rng.choice(WORDS) for _ in range(rng.randrange(2, 9))]
        rows.append((k * 7 + 1, None if k % 13 == 0 else (k * 37) % 400, rng.randrange(3), None, folio, f"{folio}.{k}", "+P0", "QX", None, "a.b", words, {"L": "B"}, 0, False, False, None))
    d = str(tmp_path_factory.mktemp("pages"))
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{d}/loci.parquet")
    split, found = records(rows), {}
    for r in sorted(rows, key=lambda r: (r[1] is None, r[1], r[0])):
        if split[r[0]][1] == "test" and len(r[10]) >= 3:
            found.setdefault((r[2], r[4]), []).append((r[0], r[10]))
    return d, found


def test_column_asof_without_joins(spark, pages):
    d, found = pages
    pairs = [(above, words) for page in found.values() for (_, above), (_, words) in zip(page, page[1:])]
    parts = [resample.column_excess(above, words) for above, words in pairs]
    df = catalog.QUERIES["column_asof"](spark, d)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Subquery" not in plan and plan.count("Exchange") <= 3  # the driver holds every stage of a plan
    r = df.first()
    assert (r.candidates, r.targets) == (sum(len(w) for _, w in pairs), sum(n for _, n in parts)) and r.targets > 100
    assert r.excess == pytest.approx(sum(x for x, _ in parts) / r.targets, abs=1e-6)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW loci AS SELECT * FROM '{d}/loci.parquet/*.parquet'")
    other = con.sql(catalog.SQL["column_asof"])
    assert dict(zip(other.columns, other.fetchall()[0])) == r.asDict()


def test_orders_of_long_pages(spark, pages):
    import numpy as np

    page_lines = [(min(i for i, _ in page), [" ".join(words) for _, words in page]) for page in pages[1].values() if len(page) > 1]
    assert {len(lines) > 4 for _, lines in page_lines} == {True, False}
    want = np.zeros((2, 31))
    for number, lines in page_lines:
        places = np.concatenate([np.arange(len(lines))[None], resample.orders(resample.keys(5, np.arange(30), np.array([number]), len(lines)))[0]])
        for r, p in enumerate(places):
            want[:, r] += np.sum([resample.column_excess(lines[a].split(), lines[b].split()) for a, b in zip(p, p[1:])], axis=0)
    df = spark.createDataFrame(page_lines, "page long, lines array<string>")
    for most, held in ((1024, 1 << 20), (4, 1 << 20), (0, 100)):  # all pages by table, long ones whole, all in ranges of replicates
        got = {r.r: (r.excess, r.targets) for r in resample.column_sums(df, 30, 5, most, held).collect()}
        assert sorted(got) == list(range(-1, 30))
        assert np.allclose([got[r] for r in range(-1, 30)], want.T, atol=1e-9)
    plan = studies.line_order_perm(spark, pages[0], 20)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan  # the orders are counted once, though their scores are read twice


def test_distances_of_pairs():
    rng = random.Random(5)
    words = {"".join(rng.choice("abc") for _ in range(rng.choice([1, 2, 3, 6, 20, 33]))) for _ in range(60)}
    for more in (set(), {"ab" * 40, "ba" * 45, "c" * 64, "b" * 65}):
        x = sorted(words | more, key=lambda w: (-len(w), w))
        found = resample.distances(x)
        assert all(found[i, j] == resample.distance(a, b) for i, a in enumerate(x) for j, b in enumerate(x))
    x = [0, 1, resample.PRIME - 1, resample.PRIME, 2 * resample.PRIME, 2**32, 2**62 - 1]
    import numpy as np

    assert resample.modulo(np.array(x)).tolist() == [v % resample.PRIME for v in x]


def test_triggers_write_what_arrived(spark, tmp_path):
    import datetime

    from lociflow.runtime import shared_dir
    from lociflow.streaming import counts

    rng, d = random.Random(2), str(tmp_path)
    arrived = []
    for k in range(6):
        rows = [(k * 20 + i, 1, 1, None, "f1r", "f1r.1", "+P0", "QX", None, "a", [rng.choice(WORDS) for _ in range(4)], {}, 0, False, False, datetime.datetime(2026, 1, 1 + k // 2, k % 2 * 12, i)) for i in range(20)]
        arrived += [(r[15].date(), w) for r in rows for w in r[10]]
        none = [(None, *rows[0][1:])] * (k == 3)  # no record; and five records of the file before come again, a day later
        again = [(*r[:15], r[15] + datetime.timedelta(days=1)) for r in last[:5]] if k else []
        spark.createDataFrame([*rows, *again, *none], SCHEMA).coalesce(1).write.mode("append").parquet(f"{d}/loci.parquet")
        last = rows
    want = Counter(arrived)
    got = counts.run_to_sums(counts.windowed_terms(counts.read_loci_stream(spark, f"{d}/loci.parquet")), "written").collect()
    assert {(r.start.date(), r.term): r.n for r in got} == want
    written = spark.read.parquet(f"{shared_dir(spark)}/streams/written/parts").agg({"n": "sum", "*": "count"}).first()
    assert written["sum(n)"] == len(arrived) and written["count(1)"] <= 6 * len(WORDS)  # not all counts again at each trigger
    days = {r.day: (r.terms, r.n) for r in catalog.QUERIES["stream_windows"](spark, d).collect()}
    assert days == {str(x): (sum(y == x for y, _ in want), sum(n for (y, _), n in want.items() if y == x)) for x in {x for x, _ in want}}


def test_entry_without_llm(monkeypatch):
    import importlib.util

    import __spark_entry__

    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith("lociflow.llm") else real(name, *a))
    assert not any(k in __spark_entry__.queries() for k in ("p1_found", "p7_ids")) and "p6_found" in __spark_entry__.queries()
    assert os.path.exists(__spark_entry__.__file__)
