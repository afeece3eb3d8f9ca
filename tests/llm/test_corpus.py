import random
from itertools import combinations

import pytest

from lociflow.llm import leakage, markup, pairs, splits, terms

LOCI = "locus_id long, volume_id long, line_group string, folio string, scribe string, tokens array<string>, metadata map<string,string>, id string"


def loci(spark, n=400, seed=1):
    rng = random.Random(seed)
    words = ["ab", " Ab ", "cd", "ef", "gh", None, "", "x1", "ÿ", "qo", "da"]
    rows = []
    for i in range(n):
        rows.append((i, rng.choice([1, 2, 3, 4, None]), rng.choice([None, "1", "2", "3"]) if i % 3 else None, rng.choice([None, "f1r", "F01V", "fRos", "f85v2", "f7r", "x"]),
                     rng.choice([None] * 12 + ["hand a", " Hand A ", f"hand {i}"]), None if i % 17 == 0 else [rng.choice(words) for _ in range(rng.randrange(7))], {"L": rng.choice("AB")}, "clash"))
    rows += rows[:20]
    return rows, spark.createDataFrame(rows, LOCI)


def brute_families(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    seen = {}
    for i, vol, group, folio, scribe, *_ in rows:
        find(i)
        number = None
        if folio:
            digits = "".join(c for c in folio.lower().replace("fros", "85").partition("r")[0].partition("v")[0] if c.isdigit())
            number = digits.lstrip("0") or None
        for tie in (("g", vol, group), ("f", vol, number), ("s", scribe.strip().lower() if scribe else None)):
            if None not in tie:
                join(i, seen.setdefault(tie, i))
    return {i: find(i) for i in parent}


def test_families_and_splits(spark):
    rows, df = loci(spark)
    want = brute_families(rows)
    members, roots = splits.families(df, "locus_id", splits.locus_ties())
    got = {r.id: r.root for r in members.distinct().join(roots, "tie").collect()}
    assert got == want
    rng = random.Random(3)
    runs = [(i, rng.choice(["train", " Train", None, "dev", "valid", "test"] if want[i] % 2 else ["train", "TRAIN ", None])) for i in range(0, 400, 2)] + [(99999, "test")]
    name = {"dev": "validation", "valid": "validation"}
    parts = {}
    for i, p in runs:
        if p and i in want:
            parts.setdefault(want[i], set()).add(name.get(p.strip().lower(), p.strip().lower()))
    torn = splits.torn_families(df, spark.createDataFrame(runs, "locus_id long, partition_name string"))
    assert {r.root_locus for r in torn.collect()} == {r for r, s in parts.items() if len(s) > 1}


def test_assignment_keeps_families_and_shares(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, i // 7 % 90, None, None, None, [], {"L": "AB"[i % 2]}, "") for i in range(2000)], LOCI)
    rows = splits.assign_splits(df, "locus_id", [splits._tie("v", F.col("volume_id"))], F.col("metadata")["L"], ["A", "B"], {"train": 0.7, "validation": 0.1, "test": 0.2}).collect()
    assert len(rows) == 2000 and len({r.locus_id for r in rows}) == 2000
    assert len({(r.root, r.split) for r in rows}) == 90
    share = sum(r.split == "train" for r in rows) / 2000
    assert abs(share - 0.7) < 0.03
    assert splits.assign_splits(df.limit(0), "locus_id", splits.locus_ties(), F.lit("A"), ["A"], {"a": 1, "b": 1}).count() == 0


def test_annealing_returns_its_best(monkeypatch):
    # the search is cut after each number of moves; its walk is the same up to there, so the best never rises
    rng = random.Random(4)
    vectors = [(float(rng.randrange(1, 9)), float(rng.randrange(3))) for _ in range(100)]
    shares = [0.7, 0.1, 0.2]
    target = [[p * sum(v[d] for v in vectors) for d in range(2)] for p in shares]
    start = [rng.randrange(3) for _ in vectors]
    ends = []
    monkeypatch.setattr(splits.math, "exp", lambda x: 0.5 if x < 0 else 1.0)  # half of the moves uphill are taken: the end is not the best
    for moves in (1, 2, 4, 8):
        monkeypatch.setattr(splits, "MOVES", moves)
        cost, at = splits.anneal(vectors, shares, start, 7, target)
        sums = [[sum(v[d] for v, x in zip(vectors, at) if x == s) for d in range(2)] for s in range(3)]
        assert abs(splits.deviation(sums, target) - cost) < 1e-9
        ends.append(cost)
    assert ends == sorted(ends, reverse=True)


def test_long_chain(spark):
    edges = spark.range(500).selectExpr("xxhash64(id) as a", "xxhash64(id + 1) as b").selectExpr("least(a, b) as u", "greatest(a, b) as v")
    labels = splits.connected(edges).collect()
    assert len(labels) == 501 and len({r.root for r in labels}) == 1


def test_terms(spark):
    rows, df = loci(spark)
    occ, rec, seen = {}, {}, set()
    for i, *_, tokens, _, _ in rows:
        if i in seen:
            continue
        seen.add(i)
        for t in tokens or []:
            t = (t or "").strip().lower()
            if t.isascii() and t.isalpha():
                occ[t] = occ.get(t, 0) + 1
                rec.setdefault(t, set()).add(i)
    got = {r.term: (r.n_occurrences, r.n_records, r.mark) for r in terms.term_frequencies(df).collect()}
    assert got == {t: (n, len(rec[t]), "rare" if n == 1 else "common" if len(rec[t]) * 10 > len(seen) else None) for t, n in occ.items()}
    assert terms.term_frequencies(df.limit(0)).count() == 0


def test_terms_of_an_id_with_many_deliveries(spark):
    from pyspark.sql import functions as F

    hot = spark.range(0, 3000, 1, 6).select(F.lit(1).cast("long").alias("locus_id"), F.expr("array('solus', 'bis', 'bis')").alias("tokens"))
    others = spark.range(2, 30).select(F.col("id").alias("locus_id"), F.expr("array('bis', 'ter')").alias("tokens"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        got = {tuple(r) for r in terms.term_frequencies(hot.unionByName(others)).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {("solus", 1, 1, "rare"), ("bis", 30, 29, "common"), ("ter", 28, 28, "common")}


@pytest.mark.parametrize("dictionary", [1000, 2])
@pytest.mark.parametrize("share", [256, 3])
def test_pairs(spark, monkeypatch, dictionary, share):
    monkeypatch.setattr(pairs, "HEAVY_SHARE", share)
    if share == 3:  # blocks end by their postings
        monkeypatch.setattr(pairs, "POSTINGS", 40)
    rng = random.Random(5)
    names = [f"{a}{b}" for a in "abcdef" for b in "xyz"]
    rows = []
    for i in range(600):
        base = rng.sample(names, rng.randrange(5))
        rows.append((i, base + [names[k] for k in (i % 18, (i % 18 + 1) % 18)] if i % 5 else base))
    rows += [(0, rows[0][1]), (None, names)]
    df = spark.createDataFrame(rows, "locus_id long, tokens array<string>")
    sets = {i: set(t) for i, t in rows if i is not None}
    n, df_, ab = len(sets), {}, {}
    for s in sets.values():
        for t in s:
            df_[t] = df_.get(t, 0) + 1
        for p in combinations(sorted(s), 2):
            ab[p] = ab.get(p, 0) + 1
    for lift in (1, 1.5):
        want = {(*p, c, df_[p[0]], df_[p[1]]) for p, c in ab.items() if c >= 10 and c * n >= lift * df_[p[0]] * df_[p[1]]}
        got = pairs.cooccurrences(df, min_lift=lift, dictionary_rows=dictionary).collect()
        assert {tuple(r)[:5] for r in got} == want and len(got) == len(want) > 0
    assert pairs.cooccurrences(df.limit(0)).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_word_distance():
    rng = random.Random(2)
    for _ in range(3000):
        a = [rng.randrange(5) for _ in range(rng.randrange(1, 90))]
        b = [x for x in a if rng.random() > 0.05] if rng.random() < 0.7 else [rng.randrange(5) for _ in range(rng.randrange(1, 90))]
        d, most = distance(a, b), rng.randrange(12)
        assert min(leakage.word_distance(a, b, most), most + 1) == min(d, most + 1)


def test_chunks_leave_no_pair_out():
    import numpy as np

    rng = random.Random(4)
    for _ in range(3000):
        n = rng.randrange(8, 90)
        a = [rng.randrange(1, 1 << 40) for _ in range(n)]
        b = list(a)
        for _ in range(rng.randrange(1, n // 8 + 1)):
            k = rng.randrange(len(b))
            match rng.randrange(3):
                case 0:
                    b[k] = rng.randrange(1, 1 << 40)
                case 1:
                    del b[k]
                case _:
                    b.insert(k, rng.randrange(1, 1 << 40))
        most = max(len(a), len(b)) // 8
        if leakage.word_distance(a, b, most) > most:
            continue
        lists = np.array(a + b, np.uint64)
        lengths = np.array([len(a), len(b)])
        row, at, digest = leakage.chunk_hashes(lists, lengths)
        hot = np.unique(rng.sample(digest.tolist(), rng.randrange(len(digest))))
        hot = (hot.astype(np.uint64), np.array(rng.sample(range(len(hot)), len(hot)), np.uint64))
        keep = leakage.chosen(row, digest, lengths, hot)
        assert all(np.bincount(row[keep], minlength=2) <= [leakage.prefix(len(a)), leakage.prefix(len(b))])
        x, y = ([(int(h), int(p)) for h, p in zip(digest[keep & (row == k)], at[keep & (row == k)])] for k in (0, 1))
        longer = len(a) - len(b)
        assert any(h == h2 and abs(p - q) + abs(longer - (p - q)) <= most for h, p in x for h2, q in y)


def test_shared_words():
    import numpy as np

    rng = random.Random(11)
    a, b = ([[rng.randrange(1, 5) for _ in range(rng.choice([0, 2, 3, 7, 12]))] for _ in range(60)] for _ in range(2))
    flat = lambda lists: (np.array([w for x in lists for w in x], np.uint64), np.array([len(x) for x in lists]))
    chunks, words = leakage.shared_words(flat(a), flat(b))
    for k, (x, y) in enumerate(zip(a, b)):
        has = {tuple(y[i : i + 3]) for i in range(len(y) - 2)}
        met = [i for i in range(len(x) - 2) if tuple(x[i : i + 3]) in has]
        assert chunks[k] == len(met) and words[k] == len({i + j for i in met for j in range(3)})


def test_pairs_of_repeated_words(spark):
    # few words, so chunks recur within a list and across lists, and a phrase that every list has
    rng = random.Random(12)
    rows = []
    for i in range(260):
        t = list(rng.choice(rows)[2]) if rows and rng.random() < 0.5 else ["in", "the", "name", "of"] + [rng.choice("ab") for _ in range(rng.randrange(3, 24))]
        if rng.random() < 0.7:
            k = rng.randrange(len(t))
            t[k : k + rng.randrange(2)] = [rng.choice("abc")]
        rows.append((i, 1 + i % 2, t))
    rows += [(300 + k, 1 + k % 2, ["la"] * n) for k, n in enumerate([7, 8, 9, 40, 45, 46, 3000, 3001])]
    want = {(min(i, j), max(i, j)) for (i, f, a), (j, g, b) in combinations(rows, 2) if f != g and max(len(a), len(b)) < 100 and min(len(a), len(b)) > 5 and 8 * distance(a, b) <= max(len(a), len(b))}
    want.add((306, 307))
    df = spark.createDataFrame(rows, "rec_id long, file_id long, tokens array<string>")
    manifest = spark.createDataFrame([(1, "a", "train"), (2, "a", "test")], "file_id long, corpus_id string, split_name string")
    got = leakage.cross_split_pairs(df, manifest).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 100


def test_cross_split_pairs(spark):
    import unicodedata

    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(60)] + ["Été", "été", "été", "ſol", "sol", None, " ", ""]
    files = [(1, "a", "train"), (2, "a", " Dev"), (3, "b", "TEST"), (4, "b", None), (5, "c", "Train")]
    rows = []
    for i in range(300):
        if rows and rng.random() < 0.6:
            t = list(rng.choice(rows)[2] or [])
            for _ in range(rng.randrange(3)):
                if t:
                    t[rng.randrange(len(t))] = rng.choice(vocabulary)
        else:
            t = [rng.choice(vocabulary) for _ in range(rng.randrange(30))]
        rows.append((i, rng.choice([1, 2, 3, 4, 5, None, 77]), t if i % 40 else None))
    norm = lambda w: "".join(c for c in unicodedata.normalize("NFKD", w).casefold() if not unicodedata.combining(c)).strip()
    role = {1: 1, 5: 1, 2: 2, 3: 2}
    ok = [(i, role[f], w) for i, f, t in rows if f in role and len(w := [x for x in (norm(y) for y in t or [] if y is not None) if x]) >= 6]
    want = {(min(i, j), max(i, j)) for (i, r, a), (j, s, b) in combinations(ok, 2) if r != s and 8 * distance(a, b) <= max(len(a), len(b))}
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows + rows[:9]], "rec_id long, file_id long, tokens array<string>, role int, class string, rec string")
    manifest = spark.createDataFrame(files, "file_id long, corpus_id string, split_name string")
    got = leakage.cross_split_pairs(df, manifest).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 20
    over = {r.rec_id: r.overlap for r in leakage.overlap_fractions(df, manifest).collect()}
    assert set(over) == {i for i, r, _ in ok if r == 2} and all(0 <= x <= 1 for x in over.values())
    report = leakage.leakage_report(df, manifest).collect()
    assert sum(r.n_pairs for r in report) == len(want)
    assert leakage.cross_split_pairs(df.limit(0), manifest).count() == 0


def test_overlap_of_unlike_lengths(spark):
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(40)}"
    rows = [(i, 1, [word() for _ in range(rng.choice([6, 9, 18, 25, 40]))]) for i in range(60)]
    whole = set()
    for i in range(60, 160):
        long_ = rng.choice(rows[:60])[2]
        n = rng.choice([6, 7, 8, 10, 12, 13, 18])
        at = rng.randrange(max(1, len(long_) - n))
        part = long_[at : at + n]
        if i % 2:
            part = [*(word() for _ in range(rng.randrange(9))), *part[: rng.randrange(2, n)], *(word() for _ in range(rng.randrange(9)))]
        elif len(part) >= 6:
            whole.add(i)
        rows.append((i, 2, part))
    runs = {tuple(t[k : k + 3]) for _, f, t in rows if f == 1 for k in range(len(t) - 2)}
    want = {i: (len(t), len({k + j for k in range(len(t) - 2) if tuple(t[k : k + 3]) in runs for j in range(3)})) for i, f, t in rows if f == 2 and len(t) >= 6}
    df = spark.createDataFrame(rows + rows[-5:], "rec_id long, file_id long, tokens array<string>")
    manifest = spark.createDataFrame([(1, "a", "train"), (2, "a", "test")], "file_id long, corpus_id string, split_name string")
    got = leakage.overlap_fractions(df, manifest).collect()
    assert {r.rec_id: (r.n_words, r.shared_words) for r in got} == want and len(got) == len(want)
    assert len(whole) > 20 and {r.overlap for r in got if r.rec_id in whole} == {1.0}
    assert len({s for _, s in want.values()}) > 5


KINDS = [
    ("<p>Bonum</p>", {("html", "inline")}),
    ("a < b and c > d; 39 < 42 and 39 > 37", set()),
    ("<f12v.3,@P0> daiin<->chol <%>shol<$> <!faint ink> [a:o] {cth} @130; <! $Q=A $L=B>", set()),
    ("cost $70 or $75, 12'' by 14'', 5 * 3 * 2, no. 16. Bae, unit_count_max, AT&T-like; recto\\verso [sic] {Plo} c<9> shelf # 50 p|q|r a == b", set()),
    ("x $E=mc^2$ y \\(a\\) \\[b\\]", {("latex", "formula")}),
    ("```py\n# no\n**no** <b>no</b>\n```", {("markdown", "code_block")}),
    ("\\begin{verbatim}\n\\alpha '''no'''\n\\end{verbatim}", {("latex", "code_block")}),
    ("<pre><code>x &lt; y\n* no</code></pre>", {("html", "code_block")}),
    ("{| class=\"wikitable\"\n|-\n! A\n|-\n| 7\n|}", {("wiki", "table")}),
    ("| a | n |\n|---|---:|\n| b | 7 |", {("markdown", "table")}),
    ("\\begin{tabular}{lr}\na & 92 \\\\\n\\end{tabular}", {("latex", "table")}),
    ("<table border=1><tr><th>a</th><td>2</td></tr></table>", {("html", "table")}),
    ("Title here\n====\n\ntext", {("markdown", "heading")}),
    ("## T ##\n\n=== W ===\n\n\\subsection*{S}\n\n<h3>H</h3>", {("markdown", "heading"), ("wiki", "heading"), ("latex", "heading"), ("html", "heading")}),
    ("- [ ] a\n1) b\n+ c", {("markdown", "list_item")}),
    ("; t : d\n: e", {("wiki", "list_item")}),
    ("\\begin{itemize}\\item a \\item[b] c\\end{itemize} <list><item n=\"2\">x</item></list>", {("latex", "list_item"), ("html", "list_item")}),
    ("<math><mi>H</mi><mo>=</mo><mn>2</mn></math>", {("html", "formula")}),
    ("'''b''' ''i'' [[a|b]] {{lang|la|x}}", {("wiki", "inline")}),
    ("**b** *i* _u_ `c` [t](u.html) ~~s~~ ![x](y.png)", {("markdown", "inline")}),
    ("\\emph{e} {\\it f} \\cite{k} \\& x", {("latex", "inline")}),
    ("&nbsp;<!-- gone --><choice><sic>a</sic><corr>b</corr></choice>", {("html", "inline")}),
]


@pytest.mark.parametrize("text,kinds", KINDS)
def test_kinds(text, kinds):
    assert set(markup.convert(text)[1]) == kinds


def test_clean_text():
    clean = lambda s: markup.convert(s)[0]
    assert clean("<h2>T</h2><ul><li>a</li><li>b</li></ul>") == "## T\n\n- a\n- b"
    assert clean("<choice><sic>teh</sic><corr>the</corr></choice> &amp; x") == "the & x"
    assert clean("see [[a|b]] and **c**, $x_1$") == "see b and c, $x_1$"
    assert clean("\\begin{tabular}{lr}\na & 9 \\\\\n\\end{tabular}") == "| a | 9 |"
    assert clean("```\nx < 1\n```") == "```\nx < 1\n```"
    for same in (None, "", "  ", "plain words", "a < b"):
        assert markup.convert(same) == (same, [])
    nav = "\n".join(['<a href="1">Home</a> <a href="2">News</a> <a href="3">Shop</a>'] * 4 + ["<p>" + "Long prose of the page itself goes on here. " * 6 + "</p>"] * 6)
    assert "Home" not in clean(nav) and clean(nav).count("Long prose") == 36
    markup.convert("<" * 20000 + "*" * 20000 + "[[" * 9000 + "$" * 3000 + "\\[" * 3000 + "`" * 999)


def test_no_text_is_lost():
    clean = lambda s: markup.convert(s)[0]
    assert clean("a <del>gone</del> b <del>stays\n\nnext</p> words") == "a  b stays\n\nnext\n\n words"
    assert clean("x <script>y stays") == "x y stays" and clean("x <style>p</style>z") == "x z"
    assert clean("one <!-- two *a*\n\n**b**") == "one two *a*\n\nb" and clean("a<!-- b -->c") == "ac"
    assert clean("<figure><p>picture</p><head>Caption</head></figure>") == "picture\n\n## Caption"
    assert clean("a <choice><sic>wrd</sic></choice> b") == "a wrd b"
    assert clean("<choice><abbr>etc</abbr><expan>et cetera</expan></choice>") == "et cetera"
    assert clean("<choice><orig>u</orig><reg>v</reg>") == "v"


def test_nesting_without_end():
    clean = lambda s: markup.convert(s)[0]
    assert clean("\\emph{" * 60 + "x" + "}" * 60) == "x"
    assert clean("a" + "{{t|" * 40 + "x" + "}}" * 40 + "b") == "ab"
    assert clean("**a *b __c ''d ~~e~~ d'' c__ b* a**") == "a b c d e d c b a"
    assert clean("*" + "word " * 3000 + "end*") == "word " * 3000 + "end"
    assert clean("\ufdd05\ufdd1 *a*") == "\ufdd05\ufdd1 a"


def test_content_regions_at_every_size():
    nav = '<a href="1">Home</a> | <a href="2">News of the day and of the week</a>'
    prose = "Prose of some length stands here, without any tag in it, and goes on."
    for lines in (2, 3, 4, 9):
        for words in (3, 6, 40):
            clean, kinds = markup.convert("\n".join([nav] * lines + [prose] * words))
            assert clean.count("Prose") == words and clean.count("Home") <= 1 and kinds == [("html", "inline")]
    assert markup.convert(nav)[0] == "Home | News of the day and of the week"
    assert markup.convert("\n".join([nav] * 5))[0].count("Home") == 5  # nothing but links: nothing to tell them from
    titled = "\n".join(["<h2>Title</h2>", nav, nav, nav, *[prose] * 5])
    assert markup.convert(titled)[0].startswith("## Title")


def test_dropped_lines(spark):
    page = "\n".join(['<a href="1">Home</a> &amp; <a href="2">News</a>'] * 3 + ["Prose of some length stands here, without any tag in it."] * 4)
    df = spark.createDataFrame([(1, page, "x"), (2, None, "y"), (3, "a < b", "z"), (4, "", None)], "doc_id long, text string, line string")
    rows = sorted(tuple(r) for r in markup.dropped_lines(df, "doc_id", "text").collect())
    assert rows and {r[0] for r in rows} == {1} and all(line == "Home &amp; News" for *_, line in rows)
    assert markup.convert(page)[0].count("Home") + len(rows) == 3


def test_markup_rows(spark):
    df = spark.createDataFrame([(1, "**a** <b>x</b>", "c1", 1), (1, "**a** <b>x</b>", "c1", 2), (2, None, "[[c2]]", 3), (3, "", None, 4)], "paragraph_id long, text string, chapter_id string, kinds int")
    got = sorted(tuple(r) for r in markup.markup_kinds(df, "paragraph_id", ["text", "chapter_id"]).collect())
    assert got == [(1, "text", "html", "inline"), (1, "text", "markdown", "inline"), (2, "chapter_id", "wiki", "inline")]
    assert markup.markup_kinds(df.limit(0), "paragraph_id", ["text"]).count() == 0
